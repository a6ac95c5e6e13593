"""Training-data operators.

Ten operators over a corpus of documents, and the queries that apply them.
Nothing outside this subpackage imports it; the library works without it.

Conventions shared by all operators:

* a null text counts as an empty text;
* a null id sorts after every other id and never matches another null id
  unless the operator says so;
* extra columns pass through untouched or are ignored, and internal columns
  carry the prefix ``_wm_`` so that they do not clash with the caller's;
* white space is ``[\\x20\\x09-\\x0D]`` and a word is a maximal run of anything
  else, in bytes of UTF-8.
"""
