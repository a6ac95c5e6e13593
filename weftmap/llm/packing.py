"""Best-fit packing of token ids into sequences of bounded length.

A document becomes the ids of its text and a closing id. Ids beyond one
sequence are cut off in whole sequences at the end, so at most the first piece
is short; full pieces are sequences of their own and the short ones are packed.

:class:`BestFit` is online best fit with bounded space: pieces are placed one by
one as they come; at most ``max_open`` bins are open, found through a bitset in
which bit f says that some open bin has f free. A piece goes where the least
space remains; when a new bin would be one too many, the fullest is closed. It
keeps a number per bin and no contents.

Distribution: each task packs its own partition; sequences never span
partitions, and a partition leaves a few open bins at most partly filled. A task
holds one batch of texts and the numbers of its open bins; nothing is shuffled.

Ids are those of the ``tokenizers`` file. For a file of the plain byte-level kind
(:func:`plain`) they are made by ``tiktoken`` from the same vocabulary; any other
file is run by ``tokenizers`` itself.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftmap.llm._session import text_or_empty

LIMIT = 1024
CLOSING = 2
MAX_OPEN = 64
ROWS = 16_384  # rows of a result's batch
SPECIAL = "<|endoftext|>"
#: The split pattern of byte-level BPE vocabularies of this family, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern's search fails on runs of about a million blanks; runs from this length on do not reach it.
LONG_RUN = 100_000
#: What the pattern takes for white space; Python's own has four characters more.
_LONG_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class BestFit:
    """Bounded-space online best fit for pieces of 1..limit."""

    def __init__(self, limit: int = LIMIT, max_open: int = MAX_OPEN):
        self.limit = limit
        self.max_open = max_open
        self._bits = 0  # bit f: an open bin has f free
        self._bins: list[list[int]] = [[] for _ in range(limit + 1)]
        self._open = 0
        self.sequences = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset in it) for the next piece."""
        if not 0 < length <= self.limit:
            raise ValueError(f"a piece of {length} does not fit {self.limit}")
        fits = self._bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bins = self._bins[free]
            sequence = bins.pop()
            if not bins:
                self._bits ^= 1 << free
            self._open -= 1
        else:
            free = self.limit
            sequence = self.sequences
            self.sequences += 1
        left = free - length
        if left:
            if self._open >= self.max_open:
                self._close_fullest()
            if not self._bins[left]:
                self._bits |= 1 << left
            self._bins[left].append(sequence)
            self._open += 1
        return sequence, self.limit - free

    def _close_fullest(self) -> None:
        free = (self._bits & -self._bits).bit_length() - 1
        self._bins[free].pop(0)
        if not self._bins[free]:
            self._bits ^= 1 << free
        self._open -= 1


def vocabulary(path: str) -> tuple[list[bytes], dict[str, int]]:
    """The pieces of a byte-level BPE file by id, and the special strings with their ids.

    The ids of that family follow the order of the merges, so the ids are also
    the ranks by which pieces merge.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    back = {c: b for b, c in _byte_letters().items()}
    pieces = [b""] * (1 + max(spec["model"]["vocab"].values()))
    for piece, i in spec["model"]["vocab"].items():
        if piece not in special:
            pieces[i] = bytes(back[c] for c in piece)
    return pieces, special


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves, and the others as code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def plain(spec: dict) -> bool:
    """Does a file say nothing but a byte-level vocabulary, its usual split pattern and special strings?

    That is: texts are taken as they are, no piece has a prefix, suffix or
    stand-in, special strings match anywhere, and ids follow the order of the merges.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    whole = not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (bare and whole and model.get("type") == "BPE" and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return False
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    singles = [i for piece, i in model["vocab"].items() if len(piece) == 1]
    return None not in merged and merged == sorted(merged) and max(singles) < merged[0] and len(model["vocab"]) - len(special & set(model["vocab"])) == len(merged) + len(singles)


_ENCODERS: dict[str, object] = {}  # of this process, by digest of the vocabulary


class Tokens:
    """Turns texts into ids; it carries the vocabulary to the executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self._key = hashlib.sha256(text.encode()).hexdigest()
        self.plain = plain(json.loads(text))
        self._text = None if self.plain else text
        self._pieces, self._special = vocabulary(path) if self.plain else ([], {})

    def _encoder(self):
        if self._key not in _ENCODERS:
            if self.plain:
                import tiktoken

                ranks = {p: i for i, p in enumerate(self._pieces) if p}
                _ENCODERS[self._key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self._special)
            else:
                from tokenizers import Tokenizer

                _ENCODERS[self._key] = Tokenizer.from_str(self._text)
        return _ENCODERS[self._key]

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text; special strings in it are their ids."""
        encoder = self._encoder()
        if not self.plain:
            return np.array(encoder.encode(text, add_special_tokens=False).ids, np.uint32)

        def ids(part: str) -> np.ndarray:
            return encoder.encode_to_numpy(part, allowed_special="all", disallowed_special=())

        if len(text) < LONG_RUN:
            return ids(text)
        # a run is one piece, but for its last blank where more text follows that is no special string
        parts, done = [], 0
        for run in _LONG_RUNS.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(tuple(self._special), end):
                end -= 1
            parts.append(ids(text[done : run.start()]))
            parts.append(np.array(encoder._encode_single_piece(text[run.start() : end]), np.uint32))
            done = end
        return np.concatenate([*parts, ids(text[done:])])


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be short, the others are full."""
    first = n % limit or limit
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)]


def _schema(id_type: str, with_ids: bool) -> str:
    return f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids


def _pack(tokens: Tokens, limit: int, closing: int, max_open: int, with_ids: bool, id_type: pa.DataType):
    import zlib

    kinds = [id_type, pa.int32(), *[pa.int64()] * 5, *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: len(kinds)]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def run(batches):
        bins = BestFit(limit, max_open)
        base = TaskContext.get().partitionId() << 40
        rows: list = []
        for got in batches:
            for key, text in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                ids = np.append(tokens(text.as_py() or ""), np.uint32(closing)).astype("<u4", copy=False)
                for k, (at, n) in enumerate(cuts(len(ids), limit)):
                    part = ids[at : at + n]
                    sequence, offset = bins.place(n)
                    rows.append((key, k, at, n, zlib.crc32(part.tobytes()), base + sequence, offset, part.astype(np.int32) if with_ids else None))
                if len(rows) >= (ROWS if not with_ids else ROWS // 16):
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    closing: int = CLOSING,
    max_open: int = MAX_OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked.

    A null or empty text is the closing id alone. Repeated rows are packed each.
    An empty table gives an empty table. A task's result depends on its rows
    and their order alone, so a task that is run again packs as before.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    run = _pack(Tokens(tokenizer_path), limit, closing, max_open, with_ids, to_arrow_type(kind))
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text")).mapInArrow(run, _schema(kind.simpleString(), with_ids))
    return rows.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids); a sequence has at most ``limit`` ids."""
    from pyspark.sql import functions as F

    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"))
