"""weftmap: tables and RDF in, a typed property graph out, on PySpark.

Subpackages: ``sources`` read, ``functions`` are expressions over columns,
``operators`` are the relational algebra and graph construction, ``plans`` are
the program text, its checks and its run, ``sinks`` write, ``streaming`` says
why there is nothing to stream.
"""
