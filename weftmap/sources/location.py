"""Where a source is: a connection's path, a URL, or a path beside the program."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from weftmap.errors import Refusal
from weftmap.session import filesystem

EXTENSIONS = {
    "csv": (".csv", ".tsv", ".txt"),
    "json": (".json", ".jsonl", ".ndjson"),
    "parquet": (".parquet",),
    "rdf": (".ttl", ".nt", ".n3", ".rdf"),
    "shex": (".shex", ".shexc", ".shexj", ".json"),
    "shacl": (".ttl", ".nt", ".n3", ".rdf"),
}


def resolve(uri: str, base: str | None, connections: dict[str, str] | None = None) -> str:
    """``@name/path`` under a connection, a URL or absolute path as it is, else beside ``base``; never the working directory."""
    if uri.startswith("@"):
        name, _, rest = uri[1:].partition("/")
        if name not in (connections or {}):
            raise Refusal("source/not-found", f"there is no connection `{name}`")
        return connections[name].rstrip("/") + "/" + rest
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) or uri.startswith("/"):
        return uri
    if base is None:
        raise Refusal("source/not-found", f"`{uri}` is relative, and the program has no place of its own")
    return base.rstrip("/") + "/" + uri


def check_extension(reader: str, uri: str) -> None:
    last = uri.rstrip("/").rpartition("/")[2]
    if "." in last and not any(last.lower().endswith(e) or e + "." in last.lower() for e in EXTENSIONS[reader]):
        raise Refusal("provider/wrong-extension", f"io.{reader} reads {', '.join(EXTENSIONS[reader])}, and this is `{last}`")


def check_exists(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    found = fs.globStatus(where)
    if found is None or not len(found):
        raise Refusal("source/not-found", f"there is nothing at `{path}`")


def read_text(spark: SparkSession, path: str) -> str:
    """A small document (a program, a shape document) as text."""
    check_exists(spark, path)
    rows = spark.read.text(path, wholetext=True).collect()
    return "\n".join(r.value for r in rows)
