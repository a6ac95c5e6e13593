"""Secret scans over an incremental blob ledger.

Every version of every text is a blob, known by the SHA-256 digest of its
bytes. The ledger has rows per blob: the rule versions it was scanned with, and
what each of them found. A scan looks up each blob, scans the unseen pairs of
blob and rule version only, once per blob however many paths hold it. Findings
of the rules' present versions are joined back to all paths; those of older
versions stay in the ledger and are passed over. :class:`Ledger` keeps the rows
in a folder, to which each scan adds.

Distribution: digests are computed where the texts lie; blobs meet by digest,
after partial aggregation, as (digest, one path) rows. The text of that one path
is fetched by a join on (digest, path), a key that no group of copies shares.
Findings go back by a join on the digest, which Spark may split where a blob has
very many paths. A task holds one batch of texts at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.llm._bytes import chunks
from weftmap.llm._session import cut, text_or_empty
from weftmap.session import filesystem

# The patterns of the three base rules and the lengths that their matches need.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """A pattern, which group must have how many characters, and strings of which a match holds one (in lower case)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    any_of: tuple[str, ...] = ()
    either_case: bool = False
    extra: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: str):
        flags = re.ASCII | (re.IGNORECASE if self.either_case else 0)
        for m in re.finditer(self.pattern, text, flags):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


RULES = (
    Rule("assign", 1, ASSIGN, 2, 8, ("passw", "secret", "token", "apikey", "api_key"), either_case=True),
    Rule("access", 1, ACCESS, 0, 16, ("akia",)),
    Rule("hex", 1, HEX, 0, 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", any_of=("private key-----",), extra=True),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36}\b", any_of=("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), extra=True),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", any_of=("eyj",), extra=True),
)

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def _long_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """For each text: may it hold ``least`` hexadecimal bytes in a row? (A run across texts may say yes.)"""
    run, have = _HEX_BYTE[data], 1
    while have < least:
        step = min(have, least - have)
        run = run[:-step] & run[step:] if len(run) > step else run[:0]
        have += step
    found = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(run)
    found[np.searchsorted(offsets, at, "right") - 1] = True
    return found


def scan_texts(column: pa.Array, todo: list[list[str]], rules: tuple[Rule, ...] = RULES):
    """For each text the [(start, rule version, end)] of the rules named in its todo, in code points."""
    for first, data, offsets in chunks(column):
        runs = {}
        for i in range(len(offsets) - 1):
            named = set(todo[first + i] or ())
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            low = raw.lower()
            text, found = None, []
            for rule in rules:
                if rule.name not in named:
                    continue
                if rule.any_of:
                    if not any(s.encode() in low for s in rule.any_of):
                        continue
                elif rule.pattern == HEX:
                    if rule.least not in runs:
                        runs[rule.least] = _long_runs(data, offsets, rule.least)
                    if not runs[rule.least][i]:
                        continue
                text = raw.decode() if text is None else text
                found += [(a, rule.name, b) for a, b in rule.find(text)]
            yield found


def _scan(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rule", pa.string()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            todo = batch.column(1).to_pylist()
            found = [[{"start": a, "rule": k, "end": b} for a, k, b in f] for f in scan_texts(batch.column(2), todo, rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["blob", "done", "findings"])

    return run


LEDGER = "blob binary, done array<string>, findings array<struct<start: int, rule: string, end: int>>"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def unseen_pairs(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, path, todo): the blobs with rule versions that the ledger lacks, and the smallest id that holds each (null counts as an id)."""
    names = F.array(*[F.lit(r.name) for r in rules])
    held = docs.select(docs[id_col].alias("id"), blob(docs[text_col]).alias("blob"))
    unseen = held.groupBy("blob").agg(F.min("id").alias("path"))
    if ledger is None:
        return unseen.withColumn("todo", names)
    done = ledger.groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("done"))
    unseen = unseen.join(done, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))))
    return unseen.filter(F.size("todo") > 0).drop("done")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, unseen: DataFrame | None = None) -> DataFrame:
    """The ledger rows that ``docs`` add: (blob, rule versions now done, their findings).

    One scan per distinct text with an unseen rule version. Rows that repeat id
    and text are fetched together and one of them stands for all.
    """
    unseen = unseen_pairs(docs, ledger, id_col, text_col, rules) if unseen is None else unseen
    texts = docs.select(docs[id_col].alias("_wm_id"), blob(docs[text_col]).alias("_wm_blob"), text_or_empty(docs[text_col]).alias("_wm_text"))
    fetched = texts.join(unseen, (F.col("_wm_blob") == F.col("blob")) & F.col("_wm_id").eqNullSafe(F.col("path")))
    return fetched.select("blob", "todo", F.col("_wm_text")).mapInArrow(_scan(rules), LEDGER).dropDuplicates(["blob"])


class Ledger:
    """A ledger in a folder: one Parquet table, to which every scan appends in one job, so a scan that fails adds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        fs, where = filesystem(self._spark, self.path)
        return self._spark.read.schema(LEDGER).parquet(self.path) if fs.exists(where) else None

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
        """Scan what is unseen; how many blobs that were. Where nothing is, no text is fetched."""
        unseen = cut(unseen_pairs(docs, self.rows(), id_col, text_col, rules), "unseen")
        n = unseen.count()
        if n or self.rows() is None:
            scan_unseen(docs, None, id_col, text_col, rules, unseen).write.mode("append").parquet(self.path)
        return n


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, blob and the findings (start, place of the rule in ``rules``, end) of its blob, sorted.

    Only findings of the versions that ``rules`` name count.
    """
    held = docs.select(docs[id_col], blob(docs[text_col]).alias("blob"))
    names = F.array(*[F.lit(r.name) for r in rules])
    placed = F.transform(
        F.flatten(F.collect_list("findings")),
        lambda f: F.struct(f["start"].alias("start"), (F.array_position(names, f["rule"]) - 1).cast("int").alias("rule"), f["end"].alias("end")),
    )
    known = ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.filter(placed, lambda f: f["rule"] >= 0)).alias("findings"))
    empty = F.array().cast("array<struct<start: int, rule: int, end: int>>")
    return held.join(known, "blob", "left").select(id_col, "blob", F.coalesce("findings", empty).alias("findings"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(rule: int) -> Column:
    return F.size(F.filter("findings", lambda s: s["rule"] == rule)).cast("long")


def report(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of :func:`findings`."""
    base = [k for k, r in enumerate(rules) if not r.extra]
    own = F.filter("findings", lambda s: s["rule"].isin(base))
    return found.select(
        id_col,
        *[_count(k).alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(_joined(own, rules).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("findings"), rules).alias("spans"),
    )
