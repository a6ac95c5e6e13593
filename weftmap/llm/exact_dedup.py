"""Exact deduplication over a cuckoo-filter index.

Texts are equal when they are identical after every run of white space has
become one space. Each text is known by the SHA-256 digest of that form.

:class:`CuckooIndex` is a cuckoo filter whose slots hold a short fingerprint of
a digest; a fingerprint that hits is held against the stored digest and then
against the stored content itself. Digests can be deleted again, and a full
table grows by rehashing from the digests that it stores, so there is no false
answer and no lost key.

Distribution: every task folds its rows into an index first, so a text with a
third of all rows leaves each task as a row or a few; the partial rows meet
by digest, sorted, and are folded again. An index holds live digests only: those
met since ``LIVE`` bytes of content went by, and behind the sort those of the
digest at hand. The others have been sent on and deleted, so the index does not
grow with the input.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmap.llm._bytes import chunks, normalised
from weftmap.llm._session import integer_id, partitions, text_or_empty

SLOTS = 4
MAX_KICKS = 200
LIVE = 1 << 24  # bytes of content that an index holds before it is emptied


class CuckooIndex:
    """A cuckoo filter over 32-byte digests, with the digests kept for checks.

    ``bits`` is the width of a fingerprint. Bucket ``b`` and fingerprint ``f``
    have the alternate bucket ``b ^ hash(f)``, so a slot can move without its key.
    """

    def __init__(self, buckets: int = 64, bits: int = 16):
        self._mask_f = (1 << bits) - 1
        self._make(1 << max(1, (buckets - 1).bit_length()))
        self._n = 0
        self.resizes = 0

    def _make(self, buckets: int) -> None:
        self._mask = buckets - 1
        self._prints: list[list[int]] = [[] for _ in range(buckets)]
        self._kept: list[list[list]] = [[] for _ in range(buckets)]  # [digest, payload]

    def __len__(self) -> int:
        return self._n

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(digest[:4], "little") & self._mask_f or 1
        b = int.from_bytes(digest[4:12], "little") & self._mask
        return f, b, self._other(b, f)

    def _other(self, bucket: int, f: int) -> int:
        return (bucket ^ (f * 0x5BD1E995)) & self._mask

    def find(self, digest: bytes) -> list | None:
        """The stored ``[digest, payload]``, or None; a fingerprint alone is no hit."""
        f, a, b = self._places(digest)
        for at in (a, b):
            prints = self._prints[at]
            if f in prints:
                for kept in self._kept[at]:
                    if kept[0] == digest:
                        return kept
        return None

    def insert(self, digest: bytes, payload) -> None:
        """Add a digest that is not there yet."""
        self._put([digest, payload])
        self._n += 1

    def _put(self, item: list) -> None:
        f, a, b = self._places(item[0])
        for at in (a, b):
            if len(self._prints[at]) < SLOTS:
                self._prints[at].append(f)
                self._kept[at].append(item)
                return
        at = b
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            f, self._prints[at][slot] = self._prints[at][slot], f
            item, self._kept[at][slot] = self._kept[at][slot], item
            at = self._other(at, f)
            if len(self._prints[at]) < SLOTS:
                self._prints[at].append(f)
                self._kept[at].append(item)
                return
        self._grow(item)

    def _grow(self, homeless: list) -> None:
        everything = [x for bucket in self._kept for x in bucket] + [homeless]
        self.resizes += 1
        self._make(2 * (self._mask + 1))
        for x in everything:
            self._put(x)

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not there."""
        f, a, b = self._places(digest)
        for at in (a, b):
            for slot, kept in enumerate(self._kept[at]):
                if kept[0] == digest:
                    del self._kept[at][slot]
                    del self._prints[at][slot]
                    self._n -= 1
                    return True
        return False

    def items(self):
        for bucket in self._kept:
            yield from bucket


def digests_of(column: pa.Array):
    """(first row, digests, bytes, offsets) of slices of a column of texts, all of them normalised."""
    for first, data, offsets in chunks(column):
        data, offsets = normalised(data, offsets)
        raw = memoryview(data)
        yield first, [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], raw, offsets


class Folder:
    """An index whose payloads are ``[content, least id, rows]``; :meth:`emptied` sends all on and deletes them."""

    def __init__(self):
        self.index = CuckooIndex()
        self.held = 0

    def add(self, key: bytes, content, doc: int | None, n: int) -> None:
        if (hit := self.index.find(key)) is None:
            content = bytes(content)
            self.index.insert(key, [content, doc, n])
            self.held += len(content) + 100
            return
        known = hit[1]
        if known[0] != content:
            raise ValueError(f"two texts share the digest {key.hex()}")
        known[2] += n
        if doc is not None and (known[1] is None or doc < known[1]):
            known[1] = doc

    def emptied(self) -> list[tuple]:
        rows = [(key, *payload) for key, payload in self.index.items()]
        for key, *_ in rows:
            self.index.delete(key)
        self.held = 0
        return rows


PARTIAL = "digest binary, content binary, keep_id long, group_size long"


def _rows(rows: list[tuple], with_content: bool):
    """Record batches of bounded size."""
    while rows:
        n, size = 0, 0
        while n < len(rows) and n < 20_000 and size < 1 << 22:
            size += len(rows[n][1])
            n += 1
        part, rows = rows[:n], rows[n:]
        columns = [pa.array([r[0] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64())]
        names = ["digest", "keep_id", "group_size"]
        if with_content:
            columns.insert(1, pa.array([r[1] for r in part], pa.binary()))
            names.insert(1, "content")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _fold(batches):
    """(id, text) rows -> digest, content, least id and number of the rows that this task met between two emptyings."""
    folder = Folder()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, keys, raw, offsets in digests_of(batch.column(1)):
            for i, key in enumerate(keys):
                folder.add(key, raw[offsets[i] : offsets[i + 1]], ids[first + i], 1)
            if folder.held >= LIVE:
                yield from _rows(folder.emptied(), True)
    yield from _rows(folder.emptied(), True)


def _meet(batches):
    """Partial rows sorted by digest -> one row for each digest; a digest is live until the next one comes."""
    folder, out, now = Folder(), [], None
    for batch in batches:
        ids, sizes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i in range(len(ids)):
            key = batch.column(0)[i].as_py()
            if key != now:
                out += folder.emptied()
                now = key
            folder.add(key, memoryview(batch.column(1)[i].as_buffer()).cast("B"), ids[i], sizes[i])
        out = [(k, b"", d, n) for k, _, d, n in out]
        if len(out) >= 20_000:
            yield from _rows(out, False)
            out = []
    yield from _rows([(k, b"", d, n) for k, _, d, n in out + folder.emptied()], False)


def _known(batches):
    for batch in batches:
        for first, keys, _, _ in digests_of(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(keys)), pa.array(keys, pa.binary())], names=["id", "digest"])


def _marked(columns: list[str], at: int):
    """Rows with all their columns and, last, the digest of the text at ``at``."""

    def run(batches):
        for batch in batches:
            for first, keys, _, _ in digests_of(batch.column(at)):
                part = batch.slice(first, len(keys))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*columns, "_wm_digest"])

    return run


def groups(own: DataFrame) -> DataFrame:
    """(id, text) rows -> (digest, keep_id, group_size), by two folds into cuckoo indexes."""
    partial = own.mapInArrow(_fold, PARTIAL).repartition(partitions(own.sparkSession), "digest").sortWithinPartitions("digest")
    return partial.mapInArrow(_meet, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. A null text is an empty
    one; a null id loses against any other. Rows that repeat both id and text
    all count in group_size, and exactly one of them has kept = true (rows of a
    group without any id: one of them). An empty table gives an empty table. Ids
    are whole numbers, others are refused.
    """
    own = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    repeats = own.mapInArrow(_known, "id long, digest binary").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("_wm_n"))
    joined = repeats.join(groups(own), "digest")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_wm_n"))).alias("_wm_copy"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ).select(
        id_col,
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_wm_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat id and text the one stays whose other columns hash
    lowest, so reruns agree (columns of maps have no say).
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = kept.select(F.col(id_col).isNotNull().alias("_wm_known"), F.coalesce(id_col, F.lit(0).cast("long")).alias("_wm_id"), F.unhex("text_sha256").alias("_wm_digest"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_wm_digest", T.BinaryType())])
    marked = docs.mapInArrow(_marked(docs.columns, docs.columns.index(text_col)), schema)
    marked = marked.withColumns({"_wm_known": F.col(id_col).isNotNull(), "_wm_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))})
    # the texts are dealt once: the join and the choice among repeated rows go by the same columns
    stay = marked.join(kept, ["_wm_known", "_wm_id", "_wm_digest"], "left_semi")
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = stay.groupBy("_wm_known", "_wm_id", "_wm_digest").agg(F.min_by(row, order).alias("_wm_row"))
    return chosen.select("_wm_row.*")
