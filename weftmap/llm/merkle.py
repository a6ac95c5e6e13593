"""Document fingerprints: Merkle trees over sections, paragraphs and leaves.

A text is cut into leaves of a few words, at words whose hash says so (about
one in four), at the ends of paragraphs (lines), and 64 words behind the last
of these at the latest. A leaf covers its words and the white space behind them, so the leaves
cover every byte. Leaves form paragraphs, paragraphs form sections (a section
ends at a paragraph whose digest says so, about one in four), sections form the
document. The digest of a node is made of its children's digests in order.

A fingerprint is ``ROOT:BODY``: the root in hexadecimal and 6 hexadecimal digits
of each leaf, with ``,`` behind each paragraph and ``/`` behind each section.
Equal texts have equal fingerprints, and equal roots mean equal texts: digests
are of 128 bits from the leaves (two independent hashes of their bytes) to the
root. As leaves are cut by content, an edit changes the leaves it touches and
leaves the others alone: :func:`likeness` is the share of leaves that two
fingerprints have in common, :func:`differing` aligns the branches and walks
down those that differ, :meth:`Trees.first_difference` finds the first of them.

The neighbours of :func:`neighbours` (the next document in descending order of
ids) meet in one shuffle of the texts into ranges of ids. The ends of the ranges
are quantiles; of each range the driver knows one id.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmap.llm._bytes import CHUNK, Blocks, U, mix, words
from weftmap.llm._session import integer_id, partitions, text_or_empty

LEAF_WORDS = 4
SECTION_PARAGRAPHS = 4
LONGEST_LEAF = 64
DIGITS = 6
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _parents(children: list[np.ndarray], last: np.ndarray) -> list[np.ndarray]:
    """Digests (two lanes) of runs of children; ``last`` holds the index of the last child of each run."""
    first = np.concatenate(([0], last[:-1] + 1))
    place = mix(np.arange(len(children[0]), dtype=U) - np.repeat(first.astype(U), np.diff(np.concatenate((first, [len(children[0])])))) + U(1))
    return [mix(np.add.reduceat(mix(lane ^ place), first)) for lane in children]


@dataclass
class Trees:
    """The trees of some texts, level by level: digests (two lanes), and where the children of each node begin (n + 1 numbers)."""

    prints: list[str]
    leaves: list[np.ndarray]
    paragraphs: list[np.ndarray]
    sections: list[np.ndarray]
    of_paragraph: np.ndarray  # leaves
    of_section: np.ndarray  # paragraphs
    of_text: np.ndarray  # sections
    leaf_first: np.ndarray  # leaves of texts

    @property
    def short(self) -> np.ndarray:
        """The part of each leaf's digest that is written."""
        return (self.leaves[0] >> U(64 - 4 * DIGITS)).astype(np.uint32)

    def first_difference(self, i: int, other: Trees, j: int) -> tuple[int, int, int] | None:
        """(section, paragraph in it, leaf in that) where text i and the other's text j begin to differ, found from the roots down; None if they are equal."""
        if self.prints[i][:32] == other.prints[j][:32]:
            return None
        path, a, b = [], i, j
        for level, mine, theirs in (("sections", "of_text", "of_text"), ("paragraphs", "of_section", "of_section"), ("leaves", "of_paragraph", "of_paragraph")):
            first_a, first_b = getattr(self, mine)[a : a + 2], getattr(other, theirs)[b : b + 2]
            n = int(min(first_a[1] - first_a[0], first_b[1] - first_b[0]))
            k = n
            for x, y in zip(getattr(self, level), getattr(other, level), strict=True):
                apart = np.flatnonzero(x[first_a[0] : first_a[0] + n] != y[first_b[0] : first_b[0] + n])
                k = min(k, int(apart[0])) if len(apart) else k
            path.append(k)
            if k == n:  # one of them ends here
                return (*path, *[0] * (3 - len(path)))
            a, b = int(first_a[0]) + k, int(first_b[0]) + k
        return tuple(path)


def trees(texts: list[bytes]) -> Trees:
    """The trees of texts in UTF-8."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = words(data, offsets)
    # texts without words: all their bytes are one leaf
    blank = np.flatnonzero((first[1:] == first[:-1]) & (lengths > 0))
    if len(blank):
        starts = np.sort(np.concatenate((starts, offsets[blank])))
        ends = np.sort(np.concatenate((ends, offsets[blank + 1])))
        first = np.searchsorted(starts, offsets)
    n = len(starts)
    if not n:
        root = hashlib.blake2b(b"", digest_size=16).hexdigest()
        none, zero = [np.zeros(0, U)] * 2, np.zeros(1, np.int64)
        return Trees([f"{root}:"] * len(texts), none, none, none, zero, zero, *[np.zeros(len(texts) + 1, np.int64)] * 2)
    blocks = Blocks(data)
    cut = (blocks.of(starts, ends) & U(LEAF_WORDS - 1)) == 0
    owner = np.searchsorted(first, np.arange(n), "right") - 1
    closes = np.zeros(n, bool)
    closes[first[1:][first[1:] > first[:-1]] - 1] = True
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    behind = np.append(starts[1:], len(data))
    behind[closes] = offsets[owner[closes] + 1]
    paragraph = closes | (lines[behind] != lines[ends])
    cut |= paragraph
    # words since the last cut, so that a leaf that is cut for its length does not depend on what is far in front of it
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(np.concatenate(([True], cut[:-1])), at, 0))
    last = np.flatnonzero(cut | (since % LONGEST_LEAF == LONGEST_LEAF - 1))  # the last word of each leaf
    leaf_end = behind[last]
    leaf_start = np.concatenate(([0], leaf_end[:-1]))
    leaf_owner = owner[last]
    fresh = np.concatenate(([True], leaf_owner[1:] != leaf_owner[:-1]))
    leaf_start[fresh] = offsets[leaf_owner[fresh]]
    leaves = [blocks.of(leaf_start, leaf_end, lane) for lane in (0, 1)]
    p_last = np.flatnonzero(paragraph[last])
    paragraphs = _parents(leaves, p_last)
    p_closes = closes[last[p_last]]
    s_last = np.flatnonzero(p_closes | ((paragraphs[0] & U(SECTION_PARAGRAPHS - 1)) == 0))
    sections = _parents(paragraphs, s_last)
    # the written form: digits of each leaf, then marks
    width = np.full(len(leaves[0]), DIGITS)
    ends_p = np.zeros(len(leaves[0]), bool)
    ends_p[p_last] = True
    ends_s = np.zeros(len(leaves[0]), bool)
    ends_s[p_last[s_last]] = True
    width += ends_p
    width += ends_s
    at = np.concatenate(([0], np.cumsum(width)))
    body = np.empty(at[-1], np.uint8)
    for k in range(DIGITS):
        body[at[:-1] + k] = _HEX[((leaves[0] >> U(60 - 4 * k)) & U(15)).astype(np.intp)]
    body[at[:-1][ends_p] + DIGITS] = ord(",")
    body[at[:-1][ends_s] + DIGITS + 1] = ord("/")
    leaf_first = np.searchsorted(leaf_owner, np.arange(len(texts) + 1))
    section_first = np.searchsorted(leaf_owner[p_last[s_last]], np.arange(len(texts) + 1))
    written = body.tobytes().decode()
    whole = np.column_stack(sections).tobytes()
    out = []
    for i in range(len(texts)):
        root = hashlib.blake2b(whole[16 * section_first[i] : 16 * section_first[i + 1]], digest_size=16).hexdigest()
        out.append(f"{root}:{written[at[leaf_first[i]] : at[leaf_first[i + 1]]]}")
    begin = lambda last: np.concatenate(([0], last + 1))
    return Trees(out, leaves, paragraphs, sections, begin(p_last), begin(s_last), section_first, leaf_first)


def fingerprints(texts: list[bytes]) -> list[str]:
    return trees(texts).prints


def _leaves(fingerprint: str) -> list[str]:
    body = fingerprint.partition(":")[2].replace(",", "").replace("/", "")
    return [body[i : i + DIGITS] for i in range(0, len(body), DIGITS)]


def likeness(a: str, b: str) -> float:
    """2 x the leaves in common (as a multiset) / the leaves of both; 1 for equal roots."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    x, y = Counter(_leaves(a)), Counter(_leaves(b))
    return 2.0 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def differing(a: str, b: str) -> list[tuple[str, int, int, int]]:
    """(side, section, paragraph in it, leaf in that) of the leaves that only ``a`` has (side ``a``) and only ``b`` has (``b``).

    Children are aligned before the walk goes down: equal sections are passed
    over wherever an insertion has moved them to, then equal paragraphs, then
    equal leaves. So what is put in or taken out is told once, and nothing behind it.
    """
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    found = []

    def walk(x: list[tuple[tuple, object]], y: list[tuple[tuple, object]]) -> None:
        nodes = [n for _, n in x], [n for _, n in y]
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, *nodes, autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if x[i1:i2] and len(x[i1][0]) == 3 or y[j1:j2] and len(y[j1][0]) == 3:
                found.extend([("a", *path) for path, _ in x[i1:i2]] + [("b", *path) for path, _ in y[j1:j2]])
            else:  # an edit may also move a section's end: children are aligned over all branches that differ here
                walk(*([((*path, k), child) for path, node in side for k, child in enumerate(node)] for side in (x[i1:i2], y[j1:j2])))

    walk(*([((k,), section) for k, section in enumerate(_tree(print_))] for print_ in (a, b)))
    return found


def _tree(fingerprint: str) -> tuple[tuple[tuple[str, ...], ...], ...]:
    sections = fingerprint.partition(":")[2].split("/")[:-1]
    return tuple(tuple(tuple(p[i : i + DIGITS] for i in range(0, len(p), DIGITS)) for p in s.split(",")[:-1]) for s in sections)


def _common(texts: int, owner_a: np.ndarray, a: np.ndarray, owner_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each text, how many leaves (as multisets) its a and its b have in common."""
    x, n = np.unique(owner_a.astype(np.int64) << 32 | a, return_counts=True)
    y, m = np.unique(owner_b.astype(np.int64) << 32 | b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(both >> 32, np.minimum(n[i], m[j]), texts)


def _likeness(x: Trees, y: Trees, skip: int = 0) -> np.ndarray:
    """Of each text of x (but the last, where y has fewer) and the text of y at its place, or ``skip`` behind it."""
    texts = len(y.prints) - skip
    n, m = np.diff(x.leaf_first[: texts + 1]), np.diff(y.leaf_first[skip:])
    common = _common(texts, np.repeat(np.arange(texts), n), x.short[: x.leaf_first[texts]], np.repeat(np.arange(texts), m), y.short[y.leaf_first[skip] :])
    same = np.fromiter((p[:32] == q[:32] for p, q in zip(x.prints, y.prints[skip:])), bool, texts)
    return np.where(same, 1.0, 2.0 * common / np.maximum(1, n + m))


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at string"


def _pairs(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """rows: documents and, last, the one after them; what the query wants of all but that."""
    own = trees([t.encode() for _, t in rows])
    edited, n_chars = [], []
    for (_, text), (_, following) in zip(rows, rows[1:]):
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode())
        n_chars.append(len(text))
    changed = trees(edited)
    m = len(edited)
    paths = [own.first_difference(i, changed, i) for i in range(m)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows[:m]], pa.int64()),
            pa.array(n_chars, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array(own.prints[:m]),
            pa.array(changed.prints),
            pa.array(_likeness(own, changed)),
            pa.array(_likeness(own, own, 1)),
            pa.array([None if p is None else ".".join(map(str, p)) for p in paths], pa.string()),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def _run(batches):
    """Rows in order; the last row only follows the others."""
    rows, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.append((doc, text.as_py()))
            size += len(rows[-1][1])
            if size >= CHUNK and len(rows) > 1:
                yield _pairs(rows)
                rows = rows[-1:]
                size = len(rows[0][1])
    if len(rows) > 1:
        yield _pairs(rows)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited self and the next document, as fingerprints.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document in descending order of ids; after the
    last comes the first. Rows with equal ids are ordered by text, a null id is
    the smallest, a null text is empty. A single document is its own successor.
    ``edited_at`` is the branch (section.paragraph.leaf) where the two trees
    begin to differ, null where they are equal. An empty table gives an empty
    table. Ids are whole numbers, others are refused.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = partitions(spark)
    own = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    shares = [i / n for i in range(1, n)] or [0.5]
    bounds = own.select(F.percentile_approx("id", shares, max(10_000, 10 * n)).alias("b")).first()["b"] or []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_wm_at", outputCol="_wm_range")
    placed = ranges.transform(own.withColumn("_wm_at", F.coalesce(F.col("id").cast("double"), F.lit(-1.7e308))))
    placed = placed.select("id", "text", F.col("_wm_range").cast("int").alias("place"))
    # one id per range comes to the driver: the first of each range also follows the range above
    order = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"))
    heads = sorted((r["place"], r["head"]["id"]) for r in placed.groupBy("place").agg(F.max(order).alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("id", id_col)
    follows = [(doc, place, heads[(i + 1) % len(heads)][0]) for i, (place, doc) in enumerate(heads)]
    follows = F.broadcast(spark.createDataFrame(follows, "_wm_head long, _wm_place int, _wm_above int"))
    also = placed.join(follows, F.col("id").eqNullSafe(F.col("_wm_head")) & (F.col("place") == F.col("_wm_place")), "left")
    spread = also.select(
        "id",
        "text",
        F.explode(
            F.when(F.col("_wm_above").isNull(), F.array(F.struct(F.col("place"), F.lit(0).alias("after")))).otherwise(
                F.array(F.struct(F.col("place"), F.lit(0).alias("after")), F.struct(F.col("_wm_above").alias("place"), F.lit(1).alias("after")))
            )
        ).alias("to"),
    ).select("id", "text", "to.place", "to.after")
    ordered = spread.repartitionById(len(splits) - 1, "place").sortWithinPartitions("after", F.col("id").desc_nulls_last(), "text")
    return ordered.select("id", "text", "after").mapInArrow(_first_after, SCHEMA).withColumnRenamed("id", id_col)


def _first_after(batches):
    """Drops all but the first of the rows that follow: equal ids may have sent several."""

    def rows():
        seen = False
        for batch in batches:
            after = batch.column(2).to_pylist()
            keep = len(after)
            if 1 in after or seen:
                one = after.index(1) if 1 in after else len(after)
                keep = one + (not seen and one < len(after))
                seen = True
            if keep:
                yield batch.slice(0, keep)

    yield from _run(rows())
