"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts, many texts at once. Trees are grown on
the driver from at most ``MAX_ROWS`` labelled rows (those whose ids hash lowest)
and flattened into arrays: node i of a tree has its children at 2i+1 and 2i+2,
so a batch of documents walks all trees with a few numpy gathers per level. The
model is a few thousand numbers, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmap.llm._bytes import Sums, U, chunks, mix, words
from weftmap.llm._session import integer_id, text_or_empty

MAX_ROWS = 20_000
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _STOP, _OTHER, _WIDE, _BREAK, _SPACE, _BAR = range(9)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_KIND[[*b".,;:!?'\"()-"]] = _STOP
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[124] = _SPACE, _BREAK, _BAR

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "stop", "other", "wide", "breaks", "bar",
    "word_length", "short_words", "long_words", "marked_words", "upper_words", "distinct_words", "commonest_word", "doubled_words",
    "distinct_pairs", "distinct_triples", "distinct_lines", "line_words", "longest_line", "sentences", "exclaimed",
)


def _spread(owner: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many distinct hashes, and the count of the commonest."""
    if not len(hashes):
        return np.zeros(texts), np.zeros(texts)
    key = np.sort((owner.astype(U) << U(40)) | (hashes >> U(24)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    who = (key[at] >> U(40)).astype(np.int64)
    most = np.zeros(texts)
    np.maximum.at(most, who, np.diff(np.append(at, len(key))))
    return np.bincount(who, minlength=texts).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; all finite, also for empty texts."""
    texts = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = words(data, offsets)
    n = np.diff(first).astype(float)
    owner = np.repeat(np.arange(texts), np.diff(first))
    kind = _KIND[data]

    def share(of: np.ndarray, by: np.ndarray) -> np.ndarray:
        return of / np.maximum(1, by)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, texts)[:texts] if len(owner) else np.zeros(texts)

    counts = [per_text(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _STOP, _OTHER, _WIDE, _BREAK, _BAR)]
    length = ends - starts
    sums = Sums(data, lower=True)
    hashed = mix(sums.of(starts, ends))
    distinct, commonest = _spread(owner, hashed, texts)
    doubled = np.zeros(len(starts))
    doubled[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    runs = []
    for width in (2, 3):
        m = max(0, len(starts) - width + 1)
        rolled = np.zeros(m, U)
        for k in range(width):
            rolled += hashed[k : m + k] * U(2 * k + 3)
        inside = owner[:m] == owner[width - 1 : m + width - 1]
        got, _ = _spread(owner[:m][inside], mix(rolled[inside]), texts)
        runs.append(share(got, n - width + 1))
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_owner, minlength=texts)[:texts].astype(float)
    # without the line feed, so that a last line is like the others
    tail = line_ends - (data[line_ends - 1] == 10)
    fresh, _ = _spread(line_owner, mix(sums.of(line_starts, np.maximum(tail, line_starts))), texts)
    longest = np.zeros(texts)
    np.maximum.at(longest, line_owner, (tail - line_starts).astype(float))
    last = kind[ends - 1] if len(ends) else kind[:0]
    columns = [
        np.log1p(size), np.log1p(n), *[share(c, size) for c in counts],
        share(per_word(length), n), share(per_word(length <= 3), n), share(per_word(length >= 12), n),
        share(per_word((last == _OTHER) | (last == _BAR)), n),
        share(per_word((kind[starts] == _UPPER) & (kind[ends - 1 - (length > 2)] == _UPPER)) if len(starts) else np.zeros(texts), n),
        share(distinct, n), share(commonest, n), share(per_word(doubled), n), *runs,
        share(fresh, lines), share(n, lines), np.log1p(longest),
        share(per_text((data == 46) | (data == 63)), n), share(per_text(data == 33), n),
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Flat trees: row t holds tree t as a complete binary tree of the given depth."""

    depth: int
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += leaf[node - ((1 << self.depth) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Gradient boosting of log loss over histograms of binned statistics.

    Without rows the score is 0.5; with one label it is nearly that label.
    """
    inner, outer = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, outer)), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    columns = x.shape[1]
    cell = binned + np.arange(columns) * bins
    raw = np.full(len(y), model.bias)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(outer)
        node = np.zeros(len(y), np.int64)  # within the level
        for level in range(depth):
            width = 1 << level
            at = (node[:, None] * (columns * bins) + cell).ravel()
            g = np.bincount(at, np.repeat(gradient, columns), width * columns * bins).reshape(width, columns, bins).cumsum(2)
            h = np.bincount(at, np.repeat(weight, columns), width * columns * bins).reshape(width, columns, bins).cumsum(2)
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < least) | (total_h - h < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            b = np.where(good, b, bins)  # all go left
            base = width - 1
            feature[base : base + width] = f
            threshold[base : base + width] = [edges[i][j] if ok and j < len(edges[i]) else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            node = 2 * node + (binned[np.arange(len(y)), f[node]] > b[node])
        g, h = np.bincount(node, gradient, outer), np.bincount(node, weight, outer)
        leaf = rate * g / (h + ridge)
        raw += leaf[node]
        grown.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.array(c) for c in zip(*grown, strict=True))
    return model


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(_wm_id, _wm_label), one row per id; null ids or labels have no say, of two labels the greater counts."""
    known = labels.select(F.col(id_col).cast("long").alias("_wm_id"), F.col(label).cast("int").alias("_wm_label")).dropna()
    return known.groupBy("_wm_id").agg(F.max("_wm_label").alias("_wm_label"))


def lowest(known: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose ids hash lowest.

    Where there are many more, those whose hash is beyond four times the share
    that is wanted are passed over before the rest is ranked, so the ranking
    task gets few rows from each partition.
    """
    n = known.count()
    place = F.pmod(F.xxhash64("_wm_id"), F.lit(1 << 40))
    some = known if n <= 4 * rows else known.filter(place < int((1 << 40) * (4 * rows / n)))
    return some.orderBy(place, "_wm_id").limit(rows)


def _measured(batches):
    for batch in batches:
        for first, data, offsets in chunks(batch.column(2)):
            rows = statistics(data, offsets)
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, m), batch.column(1).slice(first, m), pa.array(list(rows), pa.list_(pa.float64()))],
                names=["id", "label", "x"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Trees:
    """Grow the trees from labelled rows outside the held-out fold, at most ``max_rows`` of them.

    Only the text of a row is an input. Labels without a document are passed over.
    """
    chosen = lowest(labelled(labels.filter(fold(F.col(id_col), folds) != held_out), label, id_col), max_rows)
    texts = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    joined = texts.join(F.broadcast(chosen), texts["id"] == chosen["_wm_id"]).select("id", F.col("_wm_label").alias("label"), "text")
    rows = joined.mapInArrow(_measured, "id long, label int, x array<double>").orderBy("id", "x").limit(max_rows).collect()
    if not rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return grow(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Null and empty texts are scored like any other; an empty table gives an
    empty table. Repeated rows get equal scores.
    """

    def run(batches):
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                scores = model.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(scores)), pa.array(scores)], names=["id", "score"])

    texts = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    scored = texts.mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns; one pass, nothing is joined."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = [model.score(statistics(data, offsets)) >= threshold for _, data, offsets in chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
