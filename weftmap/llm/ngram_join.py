"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set is its distinct shingles of ``width`` words; two documents link
when 100 * intersection >= percent * union. Documents with equal sets are one
class. A class with n shingles can link only to one that occurs on at least
T = ceil(percent * n / 100) of the inverted lists of its shingles.

1. Shingles are hashed, and sent with their class to partitions of the hash: an
   inverted index in which a task holds whole lists, and as many partitions as
   the number of shingles asks for. Lists of one class cannot
   make a link and are dropped there. What is left comes back to the classes:
   a class with fewer than T shared shingles is out for good.
2. DivideSkip. A class's lists are ordered by length (then by hash); all but
   the T - k longest are short. Whatever occurs T times on its lists occurs
   k times on the short ones: these are merged with a heap, and ids met k times
   are probed, by binary search, for the shingles of the long lists. ``k`` is
   ``MERGE``, less for tiny sets. As both sides of a pair order their lists alike
   it suffices that both look at their own short lists.
3. Long lists of a group of near copies would pair all its members. So rounds of
   the search look at one member of each list only, and link each class with at
   most ``BEST`` of those that it meets most often; classes that are connected
   need no further link.
4. What may still link is members of different components on one list. Classes
   that share a list are a cluster. A cluster is cut into blocks of bounded size,
   by bands of sizes that can link and by hash; each pair of blocks is one group
   of rows, in which a task runs the same search on inverted lists of its own
   and returns the links that connect. No pair is written that does not link.

All steps go by hash of shingle, class or component; a list, class or component
with a third of all rows is partial rows that combine before a shuffle, or rows
of a join that Spark can split. The driver sees counts only.

In the index 64-bit hashes stand for shingles (48 bits and the partition, which
is the upper bits). A class is 64 bits of a digest over two independent hashes of
each shingle; the other 64 bits check it. Should two sets of shingles share a
class, all classes are made anew by another salt, so documents are one class only
where 128 bits agree.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmap.llm._bytes import Blocks, U, chunks, mix, words
from weftmap.llm._session import cut, integer_id, partitions, text_or_empty
from weftmap.llm.components import components

WIDTH = 5
PERCENT = 75
MERGE = 3
ROUNDS = 1
BEST = 4
BLOCK = 1 << 17  # shingles in a block
POSTINGS = 4_000_000  # shingles that a partition of the index is made for
SALTS = 8
BUFFER = 2_000_000  # postings that a task holds before it sends them on
LOW48 = U((1 << 48) - 1)


def _rolled(word: np.ndarray, width: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row from hashes of words, and what each of them is multiplied by."""
    factors = mix(np.arange(1, width + 1, dtype=U) * U(0xA24BAED4963EE407) + U(lane)) | U(1)
    n = max(0, len(word) - width + 1)
    rolled = np.zeros(n, U)
    for k in range(width):
        rolled += word[k : n + k] * factors[k]
    return mix(rolled), factors


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, as sorted 64-bit hashes and as a second hash of each of them; A-Z count as a-z."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return [(np.zeros(0, U), np.zeros(0, U))] * (len(offsets) - 1)
    blocks = Blocks(data, lower=True)
    lanes = []
    for lane in (0, 1):
        word = blocks.of(starts, ends, lane)
        lanes.append((word, *_rolled(word, width, lane)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = lanes[0][1][a : b - width + 1]
            order = np.argsort(own)
            own = own[order]
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append((own[fresh], lanes[1][1][a : b - width + 1][order][fresh]))
        elif b > a:
            out.append(tuple(mix(np.array([(word[a:b] * factors[: b - a]).sum(dtype=U) + U(b - a)], U) ^ U(0x5851F42D4C957F2D)) for word, _, factors in lanes))
        else:
            out.append((np.zeros(0, U), np.zeros(0, U)))
    return out


def class_of(own: tuple[np.ndarray, np.ndarray], seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit numbers for a set of shingles, of 128 bits of each: its class, and what the class is checked by."""
    digest = hashlib.blake2b(own[0].tobytes() + own[1].tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _each(batches, column: int, width: int):
    """(batch, first row, sets) of every chunk of every batch."""
    for batch in batches:
        for first, data, offsets in chunks(batch.column(column)):
            yield batch, first, shingles(data, offsets, width)


def _classes(width: int, seed: int):
    def run(batches):
        for batch, first, sets in _each(batches, 1, width):
            told = [class_of(s, seed) if len(s[0]) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    pa.array([len(s[0]) for s in sets], pa.int64()),
                    pa.array([c for c, _ in told], pa.int64()),
                    pa.array([c for _, c in told], pa.int64()),
                ],
                names=["id", "n_shingles", "class", "check"],
            )

    return run


# A blob of postings: the classes, their sizes, how many postings each has here, then the postings in that order.


def _write(classes, sizes, counts, tokens, ranks=None) -> bytes:
    head = np.array([len(classes), len(tokens)], "<u4").tobytes()
    body = [classes.astype("<i8"), sizes.astype("<u4"), counts.astype("<u4"), tokens.astype("<u4"), (tokens >> U(32)).astype("<u2")]
    if ranks is not None:
        body.append(ranks.astype("u1"))
    return head + b"".join(x.tobytes() for x in body)


def _read(blob: bytes, ranked: bool):
    k, m = np.frombuffer(blob, "<u4", 2)
    at, out = 8, []
    for kind, n in (("<i8", k), ("<u4", k), ("<u4", k), ("<u4", m), ("<u2", m)) + ((("u1", m),) if ranked else ()):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    classes, sizes, counts, low, high = out[:5]
    return classes, sizes, counts, low.astype(U) | high.astype(U) << U(32), (out[5] if ranked else None)


def _rows(found: list[tuple[int, bytes]]):
    for at in range(0, len(found), 64):
        part = found[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], names=["part", "blob"]
        )


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts)) >> U(32)


def _postings(width: int, parts: int, seed: int = 0):
    """Texts -> blobs of postings by partition of the shingle's hash; a task sends each class once."""

    def flush(sets: list[np.ndarray], classes: list[int]):
        if not sets:
            return
        sizes = np.array([len(s) for s in sets])
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        part = _part(hashes, parts)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        part, owner, hashes = part[order], owner[order], hashes[order] & LOW48
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=U))
        known = np.array(classes, np.int64)
        for p in np.flatnonzero(np.diff(edges)):
            a, b = edges[p], edges[p + 1]
            own = owner[a:b]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            who = own[at]
            yield int(p), _write(known[who], sizes[who], np.diff(np.append(at, b - a)), hashes[a:b])

    def run(batches):
        sent: set[int] = set()
        sets, classes, held = [], [], 0
        for _, _, found in _each(batches, 0, width):
            for own in found:
                if len(own[0]) and (c := class_of(own, seed)[0]) not in sent:
                    sent.add(c)
                    sets.append(own[0])
                    classes.append(c)
                    held += len(own[0])
            if held >= BUFFER:
                yield from _rows(list(flush(sets, classes)))
                sets, classes, held = [], [], 0
        yield from _rows(list(flush(sets, classes)))

    return run


def _gather(batches):
    """All blobs of a partition: its number, run classes, sizes, counts and tokens."""
    blobs = [(p, *_read(b.as_buffer(), False)) for batch in batches for p, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
    if not blobs:
        return None
    join = lambda i: np.concatenate([x[i] for x in blobs])
    return blobs[0][0], join(1), join(2).astype(np.int64), join(3).astype(np.int64), join(4)


def _shared(parts: int):
    """Whole inverted lists -> the postings of lists with two classes or more, by partition of the class."""

    def run(batches):
        got = _gather(batches)
        if got is None:
            return
        here, classes, sizes, counts, tokens = got
        # a class that several tasks have sent is the same run again
        _, once = np.unique(classes, return_index=True)
        runs = np.zeros(len(classes), bool)
        runs[once] = True
        tokens = tokens[np.repeat(runs, counts)]
        classes, sizes, counts = classes[runs], sizes[runs], counts[runs]
        order = np.argsort(tokens)
        ranked = tokens[order]
        edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        length = np.diff(np.append(edge, len(ranked)))
        df = np.empty(len(tokens), np.int64)
        df[order] = np.repeat(length, length)
        keep = df > 1
        owner = np.repeat(np.arange(len(classes)), counts)[keep]
        tokens, df = tokens[keep], df[keep]
        to = _part(classes.view(U), parts)[owner]
        order = np.argsort(to.astype(np.uint16), kind="stable")
        owner, tokens, to = owner[order], tokens[order], to[order]
        rank = np.minimum(255, 4 * np.log2(df[order])).astype(np.uint8)
        edges = np.searchsorted(to, np.arange(parts + 1, dtype=U))
        out = []
        for p in np.flatnonzero(np.diff(edges)):
            a, b = edges[p], edges[p + 1]
            own = owner[a:b]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            who = own[at]
            # the list's partition goes with the blob, as the rest of its token
            out.append((int(p), np.array([here], "<u4").tobytes() + _write(classes[who], sizes[who], np.diff(np.append(at, b - a)), tokens[a:b], rank[a:b])))
        yield from _rows(out)

    return run


ACTIVE = "class long, n long, s long, k int, short array<long>, tokens binary"


def _active(percent: int, merge: int):
    """Shared postings of whole classes -> the classes that can link, with their short lists and all their shared shingles."""

    def run(batches):
        blobs = []
        for batch in batches:
            for b in batch.column(1):
                raw = b.as_buffer()
                blobs.append((int(np.frombuffer(raw, "<u4", 1)[0]), *_read(raw[4:], True)))
        if not blobs:
            return
        join = lambda i: np.concatenate([x[i] for x in blobs])
        classes, sizes, counts, ranks = join(1), join(2).astype(np.int64), join(3).astype(np.int64), join(5)
        tokens = np.concatenate([x[4] | U(x[0]) << U(48) for x in blobs])
        known, at, inverse = np.unique(classes, return_index=True, return_inverse=True)
        n = sizes[at]
        shared = np.bincount(inverse, counts, len(known)).astype(np.int64)
        need = (percent * n + 99) // 100
        live = shared >= need
        owner = np.repeat(inverse, counts)
        keep = live[owner]
        owner, tokens, ranks = owner[keep], tokens[keep], ranks[keep]
        order = np.lexsort((tokens, ranks, owner))
        owner, tokens = owner[order], tokens[order]
        first = np.searchsorted(owner, np.arange(len(known) + 1))
        rows = []
        for i in np.flatnonzero(live):
            own = tokens[first[i] : first[i + 1]]
            k = min(merge, int(need[i]))
            short = own[: len(own) - int(need[i]) + k]
            rows.append((int(known[i]), int(n[i]), len(own), k, short.view(np.int64), np.sort(own).tobytes()))
            if len(rows) == 500:
                yield _active_rows(rows)
                rows = []
        if rows:
            yield _active_rows(rows)

    return run


def _active_rows(rows):
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int32()),
            pa.array([r[4] for r in rows], pa.list_(pa.int64())),
            pa.array([r[5] for r in rows], pa.binary()),
        ],
        names=["class", "n", "s", "k", "short", "tokens"],
    )


def merge_lists(lists: list[list[int]]):
    """(id, on how many of the sorted lists it is), by a heap over the lists' heads."""
    for i, same in groupby(heapq.merge(*lists)):
        yield i, sum(1 for _ in same)


def _merge(best: int):
    """Rows (query, k, token, id, id's k), sorted by query and token -> for each query the ids that occur often enough, at most ``best``."""

    def answer(query, k, lists, bounds):
        found = [(c, i) for i, c in merge_lists([sorted(x) for x in lists.values()]) if c >= min(k, bounds[i])]
        return [(query, i) for _, i in heapq.nlargest(best, found)]

    def run(batches):
        now, k, lists, bounds, out = None, 0, {}, {}, []
        for batch in batches:
            for query, own, token, i, bound in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if query != now:
                    if lists:
                        out += answer(now, k, lists, bounds)
                    now, k, lists, bounds = query, own, {}, {}
                lists.setdefault(token, []).append(i)
                bounds[i] = bound
            if len(out) > 10_000:
                yield _pair_rows(out)
                out = []
        if lists:
            out += answer(now, k, lists, bounds)
        if out:
            yield _pair_rows(out)

    return run


def _pair_rows(pairs):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def probe(query: np.ndarray, other: np.ndarray) -> int:
    """How many of ``query`` are in ``other``, by binary search; both are sorted."""
    if not len(other):
        return 0
    at = np.searchsorted(other, query)
    at[at == len(other)] = 0
    return int(np.count_nonzero(other[at] == query))


def _probe(percent: int):
    """Pairs with both sides' shingles -> those that reach the overlap."""

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (4, 5))
                both = probe(x, y) if len(x) <= len(y) else probe(y, x)
                if 100 * both >= percent * (n_a[i] + n_b[i] - both):
                    out.append((a[i], b[i]))
            if out:
                yield _pair_rows(out)

    return run


class Lists:
    """Inverted lists over a few sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        tokens = np.concatenate([np.zeros(0, U), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(tokens))

    def search(self, query: np.ndarray, need: int, merge: int = MERGE):
        """(member, overlap) of the members on at least ``need`` of the query's lists."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        if len(at) < need:
            return
        at = at[np.argsort(self.first[at + 1] - self.first[at], kind="stable")]
        k = min(merge, need)
        short, long = at[: len(at) - need + k], np.sort(self.tokens[at[len(at) - need + k :]])
        lists = [self.owner[self.first[i] : self.first[i + 1]].tolist() for i in short]
        for member, count in merge_lists(lists):
            if count >= k and (both := count + probe(long, self.sets[member])) >= need:
                yield member, both


def _connect(percent: int):
    """Groups of rows (key, side, class, component, n, tokens), sorted by key -> links between different components."""

    def answer(rows):
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
        if len({r[2] for r in rows}) < 2 or not left or not right:
            return
        lists = Lists([r[4] for r in right])
        for side, query, component, n, tokens in left:
            for member, both in lists.search(tokens, (percent * n + 99) // 100):
                _, other, theirs, m, _ = right[member]
                if (side == 2 and other >= query) or find(component) == find(theirs):
                    continue
                if 100 * both >= percent * (n + m - both):
                    root[find(component)] = find(theirs)
                    yield query, other

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for i, key in enumerate(columns[0]):
                if key != now:
                    out += answer(rows)
                    now, rows = key, []
                rows.append((*(c[i] for c in columns[1:]), np.frombuffer(batch.column(5)[i].as_buffer(), U).copy()))
            if len(out) > 10_000:
                yield _pair_rows(out)
                out = []
        out += answer(rows)
        if out:
            yield _pair_rows(out)

    return run


def _verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    left = active.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = active.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")
    return both.mapInArrow(_probe(percent), "a long, b long")


def _fits(percent: int):
    """The overlap of a pair is at most the shared shingles of either side, and must reach percent / (100 + percent) of both sizes."""
    return F.least("s", "s_i") * (100 + percent) >= (F.col("n") + F.col("n_i")) * percent


def _star(lists: DataFrame, active: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links between each class and one member of each of its lists (token, class, n, s, k, component)."""
    own = [F.col(c).alias(f"{c}_i" if c != "class" else "i") for c in ("class", "n", "s", "k")] + [F.col("component").alias("c_i")]
    # first the member with the least of its own, then one at random for each list
    order = (-F.col("s") / F.col("n")) if turn == 0 else F.xxhash64("class", "token", F.lit(turn))
    heads = lists.groupBy("token").agg(F.min(F.struct(order.alias("_wm_order"), *own)).alias("head")).select("token", "head.*")
    met = lists.join(heads, "token").filter((F.col("component") != F.col("c_i")) & _fits(percent))
    rows = met.select("class", "k", "token", "i", "k_i").repartition(partitions(lists.sparkSession), "class").sortWithinPartitions("class", "token")
    return _verified(rows.mapInArrow(_merge(1 if turn == 0 else BEST), "a long, b long"), active, percent)


def _rest(lists: DataFrame, active: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between all members of different components that share a list."""
    heads = lists.groupBy("token").agg(F.min("class").alias("b"))
    weak = lists.join(heads, "token").select(F.col("class").alias("a"), "b").filter("a != b").distinct()
    clusters = components(cut(weak, "weak"))
    known = lists.select("class", "component", "n").distinct()
    clustered = known.join(clusters.select("node", F.col("component").alias("cluster")), known["class"] == F.col("node"))
    # sizes that can link are in one band or in bands side by side
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long")
    members = clustered.select("class", "component", "n", "cluster", band.alias("band"))
    members = cut(members, "members")
    sizes = cut(members.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / block).alias("blocks")), "sizes")
    above = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    placed = members.join(sizes, ["cluster", "band"]).join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    placed = placed.withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")))

    return _verify_blocks(placed, active, percent)


def _verify_blocks(placed: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Every class goes to each pair of blocks that holds its own: within its band, and with the bands above and below."""

    def goes(kind: int, low: int, first: Column, second: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("band") + low).alias("low"), first.alias("first"), second.alias("second"), side.alias("side"))

    def blocks(n: str) -> Column:
        last = F.coalesce(F.col(n), F.lit(0)) - 1
        return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))

    at = F.col("at")
    within = F.transform(
        blocks("blocks"),
        lambda j: goes(0, 0, F.least(at, j), F.greatest(at, j), F.when(at == j, 2).when(at < j, 0).otherwise(1)),
    )
    upward = F.transform(blocks("above"), lambda j: goes(1, 0, at, j, F.lit(0)))
    downward = F.transform(blocks("below"), lambda j: goes(1, -1, j, at, F.lit(1)))
    spread = placed.select("class", "component", "n", "cluster", F.explode(F.concat(within, upward, downward)).alias("to"))
    keyed = spread.select(F.xxhash64("cluster", "to.kind", "to.low", "to.first", "to.second").alias("key"), "to.side", "class", "component", "n")
    tokens = active.select("class", "tokens")
    rows = keyed.join(tokens, "class").select("key", "side", "class", "component", "n", "tokens")
    rows = rows.repartition(partitions(active.sparkSession), "key").sortWithinPartitions("key", "side", "class")
    return rows.mapInArrow(_connect(percent), "a long, b long")


def links(active: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame | None:
    """(a, b) pairs of classes that link, enough of them to connect all that are connected; None if there are none."""
    posts = active.select("class", "n", "s", "k", F.explode("short").alias("token"))
    several = posts.groupBy("token").agg(F.count(F.lit(1)).alias("_wm_n")).filter("_wm_n > 1").select("token")
    posts = cut(posts.join(several, "token"), "lists")
    found, groups, more = None, None, True
    for turn in [*range(rounds), None]:
        if turn is not None and not more:
            continue
        if groups is None:
            lists = posts.withColumn("component", F.col("class"))
        else:
            lists = posts.join(groups, posts["class"] == groups["node"], "left")
            lists = lists.withColumn("component", F.coalesce("component", F.col("class"))).drop("node")
            mixed = lists.groupBy("token").agg(F.min("component").alias("_wm_low"), F.max("component").alias("_wm_high"))
            lists = cut(lists.join(mixed.filter("_wm_low != _wm_high").select("token"), "token"), "mixed")
        fresh = cut(_rest(lists, active, percent, block) if turn is None else _star(lists, active, percent, turn), "found")
        more = fresh.limit(1).count() > 0
        if not more:
            continue
        found = fresh if found is None else found.union(fresh)
        if turn is not None:
            groups = cut(components(found), "groups")
    return found


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, merge: int = MERGE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, class.

    component_id is the smallest id that the row reaches by links, itself
    included. A text with fewer words than ``width`` has its whole sequence as
    its one shingle. A text without words (null, empty, blank) has the empty set,
    class null, and links with nothing, not even its like. A null id takes part;
    where a component has no other id, component_id is null. Repeated rows are
    rows of one class. An empty table gives an empty table. Ids are whole
    numbers, others are refused.
    """
    spark = docs.sparkSession
    own = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    for seed in range(SALTS):
        base = cut(own.mapInArrow(_classes(width, seed), "id long, n_shingles long, class long, check long"), "classes")
        if not base.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low != high").limit(1).count():
            break
    else:
        raise ValueError("two sets of shingles share a class under every salt")
    # a task holds one partition of the index: there are as many as the shingles need
    parts = min(max(partitions(spark), -(-(base.agg(F.sum("n_shingles")).first()[0] or 0) // POSTINGS)), (1 << 16) - 1)
    blobs = own.select("text").mapInArrow(_postings(width, parts, seed), "part int, blob binary").repartitionById(parts, "part")
    shared = blobs.mapInArrow(_shared(parts), "part int, blob binary").repartitionById(parts, "part")
    active = cut(shared.mapInArrow(_active(percent, merge), ACTIVE), "active")
    found = links(active, percent, rounds)
    label = F.col("class")
    named = base
    if found is not None:
        groups = cut(components(found), "groups")
        named = base.join(groups, base["class"] == groups["node"], "left").drop("node")
        label = F.coalesce("component", "class")
    named = named.select("id", "n_shingles", "class", label.alias("label"))
    least = named.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    joined = named.join(least, "label", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        "class",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows that share an id go together.

    Rows with a null id stay only where they have no component with an id.
    """
    joined = ngram_join(docs, id_col, text_col, **how)
    kept = joined.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_wm_id")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_wm_id"]), "left_semi")
