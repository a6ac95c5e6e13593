"""Suffix-array dedup: repeated strings found by merging shard Burrows-Wheeler transforms.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts
earlier: in a row with a smaller id, or in the same row further left. All is
judged on the input.

1. Windows (strings of LENGTH bytes) that are equal have the same minimizer: the
   substring of ``GRAM`` bytes with the least hash, at the same place. A text is
   cut into pieces, runs of windows that share an occurrence of their minimizer.
   Pieces are sent, as hashes, to partitions of the minimizer's hash.
2. There, pieces of equal content are folded: all but the first are copies, with
   all their windows. A piece whose minimizer is met with one content only has
   no other match. The first pieces of all other contents are asked for.
3. Their bytes meet by minimizer. Shards of pieces each get a suffix array and a
   Burrows-Wheeler transform of their own. The shards are merged by refining an
   interleave: a vector says, for each rank, which shard the suffix there comes
   from; sorting it stably by the symbols that precede the suffixes gives the
   interleave by one symbol more. Suffixes are never compared again. ``STRIDE``
   bytes count as a symbol. Beside it runs the vector of blocks, suffixes with a
   common prefix of that depth, so after LENGTH bytes the blocks are the
   intervals of repeated windows: all but the first window of each go.
4. The runs of windows that go meet their texts again, which are cut.

Contents are told apart by 96 bits of two independent hashes, besides the
minimizer; rows by their id and 63 bits of a digest, and a row counts as there
twice only where its text is the same.

A task holds one of ``SUB`` shares of a partition at a time, and in the merge one
slice (``SLICE`` bytes) of whole minimizers. Tasks fold what they have before
they send it, so a passage with a third of all rows is a row per task. A
minimizer with more than ``HOT`` contents (a passage whose neighbourhood differs
in each of very many texts) is not gathered: its windows are sent one by one to
partitions of their own hashes and merged there; a task sends equal windows once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmap.llm._bytes import Blocks, Sums, U, column_bytes, mix
from weftmap.llm._session import cut, integer_id, partitions, text_or_empty

LENGTH = 100
GRAM = 40
STEP = 4  # bytes that are one symbol
STRIDE = 20  # bytes that one round of the merge refines by, where LENGTH is a multiple of it
SEGMENT = 1 << 19  # windows that are cut into pieces at a time
BUFFER = 250_000  # pieces that a task holds before it sends them on
FETCHED = 1 << 22  # bytes of pieces that a task holds before it sends them on
SLICE = 1 << 18  # bytes whose shards are merged at a time
SHARD = 1 << 16
SUB = 8
PART = 1 << 26  # bytes of text that a partition is made for
HOT = 20_000
LOW48 = U((1 << 48) - 1)
_END = 0xFF  # never part of UTF-8
_PLACE = U((1 << 24) - 1)


# 1. Pieces


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers, from minima of aligned blocks."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, start, windows, minimizer's hash, two hashes of the content) of all pieces of some texts, in order."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, U))
    if len(data) < length:
        return none
    sums = Sums(data)
    hashes = mix(sums.grams(gram))
    place = np.arange(len(hashes), dtype=U)
    # the leftmost of the least
    best = _least((hashes & ~_PLACE) | place, length - gram + 1)
    windows = np.arange(len(best))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    inside = np.flatnonzero(windows + length <= offsets[owner + 1])
    if not len(inside):
        return none
    best, owner = best[inside], owner[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (best[1:] != best[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(fresh)
    start = inside[at]
    count = np.diff(np.append(at, len(inside)))
    anchor = hashes[(best[at] & _PLACE).astype(np.int64)]
    blocks = Blocks(data)
    content, more = (blocks.of(start, start + count + length - 1, lane) for lane in (0, 1))
    return owner[at], start - offsets[owner[at]], count, anchor, content, more >> U(32)


def _tag(text: bytes, known: bool = True) -> int:
    """Tells rows apart that share an id; negative where there is no id, so null is no number of its own."""
    tag = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") >> 1
    return tag if known else tag - (1 << 63)


_KINDS = {"doc": "<i8", "tag": "<i8", "count": "<u4", "low": "<u4", "high": "<u2", "content": "<u8", "more": "<u4", "start": "<u4", "windows": "u1"}


def _write(doc, tag, count, anchor, content, more, start, windows) -> bytes:
    columns = (doc, tag, count, anchor, anchor >> U(32), content, more, start, windows)
    head = np.array([len(doc), len(start)], "<u4").tobytes()
    return head + b"".join(np.asarray(c).astype(k).tobytes() for c, k in zip(columns, _KINDS.values(), strict=True))


def _read(blob):
    k, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    at, out = 8, []
    for name, kind in _KINDS.items():
        n = k if name in ("doc", "tag", "count") else m
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    doc, tag, count, low, high, content, more, start, windows = out
    return doc, tag, count, low.astype(U) | high.astype(U) << U(32), content, more, start.astype(np.int64), windows.astype(np.int64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts)) >> U(32)


def _first_of_each(doc, tag, start, *keys) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then by row (those without an id last) and place; and where in it a new combination of keys begins."""
    order = np.lexsort((start, tag, doc, tag < 0, *keys[::-1]))
    fresh = np.zeros(len(order), bool)
    if len(order):
        fresh[0] = True
        for k in keys:
            k = k[order]
            fresh[1:] |= k[1:] != k[:-1]
    return order, fresh


ROUTED = "part int, kind int, doc long, tag long, blob binary"


def _routed(rows):
    """Record batches of at most 1,000 rows, and of few large ones."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[4])
        if len(part) == 1000 or size >= 1 << 21:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(part: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ROUTED.split(", ")])


POSTINGS, RUNS, WANTED = 0, 1, 2


def _by_row(doc, tag, start, windows, kind: int, extra=None, parts: int = 1):
    """One row per document: (a part by its tag, kind, doc, tag, starts and window counts as bytes)."""
    if not len(doc):
        return
    order = np.lexsort((start, tag, doc))
    doc, tag, start, windows = doc[order], tag[order], start[order], windows[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
    both = np.column_stack((start, windows)).astype("<u4")
    more = None if extra is None else extra[order].astype("<u8")
    for a, b in zip(edge, np.append(edge[1:], len(doc)), strict=True):
        yield int(tag[a]) % parts, kind, int(doc[a]), int(tag[a]), both[a:b].tobytes() + (b"" if more is None else more[a:b].tobytes())


def _cut_up(parts: int, length: int, gram: int):
    """Texts -> postings of pieces by partition of the minimizer's hash, folded within the task; and the runs of what was folded."""

    def flush(docs, tags, found):
        if not found:
            return
        text, start, windows, anchor, content, more = (np.concatenate(c) for c in zip(*found, strict=True))
        docs, tags = np.array(docs, np.int64), np.array(tags, np.int64)
        doc, tag = docs[text], tags[text]
        both = anchor ^ mix(content)
        _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[inverse] > 1)
        order, fresh = _first_of_each(doc[several], tag[several], start[several], both[several], content[several], more[several])
        copies = several[order[~fresh]]
        firsts = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))[~fresh]
        first = several[order[firsts]]
        itself = (doc[copies] == doc[first]) & (tag[copies] == tag[first]) & (start[copies] == start[first])
        yield from _by_row(doc[copies[~itself]], tag[copies[~itself]], start[copies[~itself]], windows[copies[~itself]], RUNS, parts=parts)
        keep = np.ones(len(text), bool)
        keep[copies] = False
        text, start, windows, anchor, content, more = text[keep], start[keep], windows[keep], anchor[keep], content[keep], more[keep]
        part = _part(mix(anchor), parts)  # minimizers are small numbers: mixed, they spread evenly
        order = np.argsort(part.astype(np.uint32), kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=U))
        for p in np.flatnonzero(np.diff(edges)):
            own = order[edges[p] : edges[p + 1]]
            t = text[own]
            at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            blob = _write(docs[t[at]], tags[t[at]], np.diff(np.append(at, len(t))), anchor[own] & LOW48, content[own], more[own], start[own], windows[own])
            yield int(p), POSTINGS, None, None, blob

    def run(batches):
        docs, tags, found, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            i = 0
            while i < len(ids):
                # whole texts up to a segment, or one long text by segments of its windows
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
                a, b = int(offsets[i]), int(offsets[j])
                base = len(docs)
                docs += [d or 0 for d in ids[i:j]]
                tags += [_tag(data[offsets[x] : offsets[x + 1]].tobytes(), ids[x] is not None) for x in range(i, j)]
                for low in range(a, max(a + 1, b), SEGMENT if j == i + 1 else max(1, b - a)):
                    high = min(b, low + SEGMENT + length - 1) if j == i + 1 else b
                    local = np.array([0, high - low]) if j == i + 1 else offsets[i : j + 1] - a
                    text, start, *rest = pieces(data[low:high], local, length, gram)
                    if len(text):
                        found.append((text + base, start + (low - a if j == i + 1 else 0), *rest))
                        held += len(text)
                i = j
                if held >= BUFFER:
                    yield from _routed(flush(docs, tags, found))
                    docs, tags, found, held = [], [], [], 0
        yield from _routed(flush(docs, tags, found))

    return run


# 2. Folding


def _fold(length: int, hot: int):
    """Whole minimizers -> runs of copies, and the pieces whose bytes are wanted, by document."""

    def fold(got):
        count = np.concatenate([g[2] for g in got]).astype(np.int64)
        doc = np.repeat(np.concatenate([g[0] for g in got]), count)
        tag = np.repeat(np.concatenate([g[1] for g in got]), count)
        anchor, content, more, start, windows = (np.concatenate([g[i] for g in got]) for i in range(3, 8))
        order, fresh = _first_of_each(doc, tag, start, anchor, content, more)
        doc, tag, anchor, start, windows = doc[order], tag[order], anchor[order], start[order], windows[order]
        # a row that is there twice is no copy of itself
        itself = np.zeros(len(doc), bool)
        itself[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])
        copy = ~fresh & ~itself
        yield from _routed(_by_row(doc[copy], tag[copy], start[copy], windows[copy], RUNS))
        doc, tag, anchor, start, windows = doc[fresh], tag[fresh], anchor[fresh], start[fresh], windows[fresh]
        _, inverse, contents = np.unique(anchor, return_inverse=True, return_counts=True)
        many = contents[inverse]
        want = many > 1
        # the highest bit says that the windows are to be sent one by one
        anchor = anchor | np.where(many > hot, U(1) << U(63), U(0))
        yield from _routed(_by_row(doc[want], tag[want], start[want], windows[want], WANTED, anchor[want]))

    def run(batches):
        now, got = None, []
        for batch in batches:
            places, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, kind in enumerate(kinds):
                if kind == POSTINGS:
                    if places[i] != now and got:
                        yield from fold(got)
                        got = []
                    now = places[i]
                    got.append(_read(batch.column(4)[i].as_buffer()))
            passed = np.flatnonzero(np.array(kinds) != POSTINGS)
            if len(passed):
                yield batch.take(pa.array(passed))
        if got:
            yield from fold(got)

    return run


# 3. Merging


def _fetch(parts: int, length: int):
    """Rows sorted by (doc, tag, kind): what is wanted, then the text -> the bytes of pieces by partition of the minimizer."""

    def run(batches):
        wanted, now, out, size = [], None, [], 0
        for batch in batches:
            docs, tags, kinds = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(docs)):
                if (docs[i], tags[i]) != now:
                    now, wanted = (docs[i], tags[i]), []
                blob = batch.column(3)[i].as_py()
                if kinds[i] == WANTED:
                    wanted.append(blob)
                    continue
                for w in wanted:
                    n = len(w) // 16
                    spans, anchors = np.frombuffer(w, "<u4", 2 * n).reshape(-1, 2).astype(np.int64), np.frombuffer(w, "<u8", n, 8 * n)
                    for (start, windows), anchor in zip(spans.tolist(), anchors.tolist(), strict=True):
                        if anchor >> 63:
                            for s in range(start, start + windows):
                                own = blob[s : s + length]
                                key = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little") & ~(1 << 63) | 1 << 62
                                out.append((key, docs[i], tags[i], s, own))
                        else:
                            out.append((anchor, docs[i], tags[i], start, blob[start : start + windows + length - 1]))
                        size += len(out[-1][-1])
                wanted = []  # a row that is there again has nothing of its own
                if size >= FETCHED:
                    yield from _piece_rows(out, parts)
                    out, size = [], 0
        yield from _piece_rows(out, parts)

    return run


PIECES = "part int, anchor long, doc long, tag long, start long, bytes binary"


def _piece_rows(rows, parts):
    """Pieces as they are; of windows sent one by one that hold the same bytes the first, and of the others where they are."""
    least: dict[bytes, tuple] = {}

    def place(r):
        return (r[2] < 0, *r[1:4])

    for r in rows:
        if r[0] >> 48 and (r[4] not in least or place(r) < least[r[4]]):
            least[r[4]] = place(r)
    rows = [r if not r[0] >> 48 or place(r) == least[r[4]] else (*r[:4], None) for r in rows]
    if rows:
        anchor = np.array([r[0] for r in rows], U)
        spread = (mix(anchor) >> U(32)) * U(parts) >> U(32)
        columns = [pa.array(spread.astype(np.int32)), pa.array(anchor.astype(np.int64))]
        columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)] + [pa.array([r[4] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])


def _codes(text: np.ndarray) -> np.ndarray:
    """The four symbols from each place on, read around the end, as one number."""
    around = np.resize(text, len(text) + 3).astype(np.uint32)
    n = len(text)
    return around[:n] << 24 | around[1 : n + 1] << 16 | around[2 : n + 2] << 8 | around[3 : n + 3]


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of some numbers, equal ones by place, and the rank of each among those that differ.

    Where number and place fit into 64 bits they are sorted as one, which takes a
    fraction of the time of a stable sort.
    """
    n = len(key)
    bits = max(1, n - 1).bit_length()
    if int(key.max()).bit_length() + bits <= 64:
        both = (key.astype(U) << U(bits)) | np.arange(n, dtype=U)
        both.sort()
        order = (both & U((1 << bits) - 1)).astype(np.int64)
        ranked = both >> U(bits)
    else:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
    return order, rank


def _pair_ranked(rank: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of ranks."""
    return _ranked((rank << max(1, int(other.max())).bit_length()) | other)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text in the order of the ``depth`` symbols (or more) from there on, by doubling."""
    n = len(text)
    order, rank = _ranked(_codes(text))
    known = STEP
    while known < depth and rank[order[-1]] < n - 1:
        order, rank = _pair_ranked(rank, np.roll(rank, -(known % n)))
        known *= 2
    return order


def _strides(texts: list[np.ndarray], step: int) -> list[np.ndarray]:
    """For each place of each cyclic text the rank of the ``step`` symbols from there on among all such strings of all texts, by doubling."""
    sizes = np.cumsum([len(t) for t in texts])[:-1]

    def onward(ranks: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([np.roll(r, -(by % len(r))) for r in np.split(ranks, sizes)])

    known = {STEP: _ranked(np.concatenate([_codes(t) for t in texts]))[1]}
    size = STEP
    while 2 * size <= step:
        known[2 * size] = _pair_ranked(known[size], onward(known[size], size))[1]
        size *= 2
    rank, have = known[size], size
    for more in sorted(known, reverse=True):
        while have + more <= step:
            rank = _pair_ranked(rank, onward(known[more], have))[1]
            have += more
    return np.split(rank, sizes)


def merge_transforms(texts: list[np.ndarray], depth: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all places of some cyclic texts, and for each its block: places there whose next ``depth`` symbols are equal.

    Places count through the texts one after the other. ``depth`` is a multiple
    of STEP; ``stride``, or else STEP, symbols are refined by at a time.
    """
    arrays = [suffix_array(t, depth) for t in texts]
    step = stride if depth % stride == 0 else STEP
    # the transform: the symbols before each suffix, as one rank
    transform = np.concatenate([np.roll(r, step)[a] for r, a in zip(_strides(texts, step), arrays, strict=True)])
    n = len(transform)
    source = np.repeat(np.arange(len(texts), dtype=np.uint8 if len(texts) < 256 else np.uint16), [len(t) for t in texts])
    block = np.zeros(n, np.int64)
    symbol = np.empty(n, np.int64)
    for _ in range(0, depth, step):
        # each shard's suffixes take its transform in order, wherever the interleave puts them
        symbol[np.argsort(source, kind="stable")] = transform
        order, _ = _ranked(symbol)
        ranked, own = symbol[order], block[order]
        source = source[order]
        block[0] = 0
        np.cumsum((ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1]), out=block[1:])
    places = np.empty(n, np.int64)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    places[np.argsort(source, kind="stable")] = np.concatenate([a + b for a, b in zip(arrays, base, strict=True)])
    return places, block


def repeated(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH, shard: int = SHARD):
    """(doc, tag, start, bytes) pieces -> (doc, tag, start) of all windows that are not the first of their content."""
    shards, size = [[]], 0
    target = min(shard, max(1, sum(len(r[3]) for r in rows) // 2 + 1))
    for i, r in enumerate(rows):
        if size >= target:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(r[3]) + 1
    texts = [np.frombuffer(b"".join(rows[i][3] + bytes([_END]) for i in s) + bytes([_END]) * length, np.uint8) for s in shards]
    places, block = merge_transforms(texts, length)
    # for each place its piece, where that is long enough for a window
    total = sum(len(t) for t in texts)
    piece = np.full(total, -1, np.int64)
    begin = np.zeros(len(rows), np.int64)
    at = 0
    for s, text in zip(shards, texts, strict=True):
        inner = at
        for i in s:
            begin[i] = inner
            piece[inner : inner + len(rows[i][3]) - length + 1] = i
            inner += len(rows[i][3]) + 1
        at += len(text)
    own = piece[places]
    real = own >= 0
    places, block, own = places[real], block[real], own[real]
    _, inverse, times = np.unique(block, return_inverse=True, return_counts=True)
    several = times[inverse] > 1
    places, block, own = places[several], block[several], own[several]
    doc, tag, start = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    where = start[own] + places - begin[own]
    order, fresh = _first_of_each(doc[own], tag[own], where, block)
    gone = order[~fresh]
    return doc[own[gone]], tag[own[gone]], where[gone]


def _merge(length: int):
    """Pieces sorted by minimizer -> runs of windows that go, by document; a slice of whole minimizers at a time."""

    def answer(rows):
        if len(rows) > 1:
            doc, tag, start = repeated(rows, length)
            yield from _routed(_by_row(doc, tag, start, np.ones(len(start), np.int64), RUNS))

    def run(batches):
        rows, copies, now, size = [], [], None, 0
        for batch in batches:
            anchors, docs, tags, starts = (batch.column(i).to_pylist() for i in range(1, 5))
            for i, anchor in enumerate(anchors):
                if anchor != now and size >= SLICE:
                    yield from answer(rows)
                    rows, size = [], 0
                now = anchor
                text = batch.column(5)[i].as_py()
                if text is None:
                    copies.append((docs[i], tags[i], starts[i]))
                    continue
                rows.append((docs[i], tags[i], starts[i], text))
                size += len(text)
            if copies:
                doc, tag, start = (np.array(c, np.int64) for c in zip(*copies, strict=True))
                yield from _routed(_by_row(doc, tag, start, np.ones(len(start), np.int64), RUNS))
                copies = []
        yield from answer(rows)

    return run


# 4. Cutting


def cut_out(text: bytes, runs: np.ndarray, length: int = LENGTH) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) for (start, windows) runs."""
    if not len(runs):
        return 0, 0, text
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    begin, end = runs[:, 0], np.maximum.accumulate(runs[:, 0] + runs[:, 1] + length - 1)
    fresh = np.concatenate(([True], begin[1:] > end[:-1]))
    begin, end = begin[fresh], np.append(end[:-1][fresh[1:]], end[-1])
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return int((end - begin).sum()), len(begin), b"".join(kept)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finish(length: int):
    """Rows sorted by (doc, tag, kind): runs, then texts -> what is left of each text."""

    def run(batches):
        now, runs, first, out, size = None, [], None, [], 0
        for batch in batches:
            docs, tags, kinds = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(docs)):
                if (docs[i], tags[i]) != now:
                    now, runs, first = (docs[i], tags[i]), [], None
                blob = batch.column(3)[i].as_py()
                if kinds[i] == RUNS:
                    runs.append(np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64))
                    continue
                if first is None:
                    removed, spans, kept = cut_out(blob, np.concatenate(runs) if runs else np.zeros((0, 2), np.int64), length)
                    first = blob
                elif first != blob:
                    raise ValueError(f"two texts of id {docs[i]} share the digest {tags[i]}")
                else:  # the same row again: every window of it starts earlier
                    removed, spans, kept = (len(blob), 1, b"") if len(blob) >= length else (0, 0, blob)
                out.append((None if tags[i] < 0 else docs[i], len(blob), removed, spans, kept))
                size += len(kept)
                if size >= FETCHED:
                    yield _result(out)
                    out, size = [], 0
        if out:
            yield _result(out)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


TEXT = 9


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts and what belongs to them, by row: (doc, tag, kind, blob), sorted so that the texts come last."""
    both = texts.select("doc", "tag", "kind", "blob").union(rows.select("doc", "tag", "kind", "blob"))
    return both.repartition(partitions(texts.sparkSession), "doc", "tag").sortWithinPartitions("doc", "tag", "kind")


def _tagged(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        docs = batch.column(0).to_pylist()
        tags = [_tag(data[a:b].tobytes(), d is not None) for a, b, d in zip(offsets[:-1], offsets[1:], docs, strict=True)]
        docs = [d or 0 for d in docs]
        blobs = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array([TEXT] * len(docs), pa.int32()), blobs], names=["doc", "tag", "kind", "blob"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Null texts are empty; texts shorter than ``length`` stay whole. Null ids come
    last. Rows that share an id are ordered by a hash of their texts; of rows
    that repeat id and text one is the first and the others go. An empty table
    gives an empty table. Ids are whole numbers, others are refused.
    """
    if length % STEP or not 4 <= gram <= length or length - gram > 254:
        raise ValueError("length must be a multiple of 4, at least gram, and at most 254 more than it")
    own = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(partitions(docs.sparkSession), -(-size // PART)), (1 << 16) - 1)
    routed = own.mapInArrow(_cut_up(parts * SUB, length, gram), ROUTED)
    routed = routed.repartitionById(parts, F.floor(F.col("part") / SUB).cast("int")).sortWithinPartitions("part")
    folded = cut(routed.mapInArrow(_fold(length, hot), ROUTED), "folded")
    texts = own.mapInArrow(_tagged, "doc long, tag long, kind int, blob binary")
    wanted = _with_texts(texts, folded.filter(F.col("kind") == WANTED)).mapInArrow(_fetch(parts, length), PIECES)
    merged = wanted.repartitionById(parts, "part").sortWithinPartitions("anchor").mapInArrow(_merge(length), ROUTED)
    runs = folded.filter(F.col("kind") == RUNS).select("doc", "tag", "kind", "blob").union(cut(merged, "merged").select("doc", "tag", "kind", "blob"))
    done = _with_texts(texts, runs).mapInArrow(_finish(length), RESULT)
    return done.withColumnRenamed("doc", id_col)
