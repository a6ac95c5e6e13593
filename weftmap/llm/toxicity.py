"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

A text is sentences of units. A unit is the letters of a word (case folded,
digits read as the letters they stand in for, marks dropped), or of a run of
one-letter words, so ``i d i o t`` and ``i-d-i-o-t`` are one unit.

The kernel of two units sums, over all triples of letters that occur in order in
both, ``DECAY`` to the power of the spans; spans beyond ``SPAN`` letters are left
out. Gaps and inserted letters only lengthen spans. It is scaled by a function
of each side, which keeps it a kernel. With landmark units L a unit x maps to
``K(x, L) K(L, L)^(-1/2)`` (Nystrom); a linear SVM on that is a table of weights
over triples of letters, so a unit is scored by looking up its triples.

Training takes at most ``MAX_ROWS`` labelled rows per label, and all of each: a
row comes to the driver as its distinct units, how often each occurs and where
first. Labels are those of texts, sentences are what is trained on: all
sentences of a clean text are clean; a sentence of a toxic text is toxic where
one of its units, or a piece of four letters of it, is one that toxic texts have
far oftener than clean ones. Pieces come first; whole units, against a bar of
their own, tell of texts where no piece does, as the pieces of a toxic word may
be ordinary in its language. A toxic sentence stands for its worst unit, and for copies of
it with a letter put in; clean ones for their units, of which those that the
machine takes for bad come first in its next round. A text is scored, as a whole,
by its worst unit, by how many are bad, and by how many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmap.llm._bytes import Blocks, U, chunks, words
from weftmap.llm._session import integer_id, text_or_empty
from weftmap.llm.quality import fold, labelled, lowest

MAX_ROWS = 2_000
LANDMARKS = 192
POOL = 300  # units of each side, the most telling ones, among which landmarks are looked for
LOOKED_AT = 20_000  # clean units of a round that only looks for landmarks; the last round trains on all
AT_ONCE = 1_000  # units whose kernels are computed together
PIECES = (4, 0)  # lengths of the pieces by which toxic sentences are told; 0: whole units
SPAN = 7
DECAY = 0.7
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
ALPHABET = 60  # 0: nothing, 1..26 a-z, 27..58 by the last byte of a letter beyond ASCII, 59: start of a unit

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[[*b"0134578"]] = [15, 9, 5, 1, 19, 20, 2]  # o i e a s t b
_SYMBOL[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 31)
_BEGIN = 59


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all units, where each unit's begin (n + 1 numbers), its text, its sentence (counted over all)."""
    starts, ends, first = words(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    symbol = _SYMBOL[data]
    inked = np.concatenate(([0], np.cumsum(symbol > 0)))
    size = inked[ends] - inked[starts]
    full = size > 0
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    broken = np.concatenate(([0], np.cumsum(data == 10)))
    # a sentence begins with a text, behind a full stop and behind a line feed
    begins = np.ones(len(starts), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | stop[:-1] | (broken[starts[1:]] != broken[ends[:-1]])
    sentence = np.cumsum(begins) - 1
    sentence, owner, size, begin = sentence[full], owner[full], size[full], inked[starts[full]]
    single = size == 1
    joins = np.zeros(len(size), bool)
    joins[1:] = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    heads = np.flatnonzero(~joins)
    return symbol[symbol > 0], np.append(begin[heads], inked[-1]), owner[heads], sentence[heads]


def _pairs() -> list[tuple[int, int]]:
    return [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _framed(letters: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with a letter in front of each that says it begins."""
    n = len(first) - 1
    at = first[:-1] + np.arange(n)
    out = np.empty(len(letters) + n, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[at] = _BEGIN
    out[inside] = letters
    return out, first + np.arange(n + 1)


def _triples(letters: np.ndarray, first: np.ndarray):
    """(position, triple, weight) of all triples, by their two gaps."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a, b in _pairs():
        m = len(letters) - b
        if m <= 0:
            continue
        at = np.flatnonzero(owner[:m] == owner[b:])
        yield at, (letters[at].astype(np.int64) * ALPHABET + letters[at + a]) * ALPHABET + letters[at + b], DECAY ** (b + 1)


def _scales(first: np.ndarray) -> np.ndarray:
    """What a unit's kernel is multiplied by: the inverse root of the summed squares of its triples' weights, each on its own."""
    size = np.diff(first)
    total = np.zeros(len(size))
    for _, b in _pairs():
        total += np.maximum(0, size - b) * DECAY ** (2 * b + 2)
    return 1 / np.sqrt(np.maximum(total, DECAY**6))


def weigh(letters: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each (framed) unit, the scaled sum of the table's weights over its triples."""
    summed = np.zeros(len(letters) + 1)
    for at, triple, weight in _triples(letters, first):
        summed[at] += table[triple] * weight
    total = np.concatenate(([0.0], np.cumsum(summed)))
    return (total[first[1:]] - total[first[:-1]]) * _scales(first)


class Basis:
    """Landmark units as scaled triple weights, over the triples that they have."""

    def __init__(self, letters: np.ndarray, first: np.ndarray):
        parts = list(_triples(letters, first))
        self.kinds = np.unique(np.concatenate([np.zeros(0, np.int64), *[t for _, t, _ in parts]]))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        scale = _scales(first)
        self.rows = np.zeros((len(first) - 1, len(self.kinds) + 1), np.float32)  # the last column: any other triple
        for at, triple, weight in parts:
            np.add.at(self.rows, (owner[at], np.searchsorted(self.kinds, triple)), weight * scale[owner[at]])

    def take(self, which: list[int]) -> Basis:
        out = object.__new__(Basis)
        out.kinds, out.rows = self.kinds, self.rows[which]
        return out

    def kernels(self, letters: np.ndarray, first: np.ndarray):
        """(first unit, kernel of some units (rows) with the landmarks (columns)), unit after unit."""
        place = np.full(ALPHABET**3, len(self.kinds), np.int32)
        place[self.kinds] = np.arange(len(self.kinds))
        columns = np.ascontiguousarray(self.rows.T)
        for low in range(0, len(first) - 1, AT_ONCE):
            own = first[low : low + AT_ONCE + 1]
            part = np.zeros((len(own) - 1, len(self.rows)))
            owner = np.repeat(np.arange(len(part)), np.diff(own))
            for at, triple, weight in _triples(letters[own[0] : own[-1]], own - own[0]):
                known = place[triple]
                met = known < len(self.kinds)
                who = owner[at][met]
                edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, int)
                if len(edge):
                    part[who[edge]] += np.add.reduceat(columns[known[met]], edge, axis=0) * weight
            yield low, part * _scales(own - own[0])[:, None]

    def kernel(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(self.rows))), *[part for _, part in self.kernels(letters, first)]])

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """A weight for every triple of letters from one for each landmark."""
        out = np.zeros(ALPHABET**3)
        out[self.kinds] = (alpha @ self.rows)[:-1]
        return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Linear SVM with squared hinge loss in the primal, by Newton steps; the last column of z is 1 and its coefficient the bias."""
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(z.shape[1])

    def slack(w):
        return 1 - y * (z @ w.astype(z.dtype))

    def loss(w):
        return keep @ w**2 / 2 + weight @ np.maximum(0, slack(w)) ** 2

    now = loss(w)
    for _ in range(steps):
        short = slack(w)
        gradient, hessian = keep * w, np.diag(keep)
        for low in range(0, len(z), 1 << 14):  # some rows at a time: z is held once
            part = slice(low, low + (1 << 14))
            on = np.flatnonzero(short[part] > 0)
            own = z[part][on].astype(float)
            gradient -= 2 * own.T @ (weight[part][on] * y[part][on] * short[part][on])
            hessian = hessian + 2 * (own * weight[part][on, None]).T @ own
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and (after := loss(w - size * step)) > now:
            size /= 2
        w, now = w - size * step, after
        if np.abs(size * step).max() < 1e-5:
            break
    return w


@dataclass
class Machine:
    """Weights over triples of letters, a bias, and how a text's units make its score."""

    table: np.ndarray
    bias: float
    link: np.ndarray  # of (1, worst margin, log(1 + bad units), log(1 + units))

    def margins(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        return weigh(*_framed(letters, first), self.table) + self.bias

    def score(self, worst: np.ndarray, bad: np.ndarray, every: np.ndarray) -> np.ndarray:
        raw = self.link[0] + self.link[1] * worst + self.link[2] * np.log1p(bad) + self.link[3] * np.log1p(every)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


FLOOR = -3.0  # the worst margin of a text without units, and the least that counts


def summarise(margin: np.ndarray, owner: np.ndarray, texts: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its worst margin, how many units are bad, and how many there are."""
    worst = np.full(texts, FLOOR)
    np.maximum.at(worst, owner, margin)
    times = np.ones(len(owner)) if times is None else times
    return worst, np.bincount(owner, (margin > 0) * times, texts), np.bincount(owner, times, texts)


class Scorer:
    """Scores texts; a unit that this task has met before is not scored again."""

    KEPT = 1 << 20

    def __init__(self, machine: Machine):
        self._machine = machine
        self._known, self._margin = np.zeros(0, U), np.zeros(0)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        letters, first, owner, _ = units(data, offsets)
        if not len(owner):
            return self._machine.score(np.full(texts, FLOOR), np.zeros(texts), np.zeros(texts))
        hashed = Blocks(letters).of(first[:-1], first[1:])
        distinct, at, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        margin = np.empty(len(distinct))
        place = np.searchsorted(self._known, distinct)
        place[place == len(self._known)] = 0
        hit = self._known[place] == distinct if len(self._known) else np.zeros(len(distinct), bool)
        margin[hit] = self._margin[place[hit]]
        new = at[~hit]
        margin[~hit] = self._machine.margins(*_some(letters, first, new))
        if len(self._known) > self.KEPT:
            self._known, self._margin = distinct, margin
        else:
            known = np.concatenate((self._known, distinct[~hit]))
            order = np.argsort(known)
            self._known, self._margin = known[order], np.concatenate((self._margin, margin[~hit]))[order]
        return self._machine.score(*summarise(margin[inverse], owner, texts))


# Training, on the driver, from bounded rows


@dataclass
class Rows:
    """Distinct units of labelled texts: letters, where units begin, and for each its text, its first sentence, how often it occurs, and the unit in front of it (its place here, or -1)."""

    letters: np.ndarray
    first: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    times: np.ndarray
    before: np.ndarray
    label: np.ndarray  # by text


def _distinct(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Framed distinct units, and for each occurrence which it is."""
    letters, first = _framed(rows.letters, rows.first)
    _, at, inverse = np.unique(Blocks(letters).of(first[:-1], first[1:]), return_index=True, return_inverse=True)
    return *_some(letters, first, at), inverse


def _pieces(letters: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit, piece) of all pieces of a length, sorted by unit, and how many pieces differ; length 0: the whole unit."""
    n = len(first) - 1
    if not length:
        return np.arange(n), np.arange(n), n
    owner = np.repeat(np.arange(n), np.diff(first))
    m = max(0, len(letters) - length + 1)
    inside = np.flatnonzero(owner[:m] == owner[length - 1 : m + length - 1])
    piece = np.zeros(len(inside), np.int64)
    for k in range(length):
        piece = piece * ALPHABET + letters[inside + k]
    kinds, piece = np.unique(piece, return_inverse=True)
    return owner[inside], piece, len(kinds)


def _suspicion(rows: Rows, letters: np.ndarray, first: np.ndarray, inverse: np.ndarray):
    """For each length of pieces, and for each distinct unit: the largest log ratio, over its pieces, of how often toxic and clean texts have that piece.

    A piece counts once per text and once per unit in front of it, whichever is
    less, so copies of one text do not add up.
    """
    n = len(first) - 1
    before = np.where(rows.before >= 0, inverse[rows.before] + 1, 0)
    n_bad, n_good = max(1, (rows.label > 0).sum()), max(1, (rows.label == 0).sum())
    for length in PIECES:
        unit, piece, kinds = _pieces(letters, first, length)
        edge = np.searchsorted(unit, np.arange(n + 1))
        counts = []
        for label in (1, 0):
            side = rows.label[rows.text] == label
            both = []
            for context in (rows.text, before):
                count = np.zeros(kinds)
                for part in range(16):
                    own = side & (context % 16 == part)
                    seen = np.unique(context[own].astype(np.int64) * n + inverse[own])
                    where, u = seen // n, seen % n
                    each = np.unique(np.repeat(where, edge[u + 1] - edge[u]) * kinds + piece[_spans(edge, u)])
                    count += np.bincount(each % kinds, minlength=kinds)
                both.append(count)
            counts.append(np.minimum(*both))
        bad, good = counts
        # shrunk: a piece met once or twice says little
        ratio = np.log((bad + 0.5) / (n_bad + 1) / ((good + 0.5) / (n_good + 1))) * bad / (bad + 2)
        out = np.full(n, -9.0)
        np.maximum.at(out, unit, ratio[piece])
        yield out


def _spans(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The positions of some units, one after the other."""
    size = first[which + 1] - first[which]
    return np.arange(size.sum()) + np.repeat(first[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def _some(letters: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return letters[_spans(first, which)], np.concatenate(([0], np.cumsum(first[which + 1] - first[which])))


def _worst(score: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each value of ``by`` (text or sentence) the occurrence with the largest score."""
    order = np.lexsort((-score, by))
    key = by[order]
    return order[np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))]


def _landmarks(letters, first, side, count) -> list[int]:
    """Units of one side, the first of them and then always the one farthest from those taken."""
    pool = side[:POOL]
    if not len(pool):
        return []
    basis = Basis(*_some(letters, first, pool))
    gram = (basis.rows @ basis.rows.T).astype(float)
    own = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    near, taken = np.zeros(len(pool)), [0]
    while len(taken) < min(count, len(pool)):
        near = np.maximum(near, gram[taken[-1]] / own / own[taken[-1]])
        near[taken] = np.inf
        taken.append(int(near.argmin()))
    return pool[taken].tolist()


def _inserted(letters: np.ndarray, first: np.ndarray, which: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Copies of framed units with one letter put in somewhere."""
    made = []
    for i in which:
        unit = letters[first[i] : first[i + 1]]
        at = rng.integers(2, len(unit)) if len(unit) > 2 else len(unit)
        made.append(np.insert(unit, at, rng.integers(1, 27)))
    size = np.array([len(u) for u in made], int)
    return (np.concatenate(made) if made else np.zeros(0, np.uint8)), np.concatenate(([0], np.cumsum(size)))


def train(rows: Rows, landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 11) -> Machine:
    """Fit the machine; with one label or no rows, every text gets about that label's score."""
    n_bad, n = int((rows.label > 0).sum()), len(rows.label)
    share = (n_bad + 0.5) / (n + 1)
    nothing = Machine(np.zeros(ALPHABET**3), 0.0, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    if not 0 < n_bad < n or not len(rows.text):
        return nothing
    rng = np.random.default_rng(seed)
    letters, first, inverse = _distinct(rows)
    kinds = len(first) - 1
    in_bad = rows.label[rows.text] > 0
    # a sentence of a toxic text is toxic where it looks worse than nearly all clean texts, by pieces of the first length that tells any of its text
    suspicion, told, found = np.full(kinds, -9.0), np.zeros(n, bool), []
    for ratio in _suspicion(rows, letters, first, inverse):
        occurrence = ratio[inverse]
        worst = _worst(occurrence, rows.text)
        clean = np.sort(occurrence[worst][~in_bad[worst]])
        bar = max(0.0, clean[int(0.98 * (len(clean) - 1))] if len(clean) else 0.0)
        at = _worst(occurrence, rows.sentence)
        at = at[in_bad[at] & (occurrence[at] > bar) & ~told[rows.text[at]]]
        told[rows.text[at]] = True
        suspicion[inverse[at]] = np.maximum(suspicion[inverse[at]], ratio[inverse[at]])
        found.append(at)
    positive = np.concatenate(found)
    if not len(positive):
        return nothing
    times = np.bincount(inverse[positive], minlength=kinds)
    pos = np.flatnonzero(times)
    pos = pos[np.lexsort((pos, -suspicion[pos] * np.log1p(times[pos])))]
    clean_units = np.setdiff1d(np.unique(inverse[~in_bad]), pos)
    if not len(clean_units):
        return nothing
    neg = rng.permutation(clean_units)
    extra = _inserted(letters, first, pos, rng)
    often = np.minimum(times[pos], 50).astype(float)
    machine = nothing
    everything = neg
    for turn in range(rounds):
        neg = everything
        if turn < rounds - 1 and len(neg) > LOOKED_AT:
            neg = np.concatenate((neg[: LOOKED_AT // 2], rng.choice(neg[LOOKED_AT // 2 :], LOOKED_AT // 2, replace=False)))
        chosen = _landmarks(letters, first, pos, landmarks // 2) + _landmarks(letters, first, neg, landmarks // 2)
        basis = Basis(*_some(letters, first, np.array(chosen)))
        value, vector = np.linalg.eigh((basis.rows @ basis.rows.T).astype(float))
        root = vector * np.where(value > 1e-6 * value.max(), 1 / np.sqrt(np.maximum(value, 1e-12)), 0.0)
        sides = (_some(letters, first, pos), _some(letters, first, neg), extra)
        z, at = np.ones((2 * len(pos) + len(neg), len(chosen) + 1), np.float32), 0
        for side in sides:
            for low, part in basis.kernels(*side):
                z[at + low : at + low + len(part), :-1] = part @ root
            at += len(side[1]) - 1
        y = np.concatenate((np.ones(len(pos)), -np.ones(len(neg)), np.ones(len(pos))))
        weight = np.concatenate((often, np.ones(len(neg)), often / 2))
        weight[y > 0] *= 0.5 * (y < 0).sum() / weight[y > 0].sum()
        w = _svm(z, y, weight)
        machine = Machine(basis.table(root @ w[:-1]), float(w[-1]), np.zeros(4))
        margin = weigh(letters, first, machine.table) + machine.bias
        # the clean units that look worst come first: landmarks are taken from there
        everything = clean_units[np.argsort(-margin[clean_units], kind="stable")]
    worst, bad, every = summarise(margin[inverse], rows.text, n, rows.times)
    machine.link = _logistic(np.column_stack((np.ones(n), worst, np.log1p(bad), np.log1p(every))), (rows.label > 0).astype(float))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Logistic regression on a text's worst margin, its bad units and its length: the first two never lower a score, length never raises it."""
    keep = ridge * len(y) * np.array([1e-4, 0.1, 0.1, 0.1])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - keep * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([w[0], max(w[1], 0.0), max(w[2], 0.0), min(w[3], 0.0)])


def distinct_units(letters: np.ndarray, first: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's units: the first occurrence of each that differs, in order; its sentence, its count, and which of them is in front of it (-1: none)."""
    blocks = Blocks(letters)
    _, at, inverse, times = np.unique(blocks.of(first[:-1], first[1:]), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(at)
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    at = at[order]
    return at, sentence[at], times[order], np.where(at > 0, place[inverse[at - 1]], -1)


def _unit_rows(batches):
    """Labelled texts -> their distinct units as bytes."""
    for batch in batches:
        out = []
        for start, data, offsets in chunks(batch.column(2)):
            letters, first, owner, sentence = units(data, offsets)
            edge = np.searchsorted(owner, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                a, b = edge[i], edge[i + 1]
                own = first[a : b + 1]
                at, said, times, before = distinct_units(letters, own, sentence[a:b] - (sentence[a] if b > a else 0))
                size = own[at + 1] - own[at]
                out.append((start + i, letters[_spans(own, at)].tobytes(), *[x.astype("<i4").tobytes() for x in (size, said, times, before)]))
        at = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *[pa.array([o[k] for o in out], pa.binary()) for k in range(1, 6)]],
            names=["id", "label", "letters", "sizes", "sentences", "times", "before"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Machine:
    """Train from labelled rows outside the held-out fold: of each label at most ``max_rows``, those whose ids hash lowest."""
    one = labelled(labels.filter(fold(F.col(id_col), folds) != held_out), label, id_col)
    some = [lowest(one.filter(F.col("_wm_label") == v), max_rows) for v in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))
    texts = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    joined = texts.join(chosen, texts["id"] == chosen["_wm_id"]).select("id", F.col("_wm_label").alias("label"), "text")
    schema = "id long, label int, letters binary, sizes binary, sentences binary, times binary, before binary"
    got = joined.mapInArrow(_unit_rows, schema).orderBy("id", "letters").limit(2 * max_rows).collect()

    def numbers(name: str) -> list[np.ndarray]:
        return [np.frombuffer(r[name], "<i4") for r in got]

    sizes, sentences, befores = numbers("sizes"), numbers("sentences"), numbers("before")
    count, said = np.array([len(x) for x in sizes], np.int64), np.array([int(x.max()) + 1 if len(x) else 0 for x in sentences], np.int64)
    units_before, sentences_before = (np.cumsum(x).astype(np.int32) - x.astype(np.int32) for x in (count, said))
    nothing = np.zeros(0, np.int32)
    return train(
        Rows(
            np.frombuffer(b"".join(r.letters for r in got), np.uint8),
            np.concatenate(([0], np.cumsum(np.concatenate([nothing, *sizes]), dtype=np.int64))),
            np.repeat(np.arange(len(got), dtype=np.int32), count),
            np.concatenate([nothing, *[x + n for x, n in zip(sentences, sentences_before, strict=True)]]),
            np.concatenate([nothing, *numbers("times")]),
            np.concatenate([nothing, *[np.where(x >= 0, x + n, -1) for x, n in zip(befores, units_before, strict=True)]]),
            np.array([r.label for r in got], int),
        )
    )


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    A text without letters (null, empty, blank, marks) has no bad unit and gets
    the lowest score that the machine gives. Repeated rows get equal scores; an
    empty table gives an empty table.
    """

    def run(batches):
        scorer = Scorer(machine)
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                scores = scorer(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(scores)), pa.array(scores)], names=["id", "score"])

    texts = docs.select(integer_id(docs, id_col).alias("id"), text_or_empty(docs[text_col]).alias("text"))
    scored = texts.mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
