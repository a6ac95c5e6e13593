"""The n-gram Jaccard join against all pairs, on small tables."""

import collections
import random
import re

import pytest

from weftmap.llm import components, ngram_join
from weftmap.llm._session import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, width=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in lists[x])
        for j, both in common.items():
            if i < j and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(docs, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, **how).collect()), key=repr)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_odd_rows(odd, nothing):
    assert run(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert run(nothing) == []
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert ngram_join.keep_one(nothing).count() == 0


def test_as_many_partitions_as_the_shingles_need(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTINGS", 700)
    docs = table(spark, sf_dir, "documents").limit(60)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    expect = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs) == expect
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {d for d, _, c in expect if d == c}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_groups_chains_and_shared_passages(spark, rounds):
    rng = random.Random(rounds)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size, edits in ((60, 2), (40, 7), (30, 12)):
        texts += near_copies(rng, rng.choices(words, k=80), size, edits)
    chain = rng.choices(words, k=60)
    for i in range(40):  # each links with the next, few with those further on
        texts.append(" ".join(chain))
        chain = chain[2:] + rng.choices(words, k=2)
    passage = " ".join(rng.choices(words, k=60))
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)]
    texts += [" ".join(rng.choices(["a", "b"], k=rng.randint(1, 14))) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert run(docs, rounds=rounds) == brute(list(enumerate(texts)))


def thue_morse(letters, power):
    text = letters[0]
    for _ in range(power):
        text += text.translate(str.maketrans(letters, letters[::-1]))
    return text


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement agree under every polynomial modulo 2^64; they are two classes."""
    a, b = thue_morse("ab", 10), thue_morse("ba", 10)
    texts = [a, b, f"{a} {b}", f"{b} {a}", f"w x y z {a}", f"w x y z {b}", a.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(docs) == brute(list(enumerate(texts)))
    assert [r[2] for r in run(docs)] == [0, 1, 2, 3, 4, 5, 0]


def test_a_class_that_two_sets_share_is_made_anew(spark, monkeypatch):
    """With classes of one bit under the first salts, the result is the same."""
    made = []

    def narrow(width, seed):
        made.append(seed)

        def run(batches):
            import pyarrow as pa

            for batch, first, sets in ngram_join._each(batches, 1, width):
                told = [ngram_join.class_of(s, seed) for s in sets]
                ids, n = batch.column(0).slice(first, len(sets)), pa.array([len(s[0]) for s in sets], pa.int64())
                classes = pa.array([c & 1 if seed < 2 else c for c, _ in told], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, n, classes, pa.array([c for _, c in told], pa.int64())], names=["id", "n_shingles", "class", "check"])

        return run

    monkeypatch.setattr(ngram_join, "_classes", narrow)
    texts = ["a b c", "d e f", "g h", "a b c", "one two three four five six"]
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert made == [0, 1, 2]


def test_ids(spark):
    last = (1 << 63) - 1
    rows = [(last, "a b c d e f"), (-last - 1, "x y"), (None, "A b c d e F")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)
    with pytest.raises(TypeError):
        ngram_join.ngram_join(docs.withColumn("doc_id", docs["text"]))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(900, 990)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in parent}
