"""The two classifiers: held-out accuracy, and defined answers for odd rows."""

import zlib

import numpy as np
import pytest

from weftmap.llm import quality, queries, toxicity
from weftmap.llm._session import table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def held_out(spark, rows, label, folds, fold):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.array([s for s, _ in own]), np.array([y for _, y in own])


def test_quality(spark):
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == 1000
    score, label = held_out(spark, rows, "quality", 5, 0)
    assert auc(score, label) > 0.95 and (score[label == 1] >= 0.3).mean() > 0.98


def test_toxicity(spark):
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    score, label = held_out(spark, rows, "toxic", 4, 2)
    assert (score[label == 1] >= 0.3).mean() > 0.7 and (score[label == 0] >= 0.3).mean() < 0.06  # 14 toxic rows, few of them not English


def test_toxicity_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    for lang in ("de", "en", "es", "fr"):
        own = [(r.predicted, labels[r.doc_id]) for r in rows if docs[r.doc_id] == lang]
        caught, false = ([p for p, y in own if y == label] for label in (1, 0))
        assert np.mean(caught) >= 0.9 and np.mean(false) < 0.15, (lang, sum(caught), len(caught), sum(false), len(false))


def make(sentences):
    texts = [s.encode() for s in sentences]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def test_distinct_units_of_a_text():
    letters, first, _, sentence = toxicity.units(*make(["a bb. cc bb dd! bb a cc"]))
    words = ["".join(chr(96 + c) for c in letters[a:b]) for a, b in zip(first, first[1:])]
    at, said, times, before = toxicity.distinct_units(letters, first, sentence)
    assert [words[i] for i in at] == ["a", "bb", "cc", "dd"]
    assert said.tolist() == [0, 0, 1, 1] and times.tolist() == [2, 3, 2, 1] and before.tolist() == [-1, 0, 1, 1]


def test_svm_against_a_plain_search():
    """The Newton steps end where no small change of any coefficient makes the loss less."""
    rng = np.random.default_rng(1)
    z = np.column_stack((rng.normal(size=(300, 4)), np.ones(300))).astype(np.float32)
    y = np.where(z[:, 0] + 0.3 * rng.normal(size=300) > 0.2, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, 300)
    w = toxicity._svm(z, y, weight)

    def loss(w):
        return sum(w[:-1] ** 2) / 2 + 1e-6 * w[-1] ** 2 / 2 + sum(weight * np.maximum(0, 1 - y * (z @ w)) ** 2)

    assert all(loss(w + d * e) >= loss(w) - 1e-6 for e in np.eye(5) for d in (0.01, -0.01))


def plain_walk(model, x):
    """One row's raw score, tree by tree and node by node."""
    total = model.bias
    for feature, threshold, leaf in zip(model.feature.tolist(), model.threshold.tolist(), model.leaf.tolist()):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def plain_best(x, gradient, weight, edges, rows, ridge, least):
    """(column, threshold) of the best first split of some rows, from sums over rows."""
    best, where = 0.0, None
    g, h = sum(gradient[i] for i in rows), sum(weight[i] for i in rows)
    for c, cuts in enumerate(edges):
        for cut in cuts:
            left = [i for i in rows if x[i][c] <= cut]
            a, b = sum(gradient[i] for i in left), sum(weight[i] for i in left)
            if b < least or h - b < least:
                continue
            gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
            if gain > best + 1e-9:
                best, where = gain, (c, cut)
    return where


def test_trees_against_plain_python():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 5)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.grow(x, y, trees=6, depth=3, bins=16)
    raw = model.raw(x)
    assert raw == pytest.approx([plain_walk(model, r) for r in x.tolist()])
    assert ((raw > 0) == (y > 0)).mean() > 0.9
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 16)[1:-1])) for c in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1)
    gradient, weight = y - share, np.full(len(y), share * (1 - share))
    assert (model.feature[0, 0], model.threshold[0, 0]) == plain_best(x.tolist(), gradient, weight, edges, range(200), 2.0, 4.0)
    # the leaves of the first tree are the regularised means of what falls into them
    node = [0] * 200
    for i, r in enumerate(x.tolist()):
        while node[i] < 7:
            node[i] = 2 * node[i] + (2 if r[model.feature[0, node[i]]] > model.threshold[0, node[i]] else 1)
    for k in range(7, 15):
        own = [i for i in range(200) if node[i] == k]
        assert model.leaf[0, k - 7] == pytest.approx(0.15 * sum(gradient[i] for i in own) / (sum(weight[i] for i in own) + 2.0))


def plain_statistics(text):
    """Some of the statistics of one text, from its words and lines."""
    import re

    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw.lower())
    lines = [x for x in raw.split(b"\n")][: -1 if raw.endswith(b"\n") else None] if raw else []
    n = max(1, len(words))
    pairs = list(zip(words, words[1:]))
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "digit": sum(48 <= b < 58 for b in raw) / max(1, len(raw)),
        "wide": sum(b >= 128 for b in raw) / max(1, len(raw)), "word_length": sum(map(len, words)) / n, "short_words": sum(len(w) <= 3 for w in words) / n,
        "distinct_words": len(set(words)) / n, "commonest_word": max([words.count(w) for w in words], default=0) / n, "doubled_words": sum(a == b for a, b in pairs) / n,
        "distinct_pairs": len(set(pairs)) / max(1, len(pairs)), "distinct_lines": len(set(x.lower() for x in lines)) / max(1, len(lines)), "longest_line": np.log1p(max([len(x) for x in lines], default=0)),
    }


def test_statistics_against_plain_python():
    texts = ["", "one two two TWO 3", "a b\nc d\n\nA B\n", "ünï çöde 12", "x" * 500 + " y", " \n ", "end\n"]
    got = quality.statistics(*make(texts))
    for row, text in zip(got, texts):
        own = dict(zip(quality.STATISTICS, row))
        expect = plain_statistics(text)
        assert {k: own[k] for k in expect} == pytest.approx(expect), text


def test_units():
    letters, first, text, sentence = toxicity.units(*make(["An i d i o t. I-D-I-O-T!\nYes", "", " \n", "É é ** x"]))
    words = ["".join(chr(96 + c) if c < 27 else "~" for c in letters[a:b]) for a, b in zip(first, first[1:])]
    assert words == ["an", "idiot", "idiot", "yes", "~~x"] and text.tolist() == [0, 0, 0, 0, 3]
    assert len(set(sentence.tolist())) == 4


def brute_kernel(a, b):
    from itertools import combinations

    def triples(u):
        out = {}
        for i, j, k in combinations(range(len(u)), 3):
            if k - i < toxicity.SPAN:
                t = (u[i], u[j], u[k])
                out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def scale(u):
        return max(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(u)), 3) if k - i < toxicity.SPAN), toxicity.DECAY**6) ** -0.5

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0) for t, v in x.items()) * scale(a) * scale(b)


def test_kernel_against_all_subsequences():
    rng = np.random.default_rng(3)
    units = [rng.integers(1, 6, rng.integers(1, 14)) for _ in range(12)]
    letters, first = np.concatenate(units), np.concatenate(([0], np.cumsum([len(u) for u in units])))
    got = toxicity.Basis(letters, first).kernel(letters, first)
    assert got == pytest.approx(np.array([[brute_kernel(list(a), list(b)) for b in units] for a in units]))


def test_gaps_and_insertions_are_caught(spark):
    rng = np.random.default_rng(0)
    calm = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 9))) for _ in range(400)]
    insults = ["blithering", "numpty", "gormless"]
    rows = []
    for i in range(600):
        text = list(rng.choice(calm, 40))
        if i % 4 == 0:
            text[rng.integers(40)] = str(rng.choice(insults))
        rows.append((i, " ".join(text) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    base = " ".join(calm[:30])
    tests = [base] + [f"{base} {w}." for w in ("numpty", "num-pty", "n u m p t y", "numxpty", "blithherring", "gorm1ess", "GORMLESS")]
    scores = toxicity.Scorer(machine)(*make(tests))
    assert scores[0] < 0.3 and (scores[1:] >= 0.3).all(), scores


@pytest.mark.parametrize("module, label, folds, fold", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_odd_rows(spark, odd, nothing, module, label, folds, fold):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (5, None)], f"doc_id long, {label} int")
    for labelled in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        model = module.fit(odd, labelled)
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count()
        assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 40}) == 1
    assert module.score(nothing, model).count() == 0
    assert module.score(nothing, module.fit(nothing, labels)).count() == 0


def test_keep_good_keeps_columns(spark, odd):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert quality.keep_good(odd, model).columns == odd.columns
