"""Suffix-array dedup against a set of all windows, on small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmap.llm import suffix_dedup
from weftmap.llm._session import table


def brute(rows, length):
    """(id, text) rows -> sorted (id, bytes, removed, spans, kept)."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, suffix_dedup._tag((r[1] or "").encode(), r[0] is not None)))
    for doc, text in order:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i + 1 : i + length + 1] = 1
            seen.add(w)
        spans = int((np.diff(gone) == 1).sum())
        gone = gone[1:-1].astype(bool)
        out.append((doc, len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=repr)


def run(docs, **how):
    rows = suffix_dedup.suffix_dedup(docs, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=4), st.sampled_from([4, 8, 12]))
def test_merged_order(texts, depth):
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    places, block = suffix_dedup.merge_transforms(arrays, depth)
    around = []
    for t in texts:
        wide = t * (depth // len(t) + 2)
        around += [wide[i : i + depth] for i in range(len(t))]
    got = [around[p] for p in places]
    assert sorted(places.tolist()) == list(range(len(around)))
    assert got == sorted(around)
    assert [a == b for a, b in zip(got, got[1:])] == (np.diff(block) == 0).tolist()


def mixed_rows(rng, n, alphabet="abcdefghij "):
    base = ["".join(rng.choices(alphabet, k=rng.randint(150, 900))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            text += b[a : a + rng.randint(50, 400)]
            if rng.random() < 0.6:
                text += "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        rows.append((i, text))
    return rows + [(900, "ab" * 400), (901, "xab" * 100 + "ab" * 100), (902, "a" * 333), (903, "é" * 200), (904, rows[3][1]), (905, "b" * 99), (906, "b" * 100)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_mixed(spark, hot):
    rows = mixed_rows(random.Random(hot), 80)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs, hot=hot) == brute(rows, 100)


def test_as_many_partitions_as_the_texts_need(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1500)
    rows = mixed_rows(random.Random(5), 40)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows, 100)


def test_rows_without_ids_and_ids_of_any_size(spark):
    """Rows are told apart by their texts: no id is taken for null, and null ids with texts whose first hashes agree keep their texts."""
    rng, last = random.Random(6), (1 << 63) - 1
    own = ["".join(rng.choices("abcdefgh ", k=248)) for _ in range(6)]
    rows = [(last, own[0]), (-last - 1, own[0]), (None, own[1]), (None, own[2]), (None, own[1][:150] + own[3]), (0, own[2]), (last, own[4]), (last, own[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows, 100)
    with pytest.raises(TypeError):
        suffix_dedup.suffix_dedup(docs.withColumn("doc_id", docs["text"]))
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, length=400, gram=40)


def test_two_texts_are_never_one_row():
    """Texts of one id that share a tag are found out where the texts are cut, not taken for copies."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([5, 5]), pa.array([suffix_dedup.TEXT] * 2), pa.array([b"x" * 200, b"y" * 200])], names=["doc", "tag", "kind", "blob"])
    with pytest.raises(ValueError, match="share the digest"):
        list(suffix_dedup._finish(100)([batch]))


def test_short_windows(spark):
    rows = mixed_rows(random.Random(9), 40, "ab")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs, length=20, gram=8) == brute(rows, 20)


def test_many_symbols(spark):
    """More than 65,536 different runs of four bytes: the merge goes two bytes at a time."""
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x100, 0x2000)) for _ in range(60_000))
    places, block = suffix_dedup.merge_transforms([np.frombuffer(text[:30_000].encode(), np.uint8), np.frombuffer(text[30_000:].encode(), np.uint8)], 8)
    assert len(np.unique(block)) > 1 << 16


def test_long_text_by_segments(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=5000))
    rows = [(1, text + text[1000:3000]), (2, text[500:2500])]
    found = []
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["id", "text"])
    for part in suffix_dedup._cut_up(1, 100, 40)([batch]):
        for kind, blob, doc in zip(part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(2).to_pylist()):
            if kind == suffix_dedup.POSTINGS:
                doc, _, count, *_, start, windows = suffix_dedup._read(blob)
                at = 0
                for d, n in zip(doc.tolist(), count.tolist()):
                    found += [(d, s + k) for s, w in zip(start[at : at + n].tolist(), windows[at : at + n].tolist()) for k in range(w)]
                    at += n
            else:
                spans = np.frombuffer(blob, "<u4").reshape(-1, 2).tolist()
                found += [(doc, s + k) for s, w in spans for k in range(w)]
    assert sorted(found) == [(d, i) for d, t in rows for i in range(len(t) - 99)]


def test_documents_and_odd_rows(spark, sf_dir, odd, nothing):
    for docs in (odd, table(spark, sf_dir, "documents")):
        assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert run(nothing) == []
