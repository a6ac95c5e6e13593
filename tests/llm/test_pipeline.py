"""The pipeline's stages, each on its own input, against plain Python."""

import collections
import re

import corpus_pipeline as pipeline
from weftmap.llm import mixing, packing, quality, queries
from weftmap.llm._session import table

from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF, "labels"))
    expect = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    after = pipeline.good(spark, docs, SF).cache()
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == expect
    clean = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    assert len(clean - expect) <= 0.03 * len(clean)

    least = {}
    for d in sorted(expect):
        least.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[d].text), d)
    after = pipeline.without_copies(spark, after, SF).cache()
    assert after.columns == docs.columns and sorted(r.doc_id for r in after.collect()) == sorted(least.values())

    expect = sorted(d for d, _, c in brute([(d, rows[d].text) for d in least.values()]) if d == c)
    after = pipeline.without_near_copies(spark, after, SF).cache()
    assert after.columns == docs.columns and sorted(r.doc_id for r in after.collect()) == expect

    planned = {r.doc_id: r._wm_copies for r in mixing.plan_mix(after).collect()}
    after = pipeline.mixed(spark, after, SF).cache()
    taken = collections.Counter(r.doc_id for r in after.collect())
    assert after.columns == docs.columns and taken == collections.Counter({d: n for d, n in planned.items() if n})

    hf = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: len(hf.encode(rows[d].text, add_special_tokens=False).ids) + 1 for d in taken}
    pieces = pipeline.packed(spark, after, SF).collect()
    assert sum(r.length for r in pieces) == sum(ids[d] * n for d, n in taken.items())
    assert len(pieces) == sum(-(-ids[d] // packing.LIMIT) * n for d, n in taken.items())


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_odd_rows(spark, odd, nothing):
    for docs in (odd.select(pipeline.COLUMNS), nothing.select(pipeline.COLUMNS)):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == pipeline.COLUMNS
            docs = docs.cache()
            docs.count()
        pipeline.packed(spark, docs, SF).count()
