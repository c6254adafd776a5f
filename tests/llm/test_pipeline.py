"""The pipeline's stages, one after the other, against what each should do to its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_methods import brute_components
from threadloom.llm import common, packing


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(common.keep(stage(spark, seen[-1], sf)))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_join", "mixing", "packing"]
    assert all(d.columns == names for d in seen[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen[:4]]
    assert set(rows[1]) < set(rows[0]) and set(rows[2]) <= set(rows[1])
    assert len(rows[1]) - len(rows[2]) <= 0.02 * len(rows[1])
    comp = brute_components([(i, r["text"]) for i, r in rows[2].items()], 5, 80)
    assert set(rows[3]) == {i for i, (_, c) in comp.items() if i == c}
    mixed = [r["doc_id"] for r in seen[4].collect()]
    assert set(mixed) <= set(rows[3]) and max(mixed.count(i) for i in set(mixed)) <= 2
    e = packing.encoder(packing.tokenizer_path())
    ids = {i: b + np.array([1], "<u4").tobytes() for i, b in zip(rows[3], e.whole([r["text"] for r in rows[3].values()]))}
    got = seen[5].collect()
    assert sum(r["length"] for r in got) * 4 == sum(len(ids[i]) for i in mixed)
    assert all(zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in got)


def test_stages_take_an_empty_table_and_other_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    for table in (docs.limit(0), docs.limit(12).withColumn("gone_id", F.lit(1)).withColumn("copies", F.lit(2))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.keep(stage(spark, table, sf))
            assert out.columns == table.columns and (out.count() == 0 or table.count())
        assert common.keep(corpus_pipeline.packed(spark, table, sf)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
