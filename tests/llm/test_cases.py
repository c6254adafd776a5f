"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, language_id, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity, webp

WORDS = "the quick brown fox jumps over a lazy dog and runs home to sleep".split()
NAMES = "doc_id long, text string, lang string, source string, size long, shard int, copies int, quality_rules string, n_words long, rank long"


def text(n, seed=0):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n)) + "."


ROWS = [
    (1, None, None, None, 1, 1, 1, "x", 1, 1),
    (2, "", "en", "", 1, 1, 1, "x", 1, 1),
    (3, text(120), "en", "s0", 1, 1, 1, "x", 1, 1),
    (3, text(120), "en", "s0", 1, 1, 1, "x", 1, 1),
    (4, text(120), "de", "s0", 1, 1, 1, None, None, None),
    (5, text(30_000, 1), "en", "s1", 1, 1, 1, "x", 1, 1),
    (6, " \t\n", "en", None, 1, 1, 1, "x", 1, 1),
    (7, "!!", "de", "s1", 1, 1, 1, "x", 1, 1),
    (None, text(60, 2), "en", "s2", 1, 1, 1, "x", 1, 1),
    (8, "ünï ✓ \U0001f600 " + text(50, 3), "de", "s2", 1, 1, 1, "x", 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.ready(spark)
    return spark.createDataFrame(ROWS, NAMES)


@pytest.fixture(scope="module")
def none(spark):
    common.ready(spark)
    return spark.createDataFrame([], NAMES)


def test_webp(docs, none):
    out, name = webp.digests(docs)
    rows = out.select("doc_id", f"{name}.*").collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == 0 and by[1]["payload_bytes"] == 192 and by[1]["media_sha256"] == by[2]["media_sha256"]
    assert by[3]["feature"] == by[4]["feature"]
    assert webp.digests(none)[0].count() == 0


def test_quality_rules(docs, none):
    assert sorted(r["doc_id"] or 0 for r in quality_rules.keep_quality(docs).collect())[:3] == [0, 3, 3]
    assert quality_rules.keep_quality(docs).columns == docs.columns
    assert quality_rules.op10(none).count() == 0
    got = {r["doc_id"]: r for r in quality_rules.op10(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[3]["kept"] and got[5]["n_words"] == 30_000


def test_language(docs, none):
    m = language_id.fit(docs)
    out, name = language_id.predict(docs, m)
    by = {r["doc_id"]: r for r in out.select("doc_id", f"{name}.*").collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[6]["lang_pred"] == by[7]["lang_pred"] == "und"
    assert by[3]["lang_pred"] == by[4]["lang_pred"] and 0 <= by[3]["score"] <= 1
    empty = language_id.fit(none)
    assert language_id.predict(docs, empty)[0].select("language_id.lang_pred").distinct().collect()[0][0] == "und"
    one = language_id.fit(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(docs, one)[0].select("language_id.lang_pred").collect()} == {"en", "und"}


def test_classifiers(spark, docs, none):
    d, stats = quality_classifier.described(docs)
    lab = spark.createDataFrame([(3, 1), (5, 1), (7, 0), (2, 0), (2, 0), (99, 1), (4, None)], "doc_id long, quality int")
    m = quality_classifier.fit(d.join(lab, "doc_id"), stats)
    got = quality_classifier.score(d, m, stats)[0].select("doc_id", "quality_score").collect()
    assert len(got) == len(ROWS) and all(0 <= r["quality_score"] <= 1 for r in got)
    flat = quality_classifier.fit(d.join(lab.limit(0), "doc_id"), stats)
    assert {r[0] for r in quality_classifier.score(d, flat, stats)[0].select("quality_score").collect()} == {0.5}
    tox = lab.withColumnRenamed("quality", "toxic")
    m = toxicity.fit(docs, tox)
    got = toxicity.score(docs, m)[0].select("doc_id", "toxicity").collect()
    assert len(got) == len(ROWS) and all(0 <= r["toxicity"] <= 1 for r in got)
    flat = toxicity.fit(docs, tox.limit(0))
    assert {r[0] for r in toxicity.score(docs, flat)[0].select("toxicity").collect()} == {0.5}
    assert toxicity.score(none, flat)[0].count() == 0


def test_licenses(spark, docs, none):
    t = license_scan.TEMPLATES["apache-notice"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(20, f"x {t} y {t}"), (21, t), (22, "Licensed under")], "doc_id long, text string"))
    got = license_scan.scan(d).collect()
    assert {(r["doc_id"], r["license"], r["containment"]) for r in got} == {(20, "apache-notice", 1.0), (21, "apache-notice", 1.0)}
    assert license_scan.scan(none).count() == 0


def test_join(docs, none):
    got = ngram_join.op9(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["component_id"] == by[4]["component_id"] == 3 and by[1]["n_shingles"] == by[6]["n_shingles"] == 0 and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[1]["component_id"] == 1
    assert ngram_join.op9(none).count() == 0
    left = ngram_join.distinct_documents(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_join_rows_without_id_take_nothing_from_others(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (1, text), (2, text + " more"), (None, "something else"), (None, None), (3, "third text"), (3, "third text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.op9(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: None}
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.distinct_documents(docs).collect())
    assert left == [(0, ""), (0, "something else"), (0, text), (1, text), (3, "third text")]


LONG = " ".join(f"w{k}" for k in range(60))


def groups_of(spark, rows, kind="long"):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").coalesce(1)
    return {r["doc_id"]: r["component_id"] for r in ngram_join.op9(docs).collect()}


def test_join_null_id_first_in_its_task(spark):
    assert groups_of(spark, [(None, LONG), (5, LONG), (7, LONG + " more")]) == {None: None, 5: 5, 7: 5}


def test_join_an_id_of_two_texts_links_by_both(spark):
    other = " ".join(f"v{k}" for k in range(60))
    assert groups_of(spark, [(5, LONG), (5, other), (7, LONG + " more"), (9, other + " more"), (11, "alone here")]) == {5: 5, 7: 5, 9: 5, 11: 11}


def test_join_ids_may_be_strings(spark):
    assert groups_of(spark, [("b", LONG), ("a", LONG + " more"), ("c", None)], "string") == {"b": "a", "a": "a", "c": "c"}


def test_distinct_documents_keeps_what_has_no_id_and_any_column_name(spark):
    rows = [(None, "one text", 1, 1), (None, "another text", 2, 2), (3, LONG, 3, 3), (3, LONG, 4, 4), (8, LONG + " more", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id long, least_hash int")
    left = ngram_join.distinct_documents(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.collect()) == sorted(["one text", "another text", LONG])


def test_join_a_third_of_rows_under_one_id(spark):
    rows = [(1, LONG)] * 30 + [(1, f"text number {k} of the same id") for k in range(30)] + [(k, f"text number {k} of the same id") for k in range(2, 9)] + [(50, "no one else")]
    got = groups_of(spark, rows)
    assert got == {1: 1, **{k: 1 for k in range(2, 9)}, 50: 50}


def test_mixing(docs, none):
    got = mixing.op2(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.op2(none).count() == 0 and mixing.mix(none).count() == 0
    m = mixing.mix(docs)
    assert m.columns == docs.columns


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k])
def test_mixing_of_equal_documents(spark, ids):
    rows = [(ids(k), text(10), "s0") for k in range(200)] + [(1000 + k, text(10, 1), "s1") for k in range(200)]
    got = mixing.op2(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    per = {}
    for k, r in enumerate(got):
        assert r["taken"] <= 2 * r["size"]
        per[r["target"]] = per.get(r["target"], 0) + r["taken"]
    assert all(abs(n - t) <= 10 for t, n in per.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(5) for c in ("source_size", "target", "certain", "step", "drawn", "copies", "k", "row", "number")})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and abs(mixed.count() * 10 - sum(per)) <= 20
    assert set(mixed.select("row", "copies").distinct().collect()) == {(5, 5)}


def test_packing_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    table = common.keep(packing.pieces(docs, "doc_id", payload="crc32").withColumns({c: F.lit(9) for c in ("place", "rank_in_length", "sequence_id", "offset")}))
    got = packing.pack(table, "doc_id")
    assert got.columns == [*table.columns, "sequence_id_1", "offset_1"]
    assert {r["sequence_id"] for r in got.collect()} == {9} and {r["sequence_id_1"] for r in got.collect()} == {0}


def test_sharding_names(spark):
    docs = spark.createDataFrame([(k, 77) for k in range(40)], "doc_id long, ring_hash int").withColumns({c: F.lit(3) for c in ("ring_arc", "ring_rank", "ring_place", "shard", "slot")})
    got = sharding.shard(docs, "doc_id", "doc_id")
    assert got.columns == [*docs.columns, "shard_1", "slot_1", "first_shard"]
    assert {(r["ring_hash"], r["ring_arc"], r["shard"]) for r in got.collect()} == {(77, 3, 3)}


@pytest.mark.parametrize("t", ["²", "½ ①", "12", "_", "\u0301"])
def test_no_letters_no_language(t):
    assert not language_id.has_letter(t) and language_id.has_letter(t + "é") and language_id.has_letter("ª語")


def test_own_names_clash(spark, docs):
    """Columns that are called as the operators' own keep their values."""
    mine = docs.withColumns({c: F.lit(5) for c in ("language_id", "statistics", "quality_score", "toxicity", "license", "containment", "media", "feature", "webp", "node", "keys", "component")})
    for out, name in (
        webp.digests(mine),
        language_id.predict(mine, language_id.fit(mine)),
        quality_classifier.described(mine),
        toxicity.score(mine, toxicity.train([], [])),
    ):
        assert out.columns == [*mine.columns, name] and name not in mine.columns
        assert set(out.select("language_id", "toxicity", "statistics").distinct().collect()) == {(5, 5, 5)}
    assert ngram_join.op9(mine).count() == len(ROWS) and license_scan.scan(mine).count() == 0


def test_empty_tables(none):
    m = language_id.fit(none)
    assert language_id.predict(none, m)[0].count() == 0 and language_id.known_language(none, F.lit(True)).count() == 0
    d, stats = quality_classifier.described(none)
    assert quality_classifier.score(d, quality_classifier.fit(d.withColumn("quality", F.lit(1)), stats), stats)[0].count() == 0
    assert quality_rules.keep_quality(none).count() == 0 and ngram_join.distinct_documents(none).count() == 0


def test_packing(docs, none):
    got = packing.op6(docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["length"], one["doc_tokens"], one["ids_crc32"]) == (1, 1, zlib.crc32(np.array([1], "<u4").tobytes()))
    assert sum(r["doc_id"] == 3 and r["start"] == 0 for r in got) == 2
    assert packing.op6(none).count() == 0


def test_sharding(docs, none):
    got = sharding.op7(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(v) for v in per.values()) == [1] * len(ROWS) and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.op7(none).count() == 0
