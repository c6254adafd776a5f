"""Each method against brute force, exact round trips or held-out accuracy."""

import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import common, language_id, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, sharding, textstats, toxicity, webp

SF = "/root/testdata/sf0.001"
DOCS = f"'{SF}/documents.parquet'"


def rows(sql):
    return duckdb.sql(sql).fetchall()


# ---- media


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 256))
def test_grey_round_trip(data, colours):
    data = bytes(b % colours for b in data)
    payload = data + b" " * (-len(data) % webp.WIDTH)
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_lines_become_back_references():
    line = b"a line of some length that repeats in the text\n"
    payload = (line * 300)[: 192 * 70]
    media = webp.store(payload)
    assert len(media) < len(payload) / 20 and webp.load(media).tobytes() == payload


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 23), st.integers(1, 23), st.integers(0, 9999), st.booleans(), st.booleans(), st.booleans(), st.integers(0, 8))
def test_argb_round_trip_with_transforms(h, w, seed, predict, cross, subtract, cache):
    r = np.random.default_rng(seed)
    px = r.integers(0, r.integers(2, 257), (h, w, 4)).astype(np.uint8)
    blocks = (-(-h // 4), -(-w // 4))
    modes = r.integers(0, 14, blocks).astype(np.uint8) if predict else None
    elements = r.integers(0, 256, (*blocks, 4)).astype(np.uint8) if cross else None
    assert (webp.decode(webp.encode_argb(px, modes, elements, subtract, 2, cache)) == px).all()


def test_predictors_one_by_one():
    """A pixel by hand: neighbours left 10, top 30, top-left 20, top-right 50 in every channel."""
    px = np.zeros((2, 3, 4), np.uint8)
    px[0] = [[20] * 4, [30] * 4, [50] * 4]
    px[1, 0], px[1, 1] = 10, 77
    want = {0: None, 1: 10, 2: 30, 3: 50, 4: 20, 5: 30, 6: 15, 7: 20, 8: 25, 9: 40, 10: 27, 12: 20, 13: 20}
    for mode, p in want.items():
        res = webp._unpredict(px, np.full((1, 1), mode, np.uint8), 2, inverse=False)[1, 1]
        assert p is None and list(res) == [77 - 255 & 255, 77, 77, 77] or list(res) == [77 - p] * 4, mode


def test_broken_files_are_told():
    media = webp.store(b"hello world " * 16)
    for bad in (b"", b"RIFF" + media[4:8] + b"WEBPVP8 " + media[16:], media[:40]):
        with pytest.raises(webp.BadImage):
            webp.decode(bad)


# ---- quality


def plain_measures(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_measures_by_brute_force(monkeypatch):
    for (t,) in rows(f"select text from {DOCS}"):
        assert textstats.measure(t)[:5] == plain_measures(t)
    t = " ".join(["a b c d"] * 20 + ["e f", "a b c"])
    short = textstats.measure(t)
    monkeypatch.setattr(textstats, "LONG", 5)
    assert textstats.measure(t) == short


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.8
    votes = np.where(r.random((4000, len(quality_rules.RULES))) < 0.85, np.where(y[:, None], 2, 0), r.integers(0, 3, (4000, len(quality_rules.RULES))))
    pattern = (votes * 3 ** np.arange(len(quality_rules.RULES) - 1, -1, -1)).sum(1)
    u, n = np.unique(pattern, return_counts=True)
    m = quality_rules.expectation_maximisation(u, n.astype(float))
    assert abs(m.prior - 0.8) < 0.03 and ((m.posterior(pattern) >= 0.5) == y).mean() > 0.99


def test_rules_agree_with_labels(spark):
    got = {r["doc_id"]: r["kept"] for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    lab = rows("select doc_id, quality, length(text) from '/root/testdata/sf0.01/labels.parquet' join '/root/testdata/sf0.01/documents.parquet' using (doc_id)")
    assert not any(got[i] for i, q, _ in lab if q == 0)
    assert np.mean([got[i] for i, q, n in lab if q == 1 and n > 600]) > 0.98


def test_classifier_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    lab = dict(rows("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'"))
    held = [(got[i]["predicted"], q) for i, q in lab.items() if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([a == b for a, b in held]) > 0.95


# ---- language, toxicity


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 12):
        c = language_id.codewords(n)
        assert c.shape[0] == n and min(int((a != b).sum()) for a, b in itertools.combinations(c, 2)) >= max(1, c.shape[1] // 4)


def test_language_held_out(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(rows("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'"))
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.97


def test_toxicity_shares_subwords():
    r = np.random.default_rng(0)
    plain = ["table", "river", "mountain", "green", "window", "letter", "under", "paper", "cloud", "stone"]
    clean = [" ".join(r.choice(plain, 40)) for _ in range(120)]
    toxic = [t + " dimwitted " + t + " blockhead" for t in clean[:60]]
    m = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    assert m.score("river table dimwitted stone") > 0.7 and m.score("cloud dimwited dimwiited blockheads paper") > 0.7
    assert m.score("cloud paper stone") < 0.5 and m.score("") < 0.7 and m.score(" ".join(plain * 100)) < 0.5


def plain_window_odds(m, t):
    """By the definition: n-grams one by one, words by their mean, windows by the mean of what is new in them."""
    words, half = toxicity.words_of(t), toxicity.WINDOW // 2

    def word(w):
        marked, grams = f"<{w}>", []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = ord(marked[i])
                for c in marked[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                grams.append(((h + n) * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32)
        grams.append(xxhash.xxh32_intdigest(w.encode()))
        return np.mean([m.value[g % toxicity.BUCKETS] for g in grams])

    spans = [words[at : at + 2 * half] for at in range(0, max(1, len(words) - half), half)]
    return [m.base + sum(map(word, set(s))) / max(len(s), half) for s in spans]


def test_toxicity_scores_by_brute_force():
    r = np.random.default_rng(1)
    m = toxicity.Model(r.normal(0, 9, toxicity.BUCKETS), -2.0)
    vocab = ["a", "bb", "ünï", "river", "mountainside", "word", "other", "\U00010400x"] + [f"tok{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(r.choice(vocab, n)) for n in (1, 2, 15, 16, 17, 31, 32, 33, 48, 49, 200)] + ["", "12 34 !"]
    got = m.predict([*texts, None])[0]
    want = [1 / (1 + np.exp(-max(plain_window_odds(m, t)))) if toxicity.words_of(t) else 1 / (1 + np.exp(2.0)) for t in texts]
    assert np.allclose(got[:-1], want, atol=1e-8) and got[-1] == got[-2]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    lab = rows(f"select doc_id, toxic, text from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id) where toxic is not null")
    seen = [(t, y) for i, y, t in lab if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [(t, y) for i, y, t in lab if zlib.crc32(str(i).encode()) % 3 == 1]
    m = toxicity.train([t or "" for t, _ in seen], [y for _, y in seen])
    p = np.array(m.predict([t for t, _ in held])[0]) >= 0.7
    y = np.array([y for _, y in held])
    assert (p == y).mean() > 0.95 and p[y == 1].mean() > 0.85


# ---- licenses


def test_licenses_match_exact_containment(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from {DOCS}")
    want = set(c.sql(license_scan.sql()).fetchall())
    got = {tuple(r) for r in queries.op4_license_scan(spark, SF).collect()}
    assert want and got == want


def test_toxicity_trains_alike_at_every_size():
    r = np.random.default_rng(3)
    for n in (300, 20_500):  # windows
        texts = [f"word{k % 50} {'dimwitted' if k % 4 == 0 else 'kind'}{r.integers(0, 9)}" for k in range(n)]
        labels = [int(k % 4 == 0) for k in range(n)]
        by_default, full = toxicity.train(texts, labels), toxicity.train(texts, labels, steps=toxicity.STEPS)
        assert by_default.base == full.base and np.array_equal(by_default.value, full.value)


# ---- join


def brute_components(texts, shingle=4, percent=85):
    sets = {}
    for i, t in texts:
        w = t.encode().translate(ngram_join._LOWER).split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n, seed, words=60, edits=3):
    r = np.random.default_rng(seed)
    base = [f"w{k}" for k in r.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.integers(0, words, r.integers(0, edits)):
            w[at] = f"x{r.integers(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def listed():
    texts = [t for (t,) in rows(f"select text from {DOCS} order by doc_id limit 120")]
    texts += near_copies(90, 1) + near_copies(40, 2, 300, 12) + near_copies(30, 3, 12, 2) + ["a b c", "A B c", "a b", "", "a b c d e f g", "a b c d e f g h"] + ["one text that has many copies here"] * 9
    texts += near_copies(60, 4, 80, 14) + near_copies(30, 5, 40, 6)  # many just under the threshold
    return list(enumerate(texts))


@pytest.mark.parametrize("shingle, percent", [(4, 85), (5, 80), (2, 100)])
def test_join_by_brute_force(spark, monkeypatch, listed, shingle, percent):
    monkeypatch.setattr(ngram_join, "TILE", 8)  # so that keys are cut into tiles here
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "OFTEN", 5)  # and some keys count as met often
    monkeypatch.setattr(ngram_join, "LAYERS", 1)  # and trees need further rounds
    monkeypatch.setattr(ngram_join, "EDGES", 20)  # and links fill several tasks
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.join(spark.createDataFrame(listed, "doc_id long, text string"), shingle=shingle, percent=percent).collect()}
    assert got == brute_components(listed, shingle, percent)


def test_op9_by_brute_force(spark, listed):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op9(spark.createDataFrame(listed, "doc_id long, text string")).collect()}
    assert got == brute_components(listed)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_linked_sets_share_a_key(percent, n, seed):
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    most = int(len(base) * (100 - percent) / 100) + 1
    a, b = (np.unique(np.concatenate([np.delete(base, r.choice(len(base), min(len(base) - 1, r.integers(0, most // 2 + 1)), replace=False)), r.integers(0, 2**63, r.integers(0, most // 4 + 1)).astype(np.uint64)])) for _ in "ab")
    if ngram_join.linked(a.tobytes(), b.tobytes(), percent):
        assert np.intersect1d(ngram_join.group_keys(a, percent), ngram_join.group_keys(b, percent)).size or np.array_equal(a, b)
        p = ngram_join.fold([ngram_join.point(a), ngram_join.point(b)])
        assert np.minimum(p[0], p[1]).sum(dtype=int) >= ngram_join.least_overlap(len(a) + len(b), percent)


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(5)
    p = r.integers(0, 6, (300, 16)).astype(np.int32)
    p[150:] = np.maximum(0, p[:150] + r.integers(-1, 2, (150, 16)))
    n, c = p.sum(1), r.integers(0, 280, 300)
    got = {tuple(sorted(x)) for x in ngram_join.CountTree(p, n, c, 85).pairs().tolist()}
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if c[a] != c[b] and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and np.minimum(p[a], p[b]).sum() >= ngram_join.least_overlap(n[a] + n[b], 85)}
    assert want and got == want


def tree_rows(placed, keys=lambda k: [7]):
    """(tile, point, component) as rows of one tree over tiles 0 and 1, or 0 alone."""
    j = max(t for t, *_ in placed)
    return [(7, 0, j, tile, k, 100, bytearray(p.tobytes()), c, keys(k)) for k, (tile, p, c) in enumerate(placed)]


TREE = "key long, i long, j long, tile long, node long, n long, point binary, component long, keys array<long>"


def test_a_body_gives_a_forest_and_not_its_pairs(spark):
    p = np.array([10] * 10 + [0] * 6, np.uint8)
    df = spark.createDataFrame(tree_rows([(0, p, k) for k in range(120)]), TREE)
    got = [tuple(r) for r in ngram_join._search(df, 1, 85).collect()]
    edges = [r[3:] for r in got if r[3] is not None]
    assert len(edges) == 119 and len(got) == 120  # a spanning tree, and word that there was more
    assert not ngram_join.roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 120).any()
    assert 119 < len(ngram_join._search(df, 2, 85).filter("a is not null").collect()) <= 2 * 119
    one = spark.createDataFrame(tree_rows([(0, p, 3) for k in range(120)]), TREE)
    assert ngram_join._search(one, 1, 85).count() == 0


def test_pairs_across_tiles_only(spark):
    p = np.array([10] * 10 + [0] * 6, np.uint8)
    df = spark.createDataFrame(tree_rows([(0, p, 0), (0, p, 1), (1, p, 2), (1, p[::-1], 3)]), TREE)
    assert {tuple(r)[3:] for r in ngram_join._search(df, 99, 85).collect()} == {(0, 2), (1, 2)}


def test_a_pair_is_looked_at_under_its_least_shared_key(spark):
    p = np.array([10] * 10 + [0] * 6, np.uint8)
    df = spark.createDataFrame(tree_rows([(0, p, 0), (0, p, 1), (0, p, 2), (0, p, 3)], lambda k: [[3, 7], [3, 7], [5, 7], [7]][k]), TREE)
    assert {tuple(r)[3:] for r in ngram_join._search(df, 99, 85).collect()} == {(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_roots_are_least_connected_nodes(edges):
    parent = list(range(31))
    for _ in edges:
        for a, b in edges:
            parent = [min(parent[a], parent[b]) if x in (parent[a], parent[b]) else x for x in parent]
    e = np.array(edges, np.int64).reshape(-1, 2)
    assert ngram_join.roots(e[:, 0], e[:, 1], 31).tolist() == parent


# ---- mixing, packing, sharding


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_water_fill(words):
    weights = [(3, 1, 2)[k % 3] for k in range(len(words))]
    out = mixing.water_fill(words, weights, 1.5 * sum(words))
    assert all(x <= 2 * w + 1e-6 for x, w in zip(out, words)) and abs(sum(out) - 1.5 * sum(words)) < 1e-3
    free = [x / w for x, w, n in zip(out, weights, words) if n and x < 2 * n - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(free)


def test_mix_comes_near_its_targets(spark):
    got = queries.op2_mixing(spark, "/root/testdata/sf0.01").collect()
    src = dict(rows("select doc_id, source from '/root/testdata/sf0.01/documents.parquet'"))
    total = Counter()
    for r in got:
        total[src[r["doc_id"]]] += r["taken"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
    target = {src[r["doc_id"]]: r["target"] for r in got}
    assert all(abs(total[s] - t) <= 0.02 * t for s, t in target.items())
    again = {r["doc_id"]: r["taken"] for r in queries.op2_mixing(spark, "/root/testdata/sf0.01").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_patterns_hold_every_piece(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for n, p in patterns:
        assert sum(p) <= 64
        for length in p:
            held[length] += n
    assert held == Counter(histogram)


ALPHABET = st.text(st.sampled_from("abcXYZ012 .,!?'éßñ\n\t¼²ªあ\U0001f600\x1c\x85\xa0<|>_-/"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=40), st.just("a <|endoftext|> b")), max_size=5))
def test_both_encoders_agree(texts):
    e = packing.encoder(packing.tokenizer_path())
    assert e.encode(texts) == [b if t else b"" for t, b in zip(texts, e.whole(texts))]


def test_packing_ids_and_padding(spark):
    e = packing.encoder(packing.tokenizer_path())
    texts = dict(rows(f"select doc_id, text from {DOCS}"))
    got = queries.op6_packing(spark, SF).collect()
    ids = {i: b + np.array([1], "<u4").tobytes() for i, b in zip(texts, e.whole(list(texts.values())))}
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] * 4 == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in got) * 4 == sum(map(len, ids.values()))
    assert sum(r["length"] for r in got) / (2048 * len({r["sequence_id"] for r in got})) > 0.97


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=12, max_size=12), st.integers(2, 5))
def test_ring_walk_is_balanced(counts, shards):
    owner = [k % shards for k in range(12)]
    room = sharding.bounds(sum(counts), shards)
    got = sharding.walk(counts, owner, room)
    per, arcs = Counter(), Counter()
    for arc, rank, s, slot, n in got:
        assert rank == arcs[arc]
        arcs[arc] += n
        per[s] += n
    assert [per[s] for s in range(shards)] == room and [arcs[a] for a in range(12)] == counts


def test_bounded_loads_move_few(spark):
    got = queries.op7_sharding(spark, SF).collect()
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.values()) <= 1
    assert np.mean([r["shard"] != r["first_shard"] for r in got]) < 0.4


# ---- the methods by their definitions


def test_mix_takes_the_prefix_of_the_pareto_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = docs.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), mixing.word_count("text").alias("size"), F.col("text").alias("t"))
    got = mixing.Mix(common.keep(mixing.told_apart(parts))).drawn.collect()
    by = {}
    for r in got:
        by.setdefault(r["s"], []).append(r)
    for rows_ in by.values():
        gap = rows_[0]["target"] - sum(r["certain"] * r["size"] for r in rows_)
        run, ranked = 0, sorted((r for r in rows_ if r["step"] is not None), key=lambda r: r["odds"])
        for r in ranked:
            run += r["size"]
            if run > gap + 1e-6:
                break
            assert r["drawn"] == 1
        left = gap - sum(r["size"] for r in ranked if r["drawn"])
        assert left >= -max([0, *(r["size"] for r in ranked)]) and not any(abs(left - r["size"]) < left - 1e-6 for r in ranked if not r["drawn"])


def test_discriminant_by_direct_densities():
    r = np.random.default_rng(4)
    k = quality_classifier.DIM
    x = [r.normal(size=(300, k)) @ r.normal(size=(k, k)) * 0.3 + c for c in (0.0, 0.5)]
    m = quality_classifier.solve(np.array([300.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    test = r.normal(size=(20, k))
    ll = []
    for c in (0, 1):
        own, pooled = (np.cov(a.T, bias=True) for a in (x[c], np.concatenate([a - a.mean(0) for a in x])))
        w = max(quality_classifier.POOL, k / (k + 300))
        v = (1 - w) * own + w * pooled
        v = (1 - quality_classifier.SPHERE) * v + quality_classifier.SPHERE * np.trace(v) / k * np.eye(k) + 1e-4 * np.eye(k)
        d = test - m.mean[c]
        ll.append(m.log_prior[c] - 0.5 * (np.einsum("ni,ni->n", d, np.linalg.solve(v, d.T).T) + np.linalg.slogdet(v)[1]))
    want = 1 / (1 + np.exp((ll[0] - ll[1]) / quality_classifier.TEMPER))
    assert np.allclose(m.scores(test), want, atol=1e-8)


def test_decoding_by_enumeration():
    r = np.random.default_rng(2)
    for n in (2, 3, 9):
        code = language_id.codewords(n)
        m = language_id.Model([f"l{k}" for k in range(n)], code, r.normal(size=(language_id.WIDTH, code.shape[1])).astype(np.float32), r.normal(size=code.shape[1]), r.random(code.shape))
        x = r.random((3, language_id.WIDTH)).astype(np.float32) / 100
        for row, got in zip(x, m.decode(x)):
            margin = [float(row @ m.weight[:, b] + m.bias[b]) for b in range(code.shape[1])]
            want = [sum(m.trust[k, b] * np.log1p(np.exp(-4 * code[k, b] * margin[b])) for b in range(code.shape[1])) for k in range(n)]
            assert np.allclose(got, want, atol=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=12, max_size=12), st.integers(2, 5))
def test_ring_walk_key_by_key(counts, shards):
    owner = [k % shards for k in range(12)]
    room = sharding.bounds(sum(counts), shards)
    left, used, want = list(room), [0] * shards, {}
    moving = [[(a, rank) for rank in range(n)] for a, n in enumerate(counts)]
    while any(moving):
        after = [[] for _ in moving]
        for at, keys in enumerate(moving):
            for key in keys:
                if left[owner[at]]:
                    left[owner[at]] -= 1
                    want[key] = (owner[at], used[owner[at]])
                    used[owner[at]] += 1
                else:
                    after[(at + 1) % 12].append(key)
        moving = after
    got = {(arc, rank + i): (s, slot + i) for arc, rank, s, slot, n in sharding.walk(counts, owner, room) for i in range(n)}
    assert got == want


def test_one_more_shard_takes_keys_only_into_itself():
    digest = lambda k: zlib.crc32(str(k).encode()) % sharding.RING
    old, new = (sharding.ring(n) for n in (16, 17))
    before, after = ([sharding.lookup(k, *r, digest) for k in range(20_000)] for r in (old, new))
    moved = [b for a, b in zip(before, after) if a != b]
    assert set(moved) == {16} and 0.03 < len(moved) / 20_000 < 0.09
