"""Cases that no table carries: cycles, lost parents, header fences, edits, importers, identities, streams."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import periods as P
from threadloom.functions import text as X
from threadloom.operators import budget, chains, identity, progress, store
from threadloom.plans import sections, writer
from threadloom.sources import log

M = "id long, reply_to long, post_id long, topic_id long, date string, sender_id long, sender_name string, text string"


def msg(i, reply=None, post=None, date="2024-01-01T10:00", sender=1, name="Ann", text="hi"):
    return (i, reply, post, None, date, sender, name, text)


def roots(spark, rows):
    return {r["id"]: r["root"] for r in chains.roots(spark.createDataFrame(rows, M)).collect()}


def test_chain_of_three_and_lost_parent(spark):
    got = roots(spark, [msg(1), msg(2, 1), msg(3, 2), msg(10, 99), msg(11, 99)])
    assert got == {1: 1, 2: 1, 3: 1, 10: 99, 11: 99}


def test_cycle_and_tail_into_it(spark):
    got = roots(spark, [msg(1, 2), msg(2, 1), msg(3, 1)])
    assert got[1] == 1 and got[2] == 2 and got[3] == 1


def test_long_chains_and_cycles_lose_no_message(spark, monkeypatch):
    monkeypatch.setattr(chains, "WALK", 4, raising=False)  # a bound on depth or steps would show here
    up = {k: k - 1 for k in range(1, 40)} | {100: 99} | {k: k - 1 for k in range(101, 140)}  # to a top, to a lost parent
    up |= {k: k - 1 for k in range(201, 230)} | {200: 229} | {300: 205} | {k: k - 1 for k in range(301, 340)} | {400: 400}
    want = {0: 0} | {k: 0 for k in range(1, 40)} | {k: 99 for k in range(100, 140)} | {k: k for k in range(200, 230)} | {k: 205 for k in range(300, 340)} | {400: 400}
    assert roots(spark, [msg(0)] + [msg(k, p) for k, p in up.items()]) == want


def test_chain_deeper_than_any_fixed_number_of_rounds(spark):
    n = 33_000
    m = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("reply_to"), F.lit(None).cast("long").alias("post_id"))
    got = chains.roots(m).groupBy("root").count().collect()
    assert [tuple(r) for r in got] == [(0, n)]


def test_post_members_keep_their_post(spark):
    got = roots(spark, [msg(5, None, 5), msg(6, 5, 5), msg(7, 6)])
    assert got == {5: 5, 6: 5, 7: 5}


def test_atoms_order_and_leaf(spark):
    m = spark.createDataFrame([msg(2, 1, date="2024-01-02T09:00", sender=2), msg(1)], M)
    a = chains.atoms(chains.with_root(m)).collect()[0]
    assert [x["id"] for x in a["members"]] == [1, 2] and a["leaf_id"] == 2 and a["n_members"] == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30), st.integers(1, 60))
def test_batches_are_next_fit(spark, costs, cap):
    df = spark.createDataFrame([(k, c + 1) for k, c in enumerate(costs)], "seq long, cost long")
    got = {r["seq"]: r["batch"] for r in chains.batches(df, cap).collect()}
    n, used, want = 0, 0, {}
    for k, c in enumerate(costs):
        if used and used + c + 1 > cap:
            n, used = n + 1, 0
        used += c + 1
        want[k] = n
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9), st.integers(0, 1500))
def test_allocation_never_overspends_and_is_fair(spark, costs, total):
    df = spark.createDataFrame([("x", f"s{k}", c) for k, c in enumerate(costs)], "per string, section string, cost long")
    got = {r["section"]: r["share"] for r in budget.allocate(df, F.lit(total), ["per"]).collect()}
    assert sum(got.values()) <= max(total, sum(min(c, got[f"s{k}"]) for k, c in enumerate(costs)))
    short = [got[f"s{k}"] for k, c in enumerate(costs) if got[f"s{k}"] < c]
    assert len(set(short)) <= 1
    if sum(costs) <= total:
        assert all(got[f"s{k}"] == c for k, c in enumerate(costs))


def test_crop_keeps_the_newest_even_over_budget(spark):
    b = spark.createDataFrame([("p", 1, "a" * 40), ("p", 2, "b" * 400), ("p", 3, " ")], "per string, pos long, text string")
    kept = budget.crop(b, F.lit(10), F.lit(1), ["per"], ["pos"], 10).collect()
    assert [(r["pos"], r["left_out"]) for r in kept] == [(2, 1)]


def test_budget_of_a_run():
    assert budget.run_budget(32_000, 408)["summary"] == int(32_000 * 0.333) - 408
    assert budget.share_of("x") == 0.333 and budget.share_of("2") == 0.9
    with pytest.raises(ValueError):
        budget.run_budget(100, 100)


def test_headers_outside_fences(spark):
    t = "\n# one\n```\n# two\n```\n###three\n"
    got = spark.createDataFrame([(t,)], "t string").select(X.upper_headers("t").alias("t")).collect()[0]["t"]
    assert got == "# ONE\n```\n# two\n```\n###THREE"


def test_mentions_and_mail(spark):
    t = "a@mail.com @alice @me жук@alice @Al"
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(X.pseudonymise("t", F.create_map(F.lit("alice"), F.lit("@u1"))).alias("t")).collect()[0]["t"]
    assert got == "a@mail.com @u1 @me жук@alice @Al"


WHOLE = M + ", sender_username string, mentions array<struct<handle string, user_id bigint, name string, real boolean>>, slots array<string>"


def whole(i, sender=1, name="Ann", text="hi", user=None, mentions=None, slots=(), date="2024-01-01T10:00"):
    return (*msg(i, date=date, sender=sender, name=name, text=text), user, mentions, list(slots))


def test_sanitised_text_has_no_handle_or_id(spark):
    rows = [
        whole(1, 555, "Ann", "see 555 and @bob, not 5551 or 0555", slots=["[photo: by @Bob for 555]"]),
        whole(2, 7, "Bob", None, user="@Bob"),
        whole(3, 7, "Bob", "@all hear @me, @everyone", mentions=[("Carl", 9, "Carl", True), ("x", None, "x", False)]),
        whole(4, 7, "Bob", "mail a@b.org, ask @carl or @Nobody"),
    ]
    got = {r["id"]: r for r in identity.sanitised(spark.createDataFrame(rows, WHOLE)).collect()}
    key = {n: "@u" + hashlib.sha256(f"id:{n}".encode()).hexdigest()[:8] for n in (555, 7, 9)}
    assert got[1]["text"] == f"see {key[555]} and {key[7]}, not 5551 or 0555" and got[1]["slots"] == [f"[photo: by {key[7]} for {key[555]}]"]
    assert got[2]["text"] is None
    everyone = " ".join(sorted(key.values()))
    assert got[3]["text"] == f"{everyone} hear {key[7]}, {everyone}"
    assert got[4]["text"] == f"mail a@b.org, ask {key[9]} or @u{hashlib.sha256(b'mention:nobody').hexdigest()[:8]}"


def test_people_keep_names_and_usernames_in_order(spark):
    rows = [whole(1, 1, "Ann", user="ann"), whole(2, 1, "Ann B", user="@ann2", date="2024-01-02"), whole(3, None, None, date="2024-01-03"), whole(4, 2, "Di", mentions=[("carl", 9, "Carl", True)], date="2024-01-04")]
    m = spark.createDataFrame(rows, WHOLE)
    got = {r["sender_id"]: r for r in identity.people(m).collect()}
    assert got[1]["names"] == ["Ann", "Ann B"] and got[1]["usernames"] == ["ann", "ann2"] and got[1]["n_messages"] == 2
    assert got[9]["names"] == ["Carl"] and got[9]["n_messages"] == 0 and not got[None]["grounded"]
    assert {r["handle"] for r in identity.handles(m).collect()} == {"ann", "ann2", "carl"}


def test_strangers_go_to_the_vault_and_back(spark):
    m = spark.createDataFrame([whole(1, 1, "Ann", "ask @Nobody", user="ann"), whole(2, 1, "Ann", "or @nobody @ann @me", date="2024-01-02")], WHOLE)
    people, unknown = identity.people(m), identity.strangers(m, identity.handles(m))
    rows = identity.vault(people, unknown).collect()
    assert [(r["label"], r["mention_only"]) for r in sorted(rows, key=lambda r: r["mention_only"])] == [("@ann", False), ("@Nobody", True)]
    key = next(r["key"] for r in rows if r["mention_only"])
    t = spark.createDataFrame([(1, f"so {key} said")], "id long, text string")
    assert identity.humanised(t, identity.readable(people, unknown)).collect()[0]["text"] == "so @Nobody said"


def test_atoms_name_their_source_and_whom_they_mention(spark):
    rows = [(1, None, "2024-01-01T10:00", 1, "Ann", "hi @bob", None, "photo", '{"resend":true}', [("bob", 2, "Bob", True)], '{"source":"proj"}'), (2, 1, "2024-01-01T10:01", 2, "Bob", "yes", "bob", None, None, None, None)]
    m = spark.createDataFrame(rows, "id long, reply_to long, date string, sender_id long, sender_name string, text string, sender_username string, media_type string, meta string, mentions array<struct<handle string, user_id bigint, name string, real boolean>>, ex string")
    m = m.withColumns({"media_meta": F.try_parse_json("meta"), "extra": F.try_parse_json("ex"), "post_id": F.lit(None).cast("long"), "topic_id": F.lit(None).cast("long")}).drop("meta", "ex")
    from threadloom.operators import rendering

    told = identity.sanitised(chains.described(m))
    a = rendering.atom_text(chains.atoms(chains.with_root(told.filter("id = 1")))).collect()[0]
    bob, ann = ("@u" + hashlib.sha256(f"id:{n}".encode()).hexdigest()[:8] for n in (2, 1))
    assert a["content"] == f"[source: proj]\n[10:00] {ann}: hi {bob}\n  [photo: re-sent image — vision unavailable]"
    assert a["mentions"] == [bob] and a["source"] == "proj"
    assert sorted(r["group"] for r in chains.by_person(chains.atoms(chains.with_root(told))).collect()) == [bob]


def test_rewrite_that_fails_leaves_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append_log(spark.createDataFrame([msg(1)], M), path)
    with pytest.raises(Exception):
        log.rewrite_log(spark.createDataFrame([msg(2)], M).withColumn("text", F.raise_error(F.lit("no")).cast("string")), path)
    assert log.read_log(spark, path).select("id").collect()[0][0] == 1


def test_conversation_ends_with_a_text_or_out_of_rounds():
    files = {}

    def client(prompt, given):
        return "done" if given and given[-1][1] == "ok" else [("write", {"path": "p", "body": "b"}), ("read", {"path": "none"})] if not given else [("read", {"path": "p"})]

    def write(path, body):
        files[path] = body

    def read(path):
        files[path]
        return "ok"

    assert writer.converse(client, "x", {"write": write, "read": read}) == "done" and files == {"p": "b"}
    assert writer.converse(lambda p, g: [("read", {"path": "q"})], "x", {"read": read}, rounds=3) is None


def test_pictures_are_found_as_they_are_or_under_the_chat(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(b"1")
    m = spark.createDataFrame([("m/a.png",), (str(tmp_path / "m" / "a.png"),), ("gone.jpg",), (None,)], "media_path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    got = {r["media_path"]: (r["image"], r["image_type"]) for r in writer.with_image(m, files, str(tmp_path)).collect()}
    assert got["m/a.png"] == (bytearray(b"1"), "image/png") == got[str(tmp_path / "m" / "a.png")] and got["gone.jpg"] == (None, None) == got[None]


def test_prompts_and_profile(spark, tmp_path):
    assert "history:" in writer.system_prompt(sections.build({"history": {}, "world": {}})) and "list_files('a/<b>/')" in writer.discovery("a/", ["b", "c"])
    (tmp_path / "p.md").write_text(" likes rain \n")
    assert log.profile(spark, [None, str(tmp_path / "none"), str(tmp_path / "p.md")]) == "likes rain" and log.profile(spark, []) == "(no profile)"
    from threadloom.plans import run

    assert len(spark.range(1).select(run.now_iso()).collect()[0][0]) == 20


def test_time_rules():
    from threadloom.plans import triggers

    assert triggers.due("days:30", None, "2024-02-01") == (True, None) and triggers.due("days:30", "2024-01-20", "2024-02-01") == (False, None)
    assert triggers.due("deadline:12-01,05-01", "2023-11-30", "2024-05-01") == (True, "2024-05-01") and triggers.due("deadline:12-01", "2024-12-01", "2024-12-09") == (False, None)


def test_view_of_a_section_without_blocks(spark):
    from threadloom.plans import report

    b = spark.createDataFrame([("x", "key_facts", " ", 1, 1), ("x", "world", "w", 1, 1)], "per string, section string, body string, updated long, doc_id long")
    got = {r["section"]: r["text"] for r in report.assembled(b, 100).collect()}
    assert got == {"key_facts": "# Key Facts\n\n(none yet)", "world": "# World\n\nw"}


def test_two_of_a_name(spark):
    p = identity.people(spark.createDataFrame([msg(1, sender=1, name="Ann B"), msg(2, sender=2, name="ann b")], M))
    assert sorted(r["label"][:5] for r in identity.labels(p).collect()) == ["@annb", "@annb"] and len({r["label"] for r in identity.labels(p).collect()}) == 2


def test_store_fold_with_edits(spark):
    ops = [("k", 1, "write", "one two two", None, None), ("k", 2, "edit", None, "two", "2"), ("k", 3, "append", "end", None, None), ("j", 1, "write", "x", None, None), ("j", 2, "delete", None, None, None)]
    got = dict(store.folded(spark.createDataFrame(ops, "key string, seq long, op string, body string, old string, new string")).collect())
    assert got == {"k": "one 2 two\n\nend", "j": ""}


def test_query_conditions(spark):
    r = spark.createDataFrame([("a/1", "Open", 5.0, ["x", "y"]), ("a/2", None, None, ["z"])], "key string, status string, n double, tags array<string>")
    keys = lambda where, **k: [x["key"] for x in store.query(r, where=where, **k).collect()]
    assert keys({"status": "OPE"}) == ["a/1"] and keys({"status": ""}) == ["a/1", "a/2"]
    assert keys({"n": ">=5"}) == ["a/1"] and keys({"status": ">=a"}) == [] and keys({"tags": ["z", "q"]}) == ["a/2"]
    assert keys({}, sort="-n") == ["a/2", "a/1"] and keys({}, sort="n") == ["a/1", "a/2"] and keys({}, limit=1) == ["a/1"]


def test_bad_paths_are_values(spark):
    got = spark.createDataFrame([("a/../b",), (" /world.md ",), ("nowhere/x",)], "p string").select(store.resolve("p").alias("r")).select("r.*").collect()
    assert [g["error"] for g in got] == ["bad path", None, "no section owns this path"] and got[1]["key"] == "world.md"


def test_terms_and_deadlines(spark):
    df = spark.createDataFrame([("2025-01-31",), ("2025-02-01",), ("2025-08-01",)], "d string")
    assert [r[0] for r in df.select(P.term("d")).collect()] == ["2024-fall", "2025-spring", "2025-fall"]
    got = spark.range(1).select(P.crossed(F.lit("2023-12-01"), F.lit("2025-05-01"), ["12-01", "05-01"])).collect()[0][0]
    assert got == ["2024-05-01", "2024-12-01", "2025-05-01"]


def test_backfilled_chain_is_fed_whole(spark):
    m = spark.createDataFrame([msg(1), msg(2, 1, date="2024-01-03T10:00"), msg(3, 1, date="2024-01-02T10:00")], M)
    a = chains.atoms(chains.with_root(m))
    done = spark.createDataFrame([("s", 1, 2, "2024-01-03T10:00")], "section string, root long, done_count long, done_leaf string")
    r = progress.status(a, done, ["s"]).withColumn("since", progress.since()).collect()[0]
    assert r["status"] == "partial" and r["since"] == 0


def test_log_round_trip_and_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.jsonl").write_text('{"id":1,"date":"2024-01-01T10:00","text":"a","unknown":3}\n\n{"id":2,"date":"2024-01-02","reply_to":1}\n')
    m = log.read_log(spark, str(tmp_path / "in"))
    assert m.count() == 2
    log.rewrite_log(m, str(tmp_path / "out"))
    log.append_log(m.filter("id = 2"), str(tmp_path / "out"))
    assert log.read_log(spark, str(tmp_path / "out")).count() == 3
    export = {"type": "public_channel", "id": 9, "name": "C", "messages": [{"type": "service", "id": 1}, {"type": "message", "id": 2, "date": "2024-01-01T10:00", "from": "A", "from_id": "user77", "text": ["x ", {"type": "bold", "text": "y"}]}, {"type": "message", "id": 3, "date": "2024-01-01T10:01", "from_id": "channel", "text": "z", "media_type": "voice_message", "reply_to_message_id": 2}]}
    (tmp_path / "e.json").write_text(json.dumps(export))
    messages, chat = log.import_export(spark, str(tmp_path / "e.json"))
    rows = {r["id"]: r for r in messages.collect()}
    assert rows[2]["text"] == "x y" and rows[2]["sender_id"] == 77 and rows[3]["sender_id"] is None and rows[3]["media_type"] == "voice" and rows[3]["reply_to"] == 2
    assert chat.collect()[0]["kind"] == "channel"


def test_sections_and_writer(spark):
    assert list(sections.spec_of(drop=["world"], add={"world": {}})) == ["people", "history", "key_facts", "world"]
    with pytest.raises(ValueError):
        sections.spec_of({"nope": {}})
    people = sections.build({"people": {}})[0]
    f = spark.createDataFrame([("people/@u00000001/status.md", "minor - rarely here", 1), ("people/@u00000002/status.md", "core", 2), ("people/@u00000002/aka.md", "Al", 3)], "path string, body string, updated long")
    got = {r["key"]: r["text"] for r in people.blocks(f).collect()}
    assert got["minor"].endswith("@u00000001 (rarely here)") and got["@u00000002"].startswith("## @u00000002\n\n### Status\ncore\n\n### Also")
    calls = []

    def busy(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise writer.Retry("busy")
        return "ok"

    assert writer.with_retries(busy, "p", sleep=lambda s: None) == ("ok", None, None)
    out = writer.write(spark.createDataFrame([("k", "a: b")], "key string, prompt string")).collect()[0]
    assert out["reply"] == "b" and out["error"] is None and not out["too_long"]


def test_stream_equals_batch(spark, tmp_path):
    from threadloom.streaming import live

    src = tmp_path / "src"
    src.mkdir()
    rows = [{"id": 2, "date": "2024-01-02", "reply_to": 1}, {"id": 3, "date": "2024-01-03", "reply_to": 2}, {"id": 1, "date": "2024-01-01"}]
    state = live.Extents(spark, str(tmp_path / "state"))
    for k, r in enumerate(rows):
        (src / f"{k}.json").write_text(json.dumps(r) + "\n")
        state.start(live.read_stream(spark, str(src), 1), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in state.extents().collect()] == [(1, 3, "2024-01-03")]


def test_run_state_resumes_and_chunks_adapt(spark, tmp_path):
    from threadloom.plans import run

    s = run.State(spark, str(tmp_path / "state"))
    assert s.last() is None
    t = spark.createDataFrame([("people", 1, 2, "2024-01-01")], "section string, root long, done_count long, done_leaf string")
    s.save(done=t, files=t, tasks=t, fired=t)
    s.save(done=t.limit(0), files=t, tasks=t, fired=t)
    assert s.last() == 2 and s.load("done").count() == 0
    m = chains.atoms(chains.with_root(spark.createDataFrame([msg(1), msg(2, 1)], M)))
    assert run.pending(m, t, ["people", "world"]).select("section").collect()[0]["section"] == "world"
    sizes = []
    got = run.ingest(list(range(100)), lambda c: (sizes.append(len(c)), sum(c) < 900)[1], 24)
    assert sum(n for n, _ in got) == 100 and max(sizes) >= 24 and not any(f for _, f in got)
    assert run.ingest([5], lambda c: False) == [(1, True)]


def test_report_goes_to_three_places(spark, tmp_path):
    from threadloom.plans import run

    m = spark.createDataFrame([msg(1, name="Ann")], M)
    key = m.select(X.person_key("sender_id", "sender_name")).collect()[0][0]
    b = spark.createDataFrame([("x", "people", f"about {key}", 1, 1)], "per string, section string, body string, updated long, doc_id long")
    run.write_report(b, m, 1000, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "named")).filter("value like '%about @ann%'").count() == 1
    assert spark.read.json(str(tmp_path / "out" / "vault")).collect()[0]["key"] == key


def test_slots_of_pictures(spark):
    from threadloom.operators import media

    df = spark.createDataFrame([("photo", None, True, False), ("photo", None, False, True), ("photo", "a cat", True, True), ("video", None, None, None), (None, None, None, None)], "k string, d string, r boolean, f boolean")
    got = [x[0] for x in df.select(media.slots(F.col("k"), F.col("d"), F.lit(None).cast("string"), F.col("r"), F.col("f"))).collect()]
    assert got == ["[photo: re-sent image — vision unavailable]", "[photo: download failed — vision unavailable]", "[photo: a cat]", "[file: video — thumbnail not described]", None]


def test_days_close_behind_the_watermark(spark, tmp_path):
    from threadloom.streaming import live

    src = tmp_path / "src"
    src.mkdir()
    for k, date in enumerate(["2024-01-01T10:00:00", "2024-01-01T12:00:00", "2024-01-09T10:00:00", "2024-01-01T13:00:00"]):
        (src / f"{k}.json").write_text(json.dumps({"id": k, "date": date, "sender_id": k}) + "\n")
    q = live.per_day(live.read_stream(spark, str(src), 1)).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select messages from days").collect()
    assert len(rows) == 1 and rows[0]["messages"] in (2, 3)


def _descend(live, period):
    """A period as coarse as there is a file for it."""
    if period in live or len(period) == 10:
        return [period] if period in live else []
    if len(period) == 4:
        parts = [f"{period}-q{q}" for q in range(1, 5)]
    elif "q" in period:
        q = int(period[-1])
        parts = [f"{period[:4]}-{m:02d}" for m in range(3 * q - 2, 3 * q + 1)]
    else:
        parts = sorted(p for p in live if len(p) == 10 and p.startswith(period))
    return [x for p in parts for x in _descend(live, p)]


def _taper(live, today):
    year, month = today[:4], int(today[5:7])
    quarter = (month + 2) // 3
    out = [x for y in sorted({p[:4] for p in live if p[:4] < year}) for x in _descend(live, y)]
    out += [x for q in range(1, quarter) for x in _descend(live, f"{year}-q{q}")]
    now = [x for m in range(3 * quarter - 2, month) for x in _descend(live, f"{year}-{m:02d}")]
    days = [p for p in sorted(live) if len(p) == 10 and p[:7] == today[:7] and p <= today]
    now += days or ([today[:7]] if today[:7] in live else [])
    return out + (now or [p for p in (f"{year}-q{quarter}", year) if p in live][:1])


@settings(max_examples=10, deadline=None)
@given(st.sets(st.sampled_from([*(f"{y}-{m:02d}-{d:02d}" for y in (2023, 2024) for m in (1, 5, 8, 9) for d in (3, 20)), *(f"{y}-{m:02d}" for y in (2023, 2024) for m in (1, 5, 8, 9)), *(f"{y}-q{q}" for y in (2023, 2024) for q in (1, 2, 3)), "2023", "2024"])), st.sampled_from(["2024-08-10", "2024-01-03", "2024-09-30"]))
def test_taper_equals_the_descent(spark, live, today):
    from threadloom.operators import history

    files = spark.createDataFrame([(p, "what happened") for p in live] + [("2022", "(empty)"), ("bad", "x y z")], "period string, body string")
    assert sorted(r["period"] for r in history.taper(files, today).collect()) == sorted(_taper(live, today))


def test_command_line(spark, tmp_path):
    from threadloom import cli

    assert cli.parse_sections(["people:timeline=off,x=on", "world"]) == {"people": {"timeline": False, "x": True}, "world": {}}
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "m.jsonl").write_text("\n".join(json.dumps({"id": k, "date": f"2024-01-{k:02d}T10:00", "text": "word " * 40, "sender_id": 1}) for k in range(1, 9)))
    assert cli.main(["report", str(tmp_path / "log"), str(tmp_path / "out"), "--window", "2000"]) == 0
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["atoms"] for r in rows) == 8 and len(rows) > 1
