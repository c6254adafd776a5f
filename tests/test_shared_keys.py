"""People and handles whose keys are the same 32 bits, as some are in every large log; ids from a search over sha256."""

import duckdb

from threadloom import registry
from threadloom.functions import text as X
from threadloom.operators import identity

C = "conv_id long, turn long, role string, text string"


def both(spark, path, name, turns):
    """Rows of a query and of its SQL over these conversations."""
    spark.createDataFrame(turns, C).write.parquet(f"{path}/conversations.parquet")
    df = registry.queries()[name](spark, str(path))
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    sql = f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})"
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(duck.sql(sql).fetchall(), key=repr)


def test_labels_of_people_who_share_a_key(spark, tmp_path):
    # sender 142241 is a user, 340182 an assistant, both @u7ff8bef8; 4951 and 350871 are users, both @ud809fb7e
    turns = [(14224, 0, "user", "a"), (34018, 0, "user", "b"), (34018, 1, "assistant", "c"), (495, 0, "user", "d"), (35087, 0, "user", "e")]
    ours, theirs = both(spark, tmp_path, "id_labels", turns)
    assert ours == theirs and len(ours) == 4 and len({r[0] for r in ours}) == 3


def test_keys_are_listed_once(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "id_keys", [(14224, 0, "user", "a"), (34018, 1, "assistant", "b")])
    assert ours == theirs and len(ours) == 1


def test_ids_of_people_who_share_a_key_are_all_scrubbed(spark):
    rows = [(1, "2024-01-01", 142241, "Ann", "ask 340182"), (2, "2024-01-01", 340182, "Bob", "ask 142241")]
    m = spark.createDataFrame(rows, "id long, date string, sender_id long, sender_name string, text string")
    assert {r["text"] for r in identity.sanitised(m).collect()} == {"ask @u7ff8bef8"}
    assert {(r["sender_id"], r["key"], r["n_messages"]) for r in identity.people(m).collect()} == {(142241, "@u7ff8bef8", 1), (340182, "@u7ff8bef8", 1)}
    assert m.select(X.person_key("sender_id", "sender_name")).distinct().count() == 1


def test_vault_has_a_row_for_each_who_shares_a_key(spark, tmp_path):
    turns = [
        (2383, 0, "user", "a"), (30630, 0, "user", "b"), (30630, 1, "assistant", "c"),  # a user and an assistant
        (20985, 0, "system", "d"), (20985, 1, "user", "e"), (21366, 0, "system", "f"), (21366, 1, "user", "g"), (1, 0, "system", "h"), (2, 0, "system", "i"),  # two systems
    ]
    ours, theirs = both(spark, tmp_path, "id_vault", turns)
    keys = [r[0] for r in ours if r[2] in (900000023831, 900000306302, 900000209850, 900000213660)]
    assert ours == theirs and sorted(keys) == ["@u45b7622c"] * 2 + ["@u954371ab"] * 2


def test_vault_has_a_row_for_each_stranger(spark, tmp_path):
    # @user9796 and @user31201 are nobody's and share a key; @user1252 has the key of the system of 9184
    turns = [(9796, 0, "system", "a"), (31201, 0, "system", "b"), (1252, 0, "system", "c"), (9184, 0, "system", "d"), (9184, 1, "user", "e")]
    ours, theirs = both(spark, tmp_path, "id_vault", turns)
    assert ours == theirs and {"@user9796", "@user31201", "@user1252"} <= {r[1] for r in ours}


def test_vault_of_chats_of_a_thousand_turns(spark, tmp_path):
    turns = [(1, t, "assistant" if t % 2 else "user", "a") for t in range(1004)] + [(2, 0, "system", "b"), (2, 1, "user", "c"), (2, 2, "assistant", "d")]
    ours, theirs = both(spark, tmp_path, "id_vault", turns)
    assert ours == theirs
