"""Columns over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that address a group rather than a person.
GROUP_TOKENS = ("me", "all", "everyone")
MENTION = r"(?U)(?<![\w@])@([A-Za-z0-9_]{3,32})"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Estimated tokens: a quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4)).cast("long")


def digest(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 8)


def person_seed(sender_id: Column | str, name: Column | str) -> Column:
    """What tells people apart: the id, or the name where there is no id ("unknown" where there is neither)."""
    return F.when(col(sender_id).isNotNull(), F.concat(F.lit("id:"), col(sender_id).cast("string"))).otherwise(F.concat(F.lit("name:"), F.lower(F.trim(F.coalesce(F.nullif(col(name), F.lit("")), F.lit("unknown"))))))


def key_of(seed: Column | str) -> Column:
    return F.concat(F.lit("@u"), digest(col(seed)))


def person_key(sender_id: Column | str, name: Column | str) -> Column:
    """A person's pseudonym. It is 32 bits of a digest: of a million people, about a hundred pairs share theirs."""
    return key_of(person_seed(sender_id, name))


def mention_key(handle: Column) -> Column:
    return key_of(F.concat(F.lit("mention:"), F.lower(handle)))


def slugify(name: Column | str) -> Column:
    """Lower case, letters, digits and dashes; never empty."""
    s = F.regexp_replace(F.lower(F.trim(col(name))), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("chat"))


def day(date: Column | str) -> Column:
    return F.substring(col(date), 1, 10)


def clock(date: Column | str) -> Column:
    """hh:mm, or empty where the date has no time."""
    return F.when(F.length(col(date)) >= 16, F.substring(col(date), 12, 5)).otherwise("")


def upper_headers(text: Column | str) -> Column:
    """Markdown headers in upper case, outside fences; outer blank lines go."""
    lines = F.split(col(text), "\n", -1)
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^[ \t]*```")
        head = ~fence & ~acc["fenced"] & line.rlike(r"^[ \t]*#{1,6}[ \t]*\S")
        marks = r"^([ \t]*#{1,6}[ \t]*)"
        out = F.when(head, F.concat(F.regexp_extract(line, marks, 1), F.upper(F.regexp_replace(line, marks, "")))).otherwise(line)
        return F.struct(F.when(fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"), F.concat(acc["done"], F.array(out)).alias("done"))

    return F.regexp_replace(F.array_join(F.aggregate(lines, start, step)["done"], "\n"), r"^\s+|\s+$", "")


def rewrite(text: Column, pattern: str, group: int, change) -> Column:
    """text with each match of pattern replaced by change(group of the match, whole match)."""
    rest = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    new = F.transform(F.arrays_zip(whole.alias("w"), part.alias("p")), lambda m: change(m["p"], m["w"]))
    woven = F.transform(rest, lambda s, i: F.concat(s, F.coalesce(F.get(new, i), F.lit(""))))
    return F.array_join(woven, "")


def pseudonymise(text: Column | str, known: Column | None = None, prefix: str = "") -> Column:
    """@handles as pseudonyms: a known person's key (map of prefix and lower-case handle to key), else one from the handle."""

    def change(handle: Column, whole: Column) -> Column:
        key = mention_key(handle)
        if known is not None:
            key = F.coalesce(F.try_element_at(known, F.concat(F.lit(prefix), F.lower(handle))), key)
        return F.when(F.lower(handle).isin(*GROUP_TOKENS), whole).otherwise(key)

    return rewrite(col(text), MENTION, 1, change)


NUMBER = r"(?U)\b\d+\b"


def scrub_ids(text: Column | str, keys: Column, prefix: str = "") -> Column:
    """Whole numbers that are somebody's id as it is written, as that person's key (map of prefix and id to key)."""
    return rewrite(col(text), NUMBER, 0, lambda _, whole: F.coalesce(F.try_element_at(keys, F.concat(F.lit(prefix), whole)), whole))


ALL, ME = r"(?iU)(?<![\w@])@(?:all|everyone)\b", r"(?iU)(?<![\w@])@me\b"


def expand_groups(text: Column | str, everyone: Column, speaker: Column) -> Column:
    """@all and @everyone as all keys, @me as the speaker's."""
    t = F.regexp_replace(col(text), F.lit(ALL), everyone)
    return F.regexp_replace(t, F.lit(ME), speaker)


def has_content(body: Column | str) -> Column:
    """At least two word characters, and not one short remark in parentheses."""
    b = F.regexp_replace(F.coalesce(col(body), F.lit("")), r"(?U)^\s+|\s+$", "")
    remark = b.startswith("(") & b.endswith(")") & (F.length(b) < 160)
    return (F.regexp_count(b, F.lit(r"(?U)\w")) >= 2) & ~remark
