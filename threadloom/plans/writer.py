"""The one step that a model may do: prompts in, writes out. Clients are functions from a prompt to a reply.

Calls run on the executors, partition by partition, with retries; a failure is a value in a column. The default client
needs no model: it extracts the first line of each message.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES, FIRST_WAIT = 5, 5.0
# What endpoints say, with status 400, when a prompt is too long.
TOO_LONG_STATUS = 400
TOO_LONG_MARKS = ("context length", "context window", "longer than", "maximum context", "maximum length", "too many tokens", "reduce the length", "exceeds the model")


class Refused(Exception):
    """An endpoint's error with its status."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def is_overflow(status: Column, message: Column) -> Column:
    """Whether an error means that the prompt was too long."""
    said = F.lower(F.coalesce(message, F.lit("")))
    some = F.lit(False)
    for mark in TOO_LONG_MARKS:
        some = some | F.contains(said, F.lit(mark))
    return F.coalesce(status == TOO_LONG_STATUS, F.lit(False)) & some


class Retry(Exception):
    """Worth another try: the endpoint is busy or out of reach."""


def extractive(prompt: str) -> str:
    return "\n".join(line.split(": ", 1)[-1][:200] for line in prompt.splitlines() if ": " in line)


def with_retries(client: Callable[[str], str], prompt: str, wait: float = FIRST_WAIT, retries: int = RETRIES, sleep=time.sleep) -> tuple[str | None, str | None, int | None]:
    """(reply, error, status): waits double after each failure that is worth another try."""
    for k in range(retries):
        try:
            return client(prompt), None, None
        except Retry as e:
            if k + 1 == retries:
                return None, str(e), None
            sleep(wait * 2**k)
        except Refused as e:
            return None, str(e), e.status
        except Exception as e:  # whatever a client raises becomes the row's error
            return None, f"{type(e).__name__}: {e}", None
    return None, None, None


def write(prompts: DataFrame, client: Callable[[str], str] = extractive, parallel: int | None = None) -> DataFrame:
    """prompts (key, prompt) with reply, error, status and whether the error means that the prompt was too long."""

    def call(batches):
        for b in batches:
            got = [with_retries(client, p) for p in b["prompt"]]
            yield b.assign(reply=[r for r, _, _ in got], error=[e for _, e, _ in got], status=[None if x is None else float(x) for _, _, x in got])

    p = prompts.repartition(parallel) if parallel else prompts
    out = p.mapInPandas(call, ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", reply string, error string, status double")
    return out.withColumn("status", F.col("status").cast("int")).withColumn("too_long", is_overflow(F.col("status"), F.col("error")))


#: Rounds of tool calls that one run may take.
ROUNDS = 40


def converse(client: Callable[[str, list], list | str], prompt: str, tools: dict[str, Callable[..., str]], rounds: int = ROUNDS) -> str | None:
    """One run: the client gets the prompt and what its calls gave so far, and answers with further calls
    (a list of (tool, arguments)) or a text, which ends the run. A tool's error is what the call gave. None: out of rounds."""
    given: list = []
    for _ in range(rounds):
        said = client(prompt, given)
        if isinstance(said, str):
            return said
        for name, arguments in said:
            try:
                given.append((name, tools[name](**arguments)))
            except Exception as e:  # the client may try otherwise
                given.append((name, f"error: {e}"))
    return None


def undescribed(messages: DataFrame) -> DataFrame:
    """Messages with a picture that nobody has described."""
    return messages.filter(F.col("media_type").isin("photo", "video") & F.col("media_path").isNotNull() & F.col("photo_desc").isNull())


def describe(messages: DataFrame, images: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """Messages with photo_desc for pictures without one: each picture is described once, whoever posts it.

    images: media_path and a prompt for the client."""
    todo = undescribed(messages).select("media_path").distinct()
    said = write(todo.join(images, "media_path"), client).select(F.col("media_path").alias("p"), "reply")
    joined = messages.join(said, F.col("media_path") == F.col("p"), "left")
    return joined.withColumn("photo_desc", F.coalesce("photo_desc", "reply")).select(*messages.columns)


def with_image(messages: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Messages with the bytes and type of their picture; files: of Spark's binaryFile source. A path counts as it is, or
    under the chat's folder."""
    kinds = F.create_map(*[F.lit(x) for kv in (("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp")) for x in kv])
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    f = files.select(plain.alias("file"), "content")
    asked = messages.filter("media_path is not null").select("media_path").distinct()
    either = asked.select("media_path", F.posexplode(F.array(F.col("media_path"), F.concat(F.lit(root.rstrip("/") + "/"), "media_path"))).alias("rank", "file"))
    got = either.join(f, "file").groupBy("media_path").agg(F.min_by("content", "rank").alias("image")).withColumnRenamed("media_path", "of")
    ending = F.lower(F.regexp_extract("media_path", r"\.([A-Za-z0-9]+)$", 1))
    out = messages.join(got, F.col("media_path") == F.col("of"), "left").drop("of")
    return out.withColumn("image_type", F.when(F.col("image").isNotNull(), F.coalesce(F.try_element_at(kinds, ending), F.lit("image/jpeg"))))


def discovery(prefix: str, tiers: list[str]) -> str:
    """Which levels to list before anything is written under a prefix."""
    path, lines = prefix, []
    for tier in tiers:
        lines.append(f"- list_files('{path}') shows each {tier} that exists")
        path += f"<{tier}>/"
    return "\n".join(["Look before you file, level by level, and use a name that exists if it fits:", *lines, "Read the note that you arrive at, and merge into it; make a new one only for something new."])


def system_prompt(sections: list, preamble: str = "You keep the files of a report.", grounding: str = "Write only what the messages say.") -> str:
    """What every run is told: the preamble, which paths each section has, and the rule to stay with the sources."""
    return "\n".join([preamble, "\n\n".join(s.paths_doc() for s in sections), "", grounding])
