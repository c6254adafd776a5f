"""Command line: python -m threadloom.cli report|list|import ..."""

from __future__ import annotations

import argparse


def parse_sections(items: list[str]) -> dict[str, dict]:
    """name:feature=off,other=on to features per name."""
    out: dict[str, dict] = {}
    for item in items:
        name, _, rest = item.partition(":")
        out[name] = {k: v not in ("off", "false", "no", "0") for k, _, v in (f.partition("=") for f in rest.split(",") if f)}
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="threadloom")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="pack a log into batches")
    r.add_argument("log")
    r.add_argument("out")
    r.add_argument("--window", type=int, default=32_000)
    r.add_argument("--share", default=None)
    r.add_argument("--system", type=int, default=408)
    li = sub.add_parser("list", help="chats under a folder")
    li.add_argument("root")
    im = sub.add_parser("import", help="import a chat export")
    im.add_argument("export")
    im.add_argument("out")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import budget
    from .plans import report
    from .sources import log

    spark = SparkSession.builder.appName("threadloom").getOrCreate()
    if a.command == "list":
        for row in log.list_chats(spark, a.root).toLocalIterator():
            print(row["slug"])
    elif a.command == "import":
        messages, chat = log.import_export(spark, a.export)
        log.rewrite_log(messages, f"{a.out}/messages")
        log.write_headers(chat, f"{a.out}/meta")
    else:
        parts = budget.run_budget(a.window, a.system, budget.share_of(a.share))
        report.batched(log.read_log(spark, a.log), F.lit(0), parts["summary"]).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
