"""``python -m tidemark STORE COMMAND ...``: the API from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.vault import Vault


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("store")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        one = commands.add_parser(name)
        for p in positional:
            one.add_argument(p)
        for flag, kind in options.items():
            one.add_argument("--" + flag.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": kind}))

    command("add", "text", source=str, user=str, project=str, entity=str, time=str)
    command("search", "question", top_k=int, as_of=str, min_score=float)
    command("history", "question", max_len=int)
    command("changes", "since", until=str, limit=int)
    command("volatility", min_revisions=int)
    command("ingest", "folder")
    command("merge", "other", deduplicate=bool)
    command("split", "key", "folder")
    command("forget", "question", top_k=int)
    command("stats")
    command("inspect")
    return top


def moment(spark: SparkSession, said: str | None) -> float | None:
    """A number of seconds, an ISO instant or a date, as seconds since 1970."""
    if said is None:
        return None
    value = spark.range(1).select(T.parse_time(F.lit(said)).alias("t")).first().t
    if value is None:
        raise SystemExit(f"not a time: {said!r}")
    return value


def run(spark: SparkSession, argv: list[str]):
    """What a command returns: a DataFrame, a number, an id or a mapping."""
    a = parser().parse_args(argv)
    vault, at = Vault(spark, a.store), lambda said: moment(spark, said)
    if a.command == "add":
        return vault.add(a.text, a.source or "cli", timestamp=at(a.time), user_id=a.user, project=a.project, entity=a.entity)
    if a.command == "search":
        return vault.search(a.question, a.top_k or 3, as_of=at(a.as_of), min_score=a.min_score or 0.0)
    if a.command == "history":
        return vault.history(a.question, a.max_len).select("ts", "revision", "text", "superseded")
    if a.command == "changes":
        return vault.changes(at(a.since), at(a.until), a.limit).select("ts", "entity", "revision", "text")
    if a.command == "volatility":
        return vault.volatility(a.min_revisions or 2)
    if a.command == "ingest":
        return vault.ingest_directory(a.folder)
    if a.command == "merge":
        return vault.merge(Vault(spark, a.other), deduplicate=a.deduplicate)
    if a.command == "split":
        return vault.split_by_key(a.key, a.folder)
    if a.command == "forget":
        return vault.forget(a.question, a.top_k or 5)
    return vault.stats() if a.command == "stats" else vault.inspect()[0]


if __name__ == "__main__":
    session = SparkSession.builder.appName("tidemark").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    result = run(session, sys.argv[1:])
    result.show(truncate=False) if hasattr(result, "show") else print(result)
