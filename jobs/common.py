"""What the jobs share: configurations, columns of given tables, reading back, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import asdict, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def configured(kind: type, path: str | None):
    """The configuration of a job: its JSON file, or the one beside the job; names that the job does not know are an error."""
    given = json.loads(Path(path).read_text())
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return kind(**given)


def columns(table: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """The columns that a configuration makes of a given table, each by an SQL expression."""
    return table.select(*[F.expr(text).alias(name) for name, text in expressions.items()])


def command(name: str, kind: type, run: Callable, paths: dict[str, str]) -> None:
    """Runs a job from the command line in a session of its own, which ends with it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, text in paths.items():
        parser.add_argument(path, help=text)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="a JSON file of settings")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = configured(kind, given.config)
    log.info("%s with %s", name, asdict(config))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[getattr(given, path) for path in paths], config)
    finally:
        spark.stop()
