"""What the jobs' command lines share: a JSON file of settings, overridden by name=value, and a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


@contextmanager
def conf(spark: SparkSession, **values: str):
    """Session settings (dots as __) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def main(job: Callable[..., Any], doc: str, argv: list[str] | None = None) -> None:
    """Read the settings, run the job in a session of its own, stop it."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("config", help="a JSON file with the job's arguments")
    parser.add_argument("settings", nargs="*", metavar="name=value", help="in place of what the file says")
    args = parser.parse_args(argv)
    given = json.loads(Path(args.config).read_text(encoding="utf-8")) | dict(s.split("=", 1) for s in args.settings)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, **given)
    finally:
        spark.stop()
