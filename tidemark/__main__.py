"""Command line: ``python -m tidemark store | check | simulate``.

A simulation is described by specs, one per run: ``--spec "entry_z=2.5 cancel_assumption=Optimistic"`` gives the fields that differ from the defaults of
``RunSpec``, ``--specs FILE`` reads a JSON list of such objects. All specs run in one scan of each session.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.backtest import OUTPUTS, RunSpec, backtest
from .operators.replay import MODES, validate
from .sources import feeds

_KINDS = {f.name: type(getattr(RunSpec(), f.name)) for f in fields(RunSpec)}


def spec_of(values: dict[str, object]) -> RunSpec:
    """A run from field names and values, given as text or as themselves; what it is labelled with unless it has a label."""
    if unknown := values.keys() - _KINDS.keys():
        raise ValueError(f"no such field of a run: {', '.join(sorted(unknown))}")
    typed = {k: str(v).lower() in ("1", "true", "yes") if _KINDS[k] is bool else _KINDS[k](v) for k, v in values.items()}
    return RunSpec(**{"label": " ".join(f"{k}={v}" for k, v in typed.items()), **typed})


def specs_of(texts: list[str], file: str | None) -> list[RunSpec]:
    listed = [dict(part.split("=", 1) for part in text.split()) for text in texts]
    if file:
        with open(file) as f:
            listed += json.load(f)
    return [spec_of(x) for x in listed or [{}]]


def store(spark: SparkSession, a: argparse.Namespace) -> None:
    feeds.convert(feeds.find_days(spark, a.source), a.data, a.levels, a.replace)


def check(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return validate(*_tables(spark, a), a.levels, a.mode or MODES)


def simulate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return backtest(*_tables(spark, a, specs_of(a.spec, a.specs)), a.levels, not a.seed_only, a.result)


def _tables(spark: SparkSession, a: argparse.Namespace, *between: object) -> list:
    both = [load(spark, a.data, a.levels) for load in (feeds.load_messages, feeds.load_depth)]
    if a.symbols:
        both = [t.where(F.col("symbol").isin(a.symbols)) for t in both]
    return [both[0], *between, both[1]]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(required=True)
    for do, about in ((store, "put pairs of CSV files into Parquet"), (check, "compare replays with the recorded depth"), (simulate, "run strategies over stored sessions")):
        c = commands.add_parser(do.__name__, help=about)
        c.set_defaults(do=do)
        if do is store:
            c.add_argument("source")
            c.add_argument("--replace", action="store_true", help="write days again that are stored already")
        c.add_argument("data")
        c.add_argument("--levels", type=int, default=10)
        if do is not store:
            c.add_argument("--symbols", nargs="+")
            c.add_argument("--to", help="a path to write to, CSV if it ends so, else Parquet")
        if do is check:
            c.add_argument("--mode", action="append", choices=MODES)
        if do is simulate:
            c.add_argument("--spec", action="append", default=[], metavar="FIELDS")
            c.add_argument("--specs", metavar="FILE")
            c.add_argument("--result", choices=sorted(OUTPUTS), default="metrics")
            c.add_argument("--seed-only", action="store_true", help="no resync after the first book")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = a.do(spark, a)
    if out is not None:
        feeds.save(out, a.to) if a.to else out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
