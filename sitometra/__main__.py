"""Command line: python -m sitometra STAGE paths, with the fields of the stage's options as --flags."""

from __future__ import annotations

import argparse
import sys
import types
import typing
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from .config import AnalyzeOptions, GraphOptions, HarvestOptions, Lexicon, LinkOptions, SampleOptions
from .plans import pipelines
from .sources import tables

STAGES = {
    "harvest": (HarvestOptions, ("editions", "metadata", "out")),
    "link": (LinkOptions, ("candidates", "editions", "out", "mentions")),
    "analyze": (AnalyzeOptions, ("linked", "out")),
    "graphs": (GraphOptions, ("cleaned", "out")),
    "sample": (SampleOptions, ("linked", "out")),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sitometra", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)
    for name, (options, paths) in STAGES.items():
        one = stages.add_parser(name)
        for path in paths:
            one.add_argument(path)
        kinds = typing.get_type_hints(options)
        for f in fields(options):
            kind = kinds[f.name]
            flag = "--" + f.name.replace("_", "-")
            if isinstance(kind, types.UnionType):
                kind = next(k for k in typing.get_args(kind) if k is not type(None))
            if kind is Lexicon:
                continue
            if kind is bool:
                one.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            elif typing.get_origin(kind) is tuple:
                of = typing.get_args(kind)
                one.add_argument(flag, nargs="+" if of[-1] is Ellipsis else len(of), type=of[0], default=f.default, dest=f.name)
            else:
                one.add_argument(flag, type=kind, default=f.default)
        if name == "link":
            one.add_argument("--append", action="store_true", help="add to the tables that are there")
    return top


def _there(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)


def run(spark: SparkSession, argv: list[str]) -> dict[str, int]:
    """Run a stage; the counts of what it read and made. Inputs that are not there raise FileNotFoundError."""
    args = parser().parse_args(argv)
    kind, paths = STAGES[args.stage]
    for name in paths:
        if name not in ("out", "mentions"):
            _there(spark, getattr(args, name))
    given = {f.name: getattr(args, f.name) for f in fields(kind) if hasattr(args, f.name)}
    options = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    if args.stage == "harvest":
        return {"candidates": pipelines.run_harvest(spark, args.editions, args.metadata, args.out, options).count()}
    if args.stage == "link":
        candidates = tables.read_csv(spark, args.candidates, ("DDB_ID", "XML_RelPath"))
        return pipelines.run_link(spark, candidates, args.editions, args.out, args.mentions, options, "append" if args.append else "overwrite").counts()
    if args.stage == "sample":
        return {"sampled": pipelines.run_sample(tables.read_csv(spark, args.linked), args.out, options).count()}
    stage = {"analyze": pipelines.run_analyze, "graphs": pipelines.run_graphs}[args.stage]
    made: dict[str, DataFrame] = stage(tables.read_csv(spark, args.linked if args.stage == "analyze" else args.cleaned), args.out, options)
    return {name: df.count() for name, df in made.items()}


if __name__ == "__main__":
    session = SparkSession.builder.appName("sitometra").getOrCreate()
    for key, count in run(session, sys.argv[1:]).items():
        print(f"{key}: {count}")
    session.stop()
