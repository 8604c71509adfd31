"""python -m lanternfish index FOLDER [--rebuild] | search QUERY..."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lanternfish import config
from lanternfish.engine import Engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lanternfish")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="embed a folder of markdown files")
    index.add_argument("path", nargs="?")
    index.add_argument("--rebuild", action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query", nargs="+")
    find.add_argument("--top-k", type=int)
    args = parser.parse_args(argv)
    settings = config.load()
    logging.getLogger("lanternfish").setLevel(settings.log_level)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "index":
        if args.path:
            settings = dataclasses.replace(settings, docs_path=args.path)
        if args.rebuild:
            for p in Path(settings.index_dir).glob("docs-*"):
                shutil.rmtree(p)
        print(Engine(spark, settings).docs().count())
    else:
        for row in Engine(spark, settings).search(" ".join(args.query), args.top_k).toJSON().collect():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
