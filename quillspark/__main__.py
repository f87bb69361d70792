"""``python -m quillspark index|search|bench CONFIG [query ...]``: build if missing, search, compare."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from quillspark.operators.index import build_index, read_index
from quillspark.operators.validation import method_latency
from quillspark.plans.engine import SearchEngine, prompt
from quillspark.sources.files import read_corpus, read_settings, write_text_index


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("command", choices=["index", "search", "bench"])
    p.add_argument("config", nargs="?", default="config.ini")
    p.add_argument("query", nargs="*")
    p.add_argument("--ranking", default="tfidf")
    p.add_argument("--rebuild", action="store_true")
    args = p.parse_args(argv)
    settings = read_settings(args.config)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    stored = f"{settings.output_file}.tables"
    if args.command == "index" or args.rebuild or not os.path.isdir(stored):
        index = build_index(read_corpus(spark, settings.input_directory)).write(stored)
        write_text_index(index.postings, settings.output_file)
    else:
        index = read_index(spark, stored)
    engine = SearchEngine(index).with_ranking(args.ranking)
    if args.command == "bench":
        method_latency(engine, args.query or ["meeting AND schedule"]).show()
    elif args.command == "search":
        if args.query:
            engine.top(" ".join(args.query)).orderBy("rank").show(truncate=False)
        else:
            prompt(engine)


if __name__ == "__main__":
    main()
