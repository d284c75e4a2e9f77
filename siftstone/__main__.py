"""python -m siftstone ingest | ask | evaluate | prepare | serve | fetch-repository | fetch-model ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftstone import service
from siftstone.config import EngineConfig
from siftstone.engine import Engine
from siftstone.functions import text as T
from siftstone.operators import evaluate, prepare
from siftstone.sources import fetch
from siftstone.sources.files import load_directory, read_golden_set


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftstone")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    for name, kind in (("--data-dir", str), ("--index-dir", str), ("--chunk-size", int), ("--chunk-overlap", int)):
        ingest.add_argument(name, type=kind)
    ingest.add_argument("--dry-run", action="store_true")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int)
    score = commands.add_parser("evaluate")
    score.add_argument("questions")
    score.add_argument("-k", type=int)
    score.add_argument("--data-dir")
    score.add_argument("--save")
    score.add_argument("--config", choices=[s.name for s in evaluate.setups()], help="one set-up")
    for flag in ("--compare", "--ablate", "--sweep", "--validate"):
        score.add_argument(flag, action="store_true")
    prep = commands.add_parser("prepare")
    for name in ("repo", "out"):
        prep.add_argument(name)
    prep.add_argument("--clean", action="store_true", help="replace what is at the output")
    serve = commands.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--origins", default="*", help="origins that may call, joined by commas")
    repository = commands.add_parser("fetch-repository")
    for name in ("url", "folder"):
        repository.add_argument(name)
    repository.add_argument("parts", nargs="*", help="directories, all if none is named")
    model = commands.add_parser("fetch-model")
    model.add_argument("name", choices=sorted(fetch.MODELS))
    model.add_argument("--folder", default="models")
    args = parser.parse_args(argv)
    if args.command == "fetch-repository":
        print(args.folder, "" if fetch.fetch_repository(args.url, args.folder, tuple(args.parts)) else "(was there)")
        return 0
    if args.command == "fetch-model":
        print(fetch.fetch_model(args.name, args.folder))
        return 0
    spark = SparkSession.builder.appName("siftstone").getOrCreate()
    config = EngineConfig.from_env()
    if args.command == "ingest":
        given = {k: v for k in ("data_dir", "index_dir", "chunk_size", "chunk_overlap") if (v := getattr(args, k)) is not None}
        Engine(spark, replace(config, **given)).ingest(dry_run=args.dry_run).show()
    elif args.command == "ask":
        Engine(spark, config).ask(spark.createDataFrame([(0, args.question)], "qid bigint, question string"), args.top_k).show(truncate=False, vertical=True)
    elif args.command == "evaluate":
        questions, engine = read_golden_set(spark, args.questions), Engine(spark, config)
        if args.validate:
            found = engine.validate(questions)
            found.show(truncate=False)
            return int(not found.isEmpty())
        config.check_key(config.embed_provider)
        k = args.k or config.top_k
        if args.ablate:
            results = engine.ablate(questions, k)
        elif args.sweep or args.compare or args.config:
            sections, _ = load_directory(spark, args.data_dir or config.data_dir)
            chosen = [s for s in evaluate.setups(config.chunk_size, config.chunk_overlap, config.mmr_lambda) if args.config in (None, s.name)]
            results = engine.sweep(sections, questions, k) if args.sweep else engine.compare(sections, questions, chosen, k)
        else:
            results = engine.evaluate(questions, k).select(F.lit(0).alias("seq"), F.lit("configured").alias("config"), F.lit(engine.index.size).alias("chunks"), "*")
        print(evaluate.printed(results, k))
        if args.save:
            results.write.json(args.save)
    elif args.command == "serve":
        service.server(service.Service(spark, config, tuple(args.origins.split(","))), args.host, args.port).serve_forever()
    else:
        files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(args.repo).select(T.relative_path(F.col("_metadata.file_path"), args.repo).alias("path"), F.col("value").alias("text"))
        pages = files.where(F.endswith("path", F.lit(".md"))).withColumnRenamed("path", "rel_path")
        made = prepare.prepare(pages, files, config.min_page_chars)
        made.where("kept").write.mode("overwrite" if args.clean else "errorifexists").parquet(args.out)
        prepare.totals(made).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
