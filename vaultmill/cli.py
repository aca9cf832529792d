"""Command line: init, ingest, query, neighbors.

python -m vaultmill.cli query "balancing feedback" --store vault.store --expand --json
"""

from __future__ import annotations

import argparse
import logging
import sys
from functools import partial

from pyspark.sql import SparkSession

from vaultmill.errors import VaultError
from vaultmill.operators.embed import HashingEmbedder, named
from vaultmill.plans import render
from vaultmill.plans.ingest import ingest
from vaultmill.plans.query import Engine
from vaultmill.plans.store import Store

NOISY = ("py4j", "pyspark")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vaultmill", description="Hybrid retrieval over linked Markdown notes.")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--store", required=True)
    common.add_argument("-v", "--verbose", action="store_true")
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("--embedder", metavar="MODULE:FACTORY", help="what makes the embedder; hashed words without it")
    sub.add_parser("init", parents=[common], help="make an empty store")
    i = sub.add_parser("ingest", parents=[common, model], help="take in a folder")
    i.add_argument("folder")
    i.add_argument("--strict", action="store_true", help="write nothing if a document is bad")
    q = sub.add_parser("query", parents=[common, model], help="rank documents")
    q.add_argument("text")
    q.add_argument("--lexical-top-k", type=int, default=20)
    q.add_argument("--semantic-top-k", type=int, default=20)
    q.add_argument("--top-k", type=int, default=10)
    q.add_argument("--expand", action="store_true")
    q.add_argument("--depth", type=int, choices=(1, 2, 3), default=1)
    q.add_argument("--expand-top-k", type=int, default=20)
    q.add_argument("--json", action="store_true")
    n = sub.add_parser("neighbors", parents=[common], help="outbound edges of a document")
    n.add_argument("doc_id")
    n.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedder_class=HashingEmbedder) -> int:
    a = arguments().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr, format="%(levelname)s %(name)s: %(message)s")
    for name in NOISY:
        logging.getLogger(name).setLevel(logging.WARNING)
    spark = spark or SparkSession.builder.appName("vaultmill").getOrCreate()
    make = partial(named, a.embedder) if getattr(a, "embedder", None) else embedder_class
    try:
        if a.command == "init":
            Store.create(spark, a.store)
            print(f"store ready at {a.store}")
            return 0
        store = Store.open(spark, a.store)
        if a.command == "ingest":
            s = ingest(spark, a.folder, store, make, strict=a.strict)
            print(f"total={s.total} ingested={s.ingested} skipped={s.skipped} failed={s.failed}")
            return int(s.failed > 0)
        engine = Engine(spark, store, make())
        if a.command == "query":
            rows = engine.query(a.text, lexical_top_k=a.lexical_top_k, semantic_top_k=a.semantic_top_k, final_top_k=a.top_k, expand=a.expand, expand_depth=a.depth, expand_top_k=a.expand_top_k)
            print(render.as_json(rows) if a.json else render.results_text(rows))
        else:
            rows = engine.neighbors(a.doc_id)
            print(render.as_json(rows) if a.json else render.neighbors_text(rows))
        return 0
    except VaultError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
