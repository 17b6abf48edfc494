"""Command line: ``build`` runs steps of the corpus build, ``ask`` answers questions over its tables.

    python -m corpusmith build --root /data/wiki --base-url https://wiki.example/wiki/ parse chunk embed bm25
    python -m corpusmith ask --root /data/wiki -q "who guards the harbour?" --tier fast
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from . import config
from .errors import SetupError
from .plans import answer, build
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmith", description="Corpus builds and questions over them.")
    top.add_argument("--master", help="Spark master; that of spark-submit where it is left out")
    kinds = top.add_subparsers(dest="command", required=True)
    steps = kinds.add_parser("build", help="run steps")
    steps.add_argument("steps", nargs="+", help=f"steps, or one of {', '.join(build.METAS)}")
    steps.add_argument("--base-url", required=True)
    steps.add_argument("--dry-run", action="store_true", help="only name the steps")
    steps.add_argument("--api", help="address of the wiki's API, for the steps that fetch")
    asks = kinds.add_parser("ask", help="answer questions")
    asks.add_argument("-q", "--question", action="append", required=True, help="may be given several times")
    asks.add_argument("--game", help="restrict the search to a facet")
    asks.add_argument("--k", type=int, help="hits that go into a prompt")
    asks.add_argument("--tier", choices=config.TIER_NAMES, help="override the routed depth")
    for each in (steps, asks):
        each.add_argument("--root", required=True, help="folder of the tables")
        each.add_argument("--config", help="JSON or YAML settings")
    return top


def settings(args: argparse.Namespace) -> dict:
    cfg = config.load_config(args.config)
    k = getattr(args, "k", None)
    return {**cfg, "top_k": k, "tiers": {t: {**e, "top_k": k} for t, e in cfg["tiers"].items()}} if k else cfg


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark, cfg = session("corpusmith", args.master), settings(args)
    client = None
    if getattr(args, "api", None):
        from .sources.api import Client, urllib_transport

        client = lambda url=args.api: Client(urllib_transport(url, "corpusmith"))
    pipe = build.Pipeline(spark, args.root, cfg, getattr(args, "base_url", ""), make_client=client)
    try:
        if args.command == "build":
            for step in args.steps:
                for name, result in pipe.run(step, args.dry_run):
                    print(json.dumps({"step": name, "result": result}))
        else:
            rows = [(i, q, args.game, args.tier) for i, q in enumerate(args.question)]
            asked = spark.createDataFrame(rows, "qid int, question string, game string, forced_tier string")
            for row in answer.answer_all(asked, pipe.store.read(), pipe.index(), cfg).orderBy("qid").collect():
                print(json.dumps({**row.asDict(), "question": args.question[row.qid], "sources": json.loads(row.sources)}, ensure_ascii=False))
    except SetupError as error:
        print(f"{type(error).__name__}: {error}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
