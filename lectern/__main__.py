"""Command line: ``python -m lectern --folder DIR ingest|ask|eval|debug|watch ...``."""

from __future__ import annotations

import argparse
import os
import sys

from lectern.config import EngineConfig
from lectern.engine import Engine
from lectern.operators import evaluate
from lectern.session import local_session


LANDING = "./data/landing_zone"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--folder", default="./data/lectern", help="where the tables are")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("path", nargs="?", default=LANDING)
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--no-stream", action="store_true")
    sub.add_parser("eval").add_argument("--stream", action="store_true")
    debug = sub.add_parser("debug")
    debug.add_argument("question")
    debug.add_argument("--top-k", type=int, default=5)
    watch = sub.add_parser("watch")
    watch.add_argument("path", nargs="?", default=LANDING)
    watch.add_argument("--recursive", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(local_session(), args.folder, EngineConfig.from_variables(os.environ))
    if args.command == "ingest":
        print(f"{engine.ingest(args.path)} chunks")
    elif args.command == "ask":
        tokens = None if args.no_stream else lambda p: iter(engine.generator(p).split(" "))
        got = engine.ask_one(args.question, args.top_k, tokens, lambda t: print(t, end=" ", flush=True))
        print(got["answer"] if args.no_stream else "")
    elif args.command == "eval":
        results = engine.run_eval()
        if args.stream:  # answers are shown as they come, case after case
            results = results.cache()
            for row in results.orderBy("question_id").toLocalIterator():
                print(f"{row['question']}\n{row['answer']}\n")
        evaluate.case_report(results).show(100, False)
        evaluate.summary(results).show(1, False)
    elif args.command == "debug":
        hits, prompts = engine.debug(args.question, args.top_k)
        hits.select("rank", "score", "source", "page", "chunk_index", "preview").show(100, False)
        print(prompts.head()["prompt"])
    else:
        engine.watch(args.path, args.recursive).start().awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
