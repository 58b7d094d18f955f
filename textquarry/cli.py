"""Command line: ``python -m textquarry index|search|search_dataset|answer|answer_dataset|evaluate|serve``."""

from __future__ import annotations

import argparse
import sys

from .operators.models import make_encoder, make_generator
from .plans.engine import Engine, Source


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("textquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry", description="Index, search and evaluate a tree of text and source files.")
    p.add_argument("--index_dir", default="data/index")
    p.add_argument("--encoder", default="hash", help="hash[:DIM], or sentence:MODEL:DIM; the same for index and search")
    p.add_argument("--generator", default="extract", help="extract, or chat:MODEL")
    p.add_argument("--max_new_tokens", type=int, default=300, help="greatest length of a generated answer")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options):
        c = sub.add_parser(name)
        for option, kind in options.items():
            if option == "query":
                c.add_argument("query")
            elif kind is bool:
                c.add_argument(f"--{option}", action="store_true")
            elif isinstance(kind, tuple):
                c.add_argument(f"--{option}", *(["-k"] if option == "k" else []), type=kind[0], default=kind[1])
            else:
                c.add_argument(f"--{option}", type=kind, required=True)

    command("index", root=(str, "data/raw"), max_chunk_size=(int, 2000), build_embeddings=bool, incremental=bool)
    command("search", query=str, k=(int, 10), use_semantic=bool)
    command("search_dataset", dataset_path=str, k=(int, 10), save_directory=str, use_semantic=bool)
    command("answer", query=str, k=(int, 10))
    command("answer_dataset", student_search_results_path=str, save_directory=str)
    command("evaluate", student_search_results_path=str, dataset_path=str)
    command("serve", host=(str, "127.0.0.1"), port=(int, 8000))
    return p


def line(s: Source) -> str:
    return f"{s.file_path} [{s.first_character_index}:{s.last_character_index}]"


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    try:
        encoder, generator = make_encoder(a.encoder), make_generator(a.generator, a.max_new_tokens)
    except ValueError as e:
        print(f"Error: {e}", file=out)
        return 1
    engine = Engine(spark or session(), a.index_dir, encoder, generator)
    try:
        if a.command == "index":
            made = engine.index(a.root, a.max_chunk_size, a.build_embeddings, a.incremental)
            print(f"Indexed {made['chunks']} chunks, {made['terms']} unique terms, {made['reprocessed']} files processed.", file=out)
        elif a.command == "search":
            found = engine.search(a.query, a.k, a.use_semantic)
            print("\n".join(map(line, found)) or "No results.", file=out)
        elif a.command == "search_dataset":
            print(engine.search_dataset(a.dataset_path, a.k, a.save_directory, a.use_semantic), file=out)
        elif a.command == "answer":
            text, sources = engine.answer(a.query, a.k)
            print("\n".join([text, *map(line, sources)]), file=out)
        elif a.command == "answer_dataset":
            print(engine.answer_dataset(a.student_search_results_path, a.save_directory), file=out)
        elif a.command == "evaluate":
            recalls = engine.evaluate(a.student_search_results_path, a.dataset_path)
            print("  ".join(f"Recall@{k}: {v:.3f}" for k, v in sorted(recalls.items())), file=out)
            if not any(recalls.values()):
                print("Warning: every recall is 0. Do the results and the data set belong together?", file=out)
        else:
            from .server import serve

            serve(engine, a.host, a.port)
    except FileNotFoundError as e:
        print(f"Not found: {e}. Run the index command first, or check the path.", file=out)
        return 1
    except ValueError as e:
        print(f"Error: {e}", file=out)
        return 1
    return 0
