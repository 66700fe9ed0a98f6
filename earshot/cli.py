"""Command line: transcribe and index a queue, ask, search and find in a chunk store, check a dataset, reset statuses.

Models are named as ``module:function``, and called as the plans say.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import replace
from importlib import import_module

from .config import Settings


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="earshot", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    find = sub.add_parser("search", help="the nearest results to one chunk's vector")
    find.add_argument("store")
    find.add_argument("chunk", type=int)
    find.add_argument("--top-k", type=int, default=Settings().top_k)
    seek = sub.add_parser("find", help="the passages of a chunk store nearest to a question")
    seek.add_argument("question")
    seek.add_argument("store")
    seek.add_argument("episodes", help="episode_id, podcast_id (Parquet)")
    seek.add_argument("--podcast-id", type=int)
    seek.add_argument("--top-k", type=int, default=Settings().top_k)
    check = sub.add_parser("check-dataset", help="rules of an evaluation dataset; exit code 1 if they are broken")
    check.add_argument("path")
    reset = sub.add_parser("reset", help="statuses of a work list (Parquet) after a reset")
    reset.add_argument("kind", choices=("stale", "failed", "done"))
    reset.add_argument("path")
    reset.add_argument("out")
    work = argparse.ArgumentParser(add_help=False)
    work.add_argument("source", help="work list (Parquet)")
    work.add_argument("out")
    work.add_argument("checkpoint")
    work.add_argument("--once", action="store_true", help="end when all there is has been done")
    work.add_argument("--poll-interval", type=float, default=Settings().poll_seconds, help="seconds")
    heard = sub.add_parser("transcribe", parents=[work], help="downloaded episodes into transcripts")
    heard.add_argument("--model", required=True)
    index = sub.add_parser("index", parents=[work], help="transcribed episodes into a chunk store")
    index.add_argument("--strategy", default="size_based")
    index.add_argument("--episode-id", type=int, help="this one alone, at once")
    index.add_argument("--retry-failed", action="store_true", help="failed ones too, at once")
    index.add_argument("--reindex", action="store_true", help="those done too, at once")
    ask = sub.add_parser("ask", help="a cited answer from a chunk store")
    ask.add_argument("question")
    ask.add_argument("store")
    ask.add_argument("episodes", help="episode_id, podcast_name, language, transcript_data (Parquet)")
    ask.add_argument("--chat", required=True)
    ask.add_argument("--episode-id", type=int)
    ask.add_argument("--podcast", help="name")
    ask.add_argument("--podcast-id", type=int)
    ask.add_argument("--top-k", type=int, default=Settings().top_k)
    for command in (index, ask, seek):
        command.add_argument("--embed", required=True)
        command.add_argument("--dim", type=int, required=True)
    return out


def named(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def check_dataset(path: str) -> int:
    from .operators.gates import ContractError
    from .sources.evaluation import load_dataset

    try:
        cases, mark = load_dataset(path)
    except ContractError as e:
        print(e, file=sys.stderr)
        return 1
    arms, tags = Counter(c.expected_arm for c in cases), Counter(t for c in cases for t in c.tags)
    print(f"{len(cases)} cases, {sum(c.critical for c in cases)} critical, fingerprint {mark}")
    for name, counted in (("arm", arms), ("tag", tags)):
        for value, n in sorted(counted.items()):
            print(f"{name} {value}: {n}")
    return 0


def search(spark, args) -> int:
    from .operators.retrieval import top_k

    chunks = spark.read.parquet(args.store)
    asked = chunks.where(chunks.chunk_id == args.chunk).first()
    if asked is None:
        print(f"no chunk {args.chunk}", file=sys.stderr)
        return 1
    top_k(chunks, asked["embedding"], args.top_k).show(args.top_k, truncate=80)
    return 0


def reset_statuses(spark, args) -> int:
    from .streaming.queue import reset

    rows, changed = reset(spark.read.option("recursiveFileLookup", "true").parquet(args.path), args.kind)
    rows.write.parquet(args.out)
    print(f"{changed} changed")
    return 0


def transcribe(spark, args) -> int:
    from .plans.transcription import transcribe_queue

    transcribe_queue(spark, args.source, named(args.model), args.out, args.checkpoint, args.once, args.poll_interval).awaitTermination()
    return 0


def index(spark, args) -> int:
    from .operators.chunking import create_chunker
    from .plans.indexing import EPISODE, index_queue, index_ready
    from .streaming.queue import reset

    settings, embed, chunker = replace(Settings(), poll_seconds=args.poll_interval), named(args.embed), create_chunker(args.strategy)
    if args.episode_id is None and not (args.retry_failed or args.reindex):
        index_queue(spark, args.source, embed, args.dim, args.out, args.checkpoint, settings, args.once, chunker=chunker).awaitTermination()
        return 0
    rows = spark.read.schema(EPISODE).option("recursiveFileLookup", "true").parquet(args.source)
    for kind, asked in (("failed", args.retry_failed), ("done", args.reindex)):
        rows = reset(rows, kind)[0] if asked else rows
    if args.episode_id is not None:
        rows = rows.where(rows.episode_id == args.episode_id)
    index_ready(rows, embed, args.dim, args.out, f"run-{uuid.uuid4().hex}", settings, chunker=chunker)
    return 0


def ask(spark, args) -> int:
    from .plans.qa import answer, episode_contexts
    from .sources.feeds import parse_transcripts
    from .sources.storage import library

    episodes = parse_transcripts(spark.read.option("recursiveFileLookup", "true").parquet(args.episodes))
    chunks, parents = library(spark, args.store, episodes)
    contexts = episode_contexts(episodes.where(episodes.episode_id == args.episode_id) if args.episode_id is not None else episodes.limit(0))
    question = spark.createDataFrame(
        [(0, args.question, args.episode_id, args.podcast_id, args.podcast, None)],
        "query_id long, question string, episode_id long, podcast_id long, podcast_name string, history array<struct<role:string,content:string>>")
    settings = replace(Settings(), top_k=args.top_k)
    said = answer(question, contexts, chunks, parents, named(args.embed), args.dim, named(args.chat), settings).first()
    print(said["answer"])
    for s in said["sources"]:
        print(f"[{s['n']}] episode {s['episode_id']}, {s['start']:.1f} s: {s['text']}")
    return 0


def find(spark, args) -> int:
    from pyspark.sql import functions as F

    from .operators.retrieval import search as results
    from .plans.qa import embed_queries
    from .sources.storage import library

    episodes = spark.read.option("recursiveFileLookup", "true").parquet(args.episodes)
    chunks, parents = library(spark, args.store, episodes)
    asked = spark.createDataFrame([(0, args.question, args.podcast_id)], "query_id long, question string, podcast_id long")
    found = results(embed_queries(asked, named(args.embed), args.dim), chunks, replace(Settings(), top_k=args.top_k), parents)
    leaf = chunks.select(F.lit("leaf").alias("level"), F.col("chunk_id").alias("id"), "text", "start", "episode_id")
    group = parents.select(F.lit("parent").alias("level"), F.col("parent_id").alias("id"), "text", "start", "episode_id")
    for r in found.join(leaf.unionByName(group), ["level", "id"]).orderBy("rank").collect():  # top_k rows
        print(f"{r['rank']}. {r['score']:.4f} episode {r['episode_id']}, {r['start']:.1f} s: {r['text']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "check-dataset":
        return check_dataset(args.path)
    from pyspark.sql import SparkSession

    commands = {"search": search, "reset": reset_statuses, "transcribe": transcribe, "index": index, "ask": ask, "find": find}
    return commands[args.command](SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
