"""The jobs from a command line: ``python -m quern <job> ...``.

A store is a folder of generations (``--store``, made by the store job); jobs that change it add to it. Or
it is two Parquet folders (``--items``, ``--chunks``), and such jobs write new ones to ``--out``.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunks import embed_hashed, embed_known, embed_with
from quern.operators.nearest import CellIndex, build_cells
from quern.plans import audit, commit, prompts, retrieve, schema_grounding, sync
from quern.sinks.files import write_json, write_prompts
from quern.sources import changes
from quern.sources.catalog import session_tables
from quern.sources.csv_items import ragged_entries, read_ragged
from quern.sources.store import load, save_chunks, save_items
from quern.streaming.feed_stream import run_feed


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, about: str, store: bool = True, out: bool = False) -> argparse.ArgumentParser:
        made = jobs.add_parser(name, help=about)
        if store:
            made.add_argument("--store", help="folder of generations")
            made.add_argument("--items")
            made.add_argument("--chunks")
            made.add_argument("--model", help="module:function that loads a model for texts; hashed vectors by default")
            made.add_argument("--vectors", help="folder that keeps vectors by text, so that a model sees a text once")
        if out:
            made.add_argument("--out", help="folder of the new store")
        return made

    job("store", "make a folder of generations from items and chunks, or from the present rows of one", out=True)
    schema = job("schema", "replace the schema items by the present tables", out=True)
    about = "a Parquet table; the session's tables when none is given"
    schema.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help=about)
    schema.add_argument("--key", action="append", default=[], metavar="TABLE(COLUMNS)", help="a primary key to verify")
    made = job("sync", "plan or apply the difference between CSV files and the store", out=True)
    made.add_argument("--dataset", default="ragdb")
    made.add_argument("--desired", default="info,example", help="kinds; reads <dir>/<kind>_items.csv")
    made.add_argument("--dir", default=".")
    made.add_argument("--has-header", action="store_true")
    made.add_argument("--dedupe", action="store_true")
    single = "no cell holds a line feed, so files need one reading only"
    made.add_argument("--single-line", action="store_true", help=single)
    made.add_argument("--apply", action="store_true")
    made.add_argument("--export-current")
    made.add_argument("--audit-json")
    made = job("commit", "add entries of a ragged CSV file", out=True)
    made.add_argument("--file", required=True)
    made.add_argument("--single-line", action="store_true", help=single)
    made.add_argument("--rejects", help="folder of the refused records; rejects in --out by default")
    made = job("retrieve", "ranked chunks and prompts for a table of questions")
    made.add_argument("--questions", required=True, help="Parquet with query_id and question")
    made.add_argument("--dataset")
    made.add_argument("--kinds", default=",".join(retrieve.KINDS))
    made.add_argument("--candidates", type=int, default=retrieve.CANDIDATES)
    made.add_argument("--topk", type=int, default=retrieve.TOPK)
    made.add_argument("--per-item-cap", type=int, default=retrieve.PER_ITEM_CAP)
    made.add_argument("--mmr", type=float, default=0.5)
    made.add_argument("--min-sim", type=float)
    made.add_argument("--metric", default="l2", choices=["l2", "cosine"])
    made.add_argument("--index", help="cells made by the index job")
    made.add_argument("--ivf-probes", type=int, help="cells to probe")
    made.add_argument("--sign-tables", type=int, help="tables of signatures to compare, instead of cells")
    made.add_argument("--save-prompt")
    made.add_argument("--save-json")
    made = job("index", "cut the chunks into cells for approximate search", out=True)
    made.add_argument("--cells", type=int, required=True)
    made = job("audit", "write the store's audit files")
    made.add_argument("--outdir", required=True)
    made = job("feed", "ingest new files of a landing folder", store=False, out=True)
    made.add_argument("--landing", required=True)
    made.add_argument("--schema", required=True, help="columns as DDL")
    made.add_argument("--keys", required=True)
    made.add_argument("--seq", required=True, help="columns that order the records of a key")
    made.add_argument("--format", default="json")
    return parser


def _embedder(model: str | None, vectors: str | None = None):
    if not model:
        return embed_hashed
    module, name = model.split(":")

    def load_model():
        return getattr(importlib.import_module(module), name)()

    if vectors:
        return lambda df, text="chunk_text": embed_known(df, lambda new: embed_with(new, load_model), vectors, model, text)
    return lambda df, text="chunk_text": embed_with(df, load_model, text)


def _now():
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def _save(store: tuple[DataFrame, DataFrame], out: str) -> None:
    save_items(store[0], f"{out}/items")
    save_chunks(store[1], f"{out}/chunks")


def _names(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def _schema(spark, args, items, chunks) -> None:
    tables = {("main", name): spark.read.parquet(path) for name, path in (t.split("=", 1) for t in args.table)}
    keys = []
    for key in args.key:
        table, columns = key.rstrip(")").split("(")
        keys.append(schema_grounding.Key("main", table, tuple(_names(columns))))
    tables = tables or session_tables(spark)
    embed = _embedder(args.model, args.vectors)
    if args.store:
        schema_grounding.refresh_in_store(spark, args.store, tables, keys, embed, _now())
        return
    store = schema_grounding.refresh_schema(spark, tables, keys, items, chunks, embed, _now())
    _save(store, args.out)


def _sync(spark, args, items, chunks) -> None:
    paths = {kind: f"{args.dir}/{kind}_items.csv" for kind in _names(args.desired)}
    plan, store = sync.run_sync(
        spark, paths, items, chunks, args.dataset, _embedder(args.model, args.vectors), _now(),
        has_header=args.has_header, dedupe=args.dedupe, apply=args.apply,
        export_path=args.export_current, audit_path=args.audit_json, model=args.model or "hashed",
        multiline=not args.single_line, store=args.store,
    )
    sync.sync_counts(plan).orderBy("kind").show()
    if store and not args.store:
        _save(store, args.out)


def _commit(spark, args, items, chunks) -> None:
    entries, rejects = ragged_entries(read_ragged(spark, args.file, multiline=not args.single_line))
    if args.store:
        commit.commit_to_store(spark, args.store, entries, _embedder(args.model, args.vectors), _now())
    else:
        _save(commit.commit_entries(entries, items, chunks, _embedder(args.model, args.vectors), _now()), args.out)
    write_json(rejects.select("cells", "reason"), args.rejects or f"{args.out}/rejects")


def _store(spark, args, items, chunks) -> None:
    changes.create(items, chunks, args.out)


def _retrieve(spark, args, items, chunks) -> None:
    knobs = retrieve.Knobs(
        kinds=_names(args.kinds), dataset=args.dataset, candidates=args.candidates, topk=args.topk,
        per_item_cap=args.per_item_cap, lam=args.mmr, min_sim=args.min_sim, metric=args.metric,
        probes=args.ivf_probes, sign_tables=args.sign_tables,
    )
    questions = _embedder(args.model, args.vectors)(spark.read.parquet(args.questions), "question")
    index = CellIndex.load(spark, args.index) if args.index else None
    ranked = retrieve.retrieve(questions, items, chunks, knobs, index)
    if args.save_json:
        write_json(retrieve.final_json(ranked), args.save_json, ["query_id", "rank"])
    if args.save_prompt:
        write_prompts(prompts.context_prompt(ranked), args.save_prompt)
    if not (args.save_json or args.save_prompt):
        shown = ranked.orderBy("query_id", "rank").select("query_id", "rank", "sim", "dist", "kind", "name", "chunk_ix")
        for row in shown.toLocalIterator():
            print(*row, sep="\t")


def _index(spark, args, items, chunks) -> None:
    build_cells(chunks, args.cells).save(args.out)


def main(argv: Sequence[str] | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    stored = args.job != "feed" and args.store
    if args.job != "feed" and not stored and not (args.items and args.chunks):
        parser.error("--store or --items and --chunks are needed")
    in_place = stored and args.job in ("schema", "sync", "commit")
    if "out" in args and not args.out and not in_place and not (args.job == "sync" and not args.apply):
        parser.error("--out is needed")
    if args.job == "commit" and not (args.out or args.rejects):
        parser.error("--rejects is needed")
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if args.job == "feed":
        keep = lambda records: records
        run_feed(spark, args.landing, args.schema, args.out, keep, _names(args.keys), _names(args.seq), _now(), args.format)
        return
    items, chunks = changes.read(spark, stored) if stored else (load(spark, args.items), load(spark, args.chunks))
    if args.job == "audit":
        audit.write_audit(items, chunks, args.outdir, _now())
        return
    {"schema": _schema, "sync": _sync, "commit": _commit, "store": _store, "retrieve": _retrieve, "index": _index}[args.job](spark, args, items, chunks)


if __name__ == "__main__":
    main()
