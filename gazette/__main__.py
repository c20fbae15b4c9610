"""Command line over a store: python -m gazette COMMAND ROOT ...

Exit codes: 0 done, 1 findings or errors, 2 wrong use.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import coverage, crosspack, digest, history, retrieve, review, updates, validate
from .plans import integrity, weekly
from .plans.harvest import QUEUE, Run, harvest
from .plans.integrity import ACKNOWLEDGED
from .plans.shared import written
from .sources import documents, packs, store, templates
from .sources.discover import discover
from .sources.registry import Registry

COMMANDS = {
    "search": "objects by filters, ranked", "get": "one object in full", "history": "an object's revisions and their problems",
    "validate": "integrity findings", "review": "what waits for a person, and decisions on it", "status": "artifacts by kind and status",
    "discover": "items of landed sources", "harvest": "take landed sources into the store", "index": "write the index documents",
    "supersede": "one object replaces another", "generate": "contexts for artifacts of an object", "import": "take metadata documents into the store",
    "baseline": "accept the repeated changes that are there now",
}
KINDS = {"tier": int, "since": date.fromisoformat, "until": date.fromisoformat}
FLAGS = ("needs_review", "stale")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gazette")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        p.add_argument("root")
        if name in ("discover", "harvest"):
            p.add_argument("landed", help="folder of fetched sources: landed/SOURCE/*")
            p.add_argument("--packs", required=True, help="folder of collections: packs/PACK/pack.yml")
            p.add_argument("--pack", required=True)
            p.add_argument("--now", type=datetime.fromisoformat, required=True)
        if name == "supersede":
            p.add_argument("old")
            p.add_argument("new")
            p.add_argument("--today", type=date.fromisoformat, required=True)
        if name == "generate":
            p.add_argument("id")
            p.add_argument("--templates", required=True)
        if name == "import":
            p.add_argument("documents", help="folder of collections: documents/PACK/knowledge/yyyy/mm/NAME/metadata.yaml")
        if name == "index":
            p.add_argument("to")
        if name == "review":
            p.add_argument("--action", choices=("approve", "archive", "resolve"))
            p.add_argument("--key", help="beginning of a task's key, or * for all")
            p.add_argument("--today", type=date.fromisoformat)
        if name in ("get", "history"):
            p.add_argument("id")
        if name == "search":
            for f in fields(retrieve.Query):
                option = f"--{f.name.replace('_', '-')}"
                if f.name in FLAGS:
                    p.add_argument(option, action=argparse.BooleanOptionalAction, default=None)
                else:
                    p.add_argument(option, type=KINDS.get(f.name, str))
            p.add_argument("--limit", type=int)
        if name == "validate":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--packs", help="folder of collections: packs/PACK/pack.yml")
            p.add_argument("--documents", help="folder of collections: documents/PACK/knowledge/yyyy/mm/NAME; needs --packs")
            p.add_argument("--pack", action="append", help="a collection that must be there")
        if name == "baseline":
            p.add_argument("--today", type=date.fromisoformat, required=True)
    return top


def show(df, empty: str) -> int:
    """Rows as tab-separated lines; how many there were."""
    n = 0
    for n, r in enumerate(df.toLocalIterator(), 1):
        print("\t".join("" if x is None else str(x) for x in r))
    if not n:
        print(empty)
    return n


def _review(spark: SparkSession, args, objects) -> int:
    """Show what waits, or decide it: queued items, flagged objects and groups across collections."""
    packs = [r.pack for r in objects.select("pack").distinct().collect()]
    queues = {p: store.read_state(spark, f"{args.root}/queue/{p}", QUEUE) for p in packs}
    known = store.read_state(spark, f"{args.root}/acknowledged", ACKNOWLEDGED, "empty")
    groups = crosspack.outstanding(crosspack.duplicate_groups(objects), known)
    found = review.tasks([review.flagged(objects), review.shared(groups), *map(review.queued, queues.values())])
    if args.action is None:
        show(review.ordered(found).select("short_key", "kind", "title", "reason"), "nothing waits")
        return 0
    key = args.key or ""
    if key != "*":
        match = review.lookup(found, spark.createDataFrame([(key,)], "prefix string")).first()
        if match.key is None:
            print(f"{match.matches} tasks begin with {key!r}")
            return 1
        key = match.key
    chosen = written(review.dispatch(found, spark.createDataFrame([(key, args.action)], "short_key string, action string")), "decisions")
    for p, queue in queues.items():
        moved, _, _ = review.applied(chosen, queue, objects)
        store.write_state(written(moved.select(*queue.columns), "queue"), f"{args.root}/queue/{p}", "identity_key")
    _, seen, resolved = review.applied(chosen, next(iter(queues.values())), objects) if queues else (None, objects, chosen.select("key").limit(0))
    resolved = written(crosspack.acknowledge(groups, known, resolved, F.lit(args.today)), "acknowledged")
    store.write_state(resolved, f"{args.root}/acknowledged", "ids")
    store.update_objects(seen.select(*objects.columns).drop("id_year", "id_month"), f"{args.root}/objects")
    return int(show(chosen.filter("refused").select("short_key", "kind", "action"), f"{chosen.count()} decided") > 0)


def _harvest(spark: SparkSession, args) -> int:
    """Items of a collection's landed sources; for harvest, into the store."""
    configs, sources, rules = packs.read_packs(spark, args.packs)
    mine = configs.filter(F.col("pack") == args.pack).first()
    if mine is None or mine.error is not None:
        show(validate.pack_exists(configs, [args.pack]) if mine is None else validate.unloadable(configs.filter(F.col("pack") == args.pack)), "")
        return 1
    found = discover(spark, sources[args.pack], lambda source: f"{args.landed}/{source.name}")
    show(found.attempts, "no sources")
    if found.items is None:
        return 1
    if args.command == "discover":
        show(found.items.select("source_name", "published_date", "title"), "nothing found")
        return 0
    run = Run(args.pack, mine.id_prefix, f"run-{args.now:%Y-%m-%dT%H-%M-%SZ}", args.now, mine.near_duplicate_threshold)
    for name, n in harvest(spark, args.root, run, found.items, rules[args.pack], found.attempts).items():
        print(f"{name}\t{n}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    objects = store.read_objects(spark, f"{args.root}/objects")
    if args.command == "search":
        query = retrieve.Query(**{f.name: getattr(args, f.name) for f in fields(retrieve.Query)})
        show(retrieve.search(objects, query, args.limit).select("id", "tier", retrieve.effective_date(), "title"), "nothing found")
    elif args.command == "get":
        return int(show(objects.filter(F.col("id") == args.id).select(F.to_json(F.struct("*"))), f"no object {args.id}") == 0)
    elif args.command == "history":
        one = objects.filter(F.col("id") == args.id)
        rows = history.exploded(one)
        if not show(history.timeline(rows).select("revision", "date", "summary", F.array_join("changed_fields", ",")), f"no object {args.id}"):
            return 1
        return int(show(history.chain_problems(rows, one.select("id", "content_hash")).select("problem", "revision"), "the chain is sound") > 0)
    elif args.command == "validate":
        found = written(integrity.findings(spark, args.root, args.packs, args.documents, args.pack), "findings")
        show(found.orderBy("level", "code", "location"), "no findings")
        return int(validate.fails_build(found, args.strict))
    elif args.command == "baseline":
        print(f"{integrity.accept(objects, args.root, F.lit(args.today))} accepted")
    elif args.command == "review":
        return _review(spark, args, objects)
    elif args.command in ("discover", "harvest"):
        return _harvest(spark, args)
    elif args.command == "index":
        rows = coverage.artifact_rows(objects, retrieve.current_revision(F.col("revisions"))).join(objects.select("id", "pack"), "id")
        packs_here = [r.pack for r in objects.select("pack").distinct().collect()]
        queues = {p: store.read_state(spark, f"{args.root}/queue/{p}", QUEUE) for p in packs_here}
        known = store.read_state(spark, f"{args.root}/acknowledged", ACKNOWLEDGED, "empty")
        tasks = weekly.tasks_of(objects, crosspack.outstanding(crosspack.duplicate_groups(objects), known), queues) if queues else None
        store.write_documents(digest.index_lines(objects, tasks, rows), args.to, ("pack", "document"), ("group", "place"))
    elif args.command == "supersede":
        pair = spark.createDataFrame([(args.old, args.new)], "old_id string, new_id string")
        after = updates.supersede(objects, pair, F.lit(args.today))
        if not store.update_objects(after.drop("id_year", "id_month"), f"{args.root}/objects", by_user=True):
            print("nothing to replace: the two must be different objects that are there, and the old one not replaced yet")
            return 1
    elif args.command == "generate":
        link = F.coalesce("announcement_url", "source_url", F.lit("unknown"))
        known = digest.facts({"Tier": F.col("tier"), "Published": F.col("published_date"), "Category": F.col("category")})
        body = F.element_at("revisions", -1)["summary_snapshot"]
        context = digest.context_pack("Work from the data below alone.", F.col("title"), known, body, F.array_join("related_topics", ", "), link)
        made = templates.contexts(objects.filter(F.col("id") == args.id), templates.read_templates(spark, args.templates), context)
        return int(made is None or show(made.select("output", "text"), f"no object {args.id}") == 0)
    elif args.command == "import":
        scanned = documents.scan(spark, args.documents)
        show(validate.finding(scanned.filter("error is not null"), validate.ERROR, "OBJ004", F.col("path"), F.col("error")).select("code", "location", "message"), "all documents can be read")
        found = written(documents.objects(scanned), "imported")
        Registry(spark, args.root).record(found, "import")
        store.insert_objects(found, f"{args.root}/objects")
    else:
        show(coverage.by_type(coverage.artifact_rows(objects, retrieve.current_revision(F.col("revisions")))), "no artifacts")
    return 0


if __name__ == "__main__":
    sys.exit(main())
