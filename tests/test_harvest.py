"""A run end to end, and again."""

from datetime import date, datetime

from pyspark.sql import functions as F

from gazette.__main__ import main
from gazette.operators.classify import rules_from_config
from gazette.plans.harvest import QUEUE, Run, harvest
from gazette.sources import store
from gazette.sources.items import Source, as_items

RULES = rules_from_config({"tier": [{"any": ["generally"], "value": 1}], "category": [{"any": ["lake"], "value": "lake"}], "tags": [{"any": ["lake"], "value": "lake"}]})


def items(spark, rows):
    df = spark.createDataFrame(rows, "link string, title string, summary string, day date")
    dated = F.struct(F.col("day").alias("date"), F.lit("day").alias("precision"), F.lit("exact").alias("confidence"))
    return as_items(df, Source("blog", "https://b.example", "rss"), link=F.col("link"), title=F.col("title"), summary=F.col("summary"), date=dated, tags=F.array().cast("array<string>"), method="feed-entry", selector=F.lit(None).cast("string"))


FIRST = [
    ("https://b.example/1", "Fast lake generally available", "one", date(2026, 7, 2)),
    ("https://b.example/2", "Slow lake preview of tables", "two", date(2026, 7, 1)),
    ("https://b.example/2#x", "Slow lake preview of tables", "two", date(2026, 7, 1)),
    ("https://b.example/9", "Fast lake generally available", "one", date(2026, 7, 3)),
    (None, "A thing without a link", "three", None),
]


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    run = Run("p", "TST", "run-1", datetime(2026, 8, 2, 6))
    report = harvest(spark, root, run, items(spark, FIRST), RULES)
    assert (report["minted"], report["queued"], report["verdict_known-content"], report["verdict_known-identity"]) == (2, 1, 1, 1)
    got = {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()}
    assert set(got) == {"TST-2026-07-001", "TST-2026-07-002"}
    fast = got["TST-2026-07-002"]
    assert (fast.tier, fast.category, fast.tags, fast.needs_review, fast.revisions[0].revision) == (1, "lake", ["lake"], False, 1)
    assert got["TST-2026-07-001"].needs_review and got["TST-2026-07-001"].tier == 3

    again = harvest(spark, root, run, items(spark, FIRST), RULES)
    assert (again["minted"], again["updated"], again["queued"]) == (0, 0, 1)
    assert {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()} == got

    queue = store.read_state(spark, f"{root}/queue/p", QUEUE).withColumns({"lifecycle": F.lit("approved"), "first_seen": F.lit("2026-05-09").cast("date")})
    store.write_state(spark.createDataFrame(queue.collect(), QUEUE), f"{root}/queue/p", "identity_key")
    second = [("https://b.example/1", "Fast lake generally available", "one, rewritten", date(2026, 7, 2)), FIRST[-1], ("https://b.example/4", "Fast lakes generally available: slow tables preview", "four", date(2026, 7, 9))]
    later = harvest(spark, root, Run("p", "TST", "run-2", datetime(2026, 8, 9, 6)), items(spark, second), RULES)
    assert (later["minted"], later["updated"], later["queued"]) == (2, 1, 0)
    now = {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()}
    assert set(now) - set(got) == {"TST-2026-05-001", "TST-2026-07-003"}  # approved late, in the month it was first seen
    changed = now["TST-2026-07-002"]
    assert [r.summary for r in changed.revisions] == ["First seen", "New summary"] and changed.revisions[1].changed_fields == ["content_hash"]
    assert changed.notes == got["TST-2026-07-002"].notes and len(spark.read.json(f"{root}/run-log").collect()) == 3

    assert main(["search", root, "--tag", "LAKE", "--tier", "1", "--no-stale"], spark) == 0
    assert main(["get", root, "TST-2026-07-002"], spark) == 0 and main(["get", root, "TST-2026-07-099"], spark) == 1
    assert main(["history", root, "TST-2026-07-002"], spark) == 0 and main(["validate", root], spark) == 0
    assert main(["review", root], spark) == 0 and main(["status", root], spark) == 0 and main(["nonsense"], spark) == 2


def test_rules_reach_stored_objects(spark, tmp_path):
    root = str(tmp_path)
    harvest(spark, root, Run("p", "TST", "run-1", datetime(2026, 8, 2, 6)), items(spark, FIRST), {"tier": rules_from_config({"tier": [{"any": ["generally"], "value": "soon"}]})["tier"]})
    before = {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()}
    assert all(r.needs_review and r.tier == 3 and r.category is None for r in before.values())  # a tier that is no number is no proposal

    locked = store.read_objects(spark, f"{root}/objects").filter("id = 'TST-2026-07-001'").withColumn("overrides", F.array(F.lit("category")))
    store.update_objects(spark.createDataFrame(locked.collect(), locked.schema), f"{root}/objects", by_user=True)
    report = harvest(spark, root, Run("p", "TST", "run-2", datetime(2026, 8, 9, 6)), items(spark, FIRST[:1]), RULES)
    after = {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()}
    assert (report["minted"], report["classified"], report["errors"]) == (0, 2, 0)
    assert (after["TST-2026-07-002"].tier, after["TST-2026-07-002"].category, after["TST-2026-07-002"].tags) == (1, "lake", ["lake"])
    assert (after["TST-2026-07-001"].category, after["TST-2026-07-001"].tags) == (None, ["lake"])

    other = rules_from_config({"tier": [{"any": ["generally"], "value": 2}], "category": [{"any": ["lake"], "value": "pond"}]})
    report = harvest(spark, root, Run("p", "TST", "run-3", datetime(2026, 8, 16, 6)), items(spark, FIRST[:1]), other)
    assert report["classified"] == 0 and {r.id: r for r in store.read_objects(spark, f"{root}/objects").collect()} == after


def test_an_unsound_item_loses_no_other(spark, tmp_path):
    root = str(tmp_path)
    rows = items(spark, [*FIRST[:2], ("https://b.example/3", "A year of five digits", "three", date(2026, 7, 3))])
    far = F.when(F.col("title").contains("digits"), F.expr("make_date(12026, 7, 3)")).otherwise(F.col("published_date"))
    report = harvest(spark, root, Run("p", "TST", "run-1", datetime(2026, 8, 2, 6)), rows.withColumn("published_date", far), RULES)
    assert (report["minted"], report["errors"]) == (2, 1)
    assert {r.id for r in store.read_objects(spark, f"{root}/objects").collect()} == {"TST-2026-07-001", "TST-2026-07-002"}
