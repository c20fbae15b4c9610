"""Seen keys and identifiers over streams: failures, replays, hot keys, one month for all."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gazette.operators import minting
from gazette.sources.snapshots import Conflict, Table
from gazette.streaming.events import incremental
from gazette.streaming.minting import COUNTERS, Minter
from gazette.streaming.seen import SeenIndex

KEYS = "key string, owner string"


def stream_of(spark, path, df, name):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_claims_are_for_good(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"), buckets=8)
    first = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], KEYS)
    answers = lambda df: sorted((r.key or "", r.owner, r.holder, r.claimed) for r in df.collect())
    want = [("", "4", None, False), ("a", "1", "1", True), ("a", "2", "1", False), ("b", "3", "3", True)]
    assert answers(index.claim(first, 0)) == want and answers(index.claim(first, 0)) == want
    assert answers(index.claim(first, 1)) == [(k, o, h, False) for k, o, h, _ in want]
    hot = spark.createDataFrame([("h", f"{k:04d}") for k in range(3000)] + [("b", "x")], KEYS)
    got = index.claim(hot, 2)
    assert got.filter("claimed").collect()[0].owner == "0000" and got.filter("holder = '0000'").count() == 3000 and got.count() == 3001
    assert answers(index.claim(spark.createDataFrame([], KEYS), 3)) == []
    assert sorted(map(tuple, index.owners(spark.createDataFrame([("a", ""), ("zz", "")], KEYS)).collect())) == [("a", "1")]


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"), buckets=16)
    index.claim(spark.createDataFrame([(f"k{n}", "o") for n in range(200)], KEYS), 0)
    one = spark.createDataFrame([("k7", "later")], KEYS)
    got = index.claim(one, 1)
    mine = one.select(index.bucket("key")).first()[0]
    files = [f for f in got.inputFiles() if "/data/" in f]
    assert files and all(f"bucket={mine}/" in f for f in files) and got.first().holder == "o"


@pytest.mark.parametrize("dies", ["before the commit", "after the commit"])
def test_a_batch_that_fails_claims_once(spark, tmp_path, monkeypatch, dies):
    index, out, fails = SeenIndex(spark, str(tmp_path / "seen"), buckets=4), {}, [True]

    def then(decided, number):
        if dies == "after the commit" and number == 1 and fails.pop() if fails else False:
            raise RuntimeError("then dies")
        out[number] = sorted((r.key, r.owner, r.claimed) for r in decided.collect())

    real = Table.commit

    def commit(self, base, parts, *a, **kw):
        if dies == "before the commit" and (kw.get("batch") or (None, 0))[1] == 1 and fails:
            fails.pop()
            raise RuntimeError("the writer dies")
        return real(self, base, parts, *a, **kw)

    monkeypatch.setattr(Table, "commit", commit)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    stream_of(spark, source, spark.createDataFrame([("a", "1"), ("b", "1")], KEYS), "x")
    stream = stream_of(spark, source, spark.createDataFrame([("b", "2"), ("c", "2")], KEYS), "x")
    with pytest.raises(Exception, match="dies"):
        incremental(stream, checkpoint, index.step(then))
    incremental(stream, checkpoint, index.step(then))
    assert out[0] == [("a", "1", True), ("b", "1", True)] and out[1] == [("b", "2", False), ("c", "2", True)]
    assert index.table.read().count() == 3 and index.table.read().select("key").distinct().count() == 3


ITEMS = "prefix string, published_date date, first_seen date, identity_key string"


def test_numbers_of_one_month_are_many_tasks_work(spark):
    rows = [("AB", date(2026, 5, k % 28 + 1) if k % 3 else None, date(2026, 5, 30), f"k{k:05d}") for k in range(6000)] + [("CD", None, date(2026, 6, 1), "x")]
    items = spark.createDataFrame(rows, ITEMS).repartition(7)
    got = {r.identity_key: r.sequence for r in minting.mint(items, spark.createDataFrame([("AB", "2026-05", 40)], COUNTERS)).collect()}
    order = sorted((r for r in rows if r[0] == "AB"), key=lambda r: (r[1] is None, r[1] or date.min, r[3]))
    assert got == {r[3]: 41 + k for k, r in enumerate(order)} | {"x": 1}
    plan = minting.mint(items, spark.createDataFrame([], COUNTERS))
    sizes = plan.sparkSession.read.parquet(*{f.rpartition("/")[0] for f in plan.inputFiles() if "mint-ranges" in f}).groupBy("range").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 6001 / 2  # no range has the month


def test_a_batch_mints_once(spark, tmp_path):
    minter = Minter(spark, str(tmp_path / "ids"), buckets=4)
    first = spark.createDataFrame([("AB", date(2026, 5, 2), date(2026, 5, 9), "b"), ("AB", date(2026, 5, 1), date(2026, 5, 9), "a"), ("AB", None, date(2026, 5, 9), "b"), ("AB", None, date(2026, 5, 9), None)], ITEMS)
    second = spark.createDataFrame([("AB", date(2026, 5, 1), date(2026, 6, 9), "c"), ("AB", date(2026, 6, 1), date(2026, 6, 9), "d"), ("AB", date(2026, 6, 2), date(2026, 6, 9), "a")], ITEMS)
    ids = lambda df: {r.identity_key: r.id for r in df.collect()}
    want = {"a": "AB-2026-05-001", "b": "AB-2026-05-002", None: None}
    assert ids(minter.mint(first, 0)) == want and ids(minter.mint(first, 0)) == want
    later = {"a": "AB-2026-05-001", "c": "AB-2026-05-003", "d": "AB-2026-06-001"}
    assert ids(minter.mint(second, 1)) == later and ids(minter.mint(second, 1)) == later and ids(minter.mint(first, 2)) == want
    assert sorted(map(tuple, minter.counters().collect())) == [("AB", "2026-05", 3), ("AB", "2026-06", 1)]
    assert minter.table.read().count() == 4


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    one, two = (Minter(spark, str(tmp_path / "ids"), buckets=64) for _ in range(2))
    row = lambda key: spark.createDataFrame([("AB", date(2026, 5, 2), date(2026, 5, 9), key)], ITEMS)
    real = Table.stage

    def overtaken(self, rows):
        parts = real(self, rows)
        if self is one.table:
            two.mint(row("other"), 0, "two")
        return parts

    monkeypatch.setattr(Table, "stage", overtaken)
    with pytest.raises(Conflict):
        one.mint(row("mine"), 0, "one")
    monkeypatch.undo()
    assert one.mint(row("mine"), 0, "one").first().id == "AB-2026-05-002" and two.mint(row("other"), 1, "two").first().id == "AB-2026-05-001"


def test_minting_over_a_stream(spark, tmp_path):
    minter, out, fails = Minter(spark, str(tmp_path / "ids"), buckets=4), {}, [True]

    def then(decided, number):
        if fails and fails.pop():
            raise RuntimeError("then dies")
        out.update({r.identity_key: r.id for r in decided.collect()})

    source = str(tmp_path / "in")
    rows = [("AB", date(2026, 5, 2), date(2026, 5, 9), k) for k in "abc"]
    for r in rows:
        stream = stream_of(spark, source, spark.createDataFrame([r], ITEMS), "x")
    with pytest.raises(Exception, match="dies"):
        incremental(stream, str(tmp_path / "checkpoint"), minter.step(then))
    incremental(stream, str(tmp_path / "checkpoint"), minter.step(then))
    assert sorted(out.values()) == [f"AB-2026-05-00{k}" for k in (1, 2, 3)] and minter.table.read().select(F.countDistinct("id")).first()[0] == 3
