"""Cross-pack groups over batches."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from gazette.operators import crosspack
from gazette.streaming.crosspack import CrossPack, sides_of

OBJECTS = "id string, pack string, url_hash string, content_hash string"
KEYS = {"url": "url_hash", "content": "content_hash"}


def named(df):
    return sorted((r.basis, r.key, r.sides, r.packs) for r in df.collect())


def test_batches_give_what_one_pass_gives(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"o{k:03d}", f"p{rng.randrange(4)}", f"u{rng.randrange(60)}", rng.choice((None, f"c{rng.randrange(60)}"))) for k in range(200)]
    rows += [(f"h{k:04d}", f"p{k % 3}", "hot", "hot-too") for k in range(900)]  # one group with most objects, the same by both bases
    kept = CrossPack(spark, str(tmp_path / "kept"), buckets=8)
    rng.shuffle(rows)
    for number, part in ((0, rows[:500]), (1, rows[500:1000]), (2, rows[1000:]), (2, rows)):
        kept.apply(sides_of(spark.createDataFrame(part, OBJECTS), KEYS), number)
    want = crosspack.duplicate_groups(spark.createDataFrame(rows, OBJECTS))
    got = kept.groups()
    assert named(got) == named(want) and ("url", "hot", 900, 3) in named(got) and not any(k == "hot-too" for _, k, _, _ in named(got))
    hot = kept.sides(got.filter("key = 'hot'"))
    assert hot.count() == 900 and hot.select("pack").distinct().count() == 3
    assert got.schema["first_id"].dataType.simpleString() == "string" and not any("array" in t for _, t in got.dtypes)


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path, monkeypatch):
    kept = CrossPack(spark, str(tmp_path / "kept"), buckets=32)
    kept.apply(sides_of(spark.createDataFrame([(f"o{k}", f"p{k % 2}", f"u{k // 2}", None) for k in range(300)], OBJECTS), KEYS), 0)
    read = []
    real = type(kept.members).read
    monkeypatch.setattr(type(kept.members), "read", lambda self, version=None, only=None: (read.append(only), real(self, version, only))[1])
    kept.apply(sides_of(spark.createDataFrame([("late", "p9", "u3", None)], OBJECTS), KEYS), 1)
    assert read and all(only is not None and len(only) == 1 for only in read)
    monkeypatch.undo()
    assert ("url", "u3", 3, 3) in named(kept.groups())


def test_objects_that_move_and_leave(spark, tmp_path):
    kept = CrossPack(spark, str(tmp_path / "kept"), buckets=4)
    old = spark.createDataFrame([("a", "p", "u", "c"), ("b", "q", "u", "c"), ("z", "r", "u", None)], OBJECTS)
    kept.apply(sides_of(old, KEYS), 0)
    assert named(kept.groups()) == [("content", "c", 2, 2), ("url", "u", 3, 3)]
    kept.apply(sides_of(old.filter("id = 'z'"), KEYS, present=False), 1)
    assert named(kept.groups()) == [("url", "u", 2, 2)]  # by content it is the same objects now
    moved = sides_of(old.filter("id = 'b'"), KEYS, present=False).unionByName(sides_of(spark.createDataFrame([("b", "q", "v", "c")], OBJECTS), KEYS))
    kept.apply(moved, 2)
    assert named(kept.groups()) == [("content", "c", 2, 2)]
    kept.apply(sides_of(spark.createDataFrame([], OBJECTS), KEYS), 3)
    assert named(kept.groups()) == [("content", "c", 2, 2)]


@pytest.mark.parametrize("rule", ["packs", "members"])
def test_acknowledgements_survive_by_rule(spark, tmp_path, rule):
    kept = CrossPack(spark, str(tmp_path / "kept"), buckets=4, rule=rule)
    add = lambda number, *rows: kept.apply(sides_of(spark.createDataFrame(rows, OBJECTS), KEYS), number)
    add(0, ("a", "p", "u", None), ("b", "q", "u", None), ("c", "p", "w", None), ("d", "q", "w", None))
    kept.acknowledge(spark.createDataFrame([("url", "u")], "basis string, key string"), F.lit(date(2026, 1, 1)))
    assert [k for _, k, _, _ in named(kept.outstanding())] == ["w"]
    add(1, ("e", "q", "u", None))
    assert [k for _, k, _, _ in named(kept.outstanding())] == (["w"] if rule == "packs" else ["u", "w"])
    kept.acknowledge(spark.createDataFrame([("url", "u"), ("url", "none")], "basis string, key string"), F.lit(date(2026, 2, 2)))
    assert [r.acknowledged_on for r in kept.known.read().collect()] == [date(2026, 1, 1) if rule == "packs" else date(2026, 2, 2)]
    add(2, ("f", "r", "u", None))
    assert [k for _, k, _, _ in named(kept.outstanding())] == ["u", "w"]


def test_an_apply_that_dies_between_its_commits(spark, tmp_path, monkeypatch):
    kept = CrossPack(spark, str(tmp_path / "kept"), buckets=4)
    rows = sides_of(spark.createDataFrame([("a", "p", "u", None), ("b", "q", "u", None)], OBJECTS), KEYS)
    monkeypatch.setattr(kept.classes, "append", lambda *_, **__: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.apply(rows, 0)
    monkeypatch.undo()
    kept.apply(rows, 0)
    assert named(kept.groups()) == [("url", "u", 2, 2)] and kept.members.read().count() == 2
