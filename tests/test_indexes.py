"""Stored indexes of titles and texts, and rules by one automaton."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gazette.functions.text import fold
from gazette.operators import automaton, classify
from gazette.operators.classify import Rule
from gazette.plans.text_index import TextIndex, grams
from gazette.plans.title_index import TitleIndex

TITLES = "owner string, place int, tokens array<string>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def slow_probe(probes, stored, t):
    """The distinct sets of stored titles, each with its first owner, that each probe is like."""
    sets = {}
    for owner, place, tokens in sorted(stored, key=lambda r: (r[1], r[0])):
        if tokens:
            sets.setdefault(frozenset(tokens), owner)
    return sorted((key, owner, round(jaccard(tokens, s), 9)) for key, tokens in probes for s, owner in sets.items() if tokens and jaccard(tokens, s) >= t)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_titles_are_found_as_by_brute_force(spark, tmp_path, threshold):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    some = lambda: rng.sample(words[: rng.choice((8, 40))], rng.randrange(0, 9))
    old = [(f"o{k:03d}", k, some()) for k in range(150)] + [(f"c{k:03d}", 200 + k, ["w1", "w2", "w3", "w4", "w5"]) for k in range(80)]
    late = [(f"p{k:03d}", 500 + k, [*some(), "unheard"]) for k in range(40)]
    probes = [(f"q{k}", some() + rng.choice(([], ["unheard"], ["never"]))) for k in range(60)] + [("same", ["w5", "w4", "w3", "w2", "w1"]), ("same", ["w1", "w1"]), ("none", []), ("near", ["w1", "w2", "w3", "w4", "w5", "w6"])]
    frame = lambda rows: spark.createDataFrame(rows, TITLES)
    index = TitleIndex(spark, str(tmp_path / "index"), threshold, buckets=8)
    index.freeze(frame(old))
    index.add(frame(old), 0, "place")
    index.add(frame(late), 1, "place")
    index.add(frame(late), 1, "place")
    found = index.probe(spark.createDataFrame(probes, "key string, tokens array<string>"))
    assert sorted((r.key, r.owner, round(r.similarity, 9)) for r in found.collect()) == slow_probe(probes, old + late, threshold)
    assert index.probe(spark.createDataFrame([], "key string, tokens array<string>")).count() == 0
    with pytest.raises(ValueError, match="fixed"):
        index.freeze(frame(late))


def test_a_probe_reads_the_buckets_of_its_words(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path / "index"), 0.85, buckets=32)
    rows = spark.createDataFrame([(f"o{k}", k, [f"w{k}", f"w{k + 1}", "all"]) for k in range(300)], TITLES)
    index.freeze(rows)
    index.add(rows, 0, "place")
    found = index.probe(spark.createDataFrame([("q", ["w7", "w8", "all"])], "key string, tokens array<string>"))
    read = {f.rpartition("/")[0] for f in found.inputFiles() if "/postings/" in f}
    assert [tuple(r) for r in found.collect()] == [("q", "o7", 1.0)] and 1 <= len(read) <= 2 < len(index.postings.version().parts)


def test_an_add_that_dies_between_its_commits(spark, tmp_path, monkeypatch):
    index = TitleIndex(spark, str(tmp_path / "index"), 0.85, buckets=4)
    rows = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["y", "x"]), ("c", 3, ["z"])], TITLES)
    index.freeze(rows)
    monkeypatch.setattr(index.postings, "append", lambda *_, **__: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(rows, 0, "place")
    monkeypatch.undo()
    index.add(rows, 0, "place")
    found = index.probe(rows.select(F.col("owner").alias("key"), "tokens"))
    assert sorted(map(tuple, found.collect())) == [("a", "a", 1.0), ("b", "a", 1.0), ("c", "c", 1.0)]


def test_texts_are_found_as_by_a_scan(spark, tmp_path):
    rng = random.Random(9)
    texts = [(f"t{k:03d}", " ".join(rng.choice(("lake", "Lakes", "sea", "Über-see", "quick", "x")) for _ in range(rng.randrange(6)))) for k in range(200)] + [("null", None), ("short", "ab"), ("emoji", "\U0001d400\U0001d401\U0001d402 z")]
    objects = spark.createDataFrame(texts, "id string, text string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=64)
    index.add(objects.filter("id < 't100'"), 0)
    for number in (1, 1):
        index.add(objects.filter("id >= 't100' or id < 't'"), number)
    index.add(objects.filter("id < 't'"), 2)  # some once more
    fold_of = lambda t: spark.createDataFrame([(t,)], "t string").select(fold(F.col("t"))).first()[0]
    folded = {r.id: r.f for r in objects.select("id", fold(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    for wanted in ("LAKE", "lakes sea", "über see", "quick, quick", "x", "", "zebra", "lake lake lake", "ab", "\U0001d401"):
        f = fold_of(wanted)
        got = sorted(r.id for r in index.search(objects, wanted, F.coalesce("text", F.lit(""))).collect())
        assert got == sorted(i for i, x in folded.items() if f in x), wanted
    files = lambda t: sum("/postings/" in x for x in index.candidates(t).inputFiles())
    assert 0 < files("quick") < index.postings.read().count() and files("quick") <= 4 * 3 * 4 < len(index.postings.read().inputFiles())
    assert index.candidates("zebra").count() == 0 and index.candidates("zz") is None


def test_grams(spark):
    df = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(F.array_sort(grams(F.col("t")))).collect()] == [["abc", "bca", "cab"], [], [], None]


RULES = {
    "tier": [Rule("1", ("Lake", "sea"), ("dry",), "wet"), Rule(None, ("quick",)), Rule(2, ("quick", "la"))],
    "category": [Rule("all", ("",), ("x",)), Rule("never", ("q",), ("",)), Rule("rest", ("x",))],
    "empty": [],
    "tags": [Rule("b", ("sea",)), Rule("a", ("e",)), Rule("a", ("k",)), Rule("", ("l",)), Rule("none", ())],
}


def test_rules_by_one_automaton_are_the_expressions(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(("lake", "sea", "dry", "quick", "x", "é")) for _ in range(rng.randrange(5)))) for k in range(200)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "k int, h string")
    got = automaton.classified(df, "h", RULES)
    one = {a: classify.first_match(F.col("h"), RULES[a], a).alias(a) for a in RULES if a != "tags"}
    want = df.select("k", "h", *one.values(), classify.all_matches(F.col("h"), RULES["tags"]).alias("tags"))
    plain = lambda d: sorted(map(str, d.select("k", *[F.to_json(F.struct(a)) for a in RULES]).collect()))
    assert plain(got.filter("h is not null")) == plain(want.filter("h is not null"))
    none = got.filter("h is null").first()
    assert none.tier is None and none.category is None and none.tags == []
    with pytest.raises(ValueError, match="already"):
        automaton.classified(df.withColumn("tier", F.lit(1)), "h", RULES)


def test_ten_thousand_terms_cost_no_more_than_ten():
    text = " ".join(f"word{k % 97}" for k in range(20_000))
    few = automaton.Matcher((("tags", tuple(Rule(f"v{k}", (f"word{k} ",)) for k in range(10))),))
    many = automaton.Matcher((("tags", tuple(Rule(f"v{k}", (f"term{k}x",)) for k in range(10_000))),))
    took = {}
    for name, m in (("few", few), ("many", many)):
        began = time.perf_counter()
        for _ in range(5):
            m(text)
        took[name] = time.perf_counter() - began
    assert took["many"] < 4 * took["few"] and len(few(text)["tags"]) == 10 and many(text) == {}
