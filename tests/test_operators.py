"""Operators against plain models, and under reordering and repetition."""

import random
from dataclasses import fields
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions import text as tx
from gazette.operators import classify, coverage, crosspack, dedupe, history, identity, minting, retrieve, review, updates, validate
from gazette.plans.similarity_join import similar_pairs
from gazette.streaming.health import fold


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- deduplication


def one_by_one(items, keys, contents):
    keys, contents, out = dict(keys), dict(contents), {}
    for rank, key, content in sorted(items):
        if key in keys:
            out[rank] = ("known-identity", keys[key])
        elif content in contents:
            out[rank] = ("known-content", contents[content])
        else:
            out[rank] = ("new", None)
            keys[key] = contents[content] = "pending"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_layers_are_those_of_one_item_after_another(spark, seed):
    rng = random.Random(seed)
    items = [(k, f"k{rng.randrange(25)}", f"c{rng.randrange(25)}") for k in range(80)]
    keys, contents = [("k1", "A-1"), ("k99", "A-2")], [("c3", "A-3")]
    want = one_by_one(items, keys, contents)
    df = spark.createDataFrame(items, "rank long, key string, content string").repartition(3)
    got = dedupe.exact(df, spark.createDataFrame(keys, "key string, owner string"), spark.createDataFrame(contents, "content string, owner string"))
    assert {r["rank"]: (r.verdict, r.matched) for r in got.collect()} == want


def test_layers_together(spark):
    titles = ["clear lake semantic model speed", "clear lake semantic model speed", "lake clear model semantic speed new", "other"]
    df = spark.createDataFrame([(k, f"k{k}", f"c{min(k, 2)}" if k != 1 else "c0", t) for k, t in enumerate(titles)], "rank long, key string, content string, title string")
    df = df.withColumn("tokens", tx.title_tokens(F.col("title")))
    got = {r["rank"]: (r.verdict, r.similarity) for r in dedupe.decide(df, 0.85).collect()}
    assert got == {0: ("new", 0.0), 1: ("known-content", 0.0), 2: ("near-duplicate", 1.0), 3: ("known-content", 0.0)}
    assert dedupe.decide(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_similarity_join_is_brute_force(spark, threshold):
    rng = random.Random(2)
    sets = [(k, rng.sample("abcdefghijkl", rng.randrange(0, 9))) for k in range(60)]
    want = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and len({*s} & {*t}) >= threshold * len({*s} | {*t})]
    got = similar_pairs(spark.createDataFrame(sets, "k long, e array<string>"), "k", "e", threshold)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_similarity_join_of_copies_and_repeated_keys(spark):
    """Rows of one key are rows of their own, copies of a set are paired like others, and pairs come once; in any order of the two sizes."""
    rng = random.Random(3)
    base = [[f"w{k}-{j}" for j in range(40)] for k in range(4)]
    sets = [(9 - k % 10, rng.sample(base[k % 4], rng.choice([34, 38, 40, 40]))) for k in range(40)] + [(3, []), (None, base[0])]
    sets += [(11, [f"a{j}" for j in range(40)]), (11, [f"b{j}" for j in range(40)]), (12, [f"b{j}" for j in range(40)])]  # the first row's elements are rarer
    want = [(a, b) for a, s in sets for b, t in sets if a is not None and b is not None and a < b and s and t and len({*s} & {*t}) >= 0.85 * len({*s} | {*t})]
    got = similar_pairs(spark.createDataFrame(sets, "k long, e array<string>"), "k", "e", 0.85)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


# --- identity and gate


def test_identity_and_grades(spark):
    cells = [("https://x/", "i", "T"), (None, "i", "T"), ("", None, "Clear Lake"), (None, None, "the of"), (None, None, "")]
    df = spark.createDataFrame(cells, "u string, i string, t string")
    got = [r.x and r.x.basis for r in df.select(identity.resolve(F.col("u"), F.col("i"), F.col("t"), F.lit(None).cast("string")).alias("x")).collect()]
    assert got == ["canonical-url", "source-identifier", "normalised-title-hash", "content-fingerprint", None]
    items = [("a", "canonical-url", "One thing", "official"), ("b", "canonical-url", "Two", "official"), ("b", "canonical-url", "Three", "official"), ("c", "canonical-url", "x", "third-party"), ("d", "content-fingerprint", "y", "official"), ("e", "normalised-title-hash", "z", "official"), ("f", "normalised-title-hash", "the", "official")]
    graded = identity.gate(identity.grade(spark.createDataFrame(items, "identity_key string, identity_basis string, title string, source_authority string")))
    got = {(r.identity_key, r.title): (r.identity_confidence, r.lifecycle) for r in graded.collect()}
    assert [got[i[0], i[2]] for i in items] == [("high", "approved"), ("medium", "queued"), ("medium", "queued"), ("high", "queued"), ("low", "queued"), ("medium", "queued"), ("low", "queued")]
    assert dict(identity.confidence_tally(graded).collect()) == {"high": 2, "medium": 3, "low": 2}
    clash = identity.collisions(graded.withColumn("rank", F.monotonically_increasing_id()), "rank").collect()
    assert [(r.identity_key, r.features, r.titles) for r in clash] == [("b", 2, ["Three", "Two"])]


# --- minting, updates


def test_numbers_go_on_from_their_counters(spark):
    d = date
    items = [("A", "k2", d(2026, 5, 2), d(2026, 6, 1)), ("A", "k1", d(2026, 5, 2), d(2026, 6, 1)), ("A", "k3", None, d(2026, 5, 9)), ("A", "k4", d(2026, 4, 1), d(2026, 6, 1)), ("B", "k1", d(2026, 5, 1), d(2026, 6, 1))]
    df = spark.createDataFrame(items, "prefix string, identity_key string, published_date date, first_seen date")
    counters = spark.createDataFrame([("A", "2026-05", 998)], "prefix string, month_key string, counter int")
    first = minting.mint(df, counters)
    assert {(r.prefix, r.identity_key): r.id for r in first.collect()} == {("A", "k1"): "A-2026-05-999", ("A", "k2"): "A-2026-05-1000", ("A", "k3"): "A-2026-05-1001", ("A", "k4"): "A-2026-04-001", ("B", "k1"): "B-2026-05-001"}
    assert rows(minting.mint(df.repartition(5), counters)) == rows(first)
    assert ("A", "2026-05", 1001) in rows(minting.counters_after(first))


def test_revisions_and_ownership(spark):
    kind = "id string, title string, note string, seen string, revisions array<struct<revision:int,changed_fields:array<string>,summary:string>>"
    df = spark.createDataFrame([("a", "x", "n", "x", [(1, [], "first")]), ("b", "x", "n", None, [(1, [], "first")])], kind)
    changed = df.withColumn("changed", updates.changed_fields([("title", F.col("title"), F.col("seen")), ("note", F.col("note"), F.col("note"))]))
    after = updates.append_revision(changed, "revisions", "changed", {"summary": updates.describe(F.col("changed"))})
    assert {r.id: [x.summary for x in r.revisions] for r in after.collect()} == {"a": ["first"], "b": ["first", "New title"]}
    again = changed.withColumn("changed", F.array(F.lit("identity_confidence")))
    assert all(len(r.revisions) == 1 for r in updates.append_revision(again, "revisions", "changed", {}).collect())
    assert updates.guard_ownership(df, df, "id", ["note"]).count() == 2
    with pytest.raises(updates.OwnershipError):
        updates.guard_ownership(df, df.withColumn("note", F.when(F.col("id") == "a", "m").otherwise(F.col("note"))), "id", ["note"])


def test_the_least_key_wins(spark):
    df = spark.createDataFrame([(1, "b", 9), (1, "a", 1), (2, "c", 5)], "o int, k string, v int")
    assert rows(updates.update_winner(df, "o", "k")) == [(1, "a", 1), (2, "c", 5)]


def test_supersede(spark):
    df = spark.createDataFrame([(x, "active", None, None) for x in "abc"] + [("d", "replaced", "c", None)], "id string, status string, replaced_by string, replaces string")
    pairs = spark.createDataFrame([("a", "b"), ("c", "c"), ("d", "a"), ("a", "c"), ("b", "zz")], "old_id string, new_id string")
    assert rows(updates.supersede(df, pairs).select("id", "status", "replaced_by", "replaces")) == [("a", "replaced", "b", None), ("b", "active", None, "a"), ("c", "active", None, None), ("d", "replaced", "c", None)]


# --- classification


def test_rules(spark):
    rules = classify.rules_from_config({"tier": [{"any": ["Generally available"], "none": ["preview"], "value": 1, "name": "ga"}, "no rule", {"any": ["preview"], "value": 2}, {"any": ["x"]}], "tags": [{"any": ["lake"], "value": "lake"}, {"any": ["a"], "value": "a"}, {"value": "never"}]})
    df = spark.createDataFrame([("GENERALLY AVAILABLE lake",), ("generally available preview",), ("nothing",)], "t string").select(classify.haystack(F.col("t")).alias("h"))
    got = df.select(classify.first_match(F.col("h"), rules["tier"], "tier").alias("m"), classify.all_matches(F.col("h"), rules["tags"]).alias("tags")).collect()
    assert [(r.m and tuple(r.m), r.tags) for r in got] == [(("1", "ga"), ["a", "lake"]), (("2", "tier[2]"), ["a"]), (None, [])]
    checked = df.select(classify.coerced(classify.first_match(F.col("h"), rules["tier"], "tier"), ("1",)).alias("m")).collect()
    assert [r.m and r.m.matched_by for r in checked] == ["ga", "tier[2] (invalid value)", None]


# --- retrieval


OBJECT = {
    "id": "A-2026-05-001", "title": "Clear-Lake speed", "tier": 2, "learning_priority": "high", "difficulty": "easy", "learning_status": "new", "status": "active", "category": "Lake", "tags": ["One", "two"],
    "source_name": "Blog", "published_date": None, "discovered_date": date(2026, 5, 4), "needs_review": True, "generation": {"quiz": ("generated", 1)}, "revisions": [(1,), (2,)],
}
KIND = "id string, title string, tier int, learning_priority string, difficulty string, learning_status string, status string, category string, tags array<string>, source_name string, published_date date, discovered_date date, needs_review boolean, generation map<string,struct<status:string,generated_from_revision:int>>, revisions array<struct<revision:int>>"
HITS = {"text": ("clear lake", "clearlake"), "tier": (2, 1), "learning_priority": ("high", "low"), "difficulty": ("easy", "hard"), "learning_status": ("new", "done"), "status": ("active", "replaced"), "category": ("LAKE", "la"), "tag": ("ONE", "on"), "source": ("bLog", "log"), "since": (date(2026, 5, 4), date(2026, 5, 5)), "until": (date(2026, 5, 4), date(2026, 5, 3)), "needs_review": (True, False), "stale": (True, False)}


def test_every_filter_hits_and_misses(spark):
    assert set(HITS) == {f.name for f in fields(retrieve.Query)} == set(retrieve.PREDICATES)
    df = spark.createDataFrame([tuple(OBJECT.values())], KIND)
    counts = df.select(*[F.count_if(retrieve.condition(retrieve.Query(**{k: v}))).alias(f"{k}{n}") for k, pair in HITS.items() for n, v in enumerate(pair)]).first()
    assert all(counts[f"{k}0"] == 1 and counts[f"{k}1"] == 0 for k in HITS)
    assert retrieve.search(df, retrieve.Query()).count() == 1 and retrieve.search(df, retrieve.Query(), 0).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([tuple(OBJECT.values())], KIND).write.parquet(str(tmp_path / "o"))
    plan = retrieve.search(spark.read.parquet(str(tmp_path / "o")), retrieve.Query(tier=2, status="active"), 5).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tier,2)" in plan and "TakeOrderedAndProject" in plan and "ReadSchema: struct<id:string,tier:int,status:string,published_date:date,discovered_date:date>" in plan


# --- histories and integrity


def test_runs_are_never_hidden(spark):
    chains = {"a": "xyyyzzz", "b": "xyyzyy", "c": "xyyyy"}
    df = spark.createDataFrame([(k, n + 1, f) for k, c in chains.items() for n, f in enumerate(c)], "id string, revision int, changed_fields string")
    want = [("a", "y", 2, 4, 3), ("a", "z", 5, 7, 3), ("c", "y", 2, 5, 4)]
    assert rows(history.repeated_runs(df)) == want
    longer = df.unionByName(spark.createDataFrame([("a", 8, "q"), ("c", 6, "q")], df.schema))
    assert rows(history.repeated_runs(longer)) == want
    accepted = spark.createDataFrame([("a", "y", 2, 4), ("c", "y", 2, 4)], "id string, fields string, first_revision int, last_revision int")
    found = validate.baseline_match(history.repeated_runs(df), accepted, ["id", "fields", "first_revision", "last_revision"], F.col("id"))
    assert sorted((r.level, r.code, r.location) for r in found.collect()) == [("info", "REV002", "a"), ("warning", "REV002", "a"), ("warning", "REV002", "c"), ("warning", "REV003", "c")]


def test_chain_problems(spark):
    d = date
    chain = [("a", 1, d(2026, 1, 1), [], "h1"), ("a", 2, d(2026, 1, 2), ["t"], "h2"), ("b", 1, d(2026, 1, 2), ["t"], "h"), ("b", 3, d(2026, 1, 1), [], "h"), ("c", 1, d(2026, 1, 1), [], None)]
    df = spark.createDataFrame(chain, "id string, revision int, date date, changed_fields array<string>, content_hash string")
    heads = spark.createDataFrame([("a", "h1"), ("b", "h"), ("c", "x"), ("d", "x")], "id string, content_hash string")
    assert rows(history.chain_problems(df, heads)) == [("a", "head-mismatch", 2), ("b", "backwards-date", 3), ("b", "initial-changes", 1), ("b", "no-changes", 3), ("b", "numbering", 2), ("d", "no-revisions", None)]


def test_findings(spark):
    packs = spark.createDataFrame([("p", "P", "AB", 1), ("q", None, "abc", 9)], "pack string, name string, id_prefix string, schema_version int")
    assert sorted(r.code for r in validate.pack_config(packs).collect()) == ["PACK001", "PACK002", "PACK003"]
    objects = spark.createDataFrame([("AB-2026-05-001", "AB", "2026/05/AB-2026-05-001"), ("XY-2026-05-002", "AB", "2026/06/other"), ("bad", "AB", "2026/05/bad")], "id string, prefix string, path string")
    assert sorted(r.code for r in validate.identifiers(objects).collect()) == ["ID001", "ID002", "ID004", "OBJ001"]
    texts = spark.createDataFrame([("a", "T", "# T\n\n" + "w " * 9), ("b", "T", "# U\nw"), ("c", "T", "none")], "id string, title string, body string")
    assert sorted((r.code, r.location) for r in validate.article(texts, 8).collect()) == [("CONS001", "c"), ("CONS002", "b"), ("COPY001", "a")]
    locks = spark.createDataFrame([("a", ["tier", "id", "zz"])], "id string, overrides array<string>")
    assert sorted(r.code for r in validate.overrides(locks, ["tier"], ["tier", "id"]).collect()) == ["OWN001", "OWN002"]
    made = spark.createDataFrame([("a", {"x": ("generated", None), "y": ("generated", "../z"), "z": ("stale", "artifacts/q"), "w": ("none", None)})], "id string, generation map<string,struct<status:string,path:string>>")
    assert sorted(r.code for r in validate.artifacts(made, spark.createDataFrame([("artifacts/other",)], "path string")).collect()) == ["GEN001", "GEN002", "GEN003"]
    assert validate.fails_build(validate.pack_config(packs)) and not validate.fails_build(validate.pack_config(packs.limit(0)), strict=True)


def test_shared_groups(spark):
    df = spark.createDataFrame([("1", "p", "u", "c"), ("2", "q", "u", "c"), ("3", "q", "v", "d"), ("4", "p", "w", "d"), ("5", "p", "x", "e"), ("6", "p", "x", "e")], "id string, pack string, url_hash string, content_hash string")
    groups = crosspack.duplicate_groups(df)
    assert rows(groups.select("basis", "ids")) == [("content", "3+4"), ("url", "1+2")]
    assert rows(crosspack.duplicate_groups(df.orderBy(F.desc("id")).repartition(3)).select("basis", "ids")) == [("content", "3+4"), ("url", "1+2")]
    assert crosspack.outstanding(groups, groups).count() == 0


# --- review, coverage, health


def test_review(spark):
    queue = spark.createDataFrame([("a", "queued"), ("b", "archived"), ("c", "queued")], "identity_key string, lifecycle string")
    acts = spark.createDataFrame([("a", "approved"), ("b", "queued"), ("c", "minted")], "identity_key string, lifecycle string")
    assert rows(review.act(queue, acts)) == [("a", "approved"), ("b", "archived"), ("c", "queued")]
    assert rows(review.enqueue(acts.unionByName(spark.createDataFrame([("z", "x")], acts.schema)), queue)) == [("z", "x")]


def test_artifacts(spark):
    df = spark.createDataFrame([({"a": ("generated", 1), "b": ("stale", 3), "c": ("requested", None)},)], "g map<string,struct<status:string,generated_from_revision:int>>")
    got = df.select(coverage.refreshed(F.col("g"), F.lit(3)).alias("g")).first().g
    assert {k: v.status for k, v in got.items()} == {"a": "stale", "b": "generated", "c": "requested"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 9), st.booleans()), max_size=40))
def test_health_folds(attempts):
    state, counts, failures = {}, [], 0
    for ok, items, primary in attempts:
        state = fold(state, ok, items, primary)
        failures = 0 if ok else failures + 1
        counts = [*counts, items][-26:] if ok else counts
        assert state["failures"] == failures and state["counts"] == counts and (state["state"] == "failed") == (not ok)
    assert fold({"state": "disabled"}, False, 0, True) == {"state": "disabled"}
