"""Sources on recorded documents, the store, and streams."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gazette.schema import OBJECT_COLUMNS, OBJECTS
from gazette.sources import discover, packs, store
from gazette.sources.feeds import SourceError, read_feed
from gazette.sources.html_tables import read_html
from gazette.sources.items import Source
from gazette.sources.markdown_tables import read_markdown
from gazette.streaming import health
from gazette.streaming.events import incremental, unseen, weekly

RSS = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>Clear  Lake is GA</title><link>https://Blog.example/a/?utm_source=x#t</link><description>short</description><guid>g1</guid><pubDate>Tue, 07 Jul 2026 10:00:00 GMT</pubDate><category>b</category><category>a</category></item>
<item><title>No link here</title><description>&lt;p&gt;Some &amp;amp; more&lt;/p&gt;</description><guid>g2</guid></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><title>An entry</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/1"/><id>i1</id><updated>2026-03-04T05:06:07Z</updated><summary>Words</summary></entry></feed>"""
MARKDOWN = """---
title: x
---
## New things

| Month | Feature | Learn more |
|:-- | --- | --- |
| July 2026 | **[Fast lake (Preview)](../lake/fast.md#a)** | The Gateway December 2025 release |
| | Lone words here | [anchor](#b) |

### Older
| Month | Feature |
|---|---|
| June 2026 | [Other](https://Else.example/x/?ref=1) news |
"""
HTML = """<h2>In this article</h2><h2>Generally <b>available</b></h2><table><tr><th>Month</th><th>Feature</th></tr>
<tr><td>July 2026</td><td><a href="/docs/a?utm_source=1">Fast lake</a></td><td>It is &amp fast. December 2025.</td></tr><tr><td>stray</td></tr></table>
<h3>Preview</h3><table><tr><td>no date</td><td>A much longer cell</td></tr></table>"""


def landed(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_feeds(spark, tmp_path):
    rss = Source("blog", "https://blog.example/feed", "rss")
    got = {r.title: r for r in read_feed(spark, landed(tmp_path, "a.xml", RSS), rss).collect()}
    first = got["Clear Lake is GA"]
    assert (first.announcement_url, first.published_date, first.date_confidence, first.raw_tags, first.identity.basis) == ("https://blog.example/a", date(2026, 7, 7), "exact", ["a", "b"], "canonical-url")
    second = got["No link here"]
    assert (second.summary, second.published_date, second.identity.basis, second.source_url) == ("Some & more", None, "source-identifier", "https://blog.example/feed")
    atom = read_feed(spark, landed(tmp_path, "b.xml", ATOM), Source("x", "https://x.example", "atom")).collect()
    assert [(r.title, r.announcement_url, r.published_date) for r in atom] == [("An entry", "https://x.example/1", date(2026, 3, 4))]
    with pytest.raises(SourceError):
        read_feed(spark, landed(tmp_path, "c.xml", "<rss><channel></channel></rss>"), rss)


def test_markdown_tables(spark, tmp_path):
    source = Source("docs", "https://raw.example/new.md", "markdown", options={"doc_path": "docs/f/new.md", "docs_prefix": "docs/", "rendered_base_url": "https://learn.example/en"})
    got = {r.title: r for r in read_markdown(spark, landed(tmp_path, "new.md", MARKDOWN), source).collect()}
    assert set(got) == {"Fast lake (Preview)", "Lone words here"}  # one word is no title
    fast = got["Fast lake (Preview)"]
    assert (fast.announcement_url, fast.published_date, fast.date_precision, fast.raw_tags) == ("https://learn.example/en/lake/fast", date(2026, 7, 1), "month", ["New things"])
    assert (got["Lone words here"].published_date, got["Lone words here"].identity.basis) == (None, "normalised-title-hash")
    with pytest.raises(ValueError):
        read_markdown(spark, "x", Source("docs", "https://x", "markdown"))


def test_html_tables(spark, tmp_path):
    got = {r.title: r for r in read_html(spark, landed(tmp_path, "p.html", HTML), Source("page", "https://Site.example/new/", "html")).collect()}
    assert set(got) == {"Fast lake", "A much longer cell"}
    fast, cell = got["Fast lake"], got["A much longer cell"]
    assert (fast.announcement_url, fast.published_date, fast.raw_tags, fast.summary) == ("https://site.example/docs/a", date(2026, 7, 1), ["Generally available"], "It is & fast. December 2025.")
    assert (cell.announcement_url, cell.published_date, cell.raw_tags, cell.summary) == (None, None, ["Preview"], "no date")


def test_chains_of_fallbacks(spark, tmp_path):
    good, bad = landed(tmp_path, "a.xml", RSS), landed(tmp_path, "c.xml", "<rss></rss>")
    second = Source("mirror", "https://m.example", "rss")
    sources = [Source("one", "https://1.example", "rss", fallbacks=(second,)), Source("two", "https://2.example", "rss", fallbacks=(Source("ask", "", "", role="manual-review"),)), Source("off", "https://3.example", "rss", status="retired")]
    found = discover.discover(spark, sources, lambda s: good if s.name == "mirror" else bad)
    assert [(a.source, a.name, a.ok, a["items"]) for a in found.attempts.collect()] == [("one", "one", False, 0), ("one", "mirror", True, 2), ("two", "two", False, 0)]
    assert found.unresolved == ["two"] and [r.published_date for r in found.items.collect()] == [date(2026, 7, 7), None]


def test_packs(spark, tmp_path):
    for name, text in (("a", "name: A\nid_prefix: AB\nschema_version: 1\nsources:\n- {name: s, url: 'https://x', type: rss}\nclassification:\n  tier:\n  - {any: [ga], value: 1}\n"), ("b", "- no mapping"), ("c", "name: C\nid_prefix: CD\nschema_version: 1\nsources:\n- {name: s, url: 'file:/etc/passwd'}\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.yml").write_text(text)
    rows, sources, rules = packs.read_packs(spark, str(tmp_path))
    got = {r.pack: r for r in rows.collect()}
    assert got["a"].error is None and got["a"].near_duplicate_threshold == 0.85 and got["b"].error == "no mapping" and "web URL" in got["c"].error
    assert [s.name for s in sources["a"]] == ["s"] and rules["a"]["tier"][0].value == 1


def an_object(spark, ident, **values):
    row = dict.fromkeys(OBJECT_COLUMNS) | {"id": ident, "title": "t", "notes": "mine"} | values
    return spark.createDataFrame([tuple(row.values())], OBJECTS).withColumn("pack", F.lit("p"))


def test_the_store(spark, tmp_path):
    path = str(tmp_path / "objects")
    assert store.read_objects(spark, path).count() == 0
    store.insert_objects(an_object(spark, "AB-2026-05-001").unionByName(an_object(spark, "AB-2026-06-001")), path)
    with pytest.raises(store.StoreError):
        store.insert_objects(an_object(spark, "AB-2026-05-001"), path)
    assert not store.update_objects(an_object(spark, "AB-2026-05-001"), path)
    assert store.update_objects(an_object(spark, "AB-2026-05-001", title="new"), path)
    with pytest.raises(ValueError, match="users own"):
        store.update_objects(an_object(spark, "AB-2026-05-001", notes="theirs"), path)
    locked = an_object(spark, "AB-2026-06-001", tier=2, overrides=["tier"])
    store.update_objects(locked, str(tmp_path / "locked"))
    with pytest.raises(ValueError, match="locked"):
        store.update_objects(locked.withColumn("tier", F.lit(1)), str(tmp_path / "locked"))
    assert store.update_objects(locked.withColumn("tier", F.lit(1)), str(tmp_path / "locked"), by_user=True)
    assert {r.id: r.title for r in store.read_objects(spark, path).collect()} == {"AB-2026-05-001": "new", "AB-2026-06-001": "t"}
    one = store.read_object(spark, path, "AB-2026-06-001", "p")
    assert one.count() == 1 and all("id_year=2026/id_month=6/" in f for f in one.inputFiles())
    assert [store.read_objects(spark, path, n).filter("title = 'new'").count() for n in (0, 1, 2)] == [0, 0, 1]
    twice = an_object(spark, "AB-2026-07-001")
    with pytest.raises(store.StoreError):
        store.insert_objects(twice.unionByName(twice), path)


def test_states_and_locks(spark, tmp_path):
    path = str(tmp_path / "state")
    assert store.read_state(spark, path, "k string, v int").count() == 0
    store.write_state(spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int"), path, "k")
    pinned = store.read_state(spark, path, "k string, v int")
    store.write_state(pinned.withColumn("v", F.col("v") + 1), path, "k")  # from what it replaces
    assert sorted(tuple(r) for r in pinned.collect()) == [("a", 2), ("b", 1)]
    assert sorted(tuple(r) for r in store.read_state(spark, path, "k string, v int").collect()) == [("a", 3), ("b", 2)]
    (tmp_path / "broken" / "versions").mkdir(parents=True)
    (tmp_path / "broken" / "versions" / "000000000001.json").write_text("{nope")
    assert store.read_state(spark, str(tmp_path / "broken"), "k string", damaged="empty").count() == 0
    with pytest.raises(store.StoreError):
        store.read_state(spark, str(tmp_path / "broken"), "k string")
    lock = str(tmp_path / "lock")
    with store.pack_lock(lock), pytest.raises(store.StoreError), store.pack_lock(lock):
        pass
    open(lock, "w").close()
    with store.pack_lock(lock, now=lambda: 1e12):
        pass


def run_to_end(spark, stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_health_over_a_stream(spark, tmp_path):
    rows = [("s", k, k not in (4, 5, 6, 9), 10 if k < 8 else 1, True) for k in range(10)] + [("t", 0, True, 5, False), ("u", 0, False, 0, True), ("u", 1, False, 0, True)]
    df = spark.createDataFrame(rows, "source string, attempt long, ok boolean, items int, primary boolean")
    path, checkpoint, out = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))

    def run(initial=None, to=(checkpoint, out)):
        with health.state_store(spark):
            stream = spark.readStream.schema(df.schema).parquet(path)
            query = health.source_health(stream, initial).writeStream.option("checkpointLocation", to[0]).format("parquet").trigger(availableNow=True).start(to[1])
            query.awaitTermination()
        return {(r.source, r.attempt): r for r in spark.read.parquet(to[1]).collect()}

    df.filter("attempt < 6").write.parquet(path)
    run()
    df.filter("attempt >= 6").write.mode("append").parquet(path)
    got = run()  # from the checkpoint
    assert len(got) == 13 and got["s", 6].needs_alert and not got["s", 7].needs_alert and got["s", 6].consecutive_failures == 3
    assert [got["s", k].state for k in (3, 4, 7, 8)] == ["healthy", "failed", "healthy", "degraded"] and got["t", 0].state == "degraded"
    assert {k: r.alert for k, r in got.items() if r.alert} == {("s", 6): "opened", ("s", 7): "closed"} and got["s", 6].alert_since == 6 and got["s", 7].alert_since is None
    states = {k: (r.state, r.consecutive_failures, r.baseline, r.alert) for k, r in got.items()}
    folded = {}
    for source in "stu":
        state = {}
        for r in sorted(x for x in rows if x[0] == source):
            state = health.fold(state, *r[2:])
            folded[source, r[1]] = (state["state"], state["failures"])
    assert {k: v[:2] for k, v in states.items()} == folded

    # A new query that starts from a snapshot of the old one's states goes on as if it were the old one.
    path = str(tmp_path / "later")
    more = [("s", 10, False, 0, True), ("s", 11, False, 0, True), ("u", 2, False, 0, True), ("off", 1, False, 0, True), ("v", 1, True, 3, True)]
    spark.createDataFrame(more, df.schema).write.parquet(path)
    off = spark.createDataFrame([("off", "disabled", 0, None, None)], "source string, state string, consecutive_failures int, alert_since long, counts array<double>")
    start = health.snapshot(spark.read.parquet(out)).unionByName(off)
    later = run(spark.createDataFrame(start.collect(), start.schema), (str(tmp_path / "c2"), str(tmp_path / "o2")))
    assert {k: (r.state, r.consecutive_failures, r.alert) for k, r in later.items()} == {
        ("s", 10): ("failed", 2, None), ("s", 11): ("failed", 3, "opened"), ("u", 2): ("failed", 3, "opened"), ("off", 1): ("disabled", 0, None), ("v", 1): ("healthy", 0, None)}
    assert later["s", 11].baseline == got["s", 9].baseline
    assert sorted(map(tuple, health.open_alerts(spark.read.parquet(str(tmp_path / "o2"))).collect())) == [("s", 11, 3), ("u", 2, 3)]


def test_weeks_and_keys_over_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 1), ("2024-01-07 23:00:00", "a", 2), ("2024-01-08 00:00:00", "a", 3), ("2024-03-01 00:00:00", "b", 1)]
    df = spark.createDataFrame(rows, "ts string, event_type string, k int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in run_to_end(spark, weekly(read()), "weeks").collect()} >= {("2024-W01", "a", 2), ("2024-W02", "a", 1)}
    assert run_to_end(spark, unseen(read(), "k", "ts", "300 days"), "keys").count() == 3
    seen = []
    for _ in range(2):
        incremental(read(), str(tmp_path / "checkpoint"), lambda batch, n: seen.append(batch.count()))
    assert seen == [4]
