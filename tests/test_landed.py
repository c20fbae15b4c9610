"""Landed files as a data source, in batches and as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gazette.schema import ITEM_COLUMNS
from gazette.sources import discover, landed
from gazette.sources.items import Source

from .test_sources_and_streams import ATOM, HTML, MARKDOWN, RSS

OPTIONS = {"doc_path": "docs/f/new.md", "docs_prefix": "docs/", "rendered_base_url": "https://learn.example/en"}
SOURCES = [
    Source("blog", "https://blog.example/feed", "rss"),
    Source("news", "https://x.example", "atom", authority="community"),
    Source("docs", "https://raw.example/new.md", "markdown", options=OPTIONS),
    Source("page", "https://Site.example/new/", "html"),
]


def put(root, name, **files):
    (root / name).mkdir(exist_ok=True)
    for file, text in files.items():
        (root / name / file).write_text(text)


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "blog", a=RSS, b=RSS.replace("guid>g", "guid>h").replace("/a/", "/b/"), _ignored="nope")
    put(tmp_path, "news", a=ATOM)
    put(tmp_path, "docs", new=MARKDOWN)
    put(tmp_path, "page", p=HTML)
    return tmp_path


def rows(df):
    return sorted(str(r.asDict(True)) for r in df.select(*ITEM_COLUMNS).collect())


def test_one_scan_gives_what_the_readers_give(spark, root):
    where = lambda s: str(root / s.name)
    entries = landed.read_entries(spark, SOURCES, where)
    assert entries.rdd.getNumPartitions() == 5  # one a file
    one_by_one = discover.discover(spark, SOURCES, where)
    want = rows(one_by_one.items)
    assert len(want) == 9 and rows(landed.items(entries)) == rows(landed.read_items(spark, SOURCES, where)) == want
    assert landed.read_items(spark, [], where).count() == 0
    at_once = discover.discover_at_once(spark, SOURCES, where)
    assert rows(at_once.items) == want and at_once.unresolved == one_by_one.unresolved == []
    key = lambda d: sorted(map(tuple, d.attempts.collect()))
    assert key(at_once) == key(one_by_one)


def test_a_broken_file_is_a_row(spark, root):
    put(root, "blog", c=RSS[: len(RSS) // 2], d="<rss><channel></channel></rss>")
    (root / "news" / "bad").write_bytes(b"\xff\xfe\x00")
    entries = landed.read_entries(spark, [*SOURCES, Source("none", "https://n.example", "rss"), Source("odd", "https://o.example", "gopher"), Source("lost", "https://l.example", "rss"), Source("md", "https://m.example", "markdown")], lambda s: str(1 / 0) if s.name == "lost" else str(root / ("docs" if s.name in ("md", "odd") else s.name)))
    failed = {(r.source, r.file and os.path.basename(r.file)): r.error for r in landed.failures(entries).collect()}
    assert set(failed) == {("blog", "c"), ("blog", "d"), ("news", "bad"), ("none", None), ("odd", "new"), ("lost", None), ("md", "new")}
    assert failed["blog", "d"] == "no entries in the feed of blog" and "no reader" in failed["odd", "new"] and "division" in failed["lost", None] and "rendered_base_url" in failed["md", "new"]
    got = landed.items(entries).groupBy("source", "file").agg(F.count("*").alias("n")).collect()
    assert {(r.source, os.path.basename(r.file)): r.n for r in got} == {("blog", "a"): 2, ("blog", "b"): 2, ("news", "a"): 1, ("docs", "new"): 2, ("page", "p"): 2}


def test_chains_at_once(spark, root):
    put(root, "bad", c="<rss></rss>")
    second = Source("blog", "https://m.example", "rss")
    ask = Source("ask", "", "", role="manual-review")
    chains = [Source("one", "https://1.example", "rss", fallbacks=(second, Source("news", "https://x.example", "atom"))), Source("two", "https://2.example", "rss", fallbacks=(ask, second)), Source("off", "https://3.example", "rss", status="retired")]
    where = lambda s: str(root / (s.name if s.name in ("blog", "news") else "bad"))
    at_once, one_by_one = discover.discover_at_once(spark, chains, where), discover.discover(spark, chains, where)
    key = lambda d: sorted((a.source, a.position, a.name, a.role, a.ok, a["items"]) for a in d.attempts.collect())
    assert key(at_once) == key(one_by_one) == [("one", 0, "one", "primary", False, 0), ("one", 1, "blog", "secondary", True, 4), ("two", 0, "two", "primary", False, 0)]
    assert at_once.unresolved == ["two"] and rows(at_once.items) == rows(one_by_one.items)
    assert discover.discover_at_once(spark, chains[2:], where).items is None


def test_a_stream_takes_each_file_once(spark, root, tmp_path_factory):
    where, log, out, state = (lambda s: str(root / s.name)), *(str(tmp_path_factory.mktemp(n)) for n in ("log", "out", "state"))

    def run():
        stream = landed.stream_items(spark, SOURCES, where, log)
        query = stream.writeStream.option("checkpointLocation", state).format("parquet").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return rows(spark.read.parquet(out))

    want = rows(landed.items(landed.read_entries(spark, SOURCES, where)))
    assert run() == want and run() == want
    put(root, "blog", late=RSS.replace("/a/", "/late/"))
    os.utime(root / "blog" / "late", (1, 1))  # an old time stamp hides nothing
    put(root, "news", broken="<feed")
    after = run()
    assert len(after) == len(want) + 2 and set(want) < set(after)
    assert after == rows(landed.read_items(spark, SOURCES, where))
    raw = landed.stream_entries(spark, SOURCES, where, log + "-raw").writeStream.format("memory").queryName("raw_entries").trigger(availableNow=True).start()
    raw.awaitTermination()
    assert landed.failures(spark.table("raw_entries")).count() == 1


def test_offsets_plan_the_same_files_again(root, tmp_path):
    links = json.loads(landed.links_option(SOURCES[:1], lambda s: str(root / s.name)))
    first = landed.LandedStream(links, str(tmp_path / "log"))
    start, end = first.initialOffset(), first.latestOffset()
    planned = first.partitions(start, end)
    assert [os.path.basename(p.file) for p in planned] == ["a", "b"] and first.latestOffset() == end
    put(root, "blog", c=RSS)
    again = landed.LandedStream(links, str(tmp_path / "log"))
    assert again.partitions(start, end) == planned
    later = again.latestOffset()
    assert [os.path.basename(p.file) for p in again.partitions(end, later)] == ["c"] and again.partitions(later, later) == []
    with pytest.raises(ValueError, match="log"):
        landed.Landed({"links": json.dumps(links)}).streamReader(None)


def test_markup_in_a_feed_and_commits(spark, root):
    feed = """<feed><entry><title type="xhtml">A <b>bold</b> lake</title><link href="https://x.example/2"/><content>one<br/>two</content><category term="b"/><category term="a"/><published>2026-03-04T05:06:07Z</published></entry></feed>"""
    put(root, "more", a=feed)
    got = landed.items(landed.read_entries(spark, [Source("more", "https://x.example", "atom")], lambda s: str(root / s.name))).first()
    assert (got.title, got.summary, got.raw_tags) == ("A <b>bold</b> lake", "one two", ["a", "b"])
    same = landed.items(landed.read_entries(spark, [Source("blog", "https://blog.example/feed", "commits")], lambda s: str(root / s.name)))
    assert same.count() == 4
