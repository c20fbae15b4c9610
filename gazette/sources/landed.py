"""Landed files of all sources as one data source: spark.read.format("landed") and spark.readStream.format("landed").

A partition is one file, so one scan reads all links of all sources' fallback chains side by side. Rows are entries as the files
have them (ENTRIES); items() makes items of them by the same expressions as the readers of single sources, row by row, so
it works on a batch and on a stream. A file that cannot be read gives one row, with `error`, and nothing else.

A stream's offset is the number of listings that have found anything new. A listing is a file of the folder `log`, made
in one step and never changed; it names the files that it found first. So a query that restarts plans the same partitions
for the same offsets, and a file that lands with an old time stamp is found all the same. The log belongs to one query.

Options: `links`, JSON as links_option() makes it, and for streams `log`. Both name folders that the driver and all executors can
open as files, as landing folders of the fetching job are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.dates import feed_date
from ..functions.html import html_to_text
from .html_tables import _Tables
from .items import Source, as_items, table_items
from .markdown_tables import cells_of

NAME = "landed"
#: The last link of a chain that asks a person instead of a source.
MANUAL = "manual-review"
LINK = "source string, position int, name string, role string, kind string, url string, authority string"
ENTRIES = (
    f"{LINK}, file string, entry int, link string, source_id string, title string, bodies array<string>, published string, updated string, tags array<string>, "
    "line string, cells array<string>, links array<struct<target:string,label:string>>, section string, folder string, docs_prefix string, base_url string, error string"
)
FIELDS = [f.split()[0] for f in ENTRIES.replace("array<struct<target:string,label:string>>", "x").split(", ")]
LINK_FIELDS = [f.split()[0] for f in LINK.split(", ")]
FEEDS = ("rss", "atom", "commits")


@dataclass
class LandedFile(InputPartition):
    """One file of a link; error where the link itself cannot be read."""

    link: dict
    file: str | None
    error: str | None = None


class _Feed:
    """Entries of RSS items or Atom entries. Names count as they are written, prefixes included; markup within a field stays part of its text."""

    def __init__(self, atom: bool):
        self.tag = "entry" if atom else "item"
        self.rows: list[dict] = []
        self.entry: dict | None = None
        self.depth = 0
        self.text: list[str] = []

    def start(self, name: str, attributes: dict) -> None:
        if self.entry is None:
            if name == self.tag:
                self.entry, self.depth = {"link@": [], "category@": []}, 0
            return
        self.depth += 1
        if self.depth == 1:
            self.text = []
            if name == "link":
                self.entry["link@"].append((attributes.get("href"), attributes.get("rel")))
            elif name == "category":
                self.entry["category@"].append(attributes.get("term"))
        else:
            self.text.append(f"<{name}>")

    def end(self, name: str) -> None:
        if self.entry is None:
            return
        if self.depth == 0:
            self.rows.append(self.entry)
            self.entry = None
            return
        if self.depth == 1:
            self.entry.setdefault(name, []).append("".join(self.text).strip())
        else:
            self.text.append(f"</{name}>")
        self.depth -= 1

    def data(self, text: str) -> None:
        if self.entry is not None and self.depth:
            self.text.append(text)


def _feed_rows(file: str, link: dict) -> Iterator[dict]:
    atom = link["kind"] == "atom"
    feed = _Feed(atom)
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = feed.start, feed.end, feed.data
    with open(file, "rb") as f:
        parser.ParseFile(f)
    if not feed.rows:
        raise ValueError(f"no entries in the feed of {link['name']}")
    for e in feed.rows:
        one = lambda name: next(iter(e.get(name, [])), None)  # noqa: B023, E731
        if atom:
            target = next((href for href, rel in e["link@"] if (rel or "alternate") == "alternate"), None)
            yield {"link": target, "source_id": one("id"), "title": one("title"), "bodies": [one("summary"), one("content")], "published": one("published"), "updated": one("updated"), "tags": e["category@"]}
        else:
            yield {"link": one("link"), "source_id": one("guid"), "title": one("title"), "bodies": [one("description"), one("content:encoded")], "published": one("pubDate"), "tags": e.get("category", [])}


def _html_rows(file: str, link: dict) -> Iterator[dict]:
    parser = _Tables(link["url"])
    with open(file, encoding="utf-8", errors="replace") as f:
        while part := f.read(1 << 20):
            parser.feed(part)
    for cells, links, section in parser.rows:
        yield {"cells": cells, "links": links, "section": section}


def _markdown_rows(file: str, link: dict) -> Iterator[dict]:
    """Every line, with its number and the heading above it; which of them are table rows is for cells_of() to tell."""
    options = link.get("options") or {}
    if not options.get("rendered_base_url"):
        raise ValueError(f"{link['name']} needs the option rendered_base_url")
    fixed = {"folder": options.get("doc_path", "").rpartition("/")[0], "docs_prefix": options.get("docs_prefix", ""), "base_url": options["rendered_base_url"]}
    section = None
    with open(file, encoding="utf-8", errors="replace", newline="\n") as f:
        for k, line in enumerate(f):
            line = line.rstrip("\n").removesuffix("\r")
            marks = len(line) - len(line.lstrip("#"))
            if 2 <= marks <= 4 and line[marks : marks + 1].isspace() and line[marks:].strip():
                section = line[marks:].strip()
            elif line.lstrip().startswith("|"):
                yield fixed | {"entry": k, "line": line, "section": section}


PARSERS: dict[str, Callable[[str, dict], Iterator[dict]]] = dict.fromkeys(FEEDS, _feed_rows) | {"html": _html_rows, "markdown": _markdown_rows}


def entries_of(part: LandedFile) -> Iterator[tuple]:
    """The rows of one partition. A file is parsed whole before its first row leaves, so a broken one leaves none but its error."""
    fixed = {k: part.link.get(k) for k in LINK_FIELDS} | {"file": part.file}
    try:
        if part.error:
            raise ValueError(part.error)
        rows = list(PARSERS[part.link["kind"]](part.file, part.link))
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its own failure
        said = f"no reader for {part.link['kind']!r}" if isinstance(e, KeyError) else str(e)
        rows = [{"error": (said or type(e).__name__)[:500]}]
    for k, row in enumerate(rows):
        yield tuple(({"entry": k} | fixed | row).get(name) for name in FIELDS)


def _files(path: str) -> list[str]:
    """The data files at a path, in order; hidden ones and those that begin with an underscore are none."""
    if os.path.isfile(path):
        return [path]
    found = [os.path.join(folder, f) for folder, folders, names in os.walk(path) for f in names]
    return sorted(f for f in found if not any(p.startswith((".", "_")) for p in os.path.relpath(f, path).split(os.sep)))


def planned(links: list[dict]) -> list[LandedFile]:
    """A partition for each file of each link; for a link without files, one that tells so."""
    out: list[LandedFile] = []
    for link in links:
        files = [] if link.get("error") else _files(link["path"])
        out += [LandedFile(link, f) for f in files] or [LandedFile(link, None, link.get("error") or f"nothing has landed for {link['name']}")]
    return out


class LandedReader(DataSourceReader):
    def __init__(self, links: list[dict]):
        self.links = links

    def partitions(self) -> Sequence[LandedFile]:
        return planned(self.links)

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        return entries_of(partition)


class LandedStream(DataSourceStreamReader):
    def __init__(self, links: list[dict], log: str):
        self.links, self.log = links, log
        os.makedirs(log, exist_ok=True)

    def _listing(self, n: int) -> list[list]:
        with open(os.path.join(self.log, f"{n:012d}.json"), encoding="utf-8") as f:
            return json.load(f)

    def _last(self) -> int:
        return max((int(f.removesuffix(".json")) for f in os.listdir(self.log) if f.endswith(".json")), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        n = self._last()
        known = {(k, f) for m in range(1, n + 1) for k, f in self._listing(m)}
        new = [[k, f] for k, link in enumerate(self.links) if not link.get("error") for f in _files(link["path"]) if (k, f) not in known]
        if new:
            n += 1
            draft = os.path.join(self.log, f".draft-{os.getpid()}")
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(new, f)
                f.flush()
                os.fsync(f.fileno())
            os.link(draft, os.path.join(self.log, f"{n:012d}.json"))  # fails if another query has made it: the log is one query's
            os.unlink(draft)
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> Sequence[LandedFile]:
        return [LandedFile(self.links[k], f) for n in range(start["listing"] + 1, end["listing"] + 1) for k, f in self._listing(n)]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        return entries_of(partition)


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ENTRIES

    def _links(self) -> list[dict]:
        return json.loads(self.options["links"])

    def reader(self, schema) -> LandedReader:
        return LandedReader(self._links())

    def streamReader(self, schema) -> LandedStream:
        if not self.options.get("log"):
            raise ValueError("a stream of landed files needs the option log")
        return LandedStream(self._links(), self.options["log"])


def links_option(sources: list[Source], landed: Callable[[Source], str]) -> str:
    """The option `links` for all links of the chains of polled sources. landed(source) is the folder or file of what was fetched; it may raise."""
    links = []
    for source in (s for s in sources if s.polled):
        for k, link in enumerate(source.chain()):
            if link.role == MANUAL:
                break
            one = {"source": source.name, "position": k, "name": link.name, "role": link.role, "kind": link.kind, "url": link.url, "authority": link.authority, "options": link.options}
            try:
                one["path"] = str(landed(link))
            except Exception as e:  # noqa: BLE001  a link that cannot be fetched fails alone
                one["error"] = str(e)[:500] or type(e).__name__
            links.append(one)
    return json.dumps(links)


def read_entries(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str]) -> DataFrame:
    spark.dataSource.register(Landed)
    return spark.read.format(NAME).option("links", links_option(sources, landed)).load()


def stream_entries(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str], log: str) -> DataFrame:
    spark.dataSource.register(Landed)
    return spark.readStream.format(NAME).option("links", links_option(sources, landed)).option("log", log).load()


#: What items() keeps of an entry beside the item.
ORIGIN = ("source", "position", "file", "entry")
CARRY = (*ORIGIN, "name", "url", "authority")


def _feed_items(entries: DataFrame, source: Source, most: int) -> DataFrame:
    body = lambda k: F.coalesce(F.get("bodies", F.lit(k)), F.lit(""))
    longest = F.array_max(F.array(*[F.struct(F.length(body(k)).alias("n"), body(k).alias("b")) for k in (0, 1)]))["b"]
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    return as_items(
        entries, source, link=F.col("link"), title=F.coalesce("title", F.lit("")), summary=html_to_text(longest), date=feed_date(F.col("published"), F.col("updated")), tags=tags,
        method="feed-entry", selector=F.lit(None).cast("string"), source_id=F.col("source_id"), most=most, carry=CARRY,
    )


def _html_items(entries: DataFrame, source: Source, most: int) -> DataFrame:
    return table_items(entries.withColumn("row", F.col("entry")), source, "html-table-row", most, CARRY)


def _markdown_items(entries: DataFrame, source: Source, most: int) -> DataFrame:
    lines = cells_of(entries.withColumn("row", F.col("entry")), F.col("folder"), F.col("docs_prefix"), F.col("base_url"))
    return table_items(lines, source, "markdown-table-row", most, CARRY)


BRANCHES: tuple[tuple[tuple[str, ...], Callable[[DataFrame, Source, int], DataFrame]], ...] = ((FEEDS, _feed_items), (("html",), _html_items), (("markdown",), _markdown_items))


def items(entries: DataFrame, most: int = 120, kinds: Iterable[str] = tuple(PARSERS)) -> DataFrame:
    """Items (with ORIGIN) of the entries of `kinds`; entries with an error have none. Row by row, so streams and batches give the same rows.

    Each branch of kinds reads `entries` for itself. read_items() and stream_items() give each its own files alone.
    """
    source = Source(F.col("name"), F.col("url"), F.col("kind"), F.col("authority"))  # constants of one source, as columns of many
    good = entries.filter("error is null")
    found = [build(good.filter(F.col("kind").isin(*of)), source, most) for of, build in BRANCHES if set(of) & set(kinds)]
    return reduce(DataFrame.unionByName, found or [_feed_items(good.filter("false"), source, most)]).drop("name", "url", "authority")


def _by_branch(sources: list[Source], landed: Callable[[Source], str]) -> Iterator[tuple[tuple[str, ...], str]]:
    """The kinds of each branch that sources use, and the option `links` for them."""
    links = json.loads(links_option(sources, landed))
    for of, _ in BRANCHES:
        mine = [k for k in links if k["kind"] in of]
        if mine:
            yield of, json.dumps(mine)


def read_items(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str], most: int = 120) -> DataFrame:
    """items() of all sources' landed files, each file read once."""
    spark.dataSource.register(Landed)
    parts = [items(spark.read.format(NAME).option("links", links).load(), most, of) for of, links in _by_branch(sources, landed)]
    return reduce(DataFrame.unionByName, parts or [items(spark.createDataFrame([], ENTRIES), most, ())])


def stream_items(spark: SparkSession, sources: list[Source], landed: Callable[[Source], str], log: str, most: int = 120) -> DataFrame:
    """items() of a stream of all sources' landed files; `log` has a folder for each branch."""
    spark.dataSource.register(Landed)
    parts = [items(spark.readStream.format(NAME).option("links", links).option("log", f"{log}/{of[0]}").load(), most, of) for of, links in _by_branch(sources, landed)]
    return reduce(DataFrame.unionByName, parts)


def failures(entries: DataFrame) -> DataFrame:
    """A row for each file, and each link without files, that could not be read."""
    return entries.filter("error is not null").select(*LINK_FIELDS, "file", "error")
