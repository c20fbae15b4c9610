"""What all sources do to make items of what they find."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import canonical_url
from ..operators.identity import resolve
from ..schema import ITEM_COLUMNS

POLLED = ("active", "deprecated")


@dataclass(frozen=True)
class Source:
    """A configured source. `fallbacks` are tried in order when it fails."""

    name: str
    url: str
    kind: str
    authority: str = "official"
    status: str = "active"
    role: str = "primary"
    options: dict = field(default_factory=dict)
    fallbacks: tuple[Source, ...] = ()

    def chain(self) -> list[Source]:
        return [self, *(s for f in self.fallbacks for s in f.chain())]

    @property
    def polled(self) -> bool:
        return self.status in POLLED


def as_items(rows: DataFrame, source: Source, *, link: Column, title: Column, summary: Column, date: Column, tags: Column, method: str, selector: Column, source_id: Column | None = None, page: str | None = None, most: int = 120, carry: tuple[str, ...] = ()) -> DataFrame:
    """Items of rows, with the columns `carry`: canonical link, one-line title, summary within the limit, date with its precision, identity."""
    rows = rows.select(*[F.col(c) for c in carry], link.alias("__link"), tx.single_line(title).alias("title"), summary.alias("said"), date.alias("dated"), tags.alias("raw_tags"), selector.alias("selector"), (F.lit(None).cast("string") if source_id is None else source_id).alias("source_id"))
    rows = rows.withColumns({"announcement_url": F.when(F.coalesce("__link", F.lit("")) != "", canonical_url(F.col("__link"))), "summary": tx.truncate_summary(F.when(F.trim("said") != "", F.col("said")).otherwise(F.col("title")), most)})
    rows = rows.withColumn("identity", resolve(F.col("announcement_url"), F.col("source_id"), F.col("title"), F.col("summary")))
    own = {
        "source_name": F.lit(source.name),
        "source_url": F.coalesce("announcement_url", canonical_url(F.lit(page or source.url))),
        "source_authority": F.lit(source.authority),
        "published_date": F.col("dated.date"),
        "date_confidence": F.col("dated.confidence"),
        "date_precision": F.col("dated.precision"),
        "extraction_method": F.lit(method),
    }
    return rows.withColumns(own).select(*carry, *ITEM_COLUMNS)


def table_items(rows: DataFrame, source: Source, method: str, most: int = 120, carry: tuple[str, ...] = ()) -> DataFrame:
    """Items of table rows (cells; links: array of target and label; section; row).

    The first cell that is a date and nothing else dates the row. The first link with a label is its title, else its longest other cell;
    titles of one word are none. The other cells are its summary.
    """
    from ..functions.dates import parse_date_cell

    dates = F.transform("cells", lambda c, k: F.struct(parse_date_cell(c).alias("d"), k.alias("k")))
    rows = rows.withColumn("dated", F.get(F.filter(dates, lambda x: x["d"]["date"].isNotNull()), F.lit(0)))
    rows = rows.withColumn("linked", F.get(F.filter("links", lambda x: x["label"] != ""), F.lit(0)))
    others = F.filter(F.transform("cells", lambda c, k: F.struct(F.length(c).alias("n"), (-k).alias("k"), c.alias("c"))), lambda x: (x["c"] != "") & ~x["k"].eqNullSafe(-F.col("dated.k")))
    rows = rows.withColumn("others", others)
    rows = rows.withColumn("title", F.coalesce(F.col("linked.label"), F.array_max("others")["c"])).filter(F.size(tx.tokens(F.col("title"))) >= 2)
    summary = F.array_join(F.transform(F.filter("others", lambda x: x["c"] != F.col("title")), lambda x: x["c"]), " ")
    date = F.coalesce(F.col("dated.d"), parse_date_cell(F.lit("")))
    tags = F.when(F.coalesce("section", F.lit("")) != "", F.array("section")).otherwise(F.array().cast("array<string>"))
    place = F.concat(F.coalesce("section", F.lit("")), F.lit(" row "), F.col("row").cast("string"))
    return as_items(rows, source, link=F.col("linked.target"), title=F.col("title"), summary=summary, date=date, tags=tags, method=method, selector=place, most=most, carry=carry)
