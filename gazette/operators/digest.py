"""Texts and tables for people: articles, context packs, indexes, weekly digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_summary


def article(title: Column, summary: Column, link: Column, limit: int = 120) -> Column:
    """A heading, the summary within the limit, and where it comes from."""
    body = truncate_summary(summary, max(limit - 12, 20))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n\nSource: "), link, F.lit("\n"))


def index(objects: DataFrame, published: str = "published_date", ident: str = "id") -> DataFrame:
    """All objects, newest first, undated ones last."""
    return objects.orderBy(F.col(published).desc_nulls_last(), ident)


def grouped_index(objects: DataFrame, by: Column, published: str = "published_date", ident: str = "id") -> DataFrame:
    """(group, objects, ids) for an index by something; ids in index order, joined by blanks."""
    order = F.struct(F.coalesce(-F.unix_date(published), F.lit(1 << 30)).alias("o"), F.col(ident).alias("id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"].cast("string")), " ")
    return objects.groupBy(by.alias("group")).agg(F.count("*").alias("objects"), ids.alias("ids"))


def facts(columns: dict[str, Column]) -> Column:
    """Labelled lines; a value that is null is `unknown`."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), F.coalesce(value.cast("string"), F.lit("unknown"))) for label, value in columns.items()])


def context_pack(instruction: str, title: Column, known: Column, body: Column, related: Column, link: Column) -> Column:
    """What a writer gets: the instruction, then data that is marked as such."""
    return F.concat(
        F.lit(f"{instruction}\n\n<data>\n# "), title, F.lit("\n\n"), known, F.lit("\n\n"), F.coalesce(body, F.lit("(no article)")), F.lit("\n\nRelated: "), F.coalesce(related, F.lit("none")), F.lit("\n\nSource: "), link, F.lit("\n</data>\n")
    )


def subject(problems: Column, new: Column) -> Column:
    return F.when(problems > 0, F.concat(problems.cast("string"), F.lit(" problems"))).when(new > 0, F.concat(new.cast("string"), F.lit(" new"))).otherwise("nothing new")


#: Lines that a digest shows of each list, and characters of a title.
SHOWN = {"errors": 20, "warnings": 20, "updated": 25}
TITLE_CHARS = 70
#: Sections of a digest in their order.
SECTIONS = ("head", "failed", "errors", "warnings", "summary", "backlog", "artifacts", "new", "updated")


def _section(rows: DataFrame, name: str, key: Column, line: Column) -> DataFrame:
    return rows.select("pack", "week", F.lit(SECTIONS.index(name)).alias("section"), key.cast("string").alias("place"), line.alias("line"))


def _listed(rows: DataFrame, name: str, heading: str) -> DataFrame:
    """A heading, the first lines of (pack, week, line) in order of the text, and how many more there are."""
    turn = Window.partitionBy("pack", "week").orderBy("line")
    ranked = rows.withColumns({"turn": F.row_number().over(turn)})
    most = SHOWN.get(name)
    shown = ranked if most is None else ranked.filter(F.col("turn") <= most)
    out = _section(rows.select("pack", "week").distinct(), name, F.lit("0"), F.lit(heading))
    out = out.unionByName(_section(shown, name, F.concat(F.lit("1"), F.lpad(F.col("turn").cast("string"), 9, "0")), F.concat(F.lit("- "), "line")))
    if most is not None:
        more = rows.groupBy("pack", "week").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        out = out.unionByName(_section(more, name, F.lit("2"), F.concat(F.lit("- and "), (F.col("n") - most).cast("string"), F.lit(" more"))))
    return out


def digest_lines(runs: DataFrame, new: DataFrame, failed: DataFrame, errors: DataFrame, warnings: DataFrame, updated: DataFrame, backlog: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(pack, week, section, place, line): the weekly digests, a row for each line; in order of section and place they are the text.

    runs has a row for each (pack, week) with run_id, discovered, updated, unchanged, queued and classified; new is (pack, week,
    id, tier, title); failed, errors, warnings and updated are (pack, week, line); backlog is (pack, week, kind, tasks);
    artifacts is (pack, week, stale, requested). What went wrong comes first, then numbers, what waits, and what is new, by
    tier. Only as many lines as SHOWN says are given of a list, and how many more there are. Weeks with nothing new and no
    failure say so. Null titles are empty; no runs give no lines.
    """
    count = new.groupBy("pack", "week").agg(F.count("*").alias("minted"))
    rows = runs.join(count, ["pack", "week"], "left").withColumn("minted", F.coalesce("minted", F.lit(0)))
    numbers = ("discovered", "minted", "updated", "unchanged", "queued", "classified")
    parts = [
        _section(rows, "head", F.lit("0"), F.concat(F.lit("# "), "pack", F.lit(": "), "week")),
        _section(rows, "head", F.lit("1"), F.concat(F.lit("run "), "run_id")),
        _listed(failed.distinct(), "failed", "## Sources that failed"),
        _listed(errors, "errors", "## Errors"),
        _listed(warnings, "warnings", "## Warnings"),
        _section(rows, "summary", F.lit("0"), F.lit("## Summary")),
        *[_section(rows, "summary", F.lit(f"1{k}"), F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for k, c in enumerate(numbers)],
    ]
    waiting = backlog.filter("tasks > 0")
    total = waiting.groupBy("pack", "week").agg(F.sum("tasks").alias("n"))
    parts.append(_section(total, "backlog", F.lit("0"), F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(" to review"))))
    parts.append(_section(waiting, "backlog", F.concat(F.lit("1"), "kind"), F.concat(F.lit("- "), "kind", F.lit(": "), F.col("tasks").cast("string"))))
    some = artifacts.filter("stale > 0 or requested > 0")
    parts.append(_section(some, "artifacts", F.lit("0"), F.lit("## Artifacts")))
    parts += [_section(some.filter(f"{c} > 0"), "artifacts", F.lit(f"1{c}"), F.concat(F.lit("- "), F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("requested", "stale")]
    quiet = rows.filter("minted = 0").join(failed.select("pack", "week").unionByName(errors.select("pack", "week")).distinct(), ["pack", "week"], "left_anti")
    parts.append(_section(quiet, "new", F.lit("0"), F.lit("## Nothing new: all sources were read")))
    parts.append(_section(count, "new", F.lit("0"), F.lit("## New")))
    title = F.substring(F.coalesce("title", F.lit("")), 1, TITLE_CHARS)
    parts.append(_section(new, "new", F.concat_ws("/", F.lit("1"), F.col("tier").cast("string"), "id"), F.concat_ws(" | ", "id", F.col("tier").cast("string"), title)))
    parts.append(_listed(updated, "updated", "## Updated"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_lines(objects: DataFrame, tasks: DataFrame | None = None, artifacts: DataFrame | None = None, published: str = "published_date") -> DataFrame:
    """(pack, document, group, place, line): the lines of the documents INDEX, by-source, by-month, review-queue and generation-status of each pack.

    In order of group and place they are the text: a heading for each group, then its objects, newest first and undated ones
    last. tasks are those of review.tasks() with pack, artifacts those of coverage.artifact_rows() with pack. No document is
    gathered into one row; a writer sorts the lines of each.
    """
    newest = F.concat(F.coalesce(F.lpad((F.lit(10_000_000) - F.unix_date(published)).cast("string"), 9, "0"), F.lit("9")), F.lit("/"), F.col("id").cast("string"))
    entry = F.concat_ws(" | ", F.col("id").cast("string"), F.coalesce(F.col(published).cast("string"), F.lit("undated")), F.coalesce("title", F.lit("")))
    kinds = {"INDEX": F.lit("all"), "by-source": F.coalesce("source_name", F.lit("unknown")), "by-month": F.coalesce(F.date_format(published, "yyyy-MM"), F.lit("undated"))}
    parts = [objects.select("pack", F.lit(name).alias("document"), by.alias("group"), newest.alias("place"), entry.alias("line")) for name, by in kinds.items()]
    if tasks is not None:
        place = F.concat_ws("/", F.coalesce(F.col("first_seen").cast("string"), F.lit("")), "key")
        parts.append(tasks.select("pack", F.lit("review-queue").alias("document"), F.concat(F.col("urgency").cast("string"), F.lit(" "), "kind").alias("group"), place.alias("place"), F.concat_ws(" | ", "short_key", "title", "reason").alias("line")))
    if artifacts is not None:
        parts.append(artifacts.select("pack", F.lit("generation-status").alias("document"), F.col("status").alias("group"), F.concat_ws("/", "id", "kind").alias("place"), F.concat_ws(" | ", "id", "kind", F.concat(F.lit("behind by "), F.col("behind").cast("string"))).alias("line")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    heads = rows.groupBy("pack", "document", "group").agg(F.count("*").alias("n"))
    heads = heads.select("pack", "document", "group", F.lit("").alias("place"), F.concat(F.lit("## "), "group", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return rows.unionByName(heads)
