"""Text functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: Words that announcements wear and that say nothing of what is announced (fixed values).
TITLE_NOISE = (
    "announcing", "announcement", "announces", "introducing", "new", "now",
    "is", "are", "the", "a", "an", "of", "for", "to", "in", "and", "with",
    "available", "availability", "general", "generally", "ga", "preview",
    "public", "update", "updates", "support", "supports",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def single_line(text: Column) -> Column:
    """White space collapsed to blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """Words between white space; none for null."""
    line = single_line(F.coalesce(text, F.lit("")))
    return F.filter(F.split(line, " "), lambda w: w != "")


def fold(text: Column) -> Column:
    """Letters and digits in lower case, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalise_title(title: Column) -> Column:
    """The title's words but for noise, sorted, repeats kept."""
    parts = F.split(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "), " ")
    noise = F.array(*[F.lit(w) for w in TITLE_NOISE])
    return F.array_join(F.array_sort(F.filter(parts, lambda w: (w != "") & ~F.array_contains(noise, w))), " ")


def title_tokens(title: Column) -> Column:
    """The set of words of a normalised title."""
    return F.array_distinct(F.filter(F.split(normalise_title(title), " "), lambda w: w != ""))


def slugify(title: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at the last hyphen within `most` characters."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(whole, 1, most)
    at_hyphen = F.regexp_replace(head, "-[^-]*$", "")
    cut = F.when(at_hyphen == "", head).otherwise(at_hyphen)
    return F.when(whole == "", "untitled").when(F.length(whole) <= most, whole).otherwise(cut)


def truncate_summary(text: Column, most: int) -> Column:
    """The first `most` words; where some were cut, with an ellipsis in place of closing punctuation."""
    words = tokens(text)
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), "[,;:]+$", ""), F.lit("…"))
    return F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(cut)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def content_hash(title: Column, summary: Column) -> Column:
    """A fingerprint of what is said, whatever its line breaks."""
    return digest(single_line(F.concat(title, F.lit("\n"), summary)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


def reading_time(text: Column, per_minute: int = 200) -> Column:
    """Whole minutes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.size(tokens(text)) / per_minute)).cast("int")


def release_wave(text: Column) -> Column:
    """`20xx Release Wave n` where the text names one, else null."""
    pattern = r"(?i)\b(20\d{2})\s+release\s+wave\s+([12])\b"
    year = F.regexp_extract(text, pattern, 1)
    return F.when(year != "", F.concat(year, F.lit(" Release Wave "), F.regexp_extract(text, pattern, 2)))


def strip_markdown(text: Column) -> Column:
    """Links become their labels (targets where there is none), emphasis marks go."""
    link = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
    unlabelled = F.regexp_replace(text, link.replace("([^\\]]*)", "", 1), "$1")
    labelled = F.regexp_replace(unlabelled, link, "$1")
    return single_line(F.regexp_replace(labelled, r"\*\*|__|\*|_|`", ""))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; empty below one."""
    value = F.floor(100 * part / F.nullif(whole, F.lit(0)))
    return F.when(value >= 1, F.concat(value.cast("string"), F.lit("%"))).otherwise("")
