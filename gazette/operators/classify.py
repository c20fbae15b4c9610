"""Classification by rules held as data, compiled to expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("category", "tier", "learning_priority", "difficulty", "workload")


@dataclass(frozen=True)
class Rule:
    """`value` where one of `any` is in the text and none of `none` is; terms are plain text, in any case."""

    value: str | int | None
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    name: str | None = None


def rules_from_config(config: dict) -> dict[str, list[Rule]]:
    """Rules of a pack's configuration, by axis; entries that are no mappings are left out, and their place still counts in the names of others."""
    found: dict[str, list[Rule]] = {}
    for axis, entries in config.items():
        found[axis] = []
        for k, entry in enumerate(entries or []):
            if isinstance(entry, dict):
                terms = {side: tuple(str(t) for t in entry.get(side) or ()) for side in ("any", "none")}
                found[axis].append(Rule(entry.get("value"), terms["any"], terms["none"], str(entry.get("name") or f"{axis}[{k}]")))
    return found


def haystack(*parts: Column) -> Column:
    """What rules look at: title, slug, latest summary. Never what classification itself sets."""
    return F.lower(F.concat_ws(" ", *parts))


def matches(text: Column, rule: Rule) -> Column:
    """Whether the rule applies to lower-case text."""

    def some(terms: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for term in terms:
            found = found | F.contains(text, F.lit(term.lower()))
        return found

    return some(rule.any) & ~some(rule.none)


def first_match(text: Column, rules: list[Rule], axis: str) -> Column:
    """A struct of value and matched_by of the first rule that applies; null where none does. Rules without a value are passed over."""
    found = None
    for k, rule in enumerate(rules):
        if rule.value is not None:
            hit = F.struct(F.lit(rule.value).cast("string").alias("value"), F.lit(rule.name or f"{axis}[{k}]").alias("matched_by"))
            condition = matches(text, rule)
            found = F.when(condition, hit) if found is None else found.when(condition, hit)
    return F.lit(None).cast("struct<value:string,matched_by:string>") if found is None else found


def all_matches(text: Column, rules: list[Rule]) -> Column:
    """The values of all rules that apply, sorted, without repeats."""
    hits = [F.when(matches(text, r), F.lit(str(r.value))) for r in rules if r.value]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))) if hits else F.array().cast("array<string>")


def coerced(found: Column, allowed: tuple[str, ...]) -> Column:
    """found, with a null value and a remark where its value is none of `allowed`."""
    valid = found["value"].isin(*allowed)
    bad = F.struct(F.lit(None).cast("string").alias("value"), F.concat(found["matched_by"], F.lit(" (invalid value)")).alias("matched_by"))
    return F.when(found.isNull() | valid, found).otherwise(bad)


def applicable(current: Column, default: Column | None, proposed: Column, locked: Column) -> Column:
    """What a field becomes: the proposal, unless there is none, a person has locked the field, or it has a value already."""
    unset = current.isNull() if default is None else (current.isNull() | (current == default))
    return F.when(proposed.isNotNull() & ~locked & unset, proposed).otherwise(current)


def needs_review(*axes: Column) -> Column:
    """Whether one of the axes that every object must have got no proposal."""
    missing = F.lit(False)
    for axis in axes:
        missing = missing | axis.isNull()
    return missing
