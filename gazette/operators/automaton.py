"""Rules as data, all of them in one pass over a text.

The terms of all rules of all axes make one multi-pattern automaton, which reads a text once, however many terms there are. The terms
that it finds lead to the rules that name them; of those the first that applies decides an axis, and all that apply give the tags.
A rule costs something only where one of its terms is in the text. Equal to the expressions of classify, rule by rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .classify import Rule

TAGS = "tags"
#: Characters of text that are turned into Python strings at a time.
SLICE = 4 << 20

Rules = tuple[tuple[str, tuple[Rule, ...]], ...]


class Matcher:
    """Rules by axis, compiled."""

    def __init__(self, rules: Rules):
        self.rules: list[tuple[str, str, str, frozenset[int]]] = []  # axis, value, name, terms that forbid it; in order within an axis
        self.leads: list[list[int]] = []  # of each term, the rules that it is reason for
        self.always: list[int] = []  # rules with the empty term, which is in every text
        self.never: set[int] = set()
        numbers: dict[str, int] = {}

        def number(term: str) -> int:
            if term not in numbers:
                numbers[term] = len(numbers)
                self.leads.append([])
            return numbers[term]

        for axis, of in rules:
            for k, rule in enumerate(of):
                if rule.value is None or (axis == TAGS and not rule.value):
                    continue
                r = len(self.rules)
                none = [t.lower() for t in rule.none]
                self.rules.append((axis, str(rule.value), rule.name or f"{axis}[{k}]", frozenset(number(t) for t in none if t)))
                for t in {t.lower() for t in rule.any}:
                    (self.leads[number(t)] if t else self.always).append(r)
                if "" in none:
                    self.never.add(r)
        self.automaton = ahocorasick.Automaton()
        for term, n in numbers.items():
            self.automaton.add_word(term, n)
        if numbers:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> dict[str, list[tuple[str, str]]]:
        """(value, name) of the rules that apply to a lower-case text, by axis, in the rules' order. None has no terms."""
        if text is None:
            return {}
        found = {n for _, n in self.automaton.iter(text)} if len(self.automaton) else set()
        out: dict[str, list[tuple[str, str]]] = {}
        for r in sorted({r for n in found for r in self.leads[n]} | set(self.always)):
            axis, value, name, none = self.rules[r]
            if r not in self.never and none.isdisjoint(found):
                out.setdefault(axis, []).append((value, name))
        return out


@lru_cache(maxsize=4)
def matcher(rules: Rules) -> Matcher:
    """One automaton a worker, however many tasks it runs."""
    return Matcher(rules)


def classified(rows: DataFrame, text: str, rules: dict[str, list[Rule]]) -> DataFrame:
    """rows with a column for each axis of rules: `tags` the sorted values of all rules that apply, any other a struct of value and matched_by of the first.

    `text` names the lower-case haystack. A null text matches nothing. Columns of rows with an axis' name are an error.
    """
    frozen: Rules = tuple((axis, tuple(of)) for axis, of in rules.items())
    hit = pa.struct([("value", pa.string()), ("matched_by", pa.string())])
    taken = [a for a in rules if a in rows.columns]
    if taken:
        raise ValueError(f"the rows have a column {taken[0]} already")
    schema = T.StructType(list(rows.schema.fields))
    for axis in rules:
        schema.add(axis, T.ArrayType(T.StringType()) if axis == TAGS else T.StructType([T.StructField("value", T.StringType()), T.StructField("matched_by", T.StringType())]))
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(frozen)
        for whole in batches:
            step = max(1, whole.num_rows * SLICE // max(1, whole.column(place).nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = [match(x) for x in batch.column(place).to_pylist()]
                made = [
                    pa.array([sorted({v for v, _ in f.get(axis, ())}) for f in found], pa.list_(pa.string())) if axis == TAGS
                    else pa.array([{"value": f[axis][0][0], "matched_by": f[axis][0][1]} if axis in f else None for f in found], hit)
                    for axis in rules
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)
