r"""Chat formatting with a grammar round trip.

The grammar, in which every turn looks the same:

    conversation = turn*        turn = "<s>" role "[INST]" text "[/INST]" "</s>"

A turn's role and text are written as they are; the turn is parsed again by the grammar, and if what comes back is not
the source, the source's control strings are escaped and the turn is parsed again, until it is identical. Escaping puts
a backslash after the first character of a control string, and one more where there are some already: `[INST]` becomes
`[\INST]`, `[\INST]` becomes `[\\INST]`. The parser takes one of them away. So an escaped text has no control string,
and the second try always succeeds.

Turns are rendered row by row. Conversations are then sorted by turn within partitions and streamed: the parser sees a
conversation's turns one after another, and no conversation is held whole, however many turns it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, TEXT, TEXT_END, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, TEXT, TEXT_END, END)
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


class GrammarError(ValueError):
    pass


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the place of the written text (code points, end exclusive) of each turn from `at` on."""
    while at < len(text):
        if not text.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        role_end = text.find(TEXT, at)
        text_end = text.find(TEXT_END, role_end)
        if role_end < 0 or text_end < 0 or not text.startswith(END, text_end + len(TEXT_END)):
            raise GrammarError(f"the turn at {at} has no end")
        a = role_end + len(TEXT)
        role, body = text[at + len(START) : role_end], text[a:text_end]
        if any(c in part for part in (role, body) for c in CONTROLS):
            raise GrammarError(f"a control string within the turn at {at}")
        yield unescape(role), unescape(body), a, text_end
        at = text_end + len(TEXT_END) + len(END)


def render(role: str, text: str) -> str:
    """One turn, escaped as far as its round trip needs."""
    for write in (lambda x: x, escape):
        turn = f"{START}{write(role)}{TEXT}{write(text)}{TEXT_END}{END}"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn
        except GrammarError:
            pass
    raise GrammarError("an escaped turn does not come back")


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and written, the turn as formatted, for each row; a conversation is its rows' `written` in order of turn, role and text.

    Null role and null text are empty, a null turn comes first, rows with a null conversation are one conversation. Rows
    that repeat are turns of their own; extra columns are ignored. A text of any length is one turn; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(written, pa.string())], names=["conv_id", "turn", "role", "text", "written"])

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    picked = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, written string")


class _Reader:
    """What is read back of one conversation, turn by turn. Loss is on the texts of `loss_role`."""

    def __init__(self, conv_id, loss_role: str):
        self.conv_id, self.loss_role = conv_id, loss_role
        self.turns = self.loss = self.chars = 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def read(self, written: str) -> None:
        for role, text, a, b in parse(written):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if role == self.loss_role:
                under_mask = unescape(written[a:b])
                self.loss += len(under_mask)
                self.under.update(under_mask.encode("utf-8", "replace"))
        self.chars += len(written)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation of format_turns()' result, from `written` alone.

    Turns that tie in `turn` are read by role, then text; a conversation without a turn of `loss_role` has no loss and the
    digest of nothing. Text that does not parse is an error, never a shorter conversation. No rows give no rows.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        reader: _Reader | None = None
        for batch in batches:
            ids = batch.schema.field(0).type
            rows = []
            for conv, written in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reader is None or reader.conv_id != conv:
                    rows += [reader.row()] if reader else []
                    reader = _Reader(conv, loss_role)
                reader.read(written)
            yield table(rows, ids)
        if reader is not None:
            yield table([reader.row()], ids)

    def table(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    n = shuffle_partitions(formatted.sparkSession)
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "written")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A turn has 20 characters of marks, and one more for each control string within it, escaped or not.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
w AS (
  SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
