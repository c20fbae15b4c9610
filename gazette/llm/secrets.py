"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for each blob and rule version, the findings
of that scan, if any. A run scans only the pairs of blob and rule version that the ledger lacks, each distinct blob
once however many paths bear it, adds them to the ledger, and joins the findings back to all paths of this run.

Only hashes are held against the ledger. Texts move for the paths that are to be scanned alone: one path of each unseen
blob, that of the smallest identifier, is joined to its text by identifier and blob, so that a blob which very many paths
bear is spread over all tasks. Where several rows bear that identifier and blob, they are aggregated to one before the scan.
The ledger is partitioned by rule and version, so a run reads the rules that it asks for. Hashes are shuffled as bytes.
A pair that is appended twice, by two runs at a time or by one that is tried again, counts once wherever the ledger is read.
"""

from __future__ import annotations

import operator
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, new_path, prefix, text_groups


@dataclass(frozen=True)
class Rule:
    """What a kind of secret looks like. `group` is what must have `least` characters. `hint`, in lower case, is in every match's lower-cased text."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: tuple[str, ...] = ()


#: Fixed patterns. The first three are those that all users agree on; the others are added by this scan.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # a run of such characters is one match, so the least length may stand here
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0, ("private key",)),
    Rule("forge", 1, r"\bgh[opsur]_[A-Za-z0-9]{36,}", 0, 0, ("gh",)),
)
BASE = ("assign", "access", "hex")
#: Bytes of texts that are Python strings at a time; a longer text is scanned whole, on its own.
BYTES = 1 << 22


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Of each kind, the leftmost matches that do not overlap, without those that are too short; code points, end exclusive."""
        lower = text.lower()
        found = {}
        for rule, pattern in self.rules:
            if rule.hint and not any(h in lower for h in rule.hint):
                found[rule.kind] = []
            else:
                found[rule.kind] = [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return found


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then in the order of `kinds`."""
    order = sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in spans.get(kind, ()))
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in order)


SPANS = "array<struct<start:long,end:long>>"
#: A ledger's rows; it is partitioned by the last two columns. `run` names the run that scanned the pair.
LEDGER = f"blob string, run string, spans {SPANS}, kind string, version int"


def read_ledger(spark: SparkSession, path: str | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at `path`, of the versions of `rules` alone; an empty one where none has been written."""
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            wanted = reduce(operator.or_, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
            return spark.read.schema(LEDGER).parquet(path).filter(wanted)
    return spark.createDataFrame([], LEDGER)


def unseen(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, doc_id (the smallest that bears it, null before all), copies (rows of paths with both) and todo (kind/version, of those that `ledger` lacks) for each blob of paths (doc_id, blob) that has any."""
    names = F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules])
    key = F.unhex("blob")
    have = ledger.groupBy(key.alias("seen")).agg(F.collect_set(F.concat_ws("/", "kind", F.col("version").cast("string"))).alias("have"))
    rows = paths.groupBy(key.alias("key"), "doc_id").agg(F.count("*").alias("copies"))
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "copies")).alias("m"))
    todo = F.array_except(names, F.coalesce("have", F.array().cast("array<string>")))
    return first.join(have, F.col("key") == F.col("seen"), "left").select(F.lower(F.hex("key")).alias("blob"), "m.doc_id", "m.copies", todo.alias("todo")).filter("size(todo) > 0")


def scan_texts(rows: DataFrame, run_name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for each row of rows (blob, text, todo) and each rule named in its todo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners: dict[tuple[str, ...], Scanner] = {}
        for whole in batches:
            for at, n in text_groups(whole.column(1), BYTES):
                out: list[list] = [[], [], [], [], []]
                for blob, text, left in zip(*(c.to_pylist() for c in whole.slice(at, n).columns), strict=True):
                    scanner = scanners.setdefault(tuple(left), Scanner(tuple(r for r in rules if f"{r.kind}/{r.version}" in left)))
                    found = scanner.spans(text)
                    for rule, _ in scanner.rules:
                        for column, value in zip(out, (blob, run_name, [{"start": a, "end": b} for a, b in found[rule.kind]], rule.kind, rule.version), strict=True):
                            column.append(value)
                kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["blob", "run", "spans", "kind", "version"])

    return rows.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def scan(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans (array of kind, start, end; by start, then by the rules' order) for each row of docs.

    Null text is an empty blob. Rows that repeat, in identifier or text, are paths of their own. Extra columns are
    ignored. The ledger at `ledger_path` (a folder that all executors share; one of this run's where None) gains what was unseen. No
    rows give no rows.
    """
    spark = docs.sparkSession
    p = prefix(docs)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    blob = F.sha2(text, 256)
    paths = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), blob.alias("blob")), "paths")
    path = ledger_path or new_path(spark, "blob-ledger")
    todo = materialize(unseen(paths, read_ledger(spark, ledger_path, rules), rules), "unseen")  # so that its size is known: texts are shuffled only where it is large
    texts = docs.select(F.col(f"`{id_col}`").alias(p + "id"), F.unhex(blob).alias(p + "blob"), text.alias("text"))
    met = lambda todo: texts.join(todo, F.col(p + "id").eqNullSafe(F.col("doc_id")) & (F.col(p + "blob") == F.unhex("blob"))).select("blob", "text", "todo")
    fresh, repeated = met(todo.filter("copies = 1")), todo.filter("copies > 1")
    if not repeated.isEmpty():
        fresh = fresh.unionByName(met(repeated).groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("todo").alias("todo")))
    scan_texts(fresh, uuid.uuid4().hex, rules).write.mode("append").partitionBy("kind", "version").parquet(path)
    forget(todo)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    found = read_ledger(spark, path, rules).filter(F.size("spans") > 0)
    rows = found.select("blob", "kind", F.explode("spans").alias("s"))
    each = F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("k"), F.col("s.end").alias("end"), F.col("kind").alias("kind"))
    findings = rows.groupBy(F.col("blob").alias("of")).agg(F.array_sort(F.collect_set(each)).alias("spans"))
    # Most blobs have no findings, and a blob's findings are as many as its own spans: the small side of a join whose other side can be split.
    findings = materialize(findings, "findings")
    joined_back = paths.join(findings, F.col("blob") == F.col("of"), "left")
    empty = F.array().cast("array<struct<start:long,k:int,end:long,kind:string>>")
    spans = F.transform(F.coalesce("spans", empty), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined_back.select("doc_id", "blob", spans.alias("spans"))


def scanned_pairs(spark: SparkSession, ledger_path: str) -> DataFrame:
    """run, kind, version and pairs: how many blobs each run scanned by each rule's version."""
    ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    return ledger.groupBy("run", "kind", "version").agg(F.count("*").alias("pairs"))


def digests_of_generations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digests() of all of docs as the second generation over one ledger; the first, some half of the rows by a hash, is in the ledger already and is not scanned again."""
    path = new_path(docs.sparkSession, "blob-ledger")
    scan(docs.filter(F.xxhash64(F.col(f"`{id_col}`")) > 0), path, id_col, text_col)
    return digests(docs, path, id_col, text_col)


def digests(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs, from scan()."""
    rows = scan(docs, ledger_path, id_col, text_col)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), "blob"
    )
