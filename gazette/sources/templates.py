"""Prompt templates: YAML front matter and an instruction, a file for each kind of artifact."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import safe_output

TEMPLATES = "kind string, version int, output string, description string, body string, error string"


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Template:
    kind: str
    version: int
    output: str
    description: str
    body: str


def parse_template(kind: str, text: str) -> Template:
    """The template of a file named after `kind`, or TemplateError with what is wrong."""
    head, mark, body = text.removeprefix("---\n").partition("\n---\n")
    if not text.startswith("---\n") or not mark:
        raise TemplateError("no front matter between lines of three dashes")
    try:
        meta = yaml.safe_load(head)
    except yaml.YAMLError:
        raise TemplateError("the front matter is no YAML") from None
    meta = meta if isinstance(meta, dict) else {}
    version, output = meta.get("prompt_version"), meta.get("output")
    if meta.get("artifact_type") != kind:
        raise TemplateError(f"is of type {meta.get('artifact_type')!r}, and its file of {kind!r}")
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise TemplateError(f"prompt_version {version!r} is no positive number")
    if not isinstance(output, str) or not safe_output(output):
        raise TemplateError(f"output {output!r} is not within the artifact folders")
    if not body.strip():
        raise TemplateError("no instruction")
    return Template(kind, version, output, str(meta.get("description", "")), body.strip())


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A row of TEMPLATES for each `*.md` in folder, by kind; a template that is wrong has an error and no body."""
    rows = []
    for r in spark.read.text(f"{folder}/*.md", wholetext=True).select("_metadata.file_name", "value").collect():  # a few files of the program's own
        kind = r[0].removesuffix(".md")
        try:
            t = parse_template(kind, r[1])
            rows.append((kind, t.version, t.output, t.description, t.body, None))
        except TemplateError as e:
            rows.append((kind, None, None, None, None, str(e)))
    return spark.createDataFrame(sorted(rows), TEMPLATES)


def contexts(packs: DataFrame, templates: DataFrame, context: Column) -> DataFrame:
    """kind, output, version, id and text for each object of packs (id, ...) and each template without an error: the instruction, then the context, put together as they are."""
    rows = None
    for t in templates.filter("error is null").collect():
        one = packs.select(F.lit(t.kind).alias("kind"), F.lit(t.output).alias("output"), F.lit(t.version).alias("version"), "id", F.concat(F.lit(t.body + "\n\n"), context).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def content(text: str) -> str:
    """What a person hands in as an artifact; it may not be empty."""
    if not text.strip():
        raise TemplateError("the content is empty")
    return text
