"""All integrity rules over a store, configurations and documents; the registry; the baseline; the weekly digest."""

from datetime import date, datetime

import pytest
import yaml
from pyspark.sql import functions as F

from gazette.__main__ import main
from gazette.plans import integrity
from gazette.plans.harvest import Run, harvest
from gazette.schema import OBJECTS
from gazette.sources import store
from gazette.sources.registry import Registry

from .test_documents_and_commands import REVISIONS, document, place
from .test_harvest import FIRST, RULES, items

PACK = {"name": "P", "id_prefix": "TST", "schema_version": 1, "categories": ["lake"], "limits": {"max_summary_words": 3}, "sources": [{"name": "s", "url": "https://x", "fallbacks": [{"name": "f", "url": "ftp://y"}]}]}


def objects_of(spark, *rows):
    return spark.createDataFrame([(*document(ident, **own).values(), pack) for pack, ident, own in rows], f"{OBJECTS}, pack string")


def codes(df):
    return sorted((r.code, r.location, r.level) for r in df.collect())


@pytest.fixture
def packs(tmp_path):
    root = tmp_path / "packs"
    texts = {"p": yaml.safe_dump(PACK), "q": "name: Q\nid_prefix: q1\nschema_version: 9\n", "r": "- list", "s": "id_prefix: SS\nschema_version: one\n"}
    for name, text in texts.items():
        (root / name).mkdir(parents=True)
        (root / name / "pack.yml").write_text(text)
    return root


def test_documents_are_held_against_their_place(spark, packs, tmp_path_factory):
    art = lambda path, status="generated": {"quiz": {"status": status, "path": path, "generated_at": None, "generated_from_revision": 1, "model": None, "prompt_version": None}}
    good, moved, alien = "TST-2026-01-001", "TST-2026-02-002", "OTH-2026-01-003"
    place(packs, "p", good, yaml.safe_dump(document(good, generation=art("artifacts/quiz.md"))))
    place(packs, "p", moved, yaml.safe_dump(document(moved, generation=art("../x"))))
    place(packs, "p", alien, yaml.safe_dump({k: v for k, v in document(alien, generation=art("artifacts/none.md")).items() if k != "notes"} | {"odd": 1}))
    place(packs, "p", "TST-2026-01-004", yaml.safe_dump(document("TST-2026-01-005", generation=art(None), title="A title")), article=False)
    place(packs, "p", "TST-2026-01-006", "a: [")
    base = packs / "p" / "knowledge" / "2026" / "01"
    (base / good / "artifacts").mkdir()
    (base / good / "artifacts" / "quiz.md").write_text("q")
    (base / good / "article.md").write_text("# A title: quoted\n\none two three\n")
    (base / moved / "article.md").write_text("no heading at all here\n")
    (base / alien / "article.md").write_text("# Another\n")
    (base / "out").symlink_to(tmp_path_factory.mktemp("elsewhere"))
    configs, _ = integrity.packs.read_configs(spark, str(packs))
    got = {(c, x) for c, x, _ in codes(integrity.document_findings(spark, str(packs), configs))}
    at = lambda name: f"2026/01/{name}"
    assert got == {
        ("SEC001", "p/knowledge/2026/01/out"), ("OBJ001", at("TST-2026-01-004")), ("OBJ003", at("TST-2026-01-004")), ("OBJ004", at("TST-2026-01-006")), ("ID002", alien), ("ID004", moved),
        ("SCHEMA002", at(alien)), ("SCHEMA004", at(alien)), ("GEN001", "TST-2026-01-005"), ("GEN002", moved), ("GEN003", alien), ("CONS001", moved), ("CONS002", alien), ("COPY001", moved),
    }


def test_packs_and_their_objects(spark, packs, tmp_path):
    root = str(tmp_path / "store")
    objects = objects_of(spark, ("p", "TST-2026-01-001", {"category": "lake"}), ("p", "TST-2026-01-002", {"category": "sea"}), ("q", "QQ-2026-01-001", {"category": "any"}))
    registry = Registry(spark, root)
    registry.record(objects.filter("pack = 'p'"), "r1")
    configs, sources = integrity.packs.read_configs(spark, str(packs))
    got = codes(integrity.pack_findings(configs, sources, objects, registry, ["p", "none"]))
    assert [(c, x) for c, x, _ in got] == [
        ("PACK000", "none"), ("PACK001", "s"), ("PACK001", "s"), ("PACK002", "q"), ("PACK003", "q"), ("PACK004", "q"), ("PACK004", "s"), ("PACK005", "r"), ("SCHEMA005", "TST-2026-01-002"), ("SEC002", "f"),
    ]


def test_the_registry(spark, tmp_path):
    root = str(tmp_path)
    objects = objects_of(spark, ("p", "TST-2026-01-001", {}), ("p", "TST-2026-01-007", {}), ("q", "OTH-2026-02-003", {}))
    assert codes(integrity.registry_findings(objects, Registry(spark, root))) == [("REG001", "registry", "error")]
    registry = Registry(spark, root)
    registry.record(objects, "r1")
    registry.record(objects, "r2")
    assert registry.paths().count() == 3 and sorted(map(tuple, registry.counters().collect())) == [("p", "2026-01", 7), ("q", "2026-02", 3)]
    assert codes(integrity.registry_findings(objects, registry)) == []
    more = objects.filter("id <> 'TST-2026-01-001'").unionByName(objects_of(spark, ("p", "TST-2026-01-009", {}), ("q", "OTH-2026-03-001", {})))
    assert [(c, x) for c, x, _ in codes(integrity.registry_findings(more, registry))] == [("REG002", "p/2026-01"), ("REG002", "q/2026-03"), ("REG003", "OTH-2026-03-001"), ("REG003", "TST-2026-01-009"), ("REG005", "TST-2026-01-001")]
    newest = sorted((tmp_path / "registry" / "versions").glob("0*.json"))[-1]
    newest.write_text("{nope")
    for crc in newest.parent.glob(".*.crc"):
        crc.unlink()
    assert codes(integrity.registry_findings(objects, registry)) == [("REG001", "registry", "error")]


def test_the_baseline(spark, tmp_path):
    root = str(tmp_path)
    again = lambda n, fields: REVISIONS[0] | {"revision": n, "date": date(2026, 2, n), "changed_fields": fields}
    revisions = [REVISIONS[0], *[again(n, ["title", "content_hash"] if n % 2 else ["content_hash", "title"]) for n in (2, 3, 4)]]
    store.insert_objects(objects_of(spark, ("p", "TST-2026-01-001", {"revisions": revisions}), ("p", "TST-2026-01-002", {})), f"{root}/objects")
    stored = store.read_objects(spark, f"{root}/objects")
    rev = lambda: [x for x in codes(integrity.findings(spark, root)) if x[0].startswith("REV")]
    assert rev() == [("REV002", "TST-2026-01-001", "warning")]
    assert main(["baseline", root, "--today", "2026-03-01"], spark) == 0 and rev() == [("REV002", "TST-2026-01-001", "info")]
    assert integrity.accept(stored, root, F.lit(date(2026, 4, 1))) == 0 and integrity.read_baseline(spark, root).first().accepted_on == date(2026, 3, 1)
    longer = objects_of(spark, ("p", "TST-2026-01-001", {"revisions": [*revisions, again(5, ["content_hash", "title"])]}))
    store.update_objects(longer, f"{root}/objects")
    assert rev() == [("REV002", "TST-2026-01-001", "warning"), ("REV003", "TST-2026-01-001", "warning")]


def test_a_run_records_its_identifiers_and_writes_its_digest(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    attempts = spark.createDataFrame([("blog", 0, "blog", "primary", True, 5, None), ("news", 0, "news", "primary", False, 0, "is down")], "source string, position int, name string, role string, ok boolean, items long, reason string")
    run = Run("p", "TST", "run-1", datetime(2026, 8, 2, 6))
    monkeypatch.setattr(store, "insert_objects", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        harvest(spark, root, run, items(spark, FIRST[:1]), RULES, attempts)  # dies with a number recorded
    monkeypatch.undo()
    report = harvest(spark, root, run, items(spark, FIRST), RULES, attempts)
    assert report["minted"] == 2 and {r.id for r in store.read_objects(spark, f"{root}/objects").collect()} == {"TST-2026-07-002", "TST-2026-07-003"}
    assert [(c, x) for c, x, _ in codes(integrity.findings(spark, root)) if c.startswith("REG")] == [("REG005", "TST-2026-07-001")]
    lines = [r[0] for r in spark.read.text(f"{root}/digests/pack=p/week=2026-W31").collect()]
    assert lines[:2] == ["# p: 2026-W31", "run run-1"] and "- news: is down" in lines and "- minted: 2" in lines and "- discovered: 5" in lines
    assert any(x.startswith("TST-2026-07-003 | ") for x in lines) and "- queued: 1" in lines
    assert main(["index", root, f"{root}/index"], spark) == 0
    waiting = [r[0] for r in spark.read.text(f"{root}/index/pack=p/document=review-queue").collect()]
    assert waiting[0].startswith("## 0 queued (1)") and any("A thing without a link" in x for x in waiting)
