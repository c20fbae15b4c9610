"""Quality rules, content sort and mixing."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm import content_sort, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [None, "", " \t\n", "a", "a b c", "x " * 5000, "one two\none two\n\none two", "é" * 300, "| | |\v|\f#$%", "\U0001f600 \U0001f600"]


def docs(spark, rows):
    full = [(k if len(r) < 2 else r[1], r[0], "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, [(t,) for t in HARD] + [(t,) for t in HARD] + [("tie", 3), ("tie", 3), ("t i e", 1), (None, None)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with the names that operators use."""
    names = ["size", "kept", "keep_id", "target", "taken", "__g0_size", "ids", "score", "h", "n", "spans", "fingerprint", "source_size"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def statistics(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics_are_those_of_brute_force(spark, hard):
    extra = docs(spark, [("a b c d e f g h i a b c d e f g h",), ("a b c d e f g h a b c d e f g h a b c d e f g h",), ("p q r s t u v w x y z " * 3,)])
    rows = quality.quality_rules(hard.unionByName(extra)).collect()
    texts = collections.defaultdict(list)
    for r in hard.unionByName(extra).collect():
        texts[r.doc_id].append(r.text)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in [statistics(t) for t in texts[r.doc_id]]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert len(rows) == hard.count() + 3


def prose(k, n=60):
    return " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest()[: 3 + int(hashlib.md5(f"{j}{k}".encode()).hexdigest()[0], 16) % 5] for j in range(n))


def test_outliers_go_and_clean_rows_stay(spark):
    clean = [(k, prose(k), "en", f"src{k % 2}") for k in range(500)]
    odd = [(1000 + k, " ".join(w + "***" for w in prose(k).split()), "en", f"src{k % 2}") for k in range(30)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(500)) and not any(kept[1000 + k] for k in range(30))


def test_small_groups_are_judged_by_their_language_or_by_all(spark):
    odd = lambda k: " ".join(w + "***" for w in prose(k).split())
    rows = [(k, prose(k), "en", "src0") for k in range(400)] + [(1000 + k, odd(k), "en", "rare") for k in range(20)] + [(2000, odd(50), "fr", "src0"), (2001, prose(51), "fr", "src0")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(400)) and kept[2001]
    assert not any(kept[1000 + k] for k in range(20)) and not kept[2000]


def slow_estimate(x, starts):
    """Mean, covariance and log determinant of the minimum-covariance-determinant subset of the rows of x, row by row, from the best of `starts` (sets of rows)."""
    n, h = len(x), round(quality.SUPPORT * len(x))
    floors = np.diag(np.square(list(quality.FLOORS.values())))
    q = quality.QUANTILE
    consistent = quality.SUPPORT / (1 - np.exp(-q / 2) * (1 + q / 2 + q**2 / 8))
    of = lambda rows, by: (rows.mean(0), by * np.cov(rows.T, bias=True) + floors)
    d2 = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    best = None
    for start in starts:
        mean, cov = of(x[start], consistent)
        for _ in range(60):
            mean, cov = of(x[np.argsort(d2(mean, cov), kind="stable")[:h]], consistent)
        found = (np.linalg.slogdet(cov)[1], mean, cov)
        best = found if best is None or found[0] < best[0] else best
    q = quality.REWEIGHED_QUANTILE
    again = quality.REWEIGHED / (1 - np.exp(-q / 2) * (1 + q / 2 + q**2 / 8))
    return best[0], d2(*of(x[d2(*best[1:]) <= q], again))


@pytest.mark.parametrize("seed", [1, 2])
def test_estimates_are_those_of_brute_force(spark, seed):
    """Against concentration steps row by row from 60 random subsets: as small a determinant, and the same distances and verdicts up to the boundary bin."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(4, 4)) * 0.4 + np.eye(4)
    x = rng.normal(size=(900, 4)) @ mix
    x[:150] = rng.normal(size=(150, 4)) * 0.3 + [9, -7, 8, 9]
    p = "__g0_"
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "__g0_g string, __g0_x0 double, __g0_x1 double, __g0_x2 double, __g0_x3 double")
    raw = quality._minimised(rows, p, quality.MOST_STEPS)
    got = np.array([r[0] for r in quality._with_distance(rows, raw, p).orderBy("__g0_x0").select("__g0_d2").collect()])
    det, want = slow_estimate(x[np.argsort(x[:, 0])], [rng.choice(900, 30, replace=False) for _ in range(60)])
    assert np.allclose(got, want, rtol=0.08, atol=0.05)
    assert ((got <= quality.CUTOFF) == (want <= quality.CUTOFF)).all() and (got > quality.CUTOFF).sum() >= 150


def test_levels_tell_whose_estimate_judged(spark):
    rows = [(k, prose(k), "en", "big" if k < 60 else f"s{k}") for k in range(70)] + [(100 + k, prose(200 + k), "fr", None) for k in range(5)] + [(200, "short", "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for least, want in ((60, (2, 1, 0)), (5, (2, 1, 2))):
        got = {r.doc_id: r.level for r in quality.quality_rules(df, least_rows=least, most_steps=1).collect()}
        assert (got[0], got[65], got[100]) == want and got[200] is None


def test_quality_kept_has_the_rows_and_columns_of_docs(spark, hard):
    df = clashing(hard.unionByName(docs(spark, [(prose(k),) for k in range(40)])))
    kept = quality.quality_kept(df)
    assert kept.columns == df.columns and kept.count() == quality.quality_rules(df).filter("kept").count() > 0


def test_content_sort_is_brute_force(spark, hard):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in content_sort.content_sort(hard).collect())
    groups = collections.defaultdict(list)
    for r in hard.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    want = collections.Counter()
    for text, rows in groups.items():
        rows = sorted(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for k, r in enumerate(rows):
            want[r.doc_id, rows[0].doc_id, len(rows), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_content_sort_splits_heavy_texts(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "RUN", 10)
    rows = docs(spark, [("same  text" if k % 9 else "same text ",) for k in range(200)] + [(f"t{k}",) for k in range(30)])
    got = content_sort.content_sort(rows).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(hot) == 200 and {(r.keep_id, r.group_size) for r in hot} == {(1, 200)} or {(r.keep_id, r.group_size) for r in hot} == {(0, 200)}
    assert sum(r.kept for r in hot) == 1 and sum(r.kept for r in got) == 31
    assert content_sort.content_sort(rows, carry=True).count() == 31


def test_content_sort_carries_columns(spark, hard):
    df = clashing(hard)
    kept = content_sort.content_sort(df, carry=True)
    assert kept.columns == df.columns and kept.count() == content_sort.content_sort(df).filter("kept").count()


def test_mixing_cuts_at_budgets(spark, hard):
    rows = docs(spark, [("w " * (1 + k % 17),) for k in range(300)] + [(None,)])
    got = mixing.mix(rows).collect()
    sizes, taken = sum(r["size"] for r in got), sum(r.taken for r in got)
    assert abs(taken - 1.5 * sizes) <= 10 and all(r.taken <= 2 * r["size"] for r in got)
    source = {r.doc_id: r.source for r in rows.collect()}
    by = collections.Counter()
    for r in got:
        by[source[r.doc_id]] += r.taken
    for r in got:
        assert by[source[r.doc_id]] == int(r.target) and r.target <= 2 * r.source_size
    again = {r.doc_id: r.taken for r in mixing.mix(rows.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(hard).count() == hard.count()


def test_mixed_holds_the_words_taken(spark):
    rows = clashing(docs(spark, [("w " * (1 + k % 17),) for k in range(100)] + [("",), (None,)]))
    got = mixing.mixed(rows)
    words = got.select(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).first()[0]
    assert got.columns == rows.columns and words == mixing.mix(rows).agg(F.sum("taken")).first()[0]


def test_no_rows(spark):
    for f in (quality.quality_rules, quality.quality_kept, content_sort.content_sort, mixing.mix, mixing.mixed):
        assert f(empty(spark)).count() == 0
