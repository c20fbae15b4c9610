"""Quality rules: fixed rules first, then robust multivariate outliers.

Word and line statistics of every whole text are transformed to a vector, its minimum-covariance-determinant mean and
covariance are estimated per language and source, and rows with a large Mahalanobis distance are rejected. DataFrame
operations only: each text is read once, and the concentration steps run over the small table of vectors.

Estimation follows the deterministic form of the method. Medians and quartile distances give three starts: scales
alone, with correlations of the hyperbolic tangents, and with spatial signs. Each takes two concentration steps, of each
group the start of the least determinant goes on until its determinant falls no more, and the rows within the 97.5 %
ellipsoid of that estimate give the last one (the reweighting step). A concentration step groups the rows of a group by
binned distance and sums moments for each bin (partial sums on the map side, so a hot group is no one's burden), and the
bins up to the wanted share of rows, the last of them in proportion, give the next mean and covariance. A bin spans 4.4 %
of squared distance, so rows of the boundary bin alone are weighed by a share instead of being taken or left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, forget, let, materialize, prefix, quoted, words

#: Share of rows that the estimate rests on.
SUPPORT = 0.75
#: Concentration steps that every start takes, and that the best of a group's takes at most; it ends when no group's log determinant falls by FALL.
FIRST_STEPS, MOST_STEPS, FALL = 2, 20, 1e-3
#: A language and source of fewer rows uses its language's estimate; a language of fewer, that of all rows. The column `level` tells which.
LEAST_ROWS = 200
#: Squared distances above this are rejected: the chi-squared quantile (4 degrees of freedom) at 1 - 2e-14, so that of 100 billion rows of a normal law less than one is expected to go.
CUTOFF = 70.0
#: The vector's parts and the least standard deviation of each: a part that is the same in most rows has none of its own.
FLOORS = {"length": 0.08, "symbols": 0.15, "lines": 0.12, "repeats": 0.12}
#: Of a chi-squared variable with 4 degrees of freedom, the SUPPORT quantile.
QUANTILE = 5.385269
#: The share of rows that the reweighting step rests on, and its quantile.
REWEIGHED, REWEIGHED_QUANTILE = 0.975, 11.143287


def _repeat_words(w: Column) -> Column:
    """Words within 8-word windows that occur twice or more. Windows are equal when their 64-bit hashes are."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda i, j: sorted_windows[i]["h"] == sorted_windows[j]["h"]
        again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(i, F.least(i + 1, n - 1))))
        places = F.sort_array(F.transform(again, lambda i: sorted_windows[i]["i"]))
        start = F.struct(F.lit(-8).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(8), x - acc["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of_windows(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(let(pairs, covered))

    # Hashes of 2, then 4, then 8 words in a row; those that would pass the end are cut off.
    doubled = lambda h, by: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by)))
    eights = lambda h: let(doubled(h, 1), lambda h2: let(doubled(h2, 2), lambda h4: F.slice(doubled(h4, 4), F.lit(1), F.size(h) - 7)))
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < 9, 0).otherwise(let(hashes, lambda h: let(eights(h), of_windows)))


def statistics(text: Column) -> Column:
    """A struct of a text's words and repeated words (w.n, w.r), its lines and repeated lines (l.n, l.d), word_chars and n_symbols (null: of no words)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    return F.struct(
        of_words.alias("w"),
        F.length(F.regexp_replace(text, f"{WS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    )


def vector(n_words: Column, word_chars: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    """The transformed statistics: word length, shares of symbols, of repeated lines and of repeated words. Each is damped by a few words or lines, so that short texts do not scatter."""
    return {
        "length": F.log((word_chars + 100.0) / (n_words + 20.0)) * 2.0,
        "symbols": F.log1p(20.0 * n_symbols / (n_words + 20.0)),
        "lines": F.log1p(4.0 * n_dup_lines / (n_lines + 4.0)),
        "repeats": F.log1p(4.0 * n_repeat_words / (n_words + 20.0)),
    }


D = range(len(FLOORS))
PAIRS = [(i, j) for i in D for j in D if j <= i]


def _cholesky(est: DataFrame, p: str) -> DataFrame:
    """Columns of c{i}{j}, a positive definite matrix, to l{i}{j}, its lower factor, and det, its log determinant; of each group g and start k."""
    for i, j in PAIRS:
        left = F.col(f"{p}c{i}{j}")
        for k in range(j):
            left = left - F.col(f"{p}l{i}{k}") * F.col(f"{p}l{j}{k}")
        est = est.withColumn(f"{p}l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"{p}l{j}{j}"))
    det = sum((2 * F.log(F.col(f"{p}l{i}{i}")) for i in D), F.lit(0.0))
    return est.select(F.col(p + "g"), F.col(p + "k"), det.alias(p + "det"), *[F.col(f"{p}m{i}") for i in D], *[F.col(f"{p}l{i}{j}") for i, j in PAIRS])


def _with_distance(rows: DataFrame, est: DataFrame, p: str) -> DataFrame:
    """rows with d2, their squared distance from their group's estimate, and the estimate's k; a row for each of the group's estimates: forward substitution."""
    rows = rows.join(est, p + "g", "left")
    for i in D:
        left = F.col(f"{p}x{i}") - F.col(f"{p}m{i}")
        for k in range(i):
            left = left - F.col(f"{p}l{i}{k}") * F.col(f"{p}z{k}")
        rows = rows.withColumn(f"{p}z{i}", left / F.col(f"{p}l{i}{i}"))
    d2 = F.lit(0.0)
    for i in D:
        d2 = d2 + F.col(f"{p}z{i}") * F.col(f"{p}z{i}")
    return rows.withColumn(p + "d2", d2).drop(*[f"{p}z{i}" for i in D], *[c for c in est.columns if c not in (p + "g", p + "k")])


def _starts(rows: DataFrame, p: str) -> DataFrame:
    """Three estimates a group: medians, and as scatter quartile distances alone (k 0), with correlations of tanh (1), with spatial signs (2)."""
    quartiles = [F.percentile_approx(f"{p}x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"{p}q{i}") for i in D]
    centre = rows.groupBy(p + "g").agg(*quartiles)
    scale = lambda i, floor: F.sqrt(F.pow((F.col(f"{p}q{i}")[2] - F.col(f"{p}q{i}")[0]) / 1.349, 2) + floor**2)
    centre = centre.select(p + "g", *[F.col(f"{p}q{i}")[1].alias(f"{p}m{i}") for i in D], *[scale(i, f).alias(f"{p}s{i}") for i, f in enumerate(FLOORS.values())])
    centre = materialize(centre, "quality-centre")
    z = rows.join(centre, p + "g").select(p + "g", *[((F.col(f"{p}x{i}") - F.col(f"{p}m{i}")) / F.col(f"{p}s{i}")).alias(f"{p}z{i}") for i in D])
    norm = F.greatest(F.sqrt(sum((F.col(f"{p}z{i}") * F.col(f"{p}z{i}") for i in D), F.lit(0.0))), F.lit(1e-9))
    t, u = [F.tanh(F.col(f"{p}z{i}")) for i in D], [F.col(f"{p}z{i}") / norm for i in D]
    sums = [F.avg(t[i]).alias(f"{p}t{i}") for i in D] + [F.avg(t[i] * t[j]).alias(f"{p}t{i}{j}") for i, j in PAIRS] + [F.avg(u[i] * u[j]).alias(f"{p}u{i}{j}") for i, j in PAIRS]
    est = centre.join(z.groupBy(F.col(p + "g").alias(p + "of")).agg(*sums), F.col(p + "g") == F.col(p + "of"))
    cov = {(i, j): F.col(f"{p}t{i}{j}") - F.col(f"{p}t{i}") * F.col(f"{p}t{j}") for i, j in PAIRS}
    kinds = (
        lambda i, j: F.lit(1.0 if i == j else 0.0),
        lambda i, j: F.lit(1.0) if i == j else cov[i, j] / F.sqrt((cov[i, i] + 1e-3) * (cov[j, j] + 1e-3)),
        lambda i, j: len(D) * F.col(f"{p}u{i}{j}") + (0.05 if i == j else 0.0),
    )
    of_kind = lambda f: F.struct(*[(f(i, j) * F.col(f"{p}s{i}") * F.col(f"{p}s{j}")).alias(f"{p}c{i}{j}") for i, j in PAIRS])
    est = est.select(p + "g", *[f"{p}m{i}" for i in D], F.posexplode(F.array(*map(of_kind, kinds))).alias(p + "k", p + "c"))
    return _cholesky(est.select("*", p + "c.*"), p)


def _from_sums(est: DataFrame, p: str, share: float, quantile: float) -> DataFrame:
    """Sums n, s{i} and s{i}{j} of the nearest `share` of a normal law's rows to its mean and covariance, which lie within the squared distance `quantile`."""
    n = F.col(p + "n")
    est = est.withColumns({f"{p}m{i}": F.col(f"{p}s{i}") / n for i in D})
    consistent = share / (1 - math.exp(-quantile / 2) * (1 + quantile / 2 + quantile**2 / 8))
    floors = list(FLOORS.values())
    for i, j in PAIRS:
        cov = consistent * (F.col(f"{p}s{i}{j}") / n - F.col(f"{p}m{i}") * F.col(f"{p}m{j}"))
        est = est.withColumn(f"{p}c{i}{j}", F.greatest(cov, F.lit(0.0)) + floors[i] ** 2 if i == j else cov)
    return _cholesky(est, p)


def _moments(p: str) -> list[Column]:
    x = [F.col(f"{p}x{i}") for i in D]
    return [F.count("*").alias(p + "n"), *[F.sum(x[i]).alias(f"{p}s{i}") for i in D], *[F.sum(x[i] * x[j]).alias(f"{p}s{i}{j}") for i, j in PAIRS]]


def _step(rows: DataFrame, est: DataFrame, p: str) -> DataFrame:
    """One concentration step, written: mean and covariance of the SUPPORT share of each group's rows nearest to each of its estimates."""
    g, k, n = F.col(p + "g"), F.col(p + "k"), F.col(p + "n")
    near = _with_distance(rows, est, p).withColumn(p + "bin", F.floor(16 * F.log2(F.col(p + "d2") + 2.0**-10)))
    # Written, so that partial sums are dealt by bin: what the windows below order is a few hundred rows for each estimate.
    bins = materialize(near.groupBy(g, k, p + "bin").agg(*_moments(p)), "quality-bins")
    upto = Window.partitionBy(g, k).orderBy(p + "bin").rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy(g, k).orderBy(p + "bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    written = bins
    bins = bins.withColumns({p + "before": F.coalesce(F.sum(n).over(upto), F.lit(0)), p + "all": F.sum(n).over(of_group)})
    weight = F.least(F.greatest((F.col(p + "all") * SUPPORT - F.col(p + "before")) / n, F.lit(0.0)), F.lit(1.0))
    bins = bins.withColumn(p + "w", weight)
    sums = [p + "n", *[f"{p}s{i}" for i in D], *[f"{p}s{i}{j}" for i, j in PAIRS]]
    est = materialize(_from_sums(bins.groupBy(g, k).agg(*[F.sum(F.col(s) * F.col(p + "w")).alias(s) for s in sums]), p, SUPPORT, QUANTILE), "quality-steps")
    forget(written)
    return est


def _least(est: DataFrame, p: str) -> DataFrame:
    """Of each group, the estimate of the least determinant."""
    rest = [c for c in est.columns if c not in (p + "g", p + "det", p + "k")]
    best = est.groupBy(p + "g").agg(F.min(F.struct(p + "det", p + "k", *rest)).alias(p + "best"))
    return best.select(p + "g", *[F.col(f"{p}best.{c}").alias(c) for c in (p + "k", p + "det", *rest)])


def _minimised(rows: DataFrame, p: str, most_steps: int) -> DataFrame:
    """The estimate of each group of rows: starts, concentration steps, the least determinant, reweighting."""
    est = materialize(_starts(rows, p), "quality-starts")
    for _ in range(FIRST_STEPS):
        before, est = est, _step(rows, est, p)
        forget(before)
    before, est = est, materialize(_least(est, p), "quality-best")
    forget(before)
    for _ in range(most_steps):
        # A step that the bins make worse is not taken.
        step = _step(rows, est, p)
        both = est.unionByName(step.withColumn(p + "k", F.col(p + "k") + 1))
        better = materialize(_least(both, p), "quality-best")
        forget(step)
        falls = est.join(better.select(F.col(p + "g").alias(p + "of"), F.col(p + "det").alias(p + "now")), F.col(p + "g") == F.col(p + "of"))
        fall = falls.agg(F.max(F.col(p + "det") - F.col(p + "now"))).first()[0]
        forget(est)
        est = better
        if fall is None or fall < FALL:
            break
    near = _with_distance(rows, est, p).filter(F.col(p + "d2") <= REWEIGHED_QUANTILE)
    last = materialize(_from_sums(near.groupBy(p + "g", p + "k").agg(*_moments(p)), p, REWEIGHED, REWEIGHED_QUANTILE), "quality-estimate")
    forget(est)
    return last


def _described(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[Column], p: str) -> DataFrame:
    """The columns `keep` of docs with statistics, base_failed and vector, named with p."""
    text, lang, source = quoted([text_col, lang_col, source_col])
    rows = docs.select(*keep, lang.alias(p + "lang"), source.alias(p + "source"), statistics(text).alias(p + "s"))
    names = {"n_words": "w.n", "n_repeat_words": "w.r", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "l.n", "n_dup_lines": "l.d"}
    rows = rows.withColumns({p + k: F.col(f"{p}s.{v}") for k, v in names.items()}).drop(p + "s")
    failed = (F.col(p + "n_words") < 20) | (100 * F.col(p + "n_repeat_words") > 30 * F.col(p + "n_words"))
    rows = rows.withColumn(p + "base_failed", failed)
    parts = vector(*[F.col(p + c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
    return rows.withColumns({f"{p}x{i}": c for i, c in enumerate(parts.values())})


def _estimates(rows: DataFrame, p: str, least_rows: int, most_steps: int) -> tuple[DataFrame, DataFrame]:
    """Of described rows: which estimate each language and source has, with its level, and the estimates."""
    good = rows.filter(~F.col(p + "base_failed"))
    sizes = good.groupBy(F.col(p + "lang").alias(p + "l"), F.col(p + "source").alias(p + "r")).agg(F.count("*").alias(p + "n"))
    sizes = sizes.withColumn(p + "of_lang", F.sum(p + "n").over(Window.partitionBy(p + "l")))
    level = F.when(F.col(p + "n") >= least_rows, 2).when(F.col(p + "of_lang") >= least_rows, 1).otherwise(0)
    part = lambda c: F.concat(F.coalesce(F.length(c), F.lit(-1)), F.lit(":"), F.coalesce(c, F.lit("")))
    lang, source = part(F.col(p + "l")), part(F.col(p + "r"))
    names = F.array(F.lit("0//"), F.concat(F.lit("1/"), lang, F.lit("/")), F.concat(F.lit("2/"), lang, F.lit("/"), source))
    groups = materialize(sizes.select(p + "l", p + "r", level.alias(p + "level"), F.get(names, level).alias(p + "g"), names.alias(p + "all_g")), "quality-groups")
    # All good rows of a language, and all good rows, are what the estimates used for small groups rest on.
    used = groups.select(p + "g").distinct()
    shares = groups.select(p + "l", p + "r", F.explode(p + "all_g").alias(p + "g")).join(used, p + "g", "left_semi")
    vectors = good.select(p + "lang", p + "source", *[f"{p}x{i}" for i in D]).join(shares, _in_group(p))
    return groups.drop(p + "all_g"), _minimised(vectors, p, most_steps)


def _in_group(p: str) -> Column:
    return F.col(p + "lang").eqNullSafe(F.col(p + "l")) & F.col(p + "source").eqNullSafe(F.col(p + "r"))


def _judged(rows: DataFrame, groups: DataFrame, est: DataFrame, p: str, cutoff: float) -> DataFrame:
    """Described rows with d2 (null where the base rules failed) and kept."""
    # A row of a group in which no row passed the base rules has failed them too, so it needs no estimate.
    rows = _with_distance(rows.join(groups, _in_group(p), "left"), est, p)
    d2 = F.when(~F.col(p + "base_failed"), F.col(p + "d2"))
    return rows.withColumns({p + "d2": d2, p + "kept": F.coalesce(d2 <= cutoff, F.lit(False))})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS, cutoff: float = CUTOFF, most_steps: int = MOST_STEPS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance and level (both null where the base rules failed), a row for each row of docs.

    level tells whose estimate judged the row: 2 that of its language and source, 1 (fewer than least_rows good rows there) of
    its language, 0 (fewer there too) of all rows. Null text is a text of no words, which the base rules reject. Null languages
    and sources are groups of their own. Rows that repeat are judged alike; extra columns are ignored; no rows give no rows.
    """
    ident = F.col(f"`{id_col}`")
    p = prefix(docs)
    rows = materialize(_described(docs, text_col, lang_col, source_col, [ident], p), "quality")
    rows = _judged(rows, *_estimates(rows, p, least_rows, most_steps), p, cutoff)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    level = F.when(~F.col(p + "base_failed"), F.col(p + "level"))
    return rows.select(ident.alias("doc_id"), *[F.col(p + c).alias(c) for c in longs], F.col(p + "base_failed").alias("base_failed"), F.col(p + "kept").alias("kept"), F.sqrt(p + "d2").alias("distance"), level.alias("level"))


def quality_kept(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS, cutoff: float = CUTOFF, most_steps: int = MOST_STEPS) -> DataFrame:
    """The rows of docs that quality_rules() keeps, in docs' columns. Texts are read twice, for the estimates and for the verdicts, and never written."""
    p = prefix(docs)
    vectors = [p + "lang", p + "source", p + "base_failed", *[f"{p}x{i}" for i in D]]
    small = materialize(_described(docs, text_col, lang_col, source_col, [], p).select(*vectors), "quality")
    groups, est = _estimates(small, p, least_rows, most_steps)
    forget(small)
    rows = _judged(_described(docs, text_col, lang_col, source_col, quoted(docs.columns), p), groups, est, p, cutoff)
    return rows.filter(p + "kept").select(*quoted(docs.columns))
