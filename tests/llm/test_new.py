"""Centroids, periodic runs and URL filters."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import centroids, periodic, url_filter

from .test_native import HARD, clashing, docs, empty

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# --- centroids

VECTORS = "vec_id long, embedding array<double>, label int"


def whole(x):
    n, d = x.as_integer_ratio()
    return n * 64 // d


def slow_cluster(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) by plain integers."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    kept = [(i, [whole(e) for e in v]) for i, v in good]
    cs = [v for _, v in sorted((sha(f"1:{'' if i is None else i}"), v) for i, v in kept)][:k]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [assign(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *assign(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(cs))}
    small = lambda d: d if d <= centroids.LONG else None
    return [(i, j, small(d), small(inertia[j]), small(sum(inertia.values())), [str(e) for e in cs[j]]) for i, j, d in out]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, repr(r)))


def clustered(df, **kw):
    return order([tuple(r) for r in centroids.cluster(df, **kw).collect()])


def test_clusters_are_plain_integers(spark):
    rng = random.Random(7)
    corner = [rng.choice((-1.0, 1.0)) for _ in range(64)]
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(64)]) for k in range(150)]
    rows += [(1000 + k, [float(rng.randrange(2)) for _ in range(64)]) for k in range(60)]  # many equal distances
    rows += [(2000 + k % 4, corner) for k in range(120)]  # one vector with a third of all rows
    rows += [(None, corner), (None, [0.5] * 64), (3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65)]
    rows += [(3004, [None] + [1.0] * 63), (3005, [math.nan] + [1.0] * 63), (3006, [math.inf] + [1.0] * 63), (3007, [-0.001] * 64)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    assert clustered(df) == order(slow_cluster(rows))
    extra = df.select("*", *[F.lit(1).alias(n) for n in ("cluster", "distance", "c", "j", "hash", "ints")])
    assert clustered(extra) == order(slow_cluster(rows))
    got = centroids.digests(df).filter("vec_id = 3").first()
    want = next(r for r in slow_cluster(rows) if r[0] == 3)
    assert tuple(got) == (*want[:5], sha(",".join(want[5])))


@pytest.mark.parametrize("size", [2.0**17, 2.0**20, 2.0**40, 1e30, 1e300])
def test_clusters_of_any_size(spark, size):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) * (size if k % 5 == 0 else 1.0) for _ in range(64)]) for k in range(80)]
    assert clustered(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)) == order(slow_cluster(rows))


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert clustered(none) == [] and clustered(none.select("vec_id", "embedding")) == []
    assert clustered(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], VECTORS)) == []
    rows = [(k, [float(k)] * 64) for k in range(3)]
    assert clustered(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)) == order(slow_cluster(rows))
    floats = spark.createDataFrame([(f"v{k}", [float(k)] * 64) for k in range(20)], "name string, v array<float>")
    assert [r[1:] for r in clustered(floats, id_col="name", vector_col="v")] == [r[1:] for r in order(slow_cluster([(f"v{k}", [float(k)] * 64) for k in range(20)]))]


def test_intervals_hold_where_float32_does_not():
    rng = np.random.default_rng(5)
    cs = rng.integers(-(1 << 25), 1 << 25, (16, 64))
    cs[9] = cs[4]
    x = rng.integers(-(1 << 25), 1 << 25, (500, 64))
    x[:200] = cs[rng.integers(0, 16, 200)] + rng.integers(-1, 2, (200, 64))
    x[200:300] = (cs[3] + cs[11]) // 2 + rng.integers(-1, 2, (100, 64))
    of = centroids.Centroids(cs.tolist())
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in cs] for r in x], dtype=object)
    want = np.array([min((d, j) for j, d in enumerate(row))[1] for row in exact])
    assert (of.nearest(x, {}) == want).all()
    short = of.shortlist(x)
    assert short[np.arange(500), want].all() and short.sum() < 500 * 16 / 2
    assert of.distances(x, {}, want) == [row[j] for row, j in zip(exact, want, strict=True)]


@given(st.integers(-(1 << 200), 1 << 200))
def test_limbs(value):
    parts = list(centroids.limbs(value))
    assert sum(p << centroids.LIMB * k for k, p in parts) == value and all(-(1 << 63) <= p < 1 << 63 for _, p in parts)


# --- periodic runs


def slow_runs(w, least=6, exponent=4):
    """Every stretch with a smallest period that no neighbour extends, by trying all periods."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end - at + q >= max(least, exponent * q):
                found.setdefault((at, end + q - at), q)
            at = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_collapse(w):
    gone = {i for s, n, q in slow_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def slow_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=30))
def test_runs_are_all_periods(head, times, tail):
    for w in (head * times + tail, tail + head * times + tail * times, (head + tail) * times + head):
        n, runs, left = periodic.collapse(" ".join(w).encode())
        assert (n, runs, left.decode()) == (len(w), slow_runs(w), slow_collapse(w))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=25), st.integers(4, 40), st.data())
def test_runs_amid_other_words(root, times, data):
    noise = lambda tag: [f"{tag}{k}" for k in range(data.draw(st.integers(0, 30)))]
    w = noise("x") + root * times + root[: data.draw(st.integers(0, len(root)))] + noise("y") + root * 5 + noise("z")
    assert periodic.collapse(" ".join(w).encode())[1] == slow_runs(w)


def test_equal_hashes_are_not_relied_on(monkeypatch):
    monkeypatch.setattr(periodic.Texts, "hashed", lambda self, i, j, length: True)
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.choice("ab") for _ in range(rng.randrange(80))] * rng.choice((1, 1, 5))
        assert periodic.collapse(" ".join(w).encode())[1] == slow_runs(w)


def test_long_and_hostile_texts():
    f, g = ["a"], ["a", "b"]
    while len(g) < 20_000:
        f, g = g, g + f
    assert periodic.collapse(" ".join(g).encode())[1] == []  # no four periods in a Fibonacci word
    assert periodic.collapse(b"a " * 300_000) == (300_000, [(0, 300_000, 1)], b"a")
    root = [f"w{k}" for k in range(50_000)]
    assert periodic.collapse(" ".join(root * 4 + ["w0", "end"]).encode())[1] == [(0, 200_001, 50_000)]
    thue = [bin(k).count("1") % 2 for k in range(1 << 14)]  # where hashes modulo 2^64 meet
    assert periodic.collapse(" ".join(map(str, thue * 4)).encode())[1] == [(0, 4 << 14, 1 << 14)]


def slow_digest(doc_id, text):
    w = slow_planted(doc_id, words_of(text))
    runs = slow_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(slow_collapse(w)), len(w))


def test_periodic_digests(spark):
    rng = random.Random(11)
    texts = [*HARD, *HARD, "x y " * 40, "a a a a a a b", "a b c d " * 4 + "é é é é é é"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(t, k) for k, t in enumerate(texts)] + [("q r " * 9, None), (None, None), ("x x x x x x x", 7), ("x x x x x x x", 7)]
    df = docs(spark, rows)
    want = order([slow_digest(k, t) for t, k in rows])
    assert order([tuple(r) for r in periodic.digests(df).collect()]) == want
    assert order([tuple(r) for r in periodic.digests(clashing(df).withColumns({"runs": F.lit(1), "collapsed": F.lit(2)})).collect()]) == want
    assert periodic.digests(empty(spark)).collect() == []
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)


def test_periodic_runs_are_general(spark):
    df = spark.createDataFrame([("a", "k k k k k k k k"), ("b", None)], "name string, body string")
    got = {r.name: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in periodic.periodic_runs(df, "name", "body", least=8, exponent=5).collect()}
    assert got == {"a": ([(0, 8, 1)], "k", 8), "b": ([], "", 0)}
    assert not periodic.periodic_runs(df, "name", "body", least=9).filter("size(runs) > 0").count()
    with pytest.raises(ValueError, match="4 periods"):
        periodic.periodic_runs(df, exponent=3)


# --- URL filters

PAGES = "page_id long, url string, html string"


def slow_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda f: (f[0], f[1], f[3])) if fit else None
    return host, path, best and best[2], best[3] if best else default


def judged(df, **kw):
    return order([tuple(r) for r in url_filter.url_filter(df, **kw).collect()])


URLS = [
    None, "", "://", "no scheme.org/es/", "http://org/", "http://org", "https://example.org/es/1", "https://EXAMPLE.Org/es/1?x=://com/de/", "http://a.b.example.org/en/1", "http://a.example.org/en/12#/x",
    "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/FR/1", "http://x.com/de/?q", "http://com/de", "http://.com/de/", "http://x.com./de/", "ftp://u:p@x.com/de/", "http://x.com:80/de/", "http://É.com/fr/é",
    "http://x.org?/es/", "http://x.org#/es/", "a\nb://x.org/\n/es", "http://http://example.org/es/", "http://" + "a." * 3000 + "com/de/" + "z" * 5000, "http://" + "x" * 20000, "http:///es/",
]


def test_urls_are_judged_rule_by_rule(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(None, URLS[6], None), (5, URLS[6], "h"), (5, URLS[6], "h")]
    df = spark.createDataFrame(rows, PAGES)
    want = order([(k, *slow_verdict(u, url_filter.RULES)) for k, u, _ in rows])
    assert judged(df) == want
    extra = df.select("*", *[F.lit(1).alias(n) for n in ("host", "path", "rule", "verdict", "digest", "short", "salt", "__g0_id")])
    assert judged(extra) == want
    assert judged(spark.createDataFrame([], PAGES)) == []


def test_rules_of_every_shape(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 1)  # hash prefixes of 4 bits meet all the time
    rng = random.Random(4)
    label, part = lambda: rng.choice(("a", "b", "cc")), lambda: rng.choice(("/", "/x", "/x/", "/xy/z", "/é", ""))
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 5)))
    rules = {(host(), part() + part()): rng.choice(("allow", "block")) for _ in range(120)}
    listed = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(k, f"http://{host()}{part()}{part()}{part()}", "") for k in range(400)] + [(k, "http://a.b/x/y", "") for k in range(400, 900)]
    df = spark.createDataFrame(rows, PAGES)
    assert judged(df, rules=spark.createDataFrame(listed, url_filter.RULE_SCHEMA), default="block") == order([(k, *slow_verdict(u, listed, "block")) for k, u, _ in rows])


def test_rules_that_conflict_or_are_none(spark):
    df = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id long, url string")
    rules = lambda *r: spark.createDataFrame(r, url_filter.RULE_SCHEMA)
    assert judged(df, rules=rules(("ORG", "/", "allow"), ("org", "/", "block"), ("org", "/", "allow"))) == [(1, "x.org", "/a", "org/", "block"), (2, "", "", None, "allow")]
    assert judged(df, rules=rules(("org", None, "block")))[0] == (1, "x.org", "/a", "org", "block")
    assert judged(df, rules=rules(), default="block") == [(1, "x.org", "/a", None, "block"), (2, "", "", None, "block")]
    for wrong in (("org", "/", "deny"), ("org", "/", None), ("o/rg", "/", "block"), ("org", "/" * 3000, "block"), ("a." * 130 + "org", "/", "allow")):
        with pytest.raises(Exception, match="not a rule"):
            url_filter.url_filter(df, rules=rules(wrong)).collect()


def test_url_filter_uses_no_python(spark):
    plan = url_filter.url_filter(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
