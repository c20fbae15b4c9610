"""Nearest centroids by float32 screening with rigorous rounding-error intervals, and exact integer rounds.

Vectors become integers, floor(SCALE * x). To compare a vector's distances to the centroids, |c|^2 - 2 x.c is enough. A
float32 matrix product gives all x.c of a batch with an error of at most gamma(64 + 2) |x| |c|, whatever the order of
summation (Higham: gamma(k) = k u / (1 - k u), u = 2^-24; two more for rounding both factors to float32). Each centroid's
value so lies in a known interval. A vector whose least interval overlaps no other has its centroid; for the others, the
overlapping centroids are compared again in exact integers, the lowest number first among equals.

Batches are reduced to sums by centroid within their task; only those, 16 x 64 numbers, are shuffled. The driver holds
the centroids and nothing that grows with the rows, so a cluster of any share of the rows costs no task more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Integers below this have squared distances of 64 components within an int64.
SMALL = 1 << 26
#: Sums leave a task in limbs of so many bits, so that sums of any size are exact.
LIMB = 60
LONG = (1 << 63) - 1


def kept_rows(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the lists that have `width` components, none of them null or non-finite."""
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), width).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at, pa.int64())).flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(at), width)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly; scale is a power of two."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def to_integers(x: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) as int64, and the rows with a component of SMALL or more as Python integers by row number; those are zero in the matrix."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    large = np.flatnonzero((np.abs(y) >= SMALL).any(axis=1))
    big = {int(r): [_whole(v, scale) for v in x[r]] for r in large}
    y[large] = 0
    return y.astype(np.int64), big


def exact_distance(x: list[int], c: list[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))


class Centroids:
    """Numbered centroids (lists of integers) and the nearest of each vector."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = np.array([max(map(abs, c)) < SMALL for c in rows])
        self.ints = np.array([c if s else [0] * len(c) for c, s in zip(rows, self.small, strict=True)], np.int64)
        self.squares = (self.ints**2).sum(axis=1)
        k = self.ints.shape[1] + 2
        self.gamma = k * 2.0**-24 / (1 - k * 2.0**-24)
        self.single = np.ascontiguousarray(self.ints.T.astype(np.float32))

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """For each row of integers below SMALL, which centroids may be nearest; of centroids beyond SMALL, all may."""
        product = (x.astype(np.float32) @ self.single).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(self.squares.astype(np.float64))[None, :]
        squares = self.squares.astype(np.float64)[None, :]
        value = squares - 2 * product
        # The last term covers the roundings of this function's own float64 arithmetic, the factor those of the norms.
        error = 2 * self.gamma * norms * (1 + 2.0**-20) + 2.0**-48 * (squares + 2 * np.abs(product))
        low, high = np.where(self.small, value - error, -np.inf), np.where(self.small, value + error, np.inf)
        return low <= high.min(axis=1)[:, None]

    def nearest(self, x: np.ndarray, big: dict[int, list[int]]) -> np.ndarray:
        """The number of the nearest centroid of each row; the smallest of those at the same distance."""
        short = self.shortlist(x)
        got = short.argmax(axis=1)
        row, c = np.nonzero(short & (short.sum(axis=1) > 1)[:, None])  # by row, then by number
        if len(row):
            exact = self.squares[c] - 2 * np.einsum("ij,ij->i", x[row], self.ints[c])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(exact, first)
            size = np.diff(np.append(first, len(row)))
            hit = np.flatnonzero(exact == np.repeat(least, size))
            got[row[first]] = c[hit[np.searchsorted(hit, first)]]
        if not self.small.all():
            for r in row[np.flatnonzero(np.diff(row, prepend=-1))].tolist():
                if r not in big:
                    got[r] = self._plain(x[r].tolist(), np.flatnonzero(short[r]))
        for r, v in big.items():
            got[r] = self._plain(v, range(len(self.rows)))
        return got

    def _plain(self, x: list[int], numbers) -> int:
        return min((exact_distance(x, self.rows[j]), int(j)) for j in numbers)[1]

    def distances(self, x: np.ndarray, big: dict[int, list[int]], got: np.ndarray) -> list[int]:
        """Squared distances to the centroids `got`, exact whatever their size."""
        out = ((x - self.ints[got]) ** 2).sum(axis=1).tolist()
        for r in {*big, *np.flatnonzero(~self.small[got]).tolist()}:
            out[r] = exact_distance(big.get(r) or x[r].tolist(), self.rows[got[r]])
        return out


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(k, limb) with value = sum of limb * 2^(LIMB * k), each limb a long."""
    k = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value >>= LIMB
        k += 1
    yield k, value


def initial(vectors: DataFrame, id_col: str, vector_col: str, k: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """The k kept vectors with the smallest SHA-256 of `1:<id>`, by hash, then by components; fewer where fewer are kept. A null id counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, column in ((b.column(0), b.column(1)) for b in batches):
            at, x = kept_rows(column, width)
            names = [hashlib.sha256(f"1:{'' if v is None else v}".encode()).hexdigest() for v in ids.take(pa.array(at, pa.int64())).to_pylist()]
            # Of this batch no row beyond its own k smallest hashes, with all that tie with the last, can be among the k.
            last = sorted(names)[:k][-1:] or [""]
            best = sorted((names[r], [_whole(v, scale) for v in x[r]]) for r in range(len(at)) if names[r] <= last[0])[:k]
            rows = [[h for h, _ in best], [[str(v) for v in ints] for _, ints in best]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.list_(pa.string()))], names=["hash", "ints"])

    each = vectors.select(quoted([id_col])[0].cast("string"), *quoted([vector_col])).mapInArrow(run, "hash string, ints array<string>")
    order = F.transform("ints", lambda v: v.cast("double"))
    return [[int(v) for v in r.ints] for r in each.orderBy("hash", order, "ints").limit(k).collect()]


def _sums(vectors: DataFrame, vector_col: str, centroids: Centroids, distances: bool, width: int, scale: int) -> dict[tuple[int, int], int]:
    """(centroid, component): sums of the components of its vectors (component -1: how many they are), or with `distances`, of their distances (component 0)."""
    n = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, width), object)
        counts = np.zeros(n, np.int64)
        for batch in batches:
            x, big = to_integers(kept_rows(batch.column(0), width)[1], scale)
            got = centroids.nearest(x, big)
            counts += np.bincount(got, minlength=n)
            if distances:
                for c, d in zip(got.tolist(), centroids.distances(x, big, got), strict=True):
                    sums[c, 0] += d
            elif len(got):
                order = np.argsort(got, kind="stable")
                present, first = np.unique(got[order], return_index=True)
                sums[present] += np.add.reduceat(x[order], first, axis=0).astype(object)
                for r, v in big.items():
                    sums[got[r]] += np.array(v, object)
        used = 1 if distances else width
        rows = [(c, j, k, part) for c in range(n) for j in range(-1, used) for k, part in limbs(int(counts[c] if j < 0 else sums[c, j])) if part]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["c", "j", "limb", "part"])

    parts = vectors.select(*quoted([vector_col])).mapInArrow(run, "c long, j long, limb long, part long")
    total = parts.groupBy("c", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], int] = {}
    for r in total.collect():  # at most centroids x (components + 1) x limbs
        out[r.c, r.j] = out.get((r.c, r.j), 0) + (int(r.total) << LIMB * r.limb)
    return out


def fit(vectors: DataFrame, id_col: str, vector_col: str, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> list[list[int]]:
    """The centroids after `rounds` rounds: each replaces every centroid by floor(sum / count) of its vectors; those without vectors stay."""
    rows = initial(vectors, id_col, vector_col, k, width, scale)
    for _ in range(rounds if rows else 0):
        sums = _sums(vectors, vector_col, Centroids(rows), False, width, scale)
        rows = [[sums.get((c, j), 0) // sums[c, -1] for j in range(width)] if sums.get((c, -1)) else rows[c] for c in range(len(rows))]
    return rows


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia and centroid (array of decimal integers as text) for each vector that is kept.

    Vectors that are null, have another number of components than `width`, or any that is null or non-finite, are left out, and do
    not count anywhere. Rows that repeat stay rows of their own, with each their weight. A null identifier counts as
    empty where vectors are chosen, and is returned as null. Of equal hashes the smaller components go first. With fewer
    than k kept vectors there are fewer centroids, and with none, no rows. Extra columns are ignored. Components are of any
    size; a distance or inertia that is beyond a long is null. scale: a power of two.
    """
    rows = fit(vectors, id_col, vector_col, k, rounds, width, scale)
    id_type = vectors.select(*quoted([id_col])).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, cluster int, distance long"
    if not rows:
        none = vectors.sparkSession.createDataFrame([], schema)
        return none.select("*", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.array().cast("array<string>").alias("centroid"))
    centroids = Centroids(rows)
    sums = _sums(vectors, vector_col, centroids, True, width, scale)
    inertia = [sums.get((c, 0), 0) for c in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = kept_rows(batch.column(1), width)
            ints, big = to_integers(x, scale)
            got = centroids.nearest(ints, big)
            distances = [d if d <= LONG else None for d in centroids.distances(ints, big, got)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(got, pa.int32()), pa.array(distances, pa.int64())], names=[id_col, "cluster", "distance"])

    long = lambda v: F.lit(v if v <= LONG else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return vectors.select(*quoted([id_col, vector_col])).mapInArrow(run, schema).select(
        "*",
        of([long(v) for v in inertia]).alias("cluster_inertia"),
        long(sum(inertia)).alias("inertia"),
        of([F.array(*[F.lit(str(v)) for v in c]) for c in rows]).alias("centroid"),
    )


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, from cluster()."""
    rows = cluster(vectors)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _round(r: int) -> str:
    """Assign by the centroids c{r}, and from that the centroids c{r + 1}."""
    return f"""
d{r} AS (SELECT v.k, v.vec_id, v.x, c.c, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS distance FROM v, c{r} c),
a{r} AS (SELECT k, vec_id, x, c, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, c) = 1),
s{r} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range({WIDTH})) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c)"""


ORACLE_SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH}
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {CENTROIDS}),{",".join(_round(r) for r in range(ROUNDS + 1))}
SELECT vec_id, a.c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} f ON a.c = f.c
"""
