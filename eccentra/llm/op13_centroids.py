"""Centroid clustering with PCA-rotated filtering, exact in integers.

Every vector is kept as integers ``floor(SCALE * x)`` beside a *sketch*: its first
``LEAD`` coordinates in the frame of the vectors' principal axes and the norm of
what these leave over. For a vector v and a centroid c,

    |v - c|^2 >= |lead(v) - lead(c)|^2 + (rest(v) - rest(c))^2

as a rotation keeps distances and norms differ by no more than the vectors do.
Centroids are taken in the order of that bound; one whose bound lies above the
best distance found so far cannot win, the others are measured in integers. The
bound is lowered by far more than rounding can add, so the filter only saves
work: assignments are those of an exhaustive search, ties to the smaller number.

The axes come from sums and products over all vectors, added up per task and
then by Spark; the driver solves one ``dim`` x ``dim`` system and holds ``k``
centroids, whatever the number of vectors. Updates are sums per cluster and
component, made per task first, so a hot cluster is no large group. Components
of any size are summed in parts of 30 bits and put together exactly; where
vectors are so long that squares could pass 62 bits (``WIDE``), distances are
taken in Python's whole numbers, and one that does not fit a long is null.

Vectors with another number of components, or with a null, NaN or infinite one,
are left out. Repeated rows are vectors like others; a null id hashes as the empty
text. With fewer vectors than ``k`` all are starts. Starts of equal id are
ordered by their components. Extra columns are ignored; no vectors, no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import by_value, discard, keep, table

by_value(__name__)

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Rotated coordinates kept with a vector.
LEAD = 12
WIDE = 1 << 27
LIMB = 30
#: Vectors handled at once.
ROWS = 8192

STORED = "vec_id long, v array<bigint>, w array<double>, lead array<double>, rest double"


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)


def exact(row) -> list[int]:
    return [whole(x) for x in row]


def usable(vectors: DataFrame, dim: int, column: str) -> DataFrame:
    """(vec_id, x): vectors of ``dim`` finite components, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter((F.size("x") == dim) & ~bad)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def axes(rows: DataFrame, dim: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first principal axes (columns), from sums over all rows."""

    def partial(batches):
        n, s, g, size = 0, np.zeros(dim), np.zeros((dim, dim)), 0.0
        for batch in batches:
            x = np.clip(matrix(batch.column("x"), dim), -1e100, 1e100)  # a longer vector only turns the axes less
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim + dim + 1)), pa.array(np.concatenate([g.ravel(), s, [n]]))], ["i", "t"])

    sums = rows.select("x").mapInArrow(partial, "i long, t double").groupBy("i").agg(F.sum("t").alias("t")).toArrow()  # dim * (dim + 1) + 1 rows
    if not sums.num_rows:
        return np.zeros(dim), np.eye(dim, lead)
    flat = np.zeros(dim * dim + dim + 1)
    flat[sums.column("i").to_numpy()] = sums.column("t").to_numpy()
    n, mean = flat[-1], flat[dim * dim:-1] / flat[-1]
    cov = flat[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean)
    if not np.isfinite(cov).all():
        return np.zeros(dim), np.eye(dim, lead)
    return mean, np.linalg.eigh(cov)[1][:, ::-1][:, :lead]


def sketches(ints: np.ndarray, centre: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest, taken from the rest itself: squares that nearly cancel would lose its digits."""
    moved = ints - centre
    lead = moved @ basis
    return lead, np.sqrt(((moved - lead @ basis.T) ** 2).sum(axis=1))


def stored(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, dim: int) -> DataFrame:
    centre = SCALE * mean

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            wide = np.abs(x).max(axis=1, initial=0) * SCALE >= WIDE
            ints = np.floor(SCALE * np.where(wide[:, None], 0.0, x))
            lead, rest = sketches(ints, centre, basis)
            offsets = np.arange(0, dim * (len(x) + 1), dim, dtype=np.int32)
            v = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ints.astype(np.int64).ravel()), mask=pa.array(wide))
            w = pa.array([r.tolist() if far else None for r, far in zip(x, wide)], pa.list_(pa.float64()))
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, basis.shape[1] * (len(x) + 1), basis.shape[1], dtype=np.int32)), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, w, p, pa.array(rest)], ["vec_id", "v", "w", "lead", "rest"])

    return rows.select("vec_id", "x").mapInArrow(run, STORED)


def nearest(ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, frame: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances measured) of vectors whose components and centroids are below ``WIDE``."""
    c_lead, c_rest = sketches(centroids.astype(float), *frame)
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    # rounding: relative to the squares that were subtracted, with room to spare
    size = (lead**2).sum(axis=1) + rest**2
    room = 1e-9 * (size[:, None] + ((c_lead**2).sum(axis=1) + c_rest**2)[None]) + 1e-6
    far = float(np.abs(frame[0]).max(initial=0.0)) ** 2
    bound = bound - room - 1e-9 * far
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(ints), np.iinfo(np.int64).max)
    who = np.full(len(ints), len(centroids))
    live, measured = np.arange(len(ints)), 0
    for step in range(len(centroids)):
        c = order[live, step]
        go = bound[live, c] <= best[live]
        live, c = live[go], c[go]  # bounds ascend: who stops here has no further candidate
        if not len(live):
            break
        d = ((ints[live] - centroids[c]) ** 2).sum(axis=1)
        better = (d < best[live]) | ((d == best[live]) & (c < who[live]))
        best[live[better]], who[live[better]] = d[better], c[better]
        measured += len(live)
    return who, best, measured


def nearest_wide(ints: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    return min(((sum((a - b) ** 2 for a, b in zip(ints, c))), j) for j, c in enumerate(centroids))[::-1]


def limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out or [0]


def assigner(centroids: list[list[int]], frame: tuple[np.ndarray, np.ndarray], dim: int):
    """A function over batches of stored vectors: (rows, integers or None, cluster, distance) for pieces of them."""
    narrow = all(abs(x) < WIDE for c in centroids for x in c)
    packed = np.array(centroids, dtype=np.int64) if narrow else None

    def run(batch):
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            near = np.flatnonzero(np.asarray(part.column("v").is_valid()) & narrow)
            if len(near):
                own = part.take(pa.array(near))
                ints = matrix(own.column("v"), dim)
                who, d, _ = nearest(ints, matrix(own.column("lead"), frame[1].shape[1]), own.column("rest").to_numpy(), packed, frame)
                yield own, ints, who, d
            far = np.setdiff1d(np.arange(part.num_rows), near)
            if len(far):
                own = part.take(pa.array(far))
                ints = [a if a is not None else exact(b) for a, b in zip(own.column("v").to_pylist(), own.column("w").to_pylist())]
                pairs = [nearest_wide(r, centroids) for r in ints]
                yield own, ints, np.array([p[0] for p in pairs]), [p[1] for p in pairs]

    return run


def moved(vectors: DataFrame, centroids: list[list[int]], frame, dim: int) -> list[list[int]]:
    """Every centroid after one round: the exact floor of its vectors' mean; without vectors it stays."""
    assign = assigner(centroids, frame, dim)

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}  # (cluster, limb) -> dim sums and the number of vectors
        for batch in batches:
            for _, ints, who, _ in assign(batch):
                for c in np.unique(who).tolist():
                    mine = np.flatnonzero(who == c)
                    if isinstance(ints, np.ndarray):
                        parts = {0: ints[mine].sum(axis=0)}
                    else:
                        parts = {}
                        for r in mine:
                            for i, value in enumerate(ints[r]):
                                for limb, piece in enumerate(limbs(value)):
                                    parts.setdefault(limb, np.zeros(dim, dtype=np.int64))[i] += piece
                    for limb, s in parts.items():
                        into = sums.setdefault((c, limb), np.zeros(dim + 1, dtype=np.int64))
                        into[:dim] += s
                        into[dim] += len(mine) if limb == min(parts) else 0
        if sums:
            at = [(c, limb, i) for c, limb in sums for i in range(dim + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), pa.array([a[2] for a in at], pa.int32()),
                                              pa.array(np.concatenate(list(sums.values())))], ["c", "limb", "i", "s"])

    # at most k * (dim + 1) * limbs rows
    total = vectors.mapInArrow(partial, "c int, limb int, i int, s long").groupBy("c", "limb", "i").agg(F.sum("s").alias("s")).collect()
    sums: dict[int, list[int]] = {}
    for r in total:
        sums.setdefault(r["c"], [0] * (dim + 1))[r["i"]] += r["s"] << (LIMB * r["limb"] if r["i"] < dim else 0)
    return [[s // sums[c][dim] for s in sums[c][:dim]] if c in sums else own for c, own in enumerate(centroids)]


def starts(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors of least hash."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [exact(r["x"]) for r in rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, lead: int = LEAD, column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, written, and the final centroids."""
    rows = usable(vectors, dim, column)
    mean, basis = axes(rows, dim, min(lead, dim))
    kept = keep(stored(rows, mean, basis, dim), "vectors")
    frame, centroids = (SCALE * mean, basis), starts(rows, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, frame, dim)
    assign = assigner(centroids, frame, dim)

    def run(batches):
        for batch in batches:
            for own, _, who, d in assign(batch):
                d = pa.array(d) if isinstance(d, np.ndarray) else pa.array([x if x < 1 << 63 else None for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), pa.array(who.astype(np.int32)), d], ["vec_id", "cluster", "distance"])

    out = keep(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    discard(kept)
    return out, centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Sums of distances that do not fit a long are null."""
    out, centroids = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # one row per cluster
    per = {r["cluster"]: int(r["s"]) if r["whole"] else None for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("distance") == F.count("*")).alias("whole")).collect()}
    per = {c: s if s is not None and s < 1 << 63 else None for c, s in per.items()}
    total = None if None in per.values() else sum(per.values())
    total = total if total is not None and total < 1 << 63 else None

    def by_cluster(values: dict, kind: str):
        column = F.lit(None)
        for c, value in values.items():
            column = F.when(F.col("cluster") == c, F.lit(value)).otherwise(column)
        return column.cast(kind)

    return out.select("vec_id", "cluster", "distance", by_cluster(per, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                      by_cluster({c: digest(v) for c, v in enumerate(centroids)}, "string").alias("centroid_sha256"))


def _oracle() -> str:
    assign = """d{r} as (select v.vec_id, v.rid, c.j, sum((x - y) * (x - y)) as d from comps v join c{r} c using (i) group by v.vec_id, v.rid, c.j),
n{r} as (select vec_id, rid, arg_min(j, (d, j)) as j, min(d) as d from d{r} group by vec_id, rid),
"""
    move = """s{r} as (select n.j, v.i, sum(x) as s, count(*) as n from n{r} n join comps v using (rid) group by n.j, v.i),
c{q} as (select c.j, c.i, coalesce((s - ((s % n) + n) % n) // n, y) as y from c{r} c left join s{r} s on s.j = c.j and s.i = c.i),
"""
    sql = """with kept as (select vec_id, embedding, row_number() over () as rid from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
comps as (select vec_id, rid, i, cast(floor(64 * cast(x as double)) as hugeint) as x from (select vec_id, rid, unnest(embedding) as x, unnest(range(64)) as i from kept)),
first as (select rid, row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), embedding) - 1 as j from kept qualify j < 16),
c0 as (select j, i, x as y from first join comps using (rid)),
"""
    for r in range(ROUNDS):
        sql += assign.format(r=r) + move.format(r=r, q=r + 1)
    sql += assign.format(r=ROUNDS) + """sha as (select j, sha256(string_agg(cast(y as varchar), ',' order by i)) as h from c{r} group by j)
select vec_id, cast(n.j as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by n.j) as bigint) as cluster_inertia,
cast(sum(d) over () as bigint) as inertia, h as centroid_sha256 from n{r} n join sha on sha.j = n.j""".format(r=ROUNDS)
    return sql


ORACLE = _oracle()
