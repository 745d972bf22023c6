"""Approximate nearest neighbours by few Gaussian (2-stable) projections, kd-trees over them and a chi-square stopping test.

A vector's projected squared distance to the query, over its true one, is distributed as chi-square with `dims` degrees. Projected
neighbours are therefore verified nearest first, a few more at a time; a search stops when, of a vector as near as the
current k-th best, the projection would have been seen by now with probability `confidence`. A higher confidence verifies
more and misses less: near the border a share of 1 - confidence is lost, and little of what is much nearer.

Where lengths differ much, the largest products belong to vectors that are far away, and little can be left out.
Largest inner product is turned into nearest distance by one more component, sqrt(M^2 - |x|^2) with M the largest norm.
Two levels of kd-tree: an upper one, cut from a bounded sample, deals all vectors to MOST_CELLS cells at most, and the vectors
of a cell by hash to blocks of about block_rows; in each block a lower tree has leaves of LEAF vectors. A block is one row. The
cells' boxes (a few numbers a cell) go to all executors; queries visit the blocks of their nearest cell first, then those
of the cells that the stopping test leaves.

Equal vectors are one point that keeps its k + 1 smallest ids, which is all that ties to the smaller id can ask for.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEAF = 64
#: Points from which the upper tree is cut, about; its cells at most, so that what the driver holds and sends has a fixed size.
SAMPLE, MOST_CELLS = 20_000, 4096


def chi_square_cdf(x: float, even: int) -> float:
    """P(chi-square with an even number of degrees <= x)."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(even // 2))


def chi_square_point(p: float, even: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, even) < p else (lo, mid)
    return hi


def projection(dim: int, dims: int, seed: int) -> np.ndarray:
    """The Gaussian directions; the last row belongs to the added component."""
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def splits(points: np.ndarray, blocks: int) -> list[tuple[int, float]]:
    """An upper kd-tree of 2^depth >= blocks cells as a heap of (axis, threshold)."""
    depth = max(0, math.ceil(math.log2(max(1, blocks))))
    heap: list[tuple[int, float]] = []
    cells = [points]
    for _ in range(depth):
        below = []
        for p in cells:
            axis = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            cut = float(np.median(p[:, axis])) if len(p) else 0.0
            heap.append((axis, cut))
            below += [p[p[:, axis] < cut], p[p[:, axis] >= cut]]
        cells = below
    return heap


def block_of(points: np.ndarray, heap: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if heap:
        axis, cut = np.array([a for a, _ in heap]), np.array([c for _, c in heap])
        rows = np.arange(len(points))
        while at[0] < len(heap) if len(at) else False:
            at = 2 * at + 1 + (points[rows, axis[at]] >= cut[at])
    return at - len(heap)


def leaf_order(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree: row numbers, LEAF or fewer in each."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        order = rows[np.argsort(points[rows, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return leaves


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, m) to boxes (b, m)."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, d] - q[:, d, None], q[:, d, None] - hi[None, :, d]), 0)
        out += gap * gap
    return out


def search(q: np.ndarray, qp: np.ndarray, bound: float, x: np.ndarray, p: np.ndarray, ends: np.ndarray, gap: np.ndarray, keep: int, far2: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one query: the rows of x with the `keep` largest inner products found (and all that tie with the last), those
    products, and how many rows were verified.

    x: vectors; p: their projections; ends: where the leaves end, in rows; gap: the leaves' projected squared distances to the
    query. bound: a squared distance that is known to hold enough better candidates (inf: none). far2: M^2.
    """
    leaves = np.flatnonzero(gap <= limit * bound)
    begin = ends[leaves] - np.diff(ends, prepend=0)[leaves]
    size = ends[leaves] - begin
    rows = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    near = ((p[rows] - qp) ** 2).sum(axis=1)
    some = near <= limit * bound
    rows, near = rows[some], near[some]
    order = np.argsort(near, kind="stable")
    rows, near = rows[order], near[order]
    score = np.zeros(0)
    norm2, at, step = float(q @ q), 0, 4 * keep
    while at < len(rows) and near[at] <= limit * max(bound, 0.0):
        part = rows[at : at + step][near[at : at + step] <= limit * max(bound, 0.0)]
        score = np.append(score, products(np.broadcast_to(q, (len(part), len(q))), x[part]))
        at += len(part)
        if at >= keep:
            bound = min(bound, norm2 + far2 - 2 * float(np.partition(score, at - keep)[at - keep]))
        step *= 2
    found = rows[:at]
    if at > keep:
        best = score >= np.partition(score, at - keep)[at - keep]
        found, score = found[best], score[best]
    return found, score, at


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components: equal vectors give equal doubles."""
    return np.add.accumulate(q * x, axis=1)[:, -1] if len(x) else np.zeros(0)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def pack_arrays(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def nearest(vectors: DataFrame, is_query, k: int = 20, dims: int = 24, confidence: float = 0.9, block_rows: int = 4096, chunk: int = 1024, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, verified): each query's k nearest found among all other rows, by inner product in double
    precision; verified: how many vectors its search has compared truly.

    is_query: a condition on id_col. Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do null ids. Repeated rows count once; an id with several vectors takes part with each, and
    a query never finds rows of its own id. Fewer candidates than k: all. Equal scores rank by vec_id. An empty table gives
    an empty result. dims is even.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = raw.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0))
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    dim = lengths[0].n
    fine = staged(fine.filter(F.size("v") == dim).distinct(), "vectors")
    firsts = fine.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    points = staged(firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    n, far2 = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    directions = projection(dim, dims, seed)
    limit = chi_square_point(confidence, dims)
    cells = min(MOST_CELLS, math.ceil(n / block_rows))
    parts = math.ceil(n / (1 << max(0, math.ceil(math.log2(cells)))) / block_rows)

    def projected(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(far2 - (v * v).sum(axis=1), 0))[:, None]]) @ directions

    def seen(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(projected(matrix(b.column("v"))).tolist())], names=["p"])

    # about SAMPLE points: those with a small hash
    share = min(1.0, SAMPLE / n)
    some = points.select("v").filter(F.xxhash64("v") <= round(-(1 << 63) + share * ((1 << 64) - 1025)))
    heap = splits(np.array([r.p for r in some.mapInArrow(seen, "p array<double>").collect()]).reshape(-1, dims), cells)

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                at = block_of(projected(matrix(b.column("v"))), heap)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["v", "ids", "part", "cell"])

    def built(table: pa.Table) -> pa.Table:
        v = matrix(table.column("v").combine_chunks())
        p = projected(v)
        leaves = leaf_order(p)
        order = np.concatenate(leaves)
        lo, hi = np.array([p[x].min(axis=0) for x in leaves]), np.array([p[x].max(axis=0) for x in leaves])
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        blob = pack_arrays(v=v[order], p=p[order], ends=np.cumsum([len(x) for x in leaves]), lo=lo, hi=hi, ids=ids.flatten().to_numpy(), count=np.diff(ids.offsets.to_numpy()))
        return pa.table({"cell": table.column("cell")[:1], "part": table.column("part")[:1], "lo": pa.array([lo.min(axis=0).tolist()]), "hi": pa.array([hi.max(axis=0).tolist()]), "tree": pa.array([blob], pa.binary())})

    part = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(parts))
    placed = points.withColumn("part", part).mapInArrow(dealt, "v array<double>, ids array<long>, part long, cell long")
    index = staged(placed.groupBy("cell", "part").applyInArrow(built, "cell long, part long, lo array<double>, hi array<double>, tree binary"), "index")
    # a row for each cell and direction, whatever the number of blocks
    sides = index.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "x")).groupBy("cell", "at").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    rows = sides.orderBy("cell", "at").toArrow()
    names = rows.column("cell").to_numpy()[::dims]
    lows, highs = (rows.column(c).to_numpy().reshape(-1, dims) for c in ("lo", "hi"))
    boxes = spark.sparkContext.broadcast((names, lows, highs))
    queries = fine.filter(is_query(F.col("id")))
    chunks = max(1, math.ceil(queries.count() / chunk))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    sent = "id long, v array<double>, chunk int, bound double, cell long"

    def to_cells(first: bool):
        def run(batches):
            names, lows, highs = boxes.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    v = matrix(b.column("v"))
                    gap = box_distance(np.hstack([v, np.zeros((len(v), 1))]) @ directions, lows, highs)
                    nearest = gap.argmin(axis=1)
                    if first:
                        row, cell, bound = np.arange(len(v)), nearest, np.full(len(v), np.inf)
                    else:
                        bound = b.column("bound").to_numpy()
                        todo = gap <= limit * np.maximum(bound, 0)[:, None]
                        todo[np.arange(len(v)), nearest] = False
                        row, cell = np.nonzero(todo)
                        bound = bound[row]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("v").take(take), b.column("chunk").take(take), pa.array(bound), pa.array(names[cell])], names=["id", "v", "chunk", "bound", "cell"])

        return run

    def packed(table: pa.Table) -> pa.Table:
        q = pack_arrays(id=table.column("id").to_numpy(), v=matrix(table.column("v").combine_chunks()), bound=table.column("bound").to_numpy())
        return pa.table({"cell": table.column("cell")[:1], "chunk": table.column("chunk")[:1], "q": pa.array([q], pa.binary())})

    def searched(batches):
        for b in batches:
            for q_blob, tree_blob in zip(b.column("q"), b.column("tree"), strict=True):
                q, t = np.load(io.BytesIO(q_blob.as_py())), np.load(io.BytesIO(tree_blob.as_py()))
                v, x, p, ends, count, ids = q["v"], t["v"], t["p"], t["ends"], t["count"], t["ids"]
                begin = np.cumsum(count) - count
                qp = np.hstack([v, np.zeros((len(v), 1))]) @ directions
                gap = box_distance(qp, t["lo"], t["hi"])
                out = []
                for i, (query, bound) in enumerate(zip(q["id"].tolist(), q["bound"].tolist(), strict=True)):
                    # one more than k: the query's own vector can be among them
                    point, score, verified = search(v[i], qp[i], bound, x, p, ends, gap[i], k + 1, far2, limit)
                    each = count[point]
                    own = ids[np.repeat(begin[point] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                    score = np.repeat(score, each)[own != query]
                    own = own[own != query]
                    top = np.lexsort((own, -score))[:k]
                    # the count goes with the first row, or alone
                    out.append((np.full(max(1, len(top)), query), pa.array(own[top]) if len(top) else pa.nulls(1, pa.int64()), pa.array(score[top]) if len(top) else pa.nulls(1, pa.float64()), np.append(verified, np.zeros(max(0, len(top) - 1), np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.concat_arrays([o[1] for o in out]), pa.concat_arrays([o[2] for o in out]), pa.array(np.concatenate([o[3] for o in out]))], names=["query_id", "vec_id", "score", "verified"])

    def visited(source: DataFrame, first: bool) -> DataFrame:
        pairs = source.mapInArrow(to_cells(first), sent).groupBy("cell", "chunk").applyInArrow(packed, "cell long, chunk int, q binary")
        both = pairs.join(index.select("cell", "part", "tree"), "cell").repartition(F.col("cell"), F.col("part"), F.col("chunk"))
        return both.select("q", "tree").mapInArrow(searched, "query_id long, vec_id long, score double, verified long")

    order = Window.partitionBy("query_id").orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        """The k best rows of a query with its sum of verified; a query that has found nothing keeps a row without vec_id."""
        rows = found.groupBy("query_id", "vec_id", "score").agg(F.sum("verified").alias("verified"))
        total = F.sum("verified").over(Window.partitionBy("query_id"))
        return rows.withColumns({"rank": F.row_number().over(order), "verified": total}).filter(F.col("rank") <= k)

    one = staged(ranked(visited(queries.withColumn("bound", F.lit(float("inf"))), True)), "first-cell")
    kth = one.groupBy("query_id").agg(F.min("score").alias("s"), F.count("vec_id").alias("n"))
    known = F.when(F.col("n") >= k, F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c) + F.lit(float(far2)) - 2 * F.col("s")).otherwise(F.lit(float("inf")))
    second = queries.join(kth.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", "chunk", known.alias("bound"))
    before = one.select("query_id", "vec_id", "score", F.when(F.col("rank") == 1, F.col("verified")).otherwise(0).alias("verified"))
    out = ranked(before.unionByName(visited(second, False)))
    return out.filter("vec_id IS NOT NULL").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
