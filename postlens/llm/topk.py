"""Exact top-k by inner product with pivot-table elimination.

Every vector's distances to the pivots are computed once and travel with it.
For a query q and a candidate x, |d(q, p) - d(x, p)| is a lower bound of their
distance for each pivot p; the largest of them bounds the inner product from
above: q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are evaluated in the
order of that bound, and evaluation stops when the next bound lies below the
k-th best score, so the result is exact. Rows meet in blocks of bounded size:
every query block with every candidate block, as one keyed shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import cut

PIVOTS = 24
PIVOT_SAMPLE = 2000  # rows the pivots are chosen from
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
SCALE = 256


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``v`` = floor(scale * x) per component, as longs.

    Rows without an id and vectors null or with null or non-finite
    components are left out. Components must stay below 2^24 in
    magnitude after scaling, so that sums are exact.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (rows.where(F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
            .where(F.size("v") > 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart rows of a bounded sample: each the one farthest from those before."""
    if not len(sample):
        return sample
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)):
        nxt = int(far.argmax())
        if far[nxt] == 0:
            break
        picked.append(nxt)
        far = np.minimum(far, ((sample - sample[nxt]) ** 2).sum(1))
    return sample[picked]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(rows)
    return np.asarray(rows.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def best_of(qid, q, qp, xid, x, xp, k: int, step: int = 256):
    """Exact top k of the rows x for each query: (query, id, score) lists."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    q2, x2 = (q * q).sum(1), (x * x).sum(1)
    out_q, out_x, out_s = [], [], []
    for i in range(len(qid)):
        low = np.abs(xp - qp[i]).max(1) if xp.shape[1] else np.zeros(len(x))
        low = np.maximum(low - 1e-6 * (1 + low), 0)
        bound = (q2[i] + x2 - low * low) / 2
        bound += 1e-9 * (1 + np.abs(bound))
        bound[xid == qid[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for lo in range(0, len(order), step):
            part = order[lo: lo + step]
            if bound[part[0]] == -np.inf or (len(scores) == k and bound[part[0]] < scores[-1]):
                break
            part = part[bound[part] > -np.inf]
            ids = np.concatenate((ids, xid[part]))
            scores = np.concatenate((scores, x[part] @ q[i]))
            top = np.lexsort((ids, -scores))
            _, first = np.unique(ids[top], return_index=True)  # an id counts once, with its best vector
            top = top[np.sort(first)][:k]
            ids, scores = ids[top], scores[top]
        out_q.append(np.full(len(ids), qid[i]))
        out_x.append(ids)
        out_s.append(scores.astype(np.int64))
    cat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return cat(out_q).astype(np.int64), cat(out_x).astype(np.int64), cat(out_s).astype(np.int64)


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5,
          pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each id divisible by ``every``.

    Scores are integer inner products of the quantised vectors; ties go to
    the smaller id; rows with the query's own id are no candidates. Exactly
    repeated rows count once; different vectors under one id all take part
    (a query id then ranks the best of its vectors). Vectors of another
    length than the query's are no candidates for it. An empty table gives
    no rows; other columns are ignored.
    """
    vecs = quantised(rows, id_col, vec_col).dropDuplicates(["id", "v"])
    vecs = cut(vecs.withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in vecs.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vecs.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # pivots per vector length, from a sample of bounded size
    chosen = {}
    for dim in sizes:
        sample = vecs.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()
        chosen[dim] = choose_pivots(_matrix(sample["v"]).astype(np.float64), pivots)

    def table(batches):
        for b in batches:
            dims = np.asarray(b.column(2))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, p = _matrix(part.column(1)).astype(np.float64), chosen[int(dim)]
                d = np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(2)) if len(x) * p.size < 1 << 22 else np.stack(
                    [np.sqrt(((x - r) ** 2).sum(1)) for r in p], 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(d.tolist(), pa.list_(pa.float64()))],
                    names=["id", "v", "dim", "d"])

    piv = vecs.mapInArrow(table, "id long, v array<long>, dim int, d array<double>")
    most = max(sizes.values())
    n_rows = -(-most // row_block)
    n_queries = max(1, -(-most // (every * query_block)))
    h = F.xxhash64("id", "v")
    row_side = piv.select("*", F.pmod(h, F.lit(n_rows)).cast("int").alias("rb"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), F.lit(False).alias("is_q"))
    query_side = (piv.where(F.col("id") % every == 0)
                  .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"),
                          F.pmod(h, F.lit(n_queries)).cast("int").alias("qb"), F.lit(True).alias("is_q")))

    def match(table: pa.Table) -> pa.Table:
        is_q = np.asarray(table["is_q"])
        part = lambda m: table.filter(pa.array(m))
        qs, xs = part(is_q), part(~is_q)
        if not len(qs) or not len(xs):
            a = b = c = np.zeros(0, np.int64)
        else:
            a, b, c = best_of(np.asarray(qs["id"]), _matrix(qs["v"]), _matrix(qs["d"]),
                              np.asarray(xs["id"]), _matrix(xs["v"]), _matrix(xs["d"]), k)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = (row_side.unionByName(query_side).groupBy("dim", "rb", "qb")
             .applyInArrow(match, "query_id long, vec_id long, score long"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
