"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are dealt out by descending length, so that a block holds vectors of about one length. Queries first meet the block of the
longest vectors, which gives each a k-th score to beat; a query then goes only to blocks whose longest vector could beat it
(Cauchy-Schwarz). Within a block, the coordinates are rotated to the directions in which the vectors have most of their
length (SVD of their second moments): the product over the first coordinates plus the product of the lengths of the rests bounds the
score. Only what the bounds leave is computed, in whole numbers. The bounds have a margin for rounding, and ties with the
k-th score are never pruned, so the result is exact.

Queries meet vectors in tasks of one chunk of queries and one block of vectors, of bounded size however many there are of either; nothing
that grows with the data is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix

#: Rows of a block, queries of a chunk, and queries that are multiplied with a block at once.
BLOCK, CHUNK, QUERIES = 8_192, 2_048, 512
#: Tasks that a small table is cut into at least, by smaller chunks.
TASKS = 16


def _quantised(scale: float):
    def run(batches):
        for b in batches:
            ok, x = matrix(b.column(1))
            # vectors of other lengths in the batch
            rest = np.flatnonzero(~ok)
            parts = [(np.flatnonzero(ok), x)]
            while len(rest):
                ok2, x2 = matrix(b.column(1).take(pa.array(rest)))
                if not ok2.any():
                    break
                parts.append((rest[ok2], x2))
                rest = rest[~ok2]
            for rows, v in parts:
                q = np.floor(scale * v)
                if (q * q).sum(1).max(initial=0) >= 2.0**62:
                    raise OverflowError("a product of two vectors may not fit 63 bits")
                if len(rows):
                    flat = pa.array(q.astype(np.int64).ravel())
                    lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * q.shape[1], flat)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), lists, pa.array(np.full(len(rows), q.shape[1], np.int32)), pa.array(np.sqrt((q * q).sum(1)))], names=["vec_id", "q", "dim", "norm"])

    return run


def _moments(batches):
    """Sums of products of components, by length of the vectors."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column(1).to_numpy()
        for d in np.unique(dims):
            _, x = matrix(b.column(0).filter(pa.array(dims == d)), int(d))
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        n = m.size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())], names=["dim", "i", "v"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in doubles where these hold them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    kind = np.float64 if most < 2**53 else np.int64
    return np.einsum("ij,ij->i", a.astype(kind), b.astype(kind)).astype(np.int64)


def search_block(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, c: np.ndarray, cid: np.ndarray, cvec: np.ndarray, turn: np.ndarray, k: int, step: int = 1024):
    """The best k of a block for each query: (query, candidate, score) rows. ``floor``: a score that a row must reach. ``c`` is sorted by
    descending length; rows whose cid is the query's qid are left out."""
    rq, rc = q.astype(np.float64) @ turn, c.astype(np.float64) @ turn
    h = max(1, q.shape[1] // 4)
    tail_q, tail_c = np.sqrt((rq[:, h:] ** 2).sum(1)), np.sqrt((rc[:, h:] ** 2).sum(1))
    norm_q, norm_c = np.sqrt((rq**2).sum(1)), np.sqrt((rc**2).sum(1))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]
    floor = floor.astype(np.float64).copy()
    done = 0
    for i in range(0, len(c), step):
        j = min(i + step, len(c))
        margin = 1 + 1e-9 * norm_q * norm_c[i]
        live = np.flatnonzero(norm_q * norm_c[i] + margin >= floor)
        if not len(live):
            break
        bound = rq[live, :h] @ rc[i:j, :h].T + tail_q[live, None] * tail_c[None, i:j] + margin[live, None]
        a, b = np.nonzero(bound >= floor[live, None])
        a, b = live[a], b + i
        real = qid[a] != cid[b]
        a, b = a[real], b[real]
        score = np.concatenate([products(q[a[s : s + 200_000]], c[b[s : s + 200_000]]) for s in range(0, len(a), 200_000)] or [np.zeros(0, np.int64)])
        enough = score >= floor[a]
        a, b, score = a[enough], b[enough], score[enough]
        done += len(a)
        cuts = np.searchsorted(a, np.arange(len(q) + 1))
        for x in np.unique(a):
            rows = slice(cuts[x], cuts[x + 1])
            at, sc = np.concatenate([best[x][0], b[rows]]), np.concatenate([best[x][1], score[rows]])
            order = np.lexsort((cvec[at], -sc))[:k]
            best[x] = (at[order], sc[order])
            if len(order) == k:
                floor[x] = max(floor[x], float(best[x][1][-1]))
    query = np.repeat(np.arange(len(q)), [len(x[0]) for x in best])
    return query, np.concatenate([x[0] for x in best]) if best else np.zeros(0, np.int64), np.concatenate([x[1] for x in best]) if best else np.zeros(0, np.int64)


def _search(turns: dict[int, np.ndarray], k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not queries.num_rows or not block.num_rows:
            return none
        dim = queries["dim"][0].as_py()
        _, c = matrix(block["q"], dim)
        order = np.argsort(-block["norm"].to_numpy(), kind="stable")
        c = c.astype(np.int64)[order]
        vec, cid = block["vec_id"].to_numpy()[order], block["rid"].to_numpy()[order]
        _, q = matrix(queries["q"], dim)
        q, qid, qvec, floor = q.astype(np.int64), queries["rid"].to_numpy(), queries["vec_id"].to_numpy(), queries["floor"].to_numpy()
        out = []
        for i in range(0, len(q), QUERIES):
            s = slice(i, i + QUERIES)
            a, b, score = search_block(q[s], qid[s], floor[s], c, cid, vec, turns[dim], k)
            out.append(pa.table({"qid": qid[s][a], "query_id": qvec[s][a], "vec_id": vec[b], "score": score}))
        return pa.concat_tables(out)

    return run


def top_k(emb: DataFrame, *, k: int = 10, scale: float = 1024.0, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``every``: the ``k`` rows of largest inner product,
    over vectors of floor(scale * component); ties go to the smaller id. All rows but the query's own take part, rows with
    the same id included; equal rows are rows of their own.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id; vectors are
    compared with those of their own length only. Fewer rows give fewer ranks; an empty table gives none. Vectors whose products
    might not fit 63 bits (a length of 2**31 or more after scaling) are an error."""
    kind = emb.schema[vector_col].dataType.simpleString()
    rows = emb.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.mapInArrow(_quantised(scale), "vec_id long, q array<long>, dim int, norm double")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors
    sums = rows.select("q", "dim").mapInArrow(_moments, "dim int, i int, v double").groupBy("dim", "i").agg(F.sum("v").alias("v"))
    turns: dict[int, np.ndarray] = {}
    if dims:
        got = sums.toPandas()
        for d, part in got.groupby("dim"):
            m = np.zeros(d * d)
            m[part["i"]] = part["v"]
            w, u = np.linalg.eigh(m.reshape(d, d))
            turns[int(d)] = u[:, ::-1].copy()
    blocks = max(1, -(-sum(dims.values()) // BLOCK))
    placed = cut(rows.repartitionByRange(blocks, "dim", F.desc("norm")).withColumn("part", F.spark_partition_id()))
    longest = placed.groupBy("dim", "part").agg(F.max("norm").alias("longest"))
    longest = longest.withColumn("first", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "part")) == 1)
    asking = placed.filter(F.col("vec_id") % every == 0)
    asked = asking.count()
    chunks = max(1, -(-asked // CHUNK), min(-(-TASKS // blocks), -(-asked // 32)))
    queries = asking.select(*[F.col(c).alias(c) for c in ("rid", "vec_id", "q", "dim", "norm")], F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int").alias("chunk"))  # columns of their own
    shape = "qid long, query_id long, vec_id long, score long"

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(c) for c in ("rid", "vec_id", "q", "dim", "part", "chunk", "floor")])
        pairs = asked.select("dim", "part", "chunk").distinct()
        against = placed.join(pairs, ["dim", "part"])
        against = against.select(*[F.col(c).alias(c) for c in ("rid", "vec_id", "q", "dim", "norm", "part", "chunk")])
        return asked.groupBy("dim", "part", "chunk").cogroup(against.groupBy("dim", "part", "chunk")).applyInArrow(_search(turns, k), shape)

    lead = queries.join(longest.filter("first").select("dim", "part"), "dim").withColumn("floor", F.lit(-(2.0**63)))
    first = cut(meet(lead))
    beat = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(F.col("qid").alias("rid"), F.col("least").cast("double").alias("least"))
    rest = queries.join(beat, "rid", "left").join(longest.filter("not first").select("dim", "part", "longest"), "dim")
    rest = rest.withColumn("floor", F.coalesce("least", F.lit(-(2.0**63)))).filter(F.col("norm") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("floor")).drop("least", "longest")
    every_ = first.unionByName(meet(rest))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return every_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
