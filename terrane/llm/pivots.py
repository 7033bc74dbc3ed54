"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by the ordered list of its nearest reference points (pivots). Two near vectors share pivots; a pair
is a candidate if it shares at least two, so the inverted lists are kept by label and pair of pivots, and a pair is
counted in the list of its two smallest shared pivots only. Candidates are verified by cosine in double precision.

Pivots are chosen from a bounded sample, each as far as possible from those before, so that a group of many near-copies doesn't
crowd them. Their number grows with the root of the number of vectors, so that lists of pairs of pivots stay about as long. Vectors of each
length have pivots of their own. Long lists are cut into blocks, and each two blocks of a list meet in a task of their own: tasks stay bounded, and
what leaves a task are link counts and one star for each component, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, local_components
from .vectors import matrix

#: Rows of a list that meet another block of it in one task.
BLOCK = 1024
#: Pivots at least and at most, and vectors for each of which half a pivot's square is spent.
FEWEST, MOST, SPREAD = 64, 8_192, 12


def pivot_count(n: int) -> int:
    """How many pivots ``n`` vectors have: 64 up to 49,152 of them, then the root of a twelfth."""
    return int(min(MOST, max(FEWEST, (n / SPREAD) ** 0.5)))


def choose_pivots(x: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors, each the farthest from those chosen before; fewer if there are no other directions."""
    if not len(x):
        return x
    got, near = [x[0]], x @ x[0]
    while len(got) < many:
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        got.append(x[i])
        near = np.maximum(near, x @ x[i])
    return np.array(got)


def _unit(column, dim):
    ok, x = matrix(column, dim)
    norm = np.sqrt((x * x).sum(1))
    good = (norm > 0) & np.isfinite(norm)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good] / norm[good, None]


def _lists(pivots: dict[int, np.ndarray], nearest: int):
    """For each vector a row for each pair of its nearest pivots."""

    def run(batches):
        for b in batches:
            for dim, points in pivots.items():
                ok, x = _unit(b.column(2), dim)
                rows = np.flatnonzero(ok)
                if not len(rows):
                    continue
                m = min(nearest, len(points))
                near = np.sort(np.concatenate([np.argsort(-(x[i : i + 1024] @ points.T), 1, kind="stable")[:, :m] for i in range(0, len(x), 1024)]), 1).astype(np.int32)
                i, j = np.triu_indices(m, 1) if m > 1 else (np.zeros(1, int), np.zeros(1, int))
                key = near[:, i].astype(np.int64) * 65536 + near[:, j]
                at = np.repeat(rows, len(i))
                flat = np.repeat(near, len(i), 0)
                for s in range(0, len(at), 20_000):
                    part = pa.array(at[s : s + 20_000])
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * m, pa.array(flat[s : s + 20_000].ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(part), b.column(1).take(part), pa.array(np.full(len(part), dim, np.int32)), pa.array(key.ravel()[s : s + 20_000]), lists, b.column(2).take(part)], names=["rid", "label", "dim", "key", "near", "v"])

    return run


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side, dim = table["side"].to_numpy(), table["dim"][0].as_py()
        key = table["key"][0].as_py()
        rid = table["rid"].to_numpy()
        _, x = _unit(table["v"], dim)
        near = np.array(table["near"].to_pylist(), np.int64)
        low, high = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # side 0: the block meets itself
        a_out, b_out = [], []
        counts = np.zeros(len(rid), np.int64)
        for s in range(0, len(low), 512):
            part = low[s : s + 512]
            a, b = np.nonzero(x[part] @ x[high].T >= threshold)
            a, b = part[a], high[b]
            if side[0] == 0:
                own = a < b
                a, b = a[own], b[own]
            # only in the list of the two smallest shared pivots
            same = near[a][:, :, None] == near[b][:, None, :]
            held = np.sort(np.where(same.any(2), near[a], 1 << 30), 1)[:, :2]
            mine = held[:, 0] * 65536 + held[:, -1] == key if near.shape[1] > 1 else np.ones(len(a), bool)
            a, b = a[mine], b[mine]
            counts += np.bincount(a, minlength=len(rid)) + np.bincount(b, minlength=len(rid))
            a_out.append(a)
            b_out.append(b)
        root = local_components(len(rid), np.concatenate(a_out), np.concatenate(b_out)) if a_out else np.arange(len(rid))
        some = np.flatnonzero(counts)
        return pa.table({"rid": rid[some], "links": counts[some], "root": rid[root[some]]})

    return run


def near_duplicates(emb: DataFrame, *, threshold: float = 0.93, pivots: int | None = None, nearest: int = 5, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. Links: found pairs of equal, not null, label and cosine >= threshold.

    ``pivots``: reference points for each length of vectors (default: ``pivot_count``). ``sample``: at most so many rows of each length (or four for
    each pivot, if that is more), those whose ids hash lowest, are looked at to choose pivots; all rows are indexed.
    Null, zero, or not wholly finite vectors and rows without a label link with nothing, nor do vectors of different lengths. Rows with
    equal ids are vectors of their own. A null id has the name of its component's smallest id, null if there is none. An
    empty table gives no rows."""
    rows = emb.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    points = {}
    for r in rows.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect():  # one row for each length of vectors
        many = pivots or pivot_count(r["n"])
        few = rows.filter(F.size("v") == r["dim"]).orderBy(F.xxhash64("vec_id", F.lit(8)), "rid").limit(max(sample, 4 * many)).select("v").toPandas()["v"]
        chosen = choose_pivots(_unit(pa.array([np.asarray(v, np.float64) for v in few], pa.list_(pa.float64())), r["dim"])[1], many)
        # a sample without a good vector: any direction serves
        points[r["dim"]] = chosen if len(chosen) else np.eye(1, r["dim"])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sent = rows.sparkSession.sparkContext.broadcast(points)  # MOST pivots of each length at most
    lists = rows.filter("label is not null and v is not null").select("rid", "label", "v").mapInArrow(lambda batches: _lists(sent.value, nearest)(batches), f"rid long, label {kind['label']}, dim int, key long, near array<int>, v {kind['v']}")
    lists = cut(lists)
    place = ["label", "dim", "key"]
    many = lists.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = lists.join(many.select(*place, "blocks"), place).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    tasks = own.withColumn("m", meet).select(*place, "m.i", "m.j", F.when(F.col("m.i") == F.col("m.j"), 0).when(F.col("block") == F.col("m.i"), 1).otherwise(2).alias("side"), "rid", "near", "v")
    found = cut(tasks.groupBy(*place, "i", "j").applyInArrow(_verify(threshold), "rid long, links long, root long"))
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    comps = connected_components(found.select("rid", "root"))
    named = rows.select("rid", "vec_id").join(links, "rid", "left").join(comps.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("component", "rid"))
    names = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return named.join(names, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
