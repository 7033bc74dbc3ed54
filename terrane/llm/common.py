"""What the operators of this subpackage share: checkpointing, block numbers, graph components, byte helpers.

Nothing here brings documents, links or labels to the driver; the only values collected are counts and checksums.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.lineage import cut, ensure_checkpoint_dir

#: ASCII white space; what is between runs of it is a word.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder; like ``cut``, for what is wide."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns of a row: rows with equal keys are equal."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # a null and an empty value must differ, so which are null is hashed, too
    nulls = F.concat(F.lit("n"), *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return F.struct(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(F.lit(1), nulls, *cols).alias("b"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in the only column of ``keys``; of equal rows one."""
    name = free_name(docs, "rk")
    return docs.withColumn(name, row_key(docs)).join(keys.select(F.col(keys.columns[0]).alias(name)), name, "left_semi").dropDuplicates([name]).drop(name)


def text_size(df: DataFrame, col: str) -> int:
    """Bytes of all values of a text column: one number, from which the operators derive how many blocks they make."""
    return df.agg(F.sum(F.octet_length(F.col(col)).cast("long"))).first()[0] or 0


def block_of(n: int, *cols: str) -> Column:
    """A block number below ``n`` that follows from the values of ``cols`` alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int").alias("blk")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------------------------------------------------- components


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the undirected edges ``a``-``b``."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b = a[live], b[live]
        low, high = np.minimum(ra[live], rb[live]), np.maximum(ra[live], rb[live])
        np.minimum.at(root, high, low)
        while True:  # pointer jumping
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _forest(batches):
    """Contract the edges of a partition to one star for each component that they form."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    a = np.concatenate([x.column(0).to_numpy(zero_copy_only=False) for x in got])
    b = np.concatenate([x.column(1).to_numpy(zero_copy_only=False) for x in got])
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_components(len(ids), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Distributed union-find. ``edges``: two long columns, undirected. Returns (node, component): the smallest node
    that each node with an edge can reach; smallest nodes themselves are left out.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which double the reach of every label. Every
    step is a map-side combined minimum and an equi-join, which AQE can split where a hub is hot; the state goes through
    ``checkpoint()``. Each partition first contracts its own edges to stars, so that long chains are short before
    the first shuffle."""
    x, y = edges.columns[:2]
    e = edges.select(F.greatest(x, y).cast("long").alias("a"), F.least(x, y).cast("long").alias("b")).filter("a <> b")
    e = cut(e.mapInArrow(_forest, "a long, b long").distinct())
    seen = None
    for _ in range(rounds):
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


# ---------------------------------------------------------------------------------------------------------- byte blobs


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, one after another, and each row's offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 2_000_000):
    """Ranges of rows whose bytes come to ``most`` or to a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose rows are the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    off = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(values)]).cast(pa.binary())
