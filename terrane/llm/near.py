"""Near-dedup of documents by shingles of words: those with a Jaccard similarity of at least 0.8 are near copies.

Candidates are what the SimHash tables join (fingerprints over the same runs of words, chains of at most 2 bits), and, as a pair at 0.8 differs in
about 10 of 64 bits, too many for tables of segments, what shares a MinHash band. The sets of all candidates are fetched and compared
completely, as for lines. Texts with the same shingles, each as often, are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines
from .common import binary_rows, connected_components, cut, keep_rows, pieces, row_key, shuffle_partitions, stored, text_bytes
from .simhash import fingerprint_components, majority_bits
from .words import Words, xxh64

#: Documents of a group that are compared with each other in one task.
BLOCK = 250
_MIX = lines._MIX


def _shingles(batch, words: int):
    """For some texts of (row, text) at a time: their range, the hashes of their shingles, and how many each has."""
    raw, off = text_bytes(batch.column(1))
    for i, j in pieces(off):
        w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        start, end, many = w.shingles(words)
        yield i, j, xxh64(w.buf, start, end), many


def text_hashes(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """64 bits for the shingles of each text, whatever their order; zero without any."""
    out = np.zeros(len(many), np.uint64)
    some = np.flatnonzero(many)
    if len(some):
        mixed = (h ^ (h >> np.uint64(31))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        out[some] = (np.add.reduceat(mixed, (np.cumsum(many) - many)[some]) + many[some].astype(np.uint64)) * _MIX
    return out


def bands(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Band keys of texts that have shingles, a row of BANDS for each; one without any has keys of its own kind."""
    low = np.full((lines.BANDS * lines.ROWS, len(many)), 0xFFFFFFFF, np.uint32)
    v = (h >> np.uint64(32)).astype(np.uint32)
    rows = np.flatnonzero(many)
    starts = (np.cumsum(many) - many)[rows]
    for i, k in pieces(np.concatenate([[0], np.cumsum(many[rows])]), 100_000):
        part = rows[i:k]
        x = v[starts[i] : starts[k - 1] + many[part[-1]]]
        for j in range(len(low)):
            low[j, part] = np.minimum.reduceat(x * lines._MUL[j] + lines._ADD[j], starts[i:k] - starts[i])
    return lines.band_keys(low)


def _scan(words: int):
    """(lid, fp, bands, row)."""

    def run(batches):
        for batch in batches:
            for i, j, h, many in _shingles(batch, words):
                keys = lines._six(bands(h, many).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(text_hashes(h, many).view(np.int64)), pa.array(majority_bits(h, many).view(np.int64)), binary_rows(keys, np.arange(j - i + 1) * lines.BANDS * 6), batch.column(0).slice(i, j - i)], names=["lid", "fp", "bands", "row"])

    return run


def _fetch(words: int):
    """(lid, line): the distinct shingle hashes of each text of (lid, text)."""

    def run(batches):
        for batch in batches:
            for i, j, h, many in _shingles(batch, words):
                cuts = np.concatenate([[0], np.cumsum(many)])
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["lid", "line"])

    return run


def _numbered(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) // 8 for s in sets], np.int64)
    return np.repeat(np.arange(len(sets)), size), np.frombuffer(b"".join(sets), np.uint64)


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies: that of the smallest id (null last; of equal ids, by a hash of the row; of
    equal rows, any). Columns stay as they are.

    Near copies are texts whose sets of runs of ``words`` lower-cased words (the whole text if it has fewer) have a Jaccard similarity of at least
    ``similarity``; a pair at 0.8 becomes a candidate with probability 0.995. All null and blank texts are one component. An empty table gives no
    rows."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), row_key(docs).alias("rk")).alias("row"), F.col(text_col).alias("text"))
    scan = rows.mapInArrow(_scan(words), f"lid long, fp long, bands binary, row {rows.schema['row'].dataType.simpleString()}")
    nodes = stored(scan.groupBy("lid").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("least")))
    groups = nodes.select("lid", "bands").mapInArrow(lines._deal_bands(n), "bucket int, keys binary, lids binary").groupBy("bucket").applyInArrow(lines._groups, "gid long, lid long, m int")
    alike = nodes.select("lid", "fp").join(fingerprint_components(nodes.select("fp")), "fp")
    many = alike.groupBy("root").agg(F.count("*").cast("int").alias("m")).filter("m > 1")
    alike = alike.join(many, "root").select(F.xxhash64("root").alias("gid"), "lid", "m")
    groups = cut(groups.unionByName(alike).distinct())
    wanted = nodes.join(groups.select("lid").distinct(), "lid", "left_semi").select("lid", F.col("least.rk").alias("rk"))
    texts = docs.select(row_key(docs).alias("rk"), F.col(text_col).alias("text")).join(wanted, "rk").dropDuplicates(["lid"]).select("lid", "text")
    texts = stored(texts.mapInArrow(_fetch(words), "lid long, line binary"))
    comps = connected_components(lines.similar(groups, texts, similarity, numbered=_numbered, block=BLOCK))
    roots = nodes.join(comps, nodes.lid == comps.node, "left").select("least", F.coalesce("component", "lid").alias("root"))
    return keep_rows(docs, roots.groupBy("root").agg(F.min("least").alias("least")).select("least.rk"))
