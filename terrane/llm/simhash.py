"""SimHash near-dedup with multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in at most 2 bits differ in at most 1 in one of the
segments, so each fingerprint looks up, for both segments, its segment and every segment that differs in one bit. Of two
segments that differ in one bit only the one that has the bit set needs to look, which halves the look-ups. What meets in
the table is verified by the complete distance.

Equal fingerprints are one node. Within a table entry with many fingerprints no pairs are made: the other segment is masked at
every pair of bits (every bit, for looked-up ones), and those that then agree are linked to one of them; that finds
the same components. An entry with more than HOT rows is dealt out again, by three pieces of the other segment: what differs in at
most 2 bits there agrees in one of the pieces. Links go on to a distributed union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, keep_rows, local_components, pieces, ranges, row_key, text_bytes
from .words import Words, xxh64

#: In table entries of up to so many rows, all pairs are compared.
SMALL = 64
#: Rows of a table entry beyond which it is dealt out again; what shares an entry and a piece are at most 2**22 fingerprints.
HOT = 1024
#: Bits of the other segment at which its pieces end.
PIECES = (0, 11, 22, 32)
#: Shingles that 16-bit counters can hold.
_LANE = 60_000


def majority_bits(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text, with ``many`` of the hashes in a row, the bits that over half of them have set; zero without any."""
    out = np.zeros(len(many), np.uint64)
    parts = np.maximum(-(-many // _LANE), 0)
    text = np.repeat(np.arange(len(many)), parts)
    if not len(text):
        return out
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    inner = ranges(np.zeros(len(many), np.int64), parts)
    starts = first[text] + inner * _LANE
    lanes = np.uint64(0x0001000100010001)
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lanes, starts)
        for k in range(4):
            counts = np.bincount(text, ((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64), len(many))
            out |= (counts * 2 > many).astype(np.uint64) << np.uint64(16 * k + j)
    return out


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row: the SimHash over XXH64 of runs of ``words`` lower-cased words. Rows stay where they are."""

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            out = []
            for i, j in pieces(off):
                w = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                start, end, many = w.shingles(words)
                out.append(majority_bits(xxh64(w.buf, start, end, seed), many))
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _probes(batches):
    """Table rows and look-ups of each fingerprint: (key: segment number and value, fp, looks)."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps, looks = [], [], []
        for s in (0, 1):
            seg = ((fp >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            keys.append(seg | (s << 32))
            fps.append(fp)
            looks.append(np.zeros(len(fp), bool))
            for bit in range(32):
                on = (seg >> bit) & 1 == 1
                keys.append((seg[on] ^ (1 << bit)) | (s << 32))
                fps.append(fp[on])
                looks.append(np.ones(int(on.sum()), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(looks))], names=["key", "fp", "looks"])


def _stars(a, b):
    """Contract links to one star for each component that they form."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_components(len(ids), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _large_entry(segment: int, fp: np.ndarray, looks: np.ndarray):
    """Links within one table entry that join what all its verified pairs would join. Look-ups alone join nothing."""
    other = (fp >> np.uint64(32 * (1 - segment))) & np.uint64(0xFFFFFFFF)
    a, b = [], []

    def agree(rows, mask):
        if not len(rows):
            return
        part = other[rows] & ~np.uint64(mask)
        order = np.lexsort((looks[rows], part))  # table rows first
        rows, part = rows[order], part[order]
        start = np.concatenate([[True], part[1:] != part[:-1]])
        head = rows[np.flatnonzero(start)][np.cumsum(start) - 1]
        near = ~start & ~looks[head]
        a.append(fp[rows[near]])
        b.append(fp[head[near]])

    table = np.flatnonzero(~looks)
    if not len(table):
        return fp[:0], fp[:0]
    every = np.arange(len(fp))
    for i in range(32):
        agree(every, 1 << i)
        for j in range(i):
            agree(table, 1 << i | 1 << j)
    return _stars(np.concatenate(a), np.concatenate(b))


def _entry_links(key: np.ndarray, fp: np.ndarray, looks: np.ndarray):
    """Links of at most 2 bits among rows that are sorted by key. Bit 32 of a key is the segment that is looked up."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(cuts)
    out_a, out_b = [], []
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    rows = ranges(cuts[small], size[small])
    after = np.repeat(cuts[small] + size[small], size[small]) - rows - 1
    a, b = np.repeat(rows, after), ranges(rows + 1, after)
    ok = ~(looks[a] & looks[b])
    a, b = a[ok], b[ok]
    near = (fp[a] != fp[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= 2)
    out_a.append(fp[a[near]])
    out_b.append(fp[b[near]])
    for g in np.flatnonzero(size > SMALL):
        x = slice(cuts[g], cuts[g + 1])
        la, lb = _large_entry(int(key[cuts[g]] >> 32) & 1, fp[x], looks[x])
        out_a.append(la)
        out_b.append(lb)
    return _stars(np.concatenate(out_a), np.concatenate(out_b))


def _links(most: int | None):
    """Sorted (key, fp, looks) rows to links (a, b, key null, looks null). What is kept between batches is the last, unfinished table
    entry; the rows of an entry of more than ``most`` come out as they are (a: fp, b null)."""

    def links(cols):
        a, b = _entry_links(*cols)
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=["a", "b", "key", "looks"])

    def left(key, fp, looks):
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(key), pa.array(looks)], names=["a", "b", "key", "looks"])

    def emit(cols):
        """Whole entries."""
        key = cols[0]
        if most is not None and len(key) > most:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(cuts)
            hot = np.repeat(size > most, size)
            if hot.any():
                yield left(*(c[hot] for c in cols))
                cols = [c[~hot] for c in cols]
        if len(cols[0]):
            yield links(cols)

    def run(batches):
        rest, passing = None, None  # the unfinished entry; the key of one that is already known to be hot
        for batch in batches:
            cols = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if passing is not None and len(cols[0]):
                same = int(np.searchsorted(cols[0], passing, "right"))
                if same:
                    yield left(*(c[:same] for c in cols))
                    cols = [c[same:] for c in cols]
                if len(cols[0]):
                    passing = None
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
                rest = None
            if not len(cols[0]):
                continue
            at = int(np.searchsorted(cols[0], cols[0][-1]))
            if at:
                yield from emit([c[:at] for c in cols])
            rest = [c[at:] for c in cols]
            if most is not None and len(rest[0]) > most:
                passing = int(rest[0][0])
                yield left(*rest)
                rest = None
        if rest is not None:
            yield from emit(rest)

    return run


def _pieces(batches):
    """Rows of hot entries (a: fp, key, looks), once for each piece of the other segment, which the key then names, too."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        key = batch.column(1).to_numpy(zero_copy_only=False)
        other = np.where(key >> 32 == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
        for k, (low, high) in enumerate(zip(PIECES, PIECES[1:])):
            value = ((other >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key | (value << 33) | (k << 45)), batch.column(0), batch.column(2)], names=["key", "fp", "looks"])


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct values of ``fps.fp``: equal roots where a chain of links of at most 2 bits exists."""
    distinct = cut(fps.select("fp").distinct())
    probes = distinct.mapInArrow(_probes, "key long, fp long, looks boolean")
    shape = "a long, b long, key long, looks boolean"
    met = cut(probes.repartition("key").sortWithinPartitions("key").mapInArrow(_links(HOT), shape))
    hot = met.filter("b is null").select("a", "key", "looks").mapInArrow(_pieces, "key long, fp long, looks boolean")
    hot = hot.repartition("key").sortWithinPartitions("key").mapInArrow(_links(None), shape)
    comps = connected_components(met.filter("b is not null").select("a", "b").unionByName(hot.select("a", "b")))
    return distinct.join(comps, distinct.fp == comps.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long, fingerprint (16 hex digits), component_id for every row: the smallest doc_id that chains of fingerprints
    at most 2 bits apart reach.

    A null or blank text has fingerprint zero and is linked like any other. Rows with a null id take part; a component of
    null ids only has a null name. Repeated rows are separate rows of the same component. An empty table gives no rows."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    roots = fingerprint_components(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last; of equal ids, by a hash of the row; of equal
    rows, any). Columns stay as they are, whatever their names. Null and blank texts are one component. An empty table gives no rows."""
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), row_key(docs).alias("rk")).alias("row"), F.col(text_col).alias("text"))
    fps = cut(fingerprints(rows, id_col="row"))
    roots = fingerprint_components(fps.select("fp"))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("least"))
    return keep_rows(docs, least.select("least.rk"))


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")
