"""Fuzzy line dedup by MinHash.

1. Each batch of documents gives its distinct lines: a hash of the line, where it occurs, and MinHash signatures of its
   character shingles, cut into bands.
2. Lines meet by band. A group of lines that share a band is known by its members; groups with equal members, which most
   bands of a group of near-copies are, count once.
3. The lines of the groups are fetched from where they occur first, and their whole shingle sets compared (as 64-bit hashes). Large groups are cut into blocks; in
   each, lines are compared with each other and with one line of the group, its centre. What is similar to the centre is one component
   already, so that only the others go on to meet the other blocks.
4. A distributed union-find joins the links; the first occurrence of a component stays, all others go.

A line is known by 64 bits of an XXH3 hash; before it goes as an equal of another one, 32 further bits must agree.

What is kept between steps is in the checkpoint folder, compressed; texts are shuffled twice (to fetch, and to remove), signatures once.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, connected_components, cut, free_name, local_components, pieces, ranges, shuffle_partitions, stored, text_bytes
from .words import _WHITE

SHINGLE = 9
#: A line pair at the threshold of 0.8 shares a band with probability 1 - (1 - 0.8**4)**10 = 0.995.
BANDS, ROWS = 10, 4
#: Lines of a group that are compared with each other in one task.
BLOCK = 400

_RNG = np.random.default_rng(10)
_MUL = (_RNG.integers(0, 1 << 31, BANDS * ROWS) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(codes: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Band keys (a row of BANDS for each line) of lines codes[start:start+size]. A line shorter than a shingle is one shingle."""
    n = len(start)
    h, r, span = codes.astype(np.uint64) + np.uint64(1), int(_MIX), 1
    while span < SHINGLE - 1:
        h = h[:-span] * np.uint64(r) + h[span:] if len(h) > span else h[:0]
        r, span = r * r & 0xFFFFFFFFFFFFFFFF, span * 2
    h = h[:-1] * _MIX + codes[SHINGLE - 1 :] if len(h) > 1 else h[:0]
    h = (((h ^ (h >> np.uint64(31))) * _MIX) >> np.uint64(32)).astype(np.uint32)
    many = np.maximum(size - SHINGLE + 1, 0)
    low = np.empty((BANDS * ROWS, n), np.uint32)
    short = many == 0
    whole = (ids >> np.uint64(32)).astype(np.uint32)
    rows = np.flatnonzero(~short)
    for j in range(BANDS * ROWS):
        low[j, short] = whole[short] * _MUL[j] + _ADD[j]
    for i, k in pieces(np.concatenate([[0], np.cumsum(many[rows])]), 100_000):
        part = rows[i:k]
        v = h[ranges(start[part], many[part])]
        cuts = np.concatenate([[0], np.cumsum(many[part])[:-1]])
        for j in range(BANDS * ROWS):
            low[j, part] = np.minimum.reduceat(v * _MUL[j] + _ADD[j], cuts)
    return band_keys(low)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each column of BANDS * ROWS minima."""
    n = low.shape[1]
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(n, b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            x = (x ^ low[j]) * _MIX
            x ^= x >> np.uint64(29)
        keys[:, b] = x
    return keys


def split_lines(raw: np.ndarray, off: np.ndarray):
    """Lines of texts: (text, number within it, start, end, not blank)."""
    breaks = np.bincount(np.searchsorted(off, np.flatnonzero(raw == 10), "right") - 1, minlength=len(off) - 1)
    text = np.repeat(np.arange(len(off) - 1), breaks + 1)
    number = ranges(np.zeros(len(off) - 1, np.int64), breaks + 1)
    at = np.flatnonzero(raw == 10)
    first = np.cumsum(breaks + 1) - (breaks + 1)
    end = np.empty(len(text), np.int64)
    last = first + breaks
    end[last] = off[1:]
    inner = np.ones(len(text), bool)
    inner[last] = False
    end[inner] = at
    start = np.empty(len(text), np.int64)
    start[first] = off[:-1]
    start[1:][inner[:-1]] = end[:-1][inner[:-1]] + 1
    solid = np.concatenate([[0], np.cumsum(~_WHITE[raw])])
    filled = solid[end] > solid[start]
    return text, number, start, end, filled


def line_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits, and 32 more, for each raw[start:end]."""
    data = memoryview(raw.tobytes())
    got = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())])
    both = np.frombuffer(got, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].astype(np.uint32)


def _line_bands(raw: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Band keys of lines of UTF-8 bytes."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int32)  # code points before each byte place
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    a, b = before[start].astype(np.int64), before[end].astype(np.int64)
    return signatures(codes, a, b - a, ids)


def _scan(batches):
    """(lid, bands, occ) for the distinct lines that aren't blank."""
    for batch in batches:
        ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        raw, off = text_bytes(batch.column(2))
        for i, j in pieces(off, 500_000):
            part = raw[off[i] : off[j]]
            text, number, start, end, filled = split_lines(part, off[i : j + 1] - off[i])
            text, number, start, end = text[filled], number[filled], start[filled], end[filled]
            if not len(start):
                continue
            lid, check = line_hashes(part, start, end)
            distinct, first, at, counts = np.unique(lid, return_index=True, return_inverse=True, return_counts=True)
            bands = _line_bands(part, start[first], end[first], distinct)
            by = np.argsort(at, kind="stable")
            occ = pa.StructArray.from_arrays([pa.array(ids[i:j][text[by]]), pa.array(keys[i:j][text[by]]), pa.array(number[by].astype(np.int32)), pa.array(check[by].view(np.int32))], names=["d", "rk", "l", "c"])
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), binary_rows(_six(bands.ravel()), np.arange(len(distinct) + 1) * BANDS * 6), pa.ListArray.from_arrays(pa.array(bounds), occ)], names=["lid", "bands", "occ"])


def _six(keys: np.ndarray) -> np.ndarray:
    """The lower six bytes of every key; lines that differ and share them are told apart by the comparison."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _deal_bands(buckets: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lid = batch.column(0).to_numpy(zero_copy_only=False)
            wide = np.zeros((len(lid) * BANDS, 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 6)
            keys = wide.view("<u8").ravel()
            lids = np.repeat(lid, BANDS)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            ids, first = np.unique(bucket[by], return_index=True)
            bounds = np.append(first, len(by))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), binary_rows(keys[by], bounds), binary_rows(lids[by], bounds)], names=["bucket", "keys", "lids"])

    return run


def _groups(table: pa.Table) -> pa.Table:
    """(gid, lid, m): lines that share a band; gid is a hash of the members."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
    lids = np.frombuffer(b"".join(table["lids"].to_pylist()), np.int64)
    order = np.argsort(keys, kind="stable")
    keys, lids = keys[order], lids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    mixed = lids.view(np.uint64) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    gid = np.add.reduceat(mixed, first) if len(first) else mixed[:0]
    several = np.flatnonzero(size > 1)
    _, one = np.unique(gid[several], return_index=True)  # equal members
    several = several[one]
    at = ranges(first[several], size[several])
    return pa.table({"gid": np.repeat(gid[several], size[several]).view(np.int64), "lid": lids[at], "m": np.repeat(size[several], size[several]).astype(np.int32)})


def _fetch(batches):
    """Documents with the places of lines to (lid, line)."""
    for batch in batches:
        out_id, out_line = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for w in wanted:
                out_id.append(w["lid"])
                out_line.append(lines[w["l"]])
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_line, pa.string())], names=["lid", "line"])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _numbered(line_column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, shingle) of the distinct shingles of each line, shingles as 64-bit hashes of their characters."""
    rows, hashes = [], []
    for k, line in enumerate(line_column):
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
        width = min(SHINGLE, len(codes))
        h = np.full(max(1, len(codes) - SHINGLE + 1), np.uint64(width))
        for i in range(width):
            h = h * _MIX + codes[i : i + len(h)]
        h = np.unique((h ^ (h >> np.uint64(29))) * _MIX)
        rows.append(np.full(len(h), k))
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


#: In groups of up to so many lines, common shingles are counted pair by pair.
SMALL = 12


def _common_small(line: np.ndarray, hashes: np.ndarray, task: np.ndarray, n: int):
    """(a, b, shingles in common) of the pairs of lines of one task that have any."""
    if not len(line):
        return (np.zeros(0, np.int64),) * 3
    key = hashes ^ (task[line].view(np.uint64) * _MIX)
    order = np.argsort(key, kind="stable")
    key, line = key[order], line[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    after = end - np.arange(len(key)) - 1
    a, b = np.repeat(line, after), line[ranges(np.arange(len(key)) + 1, after)]
    pair, both = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_counts=True)
    return pair // n, pair % n, both


def _common_large(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Shingles in common of all pairs of ``n`` lines."""
    _, at = np.unique(hashes, return_inverse=True)
    kept = np.bincount(at) > 1  # shingles of one line only add nothing to what two lines have in common
    row, at = row[kept[at]], (np.cumsum(kept) - 1)[at[kept[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((n, n), np.float32)
    for k in range(0, int(kept.sum()), 2048):
        i, j = np.searchsorted(at, (k, k + 2048))
        held = np.zeros((n, min(2048, int(kept.sum()) - k)), np.float32)
        held[row[i:j], at[i:j] - k] = 1
        both += held @ held.T
    return both


def _compare(threshold: float, numbered):
    def run(table: pa.Table) -> pa.Table:
        """Exact similarities within each task: links (a, b) that join what all similar pairs would, and for lines that are not similar to their
        group's centre (side 2), where there is one, (a, null, gid). With lines of side 1, only those of side 0 are compared."""
        table = table.sort_by("task")
        lids, side, task = (table[c].to_numpy() for c in ("lid", "side", "task"))
        n = len(lids)
        row, hashes = numbered(table["line"].to_pylist())
        size = np.bincount(row, minlength=n).astype(np.float64)
        start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        many = np.diff(np.append(start, n))
        small = np.repeat(many, many) <= SMALL
        pick = small[row]
        a, b, both = _common_small(row[pick], hashes[pick], task, n)
        near = both >= threshold * (size[a] + size[b] - both)
        found = [(a[near], b[near])]
        for s, m in zip(start[many > SMALL], many[many > SMALL]):
            i, j = np.searchsorted(row, (s, s + m))
            both = _common_large(row[i:j] - s, hashes[i:j], m)
            own = size[s : s + m].astype(np.float32)  # whole numbers
            a, b = np.nonzero(both >= np.float32(threshold) * (own[:, None] + own - both) * np.float32(1 - 1e-6))
            exact = (a < b) & (both[a, b] >= threshold * (size[a + s] + size[b + s] - both[a, b]))
            found.append((a[exact] + s, b[exact] + s))
        a, b = (np.concatenate(x) for x in zip(*found))
        meet = (side[a] != 1) | (side[b] != 1)
        a, b = a[meet], b[meet]
        root = local_components(n, a, b)
        moved = np.flatnonzero(root != np.arange(n))
        apart = np.isin(task, task[side == 2])  # in tasks that have a centre
        apart[side == 2] = False
        apart[a[side[b] == 2]] = False
        apart[b[side[a] == 2]] = False
        far = np.flatnonzero(apart)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"a": np.concatenate([lids[moved], lids[far]]), "b": pa.concat_arrays([pa.array(lids[root[moved]]), none(len(far))]), "gid": pa.concat_arrays([none(len(moved)), pa.array(table["gid"].to_numpy()[far])]), "m": pa.array(table["m"].to_numpy()[np.concatenate([moved, far])])})

    return run


def _drop(names: list[str], text_at: int):
    def run(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for text, removed in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = text.split("\n") if text is not None else []
                total.append(len(lines))
                gone.append(len(removed or ()))
                if removed:
                    drop = set(removed)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(text)
            cols = list(batch.columns[:-1])
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return run


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similar(groups: DataFrame, texts: DataFrame, threshold: float, *, block: int, numbered=_numbered) -> DataFrame:
    """Links (a, b) that join what all pairs of a group (gid, lid, m) of a similarity of at least ``threshold`` would. ``texts``: (lid, line),
    of which ``numbered`` makes the shingles.

    No task has more than about two blocks of lines. Of a group of several blocks, lines that are similar to its centre (the
    smallest lid) are one component, whatever else they are similar to; the pairs among them are made within blocks only. Lines apart from
    it meet all blocks."""
    packs = 8 * shuffle_partitions(groups.sparkSession)  # many small tasks at a time
    group = ["gid", "m"]
    own = groups.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int"))

    def compared(rows: DataFrame, *task: str) -> DataFrame:
        rows = rows.withColumn("task", F.xxhash64(*group, *task)).withColumn("pack", F.pmod("task", F.lit(packs)).cast("int"))
        met = rows.select("pack", "task", "side", *group, "lid").join(texts, "lid").select("pack", "task", "side", *group, "lid", "line")
        return met.groupBy("pack").applyInArrow(_compare(threshold, numbered), "a long, b long, gid long, m int")

    centres = own.filter("blocks > 1").groupBy(*group, "blocks").agg(F.min("lid").alias("lid")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = cut(compared(own.select(*group, "i", "lid", F.lit(0).alias("side")).unionByName(centres.select(*group, "i", "lid", F.lit(2).alias("side"))), "i"))
    links = first.filter("b is not null").select("a", "b")
    far = first.filter("b is null").select(*group, F.col("a").alias("lid"))
    if far.isEmpty():
        return links
    many = cut(far.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("others")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = far.join(many, group).withColumn("k", F.pmod(F.xxhash64("lid", F.lit(1)), F.col("others")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / block).cast("int") - 1)))
    asked = own.join(many, group).withColumn("k", every("others"))
    rows = asking.select(*group, "i", "k", "lid", F.lit(0).alias("side")).unionByName(asked.select(*group, "i", "k", "lid", F.lit(1).alias("side")))
    return links.unionByName(compared(rows, "i", "k").filter("b is not null").select("a", "b"))


def dedup_lines(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text without repeated lines, and n_lines and n_removed (long; clashing columns of ``docs`` are replaced).

    Lines are what is between line breaks; equal lines and lines whose sets of 9-character shingles have a Jaccard similarity of at
    least ``threshold`` are linked, and of each component the first line stays, in the order of id (null last), then of a hash
    of the row, then of place. Blank lines always stay. Rows with equal id and text are one document, and both keep what
    it keeps. A null text stays null; a text whose lines all go becomes empty. An empty table gives no rows. Other columns stay, whatever
    their names. (Shingles are compared as 64-bit hashes; a pair of similar lines that are not equal becomes a candidate with
    probability 0.995 or more.)"""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    docs = docs.drop("n_lines", "n_removed")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    scan = stored(docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), key.alias("rk"), F.col(text_col)).mapInArrow(_scan, "lid long, bands binary, occ array<struct<d:bigint,rk:bigint,l:int,c:int>>"))
    distinct = scan.groupBy("lid").agg(F.first("bands").alias("bands"))
    groups = distinct.mapInArrow(_deal_bands(n), "bucket int, keys binary, lids binary").groupBy("bucket").applyInArrow(_groups, "gid long, lid long, m int")
    groups = cut(groups.distinct())
    del distinct
    _release(spark)

    found = scan.select("lid", F.array_min("occ").alias("first"), F.size("occ").alias("n")).groupBy("lid").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    found = cut(found.join(groups.select(F.col("lid").alias("g")).distinct(), F.col("lid") == F.col("g"), "left").filter("n > 1 or g is not null"))
    wanted = found.filter("g is not null").groupBy("first.rk").agg(F.collect_list(F.struct("lid", "first.l")).alias("w"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), key.alias("rk")).join(wanted, "rk").select("t", "w").mapInArrow(_fetch, "lid long, line string").dropDuplicates(["lid"])
    texts = stored(texts)
    _release(spark)
    links = similar(groups, texts, threshold, block=BLOCK)
    comps = connected_components(links)

    rooted = found.join(comps, found.lid == comps.node, "left").select("lid", "first", "n", F.coalesce("component", "lid").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("all")).filter("all > 1")
    stays = rooted.join(best, "root").select("lid", "stays", F.col("first.c").alias("check"))
    gone = scan.select("lid", "occ").join(stays, "lid").select("stays", "check", F.explode("occ").alias("o")).filter("o <> stays and o.c = check").groupBy("o.rk").agg(F.collect_set("o.l").alias("removed"))
    gone = cut(gone)
    _release(spark)
    name = free_name(docs, "rk")
    joined = docs.withColumn(name, key).join(gone.withColumnsRenamed({"rk": name, "removed": free_name(docs, "removed")}), name, "left").drop(name)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_drop(docs.columns, docs.columns.index(text_col)), f"{shape}, n_lines long, n_removed long")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
