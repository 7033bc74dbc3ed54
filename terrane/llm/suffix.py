"""Suffix-array dedup: remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

Each 50-byte window belongs to the 24-byte string of least hash in it, its anchor; equal windows have equal anchors at equal places. So
windows meet by anchor, and a run of neighbouring windows with the same anchor travels as one segment:

1. distinct anchor hashes of a block of documents meet by hash, with how often they occur; two bits for each say whether another document
   has it, and whether it is hot, that is, in very many windows' runs of the corpus;
2. segments of such anchors, distinct within their block and with its smallest id, meet by the anchor's hash; a hot anchor, which would bring
   all that stands around a frequent passage to one place, has each of its windows as a segment, and these meet by the window's hash. There
   suffixes are sorted, first those that are whole segments, then those at which the windows of segments that differ start: by eight
   bytes at a time from the left, for all groups at once, so that only what agrees so far is looked at further. Runs of equal segments, then
   of equal windows, get their smallest id;
3. a bit for each window returns to the block: there is a smaller id.

Blocks are numbered by a hash of the id and dealt out once; how many there are, and how many buckets, follows from the size of the texts
alone, so that tasks are of one size at every scale. What is exchanged is in blobs whose order both sides know, so that answers are bits; it follows from
ids and texts, not from the order in which rows are fetched. A
string with any number of copies costs one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, block_of, pieces, ranges, text_bytes, text_size

ANCHOR = 24
#: Bytes of text for each block, each bucket of segments and each bucket of anchors.
BLOCK, SEGMENTS, ANCHORS = 5_000_000, 8_000_000, 40_000_000
#: An anchor of about as many runs of windows is hot. (Blocks give their counts rounded down to powers of two, 2**15 at most.)
HOT = 16_000
_R = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Stands for a null id, which is larger than any other.
NULL_ID = np.iinfo(np.int64).max


def words_of(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of ``raw``, as little-endian numbers."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,))


def hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (eight or more) from each place, by all of ``words_of``; the same wherever they are."""
    h = np.zeros(len(at), np.uint64)
    for k in range(0, size, 8):
        h = (h ^ words[at + min(k, size - 8)]) * _MIX
        h ^= h >> np.uint64(32)
    return h * _R


def anchor_runs(raw: np.ndarray, off: np.ndarray, length: int):
    """(text, first window, last window, anchor, anchor's hash) of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    h, r, span = raw.astype(np.uint64) + np.uint64(1), _R, 1
    while span < 8:  # polynomial hashes of 2, 4, 8 bytes
        h = h[:-span] * r + h[span:]
        r, span = np.uint64(int(r) * int(r) & 0xFFFFFFFFFFFFFFFF), span * 2
    h = (h[:-16] * r + h[8:-8]) * r + h[16:]  # three of 8
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _R
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    width, have = length - ANCHOR + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(np.diff(off) - length + 1, 0)
    at = ranges(off[:-1], windows)
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(windows)), windows)
    a = anchor[at]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    end = np.append(start[1:], len(at)) - 1
    return text[start], at[start], at[end], a[start], h[a[start]]


class Block:
    """The anchors of a block of texts and the order in which what they stand for is exchanged. Its rows, which come in another order each time that they
    are fetched, are in order of id and text here."""

    def __init__(self, table: pa.Table, buckets: int, length: int):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        self.doc_id = table["doc_id"]
        self.raw, self.off = text_bytes(table["text"])
        ids = self.doc_id.combine_chunks().cast(pa.int64())
        self.ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.length, self.buckets = length, buckets
        parts = []
        for i, j in pieces(self.off, 100_000):
            t, lo, hi, a, h = anchor_runs(self.raw[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i], length)
            parts.append((t + i, lo + self.off[i], hi + self.off[i], a + self.off[i], h))
        self.text, self.lo, self.hi, self.at, self.hash = (np.concatenate(x) for x in zip(*parts)) if parts else anchor_runs(self.raw[:0], np.zeros(1, np.int64), length)
        order = np.argsort((self.hash << np.uint64(40)) | (self.hash >> np.uint64(24)))  # buckets follow from the lower 24 bits
        new = np.concatenate([[True], self.hash[order][1:] != self.hash[order][:-1]]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        #: of each run of windows, the number of its anchor hash in an order by bucket
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.distinct = self.hash[order][first]
        doc = self.ids[self.text]
        low, high = np.full(len(first), NULL_ID), np.full(len(first), -1 << 63)
        if len(first):
            low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        self.several = low != high
        self.times = np.diff(np.append(first, len(order)))

    def bucket_of(self, h: np.ndarray, buckets: int | None = None) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFF)) * np.uint64(buckets or self.buckets) >> np.uint64(24)).astype(np.int64)

    def bounds(self, hashes: np.ndarray, buckets: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that occur and the bounds of their rows, of hashes in bucket order."""
        ids, first = np.unique(self.bucket_of(hashes, buckets), return_index=True)
        return ids, np.append(first, len(hashes))

    def segments(self, flags: np.ndarray, buckets: int):
        """Of the runs of windows with shared anchors, the distinct contents by bucket: (content of each such run, the runs' texts, first windows and
        last windows, per content: smallest id, first window, last window, anchor, hash). ``flags``: of each anchor, is it shared, is it hot. Each window
        of a hot anchor is a run of its own, whose hash is that of the window."""
        shared, hot = flags.reshape(-1, 2).T
        runs = np.flatnonzero(shared[self.number])
        text, lo, hi, at, h = self.text[runs], self.lo[runs], self.hi[runs], self.at[runs], self.hash[runs]
        alone = hot[self.number[runs]]
        if alone.any():
            many = np.where(alone, hi - lo + 1, 1)
            text, at, h, alone, hi = (np.repeat(x, many) for x in (text, at, h, alone, hi))
            lo = ranges(lo, many)
            hi[alone] = lo[alone]
            h[alone] = hashes(words_of(self.raw), lo[alone], self.length)
        data = self.raw.tobytes()
        seen: dict = {}
        key = np.fromiter((seen.setdefault(data[a : b + self.length], len(seen)) for a, b in zip(lo.tolist(), hi.tolist())), np.int64, len(lo))
        least = np.full(len(seen), NULL_ID)
        np.minimum.at(least, key, self.ids[text])
        first = np.empty(len(seen), np.int64)
        first[key[::-1]] = np.arange(len(lo))[::-1]
        order = np.lexsort((first, self.bucket_of(h[first], buckets)))
        place = np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        first = first[order]
        return place[key], text, lo, hi, least[order], lo[first], hi[first], at[first], h[first]


def _anchors(buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table, buckets, length)
        ids, bounds = b.bounds(b.distinct)
        log = np.minimum(np.frexp(b.times)[1] - 1, 15)
        packed = (b.distinct >> np.uint64(21) << np.uint64(5)) | (b.several * 16 + log).astype(np.uint64)
        six = np.ascontiguousarray(packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
        return pa.table({"bucket": pa.array(ids.astype(np.int32)), "blk": pa.array(np.full(len(ids), table["blk"][0].as_py(), np.int32)), "anchors": binary_rows(six, bounds * 6)})

    return run


def _shared(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For each anchor of each block, whether it is in another document and whether it is hot: two bits."""
        blobs = table["anchors"].to_pylist()
        n = [len(x) // 6 for x in blobs]
        wide = np.zeros((sum(n), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        v = wide.view("<u8").ravel()
        _, at, counts = np.unique(v >> np.uint64(5), return_inverse=True, return_counts=True)
        several = (v & np.uint64(16)) > 0
        shared = (counts > 1) | (np.bincount(at, several, len(counts)) > 0)
        times = np.bincount(at, np.left_shift(1, (v & np.uint64(15)).astype(np.int64)), len(counts))
        flags = np.stack([shared, shared & (times >= hot)], 1)[at]
        cuts = np.cumsum(n)[:-1]
        return pa.table({"blk": table["blk"], "bucket": table["bucket"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(flags, cuts)], pa.binary())})

    return run


def _answer(bounds, ids, replies: pa.Table, total: int, sizes=None) -> np.ndarray:
    """The bits of all buckets, in the block's order. ``bounds``: of the bits of each bucket."""
    out = np.zeros(total, bool)
    came = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist()))
    for bucket, i, j in zip(ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        out[i:j] = np.unpackbits(np.frombuffer(came[bucket], np.uint8), count=j - i).astype(bool)
    return out


def _segments(buckets: int, finer: int, length: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        b = Block(docs, buckets, length)
        ids, bounds = b.bounds(b.distinct)
        *_, least, lo, hi, at, h = b.segments(_answer(bounds * 2, ids, shared, 2 * len(b.distinct)), finer)
        ids, bounds = b.bounds(h, finer)
        size = hi - lo + length
        text = b.raw[ranges(lo, size)]
        return pa.table({
            "bucket": pa.array(ids.astype(np.int32)), "blk": pa.array(np.full(len(ids), docs["blk"][0].as_py(), np.int32)),
            "docs": binary_rows(least.astype(np.int64), bounds), "windows": binary_rows((hi - lo + 1).astype(np.uint8), bounds), "places": binary_rows((at - lo).astype(np.uint8), bounds),
            "text": binary_rows(text, np.concatenate([[0], np.cumsum(size)])[bounds]),
        })

    return run


# -------------------------------------------------------------------------------------------------------- suffix sorting


class Suffixes:
    """Sorts suffixes of ``buf`` by their first ``length`` bytes (a number for each suffix, or one for all). Suffixes of a group have one length, of
    eight or more, and ``buf`` has as many bytes from each."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.words = buf, words_of(buf)

    def extension(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many bytes from x and from y agree, up to ``length``: what orders can be checked with."""
        out, live = length.copy(), np.arange(len(x))
        for k in range(int(length.max(initial=0))):
            live = live[length[live] > k]
            differ = self.buf[x[live] + k] != self.buf[y[live] + k]
            out[live[differ]] = k
            live = live[~differ]
        return out

    def verified_runs(self, at: np.ndarray, group: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(the order of the suffixes ``at`` within groups (numbers in ascending order), starts of runs of equal suffixes): a radix sort from the left,
        all bytes of which are compared, eight at a time, the last eight of a length as they are (what is before them agrees by then). Groups in which
        all eight bytes are the same need no sorting; others are sorted by them and fall apart into the groups of the next eight."""
        length = np.broadcast_to(np.asarray(length, np.int64), at.shape)
        order = np.arange(len(at))
        new = np.concatenate([[True], group[1:] != group[:-1]])
        live = np.arange(len(at))  # places in groups of several whose bytes agree so far
        for k in range(0, int(length.max()), 8):
            start = new[live]
            several = ~start
            several[:-1] |= ~start[1:]
            live = live[several & (length[live] > k)]
            if not len(live):
                break
            first = np.flatnonzero(new[live])
            size = np.diff(np.append(first, len(live)))
            own = order[live]
            word = self.words[at[own] + np.minimum(k, length[live] - 8)]
            mixed = np.logical_or.reduceat(word != np.repeat(word[first], size), first)
            rows = np.flatnonzero(np.repeat(mixed, size))
            if len(rows):
                number = np.repeat(np.arange(int(mixed.sum())), size[mixed])
                by = np.lexsort((word[rows].byteswap(), number))
                order[live[rows]] = own[rows][by]
                word = word[rows][by]
                new[live[rows[1:]]] |= word[1:] != word[:-1]
        return order, np.flatnonzero(new)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that share their key with another row, by key; numbers of their groups, ascending)."""
    by = np.argsort(key)
    if not len(by):
        return by, by
    key = key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    several = ~new
    several[:-1] |= ~new[1:]
    return by[several], (np.cumsum(new) - 1)[several]


def _smaller(length: int):
    def run(table: pa.Table) -> pa.Table:
        """For each window of each block's segments, whether a smaller id has it: a bit."""
        blobs = {c: table[c].to_pylist() for c in ("docs", "windows", "places", "text")}
        doc = np.frombuffer(b"".join(blobs["docs"]), np.int64)
        windows = np.frombuffer(b"".join(blobs["windows"]), np.uint8).astype(np.int64)
        places = np.frombuffer(b"".join(blobs["places"]), np.uint8).astype(np.int64)
        buf = np.frombuffer(b"".join([*blobs["text"], b"\0"]), np.uint8)
        size = windows + length - 1
        starts = np.cumsum(size) - size
        text = Suffixes(buf)
        anchor = hashes(text.words, starts + places, ANCHOR)

        # equal segments of several blocks are one: they have the same anchor at the same place, and as many bytes
        least, one = doc.copy(), np.arange(len(doc))  # of each segment, its smallest id and which segment stands for it
        rows, group = _grouped((anchor ^ (size * 256 + places).astype(np.uint64)) * _MIX)
        if len(rows):
            own = size[rows]
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (own[1:] != own[:-1])]))  # keys that collide meet as windows
            order, runs = text.verified_runs(starts[rows], group, own)
            rows, many = rows[order], np.diff(np.append(runs, len(order)))
            least[rows] = np.repeat(np.minimum.reduceat(doc[rows], runs), many)
            one[rows] = np.repeat(rows[runs], many)
        first = np.flatnonzero(one == np.arange(len(one)))
        key = np.searchsorted(first, one)

        # of those that differ, windows meet if they have the same anchor at the same place
        w = windows[first]
        offsets = np.concatenate([[0], np.cumsum(w)])
        low = np.repeat(least[first], w)
        mine, _ = _grouped(anchor[first])
        mine.sort()
        at = ranges(starts[first][mine], w[mine])
        to_anchor = np.repeat(starts[first][mine] + places[first][mine], w[mine]) - at
        rows, group = _grouped((np.repeat(anchor[first][mine], w[mine]) ^ to_anchor.astype(np.uint64)) * _MIX)
        if len(rows):
            order, runs = text.verified_runs(at[rows], group, length)
            rows = ranges(offsets[mine], w[mine])[rows[order]]
            low[rows] = np.repeat(np.minimum.reduceat(low[rows], runs), np.diff(np.append(runs, len(order))))

        flags = low[ranges(offsets[key], windows)] < np.repeat(doc, windows)
        per = [len(x) for x in blobs["windows"]]
        cuts = np.concatenate([[0], np.cumsum(windows)])[np.cumsum(per)[:-1]]
        return pa.table({"blk": table["blk"], "bucket": table["bucket"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(flags, cuts)], pa.binary()), "step": pa.array(np.full(len(per), 2, np.int32))})

    return run


def _remove(buckets: int, finer: int, length: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        step = replies["step"].to_numpy()
        shared, smaller = (replies.filter(pa.array(step == k)) for k in (1, 2))
        b = Block(docs, buckets, length)
        ids, bounds = b.bounds(b.distinct)
        key, text, first, last, least, lo, hi, _, h = b.segments(_answer(bounds * 2, ids, shared, 2 * len(b.distinct)), finer)
        windows = hi - lo + 1
        offsets = np.concatenate([[0], np.cumsum(windows)])
        ids, bounds = b.bounds(h, finer)
        flags = _answer(offsets[bounds], ids, smaller, int(offsets[-1]))
        # a copy with a larger id than the block's least has all its windows in a smaller one
        many = last - first + 1
        hit = flags[ranges(offsets[key], many)] | np.repeat(b.ids[text] > least[key], many)
        change = np.zeros(len(b.raw) + 1, np.int64)
        at = ranges(first, many)[hit]
        change[at] += 1
        change[at + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        keep = ~gone
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]).astype(np.int8))
        inner = b.off[1:-1]
        split = inner[(inner > 0) & (inner < len(gone))]
        split = np.unique(split[gone[split - 1] & gone[split]]) if len(split) else split  # runs end with their text
        s = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
        e = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
        text = np.searchsorted(b.off, s, "right") - 1
        counts = np.bincount(text, minlength=len(docs))
        spans = pa.StructArray.from_arrays([pa.array(s - b.off[text]), pa.array(e - b.off[text])], names=["start", "end"])
        kept = np.concatenate([[0], np.cumsum(keep)])[b.off]
        return pa.table({"doc_id": b.doc_id, "n_bytes": pa.array(np.diff(b.off)), "kept": binary_rows(b.raw[keep], kept), "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)})

    return run


def dedup_substrings(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (binary, the bytes that are left), spans (removed [start, end) byte ranges) for every row.

    A null text counts as empty. A null id is larger than all others. Rows with equal ids never remove from each other.
    Texts shorter than ``length`` bytes stay as they are. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = text_size(rows, "text")
    n, finer, buckets = (max(1, -(-size // x)) for x in (BLOCK, SEGMENTS, ANCHORS))
    placed = rows.withColumn("blk", block_of(n, "doc_id")).repartition(n, "blk")
    anchors = placed.groupBy("blk").applyInArrow(_anchors(buckets, length), "bucket int, blk int, anchors binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared(HOT), "blk int, bucket int, bits binary")
    segments = placed.groupBy("blk").cogroup(shared.groupBy("blk")).applyInArrow(_segments(buckets, finer, length), "bucket int, blk int, docs binary, windows binary, places binary, text binary")
    smaller = segments.groupBy("bucket").applyInArrow(_smaller(length), "blk int, bucket int, bits binary, step int")
    replies = smaller.unionByName(shared.withColumn("step", F.lit(1)))
    return placed.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(_remove(buckets, finer, length), "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are pairs of hexadecimal digits here.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)
), least AS (
  SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS m FROM w GROUP BY s
), hit AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN least USING (s) WHERE coalesce(doc_id, 9223372036854775807) > m
), run AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM hit
), span AS (
  SELECT r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY r, k
), gap AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM (SELECT * FROM span UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d)
), kept AS (
  SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b DESC) AS k, sum(b - a) AS n_removed, count(*) FILTER (b > a) AS n_spans FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept JOIN d USING (r)
"""
