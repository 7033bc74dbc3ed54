"""LM scoring by online logistic context mixing.

The text is a stream of bits: its lower-cased words, each followed by a space, then an end byte. Bit predictors over several contexts are
mixed in the logistic domain by gated weights, in two layers.

The first layer has, for every order k up to the highest, how often a 0 and a 1 came in the training documents after the last k bytes and the
bits of the current byte so far. Its weights (the gate: how much a predictor and the next longer one have seen) are learnt
online by gradient steps, and the mixed probability is refined adaptively from what came true at similar predictions. Both are the
same for all texts.

The second layer learns along each text, from its start: it mixes the first layer's prediction, what came last in this very text after the same
bytes (hashed, with how often in a row that came), and what came in the training documents after the same REACH bytes (hashed; one
such context in EVERY, chosen by its content, predicts the SPAN bytes after it). The gate: how sure the last two are. Weights change after every CHUNK bytes
by the errors in them, so that no bit is predicted from itself or from what follows. A training text's own occurrence is left out of the counts after long contexts, which
would else be all that most of them have seen. The bits' costs add up to the cost of the text.

Counts come from all training documents; those of the orders are exact, no two contexts share one. They are gathered as counts of byte strings
of one more than the highest order, from which everything follows. Strings with the same last SHARED bytes before the current
one share a bucket, which therefore has all counts of the orders from SHARED up; these grow with the corpus and stay where they
are. Lower orders have 256 entries for each possible context, which are broadcast. Each weight step sees a string as often as it
occurred and leaves its own occurrence out of the counts; a bucket takes its strings in the order of a hash, and the weights of the buckets
are averaged. What the first layer says of a byte depends on the bytes before it only: the distinct strings of a block of documents go to
their buckets, are computed there once for all blocks, and return, by the same exchanges as the word counts and the long contexts.

How many blocks and buckets there are follows from the size of the texts alone, and so do scores: neither partitions nor their number matter.

The base score is an exact unigram model over words; the word counts meet by word, and totals return to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, block_of, cut, pieces, text_bytes, text_size
from .quality import held_out
from .words import Words

#: Orders below this have complete tables (2**24 entries for order 2); strings are placed by so many bytes of their context.
SHARED = 3
#: Bytes of text for each block of documents and each bucket of contexts.
BLOCK, BUCKET = 5_000_000, 16_000_000
#: Long contexts: their bytes, one in how many is kept, and for how many bytes it predicts.
REACH, EVERY, SPAN = 16, 64, 24
#: Bytes after which the second layer's weights change, its step, and the unit of its quantised predictions.
CHUNK, STEP, UNIT = 256, np.float32(0.0015), np.float32(12 / 127)
#: The second layer's weights at the start, by how sure a long context (rows: none, seen once, more often) and the text itself are.
START = np.array([[[1, 0, 0], [1, 0.1, 0], [0.9, 0.25, 0]], [[0.5, 0, 0.8], [0.5, 0.1, 0.8], [0.45, 0.2, 0.8]], [[0.4, 0, 0.9], [0.4, 0.1, 0.9], [0.35, 0.2, 0.9]]], np.float32)
#: Distinct byte strings that a task holds before it passes them on.
HELD = 3_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
GATES, NEXT = 13, 4

# Counts are kept as levels: exact below 32, then 8 to a doubling.
_LEVELS = np.concatenate([np.arange(32), 32 * 2 ** (np.arange(1, 225) / 8)])


def to_levels(counts: np.ndarray) -> np.ndarray:
    big = 31 + np.rint(8 * np.log2(np.maximum(counts, 1) / 32))
    return np.where(counts < 32, counts, np.clip(big, 32, 255)).astype(np.uint8)


def _lookups(delta: float):
    """For a slot's two levels (65,536 cases): the stretched probability, the gate, and the level with one occurrence less."""
    n0, n1 = _LEVELS[np.arange(65536) & 255], _LEVELS[np.arange(65536) >> 8]
    st = np.log((n1 + delta) / (n0 + delta)).astype(np.float32)
    gate = np.minimum(np.ceil(np.log2(n0 + n1 + 1)), GATES - 1).astype(np.int32)
    pure = np.minimum(n0, n1) == 0
    st[(n0 + n1) == 0] = 0
    nxt = np.select([n0 + n1 == 0, (n0 + n1 <= 3), pure], [0, 1, 2], 3).astype(np.int32)
    q = np.arange(65536)
    less = [np.where((q & 255) > 0, np.where((q & 255) < 32, q - 1, q), q).astype(np.uint16), np.where((q >> 8) > 0, np.where((q >> 8) < 32, q - 256, q), q).astype(np.uint16)]
    return st, gate, nxt, less


def suffixes(strings: np.ndarray, order: int) -> np.ndarray:
    """The last byte and the ``order`` bytes before it."""
    return strings & np.uint64((1 << 8 * (order + 1)) - 1)


def buckets_of(strings: np.ndarray, buckets: int) -> np.ndarray:
    h = ((strings >> np.uint64(8)) & np.uint64((1 << 8 * SHARED) - 1)) * _A
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that occur, and their bounds."""
    by = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")  # small numbers sort faster
    placed = bucket[by]
    first = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]])[: len(placed)])
    return by, placed[first], np.append(first, len(by))


def byte_strings(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text's stream, it and the ``order`` bytes before it, as one number; and the texts' bounds. Before
    the start of a text are zero bytes."""
    n, data = len(words.first) - 1, memoryview(words.buf)
    some = np.diff(words.first) > 0
    starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts[some], ends[some] = words.start[words.first[:-1][some]], words.end[words.first[1:][some] - 1] + 1
    blank = bytes(order)
    body = np.frombuffer(b"".join([x for a, b in zip(starts.tolist(), ends.tolist()) for x in (blank, data[a:b], b"\0")]), np.uint8)
    off = np.concatenate([[0], np.cumsum(ends - starts + 1)])  # with the end byte
    out, have, last, span = None, 0, body.astype(np.uint64), 1
    while span <= order + 1:  # the last 1, 2, 4, 8 bytes, of which the wanted number is made
        if (order + 1) & span:
            if out is None:
                out = last.copy()
            else:
                out[have:] |= last[: len(last) - have] << np.uint64(8 * have)
            have += span
        if span * 2 <= order + 1:
            longer = last.copy()
            longer[span:] |= last[:-span] << np.uint64(8 * span)
            last = longer
        span *= 2
    real = np.ones(len(body), bool)
    real[((off[:-1] + np.arange(n) * order)[:, None] + np.arange(order)).ravel()] = False
    return out[real], off


def pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Compressed values[bounds[i]:bounds[i+1]], first bytes of all first."""
    to, width = zstandard.ZstdCompressor(level=1), values.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    return pa.array([to.compress(np.ascontiguousarray(raw[i:j].T)) for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


# ------------------------------------------------------------------------------------------------------------- learning


def count_strings(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, strings, counts) of ``docs.text``: blobs of distinct strings."""

    def blobs(strings, counts):
        by, ids, bounds = by_bucket(buckets_of(strings, buckets))
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pack(strings[by], bounds), pack(counts[by].astype(np.int64), bounds)], names=["bucket", "strings", "counts"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for i, j in pieces(off):
                strings, _ = byte_strings(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i]), order)
                held.append(_counted(strings))
                rows += len(held[-1][0])
                if rows > HELD:
                    held = [merge_counts(held)]
                    rows = len(held[0][0])
                    if rows > HELD // 2:
                        yield blobs(*held[0])
                        held, rows = [], 0
        if held:
            yield blobs(*merge_counts(held))

    return docs.select("text").mapInArrow(run, "bucket int, strings binary, counts binary")


def _counted(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings in order, and how often each occurs."""
    strings = np.sort(strings)
    first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]])[: len(strings)])
    return strings[first], np.diff(np.append(first, len(strings)))


def merge_counts(parts) -> tuple[np.ndarray, np.ndarray]:
    s, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(s, kind="stable")
    s, c = s[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.add.reduceat(c, first) if len(s) else c


def _merged(table: pa.Table) -> pa.Table:
    s, c = merge_counts(list(_blobs(table)))
    whole = np.array([0, len(s)])
    return pa.table({"bucket": table["bucket"][:1], "strings": pack(s, whole), "counts": pack(c, whole)})


def _blobs(table):
    """Strings and counts of a table, or a batch, of (bucket, strings, counts)."""
    for s, c in zip(table.column("strings").to_pylist(), table.column("counts").to_pylist()):
        yield unpack(s, np.uint64), unpack(c, np.int64)


def _slot_counts(order: int, block: int):
    """Blobs of strings to blobs of the counts of orders below SHARED, by (order, block of entries)."""

    def run(batches):
        for batch in batches:
            for strings, counts in _blobs(batch):
                counts = counts.astype(np.float64)
                last = (strings & np.uint64(255)).astype(np.int64)
                for k in range(min(order + 1, SHARED)):
                    ctx = (suffixes(strings, k) >> np.uint64(8) << np.uint64(8)).astype(np.int64)
                    at, bit = [], []
                    for i in range(7, -1, -1):
                        at.append(ctx | (last | 256) >> (i + 1))
                        bit.append((last >> i) & 1)
                    at, bit, w = np.concatenate(at), np.concatenate(bit), np.tile(counts, 8)
                    ids, inv = np.unique(at, return_inverse=True)
                    n1 = np.bincount(inv, w * bit, len(ids))
                    n0 = np.bincount(inv, w, len(ids)) - n1
                    cuts = np.searchsorted(ids, np.arange(0, (1 << 8 * (k + 1)) + block, block))
                    some = np.flatnonzero(np.diff(cuts))
                    bounds = np.append(cuts[some], len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array((k * 1_000_000 + some).astype(np.int32)), binary_rows(ids.astype(np.int32), bounds), binary_rows(n0, bounds), binary_rows(n1, bounds)], names=["part", "ids", "n0", "n1"])

    return run


def _dense(block: int):
    """Rows sorted by part to the parts' packed levels; what is held is one block of sums."""

    def packed(part, n):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(*n).tobytes()], pa.binary())], names=["part", "levels"])

    def run(batches):
        now, n = None, None
        for batch in batches:
            for part, ids, *both in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if n is not None:
                        yield packed(now, n)
                    now, n = part, [np.zeros(block), np.zeros(block)]
                at = np.frombuffer(ids, np.int32) % block
                for total, x in zip(n, both):
                    total[at] += np.frombuffer(x, np.float64)
        if n is not None:
            yield packed(now, n)

    return run


def _packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return to_levels(n1).astype(np.uint16) << 8 | to_levels(n0)


def exact_counts(strings: np.ndarray, counts: np.ndarray, order: int) -> list:
    """For each number of bits that are still to come after a bit, the sorted bits before it (context and current byte) and their
    packed levels. The last entry is a sentinel, for bits that are not there."""
    s = suffixes(strings, order)
    s, c = merge_counts([(s, counts.astype(np.float64))])
    out = []
    for i in range(8):
        before = s >> np.uint64(i + 1)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(s) else np.zeros(0, np.int64)
        ones = np.add.reduceat(c * ((s >> np.uint64(i)) & np.uint64(1)), first) if len(s) else c
        every = np.add.reduceat(c, first) if len(s) else c
        out.append((np.append(before[first], ~np.uint64(0)), np.append(_packed(every - ones, ones), np.uint16(0))))
    return out


@dataclass
class Model:
    """Tables of packed levels of the orders below SHARED, exact counts of the others for the strings of one bucket, mixing
    weights by (order, gate, gate of the next order), and the refinement."""

    tables: list[np.ndarray]
    weights: np.ndarray
    refine: np.ndarray
    delta: float = 0.08

    def __post_init__(self):
        self.look = _lookups(self.delta)
        self.over(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def over(self, strings: np.ndarray, counts: np.ndarray) -> Model:
        """Take the counts of a bucket's training strings."""
        self.counts = {k: exact_counts(strings, counts, k) for k in range(SHARED, len(self.weights))}
        return self

    def levels(self, strings: np.ndarray, order: int, i: int) -> np.ndarray:
        """Packed levels for the bit of the last byte after which ``i`` are to come."""
        s = suffixes(strings, order)
        if order < SHARED:
            return self.tables[order][((s >> np.uint64(8) << np.uint64(8)) | ((s & np.uint64(255)) | np.uint64(256)) >> np.uint64(i + 1)).astype(np.int64)]
        keys, levels = self.counts[order][i]
        s >>= np.uint64(i + 1)
        at = np.searchsorted(keys, s)
        return np.where(keys[at] == s, levels[at], np.uint16(0))

    def bits(self, strings: np.ndarray, own: bool = False):
        """For each of the 8 bits of the last byte: node, bit, stretched predictions and weight cells by order. ``own``: without
        one occurrence of the string itself."""
        st, gate, nxt, less = self.look
        last = (strings & np.uint64(255)).astype(np.int64)
        orders = len(self.weights)
        for i in range(7, -1, -1):
            node, bit = (last | 256) >> (i + 1), (last >> i) & 1
            x = np.empty((orders, len(strings)), np.float32)
            cell = np.empty(x.shape, np.int32)
            above = np.zeros(len(strings), np.int32)
            for k in range(orders - 1, -1, -1):
                q = self.levels(strings, k, i)
                if own:
                    q = np.where(bit == 1, less[1][q], less[0][q])
                x[k] = st[q]
                cell[k] = (k * GATES + gate[q]) * NEXT + above
                above = nxt[q]
            yield node, bit, x, cell

    def mixed(self, x, cell):
        return np.clip((self.weights.ravel()[cell] * x).sum(0), -12, 12)

    def refined(self, node, dot):
        """The probability of a 1: half the mixed one, half what came true at such predictions, between two grid points."""
        p = 1 / (1 + np.exp(-dot))
        g = (dot + 12) * (32 / 24)
        low = np.minimum(g.astype(np.int64), 31)
        f = g - low
        r = self.refine[node, low] * (1 - f) + self.refine[node, low + 1] * f
        return np.clip((p + r) / 2, 1e-6, 1 - 1e-6)

    def predictions(self, strings: np.ndarray) -> np.ndarray:
        """For each string, the probability of each of the last byte's bits as it is, after the bytes and bits before it: stretched, in UNITs."""
        out = np.empty((len(strings), 8), np.int8)
        for i in range(0, len(strings), 65_536):
            part = strings[i : i + 65_536]
            for k, (node, bit, x, cell) in enumerate(self.bits(part)):
                p = self.refined(node, self.mixed(x, cell))
                out[i : i + len(part), k] = np.rint(np.log(p / (1 - p)) / UNIT).clip(-127, 127) * (2 * bit - 1)
        return out

    def log10(self, strings: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after those before it, by this layer alone."""
        return -np.log1p(np.exp(-self.predictions(strings) * np.float64(UNIT))).sum(1) / np.log(10)


def _grid() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, 33))), (256, 1))


def _learn_weights(model_of, rate: float):
    """Online steps over the strings of each bucket; its weights, to be averaged."""

    def run(batches):
        model = model_of()
        for batch in batches:
            for strings, counts in _blobs(batch):
                steps, weights, seen = 0.0, model.weights.astype(np.float64).ravel().copy(), np.full(model.weights.size, 1e-3)
                counts = counts.astype(np.float64)
                model.over(strings, counts)
                mix = np.argsort((strings * _A) ^ (strings * _B) >> np.uint64(29), kind="stable")
                for i in range(0, len(mix), 8192):
                    rows = mix[i : i + 8192]
                    w = counts[rows] / counts[rows].mean()
                    for _, bit, x, cell in model.bits(strings[rows], own=True):
                        p = 1 / (1 + np.exp(-np.clip((weights[cell] * x).sum(0), -12, 12)))
                        g = np.bincount(cell.ravel(), ((bit - p) * w * x).ravel(), len(weights)) / len(rows)
                        seen += g * g
                        weights += rate * g / np.sqrt(seen)
                    steps += counts[rows].sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights), dtype=np.int32)), pa.array(weights * steps), pa.array(np.full(len(weights), steps))], names=["i", "a", "b"])

    return run


def _learn_refinement(model_of):
    """Sums of what came true, by node and mixed prediction."""

    def run(batches):
        model = model_of()
        hit, all_ = np.zeros(256 * 33), np.zeros(256 * 33)
        for batch in batches:
            for strings, counts in _blobs(batch):
                counts = counts.astype(np.float64)
                model.over(strings, counts)
                for i in range(0, len(strings), 65_536):
                    part, w = strings[i : i + 65_536], counts[i : i + 65_536]
                    for node, bit, x, cell in model.bits(part, own=True):
                        at = node * 33 + np.rint((model.mixed(x, cell) + 12) * (32 / 24)).astype(np.int64)
                        all_ += np.bincount(at, w, len(all_))
                        hit += np.bincount(at, w * bit, len(hit))
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(hit[some]), pa.array(all_[some])], names=["i", "a", "b"])

    return run


@dataclass
class Trained:
    """What was learnt. ``model`` makes the model on any executor, to be given the strings of a bucket."""

    strings: DataFrame
    model: Callable[[], Model]

    def __call__(self) -> Model:
        """The model of all strings, which come to the driver; for small corpora."""
        got = [(unpack(r["strings"], np.uint64), unpack(r["counts"], np.int64)) for r in self.strings.toLocalIterator()]
        return self.model().over(*merge_counts(got)) if got else self.model()


def train(docs: DataFrame, *, order: int = 5, rate: float = 0.02, buckets: int = 1) -> Trained:
    """Learn the first layer from all rows of ``docs.text``. To the driver come the tables of the orders below SHARED (at most 34 MB, whatever the
    input), the weights and the refinement (some thousand numbers), summed up before."""
    spark = docs.sparkSession
    block = 1 << 14
    strings = count_strings(docs, order, buckets)
    strings = cut(strings.groupBy("bucket").applyInArrow(_merged, "bucket int, strings binary, counts binary"))
    dense = strings.mapInArrow(_slot_counts(order, block), "part int, ids binary, n0 binary, n1 binary")
    dense = dense.repartition("part").sortWithinPartitions("part").mapInArrow(_dense(block), "part int, levels binary")
    tables = [np.zeros(1 << 8 * (k + 1), np.uint16) for k in range(min(order + 1, SHARED))]
    for row in dense.toLocalIterator():
        k, at = divmod(row["part"], 1_000_000)
        got = np.frombuffer(row["levels"], np.uint16)[: len(tables[k])]
        tables[k][at * block : at * block + len(got)] = got
    start = np.zeros((order + 1, GATES, NEXT), np.float32)
    start[:, 1:] = 0.3
    sent = spark.sparkContext.broadcast(tables)
    learnt = lambda run: strings.mapInArrow(run, "i int, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    got = learnt(_learn_weights(lambda: Model(sent.value, start, _grid()), rate))
    weights = start.copy().ravel()
    weights[got["i"]] = (got["a"] / got["b"]).round(6)  # sums of the buckets come in any order
    weights = weights.reshape(start.shape)
    got = learnt(_learn_refinement(lambda: Model(sent.value, weights, _grid())))
    refine, strength = _grid().ravel(), 20.0
    at = got["i"].to_numpy()
    refine[at] = (got["a"].to_numpy() + strength * refine[at]) / (got["b"].to_numpy() + strength)
    refine = refine.reshape(256, 33)
    return Trained(strings, lambda: Model(sent.value, weights, refine))


# ------------------------------------------------------------------------------------------------------- the second layer

#: Counts of long contexts: their levels, and what a level of ones over a level of zeros says, in UNITs.
_FEW = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 32, 64, 128, 512, 4096])
_LONG = np.rint(np.log((_FEW[:, None] + 0.05) / (_FEW[None, :] + 0.05)) / UNIT).clip(-127, 127).astype(np.int8)
#: What came last in a text, so often in a row: what that says, in UNITs.
_LAST = np.rint(np.log((np.arange(9) + 0.4) / 0.4) / UNIT).clip(0, 127).astype(np.int8)
_SHIFTS = np.arange(7, -1, -1, dtype=np.uint8)
#: By how often in a row, and by the bits in which a byte differs from the guess: what the guess says of each bit as it is (8 numbers of 8
#: bits); bits after the first one that differs are not guessed.
_DIFFER = np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS
_GUESS = (_LAST[:, None, None] * ((_DIFFER == 0).astype(np.int8) - (_DIFFER == 1).astype(np.int8))).view(np.int64).ravel()


def few(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_FEW, counts, "right") - 1).astype(np.uint8)


def long_contexts(stream: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, context) of every byte of the streams that has REACH bytes of its text before it, where the hash of these chooses it."""
    places, contexts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in range(0, len(stream) - REACH, 65_536):
        h, r, span = stream[i : i + 65_536 + REACH - 1].astype(np.uint64) + np.uint64(1), int(_A), 1
        while span < REACH:
            h = h[:-span] * np.uint64(r) + h[span:]
            r, span = r * r & 0xFFFFFFFFFFFFFFFF, span * 2
        h = (h ^ (h >> np.uint64(31))) * _B
        h ^= h >> np.uint64(29)
        at = np.flatnonzero(h & np.uint64(EVERY - 1) == 0)
        places.append(at + i)
        contexts.append(h[at] >> np.uint64(16))
    at, h = np.concatenate(places), np.concatenate(contexts)
    inside = at + REACH < off[np.searchsorted(off, at, "right")]  # of the text in which the context starts
    return at[inside] + REACH, h[inside]


def following(stream: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SPAN bytes from each place on as numbers of eight bytes; zeros after the end of its text."""
    if not len(at):
        return np.zeros((0, SPAN // 8), np.uint64)
    place = at[:, None] + np.arange(SPAN)
    byte = stream[np.minimum(place, len(stream) - 1)]
    byte[place >= off[np.searchsorted(off, at, "right")][:, None]] = 0
    return byte.view(">u8").astype(np.uint64)


def ordered(ctx: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by context and by what follows it, and which of them, in that order, differ from the one before."""
    by = np.argsort(ctx)
    new = np.ones(len(by), bool)
    new[1:] = ctx[by][1:] != ctx[by][:-1]
    several = ~new
    several[:-1] |= ~new[1:]
    some = by[several]  # most contexts have one entry; the others are put in order among themselves
    by[several] = some[np.lexsort((*after[some].T[::-1], ctx[some]))]
    at = np.flatnonzero(~new)
    new[at] = (after[by[at]] != after[by[at - 1]]).any(1)
    return by, new


def _leading(x: np.ndarray) -> np.ndarray:
    """How many of the 64 bits are zero before the first one."""
    n = np.zeros(len(x), np.int64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        empty = x < (np.uint64(1) << np.uint64(64 - step))
        n[empty] += step
        x[empty] <<= np.uint64(step)
    return n + (x == 0)


def long_counts(ctx: np.ndarray, after: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of (context, SPAN bytes after it, how often in training documents), sorted and distinct: of those whose context has one entry only, the
    level of its count, else 255; and for the latter, in order, the levels of zeros and ones (4 bits each) of every bit after the context and
    the bits before it."""
    new = np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1
    head = np.where(several, 255, few(counts)).astype(np.uint8)
    c, bits, n = ctx[several], after[several], counts[several]
    body = np.zeros((len(c), 8 * SPAN), np.uint8)
    if len(c):
        differ = bits[1:] ^ bits[:-1]
        word = (differ != 0).argmax(1)
        agree = 64 * word + _leading(differ[np.arange(len(word)), word])
        agree = np.concatenate([[-1], np.where(c[1:] != c[:-1], -1, agree)])
        for d in range(8 * SPAN):
            starts = np.flatnonzero(agree < d)
            bit = bits[:, d // 64] >> np.uint64(63 - d % 64) & np.uint64(1)
            ones = np.add.reduceat(n * bit.astype(np.int64), starts)
            every = np.add.reduceat(n, starts)
            body[:, d] = np.repeat(few(every - ones) << 4 | few(ones), np.diff(np.append(starts, len(c))))
    return head, body


def spread_long(stream: np.ndarray, off: np.ndarray, at: np.ndarray, head: np.ndarray, body: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What long contexts say of each bit of the streams as it is, in UNITs, as a table (8 numbers of 8 bits a row) and the row of each byte, and how sure they
    are of each byte (0 to 2). ``head``, ``body``: of the places ``at``, as from ``long_counts``. The last context before a byte counts. ``learnt``: of
    each text, whether the counts hold it; its own occurrence is left out then (counts above 8 are about as large without it)."""
    row, sure = np.zeros(len(stream), np.int32), np.zeros(len(stream), np.uint8)
    tables = [np.repeat(_LONG[:, :1], 8, 1)]  # one row for each level of a context with one entry; at level 0 it says nothing
    if len(at):
        end = np.minimum(np.minimum(at + SPAN, np.append(at[1:], len(stream))), off[np.searchsorted(off, at, "right")])
        inside = np.cumsum(head == 255) - 1  # of the body
        own = learnt[np.searchsorted(off, at, "right") - 1]
        head = head - (own & (head > 0) & (head <= 8))
        rows = len(tables[0])
        for k in range(SPAN):
            some = np.flatnonzero(at + k < end)
            place, one = at[some] + k, head[some] != 255
            row[place[one]] = head[some][one]
            sure[place[one]] = np.minimum(head[some][one], 2)
            place, some = place[~one], some[~one]
            pair = body[inside[some], 8 * k : 8 * k + 8]
            bits = (stream[place][:, None] >> _SHIFTS & 1).astype(bool)
            zeros, ones, less = pair >> 4, pair & 15, own[some][:, None]
            zeros, ones = zeros - (less & ~bits & (zeros > 0) & (zeros <= 8)), ones - (less & bits & (ones > 0) & (ones <= 8))
            tables.append(np.where(bits, _LONG[ones, zeros], _LONG[zeros, ones]))
            row[place] = rows + np.arange(len(place))
            sure[place] = np.minimum(_FEW[zeros[:, 0]] + _FEW[ones[:, 0]], 2)
            rows += len(place)
    return np.concatenate(tables).astype(np.int8), row, sure


def last_seen(strings: np.ndarray, place: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte, how often in a row the same bytes before it were followed by what they were followed by last in the same text, and the bits in which it
    differs from that (a row of _GUESS); and how sure that is (0 to 2). ``strings[place]``: of all texts' bytes, each after those before it;
    ``strings`` are in order."""
    before = strings >> np.uint64(8)
    context = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))[: len(strings)].astype(np.uint64)
    byte = (strings & np.uint64(255)).astype(np.uint8)
    row, sure = np.zeros(len(place), np.int16), np.zeros(len(place), np.uint8)
    for i, j in pieces(off, 200_000):
        part = slice(off[i], off[j])
        row[part], sure[part] = _last_seen(context.take(place[part]), byte.take(place[part]), off[i : j + 1] - off[i])
    return row, sure


def _last_seen(context: np.ndarray, byte: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(context)
    bits, width = n.bit_length(), int(context.max(initial=0)).bit_length()
    if bits + width + len(off).bit_length() > 64:
        raise OverflowError("a block is too large")
    mask = np.uint64((1 << bits) - 1)
    key = context << np.uint64(bits)
    key |= np.repeat(np.arange(len(off) - 1, dtype=np.uint64) << np.uint64(bits + width), np.diff(off))
    key |= np.arange(n, dtype=np.uint64)
    key.sort()  # by text and context, then by place
    order = (key & mask).astype(np.int64)
    key >>= np.uint64(bits)
    sorted_ = byte.take(order)
    same, run = np.zeros(n, bool), np.ones(n, bool)
    np.equal(key[1:], key[:-1], out=same[1:])
    run[1:] = ~same[1:] | (sorted_[1:] != sorted_[:-1])
    run = np.flatnonzero(run)
    inner = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))  # how often in a row it came before
    often, guess = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    later = np.flatnonzero(same)
    to = order.take(later)
    often[to] = np.minimum(inner.take(later - 1) + 1, 8)
    guess[to] = sorted_.take(later - 1)
    return often.astype(np.int16) << 8 | (guess ^ byte), np.where(often > 2, 2, np.minimum(often, 1)).astype(np.uint8)


def learn_along(inputs: list[tuple[np.ndarray, np.ndarray]], gate: np.ndarray, off: np.ndarray, step: np.float32 = STEP, lanes: int = 64) -> np.ndarray:
    """The natural logarithm of each text's probability. ``inputs``: for each predictor, what it says of each bit as it is, in UNITs, as a table and the row of each
    byte of all streams; ``gate``: of each byte. Texts of about one length go through their chunks side by side, so many at a time; each has weights of
    its own."""
    by = np.argsort(-np.diff(off), kind="stable")
    inputs = [(table.view(np.int64).ravel(), row) for table, row in inputs]
    out = np.zeros(len(by))
    for k in range(0, len(by), lanes):
        some = by[k : k + lanes]
        out[some] = _along(inputs, gate, off[some], off[some + 1] - off[some], step * UNIT * UNIT)
    return out


def _along(inputs: list[tuple[np.ndarray, np.ndarray]], gate: np.ndarray, start: np.ndarray, size: np.ndarray, step: np.float32) -> np.ndarray:
    """Texts of descending size. Weights are kept in UNITs; the bits of a byte are apart (first axis), so that all else is one long row."""
    first = START.reshape(-1, len(inputs))
    gates = len(first)
    weights = [np.tile(first[:, j] * UNIT, len(start)) for j in range(len(inputs))]
    total, inner, part = np.zeros(len(start)), np.arange(CHUNK), np.empty((8, CHUNK * len(start)), np.float32)
    for k in range(-(-int(size[0]) // CHUNK)):
        live = int(np.searchsorted(-size, -k * CHUNK, "left"))
        here = (inner < (size[:live] - k * CHUNK)[:, None]).ravel()
        at = (start[:live, None] + (k * CHUNK + inner)).ravel()
        whole = here.all()
        if not whole:
            at[~here] = 0
        cell = np.repeat(np.arange(0, live * gates, gates), CHUNK)
        cell += gate.take(at)
        x = [np.ascontiguousarray(table.take(row.take(at)).view(np.int8).reshape(-1, 8).T).astype(np.float32) for table, row in inputs]
        dot = x[0] * weights[0].take(cell)
        scratch = part[:, : len(at)]
        for v, w in zip(x[1:], weights[1:]):
            dot += np.multiply(v, w.take(cell), out=scratch)
        np.clip(dot, -10, 10, out=dot)
        np.exp(np.negative(dot, out=dot), out=dot)
        dot += 1
        p = np.reciprocal(dot, out=dot)
        half = np.multiply(p[:4], p[4:], out=scratch[:4])  # eight probabilities of 4e-5 or more have a product that is held
        np.multiply(half[:2], half[2:], out=half[:2])
        cost = np.log(half[0] * half[1])
        error = np.subtract(1, p, out=p)
        if not whole:
            cost *= here
            error *= here
        total[:live] += cost.reshape(live, CHUNK).sum(1, dtype=np.float64)
        for v, w in zip(x, weights):
            v *= error
            np.add(v[:4], v[4:], out=v[:4])
            np.add(v[:2], v[2:4], out=v[:2])
            v[0] += v[1]
            w[: live * gates] += step * np.bincount(cell, v[0], live * gates).astype(np.float32)
            np.clip(w, -UNIT, 3 * UNIT, out=w)
    return total


# -------------------------------------------------------------------------------------------------------------- scoring


def _distinct(table: pa.Table):
    """A block's distinct words, each with a space after it, in an order that depends on the words only; of all words in order, which they are; and how many
    each text has."""
    words = Words(*text_bytes(table["text"]))
    bounds = np.append(words.start, words.end[-1] + 1) if len(words.start) else np.zeros(1, np.int64)  # words follow each other, a space apart
    coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(words.buf)]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)], np.diff(words.first)


def _spread(names: pa.Array, buckets: int) -> np.ndarray:
    raw, off = text_bytes(names)
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * (place + np.uint64(1)), out=sums[1:])
    h = (sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64) * _B) * _A
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Streams:
    """The byte strings of a block of texts: the distinct ones in order, the bytes, and the bounds of texts; with ``places``, each byte's string
    among them."""

    def __init__(self, texts, order: int, places: bool = True):
        raw, off = text_bytes(texts)
        parts, lasts, bounds = [np.zeros(0, np.uint64)], [], [np.zeros(1, np.int64)]
        coded = []
        for i, j in pieces(off, 1_000_000):
            strings, cuts = byte_strings(Words(raw[off[i] : off[j]], off[i : j + 1] - off[i]), order)
            bounds.append(bounds[-1][-1] + cuts[1:])
            if places:
                coded.append(pa.array(strings).dictionary_encode())
                parts.append(coded[-1].dictionary.to_numpy())
            else:
                parts.append(_counted(strings)[0])
                lasts.append((strings & np.uint64(255)).astype(np.uint8))
        self.off = np.concatenate(bounds)
        if places:
            self.distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
            cuts = np.cumsum([len(p) for p in parts])
            self.place = np.concatenate([np.zeros(0, np.int32), *(back[a:b].astype(np.int32)[c.indices.to_numpy()] for a, b, c in zip(cuts[:-1], cuts[1:], coded))])
            self.bytes = (self.distinct & np.uint64(255)).astype(np.uint8)[self.place]
        else:
            self.distinct = _counted(np.concatenate(parts))[0]
            self.bytes = np.concatenate([np.zeros(0, np.uint8), *lasts])

    def long(self):
        """Places of long contexts, which entry each is, and the distinct entries, in order: contexts and what follows."""
        at, ctx = long_contexts(self.bytes, self.off)
        after = following(self.bytes, self.off, at)
        by, new = ordered(ctx, after)
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        return at, entry, ctx[by][new], after[by][new]


def _block_words(order: int, buckets: int):
    """A block's distinct words with their counts in training texts, its distinct byte strings, and its long contexts with what follows them and how
    often in training texts, as one row for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        names, at, many = _distinct(table)
        train = table["train"].to_numpy()
        counts = np.bincount(at[np.repeat(train, many)], minlength=len(names))
        streams = Streams(table["text"], order, places=False)
        place, entry, ctx, after = streams.long()
        seen = np.bincount(entry[train[np.searchsorted(streams.off, place, "right") - 1]], minlength=len(ctx))
        keys = [_spread(names, buckets), buckets_of(streams.distinct, buckets), (ctx % np.uint64(buckets)).astype(np.int64)]
        placed = [by_bucket(k) for k in keys]
        by, ids = [p[0] for p in placed], np.unique(np.concatenate([p[1] for p in placed]))
        cuts = [np.append(np.searchsorted(k[b], ids), len(b)) for k, b in zip(keys, by)]
        lists = pa.ListArray.from_arrays(pa.array(cuts[0].astype(np.int32)), names.take(pa.array(by[0])).cast(pa.binary()))
        return pa.table({
            "bucket": pa.array(ids.astype(np.int32)), "blk": pa.array(np.full(len(ids), table["blk"][0].as_py(), np.int32)), "words": pc.binary_join(lists, pa.scalar(b"", pa.binary())).cast(pa.string()), "counts": pack(counts[by[0]].astype(np.int64), cuts[0]),
            "strings": pack(streams.distinct[by[1]], cuts[1]), "ctx": pack(ctx[by[2]], cuts[2]), "after": pack(after[by[2]].ravel(), cuts[2] * (SPAN // 8)), "seen": pack(seen[by[2]].astype(np.int32), cuts[2]),
        })

    return run


def _long_replies(ctx: list[bytes], after: list[bytes], seen: list[bytes]) -> list[bytes]:
    """For the long contexts of each block, ``long_counts`` over all blocks, in the block's own order: heads, then bodies."""
    ctx, seen = [unpack(x, np.uint64) for x in ctx], [unpack(x, np.int32) for x in seen]
    size = [len(x) for x in ctx]
    c, n = np.concatenate(ctx), np.concatenate(seen).astype(np.int64)
    after = np.concatenate([unpack(x, np.uint64) for x in after]).reshape(-1, SPAN // 8)
    by, new = ordered(c, after)
    new = np.flatnonzero(new)
    entry = np.empty(len(by), np.int64)
    entry[by] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(by))))
    one = by[new]
    total = np.bincount(entry, n, len(one)).astype(np.int64)
    heads, body = long_counts(c[one], after[one], total)
    row = np.cumsum(heads == 255) - 1
    out, bounds = [], np.concatenate([[0], np.cumsum(size)])
    for i, j in zip(bounds[:-1], bounds[1:]):
        mine = entry[i:j]
        out.append(zstandard.compress(heads[mine].tobytes() + body[row[mine][heads[mine] == 255]].tobytes(), 1))
    return out


def _totals(model):
    """For the words of a bucket, their totals over all blocks, for its strings what the first layer predicts, and for its long contexts what followed them,
    back in each block's own order."""

    def run(table: pa.Table, learnt: pa.Table) -> pa.Table:
        parts = [w[:-1].split(" ") if w else [] for w in table["words"].to_pylist()]
        coded = pa.array([w for p in parts for w in p], pa.large_string()).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(c, np.int64) for c in table["counts"].to_pylist())])
        total = np.bincount(at, counts, len(coded.dictionary)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        first = np.zeros(len(parts), np.int64)
        known, tokens = first.copy(), first.copy()
        known[:1], tokens[:1] = np.count_nonzero(total), total.sum()

        blobs = [unpack(s, np.uint64) for s in table["strings"].to_pylist()]
        every, held, rows = np.zeros(0, np.uint64), [], 0
        for k, blob in enumerate(blobs):
            held.append(blob)
            rows += len(blob)
            if rows > HELD or k == len(blobs) - 1:
                every, held, rows = np.unique(np.concatenate([every, *held])), [], 0
        m = model()
        for strings, seen in _blobs(learnt):
            m.over(strings, seen)
        said = m.predictions(every).view(np.int64).ravel()
        back = pa.concat_arrays([pack(said[np.searchsorted(every, blob)], np.array([0, len(blob)])) for blob in blobs])
        long = pa.array(_long_replies(*(table[x].to_pylist() for x in ("ctx", "after", "seen"))), pa.binary())
        return pa.table({"blk": table["blk"], "bucket": table["bucket"], "totals": pack(total[at], bounds), "said": back, "long": long, "known": known, "tokens": tokens})

    return run


def _score_block(order: int, buckets: int, kind: pa.DataType):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        came = {b: x for b, *x in zip(*(totals[x].to_pylist() for x in ("bucket", "totals", "said", "long")))}

        def back(bucket, which):
            by, ids, bounds = by_bucket(bucket)
            out = np.zeros(len(bucket), np.int64)
            for b, i, j in zip(ids.tolist(), bounds[:-1], bounds[1:]):
                out[by[i:j]] = unpack(came[b][which], np.int64)
            return out

        names, at, many = _distinct(docs)
        c = back(_spread(names, buckets), 0)
        own = np.repeat(np.arange(len(many)), many)
        base = np.bincount(own, np.log10(c + 0.1)[at], len(many))
        known = np.bincount(own, (c > 0)[at].astype(np.float64), len(many))

        streams = Streams(docs["text"], order)
        said = back(buckets_of(streams.distinct, buckets), 1)
        place, entry, ctx, *_ = streams.long()
        head, at_body, bodies = np.zeros(len(ctx), np.uint8), np.zeros(len(ctx), np.int64), [np.zeros((0, 8 * SPAN), np.uint8)]
        by, ids, bounds = by_bucket((ctx % np.uint64(buckets)).astype(np.int64))
        held = 0
        for b, i, j in zip(ids.tolist(), bounds[:-1], bounds[1:]):
            blob = np.frombuffer(zstandard.decompress(came[b][2]), np.uint8)
            head[by[i:j]] = blob[: j - i]
            bodies.append(blob[j - i :].reshape(-1, 8 * SPAN))
            at_body[by[i:j][blob[: j - i] == 255]] = held + np.arange(len(bodies[-1]))
            held += len(bodies[-1])
        body = np.concatenate(bodies)
        heads = head[entry]
        long, row, sure = spread_long(streams.bytes, streams.off, place, heads, body[at_body[entry][heads == 255]], docs["train"].to_numpy())
        last, often = last_seen(streams.distinct, streams.place, streams.off)
        score = learn_along([(said, streams.place), (_GUESS, last), (long, row)], 3 * sure + often, streams.off) / np.log(10)
        n = len(many)
        out = {"doc_id": docs["doc_id"], "held_out": pa.array(~docs["train"].to_numpy()), "words": pa.array(many), "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(score), "bytes": pa.array(np.diff(streams.off))}
        stats = {"doc_id": pa.nulls(1, kind), "held_out": pa.nulls(1, pa.bool_()), "words": pa.array([pc.sum(totals["tokens"]).as_py() or 0]), "known": pa.array([pc.sum(totals["known"]).as_py() or 0]), "base": pa.nulls(1, pa.float64()), "score": pa.nulls(1, pa.float64()), "bytes": pa.nulls(1, pa.int64())}
        rows, one = pa.table(out), pa.table(stats)
        return pa.concat_tables([rows, one.cast(rows.schema)]) if n else one

    return run


def score_documents(docs: DataFrame, *, order: int = 5, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row of ``docs``.

    A null text counts as an empty one, with an end only; null ids are held out; repeated rows are scored, and learnt
    from, each. ``score`` is the log10 probability of the text's lower-cased words and its end; ``n_bytes`` are the bytes of these (a space after
    each word, and the end), ``bits_per_byte`` is the score over them. Without training rows the scores come from an untaught
    model. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col, folds)).alias("train"))
    size = text_size(rows, "text")
    blocks, n = (max(1, -(-size // x)) for x in (BLOCK, BUCKET))
    learnt = train(rows.filter("train"), order=order, buckets=n)
    placed = rows.withColumn("blk", block_of(blocks, "doc_id", "text")).repartition(blocks, "blk")
    words = placed.groupBy("blk").applyInArrow(_block_words(order, n), "bucket int, blk int, words string, counts binary, strings binary, ctx binary, after binary, seen binary")
    totals = words.groupBy("bucket").cogroup(learnt.strings.groupBy("bucket")).applyInArrow(_totals(learnt.model), "blk int, bucket int, totals binary, said binary, long binary, known long, tokens long")
    field = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = placed.groupBy("blk").cogroup(totals.groupBy("blk")).applyInArrow(_score_block(order, n, to_arrow_type(field)), f"doc_id {field.simpleString()}, held_out boolean, words long, known long, base double, score double, bytes long")
    scored = cut(scored)
    stats = scored.filter("held_out is null").agg(F.sum("words"), F.sum("known")).first()
    ends = scored.filter("not held_out").count()
    tokens, distinct = (stats[0] or 0) + ends, (stats[1] or 0) + (ends > 0)
    scale = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return scored.filter("held_out is not null").select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(ends + 0.1))) - (F.col("words") + 1) * F.lit(scale)).alias("base_score"),
        "score",
        F.col("bytes").alias("n_bytes"),
        (F.col("score") * F.lit(-float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
