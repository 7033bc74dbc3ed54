"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text (shares of kinds of characters, lengths, repetition) is cut into bins. Boosting goes round the features,
each time fitting a shallow tree over the bins of one feature to the current gradient and adding a small step of it to that feature's
lookup table; then round the pairs of features that explain most of what is left, in the same way with a cut on either
axis. A score is the sum of the looked-up values of its bins.

The model is fitted on at most ``most`` labelled rows (those whose ids hash lowest, then those whose texts do), a documented bound;
features and scores cover whole texts of all rows, in place, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, pieces, text_bytes
from .words import Words, xxh64

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "exclaims", "bars", "symbols", "stops", "commas", "non_ascii",
    "white", "entropy", "distinct_words", "top_word", "repeats", "distinct_pairs", "line_length", "capitals", "odd_words",
]


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all zero for one without bytes."""
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n), size)
    hist = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1).astype(np.float64)
    of = lambda chars: hist[:, list(chars)].sum(1)
    upper, lower = of(range(65, 91)), of(range(97, 123))
    p = hist / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    w = Words(raw, off)
    words = np.diff(w.first)
    some = np.maximum(words, 1).astype(np.float64)
    own = np.repeat(np.arange(n), words)
    length = (w.end - w.start).astype(np.float64)
    hashes = xxh64(w.buf, w.start, w.end)
    salt = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    keyed, at, counts = np.unique(hashes + salt[own], return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, own[at], counts)
    near = np.flatnonzero(own[1:] == own[:-1])
    same = np.bincount(own[near[hashes[near] == hashes[near + 1]]], minlength=n)
    _, at2 = np.unique(hashes[near] * np.uint64(3) + hashes[near + 1] + salt[own[near]], return_index=True)
    last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    odd = ~(((last >= 97) & (last <= 122)) | (last >= 128) | (last == 46) | (last == 44))
    out = np.column_stack([
        np.log1p(size), np.log1p(words), np.bincount(own, length, n) / some, upper / np.maximum(upper + lower, 1),
        of(range(48, 58)) / total, (of(range(33, 48)) + of(range(58, 65)) + of(range(91, 97)) + of(range(123, 127))) / total, of([33]) / total, of([124]) / total,
        of(map(ord, "#$%&*@^~<>")) / total, of([46]) / some, of([44]) / some, of(range(128, 256)) / total,
        of([32, *range(9, 14)]) / total, entropy, np.bincount(own[at], minlength=n) / some, top / some,
        same / some, np.bincount(own[near[at2]], minlength=n) / np.maximum(words - 1, 1), np.log1p(size / (of([10]) + 1)), upper / some, np.bincount(own, odd.astype(np.float64), n) / some,
    ])
    out[size == 0] = 0
    return out


@dataclass
class Additive:
    """Lookup tables: one for each feature, and one for each pair of features over coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1."""
        sums = np.full(len(x), self.base)
        for table, b in zip(self.tables, self.bins(x, self.edges)):
            sums += table[b]
        if self.pairs:
            b = self.bins(x, self.coarse)
            for (i, j), grid in zip(self.pairs, self.grids):
                sums += grid[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _gain(g, h, reg):
    return g * g / (h + reg)


def _tree_1d(g: np.ndarray, h: np.ndarray, reg: float, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """Best-first cuts of a row of bins; the Newton step of each leaf for its bins."""
    spans, cg, ch = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            won = np.where((hl >= least) & (hr >= least), _gain(gl, hl, reg) + _gain(gr, hr, reg), -np.inf) - _gain(cg[b] - cg[a], ch[b] - ch[a], reg)
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (won[k], s, int(m[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """The cut on either axis that explains most, and the Newton steps of its four quarters."""
    cg, ch = (np.zeros((g.shape[0] + 1, g.shape[1] + 1)) for _ in range(2))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarters = []
    for c in (cg, ch):
        inner, right, down, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        quarters.append((inner, right - inner, down - inner, all_ - right - down + inner))
    won = sum(_gain(a, b, reg) for a, b in zip(*quarters)) - _gain(cg[-1, -1], ch[-1, -1], reg)
    if not won.size:
        return 0.0, np.zeros(g.shape)
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    step = [a[i, j] / (b[i, j] + reg) for a, b in zip(*quarters)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse: int = 10, rounds: int = 120, pair_rounds: int = 40, pairs: int = 10, rate: float = 0.12, reg: float = 4.0) -> Additive:
    """Cyclic boosting. Without rows, or with one class only, the model is a constant."""
    n = len(y)
    base = (y.sum() + 0.5) / (n + 1)
    model = Additive([], [], float(np.log(base / (1 - base))), [])
    cuts = lambda k, q: np.unique(np.quantile(x[:, k], np.linspace(0, 1, q + 1)[1:-1])) if n else np.zeros(0)
    model.edges = [cuts(k, bins) for k in range(x.shape[1])]
    model.coarse = [cuts(k, coarse) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n or y.min() == y.max():
        return model
    b, f = model.bins(x, model.edges), np.full(n, model.base)
    grad = lambda: (y - (p := 1 / (1 + np.exp(-f))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = grad()
            step = rate * _tree_1d(np.bincount(b[k], g, len(table)), np.bincount(b[k], h, len(table)), reg)
            table += step
            f += step[b[k]]
    c = model.bins(x, model.coarse)
    shape = [len(e) + 1 for e in model.coarse]
    g, h = grad()
    flat = lambda i, j: c[i] * shape[j] + c[j]
    grid = lambda i, j, v: np.bincount(flat(i, j), v, shape[i] * shape[j]).reshape(shape[i], shape[j])
    found = sorted(((_tree_2d(grid(i, j, g), grid(i, j, h), reg)[0], i, j) for i in range(len(c)) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j) for won, i, j in found if won > 0]
    model.grids = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.grids):
            g, h = grad()
            step = rate * _tree_2d(grid(i, j, g), grid(i, j, h), reg)[1]
            table += step
            f += step[c[i], c[j]]
    return model


def _arrays(source: DataFrame, kernel, extra: str) -> DataFrame:
    """Rows of (doc_id, text) to doc_id and what ``kernel`` makes of the features."""

    def run(batches):
        for batch in batches:
            raw, off = text_bytes(batch.column(batch.num_columns - 1))
            rows = [kernel(features(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in pieces(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(rows) if rows else kernel(np.zeros((0, len(FEATURES))))], names=[*batch.schema.names[:-1], extra.split()[0]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, {extra}")


def held_out(id_col: str, folds: int):
    """Rows that the model never learns from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 5, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """Fit on at most ``most`` labelled rows outside the held-out fold: of the ``most`` labels whose ids hash lowest, the ``most`` documents
    (where ids repeat, there are more) whose ids and texts hash lowest."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
    few = own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id").select("y", F.xxhash64("doc_id", "text").alias("key"), "text")  # `most` rows of two numbers
    vectors = _arrays(rows, lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), "x array<double>").orderBy("key", "y", "x").limit(most).toPandas()
    x = np.array(vectors["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, vectors["y"].to_numpy(np.float64)])  # the order of rows doesn't matter
    return fit(x[order], vectors["y"].to_numpy(np.float64)[order])


def score_documents(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row. A null text counts as empty and gets a score too."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _arrays(source, lambda x: pa.array(model.score(x)), "score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score is at least ``threshold``. A null text counts as empty;
    without labels the score is 0.5, and all stay; repeated rows stay or go together; an empty table gives no rows."""
    model = train(docs, labels, text_col=text_col, **kwargs)
    score = free_name(docs, "score")
    return _arrays(docs.select("*", F.col(text_col).alias(free_name(docs, "body"))), lambda x: pa.array(model.score(x)), f"{score} double").filter(F.col(score) >= threshold).drop(score)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels that are null or not 0 or 1, or of ids that don't occur, teach nothing; without any the score is 0.5.
    Repeated rows get the same score. A null id is held out. An empty table gives no rows."""
    model = train(docs, labels, folds=folds, most=most, id_col=id_col, text_col=text_col)
    scored = score_documents(docs, model, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
