"""Mixing sources to target weights: weighted fair queueing, in DataFrame operations only.

Each document gets a place in its source's shuffled queue. The virtual finish time of its copy in pass r is

    (tokens of all earlier passes + tokens of the queue up to and including it) / the source's target

so that at any virtual time every source has sent its share. The mix is the shortest prefix, in order of finish time, that
reaches the total budget. The prefix is found by range: token sums over equal ranges of finish time, the range that crosses
the budget cut again and again, and a sort of what is left in it. Equal ranges hold about equal numbers of tokens,
because that is what fair queueing makes of the queues.

A queue's running sums are made from sums over ranges of the shuffle key (uniform hashes, so ranges of a hot source are even)
and running sums within a range; no window spans a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, row_key, shuffle_partitions

#: Bits of the shuffle key.
KEY_BITS = 60


def shuffle_key(id_col: str, seed: int) -> Column:
    """60 bits of an MD5 over the id and the seed: the same order on every run and in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def rank_sources(sizes: DataFrame, n: int) -> DataFrame:
    """(skey, source_size, rank from 0) in order of code points. Sorted by range, then counted by part: no single task
    sees all sources."""
    src = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    parts = cut(src.repartitionByRange(n, "skey").withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each part
    inside = F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1
    return parts.withColumn("inside", inside).join(before.select("part", F.coalesce("before", F.lit(0)).alias("before")), "part").select("skey", "source_size", (F.col("before") + F.col("inside")).alias("rank"))


def targets(sources: DataFrame, weights: Sequence[int], max_passes: int) -> DataFrame:
    """Add ``target``: shares of the total by weight; a source stops at max_passes times its size and its excess
    goes to the others by weight, until none is above. Every round is one aggregate, and caps only ever grow."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = cut(sources.withColumn("w", w).withColumn("cap", F.col("source_size") * max_passes))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    left, open_w, closed = total, None, None
    while True:
        # a source is capped once its cap is at most left * w / open_w
        capped = F.lit(False) if open_w is None else F.col("cap").cast("double") * F.lit(float(open_w)) <= F.col("w") * F.lit(float(left))
        n, c, o = src.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        if open_w is not None and n == closed or not o:
            break
        left, open_w, closed = total - (c or 0), o, n
    if open_w is None or not o:
        return src.withColumn("target", F.col("cap").cast("double"))
    return src.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(float(open_w))))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), max_passes: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, rk (the row's key), source, size, source_size, target, taken (words the mix takes, repeats counted).

    size: words of the text, a null text having none. Sources in order of code points, null last and a source of its own, weigh
    ``weights``, repeating. A null id is one more id. Repeated rows are separate rows. Rows without words, and all
    rows of an empty table, take 0. The result depends on ids, sizes and sources, never on how the table is laid out.
    """
    spark = docs.sparkSession
    n = max(16, shuffle_partitions(spark))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(id_col, seed).alias("u"),
        row_key(docs).alias("rk"),
    )
    sizes = cut(sizes.withColumn("skey", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))).withColumn("range", F.floor(F.col("u") / (2.0**KEY_BITS / n)).cast("int")))
    src = cut(targets(rank_sources(sizes, n), weights, max_passes).select("skey", "source_size", "target"))

    w = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.groupBy("skey", "range").agg(F.sum("size").alias("here")).withColumn("ahead", F.coalesce(F.sum("here").over(w), F.lit(0))).join(src, "skey").drop("here")
    w = Window.partitionBy("skey", "range").orderBy("u", "doc_id", "size", "rk").rowsBetween(Window.unboundedPreceding, 0)
    queue = cut(sizes.withColumn("inside", F.sum("size").over(w)).join(ahead, ["skey", "range"]).select("doc_id", "rk", "source", "skey", "u", "size", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("cum")))

    total = queue.agg(F.sum("size")).first()[0] or 0
    finish = [(F.col("cum") + F.lit(r) * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")) for r in range(max_passes)]
    copies = queue.filter("size > 0 and target > 0").select("skey", "u", "doc_id", "size", "rk", F.explode(F.array(*[F.struct(f.alias("f"), F.lit(r).alias("pass")) for r, f in enumerate(finish)])).alias("c")).select("c.f", "skey", "c.pass", "u", "doc_id", "size", "rk")
    last = _last_taken(copies, total, n)
    if last is None:
        times = F.lit(0)
    else:
        (f, skey, at, u, doc, size), (a, b), itself = (F.lit(x) for x in last[0][:-1]), last[0][-1], last[1]
        times = F.lit(0)
        for r, x in enumerate(finish):
            own = F.struct(F.col("skey"), F.lit(r).alias("pass"), F.col("u"), F.col("doc_id"), F.col("size"), F.col("rk"))
            end = F.struct(skey.alias("skey"), at.cast("int").alias("pass"), u.cast("long").alias("u"), doc.cast(queue.schema["doc_id"].dataType).alias("doc_id"), size.cast("long").alias("size"), F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")).alias("rk"))
            tie = own <= end if itself else own < end
            times = times + F.when((x < f) | ((x == f) & tie), 1).otherwise(0)
    return queue.select("doc_id", "rk", "source", "size", "source_size", "target", (F.col("size") * F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, **kwargs) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted). Parameters as
    for ``mix_rows``."""
    return mix_rows(docs, **kwargs).drop("rk")


def take_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix that ``mix_sources`` chooses: the rows of ``docs``, all columns whatever their names, each as often as the mix takes it (up to
    max_passes times). Of rows that are equal in all columns, together as many copies are taken as the mix takes of them. Rows
    without words are not taken; an empty table gives no rows."""
    times, many, name = free_name(docs, "times"), free_name(docs, "many"), free_name(docs, "rk")
    mix = mix_rows(docs, **kwargs).filter("size > 0")
    mix = cut(mix.groupBy(F.col("rk").alias(name)).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias(times), F.count("*").alias(many)).filter(F.col(times) > 0))
    found = docs.withColumn(name, row_key(docs)).join(mix, name)
    if not mix.filter(F.col(many) > 1).isEmpty():  # equal rows: all copies come from one of them
        found = found.filter(F.col(many) == 1).unionByName(found.filter(F.col(many) > 1).dropDuplicates([name]))
    return found.withColumn(many, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(name, times, many)


def _last_taken(copies: DataFrame, total: int, n: int, few: int = 4_000):
    """The sort key at which the mix ends, and whether the copy with it still belongs to the mix. The driver sees one row
    of sums in each round."""
    low, spent = 0.0, 0
    high, rows = copies.agg(F.max("f"), F.count("*")).first()
    if not total or high is None:
        return None
    high = high * (1 + 1e-9)
    grid = max(256, n)
    live = copies
    while rows > few and high - low > 1e-12 * high:
        step = (high - low) / grid
        at = F.least(F.floor((F.col("f") - F.lit(low)) / F.lit(step)), F.lit(grid - 1))
        sums = live.groupBy(at.cast("int").alias("at")).agg(F.sum("size").alias("here"), F.count("*").alias("rows"))
        w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # at most `grid` rows
        sums = sums.withColumn("before", F.coalesce(F.sum("here").over(w), F.lit(0)))
        hit = sums.filter(F.col("before") + F.lit(spent) <= F.lit(total)).orderBy(F.desc("at")).first()
        live = live.filter(at == F.lit(hit["at"]))
        spent, rows = spent + hit["before"], hit["rows"]
        low, high = low + hit["at"] * step, low + (hit["at"] + 1) * step
    order = ["f", "skey", "pass", "u", "doc_id", "size", "rk"]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    took = live.withColumn("sum", F.sum("size").over(w)).filter(F.col("sum") + F.lit(spent) <= F.lit(total))
    row = took.orderBy(*[F.desc(x) for x in order]).first()
    if row is not None:
        return tuple(row[x] for x in order), True
    row = live.orderBy(*order).first()  # already the first copy of this range is too long
    return tuple(row[x] for x in order), False


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS u
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY skey
), o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3E0 * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY 3E0 * source_size / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), k AS (
  SELECT *, CAST(cap AS DOUBLE) * rest <= CAST(total - before AS DOUBLE) * w AS capped FROM o
), t AS (
  SELECT skey, source_size, total,
    CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) * w / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target
  FROM k
), q AS (
  SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY d.skey ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.skey = t.skey
), c AS (
  SELECT q.*, pass, CAST(cum + pass * source_size AS DOUBLE) / target AS f FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY f, skey, pass, u, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM c
), m AS (
  SELECT doc_id, skey, size, cum, sum(size) AS taken FROM r WHERE so_far <= total GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN m ON q.doc_id = m.doc_id AND q.skey = m.skey AND q.size = m.size AND q.cum = m.cum
"""
