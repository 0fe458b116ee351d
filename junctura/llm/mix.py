"""Mixing sources to target weights: pivotal dependent rounding of fractional copy numbers, in DataFrame operations only.

Every row of a source is to be taken `rate` = target / source_size times. The whole part is taken outright. The
fractional parts are rounded dependently: rows of a source meet in chunks of about FAN, largest first, and a fold over
each chunk pairs the open row with the next one, moves weighted mass between the two at random (so that expectations
stay) until one of them is 0 or 1, and goes on with the other. Each chunk leaves one open row; these meet again, FAN at a
time, up a reduction tree of log_FAN(rows) levels, each a written table. What a source takes thus differs from its
target by less than one row's size.

Defined results: null text has size 0; rows of size 0 weigh nothing and are rounded independently; a null source is a
source of its own, last in order; repeated rows are rounded together (they are counted, never gathered), so a hot
group of equal rows is one item; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, uniform, word_count

FAN = 32
EPS = 1e-9
_ITEM = ["doc_id", "source", "size", "h", "m", "base", "whole"]


def source_targets(items: DataFrame, max_repeat: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, n, target. items: source, size, m (rows alike). Weights repeat over the sources in order of code points, null last; they share the sum of all sizes, and what lies above max_repeat times a source's size is shared again by weight until none is above."""
    per = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("pos", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))),
    )
    # Sources fill up in order of ratio; the first that doesn't sets the level of all after it.
    per = per.withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "pos", "level"))).over(every)["level"])
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return per.select("source", "source_size", "n", target.alias("target"))


def _fold(rows: Column) -> Column:
    """Pairs the rows of an array one after another; gives what was decided and the row left open."""
    item = "struct<" + ",".join(f"{c}:{t}" for c, t in zip(_ITEM, ("bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"), strict=True)) + ">"
    start = F.struct(F.array().cast(f"array<struct<k:{item},up:bigint>>").alias("done"), F.lit(0.0).alias("w"), F.lit(0.0).alias("p"), F.lit(None).cast(item).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        wi, pi, wj, pj = acc["w"], acc["p"], x["w"], x["p"]
        can_raise, can_lower = F.least(1 - pi, pj * wj / wi), F.least(pi, (1 - pj) * wj / wi)
        up = x["u"] * (can_raise + can_lower) < can_lower
        # i: the open row ends (it becomes 1 or 0); otherwise the new row ends and the open one stays.
        ends = F.when(up, 1 - pi <= pj * wj / wi).otherwise(pi <= (1 - pj) * wj / wi)
        left = (
            F.when(up & ends, pj - (1 - pi) * wi / wj)
            .when(up, pi + pj * wj / wi)
            .when(ends, pj + pi * wi / wj)
            .otherwise(pi - (1 - pj) * wj / wi)
        )
        decided = F.struct(F.when(ends, acc["k"]).otherwise(x["k"]).alias("k"), F.when(ends, up).otherwise(~up).cast("long").alias("up"))
        going = F.struct(
            F.concat(acc["done"], F.array(decided)).alias("done"),
            F.when(ends, wj).otherwise(wi).alias("w"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"),
            F.when(ends, x["k"]).otherwise(acc["k"]).alias("k"),
        )
        first = F.struct(acc["done"].alias("done"), wj.alias("w"), pj.alias("p"), x["k"].alias("k"))
        return F.when(acc["k"].isNull(), first).otherwise(going)

    return F.aggregate(rows, start, step)


def _level(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """rows: source, chunk, w, p, k -> source, chunk, done, w, p, k; a chunk's rows become one."""
    one = F.struct((-F.col("w")).alias("nw"), F.xxhash64("k", F.lit(seed)).alias("o"), "k", "w", "p", uniform("k", F.lit(seed), F.lit(level)).alias("u"))
    got = rows.groupBy("source", "chunk").agg(_fold(F.sort_array(F.collect_list(one))).alias("f"))
    return cut(got.select("source", "chunk", "f.done", "f.w", "f.p", "f.k"), f"mix{level}")


def copies(items: DataFrame, max_repeat: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """How often to take each item. items: doc_id, source, size, h (a hash of whatever else tells rows apart), one row per document. Returns one row per distinct item: those columns, m (rows alike), source_size, target, base (copies of every row) and extra (how many of the m rows get one more)."""
    same = cut(items.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m")), "mix-items")
    sources = cut(source_targets(same, max_repeat, weights), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    part = (
        same.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("rate", rate)
        .withColumn("base", F.floor("rate"))
        .withColumn("more", F.col("m") * (F.col("rate") - F.col("base")))
        .withColumn("whole", F.floor(F.col("more") + EPS))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("more") - F.col("whole")))
    )
    opened = (F.col("p") > EPS) & (F.col("size") > 0)
    shut = part.where(~opened).withColumn("up", F.when(F.col("p") > EPS, (uniform("doc_id", "h", F.lit(seed)) < F.col("p")).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = part.where(opened).select(
        "source",
        F.pmod(F.xxhash64("doc_id", "size", "h", F.lit(seed)), F.ceil(F.col("n") / FAN)).alias("chunk"),
        F.col("size").cast("double").alias("w"),
        "p",
        F.struct(*_ITEM).alias("k"),
    )
    most = sources.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    decided, level = [], 0
    while True:
        done = _level(rows, seed, level)
        decided.append(done.select(F.explode("done").alias("d")).select("d.k", "d.up"))
        if most <= 1:
            break
        most, level = -(-most // FAN), level + 1
        rows = done.where("k is not null").select("source", F.expr(f"chunk div {FAN}").alias("chunk"), "w", "p", "k")
    last = done.where("k is not null").select("k", (uniform("k", F.lit(seed), F.lit(-1)) < F.col("p")).cast("long").alias("up"))
    for d in decided:
        last = last.unionByName(d)
    out = last.select("k.*", "up").unionByName(shut.select(*_ITEM, "up"))
    out = out.join(sources.withColumnRenamed("source", "_s").drop("n"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "h", "m", "source_size", "target", "base", (F.col("whole") + F.col("up")).alias("extra"))


def repeat_rows(df: DataFrame, m: str, ordinal: str, block: int = 4096) -> DataFrame:
    """Each row m times, numbered from 0 in `ordinal`; in blocks, so that no array grows with m."""
    blocks = df.where(F.col(m) > 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col(m) - 1) / block))))
    return blocks.withColumn(ordinal, F.explode(F.sequence(F.col("_b") * block, F.least(F.col(m) - 1, F.col("_b") * block + block - 1)))).drop("_b")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("h"))
    rows = repeat_rows(copies(items, **options), "m", "_i")
    n = F.col("base") + (F.col("_i") < F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (rows not taken are gone), with the input's columns."""
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("h"))
    plan = copies(items, **options).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "h", "base", "extra", "m")])
    rows = packed(docs).withColumn("_k", F.xxhash64("_row.text"))
    got = rows.join(
        plan,
        F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & F.col("_row.source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("_h")),
    )
    # Only rows with others alike need an ordinal among them.
    lone = got.where("_m = 1").withColumn("_i", F.lit(0))
    alike = got.where("_m > 1").withColumn("_i", F.row_number().over(Window.partitionBy("_doc_id", "_source", "_h").orderBy(F.lit(0))) - 1)
    n = (F.col("_base") + (F.col("_i") < F.col("_extra")).cast("long")).cast("int")
    return lone.unionByName(alike).select(F.explode(F.array_repeat("_row", n)).alias("_row")).select("_row.*")
