"""Sharding along a Hilbert curve, in DataFrame operations only.

Metadata dimensions (source, language, size) are quantised to `bits` bits each: texts by their place in the corpus
(equi-depth, in code point order, null last), sizes by their logarithm. A table-driven automaton walks the bits and
gives each row's place on the curve; rows are sorted by place and cut into runs, so that a shard covers a compact box
in every dimension and files can be pruned by any of them.

Ranks over the whole table come from a range-partitioned sort: each partition is counted, partitions get offsets, and a row's
rank is its offset plus its place in its partition. The sort ends in the row's own values and position, so groups of rows with
equal metadata, however large, are spread over partitions.

Defined results: null text has size 1 and checksum 0; null metadata sorts last; repeated rows get slots of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, utf8_size


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state of the curve and each cell (one bit a dimension): the cell's digit and the next state."""
    mask = (1 << dims) - 1

    def rol(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask

    def trailing(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1  # ones at the end

    digits, following = [], []
    for state in range((1 << dims) * dims):
        entry, direction = divmod(state, dims)
        for cell in range(1 << dims):
            gray = rol(cell ^ entry, dims - (direction + 1) % dims)
            w = gray
            shift = 1
            while shift < dims:
                w ^= w >> shift
                shift <<= 1
            start = 0 if w == 0 else ((v := 2 * ((w - 1) // 2)) ^ (v >> 1))
            turn = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % dims
            digits.append(w)
            following.append((entry ^ rol(start, direction + 1)) * dims + (direction + turn + 1) % dims)
    return digits, following


def hilbert_index(cols: list[Column], bits: int) -> Column:
    """Place on the curve of a cell given by whole numbers below 2 ** bits."""
    digits, following = hilbert_tables(len(cols))
    digit, after = (F.array(*[F.lit(x) for x in t]) for t in (digits, following))
    cells = 1 << len(cols)
    steps = []
    for b in range(bits - 1, -1, -1):
        cell = F.lit(0)
        for i, c in enumerate(cols):
            cell = cell + F.shiftleft(F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)), i)
        steps.append(cell)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    walk = F.aggregate(
        F.array(*steps),
        start,
        lambda a, cell: F.struct(F.get(after, a["s"] * cells + cell).alias("s"), (a["h"] * cells + F.get(digit, a["s"] * cells + cell)).alias("h")),
    )
    return walk["h"]


def equi_depth(df: DataFrame, col: str, bits: int) -> DataFrame:
    """v, q: each distinct value of a column with its place in the corpus, as a whole number below 2 ** bits; null last."""
    per = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("v").isNull(), "v")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("v", F.least(F.floor((before + F.col("n") / 2) * (1 << bits) / every), F.lit((1 << bits) - 1)).cast("int").alias("q"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `_rank`, from 0 in the given order, and `_n` rows in all; ties in the order of the input's rows."""
    kept = df.columns
    placed = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at")
    placed = cut(placed.withColumn("_part", F.spark_partition_id()), name)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = cut(parts.select(F.col("_part").alias("_p"), before.alias("_before"), every.alias("_n")), f"{name}-parts")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_at")) - 1
    return placed.withColumn("_in", within).join(parts, F.col("_part") == F.col("_p")).select(*kept, (F.col("_before") + F.col("_in")).alias("_rank"), "_n")


def assign(docs: DataFrame, shards: int = 8, bits: int = 6, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, curve for every row. law "rows": row counts of shards at most one apart; law "bytes": a row goes to the shard in which its first byte falls when all sizes are laid end to end along the curve and cut evenly."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r}")
    slim = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
            (utf8_size() + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    log_size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 3), F.lit((1 << bits) - 1)).cast("int")
    got = slim
    for c in ("source", "lang"):
        codes = cut(equi_depth(slim, c, bits).select(F.col("v").alias(f"_v_{c}"), F.col("q").alias(f"_q_{c}")), f"shard-{c}")
        got = got.join(codes, F.col(c).eqNullSafe(F.col(f"_v_{c}")))
    got = got.select("doc_id", "size", "text_crc32", hilbert_index([F.col("_q_source"), F.col("_q_lang"), log_size], bits).alias("curve"))
    got = ranked(got, ["curve", "text_crc32", "doc_id"], "shard-sorted")
    if law == "rows":
        shard = F.expr(f"_rank * {shards} div _n")
        got = got.withColumn("shard", shard).withColumn("slot", F.col("_rank") - F.expr(f"(shard * _n + {shards - 1}) div {shards}"))
    else:
        got = by_bytes(cut(got, "shard-ranked"), shards)
    return got.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "curve")


def by_bytes(got: DataFrame, shards: int, block: int = 1 << 16) -> DataFrame:
    """shard and slot from _rank and size: running sums in blocks of rank, so that no task sees more than a block's rows in order."""
    got = got.withColumn("_block", F.expr(f"_rank div {block}"))
    sums = got.groupBy("_block").agg(F.sum("size").alias("_s"))
    w = Window.orderBy("_block")
    sums = cut(sums.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all")), "shard-sums")
    within = F.coalesce(F.sum("size").over(Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = got.withColumn("_w", within).join(sums, F.col("_block") == F.col("_b")).withColumn("shard", F.expr(f"(_off + _w) * {shards} div _all"))
    first = cut(got.groupBy("shard").agg(F.min("_rank").alias("_first")).withColumnRenamed("shard", "_shard"), "shard-first")
    return got.join(first, F.col("shard") == F.col("_shard")).withColumn("slot", F.col("_rank") - F.col("_first"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents themselves, one folder a shard, in curve order; rows alike (doc_id, size, checksum) share their places. A task writes a run of the curve, so files hold narrow ranges of every dimension, which their footers' statistics let readers skip."""
    place = assign(docs, **options).select(F.col("doc_id").alias("_d"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "shard", "slot")
    alike = Window.partitionBy("_d", "_s", "_c").orderBy("slot")
    place = place.withColumn("_i", F.row_number().over(alike))
    rows = packed(docs).select("_row", F.col("_row.doc_id").cast("long").alias("_d2"), (F.coalesce(F.octet_length("_row.text"), F.lit(0)) + 1).cast("long").alias("_s2"), F.crc32(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary")).alias("_c2"))
    rows = rows.withColumn("_i2", F.row_number().over(Window.partitionBy("_d2", "_s2", "_c2").orderBy(F.lit(0))))
    got = rows.join(place, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_s") == F.col("_s2")) & (F.col("_c") == F.col("_c2")) & (F.col("_i") == F.col("_i2")))
    got.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "_row.*").write.partitionBy("_shard").parquet(path)
