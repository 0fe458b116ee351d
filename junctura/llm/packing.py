"""Best-fit packing planned on the length histogram.

Documents are tokenised, ended by an end id, and cut into pieces of at most `size` ids; only the first piece of a long
document may be shorter. The histogram of piece lengths (at most `size` counts, whatever the corpus) goes to the
driver, which runs best-fit decreasing over counts: all bins alike are one class, so the plan has a few thousand
entries at any scale. Pieces then take planned slots by a join on (length, rank within length). Ranks within a
length are counted in salted blocks of about BLOCK_ROWS, so one very common length is no hot key.

Defined results: a null text is empty, that is one piece with the end id; repeated rows are packed once each; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, encoder, small_batches, tokenizer_path

SIZE = 2048
#: Rows of a block in which pieces of one length are ranked, and blocks in all (more rows make larger blocks, so a length's blocks stay few).
BLOCK_ROWS, BLOCKS = 256, 100_000


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every piece of every row."""
    file = path or tokenizer_path("byte_bpe_50k.json")
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(file, "byte")
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, found in encode.slices(b.column(1)):
                rows: list[tuple] = []
                for key, got in zip(keys[at : at + len(found)], found, strict=True):
                    ids = np.empty(len(got) + 1, "<u4")
                    ids[:-1], ids[-1] = got, end
                    n = len(ids)
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[x:y].tobytes()
                        rows.append((key, i, x, y - x, zlib.crc32(part), part) if with_ids else (key, i, x, y - x, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Gives entries (length, first rank, ranks, first sequence, per sequence, offset) and the number of sequences: rank r of a length goes to sequence first + (r - first rank) div per, at offset + ((r - first rank) mod per) * length."""
    room: dict[int, list[list]] = {}  # free ids -> classes [bins, first sequence, entries kept apart by class]
    entries: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = next((r for r in range(length, size + 1) if room.get(r)), None)
            if free is None:
                free, per = size, size // length
                bins = -(-left // per)
                room.setdefault(size, []).append([bins, sequences])
                sequences += bins
            per = free // length
            bins, first = room[free].pop()
            full = min(bins, left // per)
            if full:
                entries.append((length, rank, full * per, first, per, size - free))
                room.setdefault(free - per * length, []).append([full, first])
                rank, left = rank + full * per, left - full * per
            if full < bins:
                if left and left < per:  # the last of this length share one bin
                    entries.append((length, rank, left, first + full, left, size - free))
                    room.setdefault(free - left * length, []).append([1, first + full])
                    rank, left, full = rank + left, 0, full + 1
                if full < bins:
                    room.setdefault(free, []).append([bins - full, first + full])
    return entries, sequences


def pack(cuts: DataFrame, size: int = SIZE) -> DataFrame:
    """cuts (pieces(), already written) with sequence_id and offset."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    entries, _ = plan(histogram, size)
    kept = cuts.columns
    block = max(BLOCK_ROWS, -(-sum(histogram.values()) // BLOCKS))
    salts = spark.createDataFrame([(n, -(-c // block)) for n, c in histogram.items() if c > block], "_hot int, _salts long")
    rows = cuts.join(F.broadcast(salts), F.col("length") == F.col("_hot"), "left")  # at most `size` rows: common lengths only
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("_salts", F.lit(1)))).drop("_hot", "_salts")
    blocks = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), before.alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(within) - 1).join(blocks, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_before") + F.col("_in"))
    slots = spark.createDataFrame(entries or [(0, 0, 0, 0, 1, 0)], "_length int, _lo long, _many long, _seq long, _per long, _off long")
    # A piece's entry is the last of its length that starts at or below its rank: a sorted list per length, searched in place.
    lists = slots.groupBy("_length").agg(F.sort_array(F.collect_list(F.struct("_lo", "_many", "_seq", "_per", "_off"))).alias("_e"))
    got = ranked.join(F.broadcast(lists), F.col("length") == F.col("_length"))  # one row per length, a few thousand entries in all: bounded by `size`
    got = got.withColumn("_x", F.filter("_e", lambda e: (e["_lo"] <= F.col("_rank")) & (F.col("_rank") < e["_lo"] + e["_many"]))[0])
    step = F.col("_rank") - F.col("_x._lo")
    return got.select(*kept, (F.col("_x._seq") + F.expr("(_rank - _x._lo) div _x._per")).alias("sequence_id"), (F.col("_x._off") + (step % F.col("_x._per")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) per piece."""
    cuts = cut(pieces(docs, path, size, end, with_ids), "pack-pieces")
    got = pack(cuts, size)
    return got.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32-bit): the packed sequences themselves, each at most `size` ids."""
    parts = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
