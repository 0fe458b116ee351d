"""Approximate nearest neighbours by cross-polytope hashing.

Inner products become angles by one more dimension. Vectors are indexed in bands of norms that differ by a factor of sqrt(2) at
most (small neighbouring bands are one, of one bucket); each is brought to its own band's largest norm by that dimension, queries
have 0 there and probe every band. A table's hash rotates a vector pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and
takes the nearest signed axis; where more buckets are wanted, several hashes are joined, the last over a part of the axes
only, so that a bucket holds about `bucket` vectors at any corpus size. Queries probe the nearest buckets of each of `tables` tables; what they meet there is scored exactly, on the original vectors in
double precision. `probes`, dealt over the bands, is the least: `sample` queries are searched exactly at the table's real size, and probes
(up to MOST a band and table), then tables, grow until these have `recall` of their neighbours. Where that would score as many candidates as there
are vectors, or there are few queries, all are searched exactly.

Equal vectors are one vector with several ids: all of them for answers need only the smallest k + 1. Buckets beyond
`block` vectors or queries are split into blocks that meet pairwise, so a hot bucket is many small tasks, and every task streams.
Queries that found fewer than k are searched exactly against all vectors in blocks.

Defined results: vectors that are null, empty, zero, of another dimension than most, or hold null or non-finite components
take no part; a null vec_id takes no part; ties go to the smaller vec_id; rows repeated with one vec_id and vector count once; fewer
than k candidates give as many rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join

SEED = 20_011
#: Probes of a band's table at most; tables of a band are numbered below WIDE.
MOST, WIDE = 512, 64


def hadamard(x):
    """Fast Walsh-Hadamard transform of rows; their length is a power of two."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = y[:, :, 0, :] + y[:, :, 1, :], y[:, :, 0, :] - y[:, :, 1, :]
        x = __import__("numpy").stack([a, b], axis=2).reshape(len(x), n)
        h *= 2
    return x


class CrossPolytope:
    """The hash of one table."""

    def __init__(self, dim: int, table: int, buckets: int):
        import numpy as np

        self.np, self.size = np, 1 << (dim - 1).bit_length()
        self.axes: list[int] = []  # of each joined hash
        left = buckets
        while left > 1:
            self.axes.append(min(self.size, 1 << max(0, ((left + 1) // 2 - 1).bit_length())))
            left = -(-left // (2 * self.axes[-1]))
        rng = np.random.default_rng([SEED, table])
        self.signs = rng.choice([-1.0, 1.0], (max(1, len(self.axes)), 3, self.size))

    def rotated(self, x, i: int):
        np = self.np
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for s in self.signs[i]:
            y = hadamard(y * s)
        return y[:, : self.axes[i]]

    def near(self, x, probes: int):
        """The `probes` best buckets of each row, best first (as many as there are)."""
        step = max(1, (1 << 21) // probes**2)
        return self.np.concatenate([self._near(x[i : i + step], probes) for i in range(0, max(1, len(x)), step)])

    def _near(self, x, probes: int):
        np = self.np
        code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        norm = np.sqrt((x * x).sum(1, keepdims=True)) * self.size**1.5
        for i, axes in enumerate(self.axes):
            y = self.rotated(x, i) / norm
            signed = np.concatenate([y, -y], axis=1)
            take = min(probes, 2 * axes)
            best = np.argsort(-signed, axis=1, kind="stable")[:, :take]
            far = (signed.max(1, keepdims=True) - np.take_along_axis(signed, best, 1)) ** 2
            joint = (loss[:, :, None] + far[:, None, :]).reshape(len(x), -1)
            codes = (code[:, :, None] * (2 * axes) + best[:, None, :]).reshape(len(x), -1)
            order = np.argsort(joint, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(codes, order, 1), np.take_along_axis(joint, order, 1)
        return code


def distinct_vectors(vectors: DataFrame, k: int, every: int, dim_only: bool = True) -> DataFrame:
    """uid (smallest vec_id), v (double components), ids (the k + 1 smallest), asks (whether one of its vec_ids is a query), for each distinct usable vector."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    raw = raw.where("vec_id is not null and v is not null and size(v) > 0").where(~bad & F.exists("v", lambda x: x != 0))
    raw = cut(raw, "ann-rows")
    dims = raw.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims and dim_only:
        raw = raw.where(F.size("v") == dims["d"])
    # Only k + 1 ids of each vector go on: ranked within the vector, cut before the shuffle.
    few = raw.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    asks = raw.groupBy("v").agg(F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asks"))
    got = few.groupBy("v").agg(F.min("vec_id").alias("uid"), F.sort_array(F.collect_list("vec_id")).alias("ids")).join(asks, "v")
    return got.select("uid", "v", "ids", "asks"), raw


def _best(candidates, queries, k: int):
    """For each query the k + 1 best (score, vec_id), nearest first, ties to the smaller vec_id. candidates: (matrix, ids of each), queries: matrix."""
    import numpy as np

    matrix, ids = candidates
    n, dim = matrix.shape
    rough = queries @ matrix.T
    least = np.full(len(queries), -np.inf)
    if n > k + 1:
        # Whatever may equal the (k + 1)-th best once it is summed up in the one order that all scores have.
        slack = 4 * dim * np.finfo(float).eps * np.sqrt((queries * queries).sum(1)) * np.sqrt((matrix * matrix).sum(1).max())
        least = np.partition(rough, n - k - 1, axis=1)[:, n - k - 1] - slack
    out = []
    for q, row, low in zip(queries, rough, least, strict=True):
        at = np.flatnonzero(row >= low)
        scores = (q * matrix[at]).sum(axis=1)
        if len(at) > k + 1:
            keep = scores >= np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
            at, scores = at[keep], scores[keep]
        pairs = sorted((-s, i) for c, s in zip(at.tolist(), scores.tolist(), strict=True) for i in ids[c])[: k + 1]
        out.append([(-s, i) for s, i in pairs])
    return out


_SCHEMA = "uid long, found array<struct<score:double,vec_id:long>>"


def _meet(rows: DataFrame, k: int, chunk: int = 256) -> DataFrame:
    """rows: key, ask (boolean), uid, v, ids; every candidate of a key meets every query of it."""
    rows = rows.repartition("key").sortWithinPartitions("key", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, vectors, ids, matrix, asking, asks = None, [], [], None, [], []
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

        def answer():
            nonlocal asking, asks, matrix
            if not asking or not vectors:
                asking, asks = [], []
                return None
            if matrix is None:
                matrix = np.array(vectors)
            best = _best((matrix, ids), np.array(asks), k)
            out = pa.RecordBatch.from_arrays([pa.array(asking, pa.int64()), pa.array([[{"score": s, "vec_id": i} for s, i in b] for b in best], kind)], names=["uid", "found"])
            asking, asks = [], []
            return out

        for b in batches:
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(b.num_rows, -1) if b.num_rows else flat
            for i, (at, ask, uid, own) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if at != key:
                    if (out := answer()) is not None:
                        yield out
                    key, vectors, ids, matrix = at, [], [], None
                if ask:
                    asking.append(uid)
                    asks.append(v[i])
                    if len(asking) == chunk and (out := answer()) is not None:
                        yield out
                else:
                    vectors.append(v[i])
                    ids.append(own)
        if (out := answer()) is not None:
            yield out

    return rows.select("key", "ask", "uid", "v", "ids").mapInArrow(run, _SCHEMA)


class Band:
    """Vectors of like norms: number, largest norm, size, buckets, and the probes of each of its tables."""

    def __init__(self, number: int, top: float, n: int, bucket: int):
        self.number, self.top, self.n, self.buckets, self.probes = number, top, n, max(1, -(-n // bucket)), 1

    def tables(self, tables: int) -> int:
        return tables if self.buckets > 1 else 1

    def lifted(self, v, query: bool):
        import numpy as np

        extra = np.zeros((len(v), 1)) if query else np.sqrt(np.maximum(0.0, self.top**2 - (v * v).sum(1)))[:, None]
        return np.concatenate([v, extra], axis=1)


def _bands(unique: DataFrame, bucket: int) -> tuple[list[Band], dict[int, int]]:
    """Bands from the largest norm down, and the band of each half octave of norms; neighbours that fit one bucket are one band."""
    bands, of = [], {}
    for r in unique.groupBy("octave").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy(F.desc("octave")).collect():
        if bands and bands[-1].n + r["n"] <= bucket:
            bands[-1].n += r["n"]
        else:
            bands.append(Band(len(bands), r["top"], r["n"], bucket))
        of[r["octave"]] = bands[-1].number
    return bands, of


def _ranks(bands: list[Band], dim: int, tables: range, pairs: dict):
    """For each band the place of true neighbours' buckets among the probes of their queries, the best over the tables (MOST: not among them). pairs: band -> (queries, neighbours), rows alike."""
    import numpy as np

    out = {}
    for g, (asking, found) in pairs.items():
        band, best = bands[g], np.full(len(found), MOST)
        q, at = np.unique(asking, axis=0, return_inverse=True)
        at = at.ravel()
        for t in tables if band.buckets > 1 else [0]:
            h = CrossPolytope(dim + 1, t, band.buckets)
            probed, own = h.near(band.lifted(q, True), MOST), h.near(band.lifted(found, False), 1)
            same = probed[at] == own
            best = np.minimum(best, np.where(same.any(1), same.argmax(1), MOST))
        out[g] = best
    return out


def _settle(bands: list[Band], tables: int, ranks: dict, recall: float) -> bool:
    """Raise probes where that finds most neighbours a candidate until `recall` of them is found; whether it is."""
    steps = sorted({int(2 ** (i / 2)) for i in range(2 * MOST.bit_length() - 1)} | {MOST})
    total = sum(map(len, ranks.values()))
    while sum(int((r < bands[g].probes).sum()) for g, r in ranks.items()) < recall * total:
        best = (0.0, None, 0)
        for g, r in ranks.items():
            b = bands[g]
            for p in steps:
                gain = int(((r >= b.probes) & (r < p)).sum())
                if gain and gain / ((p - b.probes) * b.n / b.buckets * tables) > best[0]:
                    best = gain / ((p - b.probes) * b.n / b.buckets * tables), b, p
        if best[1] is None:
            return False
        best[1].probes = best[2]
    return True


def _hashed(rows: DataFrame, dim: int, bands: list[Band], of: dict[int, int], tables: int, query: bool) -> DataFrame:
    """rows: uid, v, ids, octave -> uid, v, ids and t (band and table), bucket for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes = {(b.number, t): CrossPolytope(dim + 1, t, b.buckets) for b in bands for t in range(b.tables(tables))}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                own = np.array([of[o] for o in part.column(3).to_pylist()])
                for b in bands:
                    mine = np.arange(len(v)) if query else np.flatnonzero(own == b.number)
                    if not len(mine):
                        continue
                    wide = b.lifted(v[mine], query)
                    for t in range(b.tables(tables)):
                        code = hashes[b.number, t].near(wide, b.probes if query else 1)
                        pick, codes = np.repeat(mine, code.shape[1]), code.ravel()
                        for i in range(0, len(pick), 8192):
                            got = part.take(pa.array(pick[i : i + 8192]))
                            n = got.num_rows
                            yield pa.RecordBatch.from_arrays([*got.columns[:3], pa.array(np.full(n, b.number * WIDE + t, np.int32)), pa.array(codes[i : i + 8192])], names=["uid", "v", "ids", "t", "bucket"])

    return rows.select("uid", "v", "ids", "octave").mapInArrow(run, "uid long, v array<double>, ids array<long>, t int, bucket long")


def _exactly(unique: DataFrame, asks: DataFrame, n: int, k: int, bucket: int, block: int) -> DataFrame:
    """uid, found over all vectors, in blocks that are small tasks."""
    blocks = max(-(-n // block), min(64, -(-n // bucket)))
    one = unique.select("uid", "v", "ids", F.lit(False).alias("ask"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("string").alias("key"))
    every = asks.select("uid", "v", "ids", F.lit(True).alias("ask"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x.cast("string"))).alias("key"))
    return _merged(_meet(one.unionByName(every).select("key", "ask", "uid", "v", "ids"), k), k)


def _plan(unique: DataFrame, asks: DataFrame, n: int, dim: int, k: int, tables: int, probes: int, bucket: int, block: int, sample: int, recall: float):
    """Bands with their probes, the band of each half octave, and the tables that reach the recall on a sample of the queries; None where exact search costs no more."""
    import numpy as np

    some = cut(asks.orderBy(F.xxhash64("uid", F.lit(SEED)), "uid").limit(sample + 1), "ann-sample")
    if some.count() <= sample:
        return None
    some = some.limit(sample)
    bands, of = _bands(unique, bucket)
    true = cut(_exactly(unique, some, n, k, bucket, block), "ann-true").select("uid", F.explode("found.vec_id").alias("id"))
    named = unique.select(F.explode("ids").alias("id"), F.col("uid").alias("to"), F.col("v").alias("w"), "octave")
    got = true.join(F.broadcast(some.select("uid", "v")), "uid").join(named, "id").where("uid <> to").select("v", "w", "octave").collect()  # sample * (k + 1) rows at most
    lists: dict = {}
    for r in got:
        lists.setdefault(of[r["octave"]], []).append((r["v"], r["w"]))
    pairs = {g: (np.array([a for a, _ in x]), np.array([w for _, w in x])) for g, x in lists.items()}
    ranks: dict = {}
    for many in (tables, 2 * tables, 4 * tables):
        more = _ranks(bands, dim, range(many) if not ranks else range(many // 2, many), pairs)
        ranks = {g: np.minimum(r, ranks.get(g, MOST)) for g, r in more.items()}
        for b in bands:
            b.probes = max(1, round(probes * b.n / n))
        if _settle(bands, many, ranks, recall):
            met = sum(min(1.0, b.probes / b.buckets) * b.n * b.tables(many) for b in bands)
            if met < n:
                return bands, of, many
    return None


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each uid over all that was found for it."""
    every = found.groupBy("uid").agg(F.flatten(F.collect_list("found")).alias("f"))
    every = every.select("uid", F.sort_array(F.transform("f", lambda x: F.struct((-x["score"]).alias("less"), x["vec_id"].alias("vec_id")))).alias("s"))
    # Sorted, so repeated pairs are neighbours.
    once = F.filter("s", lambda x, i: (i == 0) | (x != F.get("s", i - 1)))
    best = every.select("uid", F.slice(once, 1, k + 1).alias("b"))
    return best.select("uid", F.transform("b", lambda x: F.struct((-x["less"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))


def _probed(unique: DataFrame, asks: DataFrame, facts, k: int, bucket: int, block: int, raw: DataFrame, bands: list[Band], of: dict[int, int], tables: int) -> DataFrame:
    """uid, found by probing; exactly where too few are met."""
    index = _hashed(unique, facts["d"], bands, of, tables, False)
    probe = _hashed(asks, facts["d"], bands, of, tables, True)
    rows = cut(index.withColumn("ask", F.lit(False)).unionByName(probe.withColumn("ask", F.lit(True))), "ann-rows")
    # Buckets beyond a block, few at any size (rows / block at most), are split; all others have one block.
    counts = rows.groupBy("t", "bucket").agg(F.sum((~F.col("ask")).cast("long")).alias("c"), F.sum(F.col("ask").cast("long")).alias("q"))
    hot = cut(counts.where((F.col("c") > block) | (F.col("q") > block)).select(F.col("t").alias("_t"), F.col("bucket").alias("_b"), F.ceil(F.col("c") / block).alias("_cb"), F.ceil(F.col("q") / block).alias("_qb")), "ann-hot")
    rows = rows.join(hot, (F.col("t") == F.col("_t")) & (F.col("bucket") == F.col("_b")), "left")
    own = F.pmod(F.xxhash64("uid", F.lit(SEED)), F.greatest(F.lit(1), F.coalesce(F.when(F.col("ask"), F.col("_qb")).otherwise(F.col("_cb")), F.lit(1))))
    others = F.greatest(F.lit(1), F.coalesce(F.when(F.col("ask"), F.col("_cb")).otherwise(F.col("_qb")), F.lit(1)))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    key = F.struct("t", "bucket", F.when(F.col("ask"), F.col("_other")).otherwise(F.col("_own")).alias("c"), F.when(F.col("ask"), F.col("_own")).otherwise(F.col("_other")).alias("q"))
    found = cut(_merged(_meet(rows.select(F.concat_ws(",", *[key[f] for f in ("t", "bucket", "c", "q")]).alias("key"), "ask", "uid", "v", "ids"), k), k), "ann-found")
    # What has met too few is searched exactly.
    total = raw.select("vec_id").distinct().count()
    short = asks.join(found.where(F.size("found") >= min(k + 1, total)), "uid", "left_anti")
    short = cut(short.select("uid", "v", "ids"), "ann-short")
    if short.count():
        again = _exactly(unique, short, facts["n"], k, bucket, block)
        found = found.join(short.select("uid"), "uid", "left_anti").unionByName(again)
    return found


def search(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 6, probes: int = 20, bucket: int = 400, block: int = 4096, sample: int = 128, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    unique, raw = distinct_vectors(vectors, k, every)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unique = unique.withColumn("norm", norm).withColumn("octave", F.floor(2 * F.log2(F.greatest("norm", F.lit(1e-300))) + 0.5).cast("int"))
    unique = cut(unique, "ann-unique")
    facts = unique.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not facts["n"]:
        return empty
    asks = unique.where("asks")
    plan = _plan(unique, asks, facts["n"], facts["d"], k, tables, probes, bucket, block, sample, recall)
    if plan:
        found = _probed(unique, asks, facts, k, bucket, block, raw, *plan)
    else:
        found = _exactly(unique, asks, facts["n"], k, bucket, block)
    # Queries of equal vectors share an answer; each leaves itself out.
    named = cut(raw.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("_h"), "v").distinct(), "ann-named")
    total = named.count()
    same = named.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    # By a hash of the vector, then by the vector itself: a common one is dealt over parts.
    own = cut(asks.select(F.xxhash64("v").alias("_h"), F.col("v").alias("_v"), "uid").join(same, "_h"), "ann-asks")
    answers = own.select("_h", "_v", "_n", "uid").join(found, "uid")
    got = spread_join(named, answers, "_h", "_n", total).where(F.col("v") == F.col("_v")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("f"))
    got = got.select("query_id", F.posexplode("f").alias("_i", "x"))
    return got.select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
