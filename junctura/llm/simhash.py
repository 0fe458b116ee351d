"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits, found by meet-in-the-middle ball hashing.

For radius 2 every distinct fingerprint emits itself and its 64 one-bit variants; two fingerprints at most 2 bits apart
share a variant, so a shuffle on variants brings them together. All fingerprints around one variant are within 2 bits
of each other and there are at most 65, so linking each to the one before it loses no component and never emits all
pairs. Links are verified and deduplicated; components come from alternating large-star / small-star rounds on
written tables. Edges of a hub, rows of a common fingerprint and members of a large group are dealt over parts where they join.

Deduplication of documents (keep_one) asks for a similarity of 0.8 over five-word shingles, at which 64-bit fingerprints differ in about ten bits. It
hashes balls of radius 1 around each of the four 64-bit blocks of a 256-bit SimHash of word pairs and, as those lose pairs near the threshold, equal values of
twenty bands of six MinHashes of the shingles (at a similarity of 0.8 these alone miss 0.2 %). Texts that meet are compared on MinHash sketches and, within
MARGIN of the threshold, on their whole shingle sets. Chains through each group come first; what they leave apart in a group of three or more texts is
then compared in full, in blocks: of each text and other class the TRIES partners whose sketches resemble it most are verified first, then, where
the two are still apart, TRIES times as many, until none within the margin is left. So of the pairs that meet none is given up however many texts a group
holds, but for those whose sketches, four standard errors from the threshold, are wrong on which side of it they lie.

Defined results: null or white texts have fingerprint zero and are linked like any other; equal texts share a fingerprint
and cost one node; a null doc_id never becomes a component's smallest id unless all are null; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOGETHER, cut, discard, lean, map_texts, packed, spread_join


def fingerprint(text: str, width: int) -> int:
    """SimHash of the word shingles of a text; A-Z lower-cased, words at ASCII white space, shingles hashed by XXH64 with seed 42."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 4096):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + 4096], ends[i + width - 1 : i + 4096 + width - 1], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """doc_id, h (a hash that tells texts apart), fp (64 bits as a long) for every row."""

    def make():
        def run(keys, texts):
            fps = [fingerprint(x, width) for x in texts]
            return [keys[0], keys[1], [x - (1 << 64) if x >> 63 else x for x in fps]]

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_texts(slim, ["doc_id", "h"], "text", "doc_id long, h long, fp long", make)


def _flip(v: str, p: str) -> Column:
    """The fingerprint that put variant p (0: itself, b + 1: bit b flipped) into ball v."""
    return F.when(F.col(p) == 0, F.col(v)).otherwise(F.col(v).bitwiseXOR(F.expr(f"shiftleft(1L, cast({p} as int) - 1)")))


def near_links(nodes: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that are within 2 bits. A ball's row is the variant and its number: which fingerprint it came from follows from these."""
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - ((1 << 64) if b == 63 else 0))) for b in range(64)])
    near = nodes.select(F.posexplode(ball).alias("p", "v")).select("v", F.col("p").cast("byte").alias("p"))
    along = near.select("v", "p", F.lag("p").over(Window.partitionBy("v").orderBy("p")).alias("q")).where("q is not null")
    pairs = along.select(_flip("v", "q").alias("x"), _flip("v", "p").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


#: Links that one task may take: a graph of no more isn't dealt out.
ALONE = 50_000


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """node, root for every node of links (a, b): the smallest node of its component. Stars are drawn together until a round changes nothing; a hub's edges are dealt over parts."""
    edges, seen = cut(links.select("a", "b").where("a <> b"), f"{name}-links"), None
    rows = edges.count()

    def kept(df: DataFrame, step: str) -> DataFrame:
        return cut(df.coalesce(1) if rows <= ALONE else df, f"{name}-{step}")

    def least(arcs: DataFrame, known: str) -> DataFrame:
        """u, m (the smallest that `known` names), n (its arcs)."""
        got = arcs.groupBy("u").agg(F.expr(known).alias("m"), F.count(F.lit(1)).alias("n"))
        return got if rows <= ALONE else kept(got, "least")

    def met(arcs: DataFrame, low: DataFrame) -> DataFrame:
        return arcs.join(low, "u") if rows <= ALONE else spread_join(arcs, low, "u", "n", 2 * rows)

    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = least(both, "least(min(v), u)")
        large = kept(met(both, low).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")  # u > v
        down = least(large, "min(v)")
        small = met(large, down).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, edges = edges, kept(small.distinct(), "small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        discard(last, low, large, down)
        if now == seen or now[0] == 0:
            break
        seen, rows = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(prints: DataFrame) -> DataFrame:
    """fp, n (rows), root (the class's name), component_id (smallest doc_id of the class) per distinct fingerprint. prints: doc_id, fp."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(near_links(nodes), "simhash")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root"))
    linked = named.join(roots.select(F.col("root").alias("_r")).distinct(), F.col("root") == F.col("_r"), "left_semi")
    # Partial sums first: one row a class and task is shuffled, however large the class.
    best = linked.groupBy("root").agg(F.min("low").alias("best"), F.count(F.lit(1)).alias("_k"))
    known = spread_join(named, best, "root", "_k", nodes.count()).select("fp", "n", "root", F.coalesce("best", "low").alias("component_id"))
    alone = named.join(best.select("root"), "root", "left_anti").select("fp", "n", "root", F.col("low").alias("component_id"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = cut(fingerprints(docs, width), "simhash-prints")
    got = spread_join(prints, cut(classes(prints), "simhash-classes"), "fp", "n", prints.count())
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Blocks of 64 bits, bins of a MinHash sketch, and four standard errors of what the sketch estimates at a similarity of 0.8.
BLOCKS, BINS, MARGIN = 4, 512, 0.07
#: Bands of MinHashes beside the blocks, and MinHashes of each.
BANDS, DEEP = 20, 6
#: Partners of a text in another class that are verified at first, and what their number grows by.
TRIES = 8
#: Texts of a group that one task takes at once; node ids below which a list of them is broadcast.
MEET, FEW = 2_000, 200_000


def shingle_hashes(text: str, width: int):
    """XXH64 of the word shingles of a text, repeats included (fewer words: the whole sequence; none: empty)."""
    import numpy as np
    import xxhash

    words, digest = text.encode("utf-8", "replace").lower().split(), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64, len(starts))


@cache
def _multipliers():
    """The odd numbers that make the MinHashes."""
    import numpy as np

    rng = np.random.default_rng(2_011)
    return tuple(rng.integers(0, 1 << 63, (BANDS * DEEP, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def bands(g) -> list[int]:
    """64-bit hashes of BANDS bands of DEEP MinHashes of an array of shingle hashes; a band's number is its seed."""
    import numpy as np
    import xxhash

    a, b = _multipliers()
    low = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(g), 4096):
        x = (g[None, i : i + 4096] ^ b) * a
        x ^= x >> np.uint64(32)
        x *= a
        low = np.minimum(low, x.min(axis=1))
    found = np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, DEEP))], np.uint64)
    return found.view(np.int64).tolist()


def sketch(text: str, width: int = 5) -> tuple[list[int], bytes]:
    """A 256-bit SimHash of word pairs as BLOCKS blocks of 64 bits, then BANDS bands of MinHashes, and a one-permutation MinHash of word shingles, a byte a bin (0: empty)."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * BLOCKS + bands(np.zeros(0, np.uint64)), bytes(BINS)
    wide, pairs = xxhash.xxh3_128_digest, [b" ".join(p) for p in zip(words, words[1:], strict=False)] or words
    ones = np.zeros(64 * BLOCKS, np.int64)
    for i in range(0, len(pairs), 4096):
        h = np.frombuffer(b"".join([wide(g, 1) + wide(g, 2) for g in pairs[i : i + 4096]]), np.uint8).reshape(-1, 8 * BLOCKS)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    blocks = np.packbits(2 * ones > len(pairs)).view(">i8").tolist()
    g = shingle_hashes(text, width)
    order = np.argsort(g >> np.uint64(9))[::-1]
    sig = np.zeros(BINS, np.uint8)
    sig[(g % np.uint64(BINS))[order].astype(np.int64)] = ((g >> np.uint64(9)) % np.uint64(255) + np.uint64(1))[order].astype(np.uint8)
    return blocks + bands(g), sig.tobytes()


def sketches(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """doc_id, h (a hash that tells texts apart), blocks, sig for every row."""

    def make():
        def run(keys, texts):
            got = [sketch(x, width) for x in texts]
            return [keys[0], keys[1], [b for b, _ in got], [s for _, s in got]]

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_texts(slim, ["doc_id", "h"], "text", "doc_id long, h long, blocks array<long>, sig binary", make)


def resemblance(p, q):
    """Estimated Jaccard similarity of sketches (rows of bytes); 1 where both are empty."""
    import numpy as np

    used = ((p > 0) | (q > 0)).sum(-1)
    return np.where(used == 0, 1.0, ((p == q) & (p > 0)).sum(-1) / np.maximum(used, 1))


def _members(nodes: DataFrame) -> DataFrame:
    """g, h, n, rep: each text in the groups of several texts that it meets others in, with the group's size and smallest text. A group is a band's value, or the block values that chains of balls connect (so all texts that share a ball share a group, and a text is in BLOCKS + BANDS groups at most)."""
    own = nodes.select("h", F.explode(F.slice("blocks", 1, BLOCKS)).alias("fp")).distinct()
    values = cut(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "simhash-values")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(near_links(values), "simhash-balls")
    met = values.join(roots, values.fp == roots.node, "left").where("n > 1 or root is not null").select("fp", "n", F.coalesce("root", "fp").alias("g"))
    by_block = spread_join(own, cut(met, "simhash-met"), "fp", "n", total).select("g", "h")
    every = cut(by_block.unionByName(nodes.select(F.explode(F.slice("blocks", BLOCKS + 1, BANDS)).alias("g"), "h")).distinct(), "simhash-all")
    groups = cut(every.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("rep")).where("n > 1"), "simhash-groups")
    got = cut(spread_join(every, groups, "g", "n", every.count()).select("g", "h", "n", "rep"), "simhash-members")
    discard(values, every, groups)
    return got


def _chains(members: DataFrame) -> DataFrame:
    """a < b: pairs along each group's texts. Texts of large groups are chained in salted parts, each tied to the group's first."""
    own = members.withColumn("salt", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / MEET)))
    own = own.select("h", F.coalesce(F.lag("h").over(Window.partitionBy("g", "salt").orderBy("h")), "rep").alias("other")).where("h <> other")
    return own.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b, e of the pairs whose sketches resemble each other enough."""

    @F.pandas_udf("double")
    def alike(x, y):
        import numpy as np
        import pandas as pd

        lean()
        p, q = (np.frombuffer(b"".join(map(bytes, c)), np.uint8).reshape(len(c), BINS) for c in (x, y))
        return pd.Series(resemblance(p, q))

    sig = nodes.select(F.col("h").alias("_h"), F.col("sig").alias("_sig"))
    both = pairs.join(sig, F.col("a") == F.col("_h")).select("a", "b", F.col("_sig").alias("sa")).join(sig, F.col("b") == F.col("_h")).select("a", "b", "sa", F.col("_sig").alias("sb"))
    return both.select("a", "b", alike("sa", "sb").alias("e")).where(F.col("e") >= least)


def _exact(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b of the pairs whose whole shingle sets have the similarity."""

    def make():
        def run(keys, texts):
            import numpy as np

            return [keys[0], [np.unique(shingle_hashes(x, width).astype("<u4")).tobytes() for x in texts]]

        return run

    @F.pandas_udf("double")
    def jaccard(x, y):
        import numpy as np
        import pandas as pd

        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(1, len(p) + len(q) - both) if len(p) or len(q) else 1.0)
        return pd.Series(out, dtype=float)

    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("_h")).distinct(), "simhash-need")
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    few = need.limit(FEW + 1).count() <= FEW
    texts = texts.join(F.broadcast(need) if few else need, F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h"])
    sets = cut(map_texts(texts, ["h"], "text", "h long, s binary", make), "simhash-sets")
    sets = sets.select(F.col("h").alias("_h"), F.col("s").alias("_s"))
    both = pairs.join(sets, F.col("a") == F.col("_h")).select("a", "b", F.col("_s").alias("sa")).join(sets, F.col("b") == F.col("_h")).select("a", "b", "sa", F.col("_s").alias("sb"))
    return both.where(jaccard("sa", "sb") >= similarity).select("a", "b")


def _apart(nodes: DataFrame, classes: DataFrame, members: DataFrame, least: float, tries: int, only: DataFrame | None = None) -> DataFrame:
    """a, b, to, e: for each group of three or more texts of several classes, the `tries` texts of every other class (to) that each text b outside the group's largest class (of those in `only`, if given) resembles most. Both sides are dealt in blocks of MEET that meet pairwise in a task."""
    rows = cut(members.select("g", "h").join(classes, "h").select(F.col("g").alias("v"), "h", "c"), "simhash-classed")
    most = rows.groupBy("v", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("top")).where("n > 2 and top.k < n")
    most = cut(most.select("v", "n", F.ceil(F.col("n") / MEET).alias("_cb"), F.ceil((F.col("n") - F.col("top.k")) / MEET).alias("_qb"), F.col("top.c").alias("_top")), "simhash-apart")
    rows = spread_join(rows, most, "v", "n", rows.count())
    salt = F.xxhash64("h")
    given = rows.select("v", F.pmod(salt, "_cb").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_qb") - 1)).alias("y"), F.lit(False).alias("ask"), "h", "c")
    asking = rows.where("c <> _top")
    if only is not None:
        asking = cut(asking.join(only, "h", "left_semi"), "simhash-again")
        given = given.join(asking.select("v").distinct(), "v", "left_semi")
    asked = asking.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cb") - 1)).alias("x"), F.pmod(salt, "_qb").alias("y"), F.lit(True).alias("ask"), "h", "c")
    met = given.unionByName(asked).join(nodes.select("h", "sig"), "h").select(F.concat_ws(",", F.col("v").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")).alias("key"), "ask", "h", "c", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, hs, cs, sigs, matrix = None, [], [], [], None
        for b in batches:
            out: list = []
            for at, ask, h, c, sig in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if at != key:
                    key, hs, cs, sigs, matrix = at, [], [], [], None
                if not ask:
                    hs.append(h)
                    cs.append(c)
                    sigs.append(sig)
                elif hs:
                    if matrix is None:
                        matrix = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), BINS)
                    e = resemblance(matrix, np.frombuffer(sig, np.uint8))
                    near, taken = np.flatnonzero(e >= least), Counter()
                    for i in near[np.argsort(-e[near], kind="stable")].tolist():
                        if cs[i] != c and taken[cs[i]] < tries:
                            taken[cs[i]] += 1
                            out.append((h, hs[i], cs[i], float(e[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["b", "a", "to", "e"])

    got = met.repartition("key").sortWithinPartitions("key", "ask").mapInArrow(run, "b long, a long, to long, e double")
    best = Window.partitionBy("b", "to").orderBy(F.desc("e"), "a")
    return got.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= tries).select("a", "b", "to", "e")


def similar_classes(nodes: DataFrame, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """h, c for every distinct text: its class under links between texts of the given Jaccard similarity of word shingles. nodes (written): h, blocks, sig."""
    members = _members(nodes)

    total = nodes.count()

    def of(classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) of texts in different classes, with these (ca, cb)."""
        ca, cb = classes.select(F.col("h").alias("a"), F.col("c").alias("ca")), classes.select(F.col("h").alias("b"), F.col("c").alias("cb"))
        return pairs.join(ca, "a").join(cb, "b").where("ca <> cb")

    def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
        """Classes that links connect become one; only the links between classes are looked at."""
        open_links = cut(of(classes, links).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "simhash-between")
        if open_links.isEmpty():
            return classes
        roots = components(open_links, "simhash-joined")
        moved = classes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(roots, F.col("c") == F.col("node")).select("c", "n", "root")
        return cut(spread_join(classes, cut(moved, "simhash-moved") if total > TOGETHER else moved, "c", "n", total, "left").select("h", F.coalesce("root", "c").alias("c")), "simhash-classes")

    def verified(scored: DataFrame, classes: DataFrame) -> DataFrame:
        """Of the pairs near the threshold and in different classes, those that reach it."""
        open_pairs = cut(of(classes, scored.where(F.col("e") < similarity + MARGIN)).select("a", "b"), "simhash-open")
        return open_pairs if open_pairs.isEmpty() else cut(_exact(open_pairs, docs, width, similarity), "simhash-verified")

    sure = F.col("e") >= similarity + MARGIN
    scored = cut(_estimated(_chains(members), nodes, similarity - MARGIN), "simhash-scored")
    roots = components(scored.where(sure).select("a", "b"), "simhash-sure")
    classes = cut(nodes.select("h").join(roots, nodes.h == roots.node, "left").select("h", F.coalesce("root", "h").alias("c")), "simhash-classes")
    classes = joined(classes, verified(scored, classes))
    tries, only, tried = TRIES, None, None
    while True:
        rest = cut(_apart(nodes, classes, members, similarity - MARGIN, tries, only), "simhash-rest")
        if rest.isEmpty():
            return classes
        # Pairs that an earlier round verified are not verified again.
        fresh = rest if tried is None else cut(rest.join(tried, ["a", "b"], "left_anti"), "simhash-fresh")
        tried = rest.select("a", "b") if tried is None else tried.unionByName(fresh.select("a", "b"))
        classes = joined(classes, fresh.where(sure).select("a", "b"))
        classes = joined(classes, verified(fresh, classes))
        # Texts that have more partners than were taken in a class that is still another.
        full = rest.groupBy("b", "to").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a")).where(F.col("n") >= tries)
        only = cut(of(classes, full.select("a", "b")).select(F.col("b").alias("h")).distinct(), "simhash-full")
        if only.isEmpty():
            return classes
        tries *= TRIES


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each class of near-duplicates (texts linked at the given similarity of their word shingles) the row with the smallest doc_id (null last; one of rows alike), with the input's columns."""
    nodes = cut(sketches(docs, width).groupBy("h").agg(F.min("doc_id").alias("low"), F.first("blocks").alias("blocks"), F.first("sig").alias("sig")), "simhash-texts")
    named = nodes.select("h", "low").join(similar_classes(nodes, docs, width, similarity), "h")
    # One text of each class, by its smallest doc_id; then one row of that text.
    best = named.groupBy("c").agg(F.min_by(F.struct("h", "low"), F.struct(F.col("low").isNull(), "low", "h")).alias("k"))
    keep = cut(best.select(F.xxhash64("k.low", "k.h").alias("_j"), F.col("k.h").alias("_h"), F.col("k.low").alias("_id")), "simhash-keep")
    rows = packed(docs).withColumn("_k", F.xxhash64("_row.text")).withColumn("_d", F.col("_row.doc_id").cast("long")).withColumn("_j", F.xxhash64("_d", "_k"))
    # One hash of both keys, so that rows are shuffled once for the join and for what follows.
    got = rows.join(keep.withColumnRenamed("_j", "_q").hint("merge"), (F.col("_j") == F.col("_q")) & F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_h")), "left_semi")
    alike = Window.partitionBy("_j", "_d", "_k").orderBy(F.lit(0))
    return got.withColumn("_n", F.row_number().over(alike)).where("_n = 1").select("_row.*")
