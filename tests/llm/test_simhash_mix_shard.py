from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from junctura.llm import mix, shard, simhash
from junctura.llm.common import cut

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_fingerprint(text, width=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """doc_ids (a list) to the smallest reachable id, by trying all pairs."""
    n, parent = len(prints), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(d, low[r])
    return [low[find(i)] for i in range(n)]


def test_near_duplicates(docs, no_docs):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(no_docs).collect() == []


def test_chains_and_bit_63(spark):
    chain = [0]
    for b in range(0, 63, 2):
        chain.append(chain[-1] ^ (3 << b))
    chain += [1 << 63, (1 << 63) ^ 0xF0F0F0]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(chain)]
    got = {r.fp: r.component_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    want = plain_components([(i, f) for i, f in enumerate(chain)])
    assert [got[f] for _, f in rows] == want


def test_components_of_any_graph(spark):
    import random

    rng = random.Random(2)
    for n, m in ((40, 30), (60, 50), (30, 200)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(33)]
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
        near = defaultdict(set)
        for a, b in links:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        for x in near:
            seen, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            assert got[x] == min(seen)
        assert set(got) == set(near)


def shingles(text, width=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_keep_one(docs, no_docs):
    rows = docs.collect()
    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append((r.doc_id is None, r.doc_id or 0))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(map(min, best.values()))
    assert simhash.keep_one(no_docs).collect() == []


def test_keep_one_finds_near_copies_and_leaves_the_rest(spark):
    import random

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    rows, copies = [], 0
    for i in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 500))]
        rows.append(" ".join(base))
        for _ in range(i % 3):
            edited = list(base)
            for _ in range(max(1, len(base) // 90)):  # at a similarity of 0.88 or more
                edited[rng.randrange(len(edited))] = "new"
            rows.append(" ".join(edited))
            copies += 1
    got = simhash.keep_one(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")).count()
    assert 120 <= got <= 120 + 0.03 * copies


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        share = (total - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: share * weight[s] for s in rest}
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mix_plan(docs, no_docs):
    rows = docs.collect()
    got = mix.mix_plan(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len(words(r.text or ""))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text or ""))
    targets, taken, largest = plain_targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] and r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mix.mix_plan(docs).repartition(3).collect()))
    assert mix.mix_plan(no_docs).collect() == []


def test_mix_many_levels_stays_near_targets(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.xxhash64("id") % 90 + 95).cast("int")), " ").alias("text"),
    )
    got = mix.mix_plan(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 190
    again = mix.mix(rows).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source: r.n for r in again} == {r.source: r.taken for r in got}


def test_mix_is_unbiased(spark):
    rows = cut(spark.range(40).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 5 + 3).alias("size"), F.lit(0).cast("long").alias("h")), "t")
    other = cut(rows.limit(0).unionByName(spark.range(40).select(F.lit("t").alias("source"), (F.col("id") + 100).alias("doc_id"), F.lit(5).cast("long").alias("size"), F.lit(0).cast("long").alias("h"))), "t")
    hits, runs = Counter(), 12
    for seed in range(runs):
        for r in mix.copies(rows.unionByName(other), seed=seed).collect():
            rate = r.target / r.source_size
            assert r.base == int(rate)
            hits[r.source] += r.extra
    assert 0.5 < hits["s"] / runs / 40 < 0.85  # rate 2/3


def test_mix_keeps_columns(docs, no_docs):
    got = mix.mix(docs)
    assert got.columns == docs.columns
    plan = Counter()
    for r in mix.mix_plan(docs).collect():
        plan[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +plan
    assert mix.mix(no_docs).collect() == []


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"d{i}") for i in range(dims)])
        got = sorted((r["h"], tuple(r[f"d{i}"] for i in range(dims))) for r in cells.withColumn("h", shard.hilbert_index([F.col(f"d{i}") for i in range(dims)], bits)).collect())
        assert [h for h, _ in got] == list(range(side**dims))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, no_docs, law):
    import zlib

    rows = docs.collect()
    got = shard.assign(docs, shards=8, law=law).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    if law == "rows":
        assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in part) - total / 8) <= largest for part in by.values())
    assert shard.assign(no_docs, law=law).collect() == []


def test_write_shards(docs, spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    shard.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and {r._shard for r in back.select("_shard").distinct().collect()} == {0, 1, 2}


def shingle_jaccard(a, b):
    x, y = (set(zip(*[t[i:] for i in range(5)], strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_finds_contiguous_edits(spark):
    import random

    rng = random.Random(11)

    def passage(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    rows, pairs = [], 0
    while pairs < 300:
        a = passage(rng.randrange(200, 600))
        n = len(a)
        kind, part = pairs % 3, rng.uniform(0.06, 0.24)
        k = int(part * n)
        at = rng.randrange(n - k)
        b = (a + passage(k), a[: n - k], a[:at] + passage(k // 2) + a[at + k // 2 :])[kind]
        if 0.8 <= shingle_jaccard(a, b) <= 0.87:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {2 * i for i in range(pairs)} <= kept
    assert len(kept) - pairs <= 2


def test_every_partner_near_the_threshold_is_verified(spark, monkeypatch):
    import random

    import numpy as np

    rng, rows, traps, trial = random.Random(13), [], 0, 0
    while traps < 5 and trial < 400:
        trial += 1
        base = [f"w{rng.randrange(10**6)}" for _ in range(700)]
        group = []
        for _ in range(24):
            t = list(base)
            for at in rng.sample(range(700), 3):
                t[at] = f"x{rng.randrange(10**6)}"
            group.append(t)
        n, at = round(700 * rng.uniform(0.08, 0.11)), rng.randrange(500)
        out = base[:at] + [f"y{rng.randrange(10**6)}" for _ in range(n)] + base[at + n :]
        true = [shingle_jaccard(out, t) for t in group]
        if not max(true) >= 0.8 > min(true):
            continue
        a = np.frombuffer(simhash.sketch(" ".join(out))[1], np.uint8)
        e = [float(simhash.resemblance(a[None], np.frombuffer(simhash.sketch(" ".join(t))[1], np.uint8)[None])[0]) for t in group]
        order = sorted(range(24), key=lambda i: -e[i])
        if max(e) < 0.87 and all(true[i] < 0.8 for i in order[:3]) and any(true[i] >= 0.8 and e[i] >= 0.74 for i in order):
            rows += [(100 * traps + i, " ".join(t)) for i, t in enumerate([*group, out])]
            traps += 1
    assert traps == 5
    monkeypatch.setattr(simhash, "TRIES", 2, raising=False)  # several rounds
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == [100 * i for i in range(traps)]
