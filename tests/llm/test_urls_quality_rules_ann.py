import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from junctura.llm import ann, quality, rules, urlfilter

SPACES = " \t\n\x0b\x0c\r"


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_verdict(host, path):
    best = None
    for verdict, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best or (None, "allow")


URLS = [None, "", "no scheme", "http://", "http://com/en/", "http://COM/en/x", "https://a.example.com/en/7?x", "https://xexample.com/en/7", "http://example.com/en/7", "ftp://example.net/de/8", "http://net/de", "http://a.net#/de/", "http://a.org/x.com/en/", "http://é.org/es/ñ", "http://u:p@b.org:80/es/", "http://a://b.com/en/", "http://a.com/EN/", "http://a.com/\nen/", "://x.net/de/1"]


def test_urls(spark):
    rng = random.Random(4)
    urls = URLS + ["http://" + "".join(rng.choice(["com", "net", "org", "example", ".", "/", "en", "de", "es", "7", "8", "?", "#", "X"]) for _ in range(rng.randrange(12))) for _ in range(800)] + ["http://a.com/en/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "t", "clash") for i, u in enumerate(urls)] + [(None, URLS[4], None, None)] * 2, "page_id long, url string, host string, verdict string")
    got = Counter(map(tuple, urlfilter.judge(pages).collect()))
    want = Counter((i, *(hp := plain_url(u)), *plain_verdict(*hp)) for i, u in [*enumerate(urls), (None, URLS[4]), (None, URLS[4])])
    assert got == want
    assert urlfilter.judge(pages.limit(0)).collect() == []
    kept = urlfilter.keep_pages(pages)
    assert kept.columns == pages.columns and kept.count() == sum(n for r, n in want.items() if r[4] == "allow")


@settings(max_examples=200, deadline=None)
@given(globs=st.lists(st.text("ab*?", min_size=1, max_size=9), min_size=1, max_size=30), texts=st.lists(st.text("abc", max_size=12), min_size=1, max_size=6))
def test_automaton(globs, texts):
    import re

    got = urlfilter.Automaton([urlfilter.wild(g) for g in globs]).accepted([list(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), t) is not None for g in globs]


def plain_measures(text):
    text = text or ""
    flat = text
    for c in SPACES[1:]:
        flat = flat.replace(c, " ")
    w = [x for x in flat.split(" ") if x]
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in range(3)}
    dup, seen, n = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "#", "|", "é", "\u00a0", "\x0b", "\x1c"]), max_size=60).map("".join))
def test_measures(text):
    assert rules.measures(text) == plain_measures(text)


def test_allowed_is_the_exact_binomial():
    for n, risk, level in ((50, 0.1, 0.05), (400, 0.01, 0.05), (30, 0.004, 0.01), (2000, 0.01, 0.001), (0, 0.1, 0.1)):
        most = -1
        while most + 1 <= n and n and sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(most + 2)) <= level:
            most += 1
        assert rules.allowed(n, risk, level) == most


def test_rules(docs, no_docs, labels):
    got = rules.judge(docs, labels, risk=4.0, delta=0.5)
    rows = got.collect()
    want = Counter((r.doc_id, *plain_measures(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in rows) == want
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id not in (4, None)} | {4: 0}
    # Brute force of the cutoffs and verdicts.
    strata = {}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id in truth and not r.base_failed:
            strata.setdefault(r.stratum, []).append((truth[r.doc_id], r))
    value = {"symbols": lambda r: r.n_symbols / r.word_chars, "dup_lines": lambda r: r.n_dup_lines / r.n_lines, "repeats": lambda r: r.n_repeat_words / r.n_words, "long_words": lambda r: r.word_chars / r.n_words, "short_words": lambda r: -r.word_chars / r.n_words}
    chosen = {}
    for s, held in strata.items():
        for rule, (_, grid) in rules.RULES.items():
            good = [sum(y == 1 and value[rule](r) > c for y, r in held) for c in grid]
            bad = [sum(y == 0 and value[rule](r) > c for y, r in held) for c in grid]
            chosen[s, rule] = rules.choose(sum(y for y, _ in held), good, bad, grid, 4.0 / 5, 0.5 / (len(strata) * 5))
    assert any(c is not None for c in chosen.values())
    for r in rows:
        passed = not r.base_failed and all(chosen.get((r.stratum, rule)) is None or value[rule](r) <= chosen[r.stratum, rule] for rule in rules.RULES)
        assert r.kept == passed
    kept = rules.keep(docs, labels, risk=4.0, delta=0.5)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert rules.judge(no_docs, labels).collect() == [] and rules.keep(no_docs, labels.limit(0)).collect() == []
    assert all(r.kept != r.base_failed for r in rules.judge(docs, labels.limit(0)).collect())


def test_forward_backward_is_the_sum_over_all_labellings():
    import itertools

    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 5, 2])
    odds, start, move = rng.normal(size=11), rng.normal(size=2), rng.normal(size=(2, 2))
    p, z, moves = quality.forward_backward(odds, sizes, start, move)
    at = 0
    for chain, n in enumerate(sizes):
        total, good, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(start[y[0]] + sum(odds[at + i] for i in range(n) if y[i]) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                steps[a, b] += w
        assert p[at : at + n] == pytest.approx(good / total) and z[chain] == pytest.approx(math.log(total)) and moves[chain] == pytest.approx(steps / total)
        at += n


def test_quality_on_held_out_rows(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(s >= 0.3 for s in good) / len(good) > 0.95


def test_quality_edges(docs, no_docs, labels):
    got = quality.score(docs, labels, sample=40)
    assert got.count() == docs.count() and all(r.score is not None for r in got.collect())
    assert quality.score(no_docs, labels).collect() == []
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels, sample=40)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.collect())


def plain_nearest(rows, k, every):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in usable:
        if q % every == 0:
            found = sorted((-math.fsum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q)
            out[q] = [i for _, i in found[:k]]
    return out


def test_nearest_is_exact_where_one_bucket_holds_all(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.uniform(0.2, 3)]) for i in range(150)]
    rows += [(200 + i, rows[20][1]) for i in range(60)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [1.0] * 7), (304, [None] + [1.0] * 7), (None, [1.0] * 8), rows[5], (320, [float("inf")] * 8), (321, [])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid string")
    got = {}
    for r in ann.search(vectors, block=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    assert got == plain_nearest(rows, 20, 20)
    assert ann.search(vectors.limit(0)).collect() == []
    few = ann.search(vectors.where("vec_id < 5")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, i) for i in range(1, 5)]


def test_nearest_with_too_few_found_is_searched_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(r.query_id for r in ann.search(vectors, tables=1, probes=1, bucket=5, block=64).collect())
    assert got == Counter({q: 20 for q in range(0, 300, 20)})


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids, matrix = np.array(list(rows)), np.array(list(rows.values()), float)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(rows[r.query_id], np.array(rows[r.vec_id], float))), abs=1e-12)
    hit = total = 0
    for q, found in got.items():
        s = matrix @ np.array(rows[q], float)
        s[ids == q] = -9
        hit += len(found & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += 20
    assert hit / total >= 0.9


def recall_of(spark, matrix, **options):
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.search(vectors, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = matrix @ matrix[q]
        s[q] = -np.inf
        hit += len(found & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == -(-len(matrix) // 20)
    return hit / (20 * len(got))


def units(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_where_a_small_share_of_many_buckets_is_probed(spark):
    assert recall_of(spark, units(12_000, 24, 7), bucket=12, tables=3, probes=8) >= 0.9


def test_recall_with_one_outlier_and_with_heavy_tailed_norms(spark):
    x, rng = units(12_000, 24, 8), np.random.default_rng(9)
    for norms in (np.where(np.arange(len(x)) == 77, 10.0, 1.0), np.exp(rng.normal(size=len(x)))):
        assert recall_of(spark, x * norms[:, None], bucket=40) >= 0.9


def test_training_sees_lines_beyond_the_first_64(spark):
    rng = random.Random(14)

    def lines(n, words):
        return [" ".join(rng.choice(words) for _ in range(9)) for _ in range(n)]

    fine, junk = ["river", "mountain", "little", "garden", "the", "of", "reads"], ["$$$", "|||", "###", "%%9", "0&0"]
    rows = [(i, "\n".join(lines(70, fine) + lines(90, junk if i % 2 else fine))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, known).collect()}
    assert max(got[i] for i in got if i % 2) + 0.2 < min(got[i] for i in got if i % 2 == 0)


def test_training_samples_the_labelled_documents_that_are_left(spark):
    known = spark.createDataFrame([(i, int(i < 500)) for i in range(1000)], "doc_id long, quality int")
    order = [r.doc_id for r in known.where("quality = 0").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()]
    left = [*range(100), *order[-60:]]
    docs = spark.createDataFrame([(i, "a river reads the garden of mountains\n" * 5 if i < 500 else "$$$ ||| ### 0&0\n" * 5) for i in left], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, known, sample=40).collect()}
    assert max(got[i] for i in got if i >= 500) < 0.3 < 0.5 < min(got[i] for i in got if i < 500)
