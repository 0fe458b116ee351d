"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of the lines before and after it; the chain labels lines good or bad, with
learned transitions; forward-backward gives each line's probability of being good, and their mean weighted by line length is
the document's score. Labels exist for documents only, so a training document's lines all carry its label.

The model is fitted on a bounded sample: at most `sample` labelled documents of either class (those with the smallest hashes)
and at most `lines` lines of each, the classes weighted back to their shares. Every row is scored over its whole text.

Defined results: a null or empty text is one empty line; without labels of both classes the model is undecided and every
score is 0.5; contradictory labels of a document count as the lower one; repeated rows are scored alike; labels, lang, source
and doc_id never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, map_texts, small_batches

SYMBOLS, PUNCT, DIGITS, CAPS = b"#*$%&|<>", b".,;:?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OWN = 16
WIDTH = 3 * OWN


def line_features(text: str):
    """Features (lines x OWN) and lengths of a text's lines."""
    import math

    import numpy as np

    lines = text.encode("utf-8", "replace").split(b"\n")
    kept = [x for x in lines if x and not x.isspace()] or [b""]
    seen: set[bytes] = set()
    out, lengths = [], []
    for b in kept:
        n = len(b)
        words = b.split()
        k = len(words)
        per, share = 1.0 / max(n, 1), 1.0 / max(k, 1)
        symbols, marks = n - len(b.translate(None, SYMBOLS)), b.count(b"!")
        distinct = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False))) if k > 2 else max(k - 1, 0)
        caps = n - len(b.translate(None, CAPS))
        out.append((
            1.0,
            math.log1p(k) * 0.3,
            caps * per * 2,
            min(symbols * per * 8, 3.0),
            min(symbols * share, 2.0),
            min(marks * share, 2.0),
            min((n - len(b.translate(None, DIGITS))) * per * 4, 2.0),
            min((n - len(b.translate(None, PUNCT))) * per * 10, 2.0),
            1.0 - distinct * share,
            (1.0 - pairs / (k - 1)) * 2 if k > 1 else 0.0,
            sum(map(bytes.__eq__, words, words[1:])) * share * 2,
            min(n * share * 0.1, 3.0),
            1.0 if b in seen else 0.0,
            1.0 if k <= 3 else 0.0,
            1.0 if b[-1:] in (b".", b"!", b"?") else 0.0,
            min(b.count(b"|") * share * 2, 1.0),
        ))
        lengths.append(max(n, 1))
        seen.add(b)
    return np.array(out), np.array(lengths, float)


def with_neighbours(x):
    """Each line's features, then those of the line before and of the line after (zeros at the ends)."""
    import numpy as np

    out = np.zeros((len(x), WIDTH))
    out[:, :OWN] = x
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[:-1, 2 * OWN :] = x[1:]
    return out


def forward_backward(good, sizes, start, move):
    """good: log-odds of lines of several chains laid end to end, sizes: lines of each chain, start: 2 weights, move: 2 x 2 weights (from, to). Gives every line's probability of good, the log partition of each chain, and expected moves (chains x 2 x 2)."""
    import numpy as np

    n, at = len(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    at, counts = at[order], sizes[order]
    longest = int(counts[0]) if n else 0
    e = np.exp(np.stack([np.zeros_like(good), np.clip(good, -40, 40)], 1))
    a, scale = np.empty((len(good), 2)), np.empty(len(good))
    first, trans = np.exp(start), np.exp(move)
    falling, live_at = -counts, []
    for t in range(longest):
        live = int(np.searchsorted(falling, -t, "left"))
        live_at.append(live)
        here = at[:live] + t
        f = (first if t == 0 else a[here - 1] @ trans) * e[here]
        s = f.sum(1)
        a[here], scale[here] = f / s[:, None], s
    b = np.ones((len(good), 2))
    moves = np.zeros((n, 2, 2))
    for t in range(longest - 1, 0, -1):
        here = at[: live_at[t]] + t
        right = e[here] * b[here] / scale[here][:, None]
        b[here - 1] = right @ trans.T
        moves[: live_at[t]] += a[here - 1][:, :, None] * trans * right[:, None, :]
    p = a * b
    p /= p.sum(1, keepdims=True)
    z = np.add.reduceat(np.log(scale), np.concatenate([[0], np.cumsum(sizes)[:-1]])) if n else np.zeros(0)
    back = np.empty_like(moves)
    back[order] = moves
    return p[:, 1], z, back


@dataclass
class Chain:
    """Weights of the field; score() gives a document's quality."""

    weights: list[float]
    start: list[float]
    move: list[list[float]]

    def scores(self, texts: list[str]) -> list[float]:
        import numpy as np

        got = [line_features(x) for x in texts]
        if not got:
            return []
        w, sizes = np.array(self.weights), np.array([len(x) for x, _ in got])
        odds = np.concatenate([with_neighbours(x) for x, _ in got]) @ w
        good, _, _ = forward_backward(odds, sizes, np.array(self.start), np.array(self.move))
        lengths, at = np.concatenate([n for _, n in got]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.clip(np.add.reduceat(good * lengths, at) / np.add.reduceat(lengths, at), 0, 1).tolist()


UNDECIDED = Chain([0.0] * WIDTH, [0.0, 0.0], [[0.0, 0.0], [0.0, 0.0]])


def fit(docs: list[tuple[list[list[float]], int, float]], steps: int = 150, ridge: float = 1e-3) -> Chain:
    """docs: features of lines, label, weight. Adam on the weighted conditional likelihood."""
    import numpy as np

    if len({y for _, y, _ in docs}) < 2:
        return UNDECIDED
    x = np.concatenate([with_neighbours(np.array(f)) for f, _, _ in docs])
    sizes = np.array([len(f) for f, _, _ in docs])
    y, weight = np.array([d[1] for d in docs]), np.array([d[2] for d in docs])
    weight = weight / weight.sum()
    lines_y, lines_w = np.repeat(y, sizes), np.repeat(weight, sizes)
    theta = np.zeros(WIDTH + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    stay = np.zeros((len(docs), 2, 2))
    stay[np.arange(len(docs)), y, y] = sizes - 1
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for t in range(1, steps + 1):
        p, _, moves = forward_backward(x @ theta[:WIDTH], sizes, theta[WIDTH : WIDTH + 2], theta[WIDTH + 2 :].reshape(2, 2))
        g = np.empty_like(theta)
        g[:WIDTH] = x.T @ (lines_w * (lines_y - p))
        d = weight * (y - p[firsts])
        g[WIDTH : WIDTH + 2] = [-d.sum(), d.sum()]
        g[WIDTH + 2 :] = ((stay - moves) * weight[:, None, None]).sum(0).ravel()
        g -= ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Chain(theta[:WIDTH].tolist(), theta[WIDTH : WIDTH + 2].tolist(), theta[WIDTH + 2 :].reshape(2, 2).tolist())


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> Chain:
    """Fit on documents of docs that labels know and that are not held out; at most `sample` of either class, whole."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    # Of the labelled documents only those that docs holds count and are sampled.
    known = cut(known.join(docs.select(F.col("doc_id").cast("long").alias("_d")), F.col("_id") == F.col("_d"), "left_semi"), "quality-known")
    shares = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    ids = cut(picked[0].unionByName(picked[1]), "quality-sample")  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(F.broadcast(ids), F.col("_d") == F.col("_id")).select("_d", "_y", "text")
    # Of several texts of one doc_id the one with the smallest hash, so that every fit sees the same.
    rows = rows.groupBy("_d", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def make():
        def run(keys, texts):
            return [keys[0], keys[1], [line_features(x)[0].tolist() for x in texts]]

        return run

    got = map_texts(rows, ["_d", "_y"], "text", "_d long, _y int, f array<array<double>>", make)
    best = sorted(((r["_d"], r["_y"], r["f"]) for r in got.collect()), key=lambda r: r[0])
    found = {c: sum(r[1] == c for r in best) for c in (0, 1)}
    return fit([(f, y, shares[y] / found[y]) for _, y, f in best])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, **options)

    def make():
        def run(keys, texts):
            s = model.scores(texts)
            return [keys[0], keys[1], s, [int(x >= threshold) for x in s]]

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(slim, ["doc_id", "held_out"], "text", "doc_id long, held_out boolean, score double, predicted int", make)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows whose score reaches the threshold, with the input's columns; scored in place, so no join is needed."""
    model = train(docs, labels, **options)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        lean()
        out, values = [], [x or "" for x in texts]
        for at in range(0, len(values), 512):
            out += [x >= threshold for x in model.scores(values[at : at + 512])]
        return pd.Series(out, dtype="boolean")

    small_batches(docs.sparkSession)
    return docs.where(good(F.col("text")))
