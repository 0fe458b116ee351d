"""Quality rules with risk-controlled thresholds.

Two base rules are fixed. The others compare a measure of the text with a cutoff that is chosen from labelled documents, per stratum
(language): of a fixed grid, a cutoff is admissible if an exact binomial test shows that it rejects less than
risk / rules of the stratum's good documents, at level delta / (strata * rules). A stricter cutoff never rejects less, so testing the
grid from loose to strict and stopping at the first failure keeps that level (fixed-sequence testing); over strata and rules
it is Bonferroni's correction, over rules the risks add up. So with probability 1 - delta no stratum loses more than `risk` of
its good documents to these rules. Of the admissible cutoffs the loosest is taken that rejects at least nine tenths of the labelled bad
documents that the strictest rejects.

Defined results: null and empty texts have no words and fail the base rules; a stratum with too few labels gets no cutoff and
keeps what passes the base rules; a null language is a stratum of its own; contradictory labels of a document count as the
lower one; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, map_texts, packed, small_batches

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Measures, higher is worse, and their cutoffs from loose to strict; what lies above a cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("try_divide(n_symbols, word_chars)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "repeats": ("try_divide(n_repeat_words, n_words)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "long_words": ("try_divide(word_chars, n_words)", [40, 30, 25, 20, 17, 15, 13, 12, 11, 10]),
    "short_words": ("-try_divide(word_chars, n_words)", [-1, -1.5, -2, -2.5, -3, -3.5, -4]),
}


def measures(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text."""
    b = text.encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    chars = len(text) - (len(b) - len(b.translate(None, SPACES)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        counts, end = Counter(triples), 0
        for i, t in enumerate(triples):
            if counts[t] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, h (tells texts apart) and the measures for every row."""

    def make():
        def run(keys, texts):
            return [*keys, *map(list, zip(*map(measures, texts), strict=True))] if texts else [*keys, *[[] for _ in MEASURES]]

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.xxhash64("text").alias("h"), "text")
    return map_texts(slim, ["doc_id", "stratum", "h"], "text", "doc_id long, stratum string, h long, " + ", ".join(f"{m} long" for m in MEASURES), make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def allowed(n: int, risk: float, level: float) -> int:
    """The most rejections of n good documents at which P(Binomial(n, risk) <= rejections) <= level; -1 if there are none."""
    if n <= 0:
        return -1
    total, k = 0.0, 0
    while k <= n:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > level:
            return k - 1
        k += 1
    return n


def choose(n: int, good: list[int], bad: list[int], grid: list[float], risk: float, level: float) -> float | None:
    """A cutoff of the grid (loose to strict) from the counts that each rejects; None if none is admissible."""
    most, passed = allowed(n, risk, level), 0
    while passed < len(grid) and good[passed] <= most:
        passed += 1
    if not passed:
        return None
    return next(c for c, b in zip(grid, bad, strict=False) if b >= 0.9 * bad[passed - 1])


def cutoffs(table: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum and one column c_<rule> (null: no cutoff) per rule. table: written measures."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    held = table.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    sums = [F.sum("_y").alias("n")]
    for rule, (measure, grid) in RULES.items():
        for name, y in (("good", 1), ("bad", 0)):
            sums.append(F.array(*[F.sum(((F.expr(measure) > c) & (F.col("_y") == y)).cast("long")) for c in grid]).alias(f"{name}_{rule}"))
    counts = cut(held.groupBy("stratum").agg(*sums), "rules-counts")
    strata = max(1, counts.count())
    level = delta / (strata * len(RULES))

    def pick(parts):
        import pandas as pd

        for part in parts:
            out = {"stratum": part["stratum"]}
            for rule, (_, grid) in RULES.items():
                out[f"c_{rule}"] = pd.Series([choose(int(n), list(g), list(b), grid, risk / len(RULES), level) for n, g, b in zip(part["n"], part[f"good_{rule}"], part[f"bad_{rule}"], strict=True)], dtype=float)
            yield pd.DataFrame(out)

    return cut(counts.mapInPandas(pick, "stratum string, " + ", ".join(f"c_{r} double" for r in RULES)), "rules-cutoffs")


def _kept(table: DataFrame, limits: DataFrame) -> DataFrame:
    """table (stratum and measures among its columns) with base_failed and kept. A cutoff of NaN or null is none."""
    names = table.columns
    got = table.join(limits.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    passed = F.lit(True)
    for rule, (measure, _) in RULES.items():
        passed = passed & (F.col(f"c_{rule}").isNull() | F.isnan(f"c_{rule}") | ~(F.expr(measure) > F.col(f"c_{rule}")))
    kept = F.when(base_failed(), F.lit(False)).otherwise(passed)
    return got.select(*names, base_failed().alias("base_failed"), F.coalesce(kept, F.lit(True)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, stratum, h, the measures, base_failed and kept for every row."""
    table = cut(measured(docs), "rules-measures")
    return _kept(table, cutoffs(table, labels, **options))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with the input's columns. Each text is measured once, and its row written beside its measures."""

    @F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
    def of(texts):
        import pandas as pd

        lean()
        return pd.DataFrame([measures(x or "") for x in texts], columns=MEASURES)

    small_batches(docs.sparkSession)
    rows = packed(docs).withColumn("_m", of(F.col("_row.text")))
    rows = cut(rows.select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.lang").cast("string").alias("stratum"), "_m.*"), "rules-rows")
    limits = cutoffs(rows.select("doc_id", "stratum", *MEASURES), labels, **options)
    return _kept(rows, limits).where("kept").select("_row.*")
