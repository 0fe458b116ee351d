"""Local alignment of the two flanks of a junction: affine-gap Smith-Waterman, a batch of pairs at a time over anti-diagonals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import DEFAULT, Params

HIT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("r_st", "r_en", "q_st", "q_en", "score", "mlen")] + [T.StructField("cigar", T.StringType())])


def batch(refs: list[str], queries: list[str], params: Params = DEFAULT) -> list[tuple | None]:
    """The best hit (r_st, r_en, q_st, q_en, score, mlen, cigar) of each pair, or None. Pairs of equal lengths run together."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (r, q) in enumerate(zip(refs, queries, strict=True)):
        if r and q:
            groups.setdefault((len(r), len(q)), []).append(i)
    out: list[tuple | None] = [None] * len(refs)
    for (m, n), at in groups.items():
        for i, hit in zip(at, _same_size([refs[i] for i in at], [queries[i] for i in at], m, n, params), strict=True):
            out[i] = hit
    return out


def _same_size(refs: list[str], queries: list[str], m: int, n: int, p: Params) -> list[tuple | None]:
    import numpy as np

    s, pairs = p.scoring, len(refs)
    r = np.array([np.frombuffer(x.upper().encode("latin-1", "replace"), np.uint8) for x in refs])
    q = np.array([np.frombuffer(x.upper().encode("latin-1", "replace"), np.uint8) for x in queries])
    unknown = ord("N")
    first, more, low = s.gap_open + s.gap_extend, s.gap_extend, -1_000_000
    # h[d][:, i] is the cell (i, d - i); e: gap along the reference row, f: gap along the query column.
    shape = (m + n + 1, pairs, m + 1)
    h, e, f, sub = np.zeros(shape, np.int32), np.full(shape, low, np.int32), np.full(shape, low, np.int32), np.zeros(shape, np.int32)
    for d in range(2, m + n + 1):
        a, b = max(1, d - n), min(m, d - 1)
        if a > b:
            continue
        i = np.arange(a, b + 1)
        x, y = r[:, i - 1], q[:, d - i - 1]
        score = np.where((x == unknown) | (y == unknown), -s.ambiguous, np.where(x == y, s.match, -s.mismatch))
        sub[d][:, a : b + 1] = score
        e[d][:, a : b + 1] = np.maximum(e[d - 1][:, a : b + 1] - more, h[d - 1][:, a : b + 1] - first)
        f[d][:, a : b + 1] = np.maximum(f[d - 1][:, a - 1 : b] - more, h[d - 1][:, a - 1 : b] - first)
        h[d][:, a : b + 1] = np.maximum(np.maximum(h[d - 2][:, a - 1 : b] + score, 0), np.maximum(e[d][:, a : b + 1], f[d][:, a : b + 1]))
    best = h.max(axis=(0, 2))
    # The first maximum in row-major order: the smallest i, then the smallest j.
    dd, ii = np.arange(m + n + 1)[:, None, None], np.arange(m + 1)[None, None, :]
    place = np.where(h == best[None, :, None], ii * (n + 1) + (dd - ii), np.iinfo(np.int64).max).min(axis=(0, 2))
    i_end, j_end = place // (n + 1), place % (n + 1)
    i, j, every = i_end.copy(), j_end.copy(), np.arange(pairs)
    ops = np.zeros((pairs, m + n), np.uint8)
    live = best > 0
    for t in range(m + n):
        d = i + j
        now = h[d, every, i]
        live &= (i > 0) & (j > 0) & (now > 0)
        if not live.any():
            break
        diagonal = live & (now == h[np.maximum(d - 2, 0), every, np.maximum(i - 1, 0)] + sub[d, every, i])
        left = live & ~diagonal & (now == e[d, every, i])
        up = live & ~diagonal & ~left & (now == f[d, every, i])
        live = diagonal | left | up
        ops[:, t] = np.where(diagonal, ord("M"), np.where(left, ord("I"), np.where(up, ord("D"), 0)))
        i, j = i - (diagonal | up), j - (diagonal | left)
    out: list[tuple | None] = []
    for k in range(pairs):
        span = min(int(i_end[k] - i[k]), int(j_end[k] - j[k]))
        if best[k] < p.min_score or span < p.min_span:
            out.append(None)
            continue
        out.append((int(i[k]), int(i_end[k]), int(j[k]), int(j_end[k]), int(best[k]), span, runs(bytes(ops[k]).rstrip(b"\0")[::-1].decode())))
    return out


def runs(ops: str) -> str:
    """MMMI to 3M1I."""
    from itertools import groupby

    return "".join(f"{len(list(g))}{op}" for op, g in groupby(ops))


def align(ref: Column, query: Column, params: Params = DEFAULT) -> Column:
    """The hit of each row as a struct, null where there is none."""

    @F.pandas_udf(HIT)
    def run(a, b):
        import pandas as pd

        hits: list = []
        refs, queries = [x or "" for x in a], [x or "" for x in b]
        for at in range(0, len(refs), 512):
            hits += batch(refs[at : at + 512], queries[at : at + 512], params)
        names = HIT.fieldNames()
        return pd.DataFrame({n: pd.Series([None if x is None else x[k] for x in hits], dtype=object if n == "cigar" else "Int32") for k, n in enumerate(names)})

    hit = run(ref, query)
    return F.when(hit["score"].isNotNull(), hit)
