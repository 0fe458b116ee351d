"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical form of a url, "." + host + boundary + path, where the boundary is a symbol that no url
contains. All globs are packed into multiword Shift-And masks: bit k of a pattern is "k symbols matched", a star is a
bit that stays set on any symbol, and one step over one symbol advances all patterns of all urls of a batch. At the end
the longest accepted rule decides.

Defined results: a null url or one without "://" has an empty host and path and fits no rule; a url that no rule fits gets
the default verdict; rules of equal length are tried in code point order; rows alike give rows alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, packed

BOUNDARY = -1


class Rule(NamedTuple):
    verdict: str
    rule: str  # host and path, as "example.com/en/"

    def glob(self) -> list:
        """Symbols of the rule's pattern; "*" and "?" as one-element lists are wildcards."""
        host, slash, path = self.rule.partition("/")
        return [["*"], *f".{host}", BOUNDARY, *wild(slash + path), ["*"]]


def wild(text: str) -> list:
    """"*" and "?" of a path are wildcards."""
    return [[c] if c in "*?" else c for c in text]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


class Automaton:
    """Globs (lists of characters, BOUNDARY, ["*"], ["?"]) packed into 64-bit words."""

    def __init__(self, globs: list[list]):
        import numpy as np

        self.np, at = np, 0
        start, stay, self.final = [], [], []
        symbols: dict = {}
        takes: list[tuple[object, int]] = []
        for glob in globs:
            start.append(at)
            for token in glob:
                if token == ["*"]:
                    stay.append(at)
                else:
                    at += 1
                    takes.append((None if token == ["?"] else token, at))
                    if token != ["?"]:
                        symbols.setdefault(token, len(symbols) + 1)  # 0: any other symbol
            self.final.append(at)
            at += 1
        words = at // 64 + 1
        self.symbols, self.words = symbols, words
        self.start, self.stay, self.mask = np.zeros(words, np.uint64), np.zeros(words, np.uint64), np.zeros((len(symbols) + 1, words), np.uint64)
        for bits, into in ((start, self.start), (stay, self.stay)):
            for b in bits:
                into[b // 64] |= np.uint64(1 << b % 64)
        for token, b in takes:
            rows = range(len(symbols) + 1) if token is None else [symbols[token]]
            for r in rows:
                self.mask[r, b // 64] |= np.uint64(1 << b % 64)

    def accepted(self, texts: list[list]):
        """A row for each text, a column for each glob."""
        np = self.np
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.start, (len(texts), 1))
        symbol, one, top = self.symbols, np.uint64(1), np.uint64(63)
        coded = [np.fromiter((symbol.get(c, 0) for c in texts[i]), np.int32, len(texts[i])) for i in order]
        falling = -sizes[order]
        longest = int(sizes.max(initial=0))
        for at in range(longest):
            live = int(np.searchsorted(falling, -at, "left"))  # texts longer than `at` come first
            now = state[:live]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            step = self.mask[np.fromiter((c[at] for c in coded[:live]), np.int32, live)]
            state[:live] = (moved & step) | (now & self.stay)
        back = np.empty_like(state)
        back[order] = state
        final = np.array(self.final, np.int64)
        return (back[:, final // 64] >> (final % 64).astype(np.uint64)) & one != 0


class Judge:
    """Rules, longest first (ties in code point order), over hosts and paths. The automaton is built where it is first used."""

    def __init__(self, rules: Iterable[Rule], default: str):
        self.ranked, self.default, self.machine = sorted((Rule(*r) for r in rules), key=lambda r: (-len(r.rule), r.rule)), default, None

    def __call__(self, hosts: list[str], paths: list[str]) -> list[Rule | None]:
        """The rule that decides each url; None where none fits."""
        if not self.ranked:
            return [None] * len(hosts)
        if self.machine is None:
            self.machine = Automaton([r.glob() for r in self.ranked])
        fits = self.machine.accepted([[".", *h, BOUNDARY, *p] for h, p in zip(hosts, paths, strict=True)])
        return [self.ranked[i] if found else None for i, found in zip(fits.argmax(axis=1).tolist(), fits.any(axis=1).tolist(), strict=True)]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path of a column's urls."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow", key: str = "page_id", url: str = "url", rows: int = 4096) -> DataFrame:
    """key, host, path, rule (null if none fits), verdict for every row."""
    decide = Judge(rules, default)
    host, path = host_and_path("_url")
    slim = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("_url")).select(F.col(key), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                found = decide(part.column(1).to_pylist(), part.column(2).to_pylist())
                said = [pa.array([r and r.rule for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *said], names=[key, "host", "path", "rule", "verdict"])

    return slim.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string")


def keep_pages(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow") -> DataFrame:
    """The pages that are not blocked, with the input's columns; the verdict is computed per row, so no join is needed."""
    decide = Judge(rules, default)

    @F.pandas_udf("boolean")
    def blocked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series([(r.verdict if r else default) == "block" for r in decide(hosts.tolist(), paths.tolist())], dtype="boolean")

    host, path = host_and_path("_url")
    got = packed(pages).withColumn("_url", F.coalesce(F.col("_row.url"), F.lit("")))
    return got.where(~blocked(host, path)).select("_row.*")
