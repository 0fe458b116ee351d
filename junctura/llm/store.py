"""Token ids as binary shards with a minimal perfect hash index: constant-time keyed access over raw id payloads.

Rows are range-partitioned by doc_id; each task streams its rows, in order, into one shard file:

    payload | starts u64[docs + 1] | first u32[keys] | run u32[keys] | mark u32[keys] | keys i64[keys] | bits u64[words] | ranks u32[words] | footer JSON | u64 size | b"JTOK1"

The payload is the ids of all documents, little-endian, two bytes each where the vocabulary allows. `first` and `run` are a key's first document and
its number of documents, `mark` a fingerprint of the key, all at the key's slot of the hash function; `bits` are the function's
levels (a key's slot is the number of set bits before its own). Levels after the first take the keys that collided.
A task's file has a name of its own and counts only once its row of the manifest is committed, so lost tasks and executors cost
a rerun of that task and nothing else.

Defined results: a null text is the end id alone; a null doc_id comes first, under the key null; rows of equal doc_id are one run, in the order of
their text's hash; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_ids, cut, encoder, fresh_path, small_batches, tokenizer_path

MAGIC = b"JTOK1"
GAMMA, LEVELS = 2.0, 48
MANIFEST = "part int, path string, docs long, tokens long, low long, high long, nulls long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def mixed(keys, seed: int):
    """64-bit hashes of 64-bit keys (splitmix finaliser)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Perfect:
    """Minimal perfect hash function of distinct 64-bit keys: levels of bit arrays, ranks for the slots."""

    def __init__(self, sizes: list[int], bits, ranks):
        import numpy as np

        self.np, self.sizes, self.bits, self.ranks = np, sizes, bits, ranks
        self.at = [0]
        for s in sizes:
            self.at.append(self.at[-1] + s)

    @classmethod
    def build(cls, keys) -> Perfect:
        import numpy as np

        left, sizes, parts = keys, [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = (int(len(left) * GAMMA) // 64 + 1) * 64
            h = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(h, minlength=size)
            parts.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[counts[h] > 1]
        bits = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ones = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, (np.cumsum(ones) - ones).astype("<u4"))

    def slots(self, keys):
        """The slot of each key; -1 where no level has its bit (a key that isn't there may also get a slot)."""
        np = self.np
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            h = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.at[level]
            word, bit = self.bits[h >> 6], (h & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[h >> 6].astype(np.int64) + below)[hit]
            left = left[~hit]
        return out


class ShardWriter:
    def __init__(self, folder: str, part: int, width: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
        self.path, self.width = f"{folder}/{self.name}", width
        self.out, self.tokens, self.sizes, self.keys, self.runs, self.nulls = self.fs.open_output_stream(f"{base}/{self.name}"), 0, [], [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        """Rows come with keys in order, null first."""
        self.out.write(ids)
        self.sizes.append(len(ids) // self.width)
        if key is None:
            self.nulls += 1
        elif self.keys and self.keys[-1] == key:
            self.runs[-1] += 1
        else:
            self.keys.append(key)
            self.runs.append(1)

    def close(self) -> tuple:
        import numpy as np

        keys, runs = np.array(self.keys, "<i8"), np.array(self.runs, "<u4")
        starts = np.concatenate([[0], np.cumsum(np.array(self.sizes, "<u8"))]).astype("<u8")
        function = Perfect.build(keys)
        slots = function.slots(keys)
        first, run, mark = (np.zeros(len(keys), "<u4") for _ in range(3))
        first[slots] = self.nulls + np.cumsum(runs) - runs
        run[slots], mark[slots] = runs, mixed(keys, 1 << 20).astype("<u4")
        at, sections = int(starts[-1]) * self.width, {}
        for name, data in (("starts", starts), ("first", first), ("run", run), ("mark", mark), ("keys", keys), ("bits", function.bits), ("ranks", function.ranks)):
            self.out.write(data.tobytes())
            sections[name] = [at, data.nbytes, data.dtype.str]
            at += data.nbytes
        footer = json.dumps({"width": self.width, "nulls": self.nulls, "levels": function.sizes, "sections": sections}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.path, len(self.sizes), int(starts[-1]), *((self.keys[0], self.keys[-1]) if self.keys else (None, None)), self.nulls


class Shard:
    """An open shard file."""

    def __init__(self, uri: str):
        import numpy as np

        self.np = np
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(n, size - 8 - len(MAGIC) - n))
        self.width, self.nulls, s = footer["width"], footer["nulls"], footer["sections"]
        got = {k: np.frombuffer(self.file.read_at(b, a), d) for k, (a, b, d) in s.items()}
        self.starts, self.first, self.run, self.mark, self.keys = (got[k] for k in ("starts", "first", "run", "mark", "keys"))
        self.function = Perfect(footer["levels"], got["bits"], got["ranks"])

    def find(self, keys):
        """Slots of keys, -1 for those that are not there."""
        np = self.np
        slots = self.function.slots(keys)
        slots[(slots >= 0) & (self.mark[np.maximum(slots, 0)] != mixed(keys, 1 << 20).astype("<u4"))] = -1
        return slots

    def ids(self, doc: int):
        a, b = int(self.starts[doc]) * self.width, int(self.starts[doc + 1]) * self.width
        return self.np.frombuffer(self.file.read_at(b - a, a), f"<u{self.width}")

    def documents(self, block: int = 4 << 20) -> Iterator[list[tuple[int | None, int, int, int]]]:
        """Lists of key, start, tokens, checksum of every document, each found by its key through the hash function; payloads come in reads of about `block` bytes."""
        np = self.np
        slots = self.find(self.keys)
        if (slots < 0).any():
            raise ValueError("a key is not in its index")
        run = self.run[slots].astype(np.int64)
        docs = np.repeat(self.first[slots].astype(np.int64) - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        docs = np.concatenate([np.arange(self.nulls), docs])
        keys = [None] * self.nulls + np.repeat(self.keys, run).tolist()
        begin, end = self.starts[docs].astype(np.int64), self.starts[docs + 1].astype(np.int64)
        at = 0
        while at < len(docs):
            # Documents that lie end to end are read together.
            far = int(np.searchsorted(end, begin[at] + block // self.width, "right"))
            gaps = np.flatnonzero(begin[at + 1 : far] != end[at : max(at, far - 1)])
            to = max(at + 1, at + 1 + int(gaps[0]) if len(gaps) else far)
            a, z = int(begin[at]) * self.width, int(end[to - 1]) * self.width
            data, base = self.np.frombuffer(self.file.read_at(z - a, a), f"<u{self.width}"), int(begin[at])
            yield [(k, x, y - x, crc_ids(data[x - base : y - base])) for k, x, y in zip(keys[at:to], begin[at:to].tolist(), end[at:to].tolist(), strict=True)]
            at = to


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = 1, kind: str = "word") -> DataFrame:
    """Tokenise and write all rows; gives the manifest (one row a shard), itself written. Executors write to `folder`, which all must reach."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, file = folder or fresh_path(spark, "tokens"), path or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        encode = encoder(file, kind)
        last = end.to_bytes(encode.width, "little")
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, found in encode.slices(b.column(1)):
                out = out or ShardWriter(folder, part, encode.width)
                for key, ids in zip(keys[at : at + len(found)], found, strict=True):
                    out.add(key, ids.tobytes() + last)
        if out:
            name, n, tokens, low, high, nulls = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (n, pa.int64()), (tokens, pa.int64()), (low, pa.int64()), (high, pa.int64()), (nulls, pa.int64()))], names=["part", "path", "docs", "tokens", "low", "high", "nulls"])

    return cut(rows.mapInArrow(run, MANIFEST), "tokens-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files, a task a shard; start counts the ids of all documents before it."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))  # a row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for got in Shard(path).documents():
                    key, start, n, crc = (pa.array(c, pa.int64()) for c in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([key, pa.array([x + before for x in start.to_pylist()], pa.int64()), n, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A number of partitions that is given isn't coalesced.
    return shards.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenStore:
    """Keyed access from the driver: the shard by bisection of the manifest, the document by its shard's hash function."""

    def __init__(self, manifest: DataFrame):
        self.rows = [r for r in manifest.orderBy("part").collect() if r["low"] is not None]
        self.lows, self.open = [r["low"] for r in self.rows], {}

    def get(self, key: int) -> list:
        """The ids of each document with this key; none: an empty list."""
        import numpy as np

        out, i = [], bisect_right(self.lows, key) - 1
        while i >= 0 and self.rows[i]["high"] >= key:
            path = self.rows[i]["path"]
            shard = self.open.get(path) or self.open.setdefault(path, Shard(path))
            slot = int(shard.find(np.array([key], "<i8"))[0])
            if slot >= 0:
                out = [shard.ids(d) for d in range(int(shard.first[slot]), int(shard.first[slot]) + int(shard.run[slot]))] + out
            i -= 1
        return out


def write_and_read(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    return read(write(docs, **options))
