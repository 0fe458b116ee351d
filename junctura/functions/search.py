"""Places of the genome that short probes meet with few differences: seeds by pairs of blocks, then two-bit codes, a million characters at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CODE = np.zeros(256, np.uint8)
_CODE[list(b"CGT")] = 1, 2, 3
_KNOWN = np.zeros(256, bool)
_KNOWN[list(b"ACGTN")] = True
_OTHER_STRAND = np.arange(256, dtype=np.uint8)
_OTHER_STRAND[list(b"ACGT")] = list(b"TGCA")
_LOW = np.uint64(0x5555555555555555)
CHUNK, CANDIDATES = 1 << 20, 1 << 21


class _Codes:
    """Two-bit codes of the characters from each place on, any number of them up to 32, made of powers of two. Places near the end are filled up with A."""

    def __init__(self, text: np.ndarray):
        self.by = {1: np.concatenate([_CODE[text], np.zeros(64, np.uint8)]).astype(np.uint64)}
        for n in (1, 2, 4, 8, 16):
            self.by[2 * n] = (self.by[n] << np.uint64(2 * n)) | np.concatenate([self.by[n][n:], np.zeros(n, np.uint64)])

    def of(self, n: int, at: np.ndarray) -> np.ndarray:
        got, done = np.zeros(len(at), np.uint64), 0
        for bit in (32, 16, 8, 4, 2, 1):
            if n & bit:
                got = self.by[bit][at] if bit == 32 else (got << np.uint64(2 * bit)) | self.by[bit][at + done]
                done += bit
        return got


class Probes:
    """Distinct probes of n characters that may have `most` differences, both strands, indexed by pairs of their blocks.

    Of most + 2 disjoint blocks of a probe two are intact, so a place shares the key of a pair of blocks with it (the first six characters of a block, at most, stand for it). A place counts by the first two intact
    blocks. A table has four buckets a probe or a bucket a key."""

    def __init__(self, seqs: np.ndarray, most: int):
        """seqs: bytes, a row a probe."""
        self.count, self.n = seqs.shape
        self.most, n = most, self.n
        self.text = np.concatenate([seqs, _OTHER_STRAND[seqs][:, ::-1]])
        self.step = n // (most + 2)
        self.size, self.blocks = min(self.step, 6), most + 2 if self.step else 2
        codes, rows = _Codes(self.text.reshape(-1)), np.arange(len(self.text)) * n
        self.words = [codes.of(min(32, n - a), rows + a) for a in range(0, n, 32)]
        self.seeds = [codes.of(self.size, rows + x * self.step).astype(np.uint32) for x in range(self.blocks)]
        self.odd = ~_KNOWN[self.text].all(axis=1)
        self.bits = min(4 * self.size, int(len(rows)).bit_length() + 1)
        self.tables = []
        for i in range(self.blocks):
            for j in range(i + 1, self.blocks):
                bucket = self.bucket(self.seeds[i], self.seeds[j])
                begin = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << self.bits))]).astype(np.int32)
                self.tables.append((i, j, begin, begin[1:] > begin[:-1], np.argsort(bucket, kind="stable").astype(np.int32)))
        self.hits = np.zeros(self.count, np.int64)

    def bucket(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << np.uint32(2 * self.size)) | b
        return key if self.bits == 4 * self.size else (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def search(self, text: np.ndarray, codes: _Codes, bad: np.ndarray, odd: np.ndarray | None, begin: np.ndarray, end: np.ndarray, tile: int) -> None:
        """Adds the places of tiles [begin, end) of text. bad, odd: running counts of N and of other characters."""
        n = self.n
        size = np.maximum(np.minimum(end - n + 1, begin + tile) - begin, 0)
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        at = at[bad[at + n] == bad[at]]
        if not len(at):
            return
        words, seeds = [codes.of(min(32, n - a), at + a) for a in range(0, n, 32)], [codes.of(self.size, at + x * self.step).astype(np.uint32) for x in range(self.blocks)]
        for i, j, first, used, entries in self.tables:
            bucket = self.bucket(seeds[i], seeds[j])
            place = np.flatnonzero(used[bucket])
            bucket = bucket[place]
            low, some = first[bucket].astype(np.int64), first[bucket + np.uint32(1)] - first[bucket]
            so_far = np.cumsum(some, dtype=np.int64)
            done = 0
            while done < len(place):
                before = so_far[done - 1] if done else 0
                stop = max(int(np.searchsorted(so_far, before + CANDIDATES, "right")), done + 1)
                many, ahead = some[done:stop], so_far[done:stop] - some[done:stop] - before
                probe = entries[np.repeat(low[done:stop] - ahead, many) + np.arange(int(so_far[stop - 1] - before))]
                self.verify(text, at, words, seeds, odd, i, j, np.repeat(place[done:stop], many), probe)
                done = stop

    def verify(self, text, at, words, seeds, odd, i: int, j: int, place: np.ndarray, probe: np.ndarray) -> None:
        differ = np.zeros(len(place), np.uint8)
        for w, s in zip(words, self.words, strict=True):
            x = w[place] ^ s[probe]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & _LOW)
        near = np.flatnonzero(differ <= self.most)
        place, probe = place[near], probe[near]
        keep = np.ones(len(place), bool)
        for x in range(j + 1):
            keep &= (seeds[x][place] == self.seeds[x][probe]) == (x in (i, j))
        if self.odd.any() or odd is not None:
            # Codes tell only A, C, G and T apart; where there is anything else, characters decide.
            strange = self.odd[probe] if odd is None else self.odd[probe] | (odd[at[place] + self.n] > odd[at[place]])
            which = np.flatnonzero(strange)
            for a in range(0, len(which), 1 << 16):
                part = which[a : a + (1 << 16)]
                unlike = text[at[place[part]][:, None] + np.arange(self.n)] != self.text[probe[part]]
                good = unlike.sum(axis=1) <= self.most
                for x in range(j + 1):
                    good &= unlike[:, x * self.step : x * self.step + self.size].any(axis=1) != (x in (i, j))
                keep[part] = good
        self.hits += np.bincount(probe[keep] % self.count, minlength=self.count)


def place_counts(batches: Iterator, probes: list[tuple[int, np.ndarray]], tile: int, enough: int) -> Iterator:
    """Batches of tiles (seq, each with what follows it) -> seq, hits of the probes that are met among them, `enough` at most. probes: the differences allowed and the probes, bytes with a row a probe."""
    import pyarrow as pa

    groups = [Probes(seqs, most) for most, seqs in probes]
    for batch in batches:
        seqs = batch.column(0).drop_null().cast(pa.large_string())
        if any(b is None for b in seqs.buffers()[1:]):
            continue
        data, bounds = np.frombuffer(seqs.buffers()[2], np.uint8), np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
        if len(data) and data[bounds[0] : bounds[-1]].max(initial=0) > 127:
            texts = [x.encode("latin-1", "replace") for x in seqs.to_pylist()]
            data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        done = 0
        while done < len(bounds) - 1:
            stop = max(int(np.searchsorted(bounds, bounds[done] + CHUNK, "right")) - 1, done + 1)
            text, ends = data[bounds[done] : bounds[stop]], bounds[done : stop + 1] - bounds[done]
            runs = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            strange = ~_KNOWN[text]
            codes, bad, odd = _Codes(text), runs(text == ord("N")), runs(strange) if strange.any() else None
            for group in groups:
                group.search(text, codes, bad, odd, ends[:-1], ends[1:], tile)
            done = stop
    for group in groups:
        met = np.flatnonzero(group.hits)
        for a in range(0, len(met), 10_000):
            part = met[a : a + 10_000]
            names = [row.tobytes().decode("latin-1") for row in group.text[part]]
            yield pa.RecordBatch.from_pydict({"seq": pa.array(names, pa.string()), "hits": pa.array(np.minimum(group.hits[part], enough), pa.int64())})
