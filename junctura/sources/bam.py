"""BAM files as a Python data source: `spark.read.format("bam")`, and a writer of one BAM file from many tasks.

BGZF is concatenated gzip members, decoded block by block, so that a task's memory doesn't grow with the file. A record's `file_ord` is its virtual
offset (place of its block in the file, then place in the block), which grows along the file wherever reading begins. Files with an index are split
at its offsets and read from where a region begins; others are one partition. A file that doesn't end as BGZF files do is an error."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "sample string, file_ord long, qname string, flag int, tid int, chrom string, pos long, mapq int, mtid int, mpos long, tlen long, cigar string, xs string, nh int, yc int, seq string, qual binary, tags binary"
# Fixed values of the public format.
OPS, BASES = "MIDNSHP=XB", "=ACMGRSVTWYHKDBN"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Tag types of fixed size, as struct codes.
_FIXED = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_HEAD = struct.Struct("<iiBBHHHiiii")
_PAIRS = [BASES[x >> 4] + BASES[x & 15] for x in range(256)]
#: Bases of a window of an index's offsets, as a power of two.
WINDOW = 14


def opened(path: str):
    """A file that can be read and sought: local paths, and URIs that Arrow's file systems know."""
    if "://" in path:
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(path)
        return files.open_input_file(inner)
    return open(path, "rb")


class Stream:
    """Bytes of a BGZF file from a virtual offset on; `at` is the virtual offset of what comes next."""

    def __init__(self, file, at: int = 0):
        self.file, self.block, self.data, self.i = file, at >> 16, b"", 0
        file.seek(0, 2)
        self.end = file.tell()
        file.seek(max(0, self.end - len(EOF)))
        if file.read(len(EOF)) != EOF:
            raise ValueError("the BAM file is cut off: its end-of-file block is missing")
        file.seek(self.block)
        self.next = self.block
        if at & 0xFFFF:
            self._fill()
            self.i = at & 0xFFFF

    def _fill(self) -> bool:
        """The next block that holds something; False at the end."""
        while self.next < self.end:
            self.block = self.next
            head = self.file.read(12)
            if head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError("no BGZF block")
            extra, size, k = self.file.read(struct.unpack_from("<H", head, 10)[0]), None, 0
            while k + 4 <= len(extra):
                n = struct.unpack_from("<H", extra, k + 2)[0]
                if extra[k : k + 2] == b"BC":
                    size = struct.unpack_from("<H", extra, k + 4)[0] + 1
                k += 4 + n
            if size is None:
                raise ValueError("no BGZF block")
            body = self.file.read(size - 12 - len(extra))
            self.data, self.i, self.next = zlib.decompress(body[:-8], -15), 0, self.block + size
            if self.data:
                return True
        self.data, self.i, self.block = b"", 0, self.end
        return False

    @property
    def at(self) -> int:
        if self.i == len(self.data):
            self._fill()
        return self.block << 16 | self.i

    def take(self, n: int) -> bytes:
        """n bytes; fewer than n is an error, but for none at the end of the file."""
        got = self.data[self.i : self.i + n]
        self.i += len(got)
        if len(got) == n:
            return got
        parts, left = [got], n - len(got)
        while left and self._fill():
            got = self.data[:left]
            self.i = len(got)
            parts.append(got)
            left -= len(got)
        if 0 < left < n:
            raise ValueError("a record is cut off")
        return b"".join(parts)

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def tag_items(tags: bytes) -> Iterator[tuple[bytes, int, int, object]]:
    """name, start, end and value (None for arrays) of every tag of a record."""
    at = 0
    while at + 3 <= len(tags):
        start, kind = at, chr(tags[at + 2])
        at += 3
        if kind in _FIXED:
            code = "<" + _FIXED[kind]
            value, at = struct.unpack_from(code, tags, at)[0], at + struct.calcsize(code)
            value = value.decode("latin-1") if kind == "A" else value
        elif kind in "ZH":
            end = tags.index(b"\0", at)
            value, at = tags[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            value, at = None, at + 5 + struct.unpack_from("<i", tags, at + 1)[0] * struct.calcsize("<" + _FIXED[chr(tags[at])])
        else:
            raise ValueError(f"unknown tag type {kind}")
        yield tags[start : start + 2], start, at, value


def header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    return text, [(stream.take(stream.number())[:-1].decode(), stream.number()) for _ in range(stream.number())]


def records(path: str, sample: str, begin: int = 0, end: int | None = None, region: tuple[str, int] | None = None) -> Iterator[tuple]:
    """Records that begin in [begin, end) (virtual offsets). region: a contig and a position; of a sorted file, reading ends at the contig's first record there or beyond."""
    if end is not None and begin >= end:
        return
    with opened(path) as file:
        stream = Stream(file)
        contigs = [name for name, _ in header(stream)[1]]
        if begin > stream.at:
            stream = Stream(file, begin)
        stop = (contigs.index(region[0]) if region[0] in contigs else -1, region[1]) if region else None
        while end is None or stream.at < end:
            order, size = stream.at, stream.take(4)
            if not size:
                return
            b = stream.take(struct.unpack("<i", size)[0])
            tid, pos, n_name, mapq, _, n_ops, flag, n_seq, mtid, mpos, tlen = _HEAD.unpack_from(b)
            if stop and (tid > stop[0] or tid < 0 or (tid == stop[0] and pos >= stop[1])):
                return
            at = 32 + n_name
            cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", b, at)) or "*"
            at += 4 * n_ops
            half = (n_seq + 1) // 2
            seq, at = "".join(map(_PAIRS.__getitem__, b[at : at + half]))[:n_seq], at + half
            tags, found = b[at + n_seq :], {}
            for name, _, _, value in tag_items(tags):
                if name in (b"XS", b"NH", b"YC"):
                    found[name] = value
            yield (sample, order, b[32 : 32 + n_name - 1].decode(), flag, tid, contigs[tid] if tid >= 0 else None, pos, mapq, mtid, mpos, tlen, cigar, found.get(b"XS"), found.get(b"NH"), found.get(b"YC"), seq, b[at : at + n_seq], tags)


def index_path(path: str) -> str | None:
    """The file's index, if there is one."""
    for candidate in (path + ".bai", re.sub(r"\.bam$", ".bai", path)):
        if candidate != path:
            try:
                with opened(candidate):
                    return candidate
            except OSError:
                pass
    return None


def read_index(path: str) -> list[list[int]]:
    """For each contig the virtual offset of the first record that reaches into each window (0: none)."""
    with opened(path) as f:
        if f.read(4) != b"BAI\1":
            raise ValueError("no BAM index")
        contigs = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            for _ in range(struct.unpack("<i", f.read(4))[0]):
                _, chunks = struct.unpack("<Ii", f.read(8))
                f.read(16 * chunks)
            n = struct.unpack("<i", f.read(4))[0]
            contigs.append(list(struct.unpack(f"<{n}Q", f.read(8 * n))))
        return contigs


def span(cigar: str) -> int:
    """Reference bases of a CIGAR, one at least."""
    return max(1, sum(int(n) for n, op in re.findall(r"([0-9]+)([MIDNSHP=XB])", cigar) if op in "MDN=X"))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the public binning scheme that holds [start, end)."""
    end -= 1
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if start >> shift == end >> shift:
            return ((1 << 3 * (5 - level)) - 1) // 7 + (start >> shift)
    return 0


def write_index(path: str) -> str:
    """Index a sorted file beside it: bins of chunks, and the offsets that reading needs."""
    with opened(path) as file:
        stream = Stream(file)
        contigs = header(stream)[1]
        first, rows = stream.at, list(_offsets(path))
    bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
    linear: list[list[int]] = [[] for _ in contigs]
    for (at, tid, pos, length), after in zip(rows, [*(r[0] for r in rows[1:]), None], strict=True):
        if tid < 0:
            continue
        chunks = bins[tid].setdefault(_bin(pos, pos + length), [])
        until = after if after is not None else at + 1
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = until
        else:
            chunks.append([at, until])
        for w in range(pos >> WINDOW, (pos + length - 1 >> WINDOW) + 1):
            linear[tid] += [0] * (w + 1 - len(linear[tid]))
            linear[tid][w] = linear[tid][w] or at
    assert first >= 0
    with open(path + ".bai", "wb") as out:
        out.write(b"BAI\1" + struct.pack("<i", len(contigs)))
        for own, offsets in zip(bins, linear, strict=True):
            out.write(struct.pack("<i", len(own)))
            for number, chunks in sorted(own.items()):
                out.write(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.write(struct.pack("<i", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets))
    return path + ".bai"


def _offsets(path: str) -> Iterator[tuple[int, int, int, int]]:
    for r in records(path, ""):
        yield r[1], r[4], r[6], span(r[11])


def with_nh(tags: bytes, value: int) -> bytes:
    new = b"NHi" + struct.pack("<i", value)
    for name, start, end, _ in tag_items(tags):
        if name == b"NH":
            return tags[:start] + new + tags[end:]
    return tags + new


def pack_record(row: dict) -> bytes:
    """A row of SCHEMA as a BAM record; NH is rewritten if the row's differs."""
    name = row["qname"].encode() + b"\0"
    ops = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=XB])", row["cigar"] or "")]
    seq = row["seq"] or ""
    codes = [max(0, BASES.find(c)) for c in seq.upper()] + [0] * (len(seq) % 2)
    tags = bytes(row["tags"] or b"")
    if row["nh"] is not None and next((v for t, _, _, v in tag_items(tags) if t == b"NH"), None) != row["nh"]:
        tags = with_nh(tags, row["nh"])
    place = _bin(row["pos"], row["pos"] + span(row["cigar"] or "")) if row["pos"] >= 0 else 4680
    body = _HEAD.pack(row["tid"], row["pos"], len(name), row["mapq"], place, len(ops), row["flag"], len(seq), row["mtid"], row["mpos"], row["tlen"])
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(row["qual"] or b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def text_tags(text: str) -> bytes:
    """A SAM line's tags, joined by tabs, as a BAM record has them."""
    out = b""
    for field in filter(None, text.split("\t")):
        name, kind, value = field.split(":", 2)
        out += name.encode()
        if kind == "A":
            out += b"A" + value[:1].encode()
        elif kind == "i":
            out += (b"i" + struct.pack("<i", int(value))) if int(value) < 1 << 31 else (b"I" + struct.pack("<I", int(value)))
        elif kind == "f":
            out += b"f" + struct.pack("<f", float(value))
        elif kind == "B":
            sub, *items = value.split(",")
            out += b"B" + sub.encode() + struct.pack("<i", len(items)) + struct.pack(f"<{len(items)}{_FIXED[sub]}", *[(float if sub == "f" else int)(x) for x in items])
        else:
            out += kind.encode() + value.encode() + b"\0"
    return out


def packed_tags(text: Column) -> Column:
    """Tags of SAM lines as bytes; computed only where they are written."""

    @F.pandas_udf("binary")
    def pack(lines):
        return lines.map(lambda x: text_tags(x or ""))

    return pack(text)


def packed_quality(text: Column) -> Column:
    """Base qualities of SAM lines as bytes; null where there are none."""

    @F.pandas_udf("binary")
    def pack(lines):
        return lines.map(lambda x: None if x in (None, "*") else bytes(ord(c) - 33 for c in x))

    return pack(text)


def bgzf(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str, contigs: list[tuple[str, int]]) -> bytes:
    head = text.encode()
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(contigs))
    for name, length in contigs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return data


def write_blocks(out, parts: Iterator[bytes], size: int = 60_000) -> int:
    """Bytes as BGZF blocks without an end; gives the number of parts."""
    data, n = bytearray(), 0
    for part in parts:
        data += part
        n += 1
        while len(data) >= size:
            out.write(bgzf(bytes(data[:size])))
            del data[:size]
    if data:
        out.write(bgzf(bytes(data)))
    return n


def write_bam(path: str, text: str, contigs: list[tuple[str, int]], rows) -> int:
    """Stream rows (dicts of SCHEMA, in order) to one file; gives their number."""
    with open(path, "wb") as out:
        write_blocks(out, iter([header_bytes(text, contigs)]))
        n = write_blocks(out, map(pack_record, rows))
        out.write(EOF)
    return n


class BamPartition(InputPartition):
    def __init__(self, path: str, begin: int = 0, end: int | None = None, region: tuple[str, int] | None = None):
        self.path, self.begin, self.end, self.region = path, begin, end, region


class BamReader(DataSourceReader):
    """Options: paths (JSON), split (bytes of a partition of an indexed file), region ("chrom:start-end", 1-based, inclusive: all its reads are among those given)."""

    def __init__(self, options: dict):
        import json

        given = options.get("path") or options.get("paths")
        self.paths = json.loads(given) if given.startswith("[") else [given]
        self.split = int(options.get("split", 64 << 20))
        m = re.fullmatch(r"([^:]+):([0-9]+)-([0-9]+)", options.get("region") or "")
        self.chrom, self.start, self.stop = (m[1], int(m[2]) - 1, int(m[3])) if m else (None, 0, None)

    def pushFilters(self, filters):
        """A contig and an upper limit of the position let indexed files be read in part; Spark filters again."""
        for f in filters:
            kind, column = type(f).__name__, ".".join(getattr(f, "attribute", ()))
            if kind == "EqualTo" and column == "chrom" and self.chrom in (None, f.value):
                self.chrom = f.value
            elif kind in ("LessThan", "LessThanOrEqual") and column == "pos":
                self.stop = min(f.value + (kind == "LessThanOrEqual"), self.stop if self.stop is not None else 1 << 62)
        return filters

    def partitions(self):
        return [p for path in self.paths for p in self._parts(path)]

    def _parts(self, path: str) -> list[BamPartition]:
        index = index_path(path)
        if index is None:
            return [BamPartition(path)]
        offsets = read_index(index)
        region, low = None, 0
        if self.chrom is not None:
            with opened(path) as f:
                names = [name for name, _ in header(Stream(f))[1]]
            own = offsets[names.index(self.chrom)] if self.chrom in names else []
            reach = [x for x in own[self.start >> WINDOW :] if x] if own else []
            if not reach:
                return [BamPartition(path, 1 << 62, 0)]
            region, low = (self.chrom, self.stop if self.stop is not None else 1 << 62), reach[0]
            every = sorted({x for x in own if x > low})
        else:
            every = sorted({x for own in offsets for x in own if x})
        cuts = [low]
        for x in every:
            if (x >> 16) - (cuts[-1] >> 16) >= self.split:
                cuts.append(x)
        return [BamPartition(path, a, z, region) for a, z in zip(cuts, [*cuts[1:], None], strict=True)]

    def read(self, partition):
        import pyarrow as pa

        from junctura.naming import sample_name

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        names, rows = [x.split()[0] for x in SCHEMA.split(", ")], []
        for r in records(partition.path, sample_name(partition.path), partition.begin, partition.end, partition.region):
            rows.append(r)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Part(WriterCommitMessage):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class BamWriter(DataSourceWriter):
    """Each task writes its records as blocks to a part of its own beside the target; once all are there, the parts of the tasks that count are laid end to end, in order, into the file. Options: path, header, contigs (JSON)."""

    def __init__(self, options: dict, overwrite: bool):
        import os

        self.options, self.path = dict(options), options["path"]
        self.parts = self.path + ".parts"
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")

    def write(self, rows) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        path = f"{self.parts}/{context.partitionId():06d}-{context.taskAttemptId()}"
        with open(path, "wb") as out:
            write_blocks(out, (pack_record(r.asDict()) for r in rows))
        return Part(context.partitionId(), path)

    def commit(self, messages) -> None:
        import json
        import os
        import shutil

        with open(self.path + ".new", "wb") as out:
            write_blocks(out, iter([header_bytes(self.options.get("header", ""), [tuple(x) for x in json.loads(self.options.get("contigs", "[]"))])]))
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with open(part.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(EOF)
        os.replace(self.path + ".new", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.parts, ignore_errors=True)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return BamWriter(dict(self.options), overwrite)


def read_bam(spark, paths: list[str], region: str | None = None, split: int = 64 << 20):
    """Alignments of BAM files. region ("chrom:start-end", 1-based, inclusive): those that overlap it; a malformed one gives none."""
    import json

    from ..operators.junctions import in_region

    spark.dataSource.register(BamSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": json.dumps(paths), "split": str(split)} | ({"region": region} if region else {})
    rows = spark.read.format("bam").options(**options).load()
    return rows if region is None else in_region(rows, region)


def save_bam(rows, path: str, text: str, contigs: list[tuple[str, int]]) -> None:
    """Alignments as one BAM file in file order; tasks write, the driver only lays bytes end to end."""
    import json

    rows.sparkSession.dataSource.register(BamSource)
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    placed = rows.select(*columns).repartitionByRange("file_ord").sortWithinPartitions("file_ord")
    placed.write.format("bam").mode("overwrite").option("header", text).option("contigs", json.dumps(contigs)).option("path", path).save()
