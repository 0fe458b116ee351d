"""What the operators of this subpackage share: joins with hot keys, words, batches, token ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut, discard, fresh_path, shared_dir

#: A word: a run of anything but the six ASCII white-space characters (what bytes.split() splits at).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of one key that a join leaves together; keys above it are HOT at most.
TOGETHER, HOT = 2_000, 10_000


def spread_join(many: DataFrame, one: DataFrame, key: str, n: str, rows: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) on key of many rows with the key's row (or few rows) of `one`, whose column n counts the key's rows in many, `rows` in all. Rows of keys above a block of TOGETHER (or rows / HOT, so that the broadcast list of such keys has HOT entries at most) are dealt over ceil(n / block) parts, and the key's row of `one` goes to each."""
    block = max(TOGETHER, -(-rows // HOT))
    if rows <= block:  # no key can have more
        return many.join(one, key, how)
    parts = F.ceil(F.col(n) / block)
    hot = one.where(F.col(n) > block).select(F.col(key).alias("_hot"), parts.alias("_parts")).distinct()
    salt = F.pmod(F.xxhash64(*many.columns), F.coalesce("_parts", F.lit(1)))
    dealt = many.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    each = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(each, [key, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `_row`, so that no name that an operator adds can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


#: Rows and bytes of a batch of texts that goes to Python, at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES where they are higher: rows are whole documents here, and a batch stands several times in the memory of its executor and its worker."""
    from pyspark.errors import PySparkException

    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0) if re.fullmatch(r"-?\d+b?", spark.conf.get(key)) else most + 1
            if spark.conf.get(key).startswith("-") or not 0 < now <= most:
                spark.conf.set(key, str(most))
        except PySparkException:  # a Spark without that limit
            pass


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str | T.StructType, make: Callable[[], Callable[[list[list], list[str]], Iterable[list]]], rows: int = 512) -> DataFrame:
    """Apply a function to slices of at most `rows` texts. make() builds it once per task; it takes the key columns and the texts (null: empty) as lists and yields output columns as lists."""
    small_batches(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        lean()
        arrow, fn = to_arrow_schema(out), make()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                cols = [part.column(i).to_pylist() for i in range(len(keys))]
                texts = [x or "" for x in part.column(len(keys)).to_pylist()]
                got = fn(cols, texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, arrow, strict=True)], schema=arrow)
        del fn
        lean()

    assert fields
    return df.select(*[F.col(k) for k in keys], F.col(text)).mapInArrow(run, out)


class Cache(dict):
    """A dict that computes what it lacks; at most `most` entries of at most LONGEST characters in each of two generations, so its memory is bounded and frequent keys stay."""

    LONGEST = 64

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: White space outside ASCII's six characters, as either library may see it.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_RE2 = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters beyond the first blocks (and one whose lower case is two): their chunks go to the library whole.
FAR = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Chunks that byte-level pre-tokenisation never crosses, for texts without ODD_SPACE.
BYTE_CHUNK = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
BYTE_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def odd_space(text: str) -> bool:
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return ODD_SPACE.search(text) is not None


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them (add_special_tokens=False).

    Texts are taken in slices of about SLICE bytes. A slice's texts are split where pre-tokenisation always cuts, its distinct words
    are looked up once, and its ids are gathered by one take. Words that are not known are laid end to end and merged in one call by tiktoken, whose
    ranks are made from the vocabulary file's own merges; where each word's ids begin shows in the ids. Words are remembered in two generations of
    at most `most` short keys each, so a worker holds some tens of MB whatever it reads. Texts with white space outside ASCII or strings
    of special tokens, words beyond the first Unicode blocks, and vocabularies with other rules than plain merges go to the library. kind: "byte"
    (byte-level BPE, a space joins the word after it) or "word" (lower case, white space is dropped, the last symbol of a piece carries "</w>").

    Keys of words: as they are after a space; after "\n" or "\r" (a line's or a text's first); after "\t" other white space; after "\v" a whole text."""

    SLICE = 2 << 20

    def __init__(self, path: str, kind: str, most: int = 100_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tok, self.kind = np, Tokenizer.from_file(path), kind
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type, self.most, self.new, self.old = f"<u{self.width}", most, {}, {}
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()] if self.tok.normalizer is None else ["<|"]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.apart = ODD_RE2 + r"|\x00" if kind == "word" else "|".join([r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c]", ODD_RE2, *map(re.escape, special)])
        self.merger = self._merger()

    def _merger(self):
        """tiktoken's merges over the vocabulary's; None if its rules are not plain merges. Sets the vocabulary's id of each rank, which ids begin with a space, and the id of a line end."""
        import json

        import regex
        import tiktoken

        np, end = self.np, "</w>" if self.kind == "word" else ""
        model = json.loads(self.tok.to_str())["model"]
        rules = (model.get("end_of_word_suffix") or "", *(bool(model.get(k)) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")))
        vocab, letters = model.get("vocab", {}), byte_letters()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        if model.get("type") != "BPE" or rules != (end, False, False, False, False, False) or len(set(merges)) < len(merges):
            return None
        # Such a token's symbols must merge to itself, as tiktoken takes whole pieces that are in the vocabulary at once.
        if any(len(self.tok.model.tokenize(m.removesuffix(end))) != 1 for m in merges if m.endswith(end)):
            return None
        to_byte = {c: b for b, c in letters.items()}
        symbols = [*letters.values(), *[c + end for c in letters.values() if end], *merges]
        mark = b"\0" if end else b""  # stands for "</w>"; texts that hold it are not merged here
        ranks = {bytes(to_byte[c] for c in (s.removesuffix(end) if end else s)) + (mark if end and s.endswith(end) else b""): i for i, s in enumerate(symbols)}
        if len(ranks) < len(symbols) or any(s not in vocab for s in symbols):
            return None
        self.ids = np.array([vocab[s] for s in symbols], self.type)
        self.spaced = np.array([s[0] == letters[32] for s in symbols])
        self.line = symbols.index(letters[10] + end)
        self.pieces = regex.compile(r"\n|" + WORD_PIECE)
        return tiktoken.Encoding("merges", pat_str=r"[^\x00]+\x00" if end else BYTE_PIECE, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return self.np.array(self.tok.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def merged(self, words: list[str], lines: bool) -> list[bytes]:
        """Ids of words after a space, or of lines' first words without the line end before them."""
        np, w = self.np, self.width
        if not words:
            return []
        if self.kind == "word":
            found = self.pieces.findall("\n" + "\n".join(words).lower())
            ranks, own = self.merger.encode_to_numpy("\0".join(found) + "\0", disallowed_special=()), 1
        else:
            mark, own = ("\n", 1) if lines else (" ", 0)
            ranks = self.merger.encode_to_numpy(mark + mark.join(words), disallowed_special=())
        first = np.flatnonzero(ranks == self.line if own else self.spaced[ranks])
        if len(first) != len(words):
            raise ValueError("words can't be told apart in their ids")
        data, ends = self.ids[ranks].tobytes(), [*(first[1:] * w).tolist(), len(ranks) * w]
        return [data[a:b] for a, b in zip(((first + own) * w).tolist(), ends, strict=True)]

    def fresh(self, keys: list[str]) -> list[bytes]:
        """Ids of words that are not known."""
        out: list = [None] * len(keys)
        texts: list[str | None] = [None] * len(keys)  # for the library
        plain: tuple[list[int], list[int]] = ([], [])  # places of words after a space, and of first words
        for i, key in enumerate(keys):
            head, rest = key[:1], key[1:]
            if head == "\v":
                texts[i] = rest
            elif self.merger is None or FAR.search(key) or (self.kind == "word" and "<|" in key):
                texts[i] = key if self.kind == "word" or head == "\n" else rest if head in ("\r", "\t") else " " + key
            elif not rest and head in ("", "\r"):
                out[i] = b""
            elif head == "\t":
                texts[i] = rest
            else:
                plain[self.kind == "byte" and head in ("\n", "\r")].append(i)
        at = [i for i, x in enumerate(texts) if x is not None]
        for k in range(0, len(at), 1024):
            for i, got in zip(at[k : k + 1024], self.tok.encode_batch_fast([texts[i] for i in at[k : k + 1024]], add_special_tokens=False), strict=True):
                out[i] = self.np.array(got.ids, self.type).tobytes()
        for i, got in zip(plain[0], self.merged([keys[i] for i in plain[0]], False), strict=True):
            out[i] = got
        end = self.ids[self.line].tobytes() if self.merger else b""
        for i, got in zip(plain[1], self.merged([keys[i][1:] for i in plain[1]], True), strict=True):
            out[i] = end + got if keys[i][0] == "\n" else got
        return out

    def words(self, keys: list[str]) -> list[bytes]:
        got = list(map(self.new.get, keys))
        lack = [i for i, x in enumerate(got) if x is None]
        for i in lack:
            got[i] = self.old.get(keys[i])
        lost = [i for i in lack if got[i] is None]
        for i, value in zip(lost, self.fresh([keys[i] for i in lost]), strict=True):
            got[i] = value
        for i in lack:
            if len(keys[i]) <= Cache.LONGEST:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[keys[i]] = got[i]
        return got

    def keys(self, text: str) -> list[str]:
        """Keys of a text that isn't plain."""
        if odd_space(text) or (self.kind == "byte" and self.special.search(text)):
            return ["\v" + text]
        if self.kind == "word":
            return ["\v" + text] if "\0" in text else text.split()
        return [c[1:] if c[0] == " " and not c.isspace() else ("\t" if c.isspace() else "\r") + c for c in BYTE_CHUNK.findall(text)]

    def _slice(self, texts: pa.Array) -> list:
        import pyarrow.compute as pc

        np = self.np
        odd = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        order = np.argsort(odd, kind="stable")
        plain, rest = texts.filter(pa.array(~odd)), texts.filter(pa.array(odd)).to_pylist()
        if self.kind == "byte":
            plain = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\r", plain, ""), "\n", " \n"), " ")
        else:
            plain = pc.ascii_split_whitespace(plain)
        apart = list(map(self.keys, rest))
        sizes = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False), np.fromiter(map(len, apart), np.int64, len(apart))]).astype(np.int64)
        coded = pa.concat_arrays([plain.flatten(), pa.array([k for x in apart for k in x], pa.string())]).dictionary_encode()
        del plain, rest, apart
        values = self.words(coded.dictionary.to_pylist())
        place = np.int32 if pc.sum(pc.binary_length(texts)).as_py() < 1 << 28 else np.int64  # a byte gives a few ids at most
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        flat, first, lengths = np.frombuffer(b"".join(values), self.type), (np.cumsum(lengths) - lengths).astype(place), lengths.astype(place)
        at = coded.indices.to_numpy()
        del coded, values
        own = lengths[at]
        ends = np.cumsum(own, dtype=place)
        source = np.repeat(first[at] - (ends - own), own)
        source += np.arange(len(source), dtype=place)
        ids = flat[source]
        bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]])
        out: list = [None] * len(texts)
        for i, (a, b) in zip(order.tolist(), zip(bounds.tolist(), bounds[1:].tolist(), strict=False), strict=True):
            out[i] = ids[a:b]
        return out

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, list]]:
        """(place of the first text, ids of each text as an array) for slices of the texts (null: empty)."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        sizes = self.np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=self.np.int64)
        at, done = 0, 0
        while at < len(texts):
            to = max(at + 1, int(self.np.searchsorted(sizes, done + self.SLICE, "right")))
            got = self._slice(texts.slice(at, to - at))
            release()
            yield at, got
            del got
            at, done = to, int(sizes[to - 1])

    def __call__(self, text: str) -> bytes:
        return self._slice(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this process, which Python workers keep from task to task until a task of another kind drops it; only the last one used stays."""
    if (path, kind) not in _ENCODERS:
        lean()
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def lean() -> None:
    """Drop what earlier tasks left in this Python worker, and give free memory back to the machine: executors share theirs with their workers."""
    import gc

    _ENCODERS.clear()
    gc.collect()
    release()


def release() -> None:
    """Give the free memory of Arrow's pool and the C library back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_ids(ids) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["Cache", "Encoder", "LOWER", "UPPER", "crc_ids", "cut", "discard", "encoder", "fresh_path", "lean", "map_texts", "packed", "read_table", "shared_dir", "small_batches", "spread_join", "tokenizer_path", "uniform", "utf8_size", "word_count"]
