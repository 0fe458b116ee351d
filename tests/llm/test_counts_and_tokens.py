"""Token counts, packing and the token store against the libraries themselves."""

import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from junctura.llm import packing, store, tokencount
from junctura.llm.common import Encoder, cut, tokenizer_path

ALPHABET = list("ab 'sTH\n\t.,!?019éßñ漢字\u00a0\u3000\u2028😀e\u0301\x00\x1c\x85▁<|>") + ["  ", "<|endoftext|>", "<s>", "<0x0A>", "'ll", " the", "▁▁"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def counter():
    return tokencount.MergeCounter(tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_merge_counter_is_the_librarys_count(sp, counter, text):
    assert counter(text) == len(sp.encode(text))


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_merge_counter_on_any_text(sp, counter, text):
    text = text.encode("utf-8", "replace").decode()
    assert counter(text) == len(sp.encode(text))


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def encoder(request):
    from tokenizers import Tokenizer

    path = tokenizer_path(request.param[0])
    return Encoder(path, request.param[1], most=50), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_encoder_is_the_librarys(encoder, text):
    fast, library = encoder
    assert np.frombuffer(fast(text), fast.type).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_encoder_on_any_text(encoder, text):
    fast, library = encoder
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(fast(text), fast.type).tolist() == library.encode(text, add_special_tokens=False).ids


HELD = """
import random, re
import pyarrow as pa
from junctura.llm.common import Encoder, release, tokenizer_path

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(1)
encode = Encoder(tokenizer_path("byte_bpe_50k.json"), "byte", most=1000)
texts = pa.array([" ".join(f"w{rng.randrange(50_000)}" for _ in range(600)) for _ in range(4000)])
release()
before, most, n = held(), 0, 0
for at, found in encode.slices(texts):
    n += len(found)
    most = max(most, held() - before)
print(n, most)
"""


def test_slices_leave_little_memory_behind():
    """What a worker holds beside its vocabulary, words and texts, of 16 MB of text: 11 MB; 76 MB when slices were of 4 MB and kept their free memory."""
    n, most = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) == 4000 and float(most) < 40


def test_count_tokens(docs, no_docs, sp):
    got = sorted(map(tuple, tokencount.count_tokens(docs).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect()), key=str)
    assert got == want
    assert any(r[3] for r in got)
    assert tokencount.count_tokens(no_docs).collect() == []


def test_plan_keeps_all_and_overfills_nothing():
    rng = random.Random(1)
    for size, histogram in ((2048, {2048: 3, 1500: 2, 548: 5, 1: 7}), (10, {7: 3, 3: 2, 2: 11, 1: 4}), (64, {rng.randrange(1, 65): rng.randrange(1, 400) for _ in range(50)}), (5, {}), (8, {8: 1})):
        entries, sequences = packing.plan(histogram, size)
        used, ranks = defaultdict(list), defaultdict(set)
        for length, lo, many, first, per, offset in entries:
            for r in range(many):
                assert lo + r not in ranks[length]
                ranks[length].add(lo + r)
                used[first + r // per].append((offset + r % per * length, length))
        assert {k: set(range(n)) for k, n in histogram.items()} == dict(ranks)
        assert set(used) == set(range(sequences))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        # As few as plain best-fit decreasing on single pieces.
        free = []
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            best = min((i for i, f in enumerate(free) if f >= length), key=lambda i: free[i], default=None)
            if best is None:
                free.append(size - length)
            else:
                free[best] -= length
        assert sequences == len(free)


def test_packing(docs, no_docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, with_ids=True)
    rows = [r.asDict() for r in got.collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    whole = sorted((str(r.doc_id), [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"]) for r in rows)
    assert len(pieces) == sum(max(1, -(-len(ids) // 2048)) for _, ids in whole)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        assert any(d == str(r["doc_id"]) and x[r["start"] : r["start"] + r["length"]] == ids.tolist() for d, x in whole)
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(used) <= total / 2048 + 2
    made = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(cut(got, "t")).collect()}
    assert sum(made.values()) == total
    assert packing.pack_documents(no_docs).collect() == []


def test_packing_ranks_in_salted_blocks(docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    rows = packing.pack_documents(docs).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        slots = store.Perfect.build(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_token_store(docs, no_docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    manifest = store.write(docs)
    got = [tuple(r) for r in store.read(manifest).collect()]
    want = sorted(((r.doc_id is not None, r.doc_id or 0, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()), key=lambda x: x[:2])
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((a, b, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for a, b, ids in want)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [b if a else None for a, b, _ in want]
    kept = store.TokenStore(manifest)
    for key in (0, 63, 65):
        assert [x.tolist() for x in kept.get(key)] == [ids for a, b, ids in want if a and b == key]
    assert len(kept.get(2)) == 4 and kept.get(10**9) == [] and kept.get(-5) == []
    assert store.read(store.write(no_docs)).collect() == []
