"""Token counts by heap-and-linked-list byte-pair merging, without making any identifier.

A text's pieces never cross a boundary from a non-space to a space symbol (checked on the vocabulary when it is
loaded), so each such segment is counted alone and remembered per task in a bounded cache. A segment starts as a linked
list of its characters; a heap holds the adjacent pairs that are in the vocabulary; the best pair (highest score, that
is lowest rank; ties to the left) is popped and merged until none is left. The count is the initial symbols minus the
merges; a character outside the vocabulary stands for one symbol per UTF-8 byte (byte fallback).

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings in a text are ordinary text (as
the library's encode does it); repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame

from .common import Cache, map_texts, tokenizer_path

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class MergeCounter:
    def __init__(self, model_path: str, most: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                if sp.is_unused(i):
                    raise ValueError("vocabularies with unused pieces are not supported")
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        # "a_b" with a space symbol after another symbol would make segments depend on each other.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece of this vocabulary has an inner space symbol")
        self.seen = Cache(self.segment, most)

    def segment(self, s: str) -> int:
        """Symbols left when all merges in s are done."""
        score, n = self.score, len(s)
        count = 0
        for c in s:
            count += 1 if c in score else len(c.encode("utf-8", "surrogatepass"))
        piece, after, before = list(s), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            got = score.get(s[i : i + 2])
            if got is not None:
                heap.append((-got, i, 2, i + 1))
        heapq.heapify(heap)
        while heap:
            _, i, size, j = heapq.heappop(heap)
            left, right = piece[i], piece[j]
            if not left or not right or len(left) + len(right) != size or after[i] != j:
                continue  # one of the two was merged meanwhile
            # Both symbols are in the vocabulary or single characters; a merged one always is.
            count -= (1 if left in score else len(left.encode("utf-8", "surrogatepass"))) + (1 if right in score else len(right.encode("utf-8", "surrogatepass"))) - 1
            both = piece[i] = left + right
            piece[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                got = score.get(both + piece[k])
                if got is not None:
                    heapq.heappush(heap, (-got, i, len(both) + len(piece[k]), k))
            h = before[i]
            if h >= 0:
                got = score.get(piece[h] + both)
                if got is not None:
                    heapq.heappush(heap, (-got, h, len(piece[h]) + len(both), i))
        return count

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.seen.__getitem__, _SEGMENT.findall(SPACE + text.replace(" ", SPACE))))


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row."""
    path = model_path or tokenizer_path("piece_bpe_32k.model")

    def make():
        count = MergeCounter(path)

        def run(keys, texts):
            n = [count(x) for x in texts]
            return [keys[0], [len(x.encode("utf-8", "surrogatepass")) for x in texts], n, [x > limit for x in n]]

        return run

    kind = dict(docs.dtypes)[key]
    return map_texts(docs, [key], text, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", make)
