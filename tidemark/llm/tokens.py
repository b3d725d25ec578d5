"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, the last one marked as the word's end. A heap holds the adjacent pairs
that have a merge, lowest rank first and leftmost among equals; each pop joins two symbols of a linked list.
The count is the number of initial symbols less the merges: no token identifiers are made.

Text is prepared as the vocabulary file states: special strings count as one token each, the rest is composed
to NFC, lower-cased character by character and cut into words by the file's pattern; white space is dropped. For
texts with characters beyond U+058F the library itself composes and cuts, as its Unicode tables may be of another
version than this interpreter's; for the rest the two agree, and the faster way is taken.

Null or empty text counts 0 tokens. Texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._store import small_batches

#: Words whose counts a worker remembers; the memory is emptied when full.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class PairMerger:
    """Counts the tokens of a text under one vocabulary file (a `tokenizers` JSON with word-end BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.known = set(model["vocab"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.symbols = byte_symbols()
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.rare = re.compile("[^\x00-\u058f]")
        self.cache: dict[str, int] = {}

    def word(self, symbols: str) -> int:
        """Initial symbols minus merges, of a word given as its bytes' symbols."""
        parts: list[str | None] = list(symbols)
        parts[-1] += self.end
        parts = [p for p in parts if p in self.known]  # without an unknown token such symbols vanish
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = joined, _ = left + right, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((joined, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, joined, parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], joined))) is not None:
                heapq.heappush(heap, (r, h, parts[h], joined))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is not None and "<" in text:
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.rare.search(text):
            return sum(self.word(symbols) for symbols, _ in self.cut(self.normalize(text)))
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # The capital sigma's lower case doesn't depend on its place in the word here.
        text = text.replace("Σ", "σ").lower()
        cache, table, total = self.cache, self.symbols, 0
        get = cache.get
        for word in self.words.findall(text):
            n = get(word)
            if n is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                n = self.word("".join([table[b] for b in word.encode()]))
                if len(word) <= 64:
                    cache[word] = n
            total += n
        return total


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text column; `vocabulary` is a path that every executor can open."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = PairMerger(path)
        for texts in batches:
            yield pd.Series([merger.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """`docs` with the column `out` (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, F.coalesce(token_count(F.col(text), vocabulary), F.lit(0).cast("long")))
