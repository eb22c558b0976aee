"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

The symbols of a word form a linked list; a heap holds the adjacent pairs that the vocabulary merges, by rank and then by
place. The lowest pair is popped again and again, pairs whose symbols have changed since are skipped, and the count is
the number of initial symbols minus the number of merges. A word costs n log n in its length. Words repeat, so each Python
worker remembers the counts of up to `REMEMBERED` words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Words of which a worker keeps the count, some 150 bytes each; then it starts anew.
REMEMBERED = 400_000
#: What \s stands for in the vocabulary file's patterns.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class TokenCounter:
    """Counts of a byte-level BPE vocabulary file with normalisers NFC and lower case and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [ids.get(s) for s in symbols]
        self.last = [ids.get(s + self.suffix) for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        steps = spec["normalizer"]["normalizers"]
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACES))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = _Known(self.word)

    def word(self, word: str) -> int:
        """Tokens of one word."""
        raw = word.encode("utf-8")
        symbol = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbol = [s for s in symbol if s is not None]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            merged += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, symbol[k])):
                    heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbol[h], new))):
                heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return n - merged

    def count(self, text: str | None) -> int:
        """Tokens of a text, special strings in it counted as one each; null or empty: 0."""
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.lower:
                # Character by character: a sigma at the end of a word has no form of its own.
                part = part.replace("Σ", "σ").lower()
            total += sum(map(self.known.__getitem__, self.words.findall(part)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return total


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column under the vocabulary file at `path`, which every executor must have."""

    @pandas_udf(LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counts(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row: UTF-8 bytes, tokens, and whether these are more than `limit`.

    Null and empty texts have 0 of both. Repeated rows and null ids keep their rows; an empty table gives no rows. Texts of any
    length are counted whole, in their row; of pairs of equal rank the leftmost is merged. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        count_tokens(text, path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
