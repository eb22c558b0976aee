"""Encoding and decoding with a SentencePiece BPE vocabulary by vectorised merge rounds.

A batch of texts is cut into units that no piece crosses. The symbols of all new units lie in one flat numpy array; a
round looks up the rank of every adjacent pair, takes the least rank of each unit by a segmented minimum, and merges in
all units at once the leftmost pairs of that rank. Merged symbols are compacted away and finished units leave, until no
pair remains. Units repeat, so a worker remembers up to `REMEMBERED` of them. A unit of more than `LONG` symbols (text
without blanks) has as many rounds as it has different ranks, so it is not looked through anew in each: its pairs lie in
buckets by rank, a round takes the least bucket, and only the neighbours of what it merges are looked up again.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Units of which a worker keeps ids and text, some 300 bytes each; then it starts anew.
REMEMBERED = 300_000
#: Symbols merged at a time.
FLAT_SYMBOLS = 1 << 20
#: Symbols above which a unit is merged by buckets.
LONG = 512
SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class PieceCodec:
    """Ids as the library gives them for an identity-normalised BPE model with byte fallback and a blank put before."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.surface = [
            b"" if model.is_control(i) or model.is_unknown(i) else p.replace(SPACE, " ").encode("utf-8")
            for i, p in enumerate(pieces)
        ]
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]  # equal scores have equal ranks
        made: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    made[left * n + right] = i
        self.keys = np.array(sorted(made), np.int64)
        self.made = np.array([made[k] for k in self.keys.tolist()], np.int64)
        self.rank = rank[self.made].astype(np.int64)
        # A piece is settled if no pair with it ranks as high as the piece itself: then all its merges may run at once.
        self.settled = np.ones(n, bool)
        for part in (self.keys // n, self.keys % n):
            self.settled[part[self.rank <= rank[part]]] = False
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        # Long runs of blanks merge from the left into the longest blank piece; the last blank may go to a word.
        run = max(len(p) for p in self.ids if not p.strip(SPACE))
        self.units = re.compile(f"{SPACE}{{{run}}}(?={SPACE})|[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _ranks(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each symbol, and the piece it makes."""
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        left, right = symbols[:-1], symbols[1:]
        at = np.flatnonzero((unit[:-1] == unit[1:]) & (left < self.n) & (right < self.n))
        key = left[at] * self.n + right[at]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        rank[at[hit]], made[at[hit]] = self.rank[place[hit]], self.made[place[hit]]
        return rank, made

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the piece it makes."""
        key = np.where((left < self.n) & (right < self.n), left * self.n + right, -1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        return np.where(hit, self.rank[place], _NONE), np.where(hit, self.made[place], 0)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one unit after all merges, in time n log n.

        A round merges pairs of the least rank from the left, up to the first merge that brings forth a pair of that rank or
        a better one: the next merge must then be looked for again. Neighbours are a linked list.
        """
        n = len(symbols)
        sym = np.append(symbols, _NONE)  # a last symbol that pairs with nothing
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, made = (np.append(x, [last]) for x, last in zip(self._pairs(sym[:-1], sym[1:]), (_NONE, 0), strict=True))
        alive = np.ones(n + 1, bool)
        buckets: dict[int, list[np.ndarray]] = defaultdict(list)
        least: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            values, starts = np.unique(rank[at], return_index=True)
            for r, part in zip(values.tolist(), np.split(at, starts[1:]) if len(at) else [], strict=True):
                if r not in buckets:
                    heapq.heappush(least, r)
                buckets[r].append(part)

        put(np.arange(n))
        while least:
            r = heapq.heappop(least)
            at = np.unique(np.concatenate(buckets.pop(r)))
            every = at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Of pairs that overlap, every other one from the left.
            first = np.append(True, at[1:] != after[at[:-1]])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            right = after[at]
            left, piece = before[at], made[at]
            left_symbol = np.where(left >= 0, sym[left], _NONE)
            beside = np.append(False, right[:-1] == left[1:])  # the pair before ends where this one begins
            left_symbol[1:] = np.where(beside[1:], piece[:-1], left_symbol[1:])
            new = np.minimum(self._pairs(left_symbol, piece)[0], self._pairs(piece, sym[after[right]])[0])
            bad = np.flatnonzero(new <= r)
            if len(bad):
                at = at[: bad[0] + 1]
                right, piece = right[: len(at)], piece[: len(at)]
            sym[at] = piece
            alive[right] = False
            rank[right] = _NONE
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            changed = np.unique(np.concatenate((at, before[at])))
            changed = changed[changed >= 0]
            rank[changed], made[changed] = self._pairs(sym[changed], sym[after[changed]])
            # What the cut has left over is still of this rank.
            put(np.union1d(changed, every[alive[every]]) if len(bad) else changed)
        return sym[:n][alive[:n]]

    def merge(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit (none of them empty)."""
        long = [i for i, u in enumerate(units) if len(u) > LONG]
        if long:
            short = self.merge([u for u in units if len(u) <= LONG]) if len(long) < len(units) else []
            rest = iter(short)
            return [self._ids(self._merge_long(self._symbols(u))) if len(u) > LONG else next(rest) for u in units]
        symbols = self._symbols("".join(units))
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        out_symbols, out_unit = [], []
        while len(symbols):
            rank, made = self._ranks(symbols, unit)
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            done = np.repeat(least == _NONE, sizes)
            out_symbols.append(symbols[done])
            out_unit.append(unit[done])
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & ~done)
            # Of pairs that overlap, every other one from the left.
            first = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            # Where a merge could bring forth a pair of the same rank or a better one, only the leftmost is made.
            lead = np.concatenate(([True], unit[at[1:]] != unit[at[:-1]])) if len(at) else np.zeros(0, bool)
            at = at[lead | self.settled[made[at]]] if len(at) else at
            symbols = symbols.copy()
            symbols[at] = made[at]
            stay = ~done
            stay[at + 1] = False
            symbols, unit = symbols[stay], unit[stay]
        symbols, unit = np.concatenate(out_symbols), np.concatenate(out_unit)
        order = np.argsort(unit, kind="stable")
        symbols, unit = symbols[order], unit[order]
        bounds = np.searchsorted(unit, np.arange(len(units) + 1))
        plain = symbols < self.n
        parts = symbols.astype(np.uint32)
        return [
            parts[a:b] if plain[a:b].all() else self._ids(symbols[a:b])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]

    def _symbols(self, text: str) -> np.ndarray:
        """Ids of the characters. One without a piece stands for itself above the ids; in the end its bytes are written."""
        codes, inverse = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
        ids = np.array([self.ids.get(chr(c), self.n + c) for c in codes.tolist()], np.int64)
        return ids[inverse]

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        if (symbols < self.n).all():
            return symbols.astype(np.uint32)
        return np.concatenate([self._own(s) for s in symbols.tolist()])

    def _own(self, symbol: int) -> np.ndarray:
        if symbol < self.n:
            return np.array([symbol], np.uint32)
        return self.byte_ids[np.frombuffer(chr(symbol - self.n).encode("utf-8"), np.uint8)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids give nothing, runs of byte ids are UTF-8, the first blank is the one put before."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids.tolist()])
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Per text: ids as little-endian unsigned 32-bit integers with begin and end, and the text decoded from them."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        cut = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, surface = self.known, self.surface
        new = list({u for units in cut for u in units if u not in known})
        sizes = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // FLAT_SYMBOLS
        for k in range(int(sizes[-1]) + 1 if len(new) else 0):
            some = new[np.searchsorted(sizes, k) : np.searchsorted(sizes, k, "right")]
            for unit, ids in zip(some, self.merge(some) if some else [], strict=True):
                known[unit] = ids.astype("<u4").tobytes(), b"".join([surface[i] for i in ids.tolist()])
        for units in cut:
            parts = [known[u] for u in units]
            decoded = b"".join([p[1] for p in parts]).removeprefix(b" ").decode("utf-8", "replace")
            yield begin + b"".join([p[0] for p in parts]) + end, decoded


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


#: Texts of a batch that are cut up at a time, in characters.
_CHARS_AT_ONCE = 4_000_000


def _groups(texts: pd.Series) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= _CHARS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_decode(text: Column, path: str) -> Column:
    """Struct (ids, decoded) of a text column: ids as little-endian unsigned 32-bit integers with begin and end ids."""

    @pandas_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [x for group in _groups(texts) for x in codec(path).batch(group)]
            yield pd.DataFrame(made, columns=["ids", "decoded"])

    return run(text)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) per row. Null and empty texts have the begin and end ids and decode to "".

    Repeated rows and null ids keep their rows; an empty table gives no rows; a text of any length is read whole, at n log n also
    without blanks; of pairs of equal rank the leftmost is merged. Other columns are ignored, whatever their names. The file at `path` must be
    on every executor.
    """
    made = docs.select(F.col(id_col), encode_decode(F.coalesce(F.col(text_col), F.lit("")), path).alias("_made"))
    size = (F.octet_length("_made.ids") / 4).cast("long")
    return made.select(id_col, size.alias("n_tokens"), "_made.ids", "_made.decoded")
