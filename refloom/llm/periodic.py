"""Periodic runs of words (maximal repetitions) by an online, sparse dynamic program over diagonals.

Word i matches an earlier word j on the diagonal of lag i - j; a stretch with period q is a diagonal of lag q that goes on
matching. The program walks the words once with the active lags and the word each began to match at: a lag whose
earlier word equals the new one goes on, any other ends there, and a diagonal that ends long enough is a run, emitted at once.
Which earlier occurrence may open a diagonal is what keeps it sparse. Taking every earlier occurrence of a frequent
word costs the square of its count. Here lag q is opened by the latest earlier occurrence of the last m words, m being
the power of two with m / 2 < q <= m: a run of length 4q or more holds such an occurrence, no earlier place of the same m words
gives a smallest period, and a lag that so opens has no smaller period (two periods of a stretch as long as their sum
imply their common divisor). So active lags are squares of the text, few at every word, and the cost is n log n even for
one word repeated a million times. All state is that of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from refloom.llm.common import text_of

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def openings(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(word, lag, words matched so far) where a diagonal opens, in the order of the words."""
    n, found, size = len(ids), [], 1
    gram = ids
    while size >> 1 < n // EXPONENT:
        # gram[i]: number of the `size` words that end at word i + size - 1.
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        if not same.any():
            break  # no `size` words occur twice, so no longer ones do
        at, lag = order[1:][same], order[1:][same] - order[:-1][same]
        here = (lag <= size) & (lag > size >> 1)
        at, lag = at[here], lag[here]
        if len(at):
            # Only the first word of a stretch of openings with one lag: at the others it is active.
            by = np.lexsort((at, lag))
            at, lag = at[by], lag[by]
            first = np.ones(len(at), bool)
            first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
            found += [(i + size - 1, q, size) for i, q in zip(at[first].tolist(), lag[first].tolist(), strict=True)]
        rank = np.empty(n - size + 1, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(~same)))
        gram = rank[:-size] * (n + 1) + rank[size:] if len(rank) > size else rank[:0]
        size *= 2
    return sorted(found)


def runs_of(words: list[bytes] | list[str] | list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == n:
        return []
    pending = openings(np.array(ids, np.int64))
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> first word that matched

    def end(lag: int, upto: int) -> None:
        first = active.pop(lag)
        length = upto - first + lag
        if length >= max(LEAST, EXPONENT * lag):
            runs.append((first - lag, length, lag))

    k, i = 0, 0
    while active or k < len(pending):
        if not active:
            i = pending[k][0]
        if i == n:
            break
        for lag in [q for q in active if ids[i] != ids[i - q]]:
            end(lag, i)
        while k < len(pending) and pending[k][0] == i:
            _, lag, matched = pending[k]
            active.setdefault(lag, i - matched + 1)
            k += 1
        i += 1
    for lag in list(active):
        end(lag, n)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


_FOUND = StructType(
    [
        StructField("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))),
        StructField("collapsed", StringType()),
    ]
)


@arrow_udf(_FOUND)
def _found(texts: pa.Array) -> pa.Array:
    runs, kept = [], []
    for text in texts.cast(pa.binary()):
        words = text.as_py().split()  # of bytes: ASCII blanks only
        own = runs_of(words)
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
        kept.append(b" ".join(collapse(words, own)))
    return pa.StructArray.from_arrays(
        [pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], ["runs", "collapsed"]
    )


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """(id, runs, collapsed) per row of docs: the runs by start, then period, and the text without their repeats.

    A run is a stretch of words with smallest period q, at least max(6, 4q) words long, that neither neighbour extends. Words
    are split at ASCII blanks; collapsed joins what stays by one blank. Null and empty texts have no run and collapse to the
    empty text. Rows that repeat and null ids keep a row each; runs may overlap, and each is listed. A text of any length
    is read whole, at n log n. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", _found("_text").alias("_found"))
    return rows.select(F.col("_id").alias(id_col), "_found.runs", "_found.collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones. Null if there is none."""
    return F.aggregate(
        runs,
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, run: F.when(
            best.isNotNull() & (run["length"] * best["period"] <= best["length"] * run["period"]), best
        ).otherwise(run),
    )
