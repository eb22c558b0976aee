"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lowers the text, writes look-alike letters and digits as the letters they stand for, and leaves words divided by
one blank, so an entry matches at word borders: a whole word, or a stem of at least four letters that words begin with.
The lexicon, its weights and the exception phrases are learned from labelled rows: weights are log odds of document
frequencies, and a phrase is an exception if it holds an entry, occurs in clean documents and never in toxic ones.
A document's score is a logistic function of its matched weight as a whole and by length.

Fitting uses a bounded sample of labelled rows (about `FIT_ROWS`, chosen by a hash of the id); near copies among them count
once, so that a passage that is copied often does not look toxic by its place. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from refloom.session import materialize

#: Labelled rows that the lexicon and the logistic function are fitted on, about.
FIT_ROWS = 20_000
#: An entry occurs in this many toxic documents of the sample, with this log odds; the lexicon has this many at most.
LEAST_TOXIC, LEAST_WEIGHT, MOST_ENTRIES = 5, 2.0, 5_000
STEM_LENGTHS = (4, 5, 6, 7)
#: An exception phrase occurs in this many clean documents and in no toxic one.
LEAST_CLEAN = 3

# Letters of other scripts that look like Latin ones, and the digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = str.maketrans(LOOK_ALIKES | SUBSTITUTES | dict.fromkeys(INVISIBLE, ""))
_FULL_WIDTH = str.maketrans({chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
_WORDS = re.compile(r"[^\W_]+")
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    if not text:
        return []
    low = text.translate(_FULL_WIDTH).lower() if not text.isascii() else text.lower()
    return _WORDS.findall(_INNER.sub("i", low).translate(_FOLD))


def features_of(words: list[str]) -> set[str]:
    """What the lexicon may learn from a document: " word " and " stem"."""
    out = set()
    for w in set(words):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEM_LENGTHS if k < len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str]
    #: Intercept, and factors of the measures.
    logistic: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self.automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "logistic": self.logistic, "automaton": None}

    def matches(self, words: list[str]) -> list[tuple[int, str]]:
        """(word number, entry) of the strongest entry at each word that has one, without those in exception phrases."""
        if not self.weights or not words:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry in self.weights:
                self.automaton.add_word(entry, entry)
            self.automaton.make_automaton()
        line = f" {' '.join(words)} "
        best: dict[int, str] = {}
        for end, entry in self.automaton.iter(line):
            start = end - len(entry) + 1
            if start not in best or self.weights[entry] > self.weights[best[start]]:
                best[start] = entry
        if not best:
            return []
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        places = np.searchsorted(starts, sorted(best)).tolist()
        found = list(zip(places, [best[s] for s in sorted(best)], strict=True))
        if self.exceptions:
            found = [(i, e) for i, e in found if not self.exceptions & set(phrases(words, i))]
        return found

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """Matched weight (repeats of a word count less and less), the same per hundred words, different words matched."""
        words = folded(text)
        found = self.matches(words)
        if not found:
            return 0.0, 0.0, 0.0
        times: dict[str, int] = {}
        strength: dict[str, float] = {}
        for i, entry in found:
            times[words[i]] = times.get(words[i], 0) + 1
            strength[words[i]] = self.weights[entry]
        weight = sum(strength[w] * (1 + math.log(n)) for w, n in times.items())
        return math.log1p(weight), math.log1p(100 * weight / len(words)), math.log1p(len(times))

    def score(self, text: str | None) -> float:
        a, *b = self.logistic
        z = a + sum(x * y for x, y in zip(b, self.measures(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def phrases(words: list[str], i: int) -> list[str]:
    """The word with the one before it, and with the one after it."""
    return ([f"{words[i - 1]} {words[i]}"] if i else []) + ([f"{words[i]} {words[i + 1]}"] if i + 1 < len(words) else [])


def _sketch(words: list[str]) -> int:
    """A value that near copies mostly share: the least hash of their three-word shingles."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 7) for i in range(max(1, len(words) - 2))), default=0)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, bound: int) -> DataFrame:
    """About `bound` labelled rows at most (sketch, toxic, text), one of each group of near copies.

    The ids are chosen by hash from the label table, so only their rows of docs are read further; the table of chosen ids
    has the size of the bound and is broadcast.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    named = named.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, bound / max(1, named.count()))
    named = named.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(named), "_id").withColumn("_id", F.col("_id").cast("string"))

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["sketch"] = [str(_sketch(folded(t))) for t in f["text"]]
            yield f[["sketch", "toxic", "text", "_id"]]

    rows = rows.mapInPandas(sketched, "sketch string, toxic int, text string, _id string")
    one = rows.groupBy("sketch").agg(F.min_by(F.struct("toxic", "text"), "_id").alias("r"))
    return materialize(one.select("sketch", "r.toxic", "r.text"), "toxic-fit")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method on the ridge-penalised logistic loss."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "toxic",
    text_col: str = "text",
    bound: int = FIT_ROWS,
) -> Lexicon:
    """Learn the lexicon from the labelled rows of docs. Without labels of both kinds it is empty and all scores are 0.5."""
    rows = _sample(docs, labels, id_col, label_col, text_col, bound)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, set())

    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t, group in f.groupby("toxic"):
                seen: dict[str, int] = {}
                for text in group["text"]:
                    for x in features_of(folded(text)):
                        seen[x] = seen.get(x, 0) + 1
                yield pd.DataFrame({"x": list(seen), "pos": list(seen.values()) if t else 0, "neg": 0 if t else list(seen.values())})

    df = rows.mapInPandas(exploded, "x string, pos long, neg long")
    df = df.groupBy("x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    df = df.withColumn("w", weight).where((F.col("pos") >= LEAST_TOXIC) & (F.col("w") >= LEAST_WEIGHT))
    top = df.orderBy(F.desc("pos"), F.desc("w"), "x").limit(MOST_ENTRIES).collect()
    lexicon = Lexicon({r["x"]: float(r["w"]) for r in top}, set())

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for text, t in zip(f["text"], f["toxic"], strict=True):
                words = folded(text)
                found += {(p, int(t)) for i, _ in lexicon.matches(words) for p in phrases(words, i)}
            yield pd.DataFrame(found, columns=["phrase", "toxic"])

    met = rows.mapInPandas(near, "phrase string, toxic int").groupBy("phrase")
    met = met.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).where(f"pos = 0 and neg >= {LEAST_CLEAN}")
    lexicon.exceptions = {r["phrase"] for r in met.orderBy(F.desc("neg"), "phrase").limit(MOST_ENTRIES).collect()}

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([lexicon.measures(t) for t in f["text"]], columns=["a", "b", "c"])
            yield out.assign(toxic=f["toxic"].to_numpy(), sketch=f["sketch"].to_numpy())

    seen = rows.mapInPandas(measured, "a double, b double, c double, toxic int, sketch string").toPandas().sort_values("sketch")
    lexicon.logistic = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy(float))
    return lexicon


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score of a text column between 0 and 1; null and empty texts have the score of a text without matches."""

    @pandas_udf(DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return scores(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the labels of a row are kept from fitting: crc32 of the id as text leaves 1 modulo 3 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "toxic",
    text_col: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, learned from the labels of rows that are not held out.

    Only the text is an input of a score. Repeated rows and null ids keep their rows; empty tables give no rows. Texts
    of any length are matched whole. Of entries of equal weight at a word the one that ends first counts. Other columns are ignored.
    """
    known = docs.select(id_col, text_col).where(~held_out(id_col))
    lexicon = fit(known, labels.where(~held_out(id_col)), id_col, label_col, text_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(F.col(text_col), lexicon).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
