"""Quality classifier by co-training two views of a document.

The content view reads the text: shares of its words by buckets of a hash, and how long, common and repeated they are. The
page view knows what stands about the words: source, language, size, lines and signs. Each view has a logistic regression.
In every round each classifier labels the documents it is surest of, as many of either class as the labelled rows suggest,
and the other classifier learns from them besides the true labels.
At the end each view is calibrated on labelled rows kept from training, and their log odds are combined, less the prior
that both contain.

Features are computed once per document by built-in functions and written as a narrow table. A Newton step sums gradients
and curvatures over that table, one small vector per partition, summed by Spark; pseudo-labels are a function of the
models of the round before and are never stored. So the driver holds a few hundred numbers at any size of the input.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

from refloom.llm import quality_rules
from refloom.llm.common import text_of
from refloom.llm.toxicity import held_out
from refloom.session import materialize

ROUNDS, STEPS = 3, 6
#: Share of all documents that each round adds to what a view labels for the other.
SHARE = 0.05
RIDGE = 2.0
#: Buckets of sources, languages and words, whatever their number; bins of the histogram of probabilities.
SOURCES, LANGS, WORDS, BINS = 32, 16, 64, 1000
CONTENT = ["mean_word_length", "stop_word_ratio", "repeat_word_ratio", "ellipsis_line_ratio"]
PAGE = ["log_words", "log_lines", "log_line_length", "symbol_ratio", "dup_line_ratio", "bullet_line_ratio"]
COLUMNS = [*CONTENT, "words", *PAGE, "source_bucket", "lang_bucket"]


@arrow_udf(ArrayType(FloatType()))
def word_shares(texts: pa.Array) -> pa.Array:
    """Square roots of the shares that the words of a text have in each of WORDS buckets; zeros without words."""
    out = np.zeros((len(texts), WORDS), np.float32)
    for i, text in enumerate(texts.cast(pa.binary())):
        counts = Counter((text.as_py() or b"").lower().split())
        if counts:
            place = np.fromiter((crc32(w) % WORDS for w in counts), np.int64, len(counts))
            share = np.bincount(place, np.fromiter(counts.values(), np.float64, len(counts)), WORDS)
            out[i] = np.sqrt(share / share.sum())
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WORDS)
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, one column per feature, words as an array, source and language as buckets of a hash) per row of docs."""

    def bucket(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(n)).cast("int")

    carry = {"source_bucket": bucket(source_col, SOURCES), "lang_bucket": bucket(lang_col, LANGS), "words": word_shares(text_of(text_col))}
    m = quality_rules.measures(docs, id_col, text_col, carry)
    per_line = (F.col("word_chars") + F.col("n_words")) / F.greatest(F.col("n_lines"), F.lit(1))
    m = m.withColumn("log_words", F.log1p("n_words")).withColumn("log_lines", F.log1p("n_lines"))
    m = m.withColumn("log_line_length", F.log1p(per_line))
    return m.select(F.col(id_col).alias("id"), *COLUMNS)


def matrices(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two views of some rows, with a column of ones each; buckets as indicators."""
    one = np.ones((len(rows), 1))
    content, page = (np.nan_to_num(rows[c].to_numpy(np.float64)) for c in (CONTENT, PAGE))
    source = np.eye(SOURCES)[rows["source_bucket"].to_numpy(int)]
    lang = np.eye(LANGS)[rows["lang_bucket"].to_numpy(int)]
    # Differences from typical values matter on both sides, so squares go along.
    words = np.stack(rows["words"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, WORDS))
    return np.hstack([one, content, content**2, words]), np.hstack([one, page, page**2, source, lang])


def _summed(table: DataFrame, size: int, make: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a vector that `make` gives for some of them."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for f in frames:
            total += make(f)
        yield pd.DataFrame({"place": np.arange(size), "value": total})

    sums = table.mapInPandas(parts, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["place"]] = r["value"]
    return out


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrainer:
    """Two logistic regressions, their scales, and the bounds beyond which each labels documents for the other."""

    def __init__(self, table: DataFrame, prior: float):
        self.table, self.prior = table, prior
        self.widths = [1 + 2 * len(CONTENT) + WORDS, 1 + 2 * len(PAGE) + SOURCES + LANGS]
        sizes = self.widths

        def moments(f: pd.DataFrame) -> np.ndarray:
            return np.concatenate([np.concatenate([x.sum(0), (x**2).sum(0)]) for x in matrices(f)])

        sums, self.scales = _summed(table, 2 * sum(sizes), moments), []
        at, n = 0, max(1.0, sums[0])
        for w in sizes:
            mean, square = sums[at : at + w] / n, sums[at + w : at + 2 * w] / n
            spread = np.sqrt(np.maximum(square - mean**2, 0))
            mean[0], spread[0] = 0.0, 1.0
            self.scales.append((mean, np.where(spread > 1e-9, spread, 1.0)))
            at += 2 * w
        self.rows = n
        self.betas = [np.zeros(w) for w in sizes]
        self.bounds: list[tuple[float, float]] | None = None

    def state(self) -> tuple:
        return self.scales, [b.copy() for b in self.betas], self.bounds

    def train(self, share: float) -> None:
        """One round: newton steps on true labels and on what the other view labelled under the round before."""
        before = self.state()
        for _ in range(STEPS):
            self.betas = self._step(before)
        self.bounds = self._bounds(share)

    def _step(self, before: tuple) -> list[np.ndarray]:
        scales, betas, widths = self.scales, self.betas, self.widths

        def sums(f: pd.DataFrame) -> np.ndarray:
            views = scaled(f, scales)
            # Rows kept for calibration are no labelled rows here, and get no label from a view either.
            known = np.where(f["role"].to_numpy() == "train", f["label"].fillna(-1).to_numpy(float), -1.0)
            open_ = f["role"].to_numpy() == "none"
            guesses = guess(views, before) if before[2] else None
            out = []
            for v, x in enumerate(views):
                y = known.copy()
                if guesses is not None:
                    y = np.where(open_, guesses[1 - v], y)
                used = y >= 0
                # True labels weigh as much as pseudo-labels do, whatever their numbers: the driver normalises.
                for rows in (used & ~open_, used & open_):
                    xs, ys = x[rows], y[rows]
                    p = _probability(xs @ betas[v])
                    out += [xs.T @ (ys - p), ((xs * (p * (1 - p))[:, None]).T @ xs).ravel(), np.array([rows.sum()])]
            return np.concatenate(out)

        size = sum(2 * (w + w * w + 1) for w in widths)
        total, at, made = _summed(self.table, size, sums), 0, []
        for w, beta in zip(widths, betas, strict=True):
            gradient, curve, labelled = np.zeros(w), np.zeros((w, w)), 0.0
            for pseudo in (False, True):
                g, h, n = total[at : at + w], total[at + w : at + w + w * w].reshape(w, w), total[at + w + w * w]
                at += w + w * w + 1
                labelled = labelled if pseudo else n
                weight = min(1.0, labelled / n) if pseudo and n else 1.0
                gradient, curve = gradient + weight * g, curve + weight * h
            penalty = np.diag([1e-6] + [RIDGE * max(1, w // 32)] * (w - 1))
            made.append(beta + np.linalg.solve(curve + penalty, gradient - penalty @ beta))
        return made

    def _bounds(self, share: float) -> list[tuple[float, float]]:
        """For each view the probabilities below and above which the share of all documents lies, split by the prior."""
        scales, betas = self.scales, self.betas

        def histogram(f: pd.DataFrame) -> np.ndarray:
            out = []
            for x, beta in zip(scaled(f, scales), betas, strict=True):
                out.append(np.bincount((_probability(x @ beta) * BINS).astype(int), minlength=BINS + 1))
            return np.concatenate(out).astype(float)

        counts = _summed(self.table, 2 * (BINS + 1), histogram).reshape(2, BINS + 1)
        out = []
        for c in counts:
            low, high = share * (1 - self.prior) * c.sum(), share * self.prior * c.sum()
            below = int(np.searchsorted(np.cumsum(c), low))
            above = BINS - int(np.searchsorted(np.cumsum(c[::-1]), high))
            out.append((min(below / BINS, 0.5), max(above / BINS, 0.5)))
        return out

    def calibrate(self) -> list[tuple[float, float]]:
        """For each view (a, b): a + b * log odds, fitted on the labelled rows that were kept from training."""
        scales, betas = self.scales, self.betas
        fits = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]
        for _ in range(10):
            now = [f.copy() for f in fits]

            def sums(f: pd.DataFrame, now: list[np.ndarray] = now) -> np.ndarray:
                f = f[f["role"] == "calibrate"]
                y, out = f["label"].to_numpy(float), []
                for x, beta, fit in zip(scaled(f, scales), betas, now, strict=True):
                    z = np.column_stack([np.ones(len(f)), np.clip(x @ beta, -30, 30)])
                    p = _probability(z @ fit)
                    out += [z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]
                return np.concatenate(out)

            total = _summed(self.table.where("role = 'calibrate'"), 12, sums).reshape(2, 6)
            for v, t in enumerate(total):
                pull = fits[v] - np.array([0.0, 1.0])
                fits[v] = fits[v] + np.linalg.solve(t[2:].reshape(2, 2) + np.eye(2), t[:2] - pull)
        return [(float(a), float(b)) for a, b in fits]


def scaled(f: pd.DataFrame, scales: list) -> list[np.ndarray]:
    return [(x - mean) / spread for x, (mean, spread) in zip(matrices(f), scales, strict=True)]


def guess(views: list[np.ndarray], state: tuple) -> list[np.ndarray]:
    """What each view labels under a state: 1, 0, or -1 where it is not sure."""
    out = []
    for x, beta, (low, high) in zip(views, state[1], state[2], strict=True):
        p = _probability(x @ beta)
        out.append(np.where(p >= high, 1.0, np.where(p <= low, 0.0, -1.0)))
    return out


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    rounds: int = ROUNDS,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, held_out, score, content_score, page_score, kept) per row of docs; kept if the score reaches the threshold.

    Labels of held-out rows are never read; of the others a quarter calibrates. Null and empty texts have all features 0.
    Repeated rows and null ids keep their rows; a null source or language is a value of its own. Without labels of both
    classes every score is 0.5 and every row is kept; a score equal to the threshold keeps; of several labels of an id the larger
    counts. Texts of any length are read whole in their row; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    named = named.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    table = features(docs, id_col, text_col, source_col, lang_col).join(named, "id", "left")
    apart = F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, "calibrate").otherwise("train")
    role = F.when(F.col("label").isNotNull(), apart).when(held_out("id"), "held").otherwise("none")
    table = materialize(table.withColumn("role", role), "cotraining")
    counts = {r["label"]: r["count"] for r in table.where("role = 'train'").groupBy("label").count().collect()}
    out = table.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), *COLUMNS)
    if not counts.get(0) or not counts.get(1):
        half = F.lit(0.5)
        return out.select(
            id_col, "held_out", half.alias("score"), half.alias("content_score"), half.alias("page_score"), F.lit(True).alias("kept")
        )
    prior = counts[1] / (counts[0] + counts[1])
    trainer = CoTrainer(table, prior)
    for r in range(rounds + 1):
        trainer.train(SHARE * (r + 1))
    fits, scales, betas = trainer.calibrate(), trainer.scales, trainer.betas
    base = math.log(prior / (1 - prior))

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            odds = [
                a + b * np.clip(x @ beta, -30, 30)
                for x, beta, (a, b) in zip(scaled(f, scales), betas, fits, strict=True)
            ]
            both = _probability(odds[0] + odds[1] - base)
            yield pd.DataFrame(
                {
                    id_col: f[id_col],
                    "held_out": f["held_out"],
                    "score": both,
                    "content_score": _probability(odds[0]),
                    "page_score": _probability(odds[1]),
                    "kept": both >= threshold,
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInPandas(
        judged, f"`{id_col}` {kind}, held_out boolean, score double, content_score double, page_score double, kept boolean"
    )
