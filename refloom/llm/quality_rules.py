"""Quality rules: a threshold table compiled into one projection of ratios. No user function, no shuffle.

A rule names a measure and the range in which a document is kept. `compile_rules` turns the table into one boolean
column; the measures are built-in expressions over the row, so a document of any length is judged in its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.core import settle
from refloom.llm.common import BLANK_CLASS, BLANKS, WORD_CLASS, text_of

#: Common function words of English, German, French and Spanish.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that it for on with as be by this was are or from at not have an which "
        "der die das und ist von mit zu den dem des ein eine einer nicht auf für als im sich auch er sie es "
        "le la les de du un une et est que qui dans pour par sur pas au aux avec ce il elle ne se plus "
        "el los las y en por con del no su una lo como más pero sus al".split()
    )
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document is kept if least <= measure <= most."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are taken per word, per character of words, or per line with a word.
RULES = (
    Rule("n_words", least=50, most=100_000),
    Rule("mean_word_length", least=2.5, most=12.0),
    Rule("symbol_ratio", most=0.05),
    Rule("stop_word_ratio", least=0.06),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("repeat_word_ratio", most=0.5),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column over the measures: true if every rule of the table holds."""
    kept = F.lit(True)
    for r in rules:
        if r.least is not None:
            kept = kept & (F.col(r.measure) >= F.lit(r.least))
        if r.most is not None:
            kept = kept & (F.col(r.measure) <= F.lit(r.most))
    return kept


def _repeat_words(words: Column) -> tuple[Column, Column, Column]:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are 64-bit hashes (two windows of one text colliding: below 1e-10 for 50 000 words). Most texts repeat none,
    which a hash set tells. Otherwise windows are sorted with their places, those equal to a neighbour are kept, and
    the covered words are counted from the distances of consecutive places: n log n in the length of the text.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    placed = F.sort_array(F.transform(F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.filter(
        F.col("_placed"),
        lambda x, k: (F.get(F.col("_placed"), k - 1)["h"] == x["h"]) | (F.get(F.col("_placed"), k + 1)["h"] == x["h"]),
    )
    return hashes, placed, repeated


def _ends(line: Column) -> Column:
    bare = F.rtrim(line, F.lit(BLANKS))
    return bare.endswith("...") | bare.endswith("…")


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """The id and every measure, one row per row of docs. A null text counts as empty; ratios of nothing are 0.

    carry: further columns of docs to take along, by the names they get.
    """
    carry = carry or {}
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), *[c.alias(k) for k, c in carry.items()])
    # Parts between single blanks: the words and an empty text for each further blank.
    base = base.withColumn("_parts", F.split("_t", BLANK_CLASS))
    base = base.withColumn("_w", F.filter("_parts", lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CLASS))
    base = base.withColumn("_lines", lines).withColumn("n_words", F.size("_w").cast("long"))
    hashes, placed, repeated = _repeat_words(F.col("_w"))
    empty = F.array().cast("array<bigint>")
    base = base.withColumn("_hashes", F.when(F.col("n_words") >= 4, hashes).otherwise(empty))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    base = base.withColumn("_placed", F.when(some, placed).otherwise(none))
    base = base.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    stops = F.size(
        F.filter(F.col("_w"), lambda w: F.rtrim(F.lower(w), F.lit(".,;:")).isin(STOP_WORDS))
    )
    out = base.select(
        F.col("_id").alias(id_col),
        *carry,
        "n_words",
        (F.length("_t") - F.size("_parts") + 1).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        stops.cast("long").alias("n_stop_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*(?:[-*•‣◦]|[0-9]+[.)])\x20"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_lines", _ends)).cast("long").alias("n_ellipses"),
    )

    def per(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))

    return out.withColumns(
        {
            "mean_word_length": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "word_chars"),
            "stop_word_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "bullet_line_ratio": per("n_bullets", "n_lines"),
            "ellipsis_line_ratio": per("n_ellipses", "n_lines"),
            "repeat_word_ratio": per("n_repeat_words", "n_words"),
        }
    )


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures with base_failed (too short, or mostly repeated windows) and kept (not base_failed and all rules hold).

    One row per row of docs, repeated rows and null ids included; null or empty texts have all measures 0, fail the base
    and are not kept. A measure that lies on a bound of its rule passes. Texts of any length are judged in their row; an empty table
    gives no rows. Columns of docs besides id and text are ignored, whatever their names.
    """
    measured = measures(docs, id_col, text_col)
    # Through a generator, so that a filter on the result does not pull copies of the measures below the projections.
    return (
        settle(measured, [c for c in measured.columns if c != id_col])
        .withColumn("base_failed", _failed())
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that `judge` keeps, with the columns of docs and nothing else."""
    judged = measures(docs, id_col, text_col, {"_row": F.struct(*[F.col(c) for c in docs.columns])})
    verdict = judged.select("_row", (~_failed() & compile_rules(rules)).alias("_kept"))
    # Through a generator, so that the filter does not pull copies of the measures below the projections.
    return settle(verdict, ["_kept"]).where("_kept").select("_row.*")
