"""Context of a citation on its page: tokens, position and the words before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions.core import ColumnOrName, col, cut_runs, let, matches, settle, substrings
from refloom.session import materialize

# Number of words before a citation, and single characters that stay tokens.
NEIGHBORS = 40
KEPT_SIGNS = list(":?@-.!")
RARE_LIMIT = 4
UNKNOWN = "<UNK>"
#: Bits of a table of word hashes.
SLOTS = 1 << 20

_TOKEN = r"[A-Za-zÀ-ɏͰ-ӿ0-9][\w'’À-ɏͰ-ӿ-]*|[^\s\w]"
_SKIPPED = r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|\[\[[^\[\]]*\]\]|\[[a-z]+:[^\s\[\]]*|={2,6}[^\n=]+={2,6}"


def word_tokens(text: ColumnOrName) -> Column:
    """Words and single signs of plain text."""
    return F.regexp_extract_all(col(text), F.lit(_TOKEN), F.lit(0))


def page_tokens(text: ColumnOrName) -> Column:
    """Token stream of a page: the text of an outermost template is one token, links, headings, tags and comments
    are skipped, other text is cut into words and signs."""
    c = col(text)

    def cut(spans: Column) -> Column:
        between = F.transform(
            F.sequence(F.lit(0), F.size(spans)),
            lambda i: F.struct(
                F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]).alias("start"),
                F.when(i == F.size(spans), F.length(c)).otherwise(F.get(spans, i)["start"]).alias("end"),
            ),
        )

        def tokens(gap: Column, i: Column) -> Column:
            words = word_tokens(F.regexp_replace(gap, _SKIPPED, " "))
            return F.when(i < F.size(spans), F.concat(words, F.array(F.get(spans, i)["text"]))).otherwise(words)

        return F.flatten(F.transform(substrings(c, between), tokens))

    return let(B.outermost(B.template_spans(c)), cut)


def clean_tokens(tokens: ColumnOrName) -> Column:
    """Quotes, brackets, accents, bars and commas in a word become blanks, `//` goes; templates stay."""
    return F.transform(
        col(tokens),
        lambda t: F.when(t.startswith("{{"), t).otherwise(
            F.regexp_replace(F.replace(F.regexp_replace(t, r"[\"\[\\\]^`|~]+", " "), F.lit(","), F.lit(" ")), "//", "")
        ),
    )


def filter_tokens(tokens: ColumnOrName) -> Column:
    """Tokens of two characters or more, and a few single signs."""
    return F.filter(col(tokens), lambda t: (F.length(t) > 1) | t.isin(*KEPT_SIGNS))


def token_tag(token: Column) -> Column:
    """Coarse word class: WIKICODE, NUM, PUNCT, CAP or WORD."""
    return (
        F.when(token.startswith("{{"), "WIKICODE")
        .when(matches(token, r"^[0-9][0-9.,:%-]*$"), "NUM")
        .when(matches(token, r"^[^\w\s]+$"), "PUNCT")
        .when(matches(token, r"^\p{Lu}"), "CAP")
        .otherwise("WORD")
    )


def tag_tokens(tokens: ColumnOrName) -> Column:
    """`array<struct<word,tag>>`."""
    return F.transform(col(tokens), lambda t: F.struct(t.alias("word"), token_tag(t).alias("tag")))


def token_rows(pages: DataFrame, content: str = "content", tokens: Column | None = None) -> DataFrame:
    """One row per kept token with its class and position (from 0)."""
    stream = filter_tokens(clean_tokens(page_tokens(content) if tokens is None else tokens))
    keep = [c for c in pages.columns if c != content]
    return pages.select(*keep, F.posexplode(stream).alias("pos", "token")).withColumn("tag", token_tag(F.col("token")))


def context_features(
    pages: DataFrame, content: str = "content", n: int = NEIGHBORS, page_id: str = "page_id"
) -> DataFrame:
    """One row per citation occurrence on a page: place of its first occurrence, page length in tokens and the up
    to `n` words before it.

    Everything is read from the token array inside the row, so there is neither a window nor a shuffle. Templates are
    sorted by text once, which gives the first place of each, so a page costs n log n. Only templates that are tokens, the outermost ones, have a place.
    """
    keep = [c for c in pages.columns if c != content]
    stream = filter_tokens(clean_tokens(page_tokens(content)))

    def features(tokens: Column) -> Column:
        placed = F.transform(tokens, lambda t, i: F.struct(t.alias("citation"), i.alias("at")))
        found = F.array_sort(F.filter(placed, lambda x: x["citation"].startswith("{{")))

        def same(run: Column) -> Column:
            # Occurrences of one text, the first in front.
            first = F.get(run, F.lit(0))["at"]
            return let(
                F.struct(
                    F.get(run, F.lit(0))["citation"].alias("citation"),
                    first.alias("ref_index"),
                    F.size(tokens).alias("total_words"),
                    tag_tokens(
                        F.slice(tokens, F.greatest(first - n, F.lit(0)) + 1, F.least(first, F.lit(n)))
                    ).alias("neighbors"),
                ),
                lambda f: F.transform(run, lambda x: F.struct(x["at"].alias("at"), f.alias("f"))),
            )

        runs = cut_runs(found, lambda x, before: x["citation"] != before["citation"])
        every = F.flatten(F.transform(runs, same))
        # Back in the order of the page; places differ, so nothing behind them is compared.
        return F.transform(F.array_sort(every, lambda x, y: x["at"] - y["at"]), lambda x: x["f"])

    return pages.select(*keep, F.explode(let(stream, features)).alias("citations_features"))


def explode_features(base: DataFrame) -> DataFrame:
    """Flat columns of `context_features`."""
    keep = [c for c in base.columns if c != "citations_features"]
    f = F.col("citations_features")
    return base.select(
        *keep,
        f["citation"].alias("retrieved_citation"),
        f["ref_index"].alias("ref_index"),
        f["total_words"].alias("total_words"),
        f["neighbors"]["word"].alias("neighboring_words"),
        f["neighbors"]["tag"].alias("neighboring_tags"),
    )


def lowercase_words(df: DataFrame, words: str = "neighboring_words") -> DataFrame:
    return df.withColumn(words, F.transform(words, lambda w: F.lower(w)))


def word_counts(df: DataFrame, words: str) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _slot(word: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), word), F.lit(SLOTS)).cast("int")


def _bitmap(words: DataFrame, salt: int) -> bytes:
    """One bit per slot of a hash, set if one of the words of the column `word` falls there: SLOTS / 8 bytes at any size."""
    slot = _slot(F.col("word"), salt)
    bit = F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)))
    rows = words.groupBy(F.shiftright(slot, 3).alias("byte")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(SLOTS // 8, np.uint8)
    table[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return table.tobytes()


def _in_bitmap(table: bytes, word: Column, salt: int) -> Column:
    def test(slot: Column) -> Column:
        byte = F.ascii(F.decode(F.substr(F.lit(table), F.shiftright(slot, 3) + 1, F.lit(1)), "ISO-8859-1"))
        return F.getbit(byte, slot.bitwiseAND(F.lit(7))) == 1

    return let(_slot(word, salt), test)


def unk_rare_words(df: DataFrame, key: str, words: str = "neighboring_words", threshold: int = RARE_LIMIT):
    """Words seen at most `threshold` times become `<UNK>`; an empty list becomes [`<UNK>`].

    `df` is written once, so its lists are made once, and they stay in their rows. Occurrences are counted in each task before
    anything is moved. A table of bits, of fixed size, holds the slots of the frequent words: a word that misses it
    is rare, which most rare words show in their own row. The few rare words that share a slot with a frequent one are
    doubtful; a second table of bits picks their occurrences, and only those meet the counts and are gathered per key.
    """
    staged = materialize(df, "words")
    counts = materialize(word_counts(staged, words), "word-counts")
    frequent = _bitmap(counts.where(F.col("n") > threshold), 1)
    doubtful = counts.where((F.col("n") <= threshold) & _in_bitmap(frequent, F.col("word"), 1)).select("word")
    doubt = _bitmap(doubtful, 2)
    unsure = F.filter(words, lambda w: _in_bitmap(doubt, w, 2) & _in_bitmap(frequent, w, 1))
    own = staged.select(key, F.explode(F.array_distinct(unsure)).alias("word")).join(doubtful, "word")
    lists = materialize(own.groupBy(key).agg(F.collect_set("word").alias("_rare")), "doubtful-words")
    none = F.array().cast("array<string>")
    joined = staged.join(lists, key, "left").withColumn("_rare", F.coalesce("_rare", none))
    known = F.transform(
        words,
        lambda w: F.when(~_in_bitmap(frequent, w, 1), UNKNOWN).when(F.array_contains("_rare", w), UNKNOWN).otherwise(w),
    )
    filled = F.when(F.coalesce(F.size(words), F.lit(0)) > 0, known).otherwise(F.array(F.lit(UNKNOWN)))
    return settle(joined.withColumn(words, filled), [words]).select(*df.columns)


def top_sections(df: DataFrame, sections: str = "sections", k: int = 150) -> DataFrame:
    """Most frequent sections; equal counts in alphabetic order."""
    return (
        df.select(F.explode(sections).alias("section_name"))
        .groupBy("section_name")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "section_name")
        .limit(k)
    )


def encode_sections(df: DataFrame, top: list[str], sections: str = "sections") -> DataFrame:
    """One 0/1 column per top section plus `others`, and the list itself dropped."""
    known = F.array(*[F.lit(t) for t in top])
    mapped = F.array_distinct(
        F.transform(sections, lambda s: F.when(F.array_contains(known, s), s).otherwise("others"))
    )
    staged = df.withColumn("_s", mapped)
    return staged.select(
        *[c for c in df.columns if c != sections],
        *[F.array_contains("_s", t).cast("int").alias(t) for t in [*top, "others"]],
    )


def encode_citation_type(df: DataFrame, types: list[str], column: str = "citation_type") -> DataFrame:
    """One 0/1 column per type."""
    return df.select(
        *[c for c in df.columns if c != column], *[(F.col(column) == t).cast("int").alias(t) for t in types]
    )


# Word classes that are folded into one.
OTHER_TAGS = ["LS", "``", "''", "$"]


def encode_tags(df: DataFrame, tags: list[str], column: str = "neighboring_tags") -> DataFrame:
    """Count of every tag as a column; list marks, quotes and dollar signs count as `others`."""
    folded = F.transform(column, lambda t: F.when(t.isin(*OTHER_TAGS), "others").otherwise(t))
    staged = df.withColumn("_t", folded)

    def count(tag: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == tag)).alias(tag)

    return staged.select(*[c for c in df.columns if c != column], *[count(k) for k in [*tags, "others"]])


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)


def join_features(citations: DataFrame, features: DataFrame, page: str = "id", text: str = "citations") -> DataFrame:
    """Citations with the context of the same text on the same page.

    The long texts are compared, the shuffle key is their hash together with the page. See `join_features_bucketed` for stages that
    are joined more than once.
    """
    left = citations.withColumn("_h", F.xxhash64(page, text))
    right = features.withColumn("_h", F.xxhash64("page_id", "retrieved_citation"))
    return left.join(
        right,
        (left["_h"] == right["_h"])
        & (left[page] == right["page_id"])
        & (left[text] == right["retrieved_citation"]),
        "inner",
    ).drop("_h")


def join_features_bucketed(citations: DataFrame, features: DataFrame, page: str = "id", text: str = "citations") -> DataFrame:
    """The rows of `join_features`, from two stages that `bucketed_stage` has written by page and text: no shuffle.

    All occurrences of a text on a page have the same context, so the context is one row with a count in the join, and a
    text that stands k times there gives k rows of it; the k * k rows that pair them all are made after it.
    """
    rest = [c for c in features.columns if c not in ("page_id", "retrieved_citation")]
    once = features.groupBy("page_id", "retrieved_citation").agg(*[F.first(c).alias(c) for c in rest], F.count("*").alias("_times"))
    met = citations.join(once, (citations[page] == once["page_id"]) & (citations[text] == once["retrieved_citation"]))
    pairs = met.select(*[met[c] for c in met.columns if c != "_times"], F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_"))
    return pairs.drop("_")


def join_selected(features: DataFrame, labelled: DataFrame, text: str = "citations") -> DataFrame:
    """Context of every labelled citation text, wherever it stands.

    The shuffle key is the hash of the text, the texts are compared after it. One text may stand on very many pages: the
    features side of the join is the one that Spark's skew handling (which must stay on) splits, while a labelled text is
    one row.
    """
    left = features.withColumn("_h", F.xxhash64("retrieved_citation"))
    right = labelled.withColumn("_h", F.xxhash64(text))
    return left.join(
        right, (left["_h"] == right["_h"]) & (left["retrieved_citation"] == right[text]), "inner"
    ).drop("_h")
