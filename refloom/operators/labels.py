"""Identifier columns, rule labels and news domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.core import in_list, is_set, join_key, settle
from refloom.functions.fields import legacy_id_pairs
from refloom.functions.urls import ending, host_labels, is_google_book, label_before, top_domain
from refloom.session import materialize
from refloom.tables.params import ID_KINDS

KINDS = list(ID_KINDS)


def with_ids(df: DataFrame, ids: str = "ID_list") -> DataFrame:
    """Rows that have identifiers, full duplicates removed.

    Maps cannot be compared, so the rows are grouped with the map as sorted entries.
    """
    keep = df.columns
    some = df.where(F.size(ids) > 0).withColumn(ids, F.array_sort(F.map_entries(ids)))
    return some.dropDuplicates().withColumn(ids, F.map_from_entries(ids)).select(*keep)


def parse_id_text(df: DataFrame, text: str = "ID_list") -> DataFrame:
    """Text form of the identifiers to a map; values keep commas, colons and equal signs."""
    return df.withColumn(text, legacy_id_pairs(text))


def with_id_kinds(df: DataFrame, ids: str = "ID_list") -> DataFrame:
    return df.withColumn("kinds_of_ids", F.array_sort(F.map_keys(ids)))


def id_kinds(df: DataFrame, ids: str = "ID_list") -> DataFrame:
    """Kinds that occur, with their counts."""
    return df.select(F.explode(F.map_keys(ids)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def id_columns(df: DataFrame, ids: str = "ID_list") -> DataFrame:
    """One column per kind, null where absent; the kinds are a fixed list, so nothing is collected first."""
    return df.select("*", *[F.try_element_at(ids, F.lit(k)).alias(k) for k in KINDS])


def rule_label(ids: Column, type_of_citation: Column) -> Column:
    """book / journal / other from the identifiers, later rules override earlier ones."""
    has = {k: is_set(F.try_element_at(ids, F.lit(k))) for k in ("DOI", "PMID", "PMC", "ISBN")}
    pubmed = has["PMID"] | has["PMC"]
    both = has["ISBN"] & has["DOI"]
    return (
        F.when(both & in_list(type_of_citation, ["cite journal", "cite conference"]), "journal")
        .when(both & in_list(type_of_citation, ["cite book", "cite encyclopedia"]), "book")
        .when(pubmed, "journal")
        .when(has["DOI"] & ~has["ISBN"], "journal")
        .when(has["ISBN"] & ~has["DOI"], "book")
        .otherwise("other")
    )


def label_book_journal(df: DataFrame, ids: str = "ID_list", type_column: str = "type_of_citation") -> DataFrame:
    return settle(df.withColumn("actual_label", rule_label(F.col(ids), F.col(type_column))), ["actual_label"])


def label_at_prediction(
    df: DataFrame, news: DataFrame, ids: str = "ID_list", citation: str = "citations"
) -> DataFrame:
    """Rule label before a model is asked: web for citations in the news table, then by identifier."""
    marked = mark_members(df, news.select(citation).distinct(), citation, "_in_news")
    has = {k: is_set(F.try_element_at(ids, F.lit(k))) for k in ("DOI", "PMID", "PMC", "ISBN")}
    label = (
        F.when(F.col("_in_news"), "web")
        .when(has["PMC"] | has["PMID"], "journal")
        .when(has["DOI"], "journal")
        .when(has["ISBN"], "book")
        .otherwise("NO LABEL")
    )
    return marked.withColumn("needs_a_label", label).drop("_in_news")


def mark_members(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Flag rows whose key is in a one-column set of distinct keys. Strategy and skew are left to the planner."""
    tagged = members.select(F.col(members.columns[0]).alias(key)).withColumn(flag, F.lit(True))
    return df.join(tagged, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def split_labelled(df: DataFrame, label: str = "actual_label", none: str = "other") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label) != none), df.where(F.col(label) == none)


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """(rule, size, kind) of a public suffix list in the first column, as usually written: comments and blank lines go,
    `*.x` is a wildcard, `!y.x` an exception from one; a rule of one label says nothing new."""
    line = F.lower(F.regexp_extract(F.col(suffixes.columns[0]), r"^\s*(?!//)(\S+)", 1))
    rules = suffixes.select(line.alias("rule")).where((F.col("rule") != "") & F.col("rule").contains(".")).distinct()
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    return rules.select("rule", F.size(F.split("rule", r"\.")).alias("size"), kind.alias("kind"))


def with_domain(df: DataFrame, url: str = "URL", suffixes: DataFrame | None = None) -> DataFrame:
    """Add `tld`, the registered name of the address.

    suffixes: a public suffix list. Every ending that a rule of the list could have is looked up by an equality join, and the
    longest rule found wins, an exception over all. There is one join per kind and number of labels that occur in the list
    (some five); Spark broadcasts the list by its measured size or shuffles, and hosts too short for a rule are spread.
    """
    if suffixes is None:
        return df.withColumn("tld", top_domain(url))
    rules = materialize(suffix_rules(suffixes), "suffixes")
    kinds = [(r.kind, r.size) for r in rules.groupBy("kind", "size").count().collect()]  # some five rows
    out = settle(df.withColumn("_labels", host_labels(url)), ["_labels"])
    found = []
    for i, (kind, size) in enumerate(sorted(kinds)):
        if kind == "wildcard":
            asked = F.concat(F.lit("*."), ending(F.col("_labels"), size - 1))
        else:
            asked = F.concat(F.lit("!" if kind == "exception" else ""), ending(F.col("_labels"), size))
        long = F.size("_labels") >= size
        listed = rules.where((F.col("kind") == kind) & (F.col("size") == size)).select(
            F.col("rule").alias("_asked"), F.lit(size - 1 if kind == "exception" else size).alias(f"_size{i}")
        )
        out = out.withColumn("_asked", join_key(long, asked, url, *_id_columns(df))).join(listed, "_asked", "left").drop("_asked")
        found.append((kind, f"_size{i}"))
    exceptions = [F.col(c) for k, c in found if k == "exception"]
    others = [F.col(c) for k, c in found if k != "exception"]
    size = F.coalesce(*exceptions, F.greatest(F.lit(1), F.lit(1), *others))
    return out.withColumn("tld", label_before(F.col("_labels"), size)).drop("_labels", *[c for _, c in found])


def label_news(df: DataFrame, domains: DataFrame, url: str = "URL", suffixes: DataFrame | None = None) -> DataFrame:
    """`other` citations whose domain is in the set become news. `suffixes`: see `with_domain`.

    Only rows that can change carry the domain as join key. The few ten thousand names of the usual lists are
    broadcast by their measured size; a larger set is joined by shuffle, where the rows without a key are spread
    and the planner splits a domain that holds very many rows.
    """
    names = domains.select(F.col(domains.columns[0]).alias("_domain")).distinct().withColumn("_news", F.lit(True))
    can_change = (F.col("actual_label") == "other") & (F.col("tld") != "")
    staged = settle(with_domain(df, url, suffixes), ["tld"])
    labelled = staged.withColumn("_domain", join_key(can_change, F.col("tld"), url, *_id_columns(staged)))
    joined = labelled.join(names, "_domain", "left")
    return joined.withColumn(
        "actual_label", F.when(F.col("_news"), "news").otherwise(F.col("actual_label"))
    ).drop("_domain", "_news")


def _id_columns(df: DataFrame) -> list[str]:
    """Columns that tell rows apart, for spreading them."""
    return [c for c in ("page_id", "id", "citation", "citations") if c in df.columns]


def build_domain_set(*sources: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Distinct domain names of several lists with an address in their first column. `suffixes`: see `with_domain`."""
    addresses = reduce(DataFrame.unionByName, [s.select(F.col(s.columns[0]).alias("address")) for s in sources])
    names = with_domain(addresses, "address", suffixes).select(F.col("tld").alias("domain"))
    return names.where(F.col("domain") != "").distinct()


def label_counts(df: DataFrame, label: str = "actual_label") -> DataFrame:
    """Citations per label in one pass."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def label_totals(df: DataFrame, label: str = "actual_label") -> DataFrame:
    """Totals for all, book, journal and news as one row."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(label) == k).alias(f"{k}s") for k in ("book", "journal", "news")],
    )


def google_book_counts(df: DataFrame, url: str = "URL", label: str = "actual_label") -> DataFrame:
    return (
        df.where(is_google_book(url)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    )


def labels_cube(df: DataFrame, part: str, type_column: str = "type_of_citation", label: str = "actual_label"):
    """Counts by part, type and label with all subtotals."""
    return df.cube(F.col(part).alias("part"), F.col(type_column).alias("type"), F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )


def news_share(df: DataFrame, url_domain: str = "tld", label: str = "actual_label") -> DataFrame:
    """Per domain and in total: citations and how many are news."""
    return df.rollup(F.col(url_domain).alias("domain")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == "news").alias("n_news")
    )
