"""Matching citations to bibliographic records that an outside catalogue returned as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refloom.functions.core import ColumnOrName, col, is_set, join_key, let, settle
from refloom.functions.similarity import THRESHOLD, may_reach, ratio_if, similarity_ratio
from refloom.session import materialize

# Types worth a look-up, batch size, results kept and the marker for no result.
LOOKUP_TYPES = ["cite book", "cite journal", "cite encyclopedia", "cite proceedings"]
BATCH = 75
TOP_RESULTS = 3
NO_RESULT = "No result was found in CrossRef"
BOOKS_QUERY = "https://www.googleapis.com/books/v1/volumes?q="
WORKS_QUERY = "https://api.crossref.org/works"

ID = "struct<type:string,value:string>"

_BOOKS_SCHEMA = (
    "struct<items:array<struct<volumeInfo:struct<title:string,"
    "industryIdentifiers:array<struct<type:string,identifier:string>>>>>>"
)
_WORKS_SCHEMA = (
    "struct<message:struct<items:array<struct<DOI:string,ISBN:array<string>,PMID:string,PMC:string,title:array<string>>>>>"
)


def parse_books(json: ColumnOrName) -> Column:
    """Volumes of a book search response: `array<struct<title,ids>>`, in the order of the response."""
    parsed = F.from_json(col(json), _BOOKS_SCHEMA)["items"]["volumeInfo"]
    return F.transform(
        F.filter(parsed, lambda v: v.isNotNull()),
        lambda v: F.struct(
            v["title"].alias("title"),
            F.coalesce(
                F.transform(
                    v["industryIdentifiers"],
                    lambda i: F.struct(F.lower(i["type"]).alias("type"), i["identifier"].alias("value")),
                ),
                F.array().cast(f"array<{ID}>"),
            ).alias("ids"),
        ),
    )


def parse_works(json: ColumnOrName) -> Column:
    """Works of a publication search response: `array<struct<title,ids>>`; identifiers DOI, ISBN, PMID, PMC."""
    items = F.from_json(col(json), _WORKS_SCHEMA)["message"]["items"]

    def ids(w: Column) -> Column:
        values = {
            "DOI": w["DOI"],
            "ISBN": F.when(F.size(w["ISBN"]) > 0, F.array_join(w["ISBN"], ", ")),
            "PMID": w["PMID"],
            "PMC": w["PMC"],
        }
        return F.array_compact(
            F.array(
                *[
                    F.when(v.isNotNull(), F.struct(F.lit(k).alias("type"), v.alias("value")))
                    for k, v in values.items()
                ]
            )
        )

    return F.transform(items, lambda w: F.struct(F.try_element_at(w["title"], F.lit(1)).alias("title"), ids(w).alias("ids")))


def best_candidate(
    df: DataFrame, title: str, candidates: str, threshold: float = THRESHOLD, compared: str | None = None
) -> DataFrame:
    """Add `best` (title, ids, ratio) and `n_scanned`.

    Candidates are read in order up to the first one below the threshold; the highest ratio wins, the earlier one
    where two are equal. The scan is a fold whose state says whether it is still open: after the first miss nothing is
    computed, and a candidate that the bounds rule out ends the scan without its ratio. `compared` names a column that
    gets the number of ratios computed. A null list or title has no best; a candidate without title counts as the empty text.
    """
    number = F.lit(0).cast("int")
    start = F.struct(
        F.lit(True).alias("open"),
        number.alias("n"),
        number.alias("at"),
        F.lit(-1.0).alias("ratio"),
        number.alias("exact"),
    )

    def step(state: Column, c: Column) -> Column:
        other = F.coalesce(c["title"], F.lit(""))
        reaches = may_reach(title, other, threshold)
        judged = F.struct(reaches.alias("near"), F.when(reaches, similarity_ratio(title, other)).alias("ratio"))

        def after(j: Column) -> Column:
            good = F.coalesce(j["ratio"] >= threshold, F.lit(False))
            better = good & (j["ratio"] > state["ratio"])
            n = state["n"] + F.when(good, 1).otherwise(0)
            return F.struct(
                good.alias("open"),
                n.alias("n"),
                F.when(better, n).otherwise(state["at"]).alias("at"),
                F.when(better, j["ratio"]).otherwise(state["ratio"]).alias("ratio"),
                (state["exact"] + F.when(j["near"], 1).otherwise(0)).alias("exact"),
            )

        return F.when(state["open"], let(judged, after)).otherwise(state)

    placed = df.withColumn("_pick", F.aggregate(F.col(candidates), start, step))
    placed = settle(placed, ["_pick"]).withColumn("_found", F.when(F.col("_pick.at") > 0, F.get(F.col(candidates), F.col("_pick.at") - 1)))
    best = F.struct(F.col("_found.title").alias("title"), F.col("_found.ids").alias("ids"), F.col("_pick.ratio").alias("ratio"))
    placed = placed.withColumn("best", F.when(F.col("_found").isNotNull(), best))
    placed = placed.withColumn("n_scanned", F.coalesce(F.col("_pick.n"), F.lit(0)))
    if compared:
        placed = placed.withColumn(compared, F.coalesce(F.col("_pick.exact"), F.lit(0)))
    return placed.drop("_pick", "_found")


def first_candidate(df: DataFrame, title: str, candidates: str, threshold: float = THRESHOLD) -> DataFrame:
    """Add `best` from the first candidate only, when it is similar enough."""
    staged = df.withColumn("_first", F.try_element_at(F.col(candidates), F.lit(1)))
    scored = settle(staged.withColumn("_ratio", ratio_if(title, "_first.title", threshold)), ["_ratio"])
    return scored.withColumn(
        "best",
        F.when(
            F.col("_ratio").isNotNull(),
            F.struct(
                F.col("_first.title").alias("title"), F.col("_first.ids").alias("ids"), F.col("_ratio").alias("ratio")
            ),
        ),
    ).drop("_first", "_ratio")


def top_k_results(df: DataFrame, candidates: str, k: int = TOP_RESULTS) -> DataFrame:
    """Keep the first `k` candidates; rows without any get a message."""
    some = F.size(F.coalesce(F.col(candidates), F.array().cast(df.schema[candidates].dataType))) > 0
    return df.withColumns(
        {
            candidates: F.when(some, F.slice(F.col(candidates), F.lit(1), F.lit(k))),
            "message": F.when(~some, NO_RESULT),
        }
    )


def lookup_candidates(df: DataFrame, label: str = "actual_label", type_column: str = "type_of_citation") -> DataFrame:
    """Citations without a label whose type promises a record."""
    return df.where((F.col(label) == "other") & F.col(type_column).isin(*LOOKUP_TYPES))


def match_titles(titles: DataFrame, works: DataFrame, books: DataFrame, title: str) -> DataFrame:
    """Identifiers per distinct title: of the first publication record when it is similar enough, else of the best
    book record. Both response tables are (title, response) with one row per title that was asked."""
    answers = [
        t.select(F.col(t.columns[0]).alias(title), F.col(t.columns[1]).alias(name))
        for t, name in ((works, "_works"), (books, "_books"))
    ]
    both = answers[0].join(answers[1], title, "full_outer")
    asked = titles.select(title).where(is_set(F.col(title))).distinct().join(both, title, "inner")
    parsed = asked.withColumns({"_w": parse_works("_works"), "_b": parse_books("_books")})
    by_work = first_candidate(parsed, title, "_w").withColumnRenamed("best", "_work")
    by_book = best_candidate(by_work, title, "_b").withColumnRenamed("best", "_book")
    return by_book.select(
        title,
        F.when(F.size("_work.ids") > 0, F.col("_work.ids")).otherwise(F.col("_book.ids")).alias("acquired_ID_list"),
    )


def disambiguate(
    df: DataFrame, works: DataFrame, books: DataFrame, title: str = "Title", label: str = "actual_label"
) -> DataFrame:
    """Add `acquired_ID_list`: identifiers of the publication record, else of the book record, else empty.

    Only citations that qualify are looked up, each distinct title once, so a title shared by very many rows costs
    one look-up. `df` is read twice; give a stage table, not a plan that normalises citations on the way.
    """
    wanted = (
        (F.col(label) == "other") & F.col("type_of_citation").isin(*LOOKUP_TYPES) & is_set(F.col(title))
    )
    asked = df.where(wanted).select(F.col(title).alias("_title"))
    answers = match_titles(asked, works, books, "_title")
    keyed = df.withColumn("_title", join_key(wanted, F.col(title), *[c for c in ("page_id", "id", title) if c in df.columns]))
    return keyed.join(answers, "_title", "left").drop("_title").withColumn(
        "acquired_ID_list", F.coalesce("acquired_ID_list", F.array().cast(f"array<{ID}>"))
    )


def same_identifier(ids: ColumnOrName, acquired: ColumnOrName) -> Column:
    """One of the acquired identifiers is among the known ones."""
    return F.exists(col(acquired), lambda x: F.array_contains(F.map_values(col(ids)), x["value"]))


def request_params(df: DataFrame, key: str, title: str, author: str) -> DataFrame:
    """Query parameters per citation; without an author there is no request."""
    entries = F.array(
        F.struct(F.lit("query.bibliographic").alias("k"), F.col(title).alias("v")),
        F.struct(F.lit("query.author").alias("k"), F.col(author).alias("v")),
    )
    return df.where(F.col(author).isNotNull()).select(
        key, F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("params")
    )


def request_batches(df: DataFrame, *order: str, size: int = BATCH) -> DataFrame:
    """Number the rows in `order` and cut them into batches of `size`.

    `order` must tell rows apart. A single running number over all rows would put them into one task. Rows are
    sorted into ranges, each range counts its rows, and the running start of the ranges (one small row per range)
    is added back.
    """
    # The ranges are written once: a range number must not change when a lost task is computed again.
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select(
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.join(F.broadcast(starts), "_range").withColumn("row_no", F.col("_start") + within - 1)
    return numbered.withColumn("batch", F.floor(F.col("row_no") / size)).drop("_range", "_start")


def request_urls(
    title: ColumnOrName,
    author: ColumnOrName | None = None,
    publisher: ColumnOrName | None = None,
) -> dict[str, Column]:
    """Search addresses for a record: `books` by title, author and publisher, `works` by author and title."""
    t = col(title)
    books = F.concat(F.lit(BOOKS_QUERY), F.url_encode(t))
    works = F.lit(f"{WORKS_QUERY}?rows=1")
    if author is not None:
        a = F.url_encode(col(author))
        books = F.concat(books, F.coalesce(F.concat(F.lit("+inauthor:"), a), F.lit("")))
        works = F.concat(works, F.coalesce(F.concat(F.lit("&query.author="), a), F.lit("")))
    books = F.concat(books, F.lit("+intitle:"), F.url_encode(t))
    if publisher is not None:
        books = F.concat(books, F.coalesce(F.concat(F.lit("+inpublisher:"), F.url_encode(col(publisher))), F.lit("")))
    works = F.concat(works, F.lit("&query.title="), F.url_encode(t))
    return {"books": books, "works": works}


def id_request_url(kind: ColumnOrName, value: ColumnOrName) -> Column:
    """Address that returns the record of a known identifier; null for other kinds."""
    k, v = col(kind), col(value)
    return (
        F.when(k == "ISBN", F.concat(F.lit(f"{BOOKS_QUERY}isbn:"), v))
        .when(k == "OCLC", F.concat(F.lit(f"{BOOKS_QUERY}oclc:"), v))
        .when(k == "DOI", F.concat(F.lit(f"{WORKS_QUERY}/"), v))
    )


def isbn_filter_url(isbn: ColumnOrName) -> Column:
    return F.concat(F.lit(f"{WORKS_QUERY}?filter=isbn:"), col(isbn))


def pending_requests(df: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Requests without a stored answer."""
    return df.join(answered.select(key).distinct(), key, "left_anti")


def lookup_stats(df: DataFrame, label: str = "actual_label", type_column: str = "type_of_citation") -> DataFrame:
    """Totals of a look-up run as one row, in one pass."""
    unlabelled = F.col(label) == "other"
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~unlabelled).alias("labelled"),
        F.count_if(unlabelled).alias("unlabelled"),
        F.count_if(unlabelled & F.col(type_column).isin(*LOOKUP_TYPES)).alias("likely"),
        F.count_if(F.size("acquired_ID_list") > 0).alias("added"),
    )
