"""Labelled data sets and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, col, let
from refloom.session import materialize

# Parameters whose values give a label away, longest text a model reads, share for training.
BIASED = ["doi", "isbn", "pmc", "pmid", "url", "news"]
MAX_CHARS = 400
TRAIN_SHARE = 0.9


def blank_values(text: ColumnOrName) -> Column:
    """`doi=10.1/x|` to `doi = |` for all label-giving parameters."""
    c = col(text)
    for name in BIASED:
        c = F.regexp_replace(c, name + r"\s{0,10}=\s{0,10}([^|]+)", f"{name} = ")
    return c


def drop_keys(text: ColumnOrName) -> Column:
    """Remove what `blank_values` left of the parameters."""
    c = col(text)
    for name in BIASED:
        c = F.replace(c, F.lit(f"{name} = "), F.lit(""))
    return c


def row_share(key: Column, modulus: int = 1000) -> Column:
    """Stable pseudo-random number below `modulus` from a key: the first digits of its md5, the same in every engine."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(modulus))


def clear_bias(df: DataFrame, key: ColumnOrName, fraction: float = 0.0, text: str = "citations") -> DataFrame:
    """Blank the values that give the label away; in a share of the rows the parameters go as well."""
    blanked = df.withColumn(text, blank_values(text))
    if fraction > 0:
        picked = row_share(col(key)) < int(round(fraction * 1000))
        blanked = blanked.withColumn(text, F.when(picked, drop_keys(text)).otherwise(F.col(text)))
    return blanked.drop("type_of_citation")


def labelled_dataset(book_journal: DataFrame, news: DataFrame, label: str = "actual_label") -> DataFrame:
    """Books, journals and news in one table with a number per label (alphabetic), one row per (id, citation)."""
    parts = book_journal.where(F.col(label).isin("book", "journal")).unionByName(
        news.withColumn(label, F.lit("news")), allowMissingColumns=True
    )
    code = F.when(F.col(label) == "book", 0).when(F.col(label) == "journal", 1).otherwise(2)
    return parts.withColumn("label_category", code).dropDuplicates(["id", "citations"])


def characters(text: ColumnOrName) -> Column:
    return F.filter(F.split(col(text), ""), lambda ch: ch != "")


def char_counts(df: DataFrame, text: str = "citations") -> DataFrame:
    """Frequency of every character; counted inside each task before anything is moved."""
    return df.select(F.explode(characters(text)).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def char_index(counts: DataFrame) -> DataFrame:
    """Number per character, most frequent first, equal counts by character; from 0.

    The alphabet is a bounded set (code points in use), so ranking it in one task is cheap.
    """
    from pyspark.sql.window import Window

    order = Window.orderBy(F.desc("n"), F.asc("char"))
    return counts.select("char", (F.row_number().over(order) - 1).alias("idx"))


def char_sequence(df: DataFrame, index: DataFrame, text: str = "citations", length: int = MAX_CHARS) -> DataFrame:
    """Character numbers as an array of fixed length: left filled with 0, or those of the last `length` characters.

    The text is cut first. The index has one row per distinct character and becomes one constant array with a place for
    each code point up to the largest in use (at most those of Unicode), so a character is looked up in one step.
    """
    spark = df.sparkSession
    numbered = index.select(F.ascii("char").cast("long").alias("id"), "idx")
    places = spark.range(0x110000).where(F.col("id") <= index.agg(F.max(F.ascii("char"))).scalar())
    table = places.join(numbered, "id", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "idx"))), lambda x: x["idx"]).alias("_index")
    )

    def fit(x: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(0), F.lit(length) - F.size(x)), x)

    last = characters(F.right(F.col(text), F.lit(length)))
    ids = F.transform(last, lambda ch: F.coalesce(F.get(F.col("_index"), F.ascii(ch)), F.lit(0)))
    return df.withColumn("_index", table.scalar()).withColumn("char_ids", let(ids, fit)).drop("_index")


def length_stats(df: DataFrame, label: str = "label_category", words: str = "total_words") -> DataFrame:
    """Mean and exact median page length per label."""
    return df.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.median(words).alias("median_words")
    )


def char_length_stats(df: DataFrame, text: str = "citations") -> DataFrame:
    n = F.length(text)
    return df.agg(F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"))


def stratified_split(df: DataFrame, key: ColumnOrName, share: float = TRAIN_SHARE, label: ColumnOrName | None = None) -> DataFrame:
    """Mark rows for training or test by a stable number from their key.

    Without `label` the number alone decides, so every label is split in about the same share. With it, of the n rows of
    each label exactly round(share * n) are marked for training, one at least, and one at least for test if there are two: those
    with the smallest numbers. Nothing is sorted for that but one range of numbers per label: rows are counted per label and
    range, which finds the range that holds the last training row; then per number within that range; then, if rows with
    one key go on both sides, per part of the written table. A null label is a label of its own, and a null key a key.
    """
    if label is None:
        train = row_share(col(key)) < int(round(share * 1000))
        return df.withColumn("split", F.when(train, "train").otherwise("test"))
    number = F.conv(F.substring(F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = df.select(
        F.struct(*df.columns).alias("_in"),
        F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit("")).alias("_label"),
        number.alias("_number"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "split")
    keys = rows.select("_label", "_number", "_row")
    totals = keys.groupBy("_label").agg(F.count("*").alias("_n"))
    wanted = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.round(F.col("_n") * share)))
    cut = totals.select("_label", wanted.cast("long").alias("_left"))
    # Each step narrows the place of the last training row and says how many rows of it are still to be taken.
    steps = [("_range", F.shiftright("_number", 44)), ("_number", F.col("_number")), ("_part", F.shiftright("_row", 33)), ("_row", F.col("_row"))]
    found: list[str] = []
    for name, value in steps:
        inside = keys.withColumns({"_range": F.shiftright("_number", 44), "_part": F.shiftright("_row", 33)})
        inside = inside.join(cut, ["_label", *found]).groupBy("_label", *found, value.alias(f"{name}_at"), "_left").count()
        upto = F.sum("count").over(Window.partitionBy("_label").orderBy(f"{name}_at"))
        inside = inside.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("count") < F.col("_left")))
        left = F.col("_left") - F.col("_upto") + F.col("count")
        cut = inside.select("_label", *found, F.col(f"{name}_at").alias(name), left.alias("_left"))
        cut = materialize(cut, "split-cut")
        found.append(name)
    last = cut.select("_label", F.col("_number").alias("_last"), F.col("_row").alias("_last_row"))
    marked = rows.join(last, "_label")
    train = (F.col("_number") < F.col("_last")) | ((F.col("_number") == F.col("_last")) & (F.col("_row") <= F.col("_last_row")))
    return marked.select(*[F.col(f"_in.`{c}`") for c in df.columns], F.when(train, "train").otherwise("test").alias("split"))


def sample_with_replacement(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Random rows, the same row possibly more than once; every partition samples for itself."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Features of the same rows side by side; a column that is on both sides is taken once."""
    extra = [c for c in right.columns if c in keys or c not in left.columns]
    return left.join(right.select(*extra), keys, "inner")


def accuracy(df: DataFrame, label: str = "label_category", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
    )


def confusion(df: DataFrame, label: str = "label_category", prediction: str = "prediction") -> DataFrame:
    """Counts per label, one column per prediction."""
    hits = [
        F.count_if(F.col(prediction) == k).alias(f"predicted_{k}") for k in range(3)
    ]
    return df.groupBy(F.col(label).alias("label")).agg(*hits)


def merge_predictions(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Rows labelled by rule and rows labelled by the model in one table."""
    return rule.unionByName(model, allowMissingColumns=True)
