"""Article dumps and stage tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only the fields that are read; the rest of a page is skipped by the XML reader.
PAGE_SCHEMA = (
    "id LONG, ns LONG, title STRING, redirect STRUCT<_title: STRING>, "
    "revision STRUCT<id: LONG, parentid: LONG, text STRUCT<_VALUE: STRING, _bytes: LONG>>"
)


def read_dump(spark: SparkSession, path: str, splittable: bool = True) -> DataFrame:
    """Pages of an XML dump, plain or bz2.

    The XML source reads a file in one task. Reading pages as text records instead lets Spark split a file, a
    bz2 one as well, and hands each record to `from_xml`.
    """
    if not splittable:
        return spark.read.format("xml").options(rowTag="page").schema(PAGE_SCHEMA).load(path)
    lines = spark.read.option("lineSep", "</page>").text(path).withColumn("file", F.input_file_name())
    start = F.instr("value", "<page>")
    records = lines.where(start > 0).select(
        "file", F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>")).alias("xml")
    )
    return records.select(
        F.from_xml("xml", PAGE_SCHEMA, {"rowTag": "page"}).alias("p"), "file"
    ).select("p.*", "file")


def articles(pages: DataFrame) -> DataFrame:
    """Pages of the main name space that are no redirects: id, title, content, r_id, r_parentid."""
    keep = ["file"] if "file" in pages.columns else []
    return pages.where((F.col("ns") == 0) & F.col("redirect").isNull()).select(
        F.col("id").alias("page_id"),
        "title",
        F.coalesce("revision.text._VALUE", F.lit("")).alias("content"),
        F.col("revision.id").alias("r_id"),
        F.col("revision.parentid").alias("r_parentid"),
        *keep,
    )


def page_content(pages: DataFrame) -> DataFrame:
    return articles(pages).select("page_id", F.col("title").alias("page_title"), "content")


def with_dump_part(df: DataFrame, file: str = "file") -> DataFrame:
    """Part of the dump a row comes from (`-articles1.xml-p1p41242`); rows of other files are left out."""
    part = F.regexp_extract(F.col(file), r"(-a(?!.*-a)[^/]*)\.[^./]*$", 1)
    return df.withColumn("part", part).where(F.col("part") != "")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Give a costly step one task per core where the scan yields fewer, or where most rows are in a few of its tasks.

    A Parquet file is cut by bytes, but a row group is read whole by one task: a file of few row groups gives many tasks,
    most of them empty. Rows are counted per task from the footers alone. Inputs that fill their tasks evenly are left as they are.
    """
    want = tasks or df.sparkSession.sparkContext.defaultParallelism
    given = df.rdd.getNumPartitions()
    if given >= want:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        if max(rows, default=0) * want <= 2 * sum(rows):
            return df
    return df.repartition(max(want, given))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """All part files of a stage; markers and checksum files are not data and are skipped."""
    return spark.read.parquet(path)


def bucketed_stage(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write a stage in buckets of `keys`, sorted within each, and read it as a table that knows its buckets.

    Two stages with the same number of buckets (by default the session's shuffle partitions) over the keys of a join are joined
    without a shuffle, and grouped by these keys without one, however often that is done. The table's name is its path's last part.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])
    # Dealt like the buckets first, so that a bucket is one file and not one of every task.
    dealt = df.repartition(count, *keys)
    writer = dealt.write.mode("overwrite").option("compression", "snappy").option("path", path).format("parquet")
    writer.bucketBy(count, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def write_partitioned_batches(df: DataFrame, path: str, key: str, batches: int = 32, jobs: int = 1) -> int:
    """Write in hash batches and note the finished ones in a small table beside the data; a later run skips these.

    A batch counts as finished once the job that wrote it has ended and its note is written, with or without rows. One
    job writes all of them and reads the input once; more jobs lose less if one fails and read it as often. Returns the number of batches
    written in this run.
    """
    spark = df.sparkSession
    notes = f"{path}/_finished"
    every = spark.range(batches).select(F.col("id").cast("int").alias("bucket"))
    todo = sorted(r.bucket for r in every.join(_finished(spark, notes), "bucket", "left_anti").collect())
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    per_job = -(-batches // jobs)
    for i in range(0, len(todo), per_job):
        some = todo[i : i + per_job]
        writer = bucketed.where(F.col("bucket").isin(*some)).write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        writer.partitionBy("bucket").parquet(path)
        every.where(F.col("bucket").isin(*some)).coalesce(1).write.mode("append").parquet(notes)
    return len(todo)


def _finished(spark: SparkSession, notes: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(notes)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.range(0).select(F.col("id").cast("int").alias("bucket"))
    return spark.read.schema("bucket int").parquet(notes).distinct()
