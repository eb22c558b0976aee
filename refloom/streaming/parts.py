"""New dump parts as a stream, and label counts over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refloom.operators.citations import MINIMAL_FIELDS, extract_citations, filter_known_types, normalize_citations
from refloom.operators.labels import label_book_journal, label_news


def label_part(articles: DataFrame, domains: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Stages from articles to labelled citations of one part: book and journal by identifiers, then news by domain.

    The fields are those that labelling and look-up read. Without a table of domains nothing becomes news.
    """
    found = filter_known_types(extract_citations(articles))
    labelled = label_book_journal(normalize_citations(found, "citations", fields=MINIMAL_FIELDS))
    return labelled if domains is None else label_news(labelled, domains, suffixes=suffixes)


def stream_dump_parts(
    spark: SparkSession,
    source: str,
    schema,
    target: str,
    checkpoint: str,
    transform: Callable[..., DataFrame] = label_part,
    domains: str | None = None,
    suffixes: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Work through all new article files of a folder, then stop; a restart goes on after the last finished batch.

    Each batch has its own folder named by its number, so a batch that is run again replaces its first try. `domains` and
    `suffixes` are Parquet tables that every batch reads anew and hands to `transform`: a stream-static join with what the
    tables hold when the batch starts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        tables = {
            name: session.read.parquet(path) for name, path in (("domains", domains), ("suffixes", suffixes)) if path is not None
        }
        transform(batch, **tables).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_counts(events: DataFrame, time: str, label: str, window: str = "1 day") -> DataFrame:
    """Rows per window and label. No row is too late: the state is one counter per window and label."""
    return (
        events.groupBy(F.window(time, window), F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "label", "n")
    )


def stream_label_counts(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, time: str, label: str, pattern: str = "*"
) -> StreamingQuery:
    """Windowed counts of the event files of a folder; the table holds the counts of all rows read so far.

    Each batch replaces the table by the whole result, last window included. A run over files that arrive later goes on
    from the counters in the checkpoint, so rows of windows that are long past are counted too.
    """
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return (
        windowed_counts(stamped, time, label)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
