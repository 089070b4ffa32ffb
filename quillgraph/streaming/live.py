"""Streams of file events and of signals: batches after a pause, graphs that follow their files, decayed sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.merge import last_of
from quillgraph.sources.extract import extract


def watched(events: DataFrame) -> DataFrame:
    """Events (ts, path, kind) that change a file one would extract: no reads, nothing hidden, nothing in caches."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1))
    noise = F.exists(parts, lambda p: p.isin("node_modules", "__pycache__", "venv"))
    return events.where(~F.col("kind").isin("opened", "closed_no_write") & ~hidden & ~noise)


def batches(events: DataFrame, pause: str = "3 seconds", late: str = "10 seconds", by: str | None = None) -> DataFrame:
    """(from, to, paths, deletions): events (ts, path, kind) gathered until none came for ``pause``; later than ``late`` they are dropped.

    On a stream the watermark closes sessions; on a table the same plan gives all of them.
    """
    # A stream sessions by key only: without one, a column that is always 0 takes its place.
    keys = [F.session_window("ts", pause).alias("w"), F.col(by) if by else (F.length("path") * 0).alias("one")]
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    sums = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count_if(F.col("kind") == "deleted").alias("deletions"))
    return sums.select(*([by] if by else []), F.col("w.start").alias("from"), F.col("w.end").alias("to"), "paths", "deletions")


def needs_rebuild(rows: DataFrame) -> DataFrame:
    """Adds ``rebuild``: whether a batch has code or deletions; other batches only ask for an update."""
    code = F.exists("paths", lambda p: p.rlike(r"\.(py|js|ts|tsx|go|rs|java|c|h|cpp|cs|rb|sql|md)$"))
    return rows.withColumn("rebuild", code | (F.col("deletions") > 0))


def follow_files(files: DataFrame, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the fragments of a stream of files (path, text, ts) in ``folder``: a file seen again replaces its earlier rows.

    Each micro-batch is extracted once and appended under its number; :func:`current` reads the newest rows of each
    file. A batch that runs again writes the same folder, so nothing is doubled.
    """

    def store(batch: DataFrame, number: int) -> None:
        newest = last_of(batch, ["path"], ["ts", "text"])
        g = extract(newest)
        g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes/batch={number}")
        g.edges.write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")
        newest.select("path").write.mode("overwrite").parquet(f"{folder}/files/batch={number}")
        if on_batch is not None:
            on_batch(newest, number)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, part: str) -> DataFrame:
    """The rows of ``part`` (nodes, edges) that belong to the newest batch of their file; rows without a file stay."""
    files = spark.read.parquet(f"{folder}/files").groupBy(F.col("path").alias("source_file")).agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{folder}/{part}")
    return rows.where("source_file is not null").join(files, ["source_file", "batch"], "left_semi").unionByName(rows.where("source_file is null"))


def running_score(signals: DataFrame, half_life_days: float, epoch: str = "2024-01-01", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(node, from, grown): per window the signed sum of 2 ** (age since ``epoch`` / half life).

    Such sums add up over windows; divided by 2 ** (now since epoch / half life) they are the decayed score, so late
    and early signals need no second look. ``signals`` (node, outcome, at).
    """
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1).otherwise(0)
    days = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp"))) / 86_400_000_000
    rows = signals.withWatermark("at", late) if signals.isStreaming else signals
    rows = rows.withColumn("grown", sign * F.pow(F.lit(2.0), days / half_life_days))
    return rows.groupBy("node", F.window("at", window).alias("w")).agg(F.sum("grown").alias("grown")).select("node", F.col("w.start").alias("from"), "grown")
