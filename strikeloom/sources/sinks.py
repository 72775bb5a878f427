"""Sinks: session partitions, insert-only upsert, incremental loads, result files, exports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a file in memory at once.
STRETCH = 8 << 20


def write_sessions(df: DataFrame, path: str, session: str = "dt", sort: Sequence[str] = ("ticker",)) -> None:
    """Partition by session and replace only the sessions present in ``df``.

    Rows are brought together by session; at run time a large session is split over as many
    writers as its size asks for and small ones share one. Within a file rows are sorted
    for min/max skipping.
    """
    keep = [c for c in sort if c in df.columns]
    (
        df.hint("rebalance", session).sortWithinPartitions(session, *keep)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)
    )


def insert_only(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the table does not hold; an existing key is never replaced."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items an earlier run has not finished."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Result files of a comparison run and their formats.
RESULT_FILES = {"node_comparison": "csv.gz", "star_comparison": "csv", "per_record": "csv", "summary": "json"}


def write_results(path: str, **tables: DataFrame) -> None:
    """Result files of a run, each a folder of parts written by all tasks that hold rows of it."""
    for name, df in tables.items():
        kind = RESULT_FILES[name]
        if kind == "json":
            write_summary(df, f"{path}/{name}")
        else:
            df.write.mode("overwrite").option("header", "true").option("compression", "gzip" if kind.endswith("gz") else "none").csv(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    if RESULT_FILES[name] == "json":
        return spark.read.schema(schema).json(f"{path}/{name}")
    return spark.read.schema(schema).option("header", "true").csv(f"{path}/{name}")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256, size and parquet row count of each file, read in stretches; an unreadable footer has no row count."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for path in pdf["path"]:
            fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            digest, size = hashlib.sha256(), 0
            with fs.open_input_stream(inner) as stream:
                while piece := stream.read(STRETCH):
                    digest.update(piece)
                    size += len(piece)
            try:
                rows = pq.read_metadata(inner, filesystem=fs).num_rows
            except (pa.ArrowInvalid, OSError):
                rows = None
            out.append((re.sub(r"^file:/+", "/", path), digest.hexdigest(), size, rows))
        yield pd.DataFrame(out, columns=["file_path", "sha256", "byte_size", "row_count"]).astype({"row_count": "Int64"})


def export_manifest(spark: SparkSession, path: str, tier: str, checks: DataFrame | None = None, key: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per file: SHA-256, size and row count read back from the written files by the executors.

    ``verified`` needs a readable file and, in ``checks`` (of ``verify_export``), that the source agrees with what was
    read back for the file's partition; ``pattern`` takes the ``key`` out of the path. Without checks nothing is verified.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    # One file a task at most: files are read whole.
    out = files.repartition("path").mapInPandas(_digests, "file_path string, sha256 string, byte_size bigint, row_count bigint").withColumn("tier", F.lit(tier))
    if checks is None:
        return out.withColumn("verified", F.lit(False))
    kind = checks.schema[key].dataType
    keyed = out.withColumn(key, F.regexp_extract("file_path", pattern, 1).cast(kind))
    agreed = checks.select(key, "agrees")
    return keyed.join(agreed, key, "left").withColumn("verified", F.col("row_count").isNotNull() & F.coalesce("agrees", F.lit(False))).drop("agrees")


def retention_candidates(rows: DataFrame, manifest: DataFrame, key: str, age_days: int, today) -> DataFrame:
    """Keys old enough to leave the raw tier and wholly covered by verified exports.

    Only candidates are returned; nothing is deleted here.
    """
    old = rows.where(F.col(key) < F.date_sub(today, age_days)).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    # One export of a file counts once, and counts must agree exactly: a repeated export must not cover for a missing one.
    files = manifest.where("verified").select(key, "sha256", "row_count").distinct()
    safe = files.groupBy(key).agg(F.sum("row_count").alias("exported"))
    return old.join(safe, key).where(F.col("exported") == F.col("rows"))


def verify_export(source: DataFrame, exported: DataFrame, key: str, ts: str) -> DataFrame:
    """Per partition: rows and time range of the source and of what was read back, and whether they agree."""
    def shape(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{side}_rows"), F.min(ts).alias(f"{side}_min"), F.max(ts).alias(f"{side}_max"))

    both = shape(source, "source").join(shape(exported, "exported"), key, "full")
    same = [F.col(f"source_{c}").eqNullSafe(F.col(f"exported_{c}")) for c in ("rows", "min", "max")]
    return both.withColumn("agrees", same[0] & same[1] & same[2])
