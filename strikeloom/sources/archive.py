"""Archive scan over ``ticker=X/year=YYYY...`` files whose types drift between years."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.constants import TIME_COLUMNS

_JUNK = r"(^|/)\._|\.lock$"


def _any_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else re.sub(r"([*?\[\]{}\\])", r"\\\1", c) for c in name)


def folders(root: str, tickers: Iterable[str] | None = None, years: Iterable[str] | None = None) -> list[str]:
    """Globs that lead to the wanted part of the tree only: other folders are not listed."""
    years = [str(y) for y in years] if years else None
    return [f"{root.rstrip('/')}/ticker={_any_case(x) if x else '*'}/year={y or '*'}*"
            for x in (list(tickers) if tickers else [None]) for y in (years or [None])]


def list_files(spark: SparkSession, root: str, tickers: Iterable[str] | None = None,
               years: Iterable[str] | None = None) -> DataFrame:
    """Parquet files below ``root`` with ticker and year taken from the path.

    Filters become part of the listed paths. File contents are not read: only the path
    column of the listing is used.
    """
    there = [g for g in folders(root, tickers, years) if _exists(spark, g)]
    if not there:
        return spark.createDataFrame([], "path string, ticker string, year string")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "[!.]*.parquet").load(there).select("path")
    )
    return files.where(~F.col("path").rlike(_JUNK)).select(
        "path", F.regexp_extract("path", r"ticker=([^/]+)", 1).alias("ticker"),
        F.regexp_extract("path", r"year=(\d{4})", 1).alias("year"))


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for path in pdf["path"]:
            fs, inner = pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
            schema = pq.read_schema(inner, filesystem=fs)
            out.append(",".join(f"{f.name}:{f.type}" for f in schema))
        yield pdf[["path"]].assign(footer=out)


def scan(spark: SparkSession, root: str, schema: dict[str, str], tickers: Iterable[str] | None = None,
         years: Iterable[str] | None = None) -> DataFrame:
    """Read all matching files as one table of the given column types.

    Files are grouped by the types in their footers (read by the executors);
    each group is scanned with its own types and then cast, because one scan
    cannot read a column stored as integer in one file and double in another.
    The driver holds the list of paths, as it does for any file scan.
    """
    found = list_files(spark, root, tickers, years)
    groups: dict[str, list[str]] = {}
    for row in found.select("path").mapInPandas(_footers, "path string, footer string").toLocalIterator():
        groups.setdefault(row["footer"], []).append(row["path"])
    if not groups:
        raise ValueError(f"no archive files below {root}")
    out = None
    for _, paths in sorted(groups.items()):
        one = spark.read.parquet(*paths)
        path = F.col("_metadata.file_path")
        have = [F.col(c).cast(t).alias(c) for c, t in schema.items() if c in one.columns]
        one = one.select(*have, F.regexp_extract(path, r"ticker=([^/]+)", 1).alias("_ticker"),
                         F.regexp_extract(path, r"year=(\d{4})", 1).alias("_year"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def time_column(df: DataFrame, override: str | None = None) -> str:
    if override:
        return override
    for name in TIME_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError("no time column")


def time_range(df: DataFrame, since: str | None = None, until: str | None = None, column: str | None = None) -> DataFrame:
    """Inclusive range on ISO text; a bare end date covers its whole day."""
    c = F.col(time_column(df, column))
    cond: Column = F.lit(True)
    if since:
        cond = cond & (c >= since)
    if until and len(until) == 10:
        cond = cond & (c < (dt.date.fromisoformat(until) + dt.timedelta(days=1)).isoformat())
    elif until:
        cond = cond & (c <= until)
    return df.where(cond)


def summary(df: DataFrame, column: str | None = None) -> DataFrame:
    c = time_column(df, column)
    # One row per ticker and year first, so that the distinct counts see no raw rows.
    parts = df.groupBy("_ticker", "_year").agg(F.count(F.lit(1)).alias("rows"), F.min(c).alias("time_min"), F.max(c).alias("time_max"))
    return parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("time_min").alias("time_min"), F.max("time_max").alias("time_max"),
        F.countDistinct("_ticker").alias("n_tickers"), F.countDistinct("_year").alias("n_years"),
        F.array_join(F.array_sort(F.collect_set("_year")), ",").alias("years"))
