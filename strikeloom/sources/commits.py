"""A keyed table that only grows by whole commits.

    path/data/<uuid>/      files of one load, staged before they are committed
    path/commits/<number>  one record per commit with the name of its folder; readers follow the records

A load becomes visible by one rename that fails if the number is taken. A writer that loses
the race drops its staged files, looks at what the other has written and tries again, so a
key is never held twice. A load that fails its check, or dies, is never visible.

The rename must not replace a file: HDFS guarantees that in one step; Hadoop's local file
system looks first and then renames.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from strikeloom.sources.sinks import insert_only

#: Lost races after which a writer gives up.
ATTEMPTS = 50


def _hadoop(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    return fs, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _records(spark: SparkSession, path: str) -> list[str]:
    """Folders of all commits, in order."""
    _, folder, files = _hadoop(spark, f"{path}/commits")
    if not files.exists(folder):
        return []
    held = spark.read.option("pathGlobFilter", "[0-9]*").option("wholetext", True).text(folder.toString()) if len(files.listStatus(folder)) else None
    return [] if held is None else [r[0] for r in held.select("value", "_metadata.file_name").orderBy("file_name").collect()]


def _commit(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Whether commit ``number`` is now this writer's. The record is whole before it gets its name."""
    fs, record, files = _hadoop(spark, f"{path}/commits/{number:012d}")
    files.mkdirs(record.getParent())
    staged = fs.Path(f"{path}/commits/.{folder}")
    out = files.create(staged, True)
    out.write(bytearray(folder.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(staged), files.makeQualified(record), options)
    except Py4JJavaError as e:
        files.delete(staged, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows."""
    return _rows(spark, path, schema, _records(spark, path))


def _rows(spark: SparkSession, path: str, schema, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders])


def append(new: DataFrame, path: str, keys: Sequence[str]) -> tuple[int, int]:
    """Commit the rows of ``new`` whose key the table does not hold; (rows inserted, number of the commit).

    Nothing is committed, and 0 inserted, if every key is held.
    """
    spark = new.sparkSession
    for _ in range(ATTEMPTS):
        folders = _records(spark, path)
        held = _rows(spark, path, new.schema, folders)
        folder = uuid.uuid4().hex
        staged = f"{path}/data/{folder}"
        insert_only(new, held, keys).write.parquet(staged)
        try:
            # Only what is staged is looked at: what is committed was checked when it came.
            rows = spark.read.schema(new.schema).parquet(staged)
            inserted, again = rows.count(), rows.groupBy(*keys).count().where("count > 1").limit(1).count()
            known = rows.select(*keys).join(held.select(*keys), list(keys), "left_semi").limit(1).count()
            if again or known:
                raise ValueError("a key was written twice")
            if not inserted:
                _drop(spark, staged)
                return 0, len(folders)
            if _commit(spark, path, len(folders) + 1, folder):
                return inserted, len(folders) + 1
        except BaseException:
            _drop(spark, staged)
            raise
        _drop(spark, staged)  # another writer was first: look again
    raise RuntimeError(f"{path}: {ATTEMPTS} commits were taken by other writers")


def _drop(spark: SparkSession, folder: str) -> None:
    _, where, files = _hadoop(spark, folder)
    files.delete(where, True)
