"""Grid captures, range captures and capture manifests as JSON, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATRIX_SCHEMA = (
    "meta struct<metric:string>, data struct<symbols:array<struct<symbol:string, asOf:string, spot:double, "
    "expirations:array<string>, strikes:array<struct<strike:double, value:double, nodeType:string>>, "
    "matrix:array<array<double>>>>>"
)
RANGE_SCHEMA = (
    "data struct<`from`:string, `to`:string, symbols:array<struct<symbol:string, "
    "axes:array<struct<id:bigint, strikes:array<double>>>, "
    "frames:array<struct<asOf:string, axis:bigint, values:array<double>>>>>>"
)
MANIFEST_SCHEMA = "t string, metric string, kind string, file string, credits_remaining bigint"


def _read(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*.json*")
    return reader.option("multiLine", str(multi_line).lower()).json(path).withColumn(
        "file", F.col("_metadata.file_path"))


def unwrap_rows(body, row: str) -> Column:
    """Rows of a reply that may be a bare list, or hold it under ``data``, ``data.chains`` or ``chains``.

    ``row`` is the type of one row. Other replies, and text that is no JSON, give an empty array.
    """
    body = F.col(body) if isinstance(body, str) else body
    places = [body, *(F.get_json_object(body, path) for path in ("$.data", "$.data.chains"))]
    # A reply with ``data`` is read from there only; without it, the reply itself may hold ``chains``.
    bare = F.when(places[1].isNull(), F.get_json_object(body, "$.chains"))
    found = F.coalesce(*[F.when(F.ltrim(p).startswith("["), p) for p in (*places, bare)])
    return F.coalesce(F.from_json(found, f"array<{row}>"), F.array().cast(f"array<{row}>"))


def read_matrix(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per symbol of each capture."""
    return _read(spark, path, MATRIX_SCHEMA, multi_line).select(
        "file", "meta.metric", F.explode("data.symbols").alias("s")).select("file", "metric", "s.*")


def matrix_strikes(symbols: DataFrame) -> DataFrame:
    return symbols.select("file", "symbol", "asOf", "spot", F.explode("strikes").alias("k")).select(
        "file", "symbol", "asOf", "spot", "k.strike", "k.value", F.col("k.nodeType").alias("node_type"))


def matrix_cells(symbols: DataFrame) -> DataFrame:
    """Non-zero cells; row i of the matrix belongs to strike i, column j to expiry j."""
    rows = symbols.select("file", "symbol", "asOf", "spot", "strikes", "expirations", F.posexplode("matrix").alias("i", "row"))
    cells = rows.select(
        "file", "symbol", "asOf", "spot", F.try_element_at("strikes", F.col("i") + 1)["strike"].alias("strike"),
        "expirations", F.posexplode("row").alias("j", "value"))
    return cells.where(F.col("value") != 0).select(
        "file", "symbol", "asOf", "spot", "strike", F.try_element_at("expirations", F.col("j") + 1).alias("expiry"), "value")


def read_range(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Frame values with the strike found by the frame's own axis and position."""
    top = _read(spark, path, RANGE_SCHEMA, multi_line).select(
        "file", F.col("data.from").alias("window_from"), F.explode("data.symbols").alias("s"))
    axes = top.select("file", "window_from", "s.symbol", F.explode("s.axes").alias("a")).select(
        "file", "window_from", "symbol", F.col("a.id").alias("axis"), F.posexplode("a.strikes").alias("pos", "strike"))
    frames = top.select("file", "window_from", "s.symbol", F.posexplode("s.frames").alias("frame", "f")).select(
        "file", "window_from", "symbol", "frame", F.col("f.asOf").alias("asOf"), F.coalesce("f.axis", F.lit(0)).alias("axis"),
        F.posexplode("f.values").alias("pos", "value"))
    return frames.join(axes, ["file", "window_from", "symbol", "axis", "pos"])


def on_grid(frames: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only frame strikes the grid holds."""
    return frames.join(grid.select(*keys, "strike").distinct(), [*keys, "strike"], "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines; the kind comes from the entry or else from its path."""
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path)
    from_path = F.regexp_extract("file", r"(?:matrix|range)/([^/]+)/", 1)
    return raw.withColumn("kind", F.coalesce("metric", "kind", F.nullif(from_path, F.lit("")))).withColumn(
        "day", F.substring("t", 1, 10))


def node_tier(rank: Column, gatekeepers: int = 3) -> Column:
    """Tier by rank: king, gatekeepers, three pika, three barney, then normal."""
    return (
        F.when(rank == 1, "king").when(rank <= 1 + gatekeepers, "gatekeeper")
        .when(rank <= 4 + gatekeepers, "pika").when(rank <= 7 + gatekeepers, "barney").otherwise("normal")
    )


def matrix_documents(cells: DataFrame, value: str = "g", gatekeepers: int = 3) -> DataFrame:
    """Capture documents from a grid, one per (ticker, ts).

    A document holds one grid, so its arrays are bounded by strikes x expiries.
    """
    keys = ["ticker", "ts"]
    nodes = cells.groupBy(*keys, "strike").agg(
        F.sum(value).alias("v"), F.map_from_entries(F.collect_list(F.struct("expiry", F.col(value)))).alias("by_exp"),
        F.max("spot").alias("spot"))
    order = Window.partitionBy(*keys).orderBy(F.abs("v").desc(), "strike")
    nodes = nodes.withColumn("type", node_tier(F.row_number().over(order), gatekeepers))
    exps = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("expiry")).alias("exps"))
    docs = nodes.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("strike", "v", "type", F.map_entries("by_exp").alias("cells")))).alias("rows"),
        F.max("spot").alias("spot")).join(exps, keys)
    strikes = F.transform("rows", lambda x: F.struct(x["strike"].alias("strike"), x["v"].alias("value"), x["type"].alias("nodeType")))
    matrix = F.transform("rows", lambda x: F.transform(
        "exps", lambda e: F.coalesce(F.map_from_entries(x["cells"])[e], F.lit(0.0))))
    symbol = F.struct(
        F.col("ticker").alias("symbol"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("asOf"), "spot",
        F.transform("exps", lambda e: F.date_format(e, "yyyy-MM-dd")).alias("expirations"),
        strikes.alias("strikes"), matrix.alias("matrix"))
    return docs.select(
        F.struct(F.lit("gamma").alias("metric")).alias("meta"), F.struct(F.array(symbol).alias("symbols")).alias("data"))


def write_json_gz(docs: DataFrame, path: str) -> str:
    docs.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return path


def range_documents(cells: DataFrame, value: str = "g", split: float = 25.0) -> DataFrame:
    """Range-capture documents: one frame per expiry, on two axes of different length."""
    keys = ["ticker", "ts"]
    per_exp = cells.groupBy(*keys, "expiry").agg(
        F.sort_array(F.collect_list(F.struct("strike", F.col(value).alias("v")))).alias("points"))
    docs = per_exp.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("expiry", "points"))).alias("exps"))
    docs = docs.withColumn("all_strikes", F.array_sort(F.array_distinct(
        F.flatten(F.transform("exps", lambda e: F.transform(e["points"], lambda p: p["strike"]))))))
    docs = docs.withColumn("low_strikes", F.filter("all_strikes", lambda s: s <= split))

    def frame(e, i):
        axis = i % 2
        strikes = F.when(axis == 1, F.col("all_strikes")).otherwise(F.col("low_strikes"))
        by = F.map_from_entries(e["points"])
        at = F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + i), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.struct(at.alias("asOf"), axis.cast("bigint").alias("axis"),
                        F.transform(strikes, lambda s: F.coalesce(by[s], F.lit(0.0))).alias("values"))

    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    axes = F.array(F.struct(F.lit(0).cast("bigint").alias("id"), F.col("low_strikes").alias("strikes")),
                   F.struct(F.lit(1).cast("bigint").alias("id"), F.col("all_strikes").alias("strikes")))
    symbol = F.struct(F.col("ticker").alias("symbol"), axes.alias("axes"), F.transform("exps", frame).alias("frames"))
    return docs.select(F.struct(start.alias("from"), start.alias("to"), F.array(symbol).alias("symbols")).alias("data"))


def node_census(strikes: DataFrame, keys: list[str]) -> DataFrame:
    return strikes.groupBy(*keys, "node_type").agg(F.count(F.lit(1)).alias("n"))


def sample_captures(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """First, middle and last capture per key by time."""
    heads = symbols.select(*keys, "asOf").distinct()
    order = Window.partitionBy(*keys).orderBy("asOf")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    picks = heads.withColumns({"_r": F.row_number().over(order), "_n": n}).where(
        (F.col("_r") == 1) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1) | (F.col("_r") == F.col("_n")))
    return symbols.join(picks.select(*keys, "asOf"), [*keys, "asOf"], "left_semi")


def capture_kings(symbols: DataFrame) -> DataFrame:
    """Grid king per capture: largest value by size, the smaller strike on ties."""
    return matrix_strikes(symbols).groupBy("symbol", "asOf").agg(
        F.max_by("strike", F.struct(F.abs("value"), -F.col("strike"))).alias("king"),
        F.max(F.abs("value")).alias("king_abs"), F.count(F.lit(1)).alias("n_strikes"),
        *[F.count_if(F.col("node_type") == x).alias(f"n_{x}") for x in ("king", "gatekeeper", "pika", "barney", "normal")])


def column_kings(symbols: DataFrame) -> DataFrame:
    """Largest cell of each column; an all-zero column has no king."""
    cols = symbols.select("symbol", "asOf", F.explode("expirations").alias("expiry"))
    best = matrix_cells(symbols).groupBy("symbol", "asOf", "expiry").agg(
        F.max_by("strike", F.struct(F.abs("value"), -F.col("strike"))).alias("strike"),
        F.max_by("value", F.struct(F.abs("value"), -F.col("strike"))).alias("value"))
    return cols.join(best, ["symbol", "asOf", "expiry"], "left").fillna(0.0, ["value"])


def lag_histogram(rows: DataFrame, lag_s: Column, limit: int = 3600) -> DataFrame:
    lag = F.greatest(F.least(F.bround(lag_s, 0).cast("bigint"), F.lit(limit)), F.lit(-limit))
    return rows.groupBy(lag.alias("lag_s")).agg(F.count(F.lit(1)).alias("n"))
