"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters every record into one of many memory-sized buckets by a seeded hash and
writes it with its bucket; the records of a bucket that came out too large (records that
are equal in id and text share a hash) are scattered over all buckets again, by their place. Counts per bucket say
where each bucket begins in the global order. Pass 2 brings each bucket together, puts it
in a fixed order and moves record ``r`` to place ``p[r]`` of a Fisher-Yates permutation
drawn with a seed: Spark's ``shuffle`` is the inside-out form of that algorithm. Buckets
end to end are one uniform order of all records; it is cut into shards whose row counts
differ by one at most (the law ``rows``).

Texts go through one exchange. A permutation is drawn once per bucket, in a table of one
row per bucket that is merged with the records of the bucket in sorted order, so no task
holds a bucket's texts and the sort may spill.

Defined cases: a null text counts as no bytes and has the checksum of the empty text; an
empty text likewise; null ids, repeated rows and ties are records of their own; no rows
give no rows, and shards without rows when there are fewer rows than shards. Columns not
asked for are ignored; those asked for may have any names but the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.llm.common import shared

SHARDS = 16
SEED = 20_011
#: A bucket's aim: bytes of text and rows.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 100_000
#: The records of a bucket this many times over its aim are scattered again.
OVERFULL = 4
#: Tasks of the second pass at most; beyond it a task takes several buckets in turn.
MOST_TASKS = 1 << 15
#: Buckets whose counts are summed in one window.
SUM_BLOCK = 1 << 12

OWN = ("_key", "_place", "_bucket", "_turn", "_r", "_at", "_before")


def text_size(text) -> F.Column:
    """UTF-8 bytes plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def scatter(docs: DataFrame, columns: list[str], bucket_bytes: int, bucket_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Pass 1: the records with their ``_bucket``, and per bucket its rows and the rows before it."""
    kept = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *columns])])
    total = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text_size(F.col("text"))), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["b"] // bucket_bytes), -(-total["n"] // bucket_rows))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    written = shared(
        kept.withColumns({"size": text_size(F.col("text")), "_key": key, "_place": F.monotonically_increasing_id()}).withColumn(
            "_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key")), F.lit(buckets))), "scattered")
    filled = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    over = (F.col("b") > OVERFULL * bucket_bytes) | (F.col("n") > OVERFULL * bucket_rows)
    full = shared(filled.where(over).select("_bucket", F.lit(True).alias("_full")), "overfull")
    anew = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_key"), F.col("_place")), F.lit(buckets))
    records = written.join(full, "_bucket", "left").withColumn("_bucket", F.when(F.col("_full"), anew).otherwise(F.col("_bucket"))).drop("_full")
    return records, _before(shared(records.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")), "buckets"))


def _before(per: DataFrame) -> DataFrame:
    """Rows before each bucket: sums of blocks of buckets first, then within each block."""
    block = F.floor(F.col("_bucket") / SUM_BLOCK)
    rise = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy(block.alias("_block")).agg(F.sum("_rows").alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(rise), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_block", block).join(blocks, "_block").select(
        "_bucket", "_rows", (F.col("_ahead") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_before"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, columns: tuple[str, ...] = (), seed: int = SEED,
                        bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text and ``columns`` of every record with ``size``, ``shard`` and ``slot`` (its place in the shard).

    ``columns`` must not be named size, shard, slot or like the working columns ``OWN``.
    """
    clash = {"size", "shard", "slot", *OWN} & set(columns)
    if clash:
        raise ValueError(f"columns with names of the operator: {sorted(clash)}")
    records, per = scatter(docs, list(columns), bucket_bytes, bucket_rows, seed)
    sums = per.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows")).first()
    tasks, rows = max(1, min(sums["buckets"], MOST_TASKS)), max(1, sums["rows"])
    # One partition draws its buckets' permutations one after the other, so their order is fixed first.
    drawn = per.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").select(
        "_bucket", "_before", F.shuffle(F.sequence(F.lit(0), (F.col("_rows") - 1).cast("int")), seed).alias("_turn"))
    fixed = Window.partitionBy("_bucket").orderBy("_key", "doc_id", "text", "_place")
    numbered = records.repartition(tasks, "_bucket").withColumn("_r", F.row_number().over(fixed))
    # Merged, never broadcast: the permutations together have as many numbers as there are records.
    joined = numbered.join(drawn.hint("merge"), "_bucket")
    placed = joined.withColumn("_at", F.col("_before") + F.element_at("_turn", F.col("_r")))
    shard = F.expr(f"(_at * {shards}) div {rows}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first).select(
        "doc_id", "text", *columns, "size", "shard", "slot")


def write(sharded: DataFrame, path: str) -> None:
    """One folder per shard. A task holds whole buckets and each is a stretch of slots, so files need no further exchange."""
    sharded.write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """One row per record: where it went, with size and checksum of its text."""
    return sharded.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
