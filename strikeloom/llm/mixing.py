"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, a small table turns them into repetition rates, and
every document is taken ``floor(rate)`` times plus once more when its own hash,
read as a number in [0, 1), lies below the fraction of the rate.

* Weights 5, 2, 1 repeat over the sources in code-point order, a null source last.
* A target is ``level * weight``, but at most ``max_repeat`` times the tokens of the
  source; ``level`` is chosen so that the targets add up to all tokens. Sorting the
  sources by tokens per weight makes this one running sum (the sources that stop at
  their cap are a prefix of that order), so no iteration is needed.
* A source without tokens, or a null or empty text, has size 0 and target 0.
* Null ids count as the text ``null``; repeated rows are documents of their own that
  share one decision, because it depends on the id and the seed alone.

The source table has one row per source and is written before the join: the planner
then knows its size and brings a small one to the documents, whose texts stay where they
are. A table too large for that is left to adaptive execution, which splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.llm.common import shared

#: Weights by position of the source in code-point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) from rows with ``source`` and ``size``."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(*order)) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place.cast("int") + 1).cast("long")
    per = per.select("source", "source_size", weight.alias("w"))
    # Ascending size per weight: fractions compared as products would need a self join, the quotient of two longs is exact enough to order by.
    rise = Window.orderBy(F.col("source_size") / F.col("w"), *order)
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    level = (F.col("total") - max_repeat * F.col("size_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    fits = level * F.col("w") <= max_repeat * F.col("source_size")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("w"), F.col("w_before"), level.alias("level")))).over(everything)["level"])
    cap = (max_repeat * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap))
    return per.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(key, seed: str = SEED) -> F.Column:
    """A number in [0, 1) from the first 32 bits of an md5 over seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (how often the mix takes the document).

    Input columns of these names are replaced.
    """
    own = ("size", "source_size", "target", "rate", "copies")
    sized = docs.drop(*own).withColumn("size", token_count(F.col("text")))
    table = rates(sized.select("source", "size"), weights, max_repeat)
    table = shared(table.withColumnRenamed("source", "rate_source"), "rates")
    joined = sized.join(table, sized["source"].eqNullSafe(table["rate_source"]), "left").drop("rate_source")
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", (whole + extra).cast("long"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: each row of ``mix_sources`` as often as ``copies`` says."""
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return mixed.where("copies > 0").select(*columns, again).drop("_copy")
