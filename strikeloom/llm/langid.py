"""Language of web pages by fusing text, markup, address suffix and host in Bayes' rule.

* Text: likelihood of hashed letter trigrams under one multinomial per language, counted on
  a bounded sample of labelled documents; its logarithm is tempered to ``EFFECTIVE``
  trigrams, because neighbouring trigrams depend on each other.
* Markup: how often each declared language goes with each true one, from the pages' text
  posteriors by grouped aggregation, plus a prior that declarations are right.
* Address: the prior of a page is its host's language share, smoothed towards its suffix's,
  which is smoothed towards the share of all pages. Shares are sums of text posteriors; a page's own
  posterior is taken out of all three, so that it doesn't confirm itself.

Pages meet host sums in a join on the host, which adaptive execution splits when one is hot;
sums are partial before the shuffle. Declared languages outside the model count as one
value, so that table has a bounded size and is collected.

Defined cases: a null or empty page has no text evidence, a null or odd address the empty
host and suffix; without evidence the overall share decides; ties go to the first
language by name; repeated rows each get a row; without labelled documents the language is
null and the confidence 0; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import MIX_A, blobs, mix, passes, shared, summed
from strikeloom.llm.letters import Letters

#: Labelled documents of the text model as expected without rare languages.
TRAIN_DOCS = 4_000
#: Documents of a language that are expected in the sample at least, as far as there are so many.
RARE_DOCS = 64
BITS = 15
ADD = 0.5
#: Pages that a suffix's, and a host's, own share must outweigh; declarations believed right before any page is seen.
SUFFIX_MASS, HOST_MASS, DECLARED_MASS = 20.0, 5.0, 10.0
DECLARED_RIGHT = 0.9


def trigrams(letters: Letters, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every letter trigram (word ends count as a blank) and its text."""
    points, letter, offsets = letters.points(column)
    flat = np.where(letter, points, 32).astype(np.uint64)
    n = flat.size
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    whole = (owner[2:] == owner[:-2]) & letter[1:-1]
    code = (flat[:-2] << np.uint64(42)) | (flat[1:-1] << np.uint64(21)) | flat[2:]
    bucket = (mix(code[whole] * np.uint64(MIX_A)) >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket, owner[:-2][whole]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x buckets


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Model | None:
    labelled = docs.where("doc_id is not null and lang is not null")
    # The list of languages is that of all labels, a row of the model (256 KB) each; a rare one is read whole, or by RARE_DOCS of its documents.
    found = labelled.groupBy("lang").count().collect()
    if not found:
        return None
    names, total_rows = sorted(r["lang"] for r in found), sum(r["count"] for r in found)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, max(rows / total_rows, RARE_DOCS / r["count"]))) for r in found], "lang string, _share double")
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(2**53)
    sampled = labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(uniform < F.col("_share"))
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), np.zeros((len(names), 1 << BITS), np.int64)
        for batch in passes(batches):
            bucket, owner = trigrams(letters, batch.column(0))
            lang = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])[owner]
            good = lang >= 0
            np.add.at(total, (lang[good], bucket[good]), 1)
        yield from blobs(total)

    counts = summed(sampled.select("text", "lang").mapInArrow(run, "chunk int, counts binary"), (len(names), 1 << BITS))
    smooth = counts + ADD
    return Model(names, np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True)))


_OPEN = re.compile(r"<!--|<(script|style)\b", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML, _META = re.compile(r"<html\b", re.I), re.compile(r"<meta\b", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
_CONTENT = re.compile(r"""content\s*=\s*["']?([A-Za-z]+)""", re.I)


def visible(page: str) -> str:
    """The page's text. One forward scan: what has no end is looked for once, however often it begins."""
    parts, at, endless = [], 0, set()
    for m in _OPEN.finditer(page):
        kind = m[1] and m[1].lower()
        if m.start() < at or kind in endless:
            continue
        end = _CLOSE[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
            continue
        parts.append(page[at:m.start()])
        at = end.end()
    text = " ".join([*parts, page[at:]])
    last = text.rfind(">") + 1  # no tag ends behind it
    return markup.unescape(_TAG.sub(" ", text[:last]) + text[last:])


def _tags(page: str, name: re.Pattern) -> Iterator[str]:
    """The insides of all tags of a name."""
    at = 0
    while m := name.search(page, at):
        end = page.find(">", m.end())
        yield page[m.end():end if end >= 0 else len(page)]
        if end < 0:
            return
        at = end


def declared(page: str) -> str | None:
    for inside in _tags(page, _HTML):
        if m := _LANG.search(inside):
            return m[1].lower()
    for inside in _tags(page, _META):
        at = inside.lower().find("content-language")
        if at >= 0 and (m := _CONTENT.search(inside, at + len("content-language"))):
            return m[1].lower()
    return None


def evidence(pages: DataFrame, model: Model, effective: float | None = None) -> DataFrame:
    """page_id, host, suffix, declared (in the model, ``other`` or null), text posterior by language and log-likelihood.

    With ``effective`` set, the log-likelihood of a longer text is scaled down to so many trigrams.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = Letters(), shipped.value
        known = set(m.languages)
        for batch in passes(batches, "html"):
            raw = [x or "" for x in batch.column(3).to_pylist()]
            bucket, owner = trigrams(letters, pa.array([visible(x) for x in raw], pa.string()))
            n = np.bincount(owner, minlength=len(raw))
            logs = np.stack([np.bincount(owner, row[bucket], len(raw)) for row in m.logs], axis=1)
            if effective is not None:
                logs = logs * np.minimum(1.0, effective / np.maximum(n, 1))[:, None]
            logs = logs.astype(float)
            logs -= logs.max(axis=1, keepdims=True)
            post = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
            said = [declared(x) for x in raw]
            said = [x if x is None or x in known else "other" for x in said]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string()), pa.array(list(post), kind), pa.array(list(logs), kind)], ["page_id", "host", "suffix", "declared", "post", "logs"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), "html")
    return rows.mapInArrow(run, "page_id long, host string, suffix string, declared string, post array<double>, logs array<double>")


def identify(pages: DataFrame, model: Model | None, effective: float | None = None) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host."""
    if model is None:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("host"))
    k = len(model.languages)
    seen = shared(evidence(pages, model, effective), "pages")

    def sums(df: DataFrame, *keys: str, of: str = "post") -> DataFrame:
        return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(of)[i]) for i in range(k)]).alias("total"))

    hosts = sums(seen, "host", "suffix")
    by_host = hosts.select(F.col("host").alias("h"), F.col("total").alias("host_total"))
    by_suffix = sums(hosts, "suffix", of="total").select(F.col("suffix").alias("s"), F.col("total").alias("suffix_total"))
    said = {r["declared"]: np.array(r["total"]) for r in sums(seen, "declared").collect()}
    everything = sum(said.values(), np.zeros(k))
    likely = {d: declared_log(d, t, everything, model.languages) for d, t in said.items() if d is not None}

    # Shares without the page's own posterior, from all pages down to the host.
    def without(total, own):
        return F.zip_with(total, own, lambda t, o: F.greatest(t - o, F.lit(0.0)))

    def shrink(total, prior, mass: float):
        size = F.aggregate(total, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(total, prior, lambda t, p: (t + mass * p) / (size + mass))

    joined = seen.join(by_host, seen["host"] == by_host["h"]).join(by_suffix, seen["suffix"] == by_suffix["s"])
    overall = F.array(*[F.lit(float(x)) for x in everything])
    joined = joined.withColumn("p0", shrink(without(overall, F.col("post")), F.array(*[F.lit(1.0 / k)] * k), float(k)))
    joined = joined.withColumn("p1", shrink(without(F.col("suffix_total"), F.col("post")), F.col("p0"), SUFFIX_MASS))
    joined = joined.withColumn("p2", shrink(without(F.col("host_total"), F.col("post")), F.col("p1"), HOST_MASS))
    claim = F.array(*[F.lit(0.0)] * k)
    for d, logs in likely.items():
        claim = F.when(F.col("declared") == d, F.array(*[F.lit(float(x)) for x in logs])).otherwise(claim)
    joint = F.zip_with(F.zip_with("logs", claim, lambda a, b: a + b), "p2", lambda a, p: a + F.log(p))
    joined = joined.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    mass = F.aggregate("joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in model.languages])
    first = F.element_at(names, F.array_position("joint", F.col("top")).cast("int"))
    text = F.when(F.array_max("post") > F.array_min("post"), F.element_at(names, F.array_position("post", F.array_max("post")).cast("int")))
    return joined.select("page_id", first.alias("lang"), (1.0 / mass).alias("confidence"), text.alias("text_lang"), "declared", "host")


def declared_log(said: str, total: np.ndarray, everything: np.ndarray, languages: list[str]) -> np.ndarray:
    """ln P(declared | language) with a prior that declarations are right."""
    k = len(languages)
    wrong = (1 - DECLARED_RIGHT) / k
    prior = np.array([DECLARED_RIGHT if x == said else wrong for x in languages])
    return np.log((total + DECLARED_MASS * prior) / (everything + DECLARED_MASS))
