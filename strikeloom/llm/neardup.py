"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Every document is a bag of shingles (five consecutive words; a shorter text is one shingle)
with counts as weights. The similarity of two bags is the weighted Jaccard quotient, the sum of
the smaller counts over the sum of the larger ones.

Signatures. Weights are discretised into unit cells, and cells into blocks [0,1), [1,2),
[2,4), [4,8), ... For every shingle and block runs a Poisson process, seeded by both, whose
points carry an arrival time, one of ``M`` components, and a cell found by halving the
block again and again, one random bit each. Points in cells beyond the weight don't exist
for the document. A component's value is its earliest point, so two documents agree in it
with a probability equal to their similarity, without bias, and a shingle of weight w costs
log(w) processes. Only points before a time limit are made, chosen so that every component
almost surely has one; documents for which one has none are done again with twice the limit.

Candidates. ``BANDS`` bands of ``ROWS`` components are bucket keys; two documents at the
threshold share none with a probability of 3e-6. Equal bags are one node from the start.

1. Every bucket's members are compared with its least member: pairs grow with documents,
   not with the squares of buckets.
2. That comparison also describes a document by the least member: one bit for each shingle
   of that one, and 32-bit names of the shingles outside. Where the members compared with
   one least member are not in one class by then, all pairs of different classes are
   compared by these descriptions, whose overlap is never below the true one. Large sets of
   members are cut into blocks, and pairs of blocks are the tasks; of the pairs that reach the
   threshold, a task sends those that join classes it has not joined yet.
3. Should such a pair fail its verification (names of 32 bits can agree by chance), the sets it
   comes from are compared once more, and every pair of different classes is sent.

Every link is verified on the bags themselves. Classes are connected components.

Defined cases: null and empty texts are classes of their own; null ids get a null class and
never join one; rows that share an id are one document with several texts, each of which is
compared, and join all their classes; repeated
rows each get a row; ties have no meaning here, the least id names a class; no rows give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.llm.common import MIX_A, combine, mix, passes, shared, tidy, utf8, word_names, words
from strikeloom.llm.components import connected

SHINGLE = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
ROWS, BANDS = 5, 32
M = ROWS * BANDS
#: Members in a block of the second comparison.
BLOCK = 128
#: Bits of the names in descriptions; fewer only send more pairs to verification.
NAME_BITS = 32


def bags(values: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle name and count of all bags, ordered by document and name."""
    starts, ends, bounds = words(values, offsets)
    names = word_names(values, starts, ends)
    sizes = np.diff(bounds)
    count = np.where(sizes >= shingle, sizes - shingle + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(sizes.size), count)
    at = np.repeat(bounds[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    wide = sizes[owner] >= shingle
    out = np.zeros(at.size, np.uint64)
    out[wide] = combine(*[names[at[wide] + i] for i in range(shingle)])
    for row in np.flatnonzero(~wide):
        a, b = bounds[owner[row]], bounds[owner[row] + 1]
        out[row] = combine(*[names[i:i + 1] for i in range(a, b)], np.array([b - a], np.uint64))[0]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(out.size, bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], out[first], np.diff(np.append(first, out.size))


def signatures(owner: np.ndarray, names: np.ndarray, counts: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """docs x m names of the earliest points; documents without a shingle have zeros."""
    out = np.zeros((docs, m), np.uint64)
    weight = np.bincount(owner, counts, docs)
    todo, extra = weight > 0, 1.0
    # Blocks of every shingle: 0 is the cell [0, 1), k the cells [2^(k-1), 2^k).
    depth = np.where(counts > 1, np.ceil(np.log2(counts)).astype(np.int64), 0)
    rep = np.repeat(np.arange(counts.size), depth + 1)
    block = np.arange(rep.size) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    doc, limit_cell = owner[rep], counts[rep]
    size = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1)
    begin = np.where(block > 0, size, 0)
    seed = mix(names[rep] + block.astype(np.uint64) * np.uint64(MIX_A))
    while todo.any():
        limit = extra * (math.log(m) + 3.0) / np.maximum(weight, 1)
        live = np.flatnonzero(todo[doc])
        time = np.zeros(live.size)
        flat, when, which = [], [], []
        i = 0
        while live.size:
            point = mix(seed[live] + np.uint64(((2 * i + 1) * MIX_A) % 2**64))
            gap = mix(point + np.uint64(1))
            time = time - np.log(((gap >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * size[live])
            near = time <= limit[doc[live]]
            live, time, point = live[near], time[near], point[near]
            bits = mix(point + np.uint64(2))
            # Halving a block k - 1 times by random bits ends in one of its cells.
            cell = begin[live] + (bits & (size[live] - 1).astype(np.uint64)).astype(np.int64)
            real = cell < limit_cell[live]
            part = (mix(point + np.uint64(3)) % np.uint64(m)).astype(np.int64)
            flat.append((doc[live] * m + part)[real])
            when.append(time[real])
            which.append(point[real])
            i += 1
        flat, when, which = np.concatenate(flat), np.concatenate(when), np.concatenate(which)
        table = np.full(docs * m, np.inf)
        np.minimum.at(table, flat, when)
        first = when == table[flat]
        out.reshape(-1)[flat[first]] = which[first]
        missing = np.isinf(table.reshape(docs, m)).any(axis=1)
        todo &= missing
        extra *= 2
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in passes(batches):
        owner, names, counts = bags(*utf8(batch.column(1)))
        n = batch.num_rows
        sig = signatures(owner, names, counts, n)
        keys = np.stack([combine(*[sig[:, b * ROWS + r] for r in range(ROWS)], np.full(n, b, np.uint64)) for b in range(BANDS)], axis=1)
        print_a, print_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        weighed = counts.astype(np.uint64)
        np.add.at(print_a, owner, mix(names + weighed * np.uint64(MIX_A)))
        np.add.at(print_b, owner, mix(mix(names ^ np.uint64(MIX_A)) + weighed))
        total = np.bincount(owner, counts, n).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)), pa.array(total), lists], ["doc_id", "hash", "pa", "pb", "n", "keys"])


def _overlaps(batches: Iterator[pa.RecordBatch], name_bits: int = NAME_BITS) -> Iterator[pa.RecordBatch]:
    """Shared and joint bag size of every pair (a, b, text_a, text_b), the bag size of b, which units of a's
    bag b has, and names of b's units outside. A unit is a shingle and the number of its copy."""
    for batch in passes(passes(batches, "text_a"), "text_b"):
        n = batch.num_rows
        oa, na, ca = bags(*utf8(batch.column(2)))
        ob, nb, cb = bags(*utf8(batch.column(3)))
        ka, kb = mix(na + mix(oa.astype(np.uint64))), mix(nb + mix(ob.astype(np.uint64)))
        _, ia, ib = np.intersect1d(ka, kb, return_indices=True)
        have = np.zeros(ka.size, np.int64)
        have[ia] = np.minimum(ca[ia], cb[ib])
        both = np.bincount(oa, have, n).astype(np.int64)
        size = np.bincount(ob, cb, n).astype(np.int64)
        units = np.bincount(oa, ca, n).astype(np.int64)
        copy = np.arange(int(ca.sum())) - np.repeat(np.cumsum(ca) - ca, ca)
        bits = copy < np.repeat(have, ca)
        ends = np.cumsum(units)
        packed = [np.packbits(bits[e - u:e]).tobytes() for u, e in zip(units.tolist(), ends.tolist())]
        held = np.zeros(kb.size, np.int64)
        held[ib] = np.minimum(ca[ia], cb[ib])
        outside = cb - held
        number = np.arange(int(outside.sum())) - np.repeat(np.cumsum(outside) - outside, outside) + np.repeat(held, outside)
        extra = (mix(np.repeat(nb, outside) + number.astype(np.uint64) * np.uint64(MIX_A)) >> np.uint64(64 - name_bits)).astype(np.uint32)
        stops = np.cumsum(size - both)
        named = [extra[e - u:e].tobytes() for u, e in zip((size - both).tolist(), stops.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(units + size - both), pa.array(size), pa.array(packed, pa.binary()), pa.array(named, pa.binary())], ["a", "b", "both", "every", "n", "bits", "extra"])


def verified(pairs: DataFrame, texts: DataFrame, name_bits: int = NAME_BITS) -> DataFrame:
    """``pairs`` (a, b) with the shared and the joint size of their bags; ``texts`` (id, text) holds all their texts."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(tidy(lambda batches: _overlaps(batches, name_bits)), "a long, b long, both long, every long, n long, bits binary, extra binary")


def _is_link():
    return F.col("both") * DENOMINATOR >= F.col("every") * NUMERATOR


def _cross(every: bool):
    """Links between different classes among the members of a block, or of two, by their descriptions: all of them
    (``every``), or as few as join the same classes."""
    return lambda table: _links(table, every)


def _links(table: pa.Table, every: bool) -> pa.Table:
    side, ids, label, n, both = (table.column(c).to_numpy() for c in ("side", "id", "label", "n", "both"))
    rows = table.column("bits").to_pylist()
    width = -(-len(rows[0]) // 8) * 8
    bits = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint64).reshape(len(rows), width // 8)
    names = [np.frombuffer(x, np.uint32) for x in table.column("extra").to_pylist()]
    flat, owner = np.concatenate(names), np.repeat(np.arange(len(names)), [x.size for x in names])
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = two.size == 0
    two = one if alone else two
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    out_a, out_b = [], []
    for i in one.tolist():
        rest = two[(label[two] != label[i]) & ((ids[two] > ids[i]) | (not alone))]
        inside = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1, dtype=np.int64)
        most = inside + np.minimum(n[rest] - both[rest], n[i] - both[i])
        near = most * DENOMINATOR >= (n[rest] + n[i] - most) * NUMERATOR
        rest, inside = rest[near], inside[near]
        if not rest.size:
            continue
        common = np.bincount(owner[np.isin(flat, names[i])], minlength=len(names))[rest] + inside
        for j in rest[common * DENOMINATOR >= (n[rest] + n[i] - common) * NUMERATOR].tolist():
            x, y = root(int(label[i])), root(int(label[j]))
            if every or x != y:
                if x != y and not every:
                    joined[max(x, y)] = min(x, y)
                out_a.append(min(int(ids[i]), int(ids[j])))
                out_b.append(max(int(ids[i]), int(ids[j])))
    star = table.column("a")[0].as_py()
    return pa.table({"star": pa.array([star] * len(out_a), pa.int64()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def rest_pairs(stars: DataFrame, labels: DataFrame, every: bool = False) -> DataFrame:
    """Pairs (a, b) that the first comparison left open, and the set (star) they come from, from its result (a: least
    member, b: member) and the classes by then."""
    placed = stars.select("a", F.col("b").alias("id"), "n", "both", "bits", "extra").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    placed = placed.withColumn("label", F.coalesce("label", "id"))
    mixed = placed.groupBy("a").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    open_ = placed.join(mixed.select("a", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "a")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its set once.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    spread = open_.select("*", F.explode(meets).alias("meet"))
    spread = spread.select("a", "meet.x", "meet.y", (F.col("block") != F.col("meet.x")).cast("int").alias("side"), "id", "label", "n", "both", "bits", "extra")
    # Dealt by block pairs: after the join above Spark would leave all pairs of a set in its task.
    return spread.repartition("a", "x", "y").groupBy("a", "x", "y").applyInArrow(_cross(every), "star long, a long, b long").distinct()


def _same_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the bags of one id."""
    held = rows.join(nodes.select("pa", "pb", "id"), ["pa", "pb"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    return held.join(rows, "doc_id").join(nodes.select("pa", "pb", F.col("id").alias("b")), ["pa", "pb"]).where("a <> b").select("a", "b").distinct()


def thinned(links: DataFrame) -> DataFrame:
    """Links (a < b) that join the same nodes, about one a node: a node keeps its least neighbour, and its others are
    linked to that one, where the links of all nodes of a star become the same few. For nodes of few neighbours below them."""
    least = links.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("least"))
    return least.select(F.col("least").alias("a"), F.when(F.col("a") > F.col("least"), F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def classes(docs: DataFrame, name_bits: int = NAME_BITS) -> DataFrame:
    """doc_id, class_id (least id of the class) and the size of its bag ``n_shingles``, one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    sketch = shared(docs.mapInArrow(tidy(_sketch), "doc_id long, hash long, pa long, pb long, n long, keys array<long>"), "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    # A node is a bag; the row of its least id, told by id and text, lends it its text.
    nodes = full.groupBy("pa", "pb").agg(F.min(F.struct("doc_id", "hash")).alias("row"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    nodes = shared(nodes.select("pa", "pb", "row.doc_id", "row.hash", "n", "keys", F.monotonically_increasing_id().alias("id")), "nodes")
    placed = nodes.select(F.explode("keys").alias("key"), "id")
    pivots = placed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot < other")
    pairs = placed.join(pivots.select("key", "pivot"), "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = shared(pairs, "pairs")
    # One copy of the texts that any comparison needs, one row a node.
    used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    used = nodes.select("id", "doc_id", "hash").join(used, "id")
    # The set of nodes grows with the documents, so both sides are always shuffled, also where it is small.
    texts = shared(docs.join(used.hint("merge"), ["doc_id", "hash"]).groupBy("id").agg(F.max("text").alias("text")), "texts")
    stars = shared(verified(pairs, texts, name_bits), "stars")
    # A node is in BANDS stars at most.
    links = thinned(stars.where(_is_link()).select("a", "b")).unionByName(_same_ids(full.select("doc_id", "pa", "pb").distinct(), nodes))
    links = shared(links, "links")
    rest = shared(rest_pairs(stars, connected(links)), "rest")
    checked = shared(verified(rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), texts), "checked")
    # The tasks of a set join the same classes again and again.
    links = thinned(links.unionByName(checked.where(_is_link()).select("a", "b")))
    failed = checked.where(~_is_link()).select("a", "b")
    if failed.limit(1).count():
        links = shared(links, "links")
        doubtful = rest.join(failed, ["a", "b"], "left_semi").select(F.col("star").alias("a")).distinct()
        again = rest_pairs(stars.join(doubtful, "a", "left_semi"), connected(links), every=True).select("a", "b").distinct()
        again = again.join(checked.select("a", "b"), ["a", "b"], "left_anti").join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(verified(shared(again, "again"), texts).where(_is_link()).select("a", "b"))
    labels = connected(links)
    named = nodes.select("pa", "pb", "id", "doc_id").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = shared(named.join(least, "label").select("pa", "pb", "class_id"), "named")
    out = sketch.select("doc_id", "pa", "pb", "n").join(named, ["pa", "pb"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every class the document with the least id, once.

    Rows without an id stay.
    """
    columns = docs.columns
    kept = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    found = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    once = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    first = found.withColumn("_row", F.row_number().over(once)).where("_row = 1").select(*columns)
    return first.unionByName(docs.where("doc_id is null"))
