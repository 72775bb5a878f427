"""Collocations by level-wise counting in double-array tries.

Every language is mined by itself. Level 1 counts words; a level above holds phrases of
one word more. Each level is one pass over the whole texts:

* The candidates of a level are put into a double-array trie (language, then words), which
  is broadcast. In a task numpy keeps the state of every text position and moves all of
  them on by one word at a time; positions that arrive are counted by ``bincount`` over the
  accepting states, and Spark sums the tasks' counts.
* The same pass proposes the next level: a position whose phrase is a candidate and whose
  right neighbour's is one too starts an Apriori-safe phrase (both its parts are
  frequent). Proposals are pairs of candidates, summed by Spark; those below the least
  count are no candidates. What is reported is the trie's count.

A broadcast trie has ``TRIE_LIMIT`` candidates at most. A level with more is dealt into
several tries by hash, each with a pass of its own; a proposal is then a candidate and the
word behind it, as the right neighbour may lie in another trie. Results are the same.

Texts are cut at piece ends into passes of a few MB, so memory is bounded by the
longest piece, not by the longest text.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows
count each for itself; phrases with equal score and count are ordered by UTF-8 bytes; no
rows, or no phrase often enough, give no rows. Extra columns are ignored. Counts are 64-bit,
products decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.llm.common import passes, shared, utf8

LEAST = 30
WORDS = 4
FIRST = 2000
#: A candidate goes if a longer one holds it and has this many hundredths of its count.
COVERED = 80
SCALE = 2_000_000
UNKNOWN_LANGUAGE = "und"
#: Candidates of one broadcast trie.
TRIE_LIMIT = 1 << 20
#: Bytes of text per numpy pass; entries a task gathers before it hands them on.
TEXT_BYTES, HELD = 4 << 20, 1 << 21

_WORD, _BLANK, _BREAK = range(3)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Text:
    """Words of some texts: distinct words, each word's index among them, its text, and the words left in its piece."""

    def __init__(self, column: pa.Array):
        values, offsets = utf8(column)
        kind = _CLASS[values]
        ink = kind == _WORD
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start, end = ink.copy(), ink.copy()
        start[1:] &= ~ink[:-1]
        start[begins] = ink[begins]
        end[:-1] &= ~ink[1:]
        if values.size:
            end[begins[1:] - 1] = ink[begins[1:] - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        n = starts.size
        sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        joined = _LOWER[values[ink]]
        words = pa.StringArray.from_buffers(n, pa.py_buffer(sizes), pa.py_buffer(joined)) if n else pa.array([], pa.string())
        coded = words.dictionary_encode()
        self.distinct, self.words = coded.dictionary, coded.indices.to_numpy()
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        breaks = np.cumsum(kind == _BREAK, dtype=np.int64)[starts]
        new = np.ones(n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        firsts = np.append(np.flatnonzero(new), n)
        self.left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) arrays of about ``TEXT_BYTES``; a longer text is cut at piece ends."""
    for batch in passes(batches, "text", TEXT_BYTES):
        lang, text = batch.column(batch.schema.get_field_index("lang")), batch.column(batch.schema.get_field_index("text"))
        values, _ = utf8(text)
        if batch.num_rows > 1 or values.size <= 2 * TEXT_BYTES:
            yield lang, text
            continue
        ends = np.flatnonzero(_CLASS[values] == _BREAK) + 1
        cuts = ends[np.minimum(np.searchsorted(ends, np.arange(TEXT_BYTES, values.size, TEXT_BYTES)), ends.size - 1)] if ends.size else ends
        bounds = np.unique(np.concatenate([[0], cuts, [values.size]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            piece = np.ascontiguousarray(values[a:b])
            yield lang, pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, b - a], np.int32)), pa.py_buffer(piece))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of a task's words."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

    rows = 0
    for lang, text in texts(batches):
        t = Text(text)
        langs = lang.dictionary_encode()
        d = max(1, len(t.distinct))
        keys, n = np.unique(langs.indices.to_numpy()[t.doc].astype(np.int64) * d + t.words, return_counts=True)
        if not keys.size:
            continue
        held.append(pa.table({"lang": langs.dictionary.take(pa.array(keys // d)), "phrase": t.distinct.take(pa.array(keys % d)), "n": pa.array(n, pa.int64())}))
        rows += keys.size
        if rows > HELD:
            held = [merged()]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if held:
        yield from merged().combine_chunks().to_batches(max_chunksize=1 << 16)


class Trie:
    """A double array over languages and words: state ``s`` goes with code ``c`` to ``base[s] + c`` if that slot's check is ``s``."""

    def __init__(self, ids: np.ndarray, langs: pa.Array, phrases: pa.Array, seed: int = 1):
        parts = pc.split_pattern(phrases, " ")
        self.depth = len(parts[0]) if len(parts) else 0
        flat = parts.flatten()
        # Words of one language get neighbouring codes: its states then reach over a short stretch.
        names = langs.dictionary_encode()
        order = np.argsort(names.indices.to_numpy(), kind="stable")
        first = np.argsort(np.repeat(names.indices.to_numpy(), self.depth), kind="stable")
        words = flat.take(pa.array(first)).dictionary_encode()
        self.alphabet, self.languages, self.ids = words.dictionary, names.dictionary, ids
        codes = np.empty(len(flat), np.int64)
        codes[first] = words.indices.to_numpy()
        path = np.column_stack([names.indices.to_numpy() + len(self.alphabet), codes.reshape(len(ids), self.depth)])[order]
        accepted = np.arange(len(ids))[order]
        wide = len(self.alphabet) + len(self.languages) + 1
        node, nodes = np.zeros(len(ids), np.int64), 1
        parents, labels = [], []
        for level in range(self.depth + 1):
            key, back = np.unique(node * wide + path[:, level], return_inverse=True)
            parents.append(key // wide)
            labels.append(key % wide)
            node, nodes = nodes + back, nodes + key.size
        parent, label = np.concatenate(parents), np.concatenate(labels)
        rank = np.argsort(parent, kind="stable")  # children keep their numbers: edge i leads to node i + 1
        base, size = _displace(parent[rank], label[rank], nodes, seed)
        slot = np.zeros(nodes, np.int64)
        slot[1:] = base[parent] + label
        self.base, self.check = np.zeros(size + 1, np.int32), np.full(size + 1, -1, np.int32)
        self.accept = np.full(size + 1, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accept[slot[node]] = accepted
        self.start = slot[node[:0]] if not len(ids) else (base[0] + len(self.alphabet) + np.arange(len(self.languages)))

    def arrivals(self, t: Text, lang: pa.Array) -> np.ndarray:
        """For every text position the index of the candidate that starts there, else -1."""
        out = np.full(t.words.size, -1, np.int32)
        if not t.words.size or not len(self.ids):
            return out
        codes = pc.fill_null(pc.index_in(t.distinct, self.alphabet), -1).to_numpy(zero_copy_only=False)[t.words]
        spoken = pc.fill_null(pc.index_in(lang, self.languages), -1).to_numpy(zero_copy_only=False)[t.doc]
        at = np.flatnonzero((codes >= 0) & (spoken >= 0) & (t.left >= self.depth))
        state = self.start[spoken[at]]
        for step in range(self.depth):
            code = codes[at + step]
            target = np.clip(self.base[state] + code, 0, self.check.size - 1)
            alive = (code >= 0) & (self.check[target] == state)
            at, state = at[alive], target[alive]
        out[at] = self.accept[state]
        return out


def _displace(parent: np.ndarray, label: np.ndarray, nodes: int, seed: int) -> tuple[np.ndarray, int]:
    """A base for every node so that no two edges share a slot (slot 0 is the root's). Edges come sorted by parent.

    Nodes of many children are placed first; all nodes of like size try random places at once and keep those
    that are free. The array doubles when too few of them find a place.
    """
    rng = np.random.default_rng(seed)
    base = np.zeros(nodes, np.int64)
    at = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if parent.size else np.zeros(0, np.int64)
    who, degree = parent[at], np.diff(np.append(at, parent.size))
    least, most = (np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)) if parent.size else (at, at)
    size = max(16, 2 * parent.size, 2 * int((most - least).max(initial=0)))
    free = np.ones(size, bool)
    free[0] = False
    grade = np.floor(np.log2(np.maximum(degree, 1))).astype(int)
    for g in sorted(set(grade.tolist()), reverse=True):
        todo = np.flatnonzero(grade == g)
        failed = 0
        while todo.size:
            shift = rng.integers(0, size - (most[todo] - least[todo])) - least[todo]
            count = degree[todo]
            ends = np.cumsum(count)
            edge = np.repeat(at[todo] - (ends - count), count) + np.arange(int(ends[-1]))
            slots = np.repeat(shift, count) + label[edge]
            ok = free[slots]
            winner = np.zeros(slots.size, bool)
            winner[np.unique(slots, return_index=True)[1]] = True
            good = np.logical_and.reduceat(ok & winner, ends - count)
            base[who[todo[good]]] = shift[good]
            free[slots[np.repeat(good, count)]] = False
            failed = 0 if good.sum() * 16 >= good.size else failed + 1
            todo = todo[~good]
            if failed > 8:
                free, size, failed = np.append(free, np.ones(size, bool)), 2 * size, 0
    return base, size


SUMS = "key long, other long, word string, n long"


def _pass(held, propose: bool, alone: bool):
    """Counts of the candidates (other and word null) and, if ``propose``, of the pairs or words that follow."""

    def emit(keys, other, word, n) -> Iterator[pa.RecordBatch]:
        size = len(n)
        table = pa.table([pa.array(keys, pa.int64()), pa.nulls(size, pa.int64()) if other is None else pa.array(other, pa.int64()),
                          pa.nulls(size, pa.string()) if word is None else word, pa.array(n, pa.int64())], names=["key", "other", "word", "n"])
        yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

    def pairs(found: list, trie: Trie) -> Iterator[pa.RecordBatch]:
        keys, n = _added(found)
        yield from emit(trie.ids[keys >> 32], trie.ids[keys & 0xFFFFFFFF], None, n)

    def words(found: list, trie: Trie) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(found).group_by(["key", "word"]).aggregate([("n", "sum")])
        yield from emit(trie.ids[t["key"].to_numpy()], None, t["word"].combine_chunks(), t["n_sum"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = held.value
        total = np.zeros(len(trie.ids), np.int64)
        found, rows = [], 0
        for lang, text in texts(batches):
            t = Text(text)
            here = trie.arrivals(t, lang)
            total += np.bincount(here[here >= 0], minlength=total.size)
            if not propose:
                continue
            more = np.flatnonzero((here >= 0) & (t.left > trie.depth))
            if alone:
                more = more[here[more + 1] >= 0]
                keys, n = np.unique((here[more].astype(np.int64) << 32) | here[more + 1], return_counts=True)
                found.append((keys, n))
            else:
                d = max(1, len(t.distinct))
                keys, n = np.unique(here[more].astype(np.int64) * d + t.words[more + trie.depth], return_counts=True)
                found.append(pa.table({"key": pa.array(keys // d), "word": t.distinct.take(pa.array(keys % d)), "n": pa.array(n, pa.int64())}))
            rows += keys.size
            if rows > HELD:
                yield from (pairs if alone else words)(found, trie)
                found, rows = [], 0
        if found:
            yield from (pairs if alone else words)(found, trie)
        seen = np.flatnonzero(total)
        yield from emit(trie.ids[seen], None, None, total[seen])

    return run


def _added(found: list) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if keys.size else n


def _numbered(candidates: DataFrame, label: str) -> DataFrame:
    return shared(candidates.withColumn("id", F.monotonically_increasing_id()), label)


def _level(docs: DataFrame, candidates: DataFrame, least: int, propose: bool, limit: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """The candidates (id, lang, phrase) with their count ``f``, and the next level's candidates."""
    spark = docs.sparkSession
    size = candidates.count()
    tries = max(1, -(-size // limit))
    counted, proposed = [], []
    for number in range(tries):
        mine = candidates.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(tries)) == number).select("id", "lang", "phrase").toArrow().combine_chunks()
        column = [mine.column(i).combine_chunks() if mine.num_rows else pa.array([], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        held = spark.sparkContext.broadcast(Trie(column[0].to_numpy(), column[1], column[2]))
        sums = docs.mapInArrow(_pass(held, propose, tries == 1), SUMS).groupBy("key", "other", "word").agg(F.sum("n").alias("n"))
        sums = shared(sums, f"{label}-sums")
        held.unpersist()
        is_count = F.col("other").isNull() & F.col("word").isNull()
        counted.append(sums.where(is_count).select(F.col("key").alias("id"), F.col("n").alias("f")))
        proposed.append(sums.where(~is_count & (F.col("n") >= least)))
    union = counted[0], proposed[0]
    for a, b in zip(counted[1:], proposed[1:]):
        union = union[0].unionByName(a), union[1].unionByName(b)
    result = candidates.join(union[0], "id").select("id", "lang", "phrase", "f")
    if not propose:
        return result, None
    head = candidates.select(F.col("id").alias("key"), "lang", "phrase")
    following = union[1].join(head, "key")
    if tries == 1:
        tail = candidates.select(F.col("id").alias("other"), F.element_at(F.split("phrase", " "), -1).alias("last"))
        following = following.join(tail, "other").withColumn("word", F.col("last"))
    return result, _numbered(following.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase")), f"{label}-next")


def count_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, limit: int = TRIE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with all word occurrences, and (lang, phrase, k, f) of all phrases of up to ``words`` words with f >= ``least``."""
    kept = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), "text")
    every = shared(kept.mapInArrow(count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "words")
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = _numbered(every.where(F.col("f") >= least).select("lang", "phrase"), "level-1")
    out = []
    for k in range(1, words + 1):
        found, candidates = _level(kept, candidates, least, k < words, limit, f"level-{k}")
        out.append(found.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"))
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionByName(more)
    return total, shared(phrases, "phrases")


def _part(first, length) -> F.Column:
    return F.array_join(F.slice("w", first, length), " ")


def mine(docs: DataFrame, words: int = WORDS, least: int = LEAST, first: int = FIRST, covered: int = COVERED, limit: int = TRIE_LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    total, phrases = count_phrases(docs, words, least, limit)
    split = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = split.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "j", _part(F.lit(1), F.col("j")).alias("left"), _part(F.col("j") + 1, F.col("k") - F.col("j")).alias("right"))
    f = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(f.toDF("lang", "left", "l"), ["lang", "left"]).join(f.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(20,0)) * cast(a as decimal(18,0))) div cast(l + r as decimal(19,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    # Where shorter phrases lie in longer ones.
    inner = split.where("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    inner = inner.groupBy("lang", _part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    hidden = F.coalesce(100 * F.col("longer").cast("decimal(20,0)") >= covered * F.col("a").cast("decimal(20,0)"), F.lit(False))
    kept = best.join(inner, ["lang", "phrase"], "left").where(~hidden)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
