"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts hashed words and hashed word beginnings, per label on a bounded sample of
labelled documents (``TRAIN_ROWS``, smallest hashes of the ids) and over all documents
for the prior. A word's log-odds are a two-level Dirichlet estimate: the word's own
counts with a prior centred on its beginning, that one with a prior centred on the
labels' overall share. The prior's mass grows with the word's share of the corpus, so
frequent words need more evidence.

Scoring subtracts a drift from the log-odds and finds all maximal scoring segments of the
token row in linear time (Ruzzo and Tompa's rule). Under the clean token distribution the
best segment of n tokens follows an extreme-value law with the expectation
E = K n exp(-lambda S); lambda and K are fitted to the clean training documents by maximum
likelihood. Segments with a small E are the toxic passages. The r best segments of a
document together have the sum T of their lambda S - ln(K n). In a clean document the r-th
best has E as the r-th arrival of a unit Poisson process, so T is -r ln of a Gamma(r) plus a
Gamma(r-1) variable (Karlin and Altschul); its tail is taken from this law for every T and every r,
since the usual exp(-T) T^(r-1) / (r! (r-1)!) holds only for T far above r^2. The document's
evidence is the best -ln of that tail over all r, and its score a logistic function of the evidence.
Calibration uses training documents scored by counts from the other half of the training rows.

Defined cases: null and empty texts hold no token and get the score of a document without
a positive segment; null labels are ignored, the greatest label of a repeated id counts;
a null id counts as the empty text when folds are dealt; without labelled rows of both
kinds every score is 0. Columns beside doc_id, text and toxic are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import blobs, passes, summed, tidy
from strikeloom.llm.letters import Letters

#: Labelled rows used for training at most.
TRAIN_ROWS = 20_000
#: Hash space of words and of beginnings.
BITS = 18
BEGINNING = 5
#: Prior mass in tokens: fixed part, and times the expected count of the word in a sample of this many tokens.
PRIOR_MASS, PRIOR_TOKENS = 6.0, 10_000
CLIP, DRIFT = 8.0, 2.0
#: Clean training documents with a positive segment from which lambda is fitted.
FEW_HITS = 4
#: A passage is significant below this expectation in a clean document.
SIGNIFICANT = 0.05


def folds(column) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def buckets(letters: Letters, batch: pa.RecordBatch, column: int):
    """Token places of a batch and each token's word and beginning bucket."""
    found = letters.tokens(batch.column(column), BEGINNING)
    mask = np.uint64((1 << BITS) - 1)
    return found, (found.names & mask).astype(np.int64), (found.heads & mask).astype(np.int64)


@dataclass
class Model:
    """Per-bucket log-odds parts and the calibration; of fixed size."""

    word_pos: np.ndarray
    word_all: np.ndarray
    mass: np.ndarray
    head_share: np.ndarray
    share: float
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -30.0

    def scores(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        mass = self.mass[word]
        p = (self.word_pos[word] + mass * self.head_share[head]) / (self.word_all[word] + mass)
        base = math.log(self.share / (1 - self.share))
        return np.clip(np.log(p) - np.log1p(-p) - base, -CLIP, CLIP) - DRIFT


def count(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Counts by bucket. Row 0: all words of the corpus; then for each half of the sample
    toxic words, other words, toxic beginnings, other beginnings."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), np.zeros((9, size), np.int64)
        for batch in passes(batches):
            found, word, head = buckets(letters, batch, 0)
            total[0] += np.bincount(word, minlength=size)
            kind = np.array([-1 if x is None else 2 * h + 1 - x for x, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])[found.docs]
            for k in range(4):
                mine = kind == k
                if mine.any():
                    row = 1 + 4 * (k // 2) + k % 2
                    # A labelled document counts once for a word, however often it repeats it.
                    for r, name in ((row, word), (row + 2, head)):
                        total[r] += np.bincount(np.unique(found.docs[mine] * size + name[mine]) % size, minlength=size)
        yield from blobs(total)

    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "toxic", "half")
    return summed(labelled.mapInArrow(tidy(run), "chunk int, counts binary"), (9, size))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one row, by the linear-time rule.

    Runs of positive scores are joined first, since a maximal segment never cuts one.
    """
    positive = np.flatnonzero(scores > 0)
    if not positive.size:
        return []
    first = np.flatnonzero(np.diff(positive, prepend=-2) > 1)
    begin = positive[first]
    end = positive[np.append(first[1:], positive.size) - 1] + 1
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # Candidates (start, end, sum before, sum after), and for each the last one before it with a smaller sum before.
    starts, ends, lows, highs, back = [], [], [], [], []
    done: list[tuple[int, int, float]] = []
    for a, b, low, high in zip(begin.tolist(), end.tolist(), sums[begin].tolist(), sums[end].tolist()):
        while True:
            j = len(starts) - 1
            while j >= 0 and lows[j] >= low:
                j = back[j]
            if j < 0:  # nothing before can join what follows: all candidates are maximal
                done += [(x, y, h - l) for x, y, l, h in zip(starts, ends, lows, highs)]
                starts, ends, lows, highs, back = [], [], [], [], []
            if j < 0 or highs[j] >= high:
                starts.append(a)
                ends.append(b)
                lows.append(low)
                highs.append(high)
                back.append(j)
                break
            # Everything from j on joins the new part, which is then compared again.
            a, low = starts[j], lows[j]
            del starts[j:], ends[j:], lows[j:], highs[j:], back[j:]
    return done + [(x, y, h - l) for x, y, l, h in zip(starts, ends, lows, highs)]


def estimate(corpus: np.ndarray, parts: np.ndarray) -> Model | None:
    """Log-odds from one set of class counts; None if a class has no token."""
    word_pos, word_neg, head_pos, head_neg = parts.astype(np.float64)
    n_pos, n_neg = word_pos.sum(), word_neg.sum()
    if not n_pos or not n_neg:
        return None
    share = min(max(n_pos / (n_pos + n_neg), 1e-4), 0.5)
    mass = PRIOR_MASS + PRIOR_TOKENS * corpus / max(corpus.sum(), 1.0)
    head_share = (head_pos + PRIOR_MASS * share) / (head_pos + head_neg + PRIOR_MASS)
    return Model(word_pos, word_pos + word_neg, mass, head_share, share)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit log-odds and calibration; ``labels`` (doc_id, toxic) holds only rows that may be used."""
    sample = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    corpus, *halves = count(docs, sample)
    halves = np.array(halves).reshape(2, 4, -1)
    model = estimate(corpus, halves.sum(axis=0))
    crossed = [estimate(corpus, halves[1 - h]) for h in (0, 1)]
    if model is None or None in crossed:
        return model
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Twice at most ``rows`` rows of three numbers reach the driver: for the law, then for the map of the evidence under that law.
    found = score(held, crossed, keep=("toxic", "half"), choose="half").select("toxic", "tokens", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).toPandas()
    fit_law(model, *(found[c].to_numpy() for c in ("toxic", "best", "tokens")))
    for m in crossed:
        m.lam, m.log_k = model.lam, model.log_k
    seen = score(held, crossed, keep=("toxic", "half"), choose="half").select("toxic", "tokens", "evidence").toPandas()
    fit_map(model, seen["toxic"].to_numpy(), seen["evidence"].to_numpy())
    return model


def fit_law(model: Model, toxic: np.ndarray, best: np.ndarray, tokens: np.ndarray) -> None:
    """Extreme-value parameters from the best segments of the clean documents."""
    clean = (toxic == 0) & (tokens > 0)
    if clean.any():
        model.lam, model.log_k = gumbel(best[clean], np.log(tokens[clean]))


def fit_map(model: Model, toxic: np.ndarray, x: np.ndarray) -> None:
    """The logistic map of the evidence."""
    y = toxic.astype(float)
    centre, spread = x.mean(), x.std() or 1.0
    z, (a, b) = (x - centre) / spread, (0.0, 0.0)
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression in one variable
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 0.0) / spread), float(b - max(a, 0.0) * centre / spread)


def gumbel(best: np.ndarray, log_n: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of P(S < s) = exp(-K n exp(-lambda s)); rows without a positive
    segment are censored at 0. For given lambda, K has a closed form. With hardly any such
    segment lambda stays 1, and half a segment is added to what was seen."""
    hit = best > 0
    few = hit.sum() < FEW_HITS

    def fit(lam: float) -> tuple[float, float]:
        t = log_n - lam * best
        top = t.max()
        log_k = math.log(hit.sum() + 0.5 * few) - top - math.log(np.exp(t - top).sum())
        return hit.sum() * (math.log(lam) + log_k - 1) + t[hit].sum(), log_k

    if few:
        return 1.0, fit(1.0)[1]
    low, high = 0.02, 8.0
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if fit(a)[0] < fit(b)[0]:
            low = a
        else:
            high = b
    lam = (low + high) / 2
    return lam, fit(lam)[1]


def gammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ln Gamma and its first three derivatives but the second's sign, for x > 0: Stirling's series after eight steps up."""
    k = x[:, None] + np.arange(8)
    y = x + 8
    i, q = 1 / y, 1 / (y * y)
    log = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680)))
    one = np.log(y) - i / 2 - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240)))
    two = i + q / 2 + i * q * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30)))
    three = q + i * q + q * q * (1 / 2 - q * (1 / 6 - q * (1 / 6 - q * 3 / 10)))
    return log - np.log(k).sum(axis=1), one - (1 / k).sum(axis=1), two + (1 / k**2).sum(axis=1), three + (2 / k**3).sum(axis=1)


def log_normal_tail(w: np.ndarray) -> np.ndarray:
    """ln P(N > w), by Chebyshev coefficients of erfc (relative error 1e-7)."""
    z = np.abs(w) / math.sqrt(2)
    t, c = 1 / (1 + z / 2), 0.0
    for a in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        c = a + t * c
    far = np.log(t / 2) - z * z + c
    return np.where(w < 0, np.log1p(-np.exp(np.minimum(far, 0.0))), far)


def log_tail(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """ln P(T_r > t) in a clean document, for every t; r = 1 in closed form, other r by a saddle point.

    For r > 2 and t below the mean it is 0: T_r has a log-concave density, so there the tail is at
    least 1/e, which the factor for looking at every r outweighs.
    """
    out = np.zeros(len(t))
    one = r == 1
    out[one] = np.log(-np.expm1(-np.exp(-np.maximum(t[one], -700.0)))) if one.any() else 0.0
    rest = np.flatnonzero(~one)
    if not rest.size:
        return out
    # The mean of T_r is r - 1 - r psi(r) < r - 1 - r ln r + 1, so most sums of many segments end here.
    rest = rest[(r[rest] == 2) | (t[rest] > -r[rest] * np.log(r[rest]) + r[rest] - 1)]
    n, s = r[rest].astype(float), t[rest]
    whole, psi, _, _ = gammas(n)
    keep = (n == 2) | (s > n - 1 - n * psi)
    rest, n, s, whole = rest[keep], n[keep], s[keep], whole[keep]
    if not rest.size:
        return out
    # ln E exp((1 - phi) T) = ln Gamma(n phi) - ln Gamma(n) - (n - 1) ln phi; its slope falls with phi. Newton in ln phi, kept in a bracket.
    low, high = np.full(len(n), -60.0), np.maximum(1.0, -s / n + 3.0)
    u = np.where(s > n, np.log(n / np.maximum(s, n)), 0.0)
    for _ in range(100):
        phi = np.exp(u)
        log, psi, tri, _ = gammas(n * phi)
        off = (n - 1) / phi - n * psi - s
        low, high = np.where(off > 0, u, low), np.where(off > 0, high, u)
        # Steps in the logarithm of phi times the slope, which is nearly straight far out.
        step = off / (phi * ((n - 1) / phi**2 + n * n * tri))
        nxt = u + step
        nxt = np.where((nxt > low) & (nxt < high), nxt, (low + high) / 2)
        done = np.abs(nxt - u).max() < 1e-10
        u = nxt
        if done:
            break
    phi = np.exp(u)
    log, _, tri, tetra = gammas(n * phi)
    theta = 1 - phi
    var = (n - 1) / phi**2 + n * n * tri
    skew = (2 * (n - 1) / phi**3 + n**3 * tetra) / var**1.5
    w = np.sign(theta) * np.sqrt(np.maximum(0.0, 2 * (theta * s - (log - whole - (n - 1) * u))))
    far = np.abs(w) > 0.02
    v = np.where(far, theta * np.sqrt(var), 1.0)
    safe = np.where(far, w, 1.0)
    out[rest] = log_normal_tail(np.where(far, w + np.log(v / safe) / safe, w + skew / 6))
    return out


def evidences(lam: np.ndarray, log_kn: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """-ln of the smallest tail probability over the r best segments, for many documents at once.

    Every row of ``lam`` and ``log_kn`` (the law's lambda and ln(K n)) belongs to one document.
    """
    out = np.zeros(len(found))
    some = [i for i, x in enumerate(found) if len(x)]
    if not some:
        return out
    sizes = np.array([len(found[i]) for i in some])
    ends = np.cumsum(sizes)
    t = np.concatenate([np.cumsum(lam[i] * np.sort(found[i])[::-1] - log_kn[i]) for i in some])
    r = np.arange(1, ends[-1] + 1) - np.repeat(ends - sizes, sizes)
    # Looking at every r costs a factor of 2 for each further segment.
    best = np.maximum.reduceat(-log_tail(t, r) - (r - 1) * math.log(2), ends - sizes)
    out[some] = np.maximum(best, 0.0)
    return out


def evidence(model: Model, scores: np.ndarray, tokens: int) -> float:
    """The evidence of one document."""
    return float(evidences(np.array([model.lam]), np.array([model.log_k + math.log(max(tokens, 1))]), [np.asarray(scores, float)])[0])


def score(docs: DataFrame, model: Model | list[Model] | None, keep=(), choose: str | None = None) -> DataFrame:
    """doc_id, tokens, segments (scores of all maximal segments), evidence, score and passages
    (start:end in code points, of all significant ones), with the ``keep`` columns that have other names.

    With several models the integer column ``choose``, one of ``keep``, names each row's.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model if isinstance(model, list) else [model])
    first = 1 if "text" in keep else 2
    others = [c for c in keep if c not in ("doc_id", "text", "tokens", "segments", "evidence", "score", "passages")]
    kept = [(c, docs.schema[c].dataType.simpleString()) for c in (["text"] if first == 1 else []) + others]
    own = "doc_id long, tokens long, segments array<double>, evidence double, score double, passages string"
    kinds = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("segments", pa.list_(pa.float64())), ("evidence", pa.float64()), ("score", pa.float64()), ("passages", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, models = Letters(), shipped.value
        for batch in passes(batches):
            found, word, head = buckets(letters, batch, 1)
            values = [None if m is None else m.scores(word, head) for m in models]
            which = batch.column(batch.schema.get_field_index(choose)).to_pylist() if choose else [0] * batch.num_rows
            sizes, points, spans = np.diff(found.bounds), [], []
            out, laws = [], np.zeros((2, batch.num_rows))
            for i in range(batch.num_rows):
                a, b, m = found.bounds[i], found.bounds[i + 1], models[which[i]]
                parts = segments(values[which[i]][a:b]) if m else []
                out.append([s for _, _, s in parts])
                limit = (m.log_k + math.log(b - a) - math.log(SIGNIFICANT)) / m.lam if parts else 0.0
                spans.append(",".join(f"{found.starts[a + x] - found.offsets[i]}:{found.ends[a + y - 1] - found.offsets[i]}" for x, y, s in parts if s > limit))
                laws[:, i] = (m.lam, m.log_k + math.log(max(b - a, 1))) if m else 0.0
            seen = evidences(laws[0], laws[1], [np.array(x) for x in out])
            for i, x in enumerate(seen.tolist()):
                m = models[which[i]]
                points.append(1 / (1 + math.exp(-max(-60.0, min(60.0, m.slope * x + m.offset)))) if m else 0.0)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, kinds.field(2).type), pa.array(seen, pa.float64()), pa.array(points), pa.array(spans, pa.string()), *batch.columns[first:]]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*kinds, *(batch.schema.field(first + i) for i in range(len(kept)))]))

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    return columns.mapInArrow(tidy(run), ", ".join([own, *(f"`{c}` {t}" for c, t in kept)]))
