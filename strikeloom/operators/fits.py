"""Model fits: sums of products are Spark aggregates, only small dense solves are local.

Gram matrices are summed per key by Spark. The solves see one key's Gram at a
time (at most 41 unknowns), as rows of arrow batches, so no extra shuffle and no
group larger than unknowns squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import LAMBDA_GRID, MAG_GAMMA
from strikeloom.functions.ordered import order_prefix
from strikeloom.functions.quantiles import exact_quantiles
from strikeloom.functions.scalar import ratio, ratio_or

RECORD = ("ticker", "ts")


def param_rows(df: DataFrame, name: str, grid: Sequence[float]) -> DataFrame:
    """Each row once per value of a fixed parameter list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in grid])))


def grid_nodes(cells: DataFrame, psi_cols: DataFrame, gammas: Sequence[float]) -> DataFrame:
    """Node values under each magnitude exponent of the instant weights."""
    base = psi_cols.select("ticker", "ts", "expiry", "psi")
    size = F.pow(F.abs("psi"), F.col("gamma") / F.lit(MAG_GAMMA)) * F.signum("psi")
    w = param_rows(base, "gamma", gammas).withColumn("_w", size)
    return cells.select("ticker", "ts", "strike", "expiry", "g").join(w, ["ticker", "ts", "expiry"]).groupBy(
        "ticker", "ts", "gamma", "strike").agg(F.sum(F.col("_w") * F.col("g")).alias("v"))


# --- per-column fits --------------------------------------------------------------

def column_sums(cells: DataFrame, keys: Sequence[str] = RECORD, y: str = "y", x: str = "g") -> DataFrame:
    """Sums of one column over its cells with a non-zero basis."""
    cell = cells.where(F.col(x) != 0)
    return cell.groupBy(*keys, "expiry").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(x)).alias("s_yx"), F.sum(F.col(x) * F.col(x)).alias("s_xx"),
        F.sum(F.col(y) * F.col(y)).alias("s_yy"), F.sum(F.abs(x)).alias("s_ax"))


def free_weights(sums: DataFrame, min_n: int = 5) -> DataFrame:
    """Least squares through the origin per column; thin columns get no weight."""
    ok = (F.col("n") >= min_n) & (F.col("s_xx") > 0)
    a = F.when(ok, F.col("s_yx") / F.col("s_xx"))
    return sums.withColumn("a", a).withColumn(
        "r2", F.when(F.col("a").isNotNull() & (F.col("s_yy") > 0), F.col("a") * F.col("s_yx") / F.col("s_yy")))


def column_spearman(cells: DataFrame, keys: Sequence[str] = RECORD, y: str = "y", x: str = "g") -> DataFrame:
    """Rank correlation within a column (average ranks); a column is a few hundred strikes."""
    col = Window.partitionBy(*keys, "expiry")
    rows = cells.where(F.col(x) != 0)
    for c, out in ((y, "_ry"), (x, "_rx")):
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "expiry", c))
        rows = rows.withColumn(out, F.rank().over(col.orderBy(c)) + (same - 1) / 2)
    rho = F.coalesce(F.nanvl(F.corr("_ry", "_rx"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*keys, "expiry").agg(F.when(F.count(F.lit(1)) >= 3, rho).otherwise(0.0).alias("rho"))


def shape_grid(free: DataFrame, params: Sequence[float], shape: Column, keys: Sequence[str] = RECORD) -> DataFrame:
    """Best parameter of a one-scale shape model per record, by squared error against the free fit.

    Works on column sums only: the error of weights k*s is
    sum(S_yy - 2 k s S_yx + k^2 s^2 S_xx).
    """
    rows = param_rows(free, "param", params).withColumn("_s", shape)
    per = rows.groupBy(*keys, "param").agg(
        F.sum(F.col("_s") * F.col("s_yx")).alias("_num"), F.sum(F.col("_s") * F.col("_s") * F.col("s_xx")).alias("_den"),
        F.sum("s_yy").alias("_yy"), F.sum(F.coalesce(F.col("a") * F.col("s_yx"), F.lit(0.0))).alias("_fit"))
    kappa = F.col("_num") / F.col("_den")
    per = per.where(F.col("_den") > 0).withColumns({
        "kappa": kappa, "sse": F.col("_yy") - 2 * kappa * F.col("_num") + kappa * kappa * F.col("_den"),
        "sse_free": F.col("_yy") - F.col("_fit")})
    best = F.min_by(F.struct("param", "kappa", "sse", "sse_free"), F.struct("sse", "param"))
    return per.groupBy(*keys).agg(best.alias("b")).select(
        *keys, "b.param", "b.kappa", ratio("b.sse", "b.sse_free").alias("sse_ratio"))


def baseline_shapes(free: DataFrame, day: Column, keys: Sequence[str] = RECORD) -> dict[str, DataFrame]:
    """Uniform, days-to-expiry power and column-size power models."""
    dte = F.greatest(F.datediff("expiry", day).cast("double"), F.lit(0.25))
    top = F.max("s_ax").over(Window.partitionBy(*keys))
    rows = free.withColumns({"_dte": dte, "_rel": F.col("s_ax") / top})
    return {
        "uniform": shape_grid(rows, [0.0], F.lit(1.0), keys),
        "dte_power": shape_grid(rows, [i * 0.05 for i in range(61)], F.pow("_dte", -F.col("param")), keys),
        "size_power": shape_grid(rows, [-2.0 + i * 0.1 for i in range(41)], F.when(F.col("_rel") > 0, F.pow("_rel", F.col("param"))).otherwise(0.0), keys),
    }


# --- Gram matrices and solves -------------------------------------------------------

def joint_gram(cells: DataFrame, vector: DataFrame, keys: Sequence[str], x: str = "g", vector_keys: Sequence[str] | None = None) -> DataFrame:
    """Gram entries and right-hand sides of a record, indexed by expiry.

    One array per strike holds its non-zero expiries; only the upper triangle of
    its outer product is summed, so the rows per strike are bounded by the
    expiries it trades.
    """
    keys = list(keys)
    per_strike = cells.where(F.col(x) != 0).groupBy(*keys, "strike").agg(
        F.sort_array(F.collect_list(F.struct("expiry", F.col(x).alias("v")))).alias("row"))
    pairs = per_strike.select(*keys, F.explode(F.flatten(F.transform(
        "row", lambda p: F.transform(F.filter("row", lambda q: q["expiry"] >= p["expiry"]),
                                     lambda q: F.struct(p["expiry"].alias("e1"), q["expiry"].alias("e2"), (p["v"] * q["v"]).alias("s")))))).alias("p"))
    gram = pairs.groupBy(*keys, "p.e1", "p.e2").agg(F.sum("p.s").alias("s"))
    gram = gram.groupBy(*keys).agg(F.collect_list(F.struct("e1", "e2", "s")).alias("gram"))
    vkeys = list(vector_keys or keys)
    rhs = per_strike.join(vector.select(*vkeys, "strike", "y"), [*keys, "strike"]).select(*vkeys, "y", F.explode("row").alias("r"))
    rhs = rhs.groupBy(*vkeys, F.col("r.expiry").alias("e")).agg(F.sum(F.col("r.v") * F.col("y")).alias("b"))
    rhs = rhs.groupBy(*vkeys).agg(F.collect_list(F.struct("e", "b")).alias("rhs"))
    return rhs.join(gram, keys)


def _ridge_solver(keys: Sequence[str], relative: float, absolute: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, rec in pdf.iterrows():
                names = sorted({e for g in rec["gram"] for e in (g["e1"], g["e2"])})
                at = {e: i for i, e in enumerate(names)}
                m = np.zeros((len(names), len(names)))
                b = np.zeros(len(names))
                for g in rec["gram"]:
                    i, j = at[g["e1"]], at[g["e2"]]
                    m[i, j] = m[j, i] = g["s"]
                for h in rec["rhs"]:
                    b[at[h["e"]]] = h["b"]
                lam = relative * np.trace(m) / max(1, len(names)) + absolute
                try:
                    a = np.linalg.solve(m + lam * np.eye(len(names)), b)
                except np.linalg.LinAlgError:
                    a = np.linalg.lstsq(m, b, rcond=None)[0]
                out.append({**{k: rec[k] for k in keys}, "expiries": names, "a": a.tolist(),
                            "fit": float(2 * a @ b - a @ m @ a), "n_expiries": len(names)})
            if out:
                yield pd.DataFrame(out)
    return run


def solve_ridge(gram: DataFrame, keys: Sequence[str], relative: float = 1e-3, absolute: float = 0.0) -> DataFrame:
    """Ridge weights per record with ``fit`` = squared norm explained (2 a'b - a'Ga)."""
    types = {f.name: f.dataType.simpleString() for f in gram.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", expiries array<date>, a array<double>, fit double, n_expiries int"
    return gram.mapInPandas(_ridge_solver(list(keys), relative, absolute), schema)


def weights_long(solved: DataFrame, keys: Sequence[str]) -> DataFrame:
    return solved.select(*keys, F.explode(F.arrays_zip("expiries", "a")).alias("z")).select(
        *keys, F.col("z.expiries").alias("expiry"), F.col("z.a").alias("a"))


def frame_fit(cells: DataFrame, frames: DataFrame, keys: Sequence[str], x: str = "g", step: int = 1) -> DataFrame:
    """Ridge weights and R2 of every frame (with ``step``, of every step-th) over the strikes of its own axis.

    ``frames`` has keys, frame, axis, strike and y. One Gram per (record, axis)
    serves all its frames.
    """
    keys = list(keys)
    used = frames.where(F.col("frame") % step == 0)
    on_axis = cells.join(used.select(*keys, "axis", "strike").distinct(), [*keys, "strike"])
    shared = used.join(cells.where(F.col(x) != 0).select(*keys, "strike").distinct(), [*keys, "strike"], "left_semi")
    solved = solve_ridge(joint_gram(on_axis, shared, [*keys, "axis"], x, [*keys, "axis", "frame"]), [*keys, "axis", "frame"])
    held = used.join(on_axis.select(*keys, "axis", "strike").distinct(), [*keys, "axis", "strike"], "left_semi")
    norms = held.groupBy(*keys, "axis", "frame").agg(
        F.sum(F.col("y") * F.col("y")).alias("_yy"), F.sum("y").alias("_y"), F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("_top"))
    out = solved.join(norms, [*keys, "axis", "frame"]).where((F.col("_top") > 0) & (F.col("n_expiries") >= 2))
    total = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n")
    return out.withColumn("r2", F.when(total > 0, 1 - (F.col("_yy") - F.col("fit")) / total).otherwise(0.0)).drop("_yy", "_y", "_top")


# --- feature model ------------------------------------------------------------------

def moment_sums(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: Column) -> DataFrame:
    """All products of the design with itself and with the response, one row per key."""
    p = len(xs)
    aggs = [F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(p) for j in range(i, p)]
    rhs = [F.sum(F.col(c) * y) for c in xs]
    return rows.groupBy(*keys).agg(
        F.array(*aggs).alias("gram"), F.array(*rhs).alias("rhs"), F.sum(y * y).alias("yy"), F.sum(y).alias("ysum"), F.count(F.lit(1)).alias("n"))


def add_arrays(a, b, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y)


def unpack(gram: Sequence[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = gram
    return m + np.triu(m, 1).T


def _min_norm(p: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            theta = [np.linalg.pinv(unpack(g, p), rcond=1e-12, hermitian=True) @ np.asarray(b) for g, b in zip(pdf["gram"], pdf["rhs"])]
            yield pdf.drop(columns=["gram", "rhs"]).assign(theta=[t.tolist() for t in theta])
    return run


def solve_min_norm(sums: DataFrame, p: int) -> DataFrame:
    """Minimum-norm least squares per row of Gram sums; collinear terms share their weight."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name not in ("gram", "rhs")]
    return sums.mapInPandas(_min_norm(p), ", ".join([*kept, "theta array<double>"]))


def fold_models(samples: DataFrame, fold: str, xs: Sequence[str], y: Column) -> DataFrame:
    """Coefficients fitted without each fold (all other folds' sums), plus one over everything."""
    own = moment_sums(samples, [fold], xs, y)
    p = len(xs)
    size, names = p * (p + 1) // 2, ("gram", "rhs")
    flat = own.select(fold, "n", *[F.col("gram")[i].alias(f"g{i}") for i in range(size)], *[F.col("rhs")[i].alias(f"b{i}") for i in range(p)])
    cols = [c for c in flat.columns if c != fold]
    whole = Window.partitionBy()
    train = flat.select(fold, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in cols])
    total = flat.groupBy().agg(*[F.sum(c).alias(c) for c in cols]).withColumn(fold, F.lit(None).cast(flat.schema[fold].dataType))
    both = train.unionByName(total)
    packed = both.select(fold, "n", F.array(*[f"g{i}" for i in range(size)]).alias(names[0]), F.array(*[f"b{i}" for i in range(p)]).alias(names[1]))
    return solve_min_norm(packed, p)


def predict(theta: Column, xs: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(xs):
        out = out + theta[i] * F.col(c)
    return out


# --- trajectories ---------------------------------------------------------------------

def persistence_error(series: DataFrame, keys: Sequence[str], group: Sequence[str], lams: Sequence[float] = LAMBDA_GRID, min_points: int = 10) -> DataFrame:
    """Mean squared one-step error of lam*w + (1-lam)*mean for each lam, per group of trajectories."""
    keys = list(keys)
    own = Window.partitionBy(*keys)
    rows = series.where(F.col("a") != 0).withColumns({
        "_next": F.lead("a").over(own.orderBy("ts")), "_mean": F.avg("a").over(own), "_n": F.count(F.lit(1)).over(own)})
    rows = param_rows(rows.where((F.col("_n") >= min_points) & F.col("_next").isNotNull()), "lam", lams)
    err = F.col("_next") - (F.col("lam") * F.col("a") + (1 - F.col("lam")) * F.col("_mean"))
    return rows.groupBy(*group, "lam").agg(F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n"))


# --- within-column feature quality ------------------------------------------------------

def feature_cos2(rows: DataFrame, names: Sequence[str], keys: Sequence[str], target: str = "y", mask: str = "g", min_n: int = 5) -> DataFrame:
    """cos2 of each feature with the target within each column, long form."""
    t = F.col(target)
    used = rows.where(F.col(mask) != 0)
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(t * t).alias("_tt")]
    for i, c in enumerate(names):
        aggs.append(F.struct(F.lit(c).alias("feature"), F.sum(t * F.col(c)).alias("tx"), F.sum(F.col(c) * F.col(c)).alias("xx")).alias(f"_f{i}"))
    per = used.groupBy(*keys).agg(*aggs).where(F.col("_n") >= min_n)
    long = per.select(*keys, "_tt", F.explode(F.array(*[f"_f{i}" for i in range(len(names))])).alias("f"))
    ok = (F.col("_tt") > 0) & (F.col("f.xx") > 0)
    return long.where(ok).select(*keys, "f.feature", (F.col("f.tx") * F.col("f.tx") / (F.col("_tt") * F.col("f.xx"))).alias("cos2"))


def ordinal_spearman(rows: DataFrame, keys: Sequence[str], target: str, feature: str, mask: str = "g", min_n: int = 5, tie: str = "strike") -> DataFrame:
    """Correlation of row-number ranks within each column; constant columns are left out."""
    col = Window.partitionBy(*keys)
    used = rows.where(F.col(mask) != 0).withColumns({
        "_rt": F.row_number().over(col.orderBy(target, tie)), "_rf": F.row_number().over(col.orderBy(feature, tie))})
    per = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.corr("_rt", "_rf").alias("rho"), F.min(target).alias("_a"), F.max(target).alias("_b"),
        F.min(feature).alias("_c"), F.max(feature).alias("_d"))
    return per.where((F.col("_n") >= min_n) & (F.col("_a") != F.col("_b")) & (F.col("_c") != F.col("_d"))).select(*keys, "rho")


def quartiles(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(long, keys, value, {"median": (0.5, "linear"), "p25": (0.25, "linear"), "p75": (0.75, "linear")})


# --- weight variants ------------------------------------------------------------------

def variant_weights(weights: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """Weights under each named variant: magnitude power, spread clip, sign rule.

    ``weights`` has a and the column sums net, flip and flow. The clip works
    around the geometric mean of a record's non-zero weights.
    """
    spec = [F.struct(F.lit(v["name"]).alias("variant"), F.lit(float(v.get("power", 1.0))).alias("power"),
                     F.lit(v.get("clip")).cast("double").alias("clip"), F.lit(v.get("sign", "net")).alias("sign_rule"),
                     F.lit(v.get("basis", "net")).alias("basis")) for v in variants]
    rows = weights.select("*", F.explode(F.array(*spec)).alias("s")).select(*weights.columns, "s.*")
    mag = F.when(F.col("a") != 0, F.pow(F.abs("a"), F.col("power")))
    rec = Window.partitionBy("ticker", "ts", "variant")
    rows = rows.withColumn("_m", mag).withColumns({
        "_lo": F.min("_m").over(rec), "_hi": F.max("_m").over(rec), "_gm": F.exp(F.avg(F.ln("_m")).over(rec))})
    half = F.sqrt("clip")
    clipped = F.when(F.col("clip").isNotNull() & (F.col("_hi") / F.col("_lo") > F.col("clip")),
                     F.greatest(F.least(F.col("_m"), F.col("_gm") * half), F.col("_gm") / half)).otherwise(F.col("_m"))
    up = lambda c: F.when(F.col(c) >= 0, 1.0).otherwise(-1.0)
    sign = (F.when(F.col("sign_rule") == "flip", up("flip")).when(F.col("sign_rule") == "flow", up("flow"))
            .when(F.col("sign_rule") == "positive", F.lit(1.0)).otherwise(F.signum("a")))
    return rows.withColumn("av", F.coalesce(sign * clipped, F.lit(0.0))).drop("_m", "_lo", "_hi", "_gm", "s")


# --- iterative fits -------------------------------------------------------------------

def record_moments(design: DataFrame, p: int = 8, keys: Sequence[str] = RECORD) -> DataFrame:
    """Per record u = X'v, G = X'X and v'v from node designs x1..xp and the target y."""
    xs = [f"x{i}" for i in range(1, p + 1)]
    return moment_sums(design, keys, xs, F.col("y")).select(*keys, "gram", "rhs", F.col("yy").alias("vv"))


def _partial_sums(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sum the fixed-size arrays executors return, one per partition; Spark adds them, the driver holds one."""
    partial = rows.mapInPandas(run, "s array<double>")
    long = partial.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for row in long.toLocalIterator():
        out[row["i"]] = row["x"]
    return out


class ProfiledFit:
    """Maximise the summed cos2 between record vectors and their designs.

    The records are read once per step by executors, which return partial sums;
    the driver only ever holds p x p numbers.
    """

    def __init__(self, moments: DataFrame, models: Sequence[tuple[str | None, str | None]] = ((None, None),), p: int = 8):
        """A model is (run, held-out fold): it uses the records of its run outside that fold.

        ``run`` and ``fold`` are text columns of ``moments``; None stands for all.
        """
        for name in ("run", "fold"):
            if name not in moments.columns:
                moments = moments.withColumn(name, F.lit(None).cast("string"))
        self.p, self.models = p, list(models)
        self.rows = moments.select("run", "fold", "gram", "rhs", "vv")

    def _sum(self, fn, size: int, held_out: bool = False) -> np.ndarray:
        p, models = self.p, self.models

        def used(run, fold):
            return [(r is None or r == run) and ((f == fold) if held_out else (f is None or f != fold)) for r, f in models]

        def run(batches):
            acc = np.zeros(size)
            for pdf in batches:
                if len(pdf):
                    mask = np.array([used(r, f) for r, f in zip(pdf["run"], pdf["fold"])])
                    acc += fn(np.array([unpack(g, p) for g in pdf["gram"]]), np.stack(pdf["rhs"].to_numpy()), pdf["vv"].to_numpy(), mask)
            yield pd.DataFrame({"s": [acc.tolist()]})

        return _partial_sums(self.rows, run, size)

    def objective(self, betas: np.ndarray, held_out: bool = False) -> np.ndarray:
        """Summed cos2 for betas of shape (models, candidates, p)."""
        m, k, p = betas.shape

        def fn(g, u, vv, mask):
            q = np.einsum("mka,rab,mkb->rmk", betas, g, betas, optimize=True)
            ub = np.einsum("ra,mka->rmk", u, betas)
            ok = (q > 0) & (vv[:, None, None] > 0) & mask[:, :, None]
            return np.where(ok, ub ** 2 / np.where(ok, q * vv[:, None, None], 1.0), 0.0).sum(axis=0).ravel()

        return self._sum(fn, m * k, held_out).reshape(m, k)

    def _surrogates(self, betas: np.ndarray) -> np.ndarray:
        m, k, p = betas.shape

        def fn(g, u, vv, mask):
            q = np.einsum("mka,rab,mkb->rmk", betas, g, betas, optimize=True)
            ok = (q > 0) & mask[:, :, None]
            w = np.where(ok, 1.0 / np.where(ok, q, 1.0), 0.0)
            return np.einsum("rmk,ra,rb->mkab", w, u, u, optimize=True).ravel()

        return self._sum(fn, m * k * p * p).reshape(m, k, p, p)

    def _values_and_gradients(self, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, k, p = betas.shape

        def fn(g, u, vv, mask):
            gb = np.einsum("rab,mkb->rmka", g, betas, optimize=True)
            q = np.einsum("rmka,mka->rmk", gb, betas)
            ok = (q > 0) & (vv[:, None, None] > 0) & mask[:, :, None]
            q, vs = np.where(ok, q, 1.0), np.where(ok, vv[:, None, None], 1.0)
            ub = np.where(ok, np.einsum("ra,mka->rmk", u, betas), 0.0)
            value = (ub ** 2 / (q * vs)).sum(axis=0)
            grad = np.einsum("rmk,ra->mka", 2 * ub / (q * vs), u) - np.einsum("rmk,rmka->mka", 2 * ub ** 2 / (q * q * vs), gb)
            return np.concatenate([value.ravel(), grad.ravel()])

        s = self._sum(fn, m * k * (1 + p))
        return s[:m * k].reshape(m, k), s[m * k:].reshape(m, k, p)

    def fit(self, iters: int = 20, refine: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (models, p) and objectives (models,); every step is one pass for all models."""
        p, m = self.p, len(self.models)
        third = np.zeros(p)
        third[[0, 1, 5]] = 0.5
        betas = np.tile(np.stack([np.eye(p)[0], np.full(p, p ** -0.5), third]), (m, 1, 1))
        best = self.objective(betas)
        live = np.ones(best.shape, dtype=bool)
        for _ in range(iters):
            if not live.any():
                break
            mats = self._surrogates(betas)
            cand = betas.copy()
            for i, k in zip(*np.nonzero(live)):
                v = betas[i, k]
                for _ in range(200):
                    nv = mats[i, k] @ v
                    norm = np.linalg.norm(nv)
                    if norm == 0:
                        break
                    v = nv / norm
                cand[i, k] = v
            j = self.objective(cand)
            live &= j > best
            betas[live], best[live] = cand[live], j[live]
        top = best.argmax(axis=1)
        beta = betas[np.arange(m), top]
        beta, j = beta / np.linalg.norm(beta, axis=1, keepdims=True), best[np.arange(m), top]
        etas = np.array([1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001])
        grad = self._values_and_gradients(beta[:, None, :])[1][:, 0]
        going = np.ones(m, dtype=bool)
        for _ in range(refine):
            norm = np.linalg.norm(grad, axis=1, keepdims=True)
            going &= norm[:, 0] > 0
            if not going.any():
                break
            cand = beta[:, None, :] + etas[None, :, None] * (grad / np.where(norm > 0, norm, 1.0))[:, None, :]
            cand /= np.linalg.norm(cand, axis=2, keepdims=True)
            js, grads = self._values_and_gradients(cand)
            better = js > j[:, None]
            going &= better.any(axis=1)
            first = better.argmax(axis=1)
            for i in np.flatnonzero(going):
                beta[i], j[i], grad[i] = cand[i, first[i]], js[i, first[i]], grads[i, first[i]]
        return beta, j


def packed_columns(rows: DataFrame, names: Sequence[str], keys: Sequence[str], target: str, fold: Column, mask: str = "g") -> DataFrame:
    """One row per column with its cells as arrays (bounded by the strikes of a column)."""
    return rows.where(F.col(mask) != 0).withColumn("fold", fold.cast("string")).groupBy(*keys, "fold").agg(
        F.collect_list(F.array(*[F.col(c).cast("double") for c in names])).alias("x"), F.collect_list(F.col(target).cast("double")).alias("t"))


def standardization(rows: DataFrame, names: Sequence[str], mask: str = "g") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature; a constant one has its value and 1, so that it becomes 0."""
    used = rows.where(F.col(mask) != 0)
    one = used.agg(*[fn(c).alias(f"{p}{i}") for i, c in enumerate(names) for p, fn in (("m", F.avg), ("v", F.var_pop), ("a", F.min), ("b", F.max))]).first()
    means, var, low, high = (np.array([one[f"{p}{i}"] for i in range(len(names))], dtype=float) for p in "mvab")
    return np.where(low == high, low, means), np.where(low == high, 1.0, np.sqrt(np.maximum(var, 1e-30)))


def ridge_solution(gram: np.ndarray, rhs: np.ndarray, ridge: float) -> np.ndarray:
    """(gram + ridge) theta = rhs for a right-hand side in the range of gram.

    Directions of exactly dependent features hold only rounding, far above a small ridge; they are left out.
    """
    scale = np.sqrt(np.diag(gram) + ridge)
    unit = gram / np.outer(scale, scale)
    values, vectors = np.linalg.eigh((unit + unit.T) / 2)
    null = vectors[:, values <= 1e-13 * len(rhs) * max(values[-1], 0.0)] / scale[:, None]
    q = np.linalg.qr(null)[0] if null.shape[1] else np.zeros((len(rhs), 0))
    # Within the orthogonal complement of the dependent directions the ridge system is regular.
    keep = np.linalg.qr(np.hstack([q, np.eye(len(rhs))]))[0][:, q.shape[1]:]
    return keep @ np.linalg.solve(keep.T @ gram @ keep + ridge * np.eye(keep.shape[1]), keep.T @ rhs)


def alternating_fits(packed: DataFrame, means: np.ndarray, norms: np.ndarray, folds: Sequence[str], ridge: float = 1e-8,
                     iters: int = 12, min_n: int = 5, groups: dict[str, Sequence[int]] | None = None) -> dict:
    """One theta over all columns (key None) and one without each fold; every column has its own scale.

    With ``groups`` (feature places by name) there is one theta for each group, 0 outside it, and the keys
    are (group, fold). Every iteration is one pass over the packed columns for all models at once.
    It returns weighted Grams, right-hand sides, objectives and column counts.
    """
    p = len(means)
    keys = [(g, f) for g in (groups or {None: None}) for f in (None, *folds)]
    models = [f for _, f in keys]
    chosen = [np.arange(p) if g is None else np.asarray(groups[g]) for g, _ in keys]
    k = len(models)
    thetas = np.stack([np.eye(p)[c[0]] for c in chosen])
    history: list[list[float]] = [[] for _ in models]
    live = np.ones(k, dtype=bool)
    width = p * p + p + 2
    rows = packed.select("fold", "x", "t")
    for _ in range(iters):
        def run(batches, thetas=thetas):
            acc = np.zeros((k, width))
            for pdf in batches:
                for fold, x, t in zip(pdf["fold"], pdf["x"], pdf["t"]):
                    x, t = (np.stack(x) - means) / norms, np.asarray(t)
                    tt = t @ t
                    if len(t) < min_n or tt <= 0:
                        continue
                    h = x @ thetas.T
                    hh, th = (h * h).sum(axis=0), t @ h
                    use = (hh > 0) & np.array([m != fold for m in models])
                    lam = np.where(use, th / np.where(hh > 0, hh, 1.0), 0.0)
                    acc[:, :p * p] += np.outer(lam * lam, (x.T @ x).ravel())
                    acc[:, p * p:p * p + p] += np.outer(lam, x.T @ t)
                    acc[:, -2] += np.where(use, th * th / (tt * np.where(hh > 0, hh, 1.0)), 0.0)
                    acc[:, -1] += use
            yield pd.DataFrame({"s": [acc.ravel().tolist()]})

        s = _partial_sums(rows, run, k * width).reshape(k, width)
        nxt = thetas.copy()
        for m in np.flatnonzero(live):
            if s[m, -1] == 0:
                live[m] = False
                continue
            c = chosen[m]
            theta = np.zeros(p)
            theta[c] = ridge_solution(s[m, :p * p].reshape(p, p)[np.ix_(c, c)], s[m, p * p:p * p + p][c], ridge)
            size = np.linalg.norm(theta)
            nxt[m] = theta / size if size > 0 else theta
            history[m].append(round(s[m, -2] / s[m, -1], 5))
            if len(history[m]) > 2 and abs(history[m][-1] - history[m][-2]) < 1e-6:
                live[m] = False
        thetas = nxt
        if not live.any():
            break
    return {key if groups else key[1]: (thetas[i], history[i]) for i, key in enumerate(keys)}


def fitted_cos2(packed: DataFrame, means: np.ndarray, norms: np.ndarray, models: dict, min_n: int = 5) -> DataFrame:
    """cos2 of target and fit within each column: for (group, None) over all columns, for (group, fold) over the held-out ones."""
    keys, thetas = list(models), np.stack([theta for theta, _ in models.values()])

    def run(batches):
        for pdf in batches:
            out = []
            for fold, x, t in zip(pdf["fold"], pdf["x"], pdf["t"]):
                h, t = ((np.stack(x) - means) / norms) @ thetas.T, np.asarray(t)
                tt, hh, th = t @ t, (h * h).sum(axis=0), t @ h
                if len(t) >= min_n and tt > 0:
                    out += [(g, f or "in_sample", float(th[i] ** 2 / (tt * hh[i]))) for i, (g, f) in enumerate(keys) if f in (None, fold) and hh[i] > 0]
            yield pd.DataFrame(out, columns=["group", "scope", "cos2"])

    return packed.select("fold", "x", "t").mapInPandas(run, "group string, scope string, cos2 double")


def standardized_value(names: Sequence[str], theta: np.ndarray, means: np.ndarray, norms: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, t, m, s in zip(names, theta, means, norms):
        out = out + F.lit(float(t)) * (F.col(c) - F.lit(float(m))) / F.lit(float(s))
    return out
