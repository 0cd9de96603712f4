"""Davidson's model of wins and ties, fitted per group by Newton's method on pair counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_quantile, two_sided_p
from ..sources.shared import settle

#: The most systems of a fit in one task: its matrices of MOST ** 2 numbers take 32 MB each.
MOST = 2000
FIT = "i int, theta double, strength double, tie double, cov array<double>, log_likelihood double, converged boolean"


def fit_counts(i, j, w_ij, w_ji, t_ij, n: int, rounds: int = 100, strengths=None, tie: float = 1.0) -> dict:
    """Log strengths (mean 0), log tie parameter and their covariance, the pseudo-inverse of the observed information.

    ``strengths`` (all positive) and ``tie`` are where the search starts; the maximum doesn't depend on it.

    Outcomes of a pair have logits theta_i, theta_j and tau + (theta_i + theta_j) / 2: the likelihood is concave.
    Without a finite maximum (someone never loses, parts never meet) the steps are halved and bounded, and
    ``converged`` is false. Sums go over the pairs that met; besides them memory holds (n + 1) ** 2 numbers. A row of the
    covariance ends with that of the tie parameter.
    """
    x = np.append(np.zeros(n) if strengths is None else np.log(np.asarray(strengths, float)), np.log(tie))
    i, j = np.asarray(i, int), np.asarray(j, int)
    counts = np.stack([w_ij, w_ji, t_ij], axis=1).astype(float) if len(i) else np.zeros((0, 3))
    total = counts.sum(axis=1)
    at = (i, j, np.full(len(i), n))  # the only parameters that a pair's outcomes depend on

    def spread(*values):
        """Sums of each pair's values for its three parameters."""
        return sum(np.bincount(k, v, n + 1) for k, v in zip(at, values))

    def state(x):
        z = np.stack([x[i], x[j], x[n] + (x[i] + x[j]) / 2], axis=1)
        z = z - z.max(axis=1, keepdims=True) if len(z) else z
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True) if len(p) else 1
        return (counts * np.log(np.maximum(p, 1e-300))).sum(), p

    def information(p):
        mean = (p[:, 0] + p[:, 2] / 2, p[:, 1] + p[:, 2] / 2, p[:, 2])
        square = ((mean[0] - p[:, 2] / 4, p[:, 2] / 4, p[:, 2] / 2), (p[:, 2] / 4, mean[1] - p[:, 2] / 4, p[:, 2] / 2), (p[:, 2] / 2, p[:, 2] / 2, p[:, 2]))
        out = np.zeros((n + 1) ** 2)
        for a in range(3):
            for b in range(3):
                out += np.bincount(at[a] * (n + 1) + at[b], total * (square[a][b] - mean[a] * mean[b]), len(out))
        return out.reshape(n + 1, n + 1)

    won = spread(counts[:, 0] + counts[:, 2] / 2, counts[:, 1] + counts[:, 2] / 2, counts[:, 2])
    value, p = state(x)
    done = False
    for _ in range(rounds):
        gradient = won - spread(total * (p[:, 0] + p[:, 2] / 2), total * (p[:, 1] + p[:, 2] / 2), total * p[:, 2])
        step = np.linalg.pinv(information(p), hermitian=True) @ gradient
        if np.abs(step).max(initial=0) < 1e-10:
            done, x = True, x + step  # the last step leaves errors of rounding only
            value, p = state(x)
            break
        step *= min(1.0, 5 / np.abs(step).max())
        while True:
            new, q = state(x + step)
            if new >= value - 1e-12 or np.abs(step).max() < 1e-12:
                break
            step /= 2
        x, value, p = x + step, new, q
    x[:n] -= x[:n].mean()
    strength = np.exp(x[:n])
    return {
        "theta": x[:n], "strength": strength / strength.sum(), "tie": float(np.exp(x[n])),
        "cov": np.linalg.pinv(information(p), hermitian=True)[:n], "value": float(value),
        "converged": done and np.abs(x).max() < 15,
    }


def fit(counts: DataFrame, n: int, *by: str, strengths=None, tie: float = 1.0) -> DataFrame:
    """One fit per group of pair counts (i, j, w_ij, w_ji, t_ij with 0 <= i < j < n): a row per system, see FIT.

    A group is fitted by one task with an n by n matrix, so n is bounded by MOST; ``many.fit_many`` has no bound.
    """
    if n > MOST:
        raise ValueError(f"{n} systems: over {MOST} are fitted by many.fit_many")
    keys = list(by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit_counts(pdf["i"], pdf["j"], pdf["w_ij"], pdf["w_ji"], pdf["t_ij"], n, strengths=strengths, tie=tie)
        out = pd.DataFrame(
            {
                "i": np.arange(n, dtype=np.int32), "theta": f["theta"], "strength": f["strength"], "tie": f["tie"],
                "cov": list(f["cov"]), "log_likelihood": f["value"], "converged": f["converged"],
            }
        )
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    grouped = counts.groupBy(*keys) if keys else counts.withColumn("_all", F.lit(1)).groupBy("_all")
    return grouped.applyInPandas(run, f"{kinds}, {FIT}" if keys else FIT)


def as_searched(fitted: DataFrame, n: int) -> DataFrame:
    """``fitted`` with the covariance that a quasi-Newton search from the identity tends to, as column ``covariance`` says.

    Such a search never moves along the flat direction (all strengths times one factor), so its inverse Hessian keeps the
    identity there: each row of the n systems sums to 1, where the information's pseudo-inverse sums to 0. Intervals get wider by it;
    p-values, which only see differences, stay.
    """
    cov = F.transform("cov", lambda c, l: c + F.when(l < n, 1.0 / n).otherwise(0.0))
    return fitted.withColumns({"cov": cov, "covariance": F.lit("searched")})


def intervals(fitted: DataFrame, conf_level: float | str = 0.95) -> DataFrame:
    """low, mid and high of exp(theta) at ``conf_level`` (a number, or a column of them), which is part of the result."""
    se = F.sqrt(F.element_at("cov", F.col("i") + 1))
    level = F.col(conf_level) if isinstance(conf_level, str) else F.lit(conf_level)
    z = normal_quantile((1 + level) / 2)
    e = lambda x: F.round(F.exp(x), 4)
    return fitted.withColumns(
        {
            "low": e(F.col("theta") - z * se), "mid": e(F.col("theta")), "high": e(F.col("theta") + z * se),
            "conf_level": level,
        }
    ).drop("cov")


def from_comparisons(rows: DataFrame, n: int, *by: str, strengths=None, tie: float = 1.0) -> DataFrame:
    """A fit of single outcomes (i, j, result: win1, win2 or tie, the first system being i)."""
    won = lambda what: F.count_if(F.col("result") == what)
    first = F.col("i") < F.col("j")
    rows = rows.withColumn(
        "result",
        F.when(
            first | (F.col("result") == "tie"), F.col("result"),
        ).when(F.col("result") == "win1", "win2").otherwise("win1"),
    )
    counts = rows.groupBy(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return fit(
        counts.agg(won("win1").alias("w_ij"), won("win2").alias("w_ji"), won("tie").alias("t_ij")), n, *by,
        strengths=strengths, tie=tie,
    )


def moments(counts: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    """Per system: points won (a tie is half a point) and points that the fit expects. They agree at the maximum of the
    likelihood and nowhere else; likewise ``ties`` and ``expected_ties`` of its group."""
    s = lambda x: fitted.select(*by, F.col("i").alias(x), F.col("strength").alias(f"s_{x}"), "tie")
    rows = counts.join(s("i"), [*by, "i"]).join(s("j").drop("tie"), [*by, "j"])
    m, t = F.col("w_ij") + F.col("w_ji") + F.col("t_ij"), F.col("tie") * F.sqrt(F.col("s_i") * F.col("s_j"))
    d = F.col("s_i") + F.col("s_j") + t
    side = lambda x, won: rows.select(
        *by, F.col(x).alias("i"), (F.col(won) + F.col("t_ij") / 2).alias("points"),
        (m * (F.col(f"s_{x}") + t / 2) / d).alias("e"), "t_ij", (m * t / d).alias("et"),
    )
    both = side("i", "w_ij").unionByName(side("j", "w_ji"))
    total = lambda c: F.round(F.sum(c), 3)
    return both.groupBy(*by, "i").agg(
        F.sum("points").alias("points"), total("e").alias("expected"), F.sum("t_ij").alias("ties"),
    )


def information_times_covariance(counts: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    """Rows and columns of the observed information times the fit's covariance, for all systems that met others: i, k,
    product. At a fit of connected systems that is 1 - 1 / n where i = k, else -1 / n, n being the number of systems."""
    s = lambda x: fitted.select(*by, F.col("i").alias(x), F.col("strength").alias(f"s_{x}"))
    tie = fitted.groupBy(*by).agg(F.first("tie").alias("tie")) if by else fitted.agg(F.first("tie").alias("tie"))
    rows = counts.join(s("i"), [*by, "i"]).join(s("j"), [*by, "j"])
    rows = rows.join(tie, list(by)) if by else rows.crossJoin(F.broadcast(tie))
    m, t = F.col("w_ij") + F.col("w_ji") + F.col("t_ij"), F.col("tie") * F.sqrt(F.col("s_i") * F.col("s_j"))
    d = F.col("s_i") + F.col("s_j") + t
    a, b, p = (F.col("s_i") + t / 2) / d, (F.col("s_j") + t / 2) / d, t / d
    entry = lambda x, y, v: F.struct(F.col(x).alias("i"), y.alias("l"), (m * v).alias("v"))
    i, j, last = F.col("i"), F.col("j"), F.lit(-1)
    entries = F.array(
        entry("i", i, a - p / 4 - a * a), entry("j", j, b - p / 4 - b * b), entry("i", j, p / 4 - a * b),
        entry("j", i, p / 4 - a * b), entry("i", last, p / 2 - a * p), entry("j", last, p / 2 - b * p),
    )
    info = rows.select(*by, F.explode(entries).alias("x")).groupBy(*by, "x.i", "x.l").agg(F.sum("x.v").alias("v"))
    cells = fitted.select(*by, F.col("i").alias("k"), F.posexplode("cov").alias("l", "c"))
    n = F.max("l").over(Window.partitionBy(*by))  # the tie parameter comes last
    cells = cells.withColumn("l", F.when(F.col("l") == n, -1).otherwise(F.col("l")))
    return info.join(cells, [*by, "l"]).groupBy(*by, "i", "k").agg(F.round(F.sum(F.col("v") * F.col("c")), 6).alias("product"))


def p_values(fitted: DataFrame, *by: str) -> DataFrame:
    """Wald p-values of theta_i = theta_j for all ordered pairs of a group, and whether its fit converged. A fit of one
    task has MOST systems at most, so a side of the pairs is broadcast."""
    a = fitted.select(*by, "i", F.col("theta").alias("ti"), F.col("cov").alias("ci"), "converged")
    b = fitted.select(*by, F.col("i").alias("j"), F.col("theta").alias("tj"), F.col("cov").alias("cj"))
    pairs = (a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))).where("i <> j")
    var = F.element_at("ci", F.col("i") + 1) + F.element_at("cj", F.col("j") + 1) - 2 * F.element_at("ci", F.col("j") + 1)
    p = F.when(var > 1e-12, two_sided_p((F.col("ti") - F.col("tj")) / F.sqrt(var))).otherwise(1.0)
    return pairs.select(*by, "i", "j", F.round(p, 4).alias("p"), "converged")


def probabilities(strengths: DataFrame, *by: str) -> DataFrame:
    """Outcome probabilities and their entropy for all i < j of ``strengths`` (i, strength, tie)."""
    a = strengths.select(*by, "i", F.col("strength").alias("si"), "tie")
    b = strengths.select(*by, F.col("i").alias("j"), F.col("strength").alias("sj"))
    pairs = (a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))).where("i < j")
    t = F.col("tie") * F.sqrt(F.col("si") * F.col("sj"))
    d = F.col("si") + F.col("sj") + t
    h = lambda c: -F.col(c) * F.ln(F.col(c) + 1e-12)
    return pairs.select(
        *by, "i", "j", (F.col("si") / d).alias("p_i"), (F.col("sj") / d).alias("p_j"), (t / d).alias("p_tie"),
    ).withColumn("entropy", h("p_i") + h("p_j") + h("p_tie"))


def log_likelihood(counts: DataFrame, strengths: DataFrame, *by: str) -> DataFrame:
    """Log likelihood of pair counts (i, j, w_ij, w_ji, t_ij) under ``strengths`` (i, strength, tie; few rows), per group."""
    si = strengths.select("i", F.col("strength").alias("si"), "tie")
    sj = strengths.select(F.col("i").alias("j"), F.col("strength").alias("sj"))
    rows = counts.join(si, "i").join(sj, "j")
    t = F.col("tie") * F.sqrt(F.col("si") * F.col("sj"))
    d = F.col("si") + F.col("sj") + t
    value = F.col("w_ij") * F.ln(F.col("si") / d) + F.col("w_ji") * F.ln(F.col("sj") / d) + F.col("t_ij") * F.ln(t / d)
    return rows.groupBy(*by).agg(F.round(F.sum(value), 4).alias("log_likelihood"))


def next_pair(pairs: DataFrame, threshold: float = 1.09054, *by: str) -> DataFrame:
    """The most uncertain pair of each group, if its entropy reaches the threshold (ln 3 is the most there can be)."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("entropy"), "i", "j"))
    return pairs.where(F.col("entropy") >= threshold).withColumn("_n", first).where("_n = 1").drop("_n")


def leaderboard(fitted: DataFrame, *by: str, conf_level: float = 0.95) -> DataFrame:
    """Systems from best to worst with rank, interval and the p-values against the others as a map.

    ``fitted`` is written first: intervals, p-values and ranks read one fit.
    """
    fitted = settle(fitted)
    ps = p_values(fitted, *by).groupBy(*by, "i").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("j").cast("string"), "p")))).alias("p_vals")
    )
    rows = intervals(fitted, conf_level).join(ps, [*by, "i"], "left")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("theta"), "i")))


def records(board: DataFrame, entries: DataFrame, *by: str) -> DataFrame:
    """A leaderboard with its systems' names, as records from weakest to strongest: ``entries`` has i and model (a struct).

    position counts from 1 in that order; intervals hold low, mid, high and the level that they are for.
    """
    named = board.join(entries.select("i", "model"), "i", "left")
    order = F.row_number().over(Window.partitionBy(*by).orderBy("theta", F.desc("i")))
    interval = F.struct("low", "mid", "high", "conf_level").alias("intervals")
    return named.select(
        *by, order.alias("position"), "model", F.col("i").alias("model_id"), interval, "p_vals", "rank", "converged",
    )


def strengths_by_rank(fitted: DataFrame, entries: DataFrame, *by: str) -> DataFrame:
    """Strengths with their systems, strongest first."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("strength"), "i"))
    return fitted.join(
        entries.select("i", "model"), "i", "left",
    ).select(*by, place.alias("rank"), "i", "model", "strength")


def ordinal_ranks(fitted: DataFrame, *by: str) -> DataFrame:
    return fitted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("strength"), "i")) - 1)


def correlations(overall: DataFrame, per_judge: DataFrame, by: str = "evaluating_model") -> DataFrame:
    """Pearson of strengths and Spearman of places of each judge's fit with the overall one; null without variation."""
    o = ordinal_ranks(overall).select("i", F.col("strength").alias("s"), F.col("place").alias("r"))
    both = ordinal_ranks(per_judge, by).join(o, "i")
    guarded = lambda x, y: F.when((F.count_distinct(x) > 1) & (F.count_distinct(y) > 1), F.corr(x, y))
    return both.groupBy(by).agg(
        F.round(guarded("strength", "s"), 6).alias("pearson"), F.round(guarded("place", "r"), 6).alias("spearman"),
        F.count("*").alias("n"),
    )


def judge_analysis(
    comparisons: DataFrame, judges: DataFrame, n: int, least_comparisons: int = 10, least_systems: int = 2,
) -> DataFrame:
    """Per judge of ``judges``: its votes and rates, whether a model could be fitted on its own comparisons, and that
    model's correlations with the one of all judges; rank orders by agreement.

    Models need ``least_comparisons`` outcomes and ``least_systems`` systems; without one of all judges none is fitted.
    """
    from .pairwise import judge_stats, pair_counts

    by = "evaluating_model"
    counts = settle(pair_counts(comparisons, by))
    m = F.sum(F.col("w_ij") + F.col("w_ji") + F.col("t_ij"))
    everyone = counts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("w_ij", "w_ji", "t_ij")])
    stats = judge_stats(comparisons, judges)
    good = n >= least_systems and (counts.agg(m.alias("m")).first()["m"] or 0) >= least_comparisons
    enough = counts.groupBy(by).agg(m.alias("m")).where((F.col("m") >= least_comparisons) & F.lit(good)).select(by)
    fitted = settle(fit(counts.join(enough, by), n, by))
    close = correlations(fit(everyone, n), fitted).withColumnRenamed(by, "judge").drop("n")
    has = fitted.groupBy(F.col(by).alias("judge")).agg(F.every("converged").alias("converged"))
    rows = stats.join(close, "judge", "left").join(has, "judge", "left").withColumn(
        "model_fitted", F.col("converged").isNotNull(),
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("agreement_rate"), "judge")))


def category_signal(
    comparisons: DataFrame, n: int, least_systems: int = 3, least_comparisons: int = 10, p_limit: float = 0.05,
    in_turn: bool = False,
) -> DataFrame:
    """How well each category tells systems apart: agreement, decisiveness, spread of strengths, interval width, share of
    significant pairs and their weighted sum, and the rank by it; categories with too little data get the first two only.

    ``model_fitted`` and ``converged`` tell whether the model figures are there and can be relied on.

    The mean width adds up the systems' widths in the order of their numbers or, with ``in_turn``, the ends of their
    intervals, each high and low by itself. The two differ in the last bit, which counts where a mean of figures of four
    digits, halfway between two of them, is rounded to four digits again.
    """
    from .pairwise import agreement, pair_counts

    by = "sentence_category"
    counts = settle(pair_counts(comparisons, by))
    size = counts.groupBy(by).agg(
        F.sum(F.col("w_ij") + F.col("w_ji") + F.col("t_ij")).alias("m"),
        F.size(F.array_union(F.collect_set("i"), F.collect_set("j"))).alias("systems"),
    )
    enough = size.where((F.col("m") >= least_comparisons) & (F.col("systems") >= least_systems)).select(by)
    fitted = settle(fit(counts.join(enough, by), n, by))
    spread = fitted.groupBy(by).agg(
        F.round(F.stddev_pop("strength"), 12).alias("spread"),  # what the fit leaves beyond is error
        F.every("converged").alias("converged"),
    )
    ends = intervals(fitted).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("ends"))
    add = (lambda s, x: s + x["high"] - x["low"]) if in_turn else (lambda s, x: s + (x["high"] - x["low"]))
    width = ends.select(by, (F.aggregate("ends", F.lit(0.0), add) / F.size("ends")).alias("width"))
    ratio = p_values(fitted, by).where("i < j").groupBy(by).agg(
        F.avg((F.col("p") < p_limit).cast("int")).alias("significant")
    )
    rows = agreement(comparisons).join(spread, by, "left").join(width, by, "left").join(ratio, by, "left")
    full = 0.3 * F.col("agreement") + 0.1 * F.col("decisiveness") + 0.25 * 10 * F.col("spread") + 0.15 / (F.col("width") + 1e-6) + 0.2 * F.col("significant")
    rows = rows.withColumn("model_fitted", F.col("spread").isNotNull())
    rows = rows.withColumn(
        "signal", F.round(F.coalesce(full, 0.6 * F.col("agreement") + 0.4 * F.col("decisiveness")), 6),
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("signal"), by)))
