"""Davidson's model for any number of systems: minorisation-maximisation as joins over pair counts.

A step multiplies each strength by points won over points expected, which raises the likelihood; a table of one number
per system is all that a step keeps. Pairs of steps are extrapolated (squared, per group), and a step that lowers the
likelihood is taken back. No matrix of systems by systems is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Settled

#: The number of the tie parameter among the parameters of a group.
TIE = -1
#: The most that a logarithm moves in a step, and the size from which a strength counts as without bound.
LEAP, FAR = 5.0, 15.0
#: The logarithm of the tie parameter of a group without ties.
NO_TIES = -700.0


def _points(edges: DataFrame, by: list[str]) -> DataFrame:
    """What each parameter has won: wins and half of the ties of a system, and the ties."""
    half = F.col("t_ij") / 2
    each = F.array(
        F.struct(F.col("i"), (F.col("w_ij") + half).alias("won")), F.struct(F.col("j").alias("i"), (F.col("w_ji") + half).alias("won")),
        F.struct(F.lit(TIE).cast(edges.schema["i"].dataType).alias("i"), F.col("t_ij").cast("double").alias("won")),
    )
    return edges.select(*by, F.explode(each).alias("x")).groupBy(*by, "x.i").agg(F.sum("x.won").alias("won"))


def _step(edges: DataFrame, x: DataFrame, by: list[str]) -> DataFrame:
    """``x`` (by, i, won, v) with ``expected`` and, in the row of the tie parameter, the log likelihood ``value``."""
    side = lambda name: x.where(F.col("i") != TIE).select(*by, F.col("i").alias(name), F.col("v").alias(f"v_{name}"))
    tie = x.where(F.col("i") == TIE).select(*by, F.col("v").alias("v_t"))
    rows = edges.join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
    rows = rows.join(tie, by) if by else rows.crossJoin(F.broadcast(tie))  # one row without groups
    rows = rows.withColumn("z", F.col("v_t") + (F.col("v_i") + F.col("v_j")) / 2)
    rows = rows.withColumn("m", F.greatest("v_i", "v_j", "z"))
    e = lambda c: F.exp(F.col(c) - F.col("m"))
    rows = rows.withColumn("d", e("v_i") + e("v_j") + e("z"))
    n, p = F.col("w_ij") + F.col("w_ji") + F.col("t_ij"), e("z") / F.col("d")
    value = (
        F.col("w_ij") * F.col("v_i") + F.col("w_ji") * F.col("v_j") + F.col("t_ij") * F.col("z")
        - n * (F.col("m") + F.ln("d"))
    )
    one = lambda name, c, v: F.struct(
        name.cast(edges.schema["i"].dataType).alias("i"), (n * c).alias("expected"), v.alias("value")
    )
    each = F.array(
        one(F.col("i"), e("v_i") / F.col("d") + p / 2, F.lit(0.0)), one(F.col("j"), e("v_j") / F.col("d") + p / 2, F.lit(0.0)),
        one(F.lit(TIE), p, value),
    )
    sums = rows.select(*by, F.explode(each).alias("x")).groupBy(*by, "x.i").agg(
        F.sum("x.expected").alias("expected"), F.sum("x.value").alias("value"),
    )
    return x.join(sums, [*by, "i"])


def _moved(scale: float) -> F.Column:
    ratio = F.ln(F.greatest(F.col("won"), F.lit(1e-300)) / F.greatest(F.col("expected"), F.lit(1e-300)))
    return F.col("v") + scale * F.greatest(F.lit(-LEAP), F.least(F.lit(LEAP), ratio))


def fit_many(counts: DataFrame, *by: str, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """A fit per group of pair counts (i, j, w_ij, w_ji, t_ij): by, i, theta, strength, tie, points, expected, converged.

    Systems are those that met others; counts of a pair may come in several rows and in either order, pairs of a system with
    itself and rows without outcomes are left out. theta has mean 0 and strength sum 1 in a group. A group has converged
    if no system's expected points are off by more than ``tolerance`` of its points (of one, if fewer) and no strength
    runs away, as it does for a system that only ever wins or loses; its tie is 0 if it has no ties. After ``rounds``
    rounds of three steps the rest is given as it is, not converged. An empty table gives no rows.

    All groups advance together and a group that has converged stands still. Each step is one aggregation over the pairs; strengths
    join by system, broadcast by Spark only where their written size allows it, and each table goes when the next is there.
    """
    keys, kept = list(by), Settled(counts.sparkSession)
    edges = kept.write(
        counts.where("i <> j and w_ij + w_ji + t_ij > 0").select(*keys, "i", "j", "w_ij", "w_ji", "t_ij")
    )
    x = kept.write(_points(edges, keys).withColumn("v", F.lit(0.0)))
    none = (F.col("i") == TIE) & (F.col("won") == 0)
    x = kept.swap(x, x.withColumn("v", F.when(none, NO_TIES).otherwise(F.col("v"))))  # without ties the tie is 0
    for _ in range(rounds):
        one = kept.write(_step(edges, x, keys).withColumn("v1", F.when(none, F.col("v")).otherwise(_moved(1.0))))
        if _settled(one, tolerance):
            kept.drop(one)
            break
        first = one.select(*keys, "i", "won", F.col("v1").alias("v"))
        two = kept.write(_step(edges, first, keys).withColumn("v2", F.when(none, F.col("v")).otherwise(_moved(1.0))))
        x = kept.swap(x, _extrapolated(edges, one, two, keys, none))
        kept.drop(one, two)
    last = kept.write(_step(edges, x, keys))
    kept.drop(x)
    return _described(last, keys, tolerance)


def _off() -> F.Column:
    """How far expected points are from those won, as a share of them."""
    return F.abs(F.col("won") - F.col("expected")) / F.greatest(F.col("won"), F.lit(1.0))


def _settled(x: DataFrame, tolerance: float) -> bool:
    worst = x.agg(F.max(_off()).alias("off")).first()["off"]
    return worst is None or worst <= tolerance


def _extrapolated(edges: DataFrame, one: DataFrame, two: DataFrame, keys: list[str], none) -> DataFrame:
    """The next parameters: along the curve of two steps, if that is likelier than after the first step, else after the
    second (or, where even a step lowered the likelihood, half of the first, which can't)."""
    a = one.select(*keys, "i", "won", F.col("v").alias("v0"), "v1", F.col("value").alias("l0"))
    rows = a.join(two.select(*keys, "i", "v2", F.col("value").alias("l1")), [*keys, "i"])
    r, c = F.col("v1") - F.col("v0"), F.col("v2") - 2 * F.col("v1") + F.col("v0")
    sizes = rows.groupBy(*keys).agg(
        F.sqrt(F.sum(r * r) / F.sum(c * c)).alias("alpha"), F.sum("l0").alias("l0"), F.sum("l1").alias("l1"),
    )
    rows = rows.drop("l0", "l1")
    rows = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))
    alpha = F.least(F.greatest(F.coalesce("alpha", F.lit(1.0)), F.lit(1.0)), F.lit(64.0))
    far = F.col("v0") + 2 * alpha * r + alpha * alpha * c
    rows = rows.withColumn("far", F.when(none, F.col("v0")).otherwise(far))
    tried = _step(edges, rows.withColumn("v", F.col("far")), keys).withColumn(
        "v3", F.when(none, F.col("v")).otherwise(_moved(1.0))
    )
    likely = tried.groupBy(*keys).agg(F.sum("value").alias("l3")) if keys else tried.agg(F.sum("value").alias("l3"))
    tried = tried.join(likely, keys) if keys else tried.crossJoin(F.broadcast(likely))
    slack = F.abs("l0") * 1e-13
    return tried.select(
        *keys, "i", "won",
        F.when(F.col("l1") < F.col("l0") - slack, (F.col("v0") + F.col("v1")) / 2)
        .when(F.col("l3") >= F.col("l1") - slack, F.col("v3")).otherwise(F.col("v2")).alias("v"),
    )


def _described(x: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    system = F.col("i") != TIE
    of = x.groupBy(*keys).agg(
        F.avg(F.when(system, F.col("v"))).alias("mean"), F.max(F.when(system, F.col("v"))).alias("top"),
        F.max(F.when(~system, F.col("v"))).alias("tau"), F.max(_off()).alias("off"),
        F.max(F.when(system, F.abs("v"))).alias("far"),
    )
    total = (x.join(of, keys) if keys else x.crossJoin(F.broadcast(of))).where(system)
    weight = F.exp(F.col("v") - F.col("top"))
    sums = total.groupBy(*keys).agg(F.sum(weight).alias("weight"))
    rows = total.join(sums, keys) if keys else total.crossJoin(F.broadcast(sums))
    steady = (F.col("off") <= tolerance) & (F.col("far") < FAR)
    return rows.select(
        *keys, "i", (F.col("v") - F.col("mean")).alias("theta"), (weight / F.col("weight")).alias("strength"),
        F.when(F.col("tau") == NO_TIES, 0.0).otherwise(F.exp("tau")).alias("tie"), F.col("won").alias("points"), "expected", steady.alias("converged"),
    )
