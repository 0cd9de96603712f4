"""Pairwise comparisons: facts from verdicts, votes, agreement, amplification, subsets and judge statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import AMPLIFIED_JUDGE, SKIP_JUDGE, coin_flip, coin_flip_key, is_refusal, last_line, strip, verdict_of_line

TRIPLET = ["sentence", "a_id", "b_id"]


def vote() -> Column:
    """'win_a', 'win_b' or 'tie' of a comparison row; null if nobody answered."""
    return F.when(F.col("a_success"), "win_a").when(F.col("b_success"), "win_b").when(F.col("identical"), "tie")


def without_self_pairs(rows: DataFrame) -> DataFrame:
    """A system is never compared with itself."""
    return rows.where("a_id <> b_id")


def flip_key() -> Column:
    """Of columns language, sentence_category, sentence, judge, a_id and b_id: what decides the order of the texts."""
    ids = [F.col(x).cast("string") for x in ("a_id", "b_id")]
    return coin_flip_key(F.col("language"), F.col("sentence_category"), F.col("sentence"), F.col("judge"), *ids)


def outcome_without_judge() -> Column:
    """Of columns text_a and text_b: 'none', 'a' or 'b' where one or both are refusals (the mark alone loses, null is a
    refusal), 'tie' where they are equal but for white space around them, else null."""
    a_no, b_no = (F.coalesce(is_refusal(F.col(x), 0), F.lit(True)) for x in ("text_a", "text_b"))
    same = strip(F.col("text_a")) == strip(F.col("text_b"))
    return F.when(a_no & b_no, "none").when(a_no, "b").when(b_no, "a").when(same, "tie")


def facts(pairs: DataFrame) -> DataFrame:
    """``pairs`` (language, sentence, sentence_category, a_id, b_id, text_a, text_b, judge, response) to comparisons.

    A refusal loses, two refusals are all false, and both are put down to the skip judge, one row a judge; equal texts are
    a tie without a judge's word; else the verdict counts, A and B exchanged where the coin flip says so. Rows without a
    readable verdict go, and so do pairs of a system with itself.
    """
    # one step each; the last makes no row where there is no outcome, so no filter repeats the steps below a join
    rows = without_self_pairs(pairs).withColumn("_o", outcome_without_judge())
    rows = rows.withColumn("_last", F.when(F.col("_o").isNull(), last_line(F.col("response"))))
    rows = rows.withColumn("_flip", F.when(F.col("_last").isNotNull(), coin_flip(flip_key())))
    rows = rows.withColumn("_v", F.coalesce("_o", verdict_of_line(F.col("_last"), F.col("_flip"))))
    rows = rows.withColumn("_won", F.explode(F.split("_v", " ")))  # one word, or null
    skip, auto = F.coalesce(F.col("_o").isin("none", "a", "b"), F.lit(False)), F.col("_o").isNotNull()
    return rows.select(
        "language", "a_id", "b_id", "sentence", "sentence_category",
        F.when(skip, SKIP_JUDGE).otherwise(F.col("judge")).alias("evaluating_model"),
        (F.col("_won") == "a").alias("a_success"), (F.col("_won") == "b").alias("b_success"),
        (F.col("_won") == "tie").alias("identical"),
        F.when(~skip, F.when(auto, "Autoskipped").otherwise(F.col("response"))).alias("evaluating_response"),
    )


def pair_counts(comparisons: DataFrame, *by: str) -> DataFrame:
    """Wins and ties of each unordered pair, the sufficient statistics of every model: i < j, w_ij, w_ji, t_ij."""
    i, j = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    first = F.col("a_id") < F.col("b_id")
    low, high = F.when(first, F.col("a_success")).otherwise(F.col("b_success")), F.when(first, F.col("b_success")).otherwise(F.col("a_success"))
    one = vote()
    won = lambda c: F.count_if(c & (one != "tie"))
    return comparisons.where(one.isNotNull()).groupBy(*by, i.alias("i"), j.alias("j")).agg(
        won(low).alias("w_ij"), won(high).alias("w_ji"), F.count_if(one == "tie").alias("t_ij"),
    )


def triplets(comparisons: DataFrame, *by: str) -> DataFrame:
    """Votes on each (sentence, a, b): n rows, a, b and t of the three outcomes."""
    return comparisons.groupBy(*by, *TRIPLET).agg(
        F.count("*").alias("n"), F.count_if("a_success").alias("a"), F.count_if("b_success").alias("b"),
        F.count_if("identical").alias("t"),
    )


def amplify(comparisons: DataFrame, *by: str) -> DataFrame:
    """Unanimity weighs quadratically: per triplet, t * t ties if a = b, else |a * a - b * b| wins of the larger, as weight."""
    t = triplets(comparisons, *by)
    even = F.col("a") == F.col("b")
    weight = F.when(even, F.col("t") * F.col("t")).otherwise(F.abs(F.col("a") * F.col("a") - F.col("b") * F.col("b")))
    outcome = F.when(even, "tie").when(F.col("a") > F.col("b"), "win_a").otherwise("win_b")
    return t.select(*by, *TRIPLET, outcome.alias("outcome"), weight.alias("weight")).where("weight > 0")


def amplified_rows(amplified: DataFrame) -> DataFrame:
    """The same as comparison rows, ``weight`` times each."""
    out = amplified.withColumn(
        "_one", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int"))),
    ).drop("_one", "weight")
    return out.select(
        "*", F.lit(AMPLIFIED_JUDGE).alias("evaluating_model"), (F.col("outcome") == "win_a").alias("a_success"),
        (F.col("outcome") == "win_b").alias("b_success"), (F.col("outcome") == "tie").alias("identical"),
    ).drop("outcome")


def amplified_counts(amplified: DataFrame, *by: str) -> DataFrame:
    """Pair counts of amplified triplets by their weights, without making the rows."""
    first = F.col("a_id") < F.col("b_id")
    low = F.when(first, "win_a").otherwise("win_b")
    w = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0))
    o = F.col("outcome")
    return amplified.groupBy(*by, F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j")).agg(
        w(o == low).alias("w_ij"), w((o != low) & (o != "tie")).alias("w_ji"), w(o == "tie").alias("t_ij"),
    )


def consensus(comparisons: DataFrame) -> DataFrame:
    """Per category: mean over triplets of |a - b| - t / 2, times 100."""
    return triplets(comparisons, "sentence_category").groupBy("sentence_category").agg(
        F.round(F.avg(F.abs(F.col("a") - F.col("b")) - 0.5 * F.col("t")) * 100, 6).alias("consensus"),
        F.count("*").alias("n"),
    )


def agreement(comparisons: DataFrame, by: str = "sentence_category") -> DataFrame:
    """Mean share of the most frequent outcome, and mean share of decided votes, over triplets."""
    return triplets(comparisons, by).groupBy(by).agg(
        F.round(F.avg(F.greatest("a", "b", "t") / F.col("n")), 6).alias("agreement"),
        F.round(F.avg((F.col("a") + F.col("b")) / F.col("n")), 6).alias("decisiveness"), F.count("*").alias("n"),
    )


def majority(comparisons: DataFrame, seen: str | None = None) -> DataFrame:
    """The most frequent vote of each triplet; equal counts go to the vote seen first in the order of the column ``seen``,
    and without one, or if that is equal too, to win_a, then win_b, then tie."""
    at = F.min(seen) if seen else F.lit(0)
    votes = comparisons.withColumn("vote", vote()).where("vote is not null").groupBy(*TRIPLET, "vote").agg(
        F.count("*").alias("c"), at.alias("first"),
    )
    first = F.row_number().over(
        Window.partitionBy(*TRIPLET).orderBy(
            F.desc("c"), "first", F.when(F.col("vote") == "win_a", 0).when(F.col("vote") == "win_b", 1).otherwise(2),
        )
    )
    return votes.withColumn("_n", first).where("_n = 1").select(
        *TRIPLET, F.col("vote").alias("majority"), F.col("c").alias("votes"),
    )


def judge_stats(comparisons: DataFrame, judges: DataFrame) -> DataFrame:
    """Per judge of ``judges`` (judge): decisions, votes with the majority, ties, wins and the rates; zeros without votes.

    Comparisons are counted once by triplet, judge and vote; the majority of a triplet (ties as in ``majority``) is found
    among these counts.
    """
    by = [*TRIPLET, "evaluating_model"]
    votes = comparisons.withColumn("vote", vote()).where("vote is not null").groupBy(*by, "vote").agg(F.count("*").alias("c"))
    v, triplet = F.col("vote"), Window.partitionBy(*TRIPLET)
    a, b, t = (F.sum(F.when(v == x, F.col("c")).otherwise(0)).over(triplet) for x in ("win_a", "win_b", "tie"))
    votes = votes.withColumns({"a": a, "b": b, "t": t})
    most = F.when(F.col("a") >= F.greatest("b", "t"), "win_a").when(F.col("b") >= F.col("t"), "win_b").otherwise("tie")
    of = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    got = votes.groupBy(F.col("evaluating_model").alias("judge")).agg(
        F.sum("c").alias("decisions"), of(v == most).alias("agreements"), of(v == "tie").alias("ties"),
        of(v == "win_a").alias("a_wins"), of(v == "win_b").alias("b_wins"),
    )
    names = ["decisions", "agreements", "ties", "a_wins", "b_wins"]
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("decisions")), F.lit(0.0)), 6)
    return judges.join(got, "judge", "left").select("judge", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]).withColumns(
        {"agreement_rate": rate("agreements"), "tie_rate": rate("ties")}
    )


#: The most values whose subsets are formed: 2 ** MEMBERS - 1 of them.
MEMBERS = 16


def subsets(names: DataFrame, name: str) -> DataFrame:
    """All non-empty subsets of the values of ``names``, MEMBERS at most: (mask, size, members)."""
    every = names.agg(F.array_sort(F.collect_set(name)).alias("all")).where("size(all) > 0")
    few = F.when(F.size("all") <= MEMBERS, F.size("all")).otherwise(F.raise_error(F.lit(f"over {MEMBERS} values of {name}")).cast("int"))
    every = every.withColumn("mask", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), few) - 1).cast("int"))))
    members = F.filter("all", lambda x, i: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return every.select("mask", F.size(members).alias("size"), members.alias("members"))


def _members(comparisons: DataFrame, by: str) -> list[str]:
    """The judges or categories whose subsets count, in order; over MEMBERS of them are refused."""
    known = comparisons.where((F.col(by) != SKIP_JUDGE) & F.col(by).isNotNull()).select(by).distinct()
    names = [r[0] for r in known.orderBy(by).limit(MEMBERS + 1).collect()]
    if len(names) > MEMBERS:
        raise ValueError(f"over {MEMBERS} values of {by}: their subsets are too many")
    return names


def _subset_sums(names: list[str], per_name: str, fields: tuple[str, ...]) -> Column:
    """Sums of ``fields`` over every subset of ``names``, the map ``per_name`` giving those of each: an array by mask.

    Sums double with each name: those without it, then those with it added. That is one addition for each subset and field.
    """
    zero = F.array(F.struct(*[F.lit(0).cast("long").alias(f) for f in fields]))
    each = F.array(*[F.element_at(per_name, F.lit(name)) for name in names])
    plus = lambda x, one: F.struct(*[(x[f] + F.coalesce(one[f], F.lit(0))).alias(f) for f in fields])
    return F.aggregate(each, zero, lambda sums, one: F.concat(sums, F.transform(sums, lambda x: plus(x, one))))


def _by_subset(gathered: DataFrame, keys: list[str], names: list[str], fields: tuple[str, ...]) -> DataFrame:
    """``gathered`` (keys, _name, fields; one row for keys and value) to (mask, size, keys, fields) of every non-empty subset."""
    value = F.struct(*[F.col(f).cast("long").alias(f) for f in fields])
    names = names or [""]  # then no subset has anything
    per = gathered.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_name"), value))).alias("_per"))
    rows = per.select(*keys, F.posexplode(_subset_sums(names, "_per", fields)).alias("mask", "_x")).where("mask > 0")
    return rows.select("mask", F.bit_count("mask").cast("int").alias("size"), *keys, "_x.*")


def subset_counts(comparisons: DataFrame, by: str) -> DataFrame:
    """Pair counts of every subset of judges or categories; MEMBERS of them at most, else ValueError.

    Facts are counted once by pair and value; a pair's counts of all subsets are then formed in place.
    """
    names = _members(comparisons, by)
    fields = ("w_ij", "w_ji", "t_ij")
    base = pair_counts(comparisons.where(F.col(by).isin(names)), by).withColumnRenamed(by, "_name")
    rows = _by_subset(base, ["i", "j"], names, fields)
    return rows.where("w_ij + w_ji + t_ij > 0")


def amplified_subset_counts(comparisons: DataFrame, by: str) -> DataFrame:
    """Amplified pair counts of every subset of judges or categories, the votes of a triplet being those of the subset.

    Triplets gather the votes of each value once; every subset then weighs them in place, so facts never multiply before
    they are counted by pair. MEMBERS values at most, else ValueError.
    """
    names = _members(comparisons, by)
    votes = triplets(comparisons.where(F.col(by).isin(names)), by).withColumnRenamed(by, "_name")
    rows = _by_subset(votes, TRIPLET, names, ("a", "b", "t"))
    even, weight = F.col("a") == F.col("b"), F.abs(F.col("a") * F.col("a") - F.col("b") * F.col("b"))
    outcome = F.when(even, "tie").when(F.col("a") > F.col("b"), "win_a").otherwise("win_b")
    rows = rows.select(
        "mask", "size", *TRIPLET, outcome.alias("outcome"),
        F.when(even, F.col("t") * F.col("t")).otherwise(weight).alias("weight"),
    )
    return amplified_counts(rows.where("weight > 0"), "mask", "size")


def progress(comparisons: DataFrame, planned: int) -> DataFrame:
    """How far a run has come: comparisons, ties, share of ties and percent of what was planned."""
    n, ties = F.count("*"), F.count_if(vote() == "tie")
    return comparisons.agg(
        n.alias("n"), ties.alias("ties"), F.round(F.try_divide(ties, n), 6).alias("tie_rate"),
        F.round(100 * n / planned, 2).alias("percent"),
    )


def watched(comparisons: DataFrame, name: str = "progress") -> DataFrame:
    """``comparisons`` whose counts a running plan reports: metrics n and ties under ``name``, in the progress of a stream
    and, with an Observation as ``name``, of a batch."""
    return comparisons.observe(name, F.count(F.lit(1)).alias("n"), F.count_if(vote() == "tie").alias("ties"))
