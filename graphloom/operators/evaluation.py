"""Evaluation of rankings and answers, and the statistics of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.chunked_keys import key_starts, number_rows, places
from graphloom.session import cut

ABSENT_RANK = 99


def per_query(queries: DataFrame, rankings: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, category, hit1, hit5, hit10, rr, gold_rank)`` for **all** of ``queries(query_id, category)``.

    A hit is any gold document among the first; without a ranking or gold all
    is 0 and the rank null. ``rankings(query_id, rank, doc_id)``,
    ``gold(query_id, doc_id)``.
    """
    best = rankings.where(F.col("rank") <= k).join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    rows = queries.select("query_id", "category").join(best, "query_id", "left")
    hit = lambda n: F.coalesce((F.col("gold_rank") <= n).cast("int"), F.lit(0))
    return rows.select("query_id", "category", hit(1).alias("hit1"), hit(5).alias("hit5"), hit(k).alias("hit10"), F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)).alias("rr"), "gold_rank")


def summary(per: DataFrame) -> DataFrame:
    """Means over all queries (``category`` null, ``overall`` 1) and by category, in one pass."""
    mean = lambda c: F.round(F.avg(c), 6)
    return per.cube("category").agg(F.grouping("category").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), mean("hit1").alias("hit1"), mean("hit5").alias("hit5"), mean("hit10").alias("hit10"), mean("rr").alias("mrr"))


def rescue_hurt(base: DataFrame, other: DataFrame) -> DataFrame:
    """Queries that only one of two methods hits, at 1 and at 10, and how their gold ranks moved."""
    a = base.select("query_id", F.col("hit1").alias("a1"), F.col("hit10").alias("a10"), F.coalesce("gold_rank", F.lit(ABSENT_RANK)).alias("ra"))
    b = other.select("query_id", F.col("hit1").alias("b1"), F.col("hit10").alias("b10"), F.coalesce("gold_rank", F.lit(ABSENT_RANK)).alias("rb"))
    n = lambda c: F.sum(c.cast("bigint"))
    only = lambda x, y: n((F.col(x) == 1) & (F.col(y) == 0))
    ra, rb = F.col("ra"), F.col("rb")
    return a.join(b, "query_id").agg(
        F.count(F.lit(1)).alias("n"),
        only("b1", "a1").alias("rescue1"),
        only("a1", "b1").alias("hurt1"),
        only("b10", "a10").alias("rescue10"),
        only("a10", "b10").alias("hurt10"),
        n((F.col("a10") == 1) & (F.col("b10") == 1)).alias("both_hit"),
        n((F.col("a10") == 0) & (F.col("b10") == 0)).alias("both_miss"),
        n((rb < ra) & (ra < ABSENT_RANK)).alias("improved"),
        n((rb == ra) & (ra < ABSENT_RANK)).alias("tied"),
        n((rb > ra) & (rb < ABSENT_RANK)).alias("worsened"),
        n((ra == ABSENT_RANK) & (rb < ABSENT_RANK)).alias("newly_retrieved"),
        n((rb == ABSENT_RANK) & (ra < ABSENT_RANK)).alias("dropped"),
    )


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each query of either ranking, how many documents both list and their Jaccard index."""
    a, b = (r.select("query_id", "doc_id").withColumn(s, F.lit(1)) for r, s in ((first, "_a"), (second, "_b")))
    both = a.join(b, ["query_id", "doc_id"], "full").groupBy("query_id").agg(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("shared"), F.count(F.lit(1)).alias("_all"))
    return both.select("query_id", "shared", F.round(F.col("shared") / F.col("_all"), 6).alias("jaccard"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """``(id, em_strict, em_relaxed, f1, abstains, wrong_abstention)`` from ``answers(id, prediction, gold)``.

    f1 is that of the relaxed tokens as multisets: 1 if both are empty, 0 if
    one is. An abstention is wrong where there is a gold answer. Null texts are
    empty ones.
    """
    rows = answers.select("id", X.strict_answer(F.col("prediction")).alias("ps"), X.strict_answer(F.col("gold")).alias("gs"), X.relaxed_answer(F.col("prediction")).alias("pr"), X.relaxed_answer(F.col("gold")).alias("gr"), X.abstains(F.col("prediction")).alias("abstains"))
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    sides = rows.select("id", F.explode(F.concat(F.transform(words("pr"), lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"), F.lit(0).alias("g"))), F.transform(words("gr"), lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"), F.lit(1).alias("g"))))).alias("x"))
    same = sides.groupBy("id", "x.t").agg(F.sum("x.p").alias("p"), F.sum("x.g").alias("g")).groupBy("id").agg(F.sum(F.least("p", "g")).alias("same"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    f1 = F.when(F.coalesce("np", F.lit(0)) + F.coalesce("ng", F.lit(0)) == 0, 1.0).otherwise(2.0 * F.col("same") / (F.col("np") + F.col("ng")))
    return rows.join(same, "id", "left").select("id", (F.col("ps") == F.col("gs")).cast("int").alias("em_strict"), (F.col("pr") == F.col("gr")).cast("int").alias("em_relaxed"), F.round(f1, 6).alias("f1"), F.col("abstains").cast("int").alias("abstains"), (F.col("abstains") & (F.col("gr") != "")).cast("int").alias("wrong_abstention"))


# fixed values: the sums of the Poisson probabilities with mean 1, of 0 to 9 events
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)


def paired_bootstrap(differences: DataFrame, by: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Mean difference and its 95 % interval from ``differences(by, diff)``, by resampling whole groups ``by``.

    In each repetition a group counts as often as a Poisson draw with mean 1
    says, which for many groups is resampling with replacement; the draw
    follows from a hash of repetition and group, so that results don't depend
    on partitions. Groups are reduced to sums first; with a group for each
    query this is the paired bootstrap, with one for each conversation the
    cluster bootstrap. Each task adds up its own groups for all repetitions,
    so ``reps`` rows a task are shuffled, whatever the number of groups.
    Repetitions that draw nothing have no mean; of the others' means in order
    those at 2.5 and 97.5 % are the bounds.
    """
    groups = differences.groupBy(by).agg(F.sum("diff").alias("_s"), F.count("diff").alias("_n"))
    name = F.coalesce(F.concat(F.lit("k"), F.col(by).cast("string")), F.lit("n"))
    rows = groups.select("_s", "_n", name.alias("_name"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), "_name")), 1, 13), 16, 10).cast("bigint") / float(1 << 52)
    weight = sum(((spot >= bound).cast("int") for bound in POISSON), F.lit(0))
    sums = rows.select("rep", weight.alias("_w"), "_s", "_n").where("_w > 0").groupBy("rep").agg(F.sum(F.col("_w") * F.col("_s")).alias("s"), F.sum(F.col("_w") * F.col("_n")).alias("n"))
    means = sums.where("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    # as many rows as repetitions
    ordered = means.select("m", (F.row_number().over(Window.orderBy("m")) - 1).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_k"))
    at = lambda share, c: F.max(F.when(F.col("_r") == F.floor(F.col("_k") * share), F.col("m"))).alias(c)
    bounds = ordered.agg(at(0.025, "low"), at(0.975, "high"))
    mean = groups.agg((F.sum("_s") / F.sum("_n")).alias("mean_diff"), F.count(F.lit(1)).alias("n_groups"))
    return mean.join(F.broadcast(bounds)).select("n_groups", F.round("mean_diff", 6).alias("mean_diff"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


#: Wanted ranks up to which they are broadcast to the numbered rows; more are joined by shuffle.
BROADCAST_RANKS = 200_000


def percentile_definitions(samples: DataFrame, by: list[str], value: str, percents: list[int], digits: int | None = 6) -> DataFrame:
    """Exact percentiles under four definitions: linear, floor index, nearest rank rounded, upper index.

    ``(*by, pct, n, linear, floor, nearest, upper)``, of all rows if ``by`` is
    empty; ``digits`` rounds the linear one. The samples are numbered by range
    partitions and prefix sums, and the rows whose numbers are wanted are
    picked, so that no task sees a whole group. Null values count nowhere; a
    group of none gives no row, null group values form groups of their own.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("all")
    rows = number_rows(samples.where(F.col(value).isNotNull()), key, F.col(value).cast("double"), payload=by)
    starts = cut(key_starts(rows), "starts")
    last, share = F.col("n") - 1, F.col("pct") / 100.0
    spot = last * share
    spots = {"low": F.floor(spot), "high": F.ceil(spot), "nearest": F.floor(spot + 0.5), "upper": F.least(last, F.floor(F.col("n") * share))}
    wanted = starts.select("start", "n", F.explode(F.array(*map(F.lit, percents))).alias("pct"))
    wanted = wanted.select("start", "n", "pct", (spot - F.floor(spot)).alias("fraction"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), i.cast("bigint").alias("i")) for k, i in spots.items()])).alias("x"))
    wanted = wanted.select("n", "pct", "fraction", "x.kind", (F.col("start") + F.col("x.i")).alias("row"))
    if starts.count() * len(percents) * len(spots) <= BROADCAST_RANKS:
        wanted = F.broadcast(wanted)
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    found = rows.join(wanted, "row").groupBy(*by, "pct").agg(F.max("n").alias("n"), F.max("fraction").alias("_f"), *[at(kind).alias(f"_{kind}") for kind in spots])
    linear = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_f")
    return found.select(*by, "pct", "n", (linear if digits is None else F.round(linear, digits)).alias("linear"), F.col("_low").alias("floor"), F.col("_nearest").alias("nearest"), F.col("_upper").alias("upper"))


def main_effects(cells: DataFrame, factors: list[str], value: str) -> DataFrame:
    """``(factor, mean_on, mean_off, effect)`` of two-level factors (0 or 1) over ``cells``."""
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("on")) for f in factors])).alias("x"), F.col(value).alias("v"))
    out = rows.groupBy("x.factor").agg(F.avg(F.when(F.col("x.on") == 1, F.col("v"))).alias("on"), F.avg(F.when(F.col("x.on") == 0, F.col("v"))).alias("off"))
    return out.select("factor", F.round("on", 6).alias("mean_on"), F.round("off", 6).alias("mean_off"), F.round(F.col("on") - F.col("off"), 6).alias("effect"))


def interactions(cells: DataFrame, factors: list[str], value: str) -> DataFrame:
    """``(factor_a, factor_b, interaction)``: the difference of differences of cell means for each pair."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("x"), F.col(value).alias("v"))
    mean = lambda a, b: F.avg(F.when((F.col("x.a") == a) & (F.col("x.b") == b), F.col("v")))
    return rows.groupBy("x.factor_a", "x.factor_b").agg(F.round((mean(1, 1) - mean(0, 1)) - (mean(1, 0) - mean(0, 0)), 6).alias("interaction"))


def _in_hash_order(rows: DataFrame, ident: str, stratum: str, seed: int) -> DataFrame:
    """``(ident, stratum, place, n)``: the number of each row in its stratum, ordered by hash, and the stratum's size."""
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string"))), 1, 15), 16, 10).cast("bigint")
    key = F.coalesce(F.concat(F.lit("k"), F.col(stratum).cast("string")), F.lit("n"))
    return places(number_rows(rows, key, spot, payload=[ident, stratum])).select(ident, stratum, "place", "n")


def stratified_split(rows: DataFrame, ident: str, stratum: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``(ident, stratum, part)``: the first ``max(1, int(share * n))`` of each stratum in hash order are ``dev``, the rest ``test``.

    Exact for strata of any size, as rows are numbered over all partitions.
    Null strata are one; equal rows are told apart.
    """
    numbered = _in_hash_order(rows, ident, stratum, seed)
    return numbered.select(ident, stratum, F.when(F.col("place") < F.greatest(F.lit(1), F.floor(F.col("n") * share)), "dev").otherwise("test").alias("part"))


def balanced_sample(rows: DataFrame, ident: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """``(ident, stratum)``: ``size`` rows shared evenly among the strata, the first ones in order getting the remainder; hash order decides.

    A stratum with fewer rows than its share gives all it has.
    """
    strata = rows.select(stratum).distinct()
    # one row for each stratum
    numbered = strata.withColumn("_i", F.row_number().over(Window.orderBy(F.col(stratum).asc_nulls_last())) - 1).join(F.broadcast(strata.agg(F.count(F.lit(1)).alias("_k"))))
    quota = F.floor(F.lit(size) / F.col("_k")) + (F.col("_i") < F.lit(size) % F.col("_k")).cast("int")
    quotas = numbered.select(F.col(stratum).alias("_stratum"), quota.alias("_q"))
    # no stratum has more rows wanted than the first has
    first = _in_hash_order(rows, ident, stratum, seed).where(F.col("place") < size)
    return first.join(quotas, F.col(stratum).eqNullSafe(F.col("_stratum"))).where("place < _q").select(ident, stratum)


def grouped_split(rows: DataFrame, ident: str, group: str, held_out: int, seed: int = 42) -> DataFrame:
    """``(ident, group, part)``: all rows of the first ``held_out`` groups in hash order are ``held_out``, those of the rest ``dev``.

    Groups, not rows, are drawn, so that no conversation is on both sides. A
    null group is a group.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(group).cast("string")), F.lit("n"))
    groups = rows.select(name.alias("_g")).distinct().select("_g", F.md5(F.concat_ws(":", F.lit(str(seed)), "_g")).alias("_h"))
    chosen = groups.orderBy("_h", "_g").limit(held_out).select("_g", F.lit(True).alias("_out"))
    part = F.when(F.col("_out"), "held_out").otherwise("dev")
    return rows.select(ident, group, name.alias("_g")).join(chosen, "_g", "left").select(ident, group, part.alias("part"))


def leave_one_out(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, mean_without, delta)``: the mean of all other groups, and how far it is from the whole mean."""
    whole = rows.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    parts = rows.groupBy(group).agg(F.sum(value).alias("_gs"), F.count(value).alias("_gn"))
    without = (F.col("_s") - F.coalesce("_gs", F.lit(0.0))) / F.nullif(F.col("_n") - F.col("_gn"), F.lit(0))
    return parts.join(F.broadcast(whole)).select(group, F.round(without, 6).alias("mean_without"), F.round(without - F.col("_s") / F.col("_n"), 6).alias("delta"))


def tolerance_gate(actual: DataFrame, expected: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-4) -> DataFrame:
    """``(*keys, metric, passed)``: each metric within ``tolerance`` of what is expected; a missing row fails."""
    side = lambda df, tag: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(tag)) for m in metrics])).alias("x")).select(*keys, "x.*")
    both = side(expected, "_e").join(side(actual, "_a"), [*keys, "metric"], "full")
    return both.select(*keys, "metric", F.coalesce(F.abs(F.col("_e") - F.col("_a")) <= tolerance, F.lit(False)).alias("passed"))
