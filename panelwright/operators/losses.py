"""Evaluation losses of a return + class model, day by day, without materialising row pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.cross_section import DAY, ic_daily, per_day, relevance_levels
from panelwright.operators.ranks import top_k
from panelwright.operators.staging import stage

# Fixed values of the pairwise loss: weight ceiling, score-difference ceiling, denominator guard.
PAIR_WEIGHT_MAX = 10.0
SCORE_DIFF_MAX = 10.0
PAIR_EPS = 1e-8
MASK_EPS = 1e-12


def clean_class(y: Column, n_classes: int) -> Column:
    """The class if it is one of 0 .. n_classes-1, else -1."""
    return F.when(y.between(0, n_classes - 1), y).otherwise(F.lit(-1)).cast("int")


def predicted_class(logits: Column) -> Column:
    """Index of the first largest logit."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def cross_entropy_term(logits: Column, y: Column) -> Column:
    """-log softmax(logits)[y], NULL where the class is ignored."""
    peak = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - peak))
    return F.when(y >= 0, peak + F.log(total) - F.get(logits, y))


def class_accuracy_daily(df: DataFrame, y: str, logits: str, n_classes: int) -> DataFrame:
    label = clean_class(F.col(y), n_classes)
    hit = F.when(label >= 0, (predicted_class(F.col(logits)) == label).cast("double"))
    return df.groupBy("date").agg(F.count(hit).alias("n_labelled"), F.avg(hit).alias("accuracy"))


def masked_mse(df: DataFrame, y: str, pred: str, mask: str, by: list[str]) -> DataFrame:
    kept = F.col(mask)
    square = F.when(kept, F.pow(F.col(pred) - F.col(y), F.lit(2.0))).otherwise(0.0)
    return df.groupBy(*by).agg(
        (F.sum(square) / (F.sum(kept.cast("double")) + MASK_EPS)).alias("mse"),
        F.sum(kept.cast("long")).alias("n_masked"),
    )


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance.cast("double")) - 1


def discount(position: Column) -> Column:
    return 1 / F.log2(position.cast("double") + 2)


def ideal_dcg(df: DataFrame, relevance: str, k: int, by: Sequence[str] = DAY, gain: Callable[[Column], Column] = _gain) -> DataFrame:
    """IDCG@k per day from counts per relevance level: position p holds the p-th best level. Gains rise with the level.

    `discounts[m]` is the sum of the first m discounts, so a level filling positions a..b
    contributes gain * (discounts[b] - discounts[a]). No sort of the day is needed.
    """
    totals = [0.0]
    for p in range(k):
        totals.append(totals[-1] + 1.0 / math.log2(p + 2))
    discounts = F.array(*[F.lit(t) for t in totals])
    levels = df.groupBy(*by, F.col(relevance).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    per = levels.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("level", "n")), asc=False).alias("levels"))

    def fill(acc: Column, item: Column) -> Column:
        stop = F.least(acc["p"] + item["n"], F.lit(k).cast("long"))
        part = gain(item["level"]) * (F.get(discounts, stop.cast("int")) - F.get(discounts, acc["p"].cast("int")))
        return F.struct(stop.alias("p"), (acc["dcg"] + part).alias("dcg"))

    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0.0).alias("dcg"))
    return per.select(*by, F.aggregate("levels", start, fill)["dcg"].alias("idcg"))


def _top_scored(df: DataFrame, score: str, k: int) -> DataFrame:
    return top_k(df, DAY, [F.col(score).desc(), F.md5(F.col("sid")).asc()], k)


def ndcg_at_k(df: DataFrame, score: str, relevance: str, k: int) -> DataFrame:
    """DCG@k, IDCG@k and their ratio per day; equal scores in md5 order of the instrument."""
    rows = stage(df.select("date", "sid", score, relevance))
    top = _top_scored(rows, score, k)
    dcg = top.groupBy("date").agg(F.sum(_gain(F.col(relevance)) * discount(F.col("top_pos"))).alias("dcg"))
    ideal = ideal_dcg(rows, relevance, k)
    return dcg.join(ideal, "date").select("date", "dcg", "idcg", F.try_divide("dcg", "idcg").alias("ndcg"))


def lambda_rank_daily(df: DataFrame, score: str, relevance: str, mask: str, k: int = 50, sigma: float = 1.0) -> DataFrame:
    """Delta-NDCG@k weighted pairwise logistic loss per day: `pair_loss` summed, `n_pairs` counted.

    A pair weighs |gain difference| * |discount difference| / IDCG, and a row outside the top
    k has discount zero. So only pairs that touch a top-k row weigh anything, and each row
    needs just the day's k top rows (an array of k items per day, broadcast). The number
    of ordered pairs comes from the counts per relevance level. The work is rows * k, and
    equals the sum over all pairs.
    """
    rows = stage(df.select("date", "sid", score, relevance, mask))
    top = _top_scored(rows, score, k)
    # At most k items per day, one row per day.
    top_items = top.groupBy("date").agg(
        F.collect_list(
            F.struct(
                F.col("sid").alias("sid"),
                F.col(score).cast("double").alias("s"),
                F.col(relevance).cast("double").alias("r"),
                F.col(mask).alias("m"),
                discount(F.col("top_pos")).alias("d"),
            )
        ).alias("_top")
    )
    context = top_items.join(ideal_dcg(rows, relevance, k), "date")
    joined = rows.join(per_day(context), "date")
    own = F.filter("_top", lambda t: t["sid"] == F.col("sid"))
    joined = joined.withColumn("_d", F.coalesce(F.get(own, F.lit(0))["d"], F.lit(0.0)))
    inside = joined["_d"] > 0
    r, s = F.col(relevance).cast("double"), F.col(score).cast("double")

    def term(acc: Column, t: Column) -> Column:
        # Inside the top, a row only takes partners better than itself, so no pair counts twice.
        counts = t["m"] & F.when(inside, t["r"] > r).otherwise(t["r"] != r)
        diff = F.when(t["r"] > r, t["s"] - s).otherwise(s - t["s"])
        diff = F.greatest(F.lit(-SCORE_DIFF_MAX), F.least(diff, F.lit(SCORE_DIFF_MAX)))
        weight = F.abs(_gain(t["r"]) - _gain(r)) * F.abs(t["d"] - F.col("_d")) / (F.col("idcg") + PAIR_EPS)
        loss = F.least(weight, F.lit(PAIR_WEIGHT_MAX)) * F.log1p(F.exp(-sigma * diff))
        return acc + F.when(counts, loss).otherwise(0.0)

    row_loss = F.when(F.col(mask), F.aggregate("_top", F.lit(0.0), term)).otherwise(0.0)
    loss = joined.groupBy("date").agg(F.sum(row_loss).alias("pair_loss"))
    counts = rows.where(F.col(mask)).groupBy("date", relevance).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.groupBy("date").agg(
        ((F.pow(F.sum("n"), F.lit(2.0)) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_pairs")
    )
    return loss.join(pairs, "date", "left").select(
        "date", "pair_loss", F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs")
    )


def lambda_rank_loss(daily: DataFrame, by: list[str]) -> DataFrame:
    """Mean over all ordered pairs of the group's days."""
    return daily.groupBy(*by).agg((F.sum("pair_loss") / (F.sum("n_pairs") + PAIR_EPS)).alias("lambda_rank_loss"))


def evaluate(
    df: DataFrame, split: str, n_classes: int = 5, use_lambda_rank: bool = False, k: int = 50, bins: int = 5, sigma: float = 1.0
) -> DataFrame:
    """Split-level roll-up over days: return loss, class loss, total, IC, rank IC, accuracy.

    `df` holds date, sid, y_ret, pred_ret, ret_mask, y_mom, logits and the split column.
    Every figure is a true mean over the days it is defined on. `df` is read once per
    figure: pass a stored table.
    """
    days = df.select("date", split).distinct()
    if use_lambda_rank:
        ranked = relevance_levels(df, "y_ret", "ret_mask", bins)
        ret = lambda_rank_daily(ranked, "pred_ret", "relevance", "ret_mask", k, sigma).select(
            "date", (F.col("pair_loss") / (F.col("n_pairs") + PAIR_EPS)).alias("ret_loss")
        )
    else:
        ret = masked_mse(df, "y_ret", "pred_ret", "ret_mask", DAY).select("date", F.col("mse").alias("ret_loss"))
    label = clean_class(F.col("y_mom"), n_classes)
    cls = df.groupBy("date").agg(
        F.avg(cross_entropy_term(F.col("logits"), label)).alias("ce_loss"),
        F.avg(F.when(label >= 0, (predicted_class(F.col("logits")) == label).cast("double"))).alias("accuracy"),
    )
    ic = ic_daily(df, "y_ret", "pred_ret", "ret_mask").select("date", "ic", "rank_ic")
    daily = days.join(ret, "date", "left").join(cls, "date", "left").join(ic, "date", "left")
    summed = daily.groupBy(split).agg(
        *[F.avg(c).alias(c) for c in ("ret_loss", "ce_loss", "ic", "rank_ic", "accuracy")]
    )
    return summed.withColumn("loss", F.col("ret_loss") + F.col("ce_loss"))
