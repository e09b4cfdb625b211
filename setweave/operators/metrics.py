"""Ranking, calibration and choice metrics. Each takes columns group..., label (0 or 1) and score.

Scores are first summed by value, so that no window holds more than the distinct scores of a
group. Groups of one class have no AUC and are left out, empty input gives no rows; if `strict`,
both are errors, as are null and non-finite scores.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import running


def by_score(df: DataFrame, groups: list[str], label: str = "label", score: str = "score", weight: Column | None = None) -> DataFrame:
    """groups, score, pos, neg: weighted counts of tied blocks."""
    w = F.lit(1.0) if weight is None else weight
    y = F.col(label)
    return df.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg"))


def checked(df: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """df, or ValueError if it is empty, a group has one class only, or a score is null or not finite."""
    s = F.col(score)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    n = df.groupBy(*groups).agg(F.count_if(bad).alias("bad"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    n = n.agg(F.count("*").alias("groups"), F.sum("bad").alias("bad"), F.count_if((F.col("p") == 0) | (F.col("n") == 0)).alias("single")).first()
    if not n["groups"] or n["bad"] or n["single"]:
        raise ValueError(f"no ranking: {n['groups']} groups, {n['bad']} bad scores, {n['single']} groups of one class")
    return df


def roc_auc(df: DataFrame, groups: list[str], label: str = "label", score: str = "score", weight: Column | None = None, strict: bool = False) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    b = by_score(checked(df, groups, label, score) if strict else df, groups, label, score, weight)
    b = running(b, groups, F.col("score"), {"below": "neg"})
    out = b.groupBy(*groups).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.where("p > 0 and n > 0").select(*groups, (F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def average_precision(df: DataFrame, groups: list[str], label: str = "label", score: str = "score", weight: Column | None = None, strict: bool = False) -> DataFrame:
    """Step-wise average precision; a tied score is one threshold."""
    b = by_score(checked(df, groups, label, score) if strict else df, groups, label, score, weight)
    b = running(b, groups, F.col("score").desc(), {"tp": "pos", "fp": "neg"})
    b = b.withColumn("tp", F.col("tp") + F.col("pos")).withColumn("all", F.col("tp") + F.col("fp") + F.col("neg"))
    out = b.groupBy(*groups).agg(F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("s"), F.sum("pos").alias("p"))
    return out.where("p > 0").select(*groups, (F.col("s") / F.col("p")).alias("ap"))


def brier_logloss(df: DataFrame, groups: list[str], label: str = "label", score: str = "score", eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return df.groupBy(*groups).agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def focal(label: Column, p: Column, gamma: float, alpha: float) -> Column:
    """Focal cross-entropy of a probability: hard examples weigh by (1 - p of the right class) ** gamma, positives by alpha."""
    one = alpha * F.pow(1 - p, F.lit(gamma)) * F.ln(p)
    return -F.when(label == 1, one).otherwise((1 - alpha) * F.pow(p, F.lit(gamma)) * F.ln(1 - p))


def accuracy(df: DataFrame, groups: list[str], label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """accuracy and balanced_accuracy (the mean of the classes' recalls)."""
    ok = ((F.col(score) >= cut).cast("int") == F.col(label)).cast("double")
    return df.groupBy(*groups).agg(F.avg(ok).alias("accuracy"), ((F.avg(F.when(F.col(label) == 1, ok)) + F.avg(F.when(F.col(label) == 0, ok))) / 2).alias("balanced_accuracy"))


def bin_of(score: Column, bins: int) -> Column:
    """Equal-width bin of a probability; a value outside [0, 1] or not finite is an error."""
    bad = score.isNull() | F.isnan(score) | (score < 0) | (score > 1)
    return F.when(bad, F.raise_error(F.lit("probability outside [0, 1]")).cast("int")).otherwise(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int"))


def reliability(df: DataFrame, groups: list[str], bins: int, label: str = "label", score: str = "score") -> DataFrame:
    """groups, bin, lower, upper, n, mean_probability, positive_rate; empty bins have null means."""
    if bins < 2:
        raise ValueError("at least two bins")
    b = df.groupBy(*groups, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_probability"), F.avg(label).alias("positive_rate"))
    grid = df.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(b, [*groups, "bin"], "left")
    return out.select(*groups, "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "positive_rate")


def ece(df: DataFrame, groups: list[str], bins: int, label: str = "label", score: str = "score") -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = df.groupBy(*groups, bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(label).alias("y"))
    return b.groupBy(*groups).agg((F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def first_argmax(df: DataFrame, groups: list[str], index: str, score: str) -> DataFrame:
    """The best candidate of each group; the first index wins ties."""
    best = F.min_by(index, F.struct((-F.col(score)).alias("s"), F.col(index).alias("i")))
    return df.groupBy(*groups).agg(best.alias("predicted_index"), F.max(score).alias("best_score"))
