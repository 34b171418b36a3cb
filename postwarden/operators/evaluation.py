"""How well scores tell attacks from mail: confusion metrics, threshold sweeps, layer ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import CAUTION, noisy_or


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1e4 / whole + 0.5) / 1e4)


def rates(counts: DataFrame) -> DataFrame:
    """Counts tp, fp, tn, fn with precision, recall, f1 and false-positive rate, four places, 0 where undefined."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn), "fpr": _share(fp, fp + tn)})


def confusion(flagged: Column) -> list[Column]:
    attack = F.col("attack")
    return [F.count_if(attack & flagged).alias("tp"), F.count_if(~attack & flagged).alias("fp"), F.count_if(~attack & ~flagged).alias("tn"), F.count_if(attack & ~flagged).alias("fn")]


def metrics(samples: DataFrame, flagged: Column, *by: str) -> DataFrame:
    """Metrics of samples (attack, ...) that ``flagged`` holds for, over all or by groups."""
    return rates(samples.groupBy(*by).agg(*confusion(flagged)))


def sweep(samples: DataFrame, steps: int = 20) -> DataFrame:
    """Metrics at each threshold i/steps, without scoring again: all counts in one pass, then unpivoted."""
    each = [F.struct(F.lit(i / steps).alias("threshold"), *confusion(F.col("score") >= i / steps)) for i in range(1, steps)]
    rows = samples.agg(F.array(*each).alias("t")).select(F.explode("t").alias("t"))
    return rates(rows.select("t.*"))


def best(swept: DataFrame, least_precision: float = 0.95) -> DataFrame:
    """The threshold of the best f1, and that of the best recall at a precision; ties to the lower threshold."""
    names = swept.columns
    top = lambda rows, by, name: rows.agg(F.min_by(F.struct(*names), F.struct(-F.col(by), "threshold")).alias("m")).where("m is not null").select(F.lit(name).alias("choice"), "m.*")
    return top(swept, "f1", "best_f1").union(top(swept.where(F.col("precision") >= least_precision), "recall", "precise"))


def ablation(findings: DataFrame, last_layer: int = 3) -> DataFrame:
    """How many messages are flagged by the risks of layers 0 to k, for each k, from findings (message_id, layer, weight)."""
    upto = F.sequence(F.col("layer"), F.lit(last_layer))
    rows = findings.withColumn("upto", F.explode(upto)).groupBy("upto", "message_id").agg(F.collect_list("weight").alias("w"))
    scored = rows.select("upto", noisy_or(F.col("w")).alias("score"))
    return scored.groupBy("upto").agg(F.count_if(F.col("score") >= CAUTION).alias("flagged"), F.count("*").alias("scored"))
