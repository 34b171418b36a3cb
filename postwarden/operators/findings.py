"""Findings as structs, and their fusion into verdicts, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicons import RELIEF, SEVERITIES

MODEL_VERSION = "pw-rules-1"
DANGER, CAUTION = 0.70, 0.28
HARD_SCORES = {"danger": 0.97, "safe": 0.02}
FINDING = "struct<code: string, layer: int, severity: string, weight: double, mitigating: boolean, scope: array<int>, hard_tier: string, human_text: string, evidence: map<string, string>>"


def finding(code, layer: int, severity, weight, text, evidence: dict[str, Column] | None = None, scope: list[int] | None = None, hard: str | None = None) -> Column:
    """One finding; ``scope`` makes it mitigating for these layers."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for k, v in (evidence or {}).items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    held = F.create_map(*pairs) if pairs else F.lit(None)
    return F.struct(
        col(code).alias("code"), F.lit(layer).alias("layer"), col(severity).alias("severity"), col(weight).cast("double").alias("weight"),
        F.lit(scope is not None).alias("mitigating"), (F.array(*map(F.lit, scope)) if scope is not None else F.lit(None)).cast("array<int>").alias("scope"),
        F.lit(hard).cast("string").alias("hard_tier"), col(text).alias("human_text"), held.cast("map<string,string>").alias("evidence"),
    )


def gathered(*rules: Column) -> Column:
    """The rules that fire, in order, as an array of findings."""
    return F.array_compact(F.array(*[r.cast(FINDING) for r in rules]))


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def noisy_or(weights: Column) -> Column:
    """1 - the product of (1 - w), in ascending order of w so that it does not depend on the rows' order."""
    held = F.transform(weights, lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))
    return 1 - F.aggregate(F.array_sort(held), F.lit(1.0), lambda a, w: a * (1 - w))


def layer_term(findings: Column, layer: int) -> Column:
    """What a layer adds: its risks fused, less what mitigation may take off at its worst severity; null without risks."""
    risks = F.filter(findings, lambda f: (f["layer"] == layer) & ~f["mitigating"])
    helps = F.filter(findings, lambda f: f["mitigating"] & (f["scope"].isNull() | F.array_contains(f["scope"], layer)))
    worst = F.array_max(F.transform(risks, lambda f: rank(f["severity"])))
    ceiling = F.get(F.array(*[F.lit(RELIEF[s]) for s in SEVERITIES]), worst.cast("int"))
    relief = F.least(noisy_or(F.transform(helps, lambda f: f["weight"])), ceiling)
    return F.when(F.size(risks) > 0, noisy_or(F.transform(risks, lambda f: f["weight"])) * (1 - relief))


def tier_of(score: Column) -> Column:
    return F.when(score >= DANGER, "danger").when(score >= CAUTION, "caution").otherwise("safe")


def _layer_numbers() -> range:
    return range(5)


def fused(findings: Column) -> Column:
    """struct<score, tier, headline, layers array<struct<layer, term>>> of a message's findings."""
    terms = F.array_compact(F.array(*[layer_term(findings, k) for k in _layer_numbers()]))
    soft = F.floor(noisy_or(terms) * 1e4 + 0.5) / 1e4
    hard = F.get(F.filter(findings, lambda f: f["hard_tier"].isNotNull()), F.lit(0))
    score = F.when(hard["hard_tier"] == "danger", HARD_SCORES["danger"]).when(hard.isNotNull(), HARD_SCORES["safe"]).otherwise(soft)
    tier = F.coalesce(hard["hard_tier"], tier_of(soft))
    risks = F.filter(findings, lambda f: ~f["mitigating"])
    top = F.reduce(
        risks,
        F.lit(None).cast(FINDING),
        lambda a, f: F.when(a.isNull() | (rank(f["severity"]) > rank(a["severity"])) | ((f["severity"] == a["severity"]) & (f["weight"] > a["weight"])), f).otherwise(a),
    )
    calm = F.get(F.transform(F.filter(findings, lambda f: f["mitigating"]), lambda f: f["human_text"]), F.lit(0))
    headline = F.coalesce(hard["human_text"], top["human_text"], calm, F.lit("Nothing unusual was found."))
    return F.struct(score.alias("score"), tier.alias("tier"), headline.alias("headline"))


def with_verdict(messages: DataFrame, findings: str = "findings") -> DataFrame:
    """``messages`` with score, tier, headline and model_version of their findings."""
    out = messages.withColumn("_v", fused(F.col(findings)))
    return out.select(*messages.columns, F.col("_v.score").alias("score"), F.col("_v.tier").alias("tier"), F.col("_v.headline").alias("headline"), F.lit(MODEL_VERSION).alias("model_version"))


def long_findings(verdicts: DataFrame, key: str = "message_id") -> DataFrame:
    """One row a finding; the weight of mitigating ones is negative."""
    f = F.col("f")
    rows = verdicts.select(key, F.posexplode("findings").alias("position", "f"))
    return rows.select(key, "position", *[f[c].alias(c) for c in ("code", "layer", "severity", "mitigating", "human_text", "evidence")], F.when(f["mitigating"], -f["weight"]).otherwise(f["weight"]).alias("weight"))
