"""Fingerprints of senders: how their mail is made, how they write, what they send.

All are grouped aggregates: histograms in two levels, per-dimension moments over exploded
vectors, and leave-one-out similarity from sums, so that nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.style import cosine, id_shape, scaled, style

VERSION = "pw-fp-1"
NEWEST, LEAST_SAMPLES, LEAST_WORDS, KNOWN = 400, 12, 12, 2
TECHNICAL = ("x_mailers", "msgid_shapes", "mime_signatures", "header_orders", "tz_offsets", "origin_orgs", "dkim_domains", "send_hours")
COMPARED = TECHNICAL[:7]
KEY = ("account_id", "canonical_email")


def technical_values() -> dict[str, Column]:
    """A message's value in each technical dimension, null where it has none."""
    some = lambda c: F.when(c != "", c)
    return {
        "x_mailers": some(F.coalesce(some(F.col("x_mailer")), F.col("user_agent"))), "msgid_shapes": some(id_shape("rfc822_message_id")),
        "mime_signatures": some(F.col("mime_signature")), "header_orders": some(F.col("header_order_hash")), "tz_offsets": F.col("tz_offset_min").cast("string"),
        "origin_orgs": some(F.col("origin_org")), "dkim_domains": some(F.col("dkim_domain")), "send_hours": F.hour("received_at").cast("string"),
    }


def usable(views: DataFrame, verdicts: DataFrame | None = None, newest: int = NEWEST) -> DataFrame:
    """The newest messages of each sender that are neither sent mail nor judged dangerous."""
    rows = views.where(~F.array_contains("labels", "SENT") & (F.col("canonical_email") != ""))
    if verdicts is not None:
        rows = rows.join(verdicts.where("tier = 'danger'").select("message_id"), "message_id", "left_anti")
    order = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("received_at"), "message_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest).drop("_n")


def histograms(samples: DataFrame) -> DataFrame:
    """(key, technical struct of map<value, count>, samples)."""
    values = F.array(*[F.struct(F.lit(k).alias("dim"), v.alias("value")) for k, v in technical_values().items()])
    rows = samples.select(*KEY, F.explode(values).alias("v")).select(*KEY, "v.dim", "v.value").where("value is not null")
    counts = rows.groupBy(*KEY, "dim", "value").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*KEY).pivot("dim", list(TECHNICAL)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))))
    none = F.create_map().cast("map<string,bigint>")
    return maps.select(*KEY, F.struct(*[F.coalesce(d, none).alias(d) for d in TECHNICAL]).alias("technical"))


def _vectors(samples: DataFrame) -> DataFrame:
    return samples.withColumn("_s", style("body_text")).where(F.col("_s.words") >= LEAST_WORDS).select(*KEY, "message_id", "_s.words", "_s.vector", "_s.greeting", "_s.signoff")


def fit_vectors(rows: DataFrame, keys: list[str], item: str, vector: str = "vector") -> DataFrame:
    """Per key: centroid, scale, mean and deviation of each item's cosine to the centre of the others, items n."""
    parts = rows.select(*keys, F.posexplode(vector).alias("at", "x"))
    moments = parts.groupBy(*keys, "at").agg(F.stddev_pop("x").alias("sd"), F.avg("x").alias("mean"))
    moments = moments.withColumn("scale", F.greatest("sd", 0.25 * F.abs("mean"), F.lit(0.01)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    scales = moments.groupBy(*keys).agg(ordered("scale").alias("scale"))
    fitted = rows.join(scales, keys).withColumn("z", scaled(F.col(vector), F.col("scale")))
    sums = fitted.select(*keys, F.posexplode("z").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    totals = sums.groupBy(*keys).agg(ordered("total").alias("total"), F.max("n").alias("n"))
    apart = fitted.join(totals, keys)
    others = F.zip_with("total", "z", lambda t, x: (t - x) / F.greatest(F.col("n") - 1, F.lit(1)))
    similar = apart.withColumn("similarity", F.when(F.col("n") > 1, cosine(F.col("z"), others)))
    stats = similar.groupBy(*keys).agg(F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("sd"))
    rounded = lambda c: F.coalesce(F.floor(F.col(c) * 1e4 + 0.5) / 1e4, F.lit(0.0)).alias(c)
    out = totals.join(scales, keys).join(stats, keys)
    return out.select(*keys, F.transform("total", lambda t: t / F.col("n")).alias("centroid"), "scale", rounded("mean"), rounded("sd"), "n")


def styles(samples: DataFrame) -> DataFrame:
    rows = _vectors(samples)
    fitted = fit_vectors(rows, list(KEY), "message_id")
    words = rows.groupBy(*KEY).agg((F.floor(F.avg("words") * 10 + 0.5) / 10).alias("mean_words"))
    out = fitted.join(words, list(KEY))
    for name in ("greeting", "signoff"):
        counts = rows.where(F.col(name) != "").groupBy(*KEY, name).agg(F.count("*").alias("k"))
        maps = counts.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "k")))).alias(f"{name}s"))
        out = out.join(maps, list(KEY), "left")
    none = F.create_map().cast("map<string,bigint>")
    return out.select(
        *KEY,
        F.struct(
            "centroid", "scale", F.col("mean").alias("self_similarity_mean"), F.col("sd").alias("self_similarity_sd"), "mean_words",
            F.coalesce("greetings", none).alias("greetings"), F.coalesce("signoffs", none).alias("signoffs"), F.col("n").alias("samples"),
        ).alias("style"),
    )


def relationships(samples: DataFrame) -> DataFrame:
    """What a sender sends; ``link_orgs`` of a message are its web links' organisations."""
    attached = F.exists("attachments", lambda a: ~a["is_inline"])
    base = samples.groupBy(*KEY).agg(
        F.count_if(F.size("link_orgs") > 0).alias("sent_links"), F.count_if(attached).alias("sent_attachments"), F.count("*").alias("messages"),
        (F.floor(F.avg(F.size("to_addrs")) * 100 + 0.5) / 100).alias("mean_recipients"),
    )
    orgs = samples.select(*KEY, F.explode(F.array_distinct("link_orgs")).alias("org")).where("org <> ''").groupBy(*KEY, "org").agg(F.count("*").alias("k"))
    maps = orgs.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("org", "k")))).alias("link_orgs"))
    out = base.join(maps, list(KEY), "left")
    return out.select(*KEY, F.struct("sent_links", "sent_attachments", "messages", "mean_recipients", F.coalesce("link_orgs", F.create_map().cast("map<string,bigint>")).alias("link_orgs")).alias("relationship"))


def build(views: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Profiles of senders with enough messages: key, version, samples, technical, style, relationship."""
    samples = usable(views, verdicts)
    counts = samples.groupBy(*KEY).agg(F.count("*").alias("samples")).where(F.col("samples") >= LEAST_SAMPLES)
    out = counts.join(histograms(samples), list(KEY)).join(styles(samples), list(KEY), "left").join(relationships(samples), list(KEY))
    return out.select(*KEY, F.lit(VERSION).alias("version"), "samples", "technical", "style", "relationship")


def share(histogram: Column, value: Column) -> Column:
    total = F.aggregate(F.map_values(histogram), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(F.try_divide(F.get(F.map_values(F.map_filter(histogram, lambda k, v: k == value)), F.lit(0)), total), F.lit(0.0))


def is_known(histogram: Column, value: Column) -> Column:
    return F.coalesce(F.exists(F.map_entries(histogram), lambda e: (e["key"] == value) & (e["value"] >= KNOWN)), F.lit(False))


def z_score(profile_style: Column, vector: Column, words: Column) -> Column:
    """How far a text is from its writer's own spread, discounted for short texts."""
    similarity = cosine(scaled(vector, profile_style["scale"]), profile_style["centroid"])
    sd = F.greatest(profile_style["self_similarity_sd"], 0.03 + 0.20 / F.sqrt(profile_style["samples"].cast("double")))
    discount = F.least(F.lit(1.0), F.sqrt(words / F.greatest(profile_style["mean_words"], F.lit(1.0))))
    return (profile_style["self_similarity_mean"] - similarity) / sd * discount
