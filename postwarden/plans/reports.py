"""What is asked of the results: lists, one verdict, statistics, evaluation, pages and JSON."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators.findings import long_findings, rank
from ..sources.mailbox import eml_files
from . import engine, synth

TIERS = ("danger", "caution", "safe")


def stats(messages: DataFrame, people: DataFrame) -> DataFrame:
    """Counts and range of a mailbox in one pass, and its contacts."""
    sent = F.array_contains("labels", "SENT")
    one = messages.agg(
        F.count("*").alias("messages"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
        F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
    )
    return one.join(people.agg(F.count("*").alias("contacts"), F.count_if(F.col("outbound_count") > 0).alias("written_to")), how="cross")


def auth_breakdown(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.coalesce("auth.dmarc", F.lit("(none)")).alias("dmarc")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dmarc")


def flagged(verdicts: DataFrame, tier: str | None = None, n: int = 25) -> DataFrame:
    """Messages of a tier, or all that are not safe, worst and newest first."""
    chosen = F.col("tier") == tier if tier else F.col("tier") != "safe"
    return verdicts.where(chosen).orderBy(F.desc("score"), F.desc("received_at"), "message_id").limit(n)


def summary(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages a tier, and the twenty most frequent risks with their worst severity."""
    f = long_findings(verdicts).where("weight > 0")
    codes = f.groupBy("code").agg(F.count("*").alias("n"), F.max_by("severity", rank(F.col("severity"))).alias("severity"))
    return verdicts.groupBy("tier").agg(F.count("*").alias("n")), codes.orderBy(F.desc("n"), "code").limit(20)


def usage(answers: DataFrame, *by: str, price_in: float = 5.0, price_out: float = 25.0) -> DataFrame:
    """Calls, tokens and cost of a classifier's answers (input_tokens, output_tokens), over all or by groups; prices are for a million tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = answers.groupBy(*by).agg(F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"))
    return sums.withColumn("cost", (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)


def profile_list(profiles: DataFrame, n: int = 25) -> DataFrame:
    """The senders with a profile, those of most samples first: samples, usual greeting, mean words, links and files sent."""
    usual = F.array_max(F.transform(F.map_entries("style.greetings"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("greeting"))))
    rows = profiles.select("account_id", "canonical_email", "samples", usual["greeting"].alias("greeting"), F.col("style.mean_words").alias("mean_words"), "relationship.sent_links", "relationship.sent_attachments")
    return rows.orderBy(F.desc("samples"), "canonical_email").limit(n)


def verdict(verdicts: DataFrame, which: str) -> DataFrame:
    """The findings of one message, by gmail_id or number, heaviest first."""
    one = verdicts.where((F.col("gmail_id") == which) | (F.col("message_id") == F.lit(which).try_cast("long")))
    return long_findings(one).orderBy(F.desc(F.abs("weight")), "position")


def show(messages: DataFrame, which: str, body: bool = False) -> DataFrame:
    keep = ["gmail_id", "received_at", "from_display", "from_addr", "reply_to_addr", "return_path_addr", "subject", "auth", "hops", "attachments", "mime_signature", "labels"]
    return messages.where((F.col("gmail_id") == which) | (F.col("message_id") == F.lit(which).try_cast("long"))).select(*keep, *(["body_text"] if body else []))


def inspect(spark: SparkSession, path: str, detect: bool = False) -> DataFrame:
    """A file parsed; with ``detect`` judged without any history."""
    mail = engine.messages(eml_files(spark, path))
    if not detect:
        return mail
    people = spark.createDataFrame([], "account_id long, canonical_email string, domain string, display_names array<string>, first_seen timestamp, last_seen timestamp, inbound_count long, outbound_count long")
    accounts = spark.createDataFrame([], "account_id long, email string")
    return engine.judged(engine.with_context(engine.views(mail), people, accounts))


def evaluate(mail: DataFrame, people: DataFrame, accounts: DataFrame, profiles: DataFrame | None = None, verdicts: DataFrame | None = None, per_transform: int = 20, benign: int = 300, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Benign mail and attacks made from it, judged once; metrics, by kind, thresholds, ablation.

    Benign is the newest mail that is not sent and not already judged dangerous, so that
    metrics hold for mail like it.
    """
    rows = mail.where(~F.array_contains("labels", "SENT") & (F.col("from_addr") != ""))
    if verdicts is not None:
        rows = rows.join(verdicts.where("tier = 'danger'").select("message_id"), "message_id", "left_anti")
    good = rows.orderBy(F.desc_nulls_last("received_at"), "message_id").limit(benign)
    own = accounts.select("account_id", F.col("email").alias("to_addr"))
    sources = good.join(own, "account_id", "left").select("gmail_id", "from_addr", "from_display", "subject", "body_text", "to_addr", "x_mailer", F.col("rfc822_message_id").alias("message_id"))
    made = synth.attacks(sources, per_transform)
    account = accounts.agg(F.min("account_id").alias("account_id"))
    raw = made.select(F.concat_ws("-", F.lit("synth"), "transform", "impersonated").alias("gmail_id"), F.array().cast("array<string>").alias("label_ids"), F.lit(None).cast("timestamp").alias("received_at"), "raw", "transform", "target_layer")
    bad = engine.messages(raw.join(account, how="cross"))
    kinds = raw.select("gmail_id", "transform", "target_layer")
    context = engine.with_context(engine.views(good.unionByName(bad)), people, accounts, profiles)
    judged = engine.judged(context, as_of).join(kinds, "gmail_id", "left").withColumn("attack", F.col("transform").isNotNull())
    samples = judged.select("message_id", "gmail_id", "transform", "target_layer", "attack", "score", "tier", "findings").persist()
    swept = V.sweep(samples)
    return {
        "overall": V.metrics(samples, F.col("tier") != "safe"), "danger_only": V.metrics(samples, F.col("tier") == "danger"), "by_transform": V.metrics(samples.where("attack"), F.col("tier") != "safe", "transform"),
        "mean_scores": samples.groupBy("attack").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n")), "sweep": swept, "best": V.best(swept), "ablation": _ablation(samples),
        "misses": samples.where("attack and tier = 'safe'").select("gmail_id", "transform", "score").orderBy("score", "gmail_id").limit(20),
        "false_alarms": samples.where("not attack and tier <> 'safe'").select("gmail_id", "score", "tier").orderBy(F.desc("score"), "gmail_id").limit(20),
    }


def _ablation(samples: DataFrame) -> DataFrame:
    """Metrics with the layers 0 to k, fused again from the findings kept, not judged again."""
    from ..operators.findings import fused

    upto = lambda k: F.filter("findings", lambda f: f["layer"] <= k)
    each = [F.struct(F.lit(k).alias("upto"), fused(upto(k))["tier"].alias("tier")) for k in range(4)]
    rows = samples.select("attack", F.explode(F.array(*each)).alias("u")).select("attack", "u.upto", "u.tier")
    return V.metrics(rows, F.col("tier") != "safe", "upto").orderBy("upto")


def as_json(parts: dict[str, DataFrame]) -> str:
    """Small results as one JSON document."""
    return json.dumps({k: [json.loads(r) for r in df.toJSON().take(1000)] for k, df in parts.items()}, sort_keys=True, indent=2)


def as_text(df: DataFrame, n: int = 50) -> str:
    """The first rows as aligned text."""
    rows = [[str(x) if x is not None else "" for x in r] for r in df.take(n)]
    table = [df.columns, *rows]
    widths = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in table)


def as_page(verdicts: DataFrame, n: int = 200) -> str:
    """A self-contained HTML page of at most ``n`` verdicts, worst tier first."""
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    rows = verdicts.orderBy(order, F.desc("score"), "message_id").limit(n).collect()
    items = []
    for r in rows:
        found = "".join(f"<li><b>{html.escape(f['severity'])}</b> {html.escape(f['human_text'])} <code>{html.escape(f['code'])}</code></li>" for f in sorted(r["findings"], key=lambda f: -f["weight"]))
        items.append(f"<article class={r['tier']}><h2>{html.escape(r['subject'] or '(no subject)')}</h2><p>{html.escape(r['from_addr'] or '')}: {r['score']:.2f}, {r['tier']}. {html.escape(r['headline'])}</p><ul>{found}</ul></article>")
    style = "body{font:15px sans-serif;max-width:60em;margin:auto}.danger{border-left:6px solid #b00}.caution{border-left:6px solid #c80}.safe{border-left:6px solid #080}article{padding:0 1em;margin:1em 0}"
    return f"<!doctype html><meta charset=utf-8><title>Mail</title><style>{style}</style>{''.join(items)}"
