"""From messages to verdicts: views, context joins, layers, fusion, and a second pass for intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions.addresses import canonical_address, name_key
from ..functions.codes import payloads_of
from ..functions.domains import org_domain
from ..functions.mail import parsed
from ..functions.markup import page
from ..functions.redaction import redacted
from ..functions.style import style
from ..operators import contacts as G
from ..operators import rules as R
from ..operators.findings import MODEL_VERSION, with_verdict

MOST_PROMPT_BODY = 6000
PROMPT_SYSTEM, PROMPT_MODEL = "Classify what this message asks of its reader.", "offline-intents-1"


def messages(raw: DataFrame) -> DataFrame:
    """Raw mail (account_id, gmail_id, label_ids, received_at, raw) parsed, one row a message.

    The raw bytes are left behind: what needs them again joins for them after filtering.
    """
    rows = raw.withColumn("m", parsed("raw"))
    received = F.coalesce("received_at", "m.date_utc")
    return rows.select("account_id", "gmail_id", F.xxhash64("account_id", "gmail_id").alias("message_id"), F.coalesce("label_ids", F.array().cast("array<string>")).alias("labels"), received.alias("received_at"), "m.*")


def collected_links(html: Column, body: Column) -> Column:
    """Links of the HTML, those of the text that the HTML lacks, and the refresh target."""
    from_html = F.transform(html["links"], lambda x: L.dissect(x["href"], x["anchor"], F.lit("html_anchor")))
    listed = F.array_compact(from_html)
    key = lambda x: F.lower(F.trim(x))
    have = F.transform(listed, lambda x: key(x["href"]))
    extra = F.filter(L.urls_in(body), lambda u: ~F.array_contains(have, key(u)))
    first = F.filter(extra, lambda u, i: F.array_position(F.transform(extra, key), key(u)) == i + 1)
    return F.array_compact(F.concat(listed, F.transform(first, lambda u: L.dissect(u)), F.array(L.dissect(html["meta_refresh"], None, F.lit("meta_refresh")))))


def views(mail: DataFrame) -> DataFrame:
    """Messages with what is derived from them alone: canonical sender, HTML page, links, style."""
    rows = mail.withColumn("canonical_email", canonical_address("from_addr")).withColumn("page", page("body_html")).withColumn("body_style", style("body_text"))
    rows = rows.withColumn("links", collected_links(F.col("page"), F.col("body_text")))
    orgs = F.array_distinct(F.filter(F.transform("links", lambda x: F.when(L.is_web(x), x["org"])), lambda o: o.isNotNull() & (o != "")))
    origin = F.get(F.reverse(F.filter("hops", lambda h: h["from_host"].isNotNull())), F.lit(0))
    rows = rows.withColumn("link_orgs", orgs).withColumn("origin_org", org_domain(origin["from_host"])).withColumn("dkim_domain", F.col("auth.dkim_domain"))
    return rows if "qr_payloads" in rows.columns else rows.withColumn("qr_payloads", F.lit(None).cast("array<string>"))


def with_codes(view: DataFrame, raw: DataFrame) -> DataFrame:
    """Views with the codes read from their pictures; only messages that are next to only pictures fetch their raw bytes."""
    pictured = F.exists("attachments", lambda a: a["content_type"].startswith("image/"))
    thin = (F.length("page.visible_text") < 200) & (F.length(F.trim(F.coalesce("body_text", F.lit("")))) < 200)
    wanted = view.where(pictured & thin).select("message_id", "account_id", "gmail_id")
    read = wanted.join(raw.select("account_id", "gmail_id", "raw"), ["account_id", "gmail_id"]).select("message_id", payloads_of("raw").alias("_codes"))
    return view.join(read, "message_id", "left").withColumn("qr_payloads", F.coalesce("_codes", "qr_payloads")).drop("_codes")


def with_context(view: DataFrame, people: DataFrame, accounts: DataFrame, profiles: DataFrame | None = None, intel: DataFrame | None = None) -> DataFrame:
    """Views joined to what is known about their senders and hosts."""
    known = people.select("account_id", "canonical_email", F.struct("inbound_count", "outbound_count", "domain").alias("contact"))
    rows = view.join(known, ["account_id", "canonical_email"], "left").withColumn("name_key", name_key("from_display"))
    named = F.when(~F.col("from_display").contains("@"), F.col("name_key")).otherwise("")
    senders = view.select("account_id", F.when(~F.col("from_display").contains("@"), name_key("from_display")).otherwise("").alias("key"), F.col("canonical_email").alias("sender"), F.col("from_domain").alias("sender_domain"))
    targets = G.name_targets(senders, G.reference_names(people)).select("account_id", "key", F.col("sender").alias("canonical_email"), F.col("sender_domain").alias("from_domain"), "target", "addresses")
    rows = rows.withColumn("key", named).join(targets, ["account_id", "key", "canonical_email", "from_domain"], "left").drop("key")
    references = G.reference_domains(people, accounts)
    codes = F.transform(F.coalesce("qr_payloads", F.array().cast("array<string>")), lambda p: L.dissect(p)["host"])
    hosts = F.array_distinct(F.array_compact(F.concat(F.transform("links", lambda x: x["host"]), codes, F.array("from_domain"))))
    each = view.select("message_id", "account_id", F.explode(hosts).alias("host")).where("host <> ''")
    facts = G.domain_facts(each.select("account_id", "host"), references)
    entry = F.struct("host", F.struct("trick", "known", "near", "brand").alias("fact"))
    maps = each.join(facts, ["account_id", "host"]).groupBy("message_id").agg(F.map_from_entries(F.collect_list(entry)).alias("facts"))
    has = references.groupBy("account_id").agg(F.lit(True).alias("has_references"))
    rows = rows.join(maps, "message_id", "left").join(has, "account_id", "left")
    if profiles is None:
        rows = rows.withColumn("profile", F.lit(None).cast(PROFILE))
    else:
        rows = rows.join(profiles.select("account_id", "canonical_email", F.struct("samples", "technical", "style", "relationship").alias("profile")), ["account_id", "canonical_email"], "left")
    if intel is None:
        return rows.withColumn("intel", F.lit(None).cast("struct<created_at: timestamp>"))
    ages = intel.where("error is null").groupBy("domain").agg(F.struct(F.max("created_at").alias("created_at")).alias("intel"))
    return rows.withColumn("domain", org_domain("from_domain")).join(ages, "domain", "left").drop("domain")


_H = "map<string,bigint>"
PROFILE = (
    f"struct<samples: bigint, technical: struct<x_mailers: {_H}, msgid_shapes: {_H}, mime_signatures: {_H}, header_orders: {_H}, tz_offsets: {_H}, origin_orgs: {_H}, dkim_domains: {_H}, send_hours: {_H}>,"
    f" style: struct<centroid: array<double>, scale: array<double>, self_similarity_mean: double, self_similarity_sd: double, mean_words: double, greetings: {_H}, signoffs: {_H}, samples: bigint>,"
    f" relationship: struct<sent_links: bigint, sent_attachments: bigint, messages: bigint, mean_recipients: double, link_orgs: {_H}>>"
)


def layers(as_of: Column, upto: int = 3) -> Column:
    """The findings of layers 0 to ``upto``, in order."""
    made = [R.protocol(), R.identity(as_of), R.habits(), R.content()][: upto + 1]
    return F.concat(*made)


def judged(context: DataFrame, as_of: Column | None = None, upto: int = 3) -> DataFrame:
    """Verdicts of the rule layers: message keys, findings, score, tier, headline, model_version."""
    as_of = F.col("received_at") if as_of is None else as_of
    rows = R.with_orgs(context)
    rows = rows.withColumn("findings", layers(as_of, upto))
    keep = ["message_id", "account_id", "gmail_id", "received_at", "from_addr", "from_display", "from_domain", "subject", "labels", "findings"]
    return with_verdict(rows.select(*keep))


def prompt(context: DataFrame) -> DataFrame:
    """message_id, the redacted prompt of a message, and the hash under which its answer is kept."""
    c, rel, own = F.col("contact"), F.col("profile.relationship"), F.col("account_email")
    habits = F.when(rel["messages"] >= 8, F.concat(
        F.when(rel["sent_attachments"] > 0, "; sends attachments").otherwise("; has never sent an attachment"),
        F.when(rel["sent_links"] > 0, "; sends links").otherwise("; has never sent a link"))).otherwise("")
    history = F.when(c.isNull(), "No earlier mail.").otherwise(F.concat(c["inbound_count"].cast("string"), F.lit(" received, "), c["outbound_count"].cast("string"), F.lit(" sent"), F.coalesce(habits, F.lit(""))))
    body = redacted(F.substring(F.coalesce("body_text", F.lit("")), 1, MOST_PROMPT_BODY), own)
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), F.coalesce(x, F.lit("")), F.lit(f"</{name}>"))
    text = F.concat_ws("\n", tag("relationship", history), tag("sender_display_name", F.col("from_display")), tag("sender_domain", F.col("from_domain")), tag("subject", redacted("subject", own)), tag("body", body))
    rows = context.select("message_id", text.alias("prompt"))
    return rows.withColumn("prompt_sha256", F.sha2(F.concat(F.lit(f"{PROMPT_SYSTEM}\0{PROMPT_MODEL}\0"), F.col("prompt")), 256))


def with_intents(verdicts: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts in the doubtful band fused again with kept answers; others and misses stay as they are.

    ``answers``: prompt_sha256 and struct<intent, confidence, flags, one_line_reason> as ``intent``.
    """
    doubtful = verdicts.where(R.in_band(F.col("score")))
    held = doubtful.join(prompts.select("message_id", "prompt_sha256"), "message_id", "left").join(answers, "prompt_sha256", "left")
    again = held.withColumn("findings", F.concat("findings", R.intent())).select(*[c for c in verdicts.columns if c not in ("score", "tier", "headline", "model_version")])
    return verdicts.where(~R.in_band(F.col("score"))).unionByName(with_verdict(again))


def unanswered(verdicts: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """The work list of a classifier: prompts of doubtful messages without an answer."""
    return prompts.join(verdicts.where(R.in_band(F.col("score"))).select("message_id"), "message_id", "left_semi").join(answers, "prompt_sha256", "left_anti")


def pending(view: DataFrame, accounts: DataFrame, verdicts: DataFrame | None = None, redo: bool = False, limit: int | None = None) -> DataFrame:
    """Messages to judge, newest first: not sent or drafted, not from the account itself, not judged by this version."""
    own = accounts.select("account_id", canonical_address("email").alias("_own"), F.lower(F.trim("email")).alias("account_email"))
    if "canonical_email" not in view.columns:
        view = view.withColumn("canonical_email", canonical_address("from_addr"))
    rows = view.join(own, "account_id", "left").where(~F.arrays_overlap("labels", F.array(F.lit("SENT"), F.lit("DRAFT"))) & ~F.coalesce(F.col("canonical_email") == F.col("_own"), F.lit(False))).drop("_own")
    if verdicts is not None and not redo:
        rows = rows.join(verdicts.where(F.col("model_version") == MODEL_VERSION).select("message_id"), "message_id", "left_anti")
    return rows.orderBy(F.desc_nulls_last("received_at"), "message_id").limit(limit) if limit else rows


def analyze(mail: DataFrame, people: DataFrame, accounts: DataFrame, profiles=None, intel=None, answers=None, verdicts=None, redo=False, limit=None, as_of: Column | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The flagship plan: pending messages, their context, four layers, fusion, and intents where given.

    Pages and styles are read of pending messages only; with ``raw`` (account_id, gmail_id, raw), so are their pictures.
    """
    view = views(pending(mail, accounts, verdicts, redo, limit))
    context = with_context(view if raw is None else with_codes(view, raw), people, accounts, profiles, intel)
    found = judged(context, as_of)
    return found if answers is None else with_intents(found, prompt(context), answers)
