"""The contact graph: who has written and been written to, and whom that makes worth imitating.

Contacts fold the log of first-ingest events, never the messages table: deleting or relabelling
a message does not undo that it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import canonical_address, domain_of, name_key
from ..functions.domains import blocking_keys, edits_of, imitation, is_freemail, name_label, org_domain, same_org, unicode_trick_of

MOST_NAMES = 20


def touches(messages: DataFrame) -> DataFrame:
    """One event a person and message: recipients (To and Cc, each time named) of sent mail, the sender of other mail."""
    sent = F.array_contains("labels", "SENT")
    people = F.when(sent, F.transform(F.concat("to_addrs", "cc_addrs"), lambda p: F.struct(p["addr"].alias("addr"), p["display"].alias("name")))).otherwise(
        F.array(F.struct(F.col("from_addr").alias("addr"), F.col("from_display").alias("name")))
    )
    rows = messages.select("account_id", "gmail_id", "received_at", sent.alias("outbound"), F.explode(people).alias("p"))
    return rows.select("account_id", "gmail_id", "received_at", "outbound", canonical_address(F.col("p.addr")).alias("canonical_email"), F.trim("p.name").alias("name")).where("canonical_email <> ''")


def contacts(events: DataFrame) -> DataFrame:
    """account_id, canonical_email, domain, display_names, first_seen, last_seen, inbound_count, outbound_count."""
    counts = events.groupBy("account_id", "canonical_email").agg(
        F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.count_if(~F.col("outbound")).alias("inbound_count"), F.count_if("outbound").alias("outbound_count")
    )
    named = events.where("name <> ''").groupBy("account_id", "canonical_email", "name").agg(F.min(F.struct("received_at", "gmail_id")).alias("at"))
    newest = Window.partitionBy("account_id", "canonical_email").orderBy(F.desc("at"), F.desc("name"))
    named = named.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= MOST_NAMES)  # each task keeps so many of a contact before the shuffle
    names = named.groupBy("account_id", "canonical_email").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n"))
    last = F.transform("n", lambda x: x["name"])
    out = counts.join(names, ["account_id", "canonical_email"], "left")
    return out.select(
        "account_id", "canonical_email", domain_of("canonical_email").alias("domain"), F.coalesce(last, F.array().cast("array<string>")).alias("display_names"),
        "first_seen", "last_seen", "inbound_count", "outbound_count",
    )


def merge_contacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two folds of disjoint event logs, the second later, as one."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    grouped = both.groupBy("account_id", "canonical_email").agg(
        F.max("domain").alias("domain"), F.array_sort(F.collect_list(F.struct("_age", "display_names"))).alias("n"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("inbound_count").alias("inbound_count"), F.sum("outbound_count").alias("outbound_count"),
    )
    names = F.array_distinct(F.flatten(F.transform("n", lambda x: x["display_names"])))
    return grouped.withColumn("display_names", F.slice(names, F.greatest(F.lit(1), F.size(names) - MOST_NAMES + 1), F.lit(MOST_NAMES))).select(old.columns)


def affinity() -> Column:
    return F.col("inbound_count") + 3 * F.col("outbound_count")


def trust() -> Column:
    """What correspondence is worth, 0 to 1: two sent messages count .6, ten received .4."""
    raw = F.least(F.lit(1.0), F.col("outbound_count") / 2.0) * 0.6 + F.least(F.lit(1.0), F.col("inbound_count") / 10.0) * 0.4
    return F.floor(raw * 1000 + 0.5) / 1000


def reference_grade() -> Column:
    return (F.col("outbound_count") > 0) | (F.col("inbound_count") >= 3)


def top_contacts(people: DataFrame, n: int = 30) -> DataFrame:
    return people.withColumn("affinity", affinity()).orderBy(F.desc("affinity"), "account_id", "canonical_email").limit(n)


def reference_names(people: DataFrame) -> DataFrame:
    """account_id, key, canonical_email, domain, trust: the names under which reference-grade contacts write."""
    rows = people.where(reference_grade()).select("account_id", "canonical_email", "domain", trust().alias("trust"), F.explode("display_names").alias("name"))
    return rows.withColumn("key", name_key("name")).where(F.length("key") >= 3).select("account_id", "key", "canonical_email", "domain", "trust").distinct()


def reference_domains(people: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id, org, trust: organisations of reference-grade contacts that are not providers, and the account's own."""
    theirs = people.where(reference_grade() & ~is_freemail("domain") & (F.col("domain") != "")).select("account_id", org_domain("domain").alias("org"), trust().alias("trust"))
    own = accounts.select("account_id", org_domain(domain_of("email")).alias("org"), F.lit(1.0).alias("trust")).where(~is_freemail("org") & (F.col("org") != ""))
    return theirs.union(own).groupBy("account_id", "org").agg(F.max("trust").alias("trust"))


def imitations(hosts: DataFrame, references: DataFrame) -> DataFrame:
    """The reference that each (account_id, host) imitates best: known, kind, confidence.

    No cross join: labels meet under keys (equal letters, equal looks, letters left out, and
    parts of the candidate's), and only pairs that share one are compared.
    """
    cands = hosts.select("account_id", "host", name_label("host").alias("c_label")).where("c_label <> ''").distinct()
    cands = cands.withColumn("key", F.explode(blocking_keys("candidate")("c_label")))
    refs = references.select("account_id", F.col("org").alias("known"), name_label("org").alias("k_label")).where(F.length("k_label") >= 4)
    refs = refs.withColumn("key", F.explode(blocking_keys("known")("k_label")))
    pairs = cands.join(refs, ["account_id", "key"]).select("account_id", "host", "known", "c_label", "k_label").distinct()
    judged = pairs.withColumn("i", imitation("host", "known", edits_of("c_label", "k_label"))).where("i is not null")
    best = judged.groupBy("account_id", "host").agg(F.min(F.struct((-F.col("i.confidence")).alias("order"), "known", F.col("i.kind").alias("kind"), F.col("i.confidence").alias("confidence"))).alias("b"))
    return best.select("account_id", "host", "b.known", "b.kind", "b.confidence")


def brands_in(hosts: DataFrame, references: DataFrame) -> DataFrame:
    """The reference whose label stands among a foreign host's labels before the last two; the first by letters."""
    labels = F.split("host", r"\.")
    rows = hosts.select("account_id", "host", org_domain("host").alias("org"), F.explode(F.slice(labels, F.lit(1), F.greatest(F.lit(0), F.size(labels) - 2))).alias("label"))
    refs = references.select("account_id", F.col("org").alias("known"), name_label("org").alias("label")).where(F.length("label") >= 4)
    own = references.select("account_id", "org")
    found = rows.join(refs, ["account_id", "label"]).join(own, ["account_id", "org"], "left_anti")
    return found.groupBy("account_id", "host").agg(F.min("known").alias("brand"))


def domain_facts(hosts: DataFrame, references: DataFrame) -> DataFrame:
    """account_id, host, trick, known, near (known, kind, confidence) and brand of distinct hosts."""
    hosts = hosts.where("host <> ''").distinct()
    known = references.select("account_id", F.col("org").alias("o"), F.lit(True).alias("known"))
    base = hosts.withColumn("trick", unicode_trick_of("host")).withColumn("o", org_domain("host")).join(known, ["account_id", "o"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    near = imitations(hosts, references).select("account_id", "host", F.struct("known", "kind", "confidence").alias("near"))
    out = base.join(near, ["account_id", "host"], "left").join(brands_in(hosts, references), ["account_id", "host"], "left")
    return out.select("account_id", "host", "trick", "known", F.when(~F.col("known"), F.col("near")).alias("near"), "brand")


def name_targets(senders: DataFrame, names: DataFrame) -> DataFrame:
    """For distinct (account_id, key, sender, sender_domain): the best contact of that name elsewhere, and three addresses of that name."""
    pairs = senders.where("key <> ''").distinct().join(names.withColumnRenamed("domain", "their_domain"), ["account_id", "key"])
    pairs = pairs.where((F.col("canonical_email") != F.col("sender")) & ~same_org("their_domain", "sender_domain"))
    best = F.min(F.struct((-F.col("trust")).alias("order"), F.col("canonical_email").alias("address"), "their_domain", "trust"))
    return pairs.groupBy("account_id", "key", "sender", "sender_domain").agg(best.alias("target"), F.slice(F.array_sort(F.collect_set("canonical_email")), 1, 3).alias("addresses"))
