"""Changes of a mailbox: netting of change records, merges and removals as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import org_domain


def net_changes(changes: DataFrame) -> DataFrame:
    """One row a message of a batch (seq, gmail_id, kind, label_ids): delete beats insert, the last labels win."""
    kind = F.col("kind")
    net = changes.groupBy("gmail_id").agg(
        F.bool_or(kind == "deleted").alias("gone"), F.bool_or(kind == "added").alias("came"), F.max_by(F.when(kind == "labels", F.struct("label_ids")), F.when(kind == "labels", F.col("seq"))).alias("last")
    )
    action = F.when(F.col("gone"), "delete").when(F.col("came"), "insert").otherwise("relabel")
    return net.select("gmail_id", action.alias("action"), F.col("last.label_ids").alias("label_ids"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose keys they lack."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def apply_changes(messages: DataFrame, net: DataFrame, fetched: DataFrame) -> DataFrame:
    """The messages table after a batch: deleted rows gone, new ones in, others relabelled; bodies of known ones stay."""
    kept = messages.join(net.where("action = 'delete'").select("gmail_id"), "gmail_id", "left_anti")
    labels = net.where("label_ids is not null").select("gmail_id", F.col("label_ids").alias("_labels"))
    kept = kept.join(labels, "gmail_id", "left").withColumn("labels", F.coalesce("_labels", "labels")).drop("_labels")
    return kept.unionByName(first_seen(messages, fetched.join(net.where("action = 'insert'").select("gmail_id"), "gmail_id", "left_semi")))


def first_seen(messages: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched messages that the table lacks, once each: the events that contacts count."""
    return fetched.dropDuplicates(["account_id", "gmail_id"]).join(messages.select("account_id", "gmail_id"), ["account_id", "gmail_id"], "left_anti")


def advanced(offset: str | None, seen: str | None) -> str | None:
    """A history offset that only moves forward; one that is no number replaces what was there."""
    if not seen:
        return offset
    if offset and offset.isdigit() and seen.isdigit():
        return str(max(int(offset), int(seen)))
    return seen


def stale(intel: DataFrame, domains: DataFrame, as_of) -> DataFrame:
    """Domains whose registration data are missing or old: errors after 7 days, known ages after 30, unknown ages never."""
    held = domains.join(intel, "domain", "left")
    days = F.datediff(F.lit(as_of).cast("date"), "checked_at")
    due = F.when(F.col("checked_at").isNull(), True).when(F.col("error").isNotNull(), days >= 7).when(F.col("created_at").isNull(), False).otherwise(days >= 30)
    return held.where(due).select(*domains.columns)


def recovered(messages: DataFrame, listing: DataFrame, now, days: int = 30) -> DataFrame:
    """After an offset has expired: listed ids of the last ``days`` that the table lacks. Removals and labels are not known then."""
    recent = listing.where(F.col("received_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return recent.join(messages.select("account_id", "gmail_id"), ["account_id", "gmail_id"], "left_anti")


def domains_to_check(messages: DataFrame, intel: DataFrame, as_of, limit: int = 200) -> DataFrame:
    """Sender organisations whose registration is due, those with the newest mail first, at most ``limit``."""
    seen = messages.where("from_domain <> ''").groupBy(org_domain("from_domain").alias("domain")).agg(F.max("received_at").alias("last_seen"), F.count("*").alias("messages"))
    return stale(intel, seen, as_of).orderBy(F.desc("last_seen"), "domain").limit(limit)
