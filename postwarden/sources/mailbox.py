"""Mail as raw bytes: folders of .eml files, and exported API records with base64url bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RAW = 5 << 20


def _below(file: Column, folder: str) -> Column:
    """A file's path below a folder; its name, if the folder is the file or is named by a pattern."""
    last = re.sub(r"^[a-z]+:/+", "/", folder.rstrip("/"))
    under = F.substring_index(file, last + "/", -1)
    return F.when(file.contains(last + "/"), under).otherwise(F.element_at(F.split(file, "/"), -1))


def eml_files(spark: SparkSession, path: str, account_id: int = 1) -> DataFrame:
    """account_id, gmail_id (path below the folder), label_ids, received_at (null: the Date header decides) and raw of .eml files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.lit(account_id).cast("long").alias("account_id"), _below(F.col("path"), path).alias("gmail_id"), F.array().cast("array<string>").alias("label_ids"),
        F.lit(None).cast("timestamp").alias("received_at"), F.col("content").alias("raw"),
    )


def api_records(records: DataFrame) -> DataFrame:
    """Exported records (account_id, id, labelIds, internalDate in ms, raw base64url) in the same shape; raw over 5 MiB is null."""
    raw = F.unbase64(F.translate("raw", "-_", "+/"))
    return records.select(
        "account_id", F.col("id").alias("gmail_id"), F.col("labelIds").alias("label_ids"), F.timestamp_millis(F.col("internalDate").try_cast("long")).alias("received_at"),
        F.when(F.length(raw) <= MOST_RAW, raw).alias("raw"),
    )


def registrations(records: DataFrame) -> DataFrame:
    """Stored RDAP replies (domain, body JSON, checked_at) as domain_intel rows."""
    shape = "struct<events: array<struct<eventAction: string, eventDate: string>>, nameservers: array<struct<ldhName: string>>, entities: array<struct<roles: array<string>, handle: string>>>"
    r = F.from_json("body", shape)
    date = lambda kind: F.get(F.filter(r["events"], lambda e: e["eventAction"] == kind), F.lit(0))["eventDate"].try_cast("timestamp")
    registrar = F.get(F.filter(r["entities"], lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["handle"]
    names = F.array_join(F.array_sort(F.transform(r["nameservers"], lambda n: F.lower(n["ldhName"]))), ",")
    return records.select("domain", date("registration").alias("created_at"), date("expiration").alias("expires_at"), registrar.alias("registrar"), names.alias("nameservers"), F.lit("rdap").alias("source"), "checked_at", F.when(r.isNull(), "unreadable").alias("error"))
