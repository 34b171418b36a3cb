"""Attacks made from genuine mail: string templates over one message a contact, chosen by seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import canonical_address, domain_of, local_of
from ..functions.domains import name_label, org_domain

SEED = 20250909
#: Which layer each kind of attack should trip.
LAYERS = {"display_name_freemail": 1, "lookalike_domain": 1, "reply_to_divert": 0, "auth_forgery": 0, "credential_link": 3, "dangerous_attachment": 3, "style_swap": 2}
AFFIXES = ("{}-secure", "{}-payroll", "{}-billing", "{}-support", "{}-hr", "secure-{}", "mail-{}", "my-{}")
PAY = (
    "Hello,\n\nour bank details have changed. Please pay this week's invoice to IBAN GB29NWBK60161331926819 and tell me when it is done.\n\nThanks",
    "Hi,\n\ncould you send the transfer today? I am boarding and cannot take calls, just confirm here and keep it between us.\n\nRegards",
    "Hi,\n\nthe new remittance details are below. Process them before the end of the day, please.\n\nBest",
)
SIGN_IN = ("Your mailbox is full and new mail is refused. Sign in below within a day to keep it.", "Someone signed in to your account. Confirm that it was you or access ends.")
STRANGER = "KINDLY REVERT AT EARLIEST!!! The undersigned hereby requests that the enclosed matter be actioned forthwith; failure to comply shall result in escalation to management without further notice!!!"


def _draw(n: int, *key) -> Column:
    """A number below ``n`` that depends on the seed and the key alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(n)).cast("int")


def _pick(choices, *key) -> Column:
    return F.get(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), _draw(len(choices), *key))


def _auth(domain: Column, verdict: str, policy: str = "") -> Column:
    dkim = F.lit(f"dkim={verdict} header.d=")
    return F.concat(F.lit("mx.example.net; "), dkim, domain, F.lit(f"; spf={verdict} smtp.mailfrom="), domain, F.lit(f"; dmarc={verdict}{policy} header.from="), domain)


def _mail(headers: list[tuple[str, Column]], kind: str, body: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(v, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("") for k, v in headers]
    return F.encode(F.concat(*lines, F.lit(f"Content-Type: {kind}\r\n\r\n"), body), "utf-8")


def attacks(sources: DataFrame, per_transform: int = 20, transforms: dict[str, int] = LAYERS) -> DataFrame:
    """raw, label, transform, target_layer, source_gmail_id, impersonated of at most ``per_transform`` attacks a kind.

    ``sources``: gmail_id, from_addr, from_display, subject, body_text, to_addr, x_mailer, message_id.
    """
    one = sources.withColumn("contact", canonical_address("from_addr")).where("contact <> ''")
    one = one.groupBy("contact").agg(F.min_by(F.struct(*sources.columns), "gmail_id").alias("s")).select("contact", "s.*")
    name, address, domain = F.col("from_display"), F.col("from_addr"), domain_of("from_addr")
    label, org, me = name_label(domain), org_domain(domain), F.coalesce("to_addr", F.lit("user@example.net"))
    who = lambda n, a: F.concat(F.lit('"'), F.replace(F.coalesce(n, F.lit("")), F.lit('"'), F.lit("")), F.lit('" <'), a, F.lit(">"))
    gmail = org.isin("gmail.com", "googlemail.com")
    free = F.concat(F.regexp_replace(F.lower(F.coalesce(name, F.lit("x"))), "[^a-z0-9]+", "."), (1 + _draw(99, "n", F.col("contact"))).cast("string"), F.lit("@gmail.com"))
    fake_label = _pick([F.replace(F.lit(a), F.lit("{}"), label) for a in AFFIXES], "affix", F.col("contact"))
    fake = F.concat(fake_label, F.substring(org, F.length(label) + 1, F.lit(255)))
    pay, sign_in = _pick(PAY, "pay", F.col("contact")), _pick(SIGN_IN, "in", F.col("contact"))
    href = _pick([F.concat(F.lit("https://"), label, F.lit("-login.pages.dev/verify/account")), F.lit("http://203.0.113.9/login/verify"), F.concat(F.lit("https://"), org, F.lit(".account-check.example/login/password"))], "href", F.col("contact"))
    page = F.concat(F.lit("<p>"), sign_in, F.lit('</p><p><a href="'), href, F.lit('">https://'), org, F.lit("/signin</a></p>"))
    subject, mid = F.coalesce("subject", F.lit("Invoice")), F.concat(F.lit("<"), F.sha2("contact", 256).substr(1, 20), F.lit("@"), org, F.lit(">"))
    base = lambda frm, auth, *more: [("Authentication-Results", auth), *more, ("From", frm), ("To", me), ("Subject", subject), ("Message-ID", mid), ("X-Mailer", F.col("x_mailer"))]
    boundary = F.concat(
        F.lit("--b\r\nContent-Type: text/plain\r\n\r\n"), pay, F.lit('\r\n--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="Invoice.pdf.exe"\r\nContent-Transfer-Encoding: base64\r\n\r\nTVqQAAMAAAAEAAAA\r\n--b--\r\n')
    )
    text, genuine = "text/plain; charset=utf-8", _auth(org, "pass")
    made = {
        "display_name_freemail": (F.length(F.trim(name)).cast("boolean") & ~gmail, _mail(base(who(name, free), _auth(F.lit("gmail.com"), "pass")), text, pay)),
        "lookalike_domain": ((F.length(label) >= 4) & ~gmail, _mail(base(who(name, F.concat(local_of("from_addr"), F.lit("@"), fake)), _auth(fake, "pass")), text, pay)),
        "reply_to_divert": (domain != "", _mail(base(who(name, address), genuine, ("Reply-To", free)), text, pay)),
        "auth_forgery": (domain != "", _mail(base(who(name, address), _auth(org, "fail", " (p=REJECT)"), ("Return-Path", F.lit("<bounce@bulk-sender.example>"))), text, pay)),
        "credential_link": (domain != "", _mail(base(who(name, address), genuine), "text/html; charset=utf-8", page)),
        "dangerous_attachment": (domain != "", _mail(base(who(name, address), genuine), 'multipart/mixed; boundary="b"', boundary)),
        "style_swap": (domain != "", _mail([("Authentication-Results", genuine), ("X-Mailer", F.lit("BulkMail 9.1")), ("Message-ID", F.concat(F.lit("<0000-"), F.sha2("contact", 256).substr(1, 8), F.lit("-bulk@sender.example>"))), ("In-Reply-To", F.col("message_id")), ("From", who(name, address)), ("Subject", subject), ("To", me)], text, F.lit(STRANGER))),
    }
    each = F.array(*[F.struct(F.lit(t).alias("transform"), F.lit(layer).alias("target_layer"), F.when(made[t][0], made[t][1]).alias("raw")) for t, layer in transforms.items()])
    rows = one.select("gmail_id", "contact", F.explode(each).alias("a")).where("a.raw is not null").select("gmail_id", "contact", "a.*")
    order = Window.partitionBy("transform").orderBy(F.xxhash64(F.lit(SEED), "transform", "contact"), "contact")
    picked = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_transform)
    return picked.select("raw", F.lit("attack").alias("label"), "transform", "target_layer", F.col("gmail_id").alias("source_gmail_id"), F.col("contact").alias("impersonated"))
