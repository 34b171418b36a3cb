"""Every finding code: a message that gives it, with severity and weight, and one that just does not."""

import copy
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from postwarden.functions import links as L
from postwarden.functions.markup import PAGE
from postwarden.functions.style import STYLE
from postwarden.operators import rules as R
from postwarden.plans.engine import PROFILE

FACT = "struct<trick: string, known: boolean, near: struct<known: string, kind: string, confidence: double>, brand: string>"
SCHEMA = f"""name string, from_addr string, from_domain string, from_display string, canonical_email string, reply_to_addr string, return_path_addr string, subject string, body_text string,
  in_reply_to string, x_mailer string, user_agent string, rfc822_message_id string, mime_signature string, header_order_hash string, tz_offset_min int, origin_org string, dkim_domain string, received_at timestamp,
  auth struct<spf: string, dkim: string, dmarc: string, raw: string, arc_present: boolean, dkim_domain: string>, contact struct<inbound_count: bigint, outbound_count: bigint, domain: string>,
  target struct<address: string, their_domain: string, trust: double>, addresses array<string>, intel struct<created_at: timestamp>, facts map<string, {FACT}>, has_references boolean, profile {PROFILE},
  page {PAGE}, sent array<struct<href: string, anchor: string>>, attachments array<struct<filename: string, content_type: string, is_inline: boolean>>, link_orgs array<string>, qr_payloads array<string>, body_style {STYLE},
  intent struct<intent: string, confidence: double, prompt_injection_attempt: boolean, requests_secrecy: boolean, unusual_for_relationship: boolean, one_line_reason: string>"""
NOW = dt.datetime(2025, 9, 10, 12)
DIMS = ("x_mailers", "msgid_shapes", "mime_signatures", "header_orders", "tz_offsets", "origin_orgs", "dkim_domains", "send_hours")
OWN = {
    "x_mailer": "Post 4", "rfc822_message_id": "ab12@acme.com", "mime_signature": "text/plain", "header_order_hash": "h", "tz_offset_min": 60, "origin_org": "acme.com", "dkim_domain": "acme.com",
}
KNOWN = dict(zip(DIMS, ("Post 4", "a9@acme.com", "text/plain", "h", "60", "acme.com", "acme.com"), strict=False))
PROFILED = {
    "samples": 30, "technical": {d: {KNOWN[d]: 9} if d in KNOWN else {} for d in DIMS},
    "style": {"centroid": [1.0, 0.0], "scale": [1.0, 1.0], "self_similarity_mean": 0.9, "self_similarity_sd": 0.1, "mean_words": 50.0, "greetings": {"hi": 5}, "signoffs": {}, "samples": 25},
    "relationship": {"sent_links": 4, "sent_attachments": 4, "messages": 30, "mean_recipients": 1.0, "link_orgs": {"acme.com": 4, "b.com": 1, "c.com": 1}},
}
BASE = {
    "from_addr": "mia@acme.com", "from_domain": "acme.com", "from_display": "Mia Holm", "canonical_email": "mia@acme.com", "reply_to_addr": "", "return_path_addr": "", "subject": "lunch", "body_text": "b" * 120, "in_reply_to": "",
    "user_agent": None, "received_at": NOW, "auth": {"spf": "pass", "dkim": "pass", "dmarc": "pass", "raw": "mx; dmarc=pass", "arc_present": False, "dkim_domain": "acme.com"},
    "contact": {"inbound_count": 3, "outbound_count": 0, "domain": "acme.com"}, "facts": {}, "has_references": True, "sent": [], "attachments": [], "link_orgs": [], "qr_payloads": [],
    "page": {"links": [], "images": [], "forms": [], "meta_refresh": None, "visible_text": "v" * 250, "hidden_text": "", "script_count": 0}, "body_style": {"words": 50, "vector": [0.75, math.sqrt(1 - 0.75**2)], "greeting": "hi", "signoff": ""}, **OWN,
}


def auth(**x):
    return {"auth": BASE["auth"] | x}


def failing(policy, **x):
    return auth(dmarc="fail", raw=f"mx; dmarc=fail (p={policy}) header.from=acme.com", **x)


def near(kind, confidence=1.0, host="acme.com", **x):
    return {"facts": {host: {"trick": None, "known": False, "near": {"known": "acne.com", "kind": kind, "confidence": confidence}, "brand": None} | x}}


def fact(host="acme.com", **x):
    return {"facts": {host: {"trick": None, "known": False, "near": None, "brand": None} | x}}


def target(domain, trust):
    return {"target": {"address": f"mia@{domain}", "their_domain": domain, "trust": trust}, "addresses": [f"mia@{domain}"]}


def profiled(style=None, relationship=None, samples=30, **message):
    p = copy.deepcopy(PROFILED) | {"samples": samples}
    p["style"] |= style or {}
    p["relationship"] |= relationship or {}
    return {"profile": p} | message


def styled(similarity, words=50, greeting="hi", **style):
    return profiled(style, body_style={"words": words, "vector": [similarity, math.sqrt(1 - similarity**2)], "greeting": greeting, "signoff": ""})


def novel(n, samples=30, **x):
    names = list(OWN)[:n]
    return profiled(samples=samples, **{k: 99 if k == "tz_offset_min" else f"new {k}" for k in names}, **x)


def linked(href, anchor=None, **x):
    return {"sent": [{"href": href, "anchor": anchor}]} | x


def page(**x):
    return {"page": BASE["page"] | x}


def form(password=False, action="https://acme.com/x"):
    return page(forms=[{"action": action, "method": "post", "has_password": password, "inputs": ["q"]}])


def image(n=1, pixel=False, data=False):
    return [{"src": "s", "is_data": data, "is_pixel": pixel, "alt": ""}] * n


def attached(name, kind="application/octet-stream", inline=False, **x):
    return {"attachments": [{"filename": name, "content_type": kind, "is_inline": inline}]} | x


def coded(*payloads, read=True, thin=True, **x):
    return attached("x.png", "image/png") | page(visible_text="v" * (199 if thin else 200)) | {"body_text": "b" * 120, "qr_payloads": list(payloads) if read else None} | x


def meant(kind="benign", confidence=1.0, **flags):
    return {"intent": {"intent": kind, "confidence": confidence, "prompt_injection_attempt": False, "requests_secrecy": False, "unusual_for_relationship": False, "one_line_reason": ""} | flags}


def ago(**x):
    return {"intel": {"created_at": NOW - dt.timedelta(**x)}}


free = {"from_addr": "mia@gmail.com", "from_domain": "gmail.com", "canonical_email": "mia@gmail.com"}
#: code, severity, weight, a message that gives it, and one that does not.
CASES = [
    ("AUTH_RESULTS_MISSING", "low", 0.20, auth(raw=None), auth(raw="mx; none")),
    ("DMARC_FAIL_ENFORCED", "critical", 0.95, failing("REJECT"), failing("NONE")),
    ("DMARC_FAIL_ENFORCED", "critical", 0.95, failing("quarantine"), auth(dmarc="pass", raw="mx; dmarc=pass (p=REJECT)")),
    ("DMARC_FAIL", "high", 0.75, failing("none"), failing("reject")),
    ("UNAUTHENTICATED_SENDER", "medium", 0.50, auth(dmarc="none", spf="none", dkim="none"), auth(dmarc="none", spf="pass", dkim="none")),
    ("SPF_FAIL", "medium", 0.50, auth(dmarc="none", spf="fail"), auth(dmarc="pass", spf="fail")),
    ("SPF_SOFTFAIL", "low", 0.28, auth(dmarc="none", spf="softfail"), auth(dmarc="none", spf="none")),
    ("DKIM_FAIL", "medium", 0.45, auth(dmarc="none", dkim="fail"), auth(dmarc="fail", dkim="fail")),
    ("DKIM_UNALIGNED", "medium", 0.50, auth(dmarc="none", dkim_domain="bulk.com"), auth(dmarc="none", dkim_domain="sendgrid.net")),
    ("DKIM_UNALIGNED", "medium", 0.50, auth(dmarc="fail", dkim_domain="bulk.com"), auth(dmarc="none", dkim_domain="mail.acme.com")),
    ("ARC_FORWARDED", "info", 0.55, auth(dmarc="none", spf="fail", arc_present=True), auth(dmarc="none", spf="fail")),
    ("DMARC_PASS", "info", 0.60, {}, auth(dmarc="none")),
    ("REPLY_TO_FREEMAIL", "high", 0.70, {"reply_to_addr": "mia@gmail.com"}, {"reply_to_addr": "mia@gmail.com"} | free),
    ("REPLY_TO_OFFDOMAIN", "medium", 0.45, {"reply_to_addr": "mia@other.com"}, {"reply_to_addr": "mia@mail.acme.com"}),
    ("RETURN_PATH_OFFDOMAIN", "low", 0.30, auth(dmarc="none") | {"return_path_addr": "b@bulk.com"}, {"return_path_addr": "b@bulk.com"}),
    ("DISPLAY_NAME_IMPERSONATION_FREEMAIL", "critical", 0.88, free | target("acme.com", 0.2), free | target("yahoo.com", 0.2)),
    ("DISPLAY_NAME_IMPERSONATION", "critical", 0.85, target("other.com", 0.5), {}),
    ("DISPLAY_NAME_IMPERSONATION", "high", 0.68, target("other.com", 0.49), free | target("acme.com", 0.49)),
    ("DISPLAY_NAME_IS_FOREIGN_ADDRESS", "high", 0.78, {"from_display": "boss@other.com"}, {"from_display": "mia@acme.com"}),
    ("HOMOGLYPH_DOMAIN", "critical", 0.90, fact(trick="mixed_script"), fact()),
    ("LOOKALIKE_DOMAIN_VISUAL", "critical", 0.90, near("visual"), near("typo")),
    ("LOOKALIKE_DOMAIN_VISUAL", "critical", 0.60, near("visual", 0.5), fact()),
    ("LOOKALIKE_DOMAIN_TYPO", "high", 0.80, near("typo"), near("cousin")),
    ("LOOKALIKE_DOMAIN_TLD_SWAP", "high", 0.72, near("tld_swap"), near("typo")),
    ("LOOKALIKE_DOMAIN_COUSIN", "high", 0.68, near("cousin"), near("typo", host="elsewhere.com")),
    ("NEWLY_REGISTERED_DOMAIN", "high", 0.72, ago(days=7, hours=23), ago(days=61)),
    ("NEWLY_REGISTERED_DOMAIN", "high", 0.62, ago(days=8), ago(days=61)),
    ("NEWLY_REGISTERED_DOMAIN", "medium", 0.40, ago(days=60), {}),
    ("FIRST_CONTACT", "info", 0.15, {"contact": {"inbound_count": 1, "outbound_count": 0}}, {"contact": {"inbound_count": 1, "outbound_count": 1}}),
    ("FIRST_CONTACT", "info", 0.15, {"contact": None}, {}),
    ("ESTABLISHED_CORRESPONDENT", "info", 0.55, {"contact": {"inbound_count": 1, "outbound_count": 1}}, {"contact": {"inbound_count": 9, "outbound_count": 0}}),
    ("RECURRING_SENDER", "info", 0.30, {"contact": {"inbound_count": 5, "outbound_count": 0}}, {"contact": {"inbound_count": 4, "outbound_count": 0}}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "low", 0.26, novel(1), profiled()),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "medium", 0.50, novel(2), novel(2, samples=11)),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "high", 0.74, novel(3), novel(3) | {"from_addr": "noreply@acme.com"}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "critical", 0.86, novel(4), novel(4) | {"contact": {"inbound_count": 15, "outbound_count": 0}}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "high", 0.70, novel(4, samples=18), {}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "medium", 0.45, novel(4, samples=17), {}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "critical", 0.92, novel(3, in_reply_to="x@y"), {}),
    ("TECHNICAL_FINGERPRINT_MISMATCH", "high", 0.68, novel(2, in_reply_to="x@y"), {}),
    ("WRITING_STYLE_MISMATCH", "high", 0.72, styled(0.69), styled(0.71)),
    ("WRITING_STYLE_UNUSUAL", "medium", 0.42, styled(0.71), styled(0.79)),
    ("WRITING_STYLE_UNUSUAL", "medium", 0.42, styled(0.77), styled(0.77, words=11)),
    ("WRITING_STYLE_MATCH", "info", 0.45, styled(0.83), styled(0.81)),
    ("UNFAMILIAR_GREETING", "low", 0.30, styled(0.8, greeting="dear"), styled(0.8)),
    ("UNFAMILIAR_GREETING", "low", 0.30, styled(0.8, greeting="dear", greetings={"hi": 4}), styled(0.8, greeting="dear", greetings={"hi": 3})),
    ("FIRST_EVER_ATTACHMENT", "medium", 0.40, attached("a.pdf", "application/pdf") | profiled(relationship={"sent_attachments": 0}), attached("a.pdf", "application/pdf") | profiled(relationship={"sent_attachments": 0, "messages": 7})),
    ("FIRST_EVER_LINK", "medium", 0.38, {"link_orgs": ["x.com"]} | profiled(relationship={"sent_links": 0}), {"link_orgs": ["x.com"]} | profiled(relationship={"sent_links": 0, "link_orgs": {}})),
    ("UNFAMILIAR_LINK_TARGET", "low", 0.30, {"link_orgs": ["x.com"]} | profiled(), {"link_orgs": ["b.com"]} | profiled()),
    ("URL_DANGEROUS_SCHEME", "high", 0.75, linked("javascript:alert(1)"), linked("https://acme.com/")),
    ("URL_USERINFO_TRICK", "critical", 0.85, linked("https://bank.com@evil.com/"), linked("https://evil.com/@bank.com")),
    ("URL_ANCHOR_MISMATCH", "high", 0.74, linked("https://evil.com/", "bank.com"), linked("https://www.bank.com/", "bank.com")),
    ("URL_HOMOGLYPH", "critical", 0.88, linked("https://evil.com/") | fact("evil.com", trick="mixed_script"), linked("https://evil.com/") | fact("evil.com")),
    ("URL_LOOKALIKE_DOMAIN", "high", 0.624, linked("https://acmee.com/") | near("typo", 0.8, "acmee.com"), linked("https://acmee.com/", has_references=False) | near("typo", 0.8, "acmee.com")),
    ("URL_LOOKALIKE_DOMAIN", "high", 0.78, linked("https://acmee.com/") | near("typo", 1.0, "acmee.com"), linked("https://acmee.com/") | near("typo", 1.0, "acmee.com", known=True)),
    ("URL_BRAND_IN_SUBDOMAIN", "high", 0.76, linked("https://bank.evil.com/") | fact("bank.evil.com", brand="bank.com"), linked("https://bank.evil.com/") | fact("bank.evil.com")),
    ("URL_IP_HOST", "high", 0.62, linked("http://203.0.113.5/x"), linked("http://203.0.113.5.com/x")),
    ("URL_OPEN_REDIRECT", "medium", 0.52, linked("https://a.com/?url=https://evil.com/"), linked("https://a.com/?url=https://www.a.com/")),
    ("URL_SHORTENER", "low", 0.32, linked("https://bit.ly/x"), linked("https://bitly.example/x")),
    ("URL_FREE_HOSTING", "medium", 0.45, linked("https://x.github.io/"), linked("https://github.io.evil.com/")),
    ("URL_CREDENTIAL_PATH", "medium", 0.48, linked("https://evil.com/login/verify"), linked("https://evil.com/login")),
    ("URL_NONSTANDARD_PORT", "low", 0.34, linked("https://evil.com:8081/"), linked("https://evil.com:443/")),
    ("HTML_CREDENTIAL_FORM", "critical", 0.90, form(password=True), form()),
    ("HTML_FORM_OFFSITE", "high", 0.68, form(action="https://evil.com/x"), form(action="https://www.acme.com/x")),
    ("HTML_HIDDEN_TEXT", "medium", 0.46, page(hidden_text="h" * 1500), page(hidden_text="h" * 1499)),
    ("HTML_HIDDEN_TEXT", "medium", 0.46, page(hidden_text="h" * 1501, visible_text="v" * 1000), page(hidden_text="h" * 1500, visible_text="v" * 1000)),
    ("HTML_IMAGE_ONLY", "medium", 0.44, page(images=image(), visible_text="v" * 59) | {"body_text": "b" * 99}, page(images=image(), visible_text="v" * 60) | {"body_text": "b" * 99}),
    ("HTML_IMAGE_ONLY", "medium", 0.44, page(images=image(), visible_text="") | {"body_text": ""}, page(images=image(pixel=True), visible_text="") | {"body_text": ""}),
    ("HTML_META_REFRESH", "medium", 0.50, page(meta_refresh="https://x.com"), page(meta_refresh="")),
    ("ATTACHMENT_RLO_FILENAME", "critical", 0.95, attached("bill‮fdp.exe"), attached("bill.pdf", "application/pdf")),
    ("ATTACHMENT_DOUBLE_EXTENSION", "critical", 0.92, attached("bill.pdf.exe"), attached("bill.v2.exe")),
    ("ATTACHMENT_EXECUTABLE", "critical", 0.90, attached("bill.exe"), attached("bill.exe.txt", "text/plain")),
    ("ATTACHMENT_SCRIPT", "critical", 0.88, attached("bill.js"), attached("bill.json")),
    ("ATTACHMENT_CONTAINER", "high", 0.72, attached("bill.iso"), attached("bill.zip")),
    ("ATTACHMENT_MACRO_DOCUMENT", "high", 0.74, attached("bill.docm"), attached("bill.docx")),
    ("ATTACHMENT_HTML", "high", 0.72, attached("bill.html", "text/html"), attached("bill.txt", "text/plain")),
    ("ATTACHMENT_LOCKED_ARCHIVE", "high", 0.74, attached("bill.zip", "application/zip", body_text="The password is 1234"), attached("bill.zip", "application/zip")),
    ("ATTACHMENT_ONENOTE", "high", 0.70, attached("bill.one"), attached("one")),
    ("ATTACHMENT_TYPE_MISMATCH", "medium", 0.48, attached("bill.pdf", "text/html"), attached("bill.pdf", "application/octet-stream")),
    ("QR_UNSCANNED_IMAGE", "info", 0.18, coded(read=False), coded(read=False, thin=False)),
    ("QR_CODE_URL", "high", 0.70, coded("https://evil.com/x"), coded("WIFI:T:WPA;S:net;;")),
    ("QR_CODE_URL", "low", 0.28, coded("https://acme.com/x") | fact("acme.com", known=True), coded("https://acme.com/x", thin=False)),
    ("QR_CODE_PRESENT", "low", 0.30, coded("WIFI:T:WPA;S:net;;"), coded("https://evil.com/x")),
    ("PROMPT_INJECTION_IN_BODY", "critical", 0.85, meant(prompt_injection_attempt=True), meant()),
    ("INTENT_PAYMENT_REDIRECTION", "critical", 0.88, meant("payment_redirection"), meant("extortion")),
    ("INTENT_CREDENTIAL_REQUEST", "critical", 0.85, meant("credential_request"), meant()),
    ("INTENT_MALWARE_DELIVERY", "high", 0.80, meant("malware_delivery"), meant()),
    ("INTENT_AUTHORITY_IMPERSONATION", "high", 0.74, meant("authority_impersonation"), meant()),
    ("INTENT_DATA_REQUEST", "high", 0.66, meant("data_request"), meant()),
    ("INTENT_ADVANCE_FEE", "high", 0.72, meant("advance_fee"), meant()),
    ("INTENT_EXTORTION", "high", 0.78, meant("extortion"), meant()),
    ("INTENT_OFF_CHANNEL_PUSH", "medium", 0.58, meant("off_channel_push"), meant()),
    ("INTENT_OTHER_SUSPICIOUS", "medium", 0.348, meant("other_suspicious", 0.5), meant()),
    ("INTENT_PAYMENT_REDIRECTION", "medium", 0.541, meant("payment_redirection", 0.3), meant()),
    ("INTENT_UNUSUAL_FOR_RELATIONSHIP", "medium", 0.45, meant("extortion", unusual_for_relationship=True), meant(unusual_for_relationship=True)),
    ("INTENT_REQUESTS_SECRECY", "high", 0.62, meant(requests_secrecy=True), meant()),
    ("INTENT_BENIGN", "info", 0.40, meant(confidence=0.7), meant(confidence=0.69)),
    ("INTENT_BENIGN", "info", 0.40, meant(), meant(requests_secrecy=True)),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [{"name": f"{k} {side}"} | BASE | case[3 + (side == "not")] for k, case in enumerate(CASES) for side in ("yes", "not")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("links", F.array_compact(F.transform("sent", lambda x: L.dissect(x["href"], x["anchor"], F.lit("html_anchor")))))
    frame = R.with_orgs(frame)
    out: dict[str, list] = {}
    for layer in (R.protocol(), R.identity(F.col("received_at")), R.habits(), R.content(), R.intent()):
        for r in frame.select("name", layer.alias("f")).collect():
            out.setdefault(r["name"], []).extend((f["code"], f["severity"], round(f["weight"], 6)) for f in r["f"])
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{k}-{c[0]}" for k, c in enumerate(CASES)])
def test_code(found, k):
    code, severity, weight, *_ = CASES[k]
    assert (code, severity, weight) in found[f"{k} yes"], [f for f in found[f"{k} yes"] if f[0] == code]
    assert (code, severity, weight) not in found[f"{k} not"]


def test_no_code_is_left_out():
    assert len({c[0] for c in CASES}) == 76
