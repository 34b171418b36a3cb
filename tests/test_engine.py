"""Mail from bytes to verdicts: parsing, rules, profiles, fusion, synthetic attacks."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from postwarden.functions import domains, links, mail, markup, redaction, style
from postwarden.operators import contacts as G
from postwarden.operators import findings as FI
from postwarden.operators import profiles as P
from postwarden.operators import sync
from postwarden.plans import engine, reports, synth

SPOOF = b"""Received: by mx.example.net with SMTP id q1; Wed, 10 Sep 2025 08:00:01 +0000
Received: from relay.bulk.example (relay.bulk.example. [198.51.100.7]) by mx.example.net with ESMTPS id q0; Wed, 10 Sep 2025 08:00:00 +0000
Authentication-Results: mx.example.net; spf=softfail (no match; really) smtp.mailfrom=x@bulk.example;
 dkim=fail header.d=northwind.example; dmarc=fail (p=REJECT sp=REJECT) header.from=northwind-payroll.com
From: =?utf-8?b?TWlhIEhvbG0=?= <mia.holm@northwind-payroll.com>
Reply-To: mia.holm.office@gmail.com
Return-Path: <bounce@bulk.example>
To: "Me" <me@gmail.com>
Subject: =?utf-8?q?Urgent=3A_new_account?=
Date: Wed, 10 Sep 2025 13:00:00 +0500
Message-ID: <20250910.aa77@relay.bulk.example>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="x"

--x
Content-Type: text/html; charset=utf-8

<p>Pay <a href="http://203.0.113.5:8081/login/verify">northwind.com</a><span style="font-size:0">unseen</span></p>
--x
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="bill.pdf.exe"
Content-Transfer-Encoding: base64

TVqQAAMAAAAEAAAA
--x--
"""
FRIEND = (
    "From: Mia Holm <mia@northwind.com>\r\nTo: me@gmail.com\r\nSubject: lunch\r\nDate: Mon, 1 Sep 2025 10:00:00 +0200\r\nMessage-ID: <abc12{k}@northwind.com>\r\nX-Mailer: Post 4\r\n"
    "Authentication-Results: mx.example.net; dmarc=pass header.from=northwind.com; spf=pass; dkim=pass header.d=northwind.com\r\n"
    "Received: from mail.northwind.com (x [192.0.2.4]) by mx.example.net; Mon, 1 Sep 2025 10:00:00 +0200\r\n\r\n"
    "Hi,\r\n\r\nshall we meet at noon by the river, number {k}? The menu is at http://northwind.com/menu and it is good today.\r\n\r\nThanks\r\n"
)
SENT = b"From: me@gmail.com\r\nTo: Mia <mia@northwind.com>\r\nSubject: re\r\n\r\nyes\r\n"


@pytest.fixture(scope="module")
def box(spark):
    rows = [(1, f"l{k}", ["INBOX"], dt.datetime(2025, 8, 1 + k), bytearray(FRIEND.format(k=k).encode())) for k in range(14)]
    rows += [(1, "s1", ["SENT"], dt.datetime(2025, 8, 20), bytearray(SENT)), (1, "x1", ["INBOX"], dt.datetime(2025, 9, 10), bytearray(SPOOF))]
    raw = spark.createDataFrame(rows, "account_id long, gmail_id string, label_ids array<string>, received_at timestamp, raw binary")
    messages = engine.messages(raw).persist()
    people = G.contacts(G.touches(messages)).persist()
    return {"mail": messages, "people": people, "accounts": spark.createDataFrame([(1, "me@gmail.com")], "account_id long, email string")}


@pytest.fixture(scope="module")
def verdicts(box):
    found = engine.analyze(box["mail"], box["people"], box["accounts"], P.build(engine.views(box["mail"]))).collect()
    return {r["gmail_id"]: r for r in found}


def codes(row):
    return [f["code"] for f in row["findings"]]


def test_parser_reads_a_spoof():
    m = mail.parse(SPOOF)
    assert (m["from_addr"], m["from_display"], m["subject"]) == ("mia.holm@northwind-payroll.com", "Mia Holm", "Urgent: new account")
    assert (m["auth"]["spf"], m["auth"]["dkim"], m["auth"]["dmarc"], m["auth"]["dkim_domain"]) == ("softfail", "fail", "fail", "northwind.example")
    assert m["hops"][1]["from_ip"] == "198.51.100.7" and m["tz_offset_min"] == 300 and m["mime_signature"] == "multipart/mixed(text/html,application/octet-stream)"
    assert m["attachments"][0]["filename"] == "bill.pdf.exe" and m["attachments"][0]["size_bytes"] == 12


@pytest.mark.parametrize("junk", [None, b"", b"no mail at all", b"From: \xff\xfe<<>>\r\n\r\n", b"Subject: =?nope?b?!!?=\r\n\r\nx", b"Content-Type: multipart/mixed; boundary=\r\n\r\n--"])
def test_parser_never_fails(junk):
    assert isinstance(mail.parse(junk)["from_addr"], str)


def test_contacts_and_trust(box):
    rows = {r["canonical_email"]: r for r in box["people"].withColumn("trust", G.trust()).collect()}
    assert (rows["mia@northwind.com"]["inbound_count"], rows["mia@northwind.com"]["outbound_count"]) == (14, 1)
    assert rows["mia@northwind.com"]["trust"] == 0.7


def test_spoof_is_dangerous(verdicts):
    row = verdicts["x1"]
    assert row["tier"] == "danger" and row["score"] == 0.97
    assert {"DMARC_FAIL_ENFORCED", "REPLY_TO_FREEMAIL", "DISPLAY_NAME_IMPERSONATION", "LOOKALIKE_DOMAIN_COUSIN", "URL_IP_HOST", "URL_ANCHOR_MISMATCH", "URL_NONSTANDARD_PORT", "ATTACHMENT_DOUBLE_EXTENSION"} <= set(codes(row))


def test_friends_are_safe_and_sent_mail_is_left_out(verdicts):
    assert "s1" not in verdicts and all(verdicts[f"l{k}"]["tier"] == "safe" for k in range(14))
    assert "DMARC_PASS" in codes(verdicts["l0"]) and "WRITING_STYLE_MATCH" in codes(verdicts["l0"])


def test_attacks_are_found(box):
    found = reports.evaluate(box["mail"], box["people"], box["accounts"])
    kinds = {r["transform"]: r for r in found["by_transform"].collect()}
    assert set(kinds) == set(synth.LAYERS)
    assert found["overall"].first()["recall"] >= 0.7
    steps = found["ablation"].collect()
    assert [r["upto"] for r in steps] == [0, 1, 2, 3] and steps[0]["tp"] <= steps[3]["tp"]


def test_attacks_repeat(box):
    src = box["mail"].select("gmail_id", "from_addr", "from_display", "subject", "body_text", F.lit("me@gmail.com").alias("to_addr"), "x_mailer", F.col("rfc822_message_id").alias("message_id"))
    once, again = (sorted(map(str, synth.attacks(src).collect())) for _ in range(2))
    assert once == again and len(once) > 0


def fused(spark, *fs):
    rows = spark.range(1).select(FI.gathered(*fs).alias("findings"))
    return FI.with_verdict(rows).first()


def test_fusion_values(spark):
    risk = lambda w, s="high", layer=1: FI.finding("R", layer, s, w, "r")
    assert fused(spark, risk(0.85, "critical"), risk(0.15, "info"))["score"] == 0.8725
    assert fused(spark, FI.finding("M", 0, "info", 0.6, "m", scope=[0]), risk(0.7, "high", 0), risk(0.15, "info"))["score"] == pytest.approx(0.59625, abs=1e-4)
    hard = fused(spark, risk(0.1), FI.finding("H", 0, "critical", 0.9, "h", hard="danger"))
    assert (hard["score"], hard["tier"], hard["headline"]) == (0.97, "danger", "h")
    assert fused(spark, FI.finding("M", 0, "info", 0.6, "m", scope=[0]))["headline"] == "m"


def test_intents_join_only_doubtful_messages(spark, box):
    answers = "prompt_sha256 string, intent struct<intent: string, confidence: double, prompt_injection_attempt: boolean, requests_secrecy: boolean, unusual_for_relationship: boolean, one_line_reason: string>"
    rows = spark.range(2).select(F.col("id").alias("message_id"), FI.gathered(FI.finding("R", 1, "medium", F.when(F.col("id") == 0, 0.4).otherwise(0.9), "r")).alias("findings"))
    judged = FI.with_verdict(rows)
    prompts = spark.createDataFrame([(0, "h0"), (1, "h1")], "message_id long, prompt_sha256 string")
    kept = spark.createDataFrame([("h0", ("payment_redirection", 1.0, False, True, False, "why")), ("h1", ("benign", 0.9, False, False, False, ""))], answers)
    out = {r["message_id"]: r for r in engine.with_intents(judged, prompts, kept).collect()}
    assert codes(out[0]) == ["R", "INTENT_PAYMENT_REDIRECTION", "INTENT_REQUESTS_SECRECY"] and codes(out[1]) == ["R"]


@pytest.mark.parametrize("a, b, kind", [("paypa1.com", "paypal.com", "visual"), ("gmial.com", "gmail.org", "typo"), ("acme.net", "acme.com", "tld_swap"), ("secure-acme.com", "acme.com", "cousin"), ("abc.net", "abc.com", None), ("unrelated.com", "acme.com", None)])
def test_imitations(spark, a, b, kind):
    hosts = spark.createDataFrame([(1, a)], "account_id long, host string")
    refs = spark.createDataFrame([(1, b, 1.0)], "account_id long, org string, trust double")
    found = G.imitations(hosts, refs).collect()
    assert [r["kind"] for r in found] == ([kind] if kind else [])


@pytest.mark.parametrize("a, b, d", [("gmial", "gmail", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0), ("microsoft", "mircosfot", 2), ("a", "abcdefgh", 5)])
def test_edits(a, b, d):
    assert domains.edits(a, b) == d


def test_unicode():
    assert domains.unicode_trick("аpple.com") == "mixed_script" and domains.unicode_trick("apple.com") is None
    assert domains.unicode_trick("xn--mnchen-3ya.de") == "punycode"


@pytest.mark.parametrize("html, shown, unseen", [
    ("<p>a<span style='display:none'>b</span>c</p>", "ac", "b"), ("<div style='font-size:0'><p style='font-size:14px'>x</p></div>", "x", ""), ("<div hidden>q", "", "q"), ("<title>t</title><link rel=x>y", "y", ""),
    ("<td>z</div></div>w", "zw", ""), ("<img style='display:none'>all after", "", "all after"),
])
def test_html(html, shown, unseen):
    page = markup.read(html)
    assert (page["visible_text"], page["hidden_text"]) == (shown, unseen)


@pytest.mark.parametrize("secret", ["GB29 NWBK 6016 1331 9268 19", "4111 1111 1111 1111", "12-34-56", "account: 12345678", "swift ABCDEFGH", "+44 20 7946 0958", "0x52908400098527886E0F7030069857D2E4169EE7", "https://x.com/reset?token=a1b2c3d4e5"])
def test_redaction_hides(secret):
    text = f"Please see {secret}. Until noon"
    assert not redaction.leaks(text, redaction.redact(text)) and "noon" in redaction.redact(text)


@pytest.mark.parametrize("prose", ["Can we meet on Tuesday at 3pm?", "account details attached", "the total is 450 pounds", "room 12 on floor 4"])
def test_redaction_leaves_prose(prose):
    assert redaction.redact(prose) == prose


def test_style():
    assert len(style.vector("Hi Bo,\nhow are you?\n> old")) == style.LENGTH and style.greeting("Dear all,\nx") == "dear" and style.signoff("x\n\nBest regards,\nBo") == "best regards"
    assert style.own_words("a\n> b\nc") == "a"


def test_id_shape(spark):
    row = spark.createDataFrame([("CAF+abc123@Mail.Example.COM",), (None,), ("x1",)], "m string").select(style.id_shape("m").alias("s")).collect()
    assert [r["s"] for r in row] == ["a+a9@mail.example.com", "", "a9@"]


def test_net_changes(spark):
    rows = [(1, "a", "added", None), (2, "a", "deleted", None), (3, "b", "labels", ["X"]), (5, "b", "labels", ["Z"]), (4, "b", "labels", ["Y"]), (6, "c", "added", None)]
    net = sync.net_changes(spark.createDataFrame(rows, "seq long, gmail_id string, kind string, label_ids array<string>"))
    assert {r["gmail_id"]: (r["action"], r["label_ids"]) for r in net.collect()} == {"a": ("delete", None), "b": ("relabel", ["Z"]), "c": ("insert", None)}


def test_offsets_move_forward():
    offset = None
    for seen in ("500", "400", "900", None):
        offset = sync.advanced(offset, seen)
    assert offset == "900" and sync.advanced("5", "x") == "x"


def test_stream_of_changes(spark, tmp_path, box):
    from postwarden.sources.tables import Tables
    from postwarden.streaming.sync import follow

    tables = Tables(spark, str(tmp_path / "tables"))
    known = box["mail"].where("gmail_id in ('l0', 'l1')").select("account_id", "gmail_id", "labels", "received_at")
    tables.write("messages", known, batch=0)
    schema = "seq long, gmail_id string, kind string, label_ids array<string>"
    spark.createDataFrame([(1, "l0", "deleted", None), (2, "l1", "labels", ["READ"]), (3, "l5", "added", None)], schema).write.parquet(str(tmp_path / "feed"))
    everything = box["mail"].select("account_id", "gmail_id", "labels", "received_at")
    for _ in range(2):  # a second run finds nothing new
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        follow(feed, lambda ids: everything.join(ids, "gmail_id", "left_semi"), tables, str(tmp_path / "offsets")).awaitTermination()
    assert {r["gmail_id"]: r["labels"] for r in tables.read("messages").collect()} == {"l1": ["READ"], "l5": ["INBOX"]}


def test_scores_do_not_depend_on_partitions(spark, box):
    people, accounts = box["people"], box["accounts"]
    few = box["mail"].where("gmail_id in ('x1', 'l3')")
    scores = [sorted((r["gmail_id"], r["score"]) for r in engine.analyze(few.repartition(n), people, accounts).collect()) for n in (1, 3)]
    assert scores[0] == scores[1]


def test_plan_has_no_cartesian_product_and_reads_html_once(box):
    plan = engine.analyze(box["mail"], box["people"], box["accounts"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unread_pictures_are_told(spark, box):
    picture = b"From: a@b.example\r\nContent-Type: image/png; name=x.png\r\nContent-Transfer-Encoding: base64\r\n\r\niVBORw0KGgo=\r\n"
    raw = spark.createDataFrame([(1, "p", ["INBOX"], dt.datetime(2025, 9, 1), bytearray(picture))], "account_id long, gmail_id string, label_ids array<string>, received_at timestamp, raw binary")
    view = engine.with_codes(engine.views(engine.messages(raw)), raw)
    found = engine.judged(engine.with_context(view, box["people"], box["accounts"])).first()
    assert "QR_UNSCANNED_IMAGE" in codes(found)


def test_registration_work_list(spark, box):
    intel = spark.createDataFrame([("northwind.com", dt.datetime(2025, 1, 1), None, dt.datetime(2010, 1, 1))], "domain string, checked_at timestamp, error string, created_at timestamp")
    due = sync.domains_to_check(box["mail"].where("not array_contains(labels, 'SENT')"), intel, "2025-01-05")
    assert [r["domain"] for r in due.collect()] == ["northwind-payroll.com"]


def test_pictures_are_read_in_the_whole_plan(spark, box, monkeypatch):
    """A reader that finds a link in the picture of a message without words: the code and the link's own findings."""
    from postwarden.plans import engine as E

    picture = b"From: a@b.example\r\nContent-Type: image/png; name=x.png\r\nContent-Transfer-Encoding: base64\r\n\r\niVBORw0KGgo=\r\n"
    raw = spark.createDataFrame([(1, "p", ["INBOX"], dt.datetime(2025, 9, 1), bytearray(picture))], "account_id long, gmail_id string, label_ids array<string>, received_at timestamp, raw binary")
    monkeypatch.setattr(E, "payloads_of", lambda c: F.when(F.col(c).isNotNull(), F.array(F.lit("http://203.0.113.5/x"))))
    found = codes(E.analyze(E.messages(raw), box["people"], box["accounts"], raw=raw).first())
    assert {"QR_CODE_URL", "URL_IP_HOST"} <= set(found) and "QR_UNSCANNED_IMAGE" not in found


def test_ip_hosts(spark):
    """Hosts of colons and hex digits are addresses exactly where the standard library reads them as such."""
    rng = random.Random(6)
    groups = ["1", "ab", "ffff", "0", "", "12345", "192.0.2.1", "300.1.1.1", "g"]
    made = {":".join(rng.choices(groups, [6, 4, 4, 4, 3, 0.5, 1, 0.5, 0.3], k=rng.randint(2, 10))) for _ in range(3000)}
    hosts = sorted(made | {"::", ":::", "::1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:192.0.2.1", "a.example", ""})

    def valid(host: str) -> bool:
        try:
            return bool(ipaddress.ip_address(host))
        except ValueError:
            return False

    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", links.is_ip(F.col("h")).alias("ip")).collect()
    assert {r.h for r in rows if r.ip} == {h for h in hosts if valid(h)}


def test_redaction_searches_only_where_it_can_match():
    """A step's mark stands in every match of it: leaving the check out changes nothing."""
    rng = random.Random(7)
    parts = ["https://u@h.example/a/b/c", "0x" + "aF" * 20, "bc1" + "q" * 30, "GB29 NWBK 6016 1331", "4111 1111 1111 1111", "20-30-40", "account no: ABCDE9", "swift ABCDEFGH",
             "me@x.example", "+44 20 7946 0000", "1234567", "\u0663\u0664\u0665\u0666\u0667\u0668", "plain words", "a:b;c:d;e:f;", "<p>", ","]
    for _ in range(500):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 5)))
        slow = " ".join(redaction.CSS.sub(" ", redaction.MARKUP.sub(" ", text)).split())
        for pattern, put, _ in redaction.STEPS:
            slow = pattern.sub(put, slow)
        assert redaction.redact(text) == slow
