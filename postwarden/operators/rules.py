"""The detectors, layer by layer, as Column expressions over one wide message row.

The row has the message's fields and what ``plans.engine`` joined to it: contact, target,
addresses, intel, facts (by host), profile, page (HTML), links and the style of its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filenames as N
from ..functions import links as L
from ..functions.addresses import canonical_address, domain_of, emails_in, local_of
from ..functions.domains import is_freemail, org_domain, same_org
from ..lexicons import AUTOMATED, DANGEROUS_SCHEMES, DELEGATED_SIGNERS, FAIL, INTENTS, SOFT
from . import profiles as P
from .findings import finding, gathered

C = F.col
BAND = (0.20, 0.80)


def say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _status(name: str) -> Column:
    return F.lower(F.coalesce(C(f"auth.{name}"), F.lit("")))


def dmarc_policy(raw: Column) -> Column:
    """The policy that the domain's owner published, as the receiver quotes it."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "), r"(?i)dmarc\s*=\s*\w+[^;]*?\bp\s*=\s*(\w+)", 1))


def with_orgs(rows: DataFrame) -> DataFrame:
    """The organisations that the rules compare, once each."""
    reply, bounce = domain_of("reply_to_addr"), domain_of("return_path_addr")
    return rows.withColumns({
        "org": org_domain("from_domain"), "signer_org": org_domain(C("auth.dkim_domain")), "reply_org": org_domain(reply), "bounce_org": org_domain(bounce),
        "from_free": is_freemail("from_domain"), "reply_free": is_freemail(reply),
    })


def protocol() -> Column:
    """Layer 0: what the receiver's authentication says, and where replies and bounces go."""
    spf, dkim, dmarc = _status("spf"), _status("dkim"), _status("dmarc")
    raw, org = F.coalesce(C("auth.raw"), F.lit("")), C("org")
    checked, policy = raw != "", dmarc_policy(raw)
    failed, undecided = dmarc.isin(*FAIL), ~dmarc.isin("pass", *FAIL)
    strict = policy.isin("reject", "quarantine")
    signer, reply, bounce = C("signer_org"), C("reply_org"), C("bounce_org")
    told = {"spf": spf, "dkim": dkim, "dmarc": dmarc}
    passed, forwarded = checked & (dmarc == "pass"), F.coalesce(C("auth.arc_present"), F.lit(False))
    diverted = (reply != "") & (org != "") & (reply != org)
    away = {"from": org, "to": reply}
    rules = [
        (~checked, finding("AUTH_RESULTS_MISSING", 0, "low", 0.20, "The receiving server recorded no authentication for this message.")),
        (checked & failed & strict, finding("DMARC_FAIL_ENFORCED", 0, "critical", 0.95, say("The owner of ", org, " asks that mail like this be refused: it is not theirs."), told | {"policy": policy}, hard="danger")),
        (checked & failed & ~strict, finding("DMARC_FAIL", 0, "high", 0.75, say("This message fails the checks of ", org, "."), told)),
        (checked & (dmarc.isin(*SOFT) | (dmarc == "")) & (spf != "pass") & (dkim != "pass"), finding("UNAUTHENTICATED_SENDER", 0, "medium", 0.50, "Nothing proves that the sender's domain sent this message.", told)),
        (checked & undecided & spf.isin(*FAIL), finding("SPF_FAIL", 0, "medium", 0.50, "The sending server is not one that the domain names.", told)),
        (checked & undecided & spf.isin(*SOFT) & (spf != "none"), finding("SPF_SOFTFAIL", 0, "low", 0.28, "The sending server is probably not one that the domain names.", told)),
        (checked & undecided & dkim.isin(*FAIL), finding("DKIM_FAIL", 0, "medium", 0.45, "The message's signature is broken.", told)),
        (checked & (dkim == "pass") & (signer != "") & (org != "") & (dmarc != "pass") & ~signer.isin(*DELEGATED_SIGNERS) & (signer != org),
         finding("DKIM_UNALIGNED", 0, "medium", 0.50, say("It is signed by ", signer, ", not by ", org, "."), {"signer": signer, "from": org})),
        (checked & forwarded & (dmarc != "pass") & (spf.isin(*FAIL, *SOFT) | dkim.isin(*FAIL)), finding("ARC_FORWARDED", 0, "info", 0.55, "A forwarder vouches for it, which explains failed checks.", told, scope=[0])),
        (passed, finding("DMARC_PASS", 0, "info", 0.60, say("The message is proven to come from ", org, "."), told, scope=[0])),
        (diverted & C("reply_free") & ~C("from_free"), finding("REPLY_TO_FREEMAIL", 0, "high", 0.70, say("Replies would go to a personal mailbox at ", reply, "."), away)),
        (diverted & ~(C("reply_free") & ~C("from_free")), finding("REPLY_TO_OFFDOMAIN", 0, "medium", 0.45, say("Replies would go to ", reply, "."), away)),
        ((bounce != "") & (org != "") & (bounce != org) & ~passed, finding("RETURN_PATH_OFFDOMAIN", 0, "low", 0.30, say("Bounces go to ", bounce, "."), {"from": org, "to": bounce})),
    ]
    return gathered(*[F.when(when, what) for when, what in rules])


def identity(as_of: Column) -> Column:
    """Layer 1: whether the sender is who the name and domain suggest. ``as_of`` is the time domain ages are taken at."""
    sender, target, near = C("canonical_email"), C("target"), C("facts")[C("from_domain")]["near"]
    inbound, outbound = F.coalesce(C("contact.inbound_count"), F.lit(0)), F.coalesce(C("contact.outbound_count"), F.lit(0))
    posing = target.isNotNull()
    private = C("from_free") & ~is_freemail(target["their_domain"])
    who = {"name": C("from_display"), "known": F.array_join("addresses", ", "), "trust": target["trust"]}
    shown = F.get(F.filter(emails_in("from_display"), lambda e: canonical_address(e) != sender), F.lit(0))
    trick = C("facts")[C("from_domain")]["trick"]
    kinds = {"visual": ("VISUAL", "critical", 0.90), "typo": ("TYPO", "high", 0.80), "tld_swap": ("TLD_SWAP", "high", 0.72), "cousin": ("COUSIN", "high", 0.68)}
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("intel.created_at")) / 86_400_000_000)
    young = F.when(age <= 7, F.struct(F.lit("high").alias("s"), F.lit(0.72).alias("w"))).when(age <= 30, F.struct(F.lit("high").alias("s"), F.lit(0.62).alias("w"))).when(age <= 60, F.struct(F.lit("medium").alias("s"), F.lit(0.40).alias("w")))
    rules = [
        (posing & private, finding("DISPLAY_NAME_IMPERSONATION_FREEMAIL", 1, "critical", 0.88, say("The name is that of ", target["address"], ", but it comes from a personal mailbox."), who)),
        (posing & ~private & (target["trust"] >= 0.5), finding("DISPLAY_NAME_IMPERSONATION", 1, "critical", 0.85, say("The name is that of ", target["address"], ", whom you know under another address."), who)),
        (posing & ~private & (target["trust"] < 0.5), finding("DISPLAY_NAME_IMPERSONATION", 1, "high", 0.68, say("The name is that of ", target["address"], "."), who)),
        (shown.isNotNull(), finding("DISPLAY_NAME_IS_FOREIGN_ADDRESS", 1, "high", 0.78, say("The name shows the address ", shown, ", but it comes from ", sender, "."), {"shown": shown})),
        (trick.isNotNull(), finding("HOMOGLYPH_DOMAIN", 1, "critical", 0.90, say("The domain ", C("from_domain"), " uses letters of another alphabet."), {"trick": trick})),
        *[(near["kind"] == kind, finding(f"LOOKALIKE_DOMAIN_{name}", 1, severity, _round(base * near["confidence"] + (1 - near["confidence"]) * 0.3), say(C("from_domain"), " looks like ", near["known"], "."), {"known": near["known"], "kind": near["kind"]}))
          for kind, (name, severity, base) in kinds.items()],
        (young.isNotNull(), finding("NEWLY_REGISTERED_DOMAIN", 1, young["s"], young["w"], say("The domain is ", age, " days old."), {"days": age})),
        (inbound + outbound <= 1, finding("FIRST_CONTACT", 1, "info", 0.15, "You have no history with this sender.")),
        ((inbound + outbound > 1) & (outbound > 0), finding("ESTABLISHED_CORRESPONDENT", 1, "info", 0.55, "You have written to this sender before.", {"sent": outbound, "received": inbound}, scope=[1])),
        ((inbound + outbound > 1) & (outbound == 0) & (inbound >= 5), finding("RECURRING_SENDER", 1, "info", 0.30, "This sender writes to you regularly.", {"received": inbound}, scope=[1])),
    ]
    return F.when(F.coalesce("from_addr", F.lit("")) == "", F.array().cast(gathered_type())).otherwise(gathered(*[F.when(when, what) for when, what in rules]))


def gathered_type() -> str:
    from .findings import FINDING

    return f"array<{FINDING}>"


def _round(x: Column, digits: int = 3) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def is_automated() -> Column:
    machine = local_of("from_addr").rlike("|".join(AUTOMATED))
    return machine | ((F.coalesce(C("contact.outbound_count"), F.lit(0)) == 0) & (F.coalesce(C("contact.inbound_count"), F.lit(0)) >= 15))


def habits() -> Column:
    """Layer 2: whether a known person's mail looks, reads and behaves as before."""
    p, tech, rel, own = C("profile"), C("profile.technical"), C("profile.relationship"), C("profile.style")
    values = P.technical_values()
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), values[d].alias("value"), tech[d].alias("known")) for d in P.COMPARED])
    compared = F.filter(pairs, lambda x: x["value"].isNotNull() & (F.size(x["known"]) > 0))
    novel = F.filter(compared, lambda x: ~P.is_known(x["known"], x["value"]))
    n, deep, mid = F.size(novel), p["samples"], F.coalesce("in_reply_to", F.lit("")) != ""
    level = F.when(n >= 4, 4).when(n == 3, 3).when(n == 2, 2).otherwise(1)
    weight = F.when(n >= 4, 0.86).when(n == 3, 0.74).when(n == 2, 0.50).otherwise(0.26)
    level = F.when(deep >= 25, level).when(deep >= 18, F.least(level, F.lit(3))).otherwise(F.least(level, F.lit(2)))
    weight = F.when(deep >= 25, weight).when(deep >= 18, F.least(weight, F.lit(0.70))).otherwise(F.least(weight, F.lit(0.45)))
    level = F.when(mid & (n >= 3), 4).when(mid & (n == 2), 3).otherwise(level)
    weight = F.when(mid & (n >= 2), F.least(F.lit(0.92), weight + 0.18)).otherwise(weight)
    severity = F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), level)
    technical = (p["samples"] >= P.LEAST_SAMPLES) & (F.size(compared) >= 3) & (n >= 1)
    dims = F.array_join(F.transform(novel, lambda x: x["dim"]), ", ")
    words, z = C("body_style.words"), P.z_score(own, C("body_style.vector"), C("body_style.words"))
    stylish = own.isNotNull() & (own["samples"] >= P.LEAST_SAMPLES) & (words >= P.LEAST_WORDS)
    greets, hello = own["greetings"], C("body_style.greeting")
    many = F.aggregate(F.map_values(greets), F.lit(0).cast("bigint"), lambda a, x: a + x) >= 4
    longtime, attached = rel["messages"] >= 8, F.exists("attachments", lambda a: ~a["is_inline"])
    unseen = F.array_sort(F.array_except("link_orgs", F.map_keys(rel["link_orgs"])))
    corpus = (F.size(rel["link_orgs"]) > 0) | (rel["sent_links"] > 0)
    spoke = {"z": _round(z, 2), "samples": own["samples"]}
    rules = [
        (technical, finding("TECHNICAL_FINGERPRINT_MISMATCH", 2, severity, weight, say("It was not made the way this sender's mail is made (", dims, ")."), {"novel": dims, "compared": F.size(compared), "mid_thread": mid})),
        (stylish & (z >= 2.0), finding("WRITING_STYLE_MISMATCH", 2, "high", 0.72, "This does not read like this sender.", spoke)),
        (stylish & (z >= 1.2) & (z < 2.0), finding("WRITING_STYLE_UNUSUAL", 2, "medium", 0.42, "The style is unusual for this sender.", spoke)),
        (stylish & (z <= 0.8), finding("WRITING_STYLE_MATCH", 2, "info", 0.45, "It reads like this sender's other mail.", spoke, scope=[1, 2])),
        (stylish & (hello != "") & many & ~F.coalesce(F.array_contains(F.map_keys(greets), hello), F.lit(False)), finding("UNFAMILIAR_GREETING", 2, "low", 0.30, say("This sender has never begun with ", hello, "."), {"greeting": hello})),
        (longtime & attached & (rel["sent_attachments"] == 0), finding("FIRST_EVER_ATTACHMENT", 2, "medium", 0.40, "This sender has never attached a file before.", {"history": rel["messages"]})),
        (longtime & (F.size("link_orgs") > 0) & corpus & (rel["sent_links"] == 0), finding("FIRST_EVER_LINK", 2, "medium", 0.38, "This sender has never sent a link before.", {"history": rel["messages"]})),
        (longtime & (rel["sent_links"] > 0) & (F.size(rel["link_orgs"]) >= 3) & (F.size(unseen) > 0), finding("UNFAMILIAR_LINK_TARGET", 2, "low", 0.30, say("It links to ", F.get(unseen, F.lit(0)), ", which is new for this sender."), {"unseen": F.array_join(F.slice(unseen, 1, 5), ", ")})),
    ]
    return F.when(p.isNull() | is_automated(), F.array().cast(gathered_type())).otherwise(gathered(*[F.when(when, what) for when, what in rules]))


def link_rules(link: Column, facts: Column, verified: Column, references: Column) -> list[tuple[str, Column, Column]]:
    """(code, condition, finding) of one link, in the order in which they are told."""
    web = L.is_web(link) & (link["host"] != "")
    fact = facts[link["host"]]
    known = F.coalesce(fact["known"], F.lit(False))
    tracked = verified & L.is_tracker(link)
    claim, near, inner, free = L.claimed_host(link), fact["near"], L.redirect_target(link), L.free_hosting(link)
    inner_org = org_domain(L.dissect(inner)["host"])
    asked = L.credential_words(link)
    at = {"href": F.substring(link["href"], 1, 120), "host": link["host"]}
    host = link["host"]
    rows = [
        ("URL_DANGEROUS_SCHEME", link["scheme"].isin(*DANGEROUS_SCHEMES), "high", 0.75, say("A link runs code (", link["scheme"], ":) instead of opening a page."), {}),
        ("URL_USERINFO_TRICK", web & (link["userinfo"] != ""), "critical", 0.85, say("A link shows ", F.substring(link["userinfo"], 1, 40), " but opens ", host, "."), {"userinfo": link["userinfo"]}),
        ("URL_ANCHOR_MISMATCH", web & claim.isNotNull() & ~tracked, "high", 0.74, say("A link says ", claim, " but opens ", host, "."), {"claimed": claim}),
        ("URL_HOMOGLYPH", web & fact["trick"].isNotNull(), "critical", 0.88, say("A link's address mixes alphabets: ", host, "."), {"trick": fact["trick"]}),
        ("URL_LOOKALIKE_DOMAIN", web & references & ~known & near.isNotNull(), "high", _round(0.78 * near["confidence"]), say("A link opens ", host, ", which looks like ", near["known"], "."), {"known": near["known"], "kind": near["kind"]}),
        ("URL_BRAND_IN_SUBDOMAIN", web & fact["brand"].isNotNull(), "high", 0.76, say("A link puts ", fact["brand"], " in front of another site: ", host, "."), {"brand": fact["brand"]}),
        ("URL_IP_HOST", web & L.is_ip(host), "high", 0.62, say("A link opens a bare address, ", host, "."), {}),
        ("URL_OPEN_REDIRECT", web & inner.isNotNull() & (F.coalesce(inner_org, F.lit("")) != "") & ~same_org(inner_org, link["org"]) & ~tracked
         & (F.substring_index(inner_org, ".", 1) != F.substring_index(link["org"], ".", 1)), "medium", 0.52, say("A link to ", host, " passes you on to ", inner_org, "."), {"target": inner}),
        ("URL_SHORTENER", web & L.is_shortener(link), "low", 0.32, say("A shortened link (", host, ") hides where it leads."), {}),
        ("URL_FREE_HOSTING", web & free.isNotNull(), "medium", 0.45, say("A link opens a page on ", free, ", where anyone can put one."), {"platform": free}),
        ("URL_CREDENTIAL_PATH", web & ~known & ~tracked & (F.size(asked) >= 2), "medium", 0.48, say("A link to ", host, " looks like a sign-in page."), {"words": F.array_join(asked, ", ")}),
        ("URL_NONSTANDARD_PORT", web & (F.coalesce(link["port"], F.lit(0)) != 0) & ~link["port"].isin(80, 443), "low", 0.34, say("A link uses an unusual port, ", link["port"], "."), {"port": link["port"]}),
    ]
    return [(code, F.coalesce(when, F.lit(False)), finding(code, 3, severity, weight, text, at | more)) for code, when, severity, weight, text, more in rows]


def link_findings(links: Column) -> Column:
    """The first finding of each kind over all links, in the links' order."""
    verified, references = _status("dmarc") == "pass", F.coalesce(C("has_references"), F.lit(False))

    def each(link: Column) -> Column:
        return F.array_compact(F.array(*[F.when(when, what.cast(gathered_type()[6:-1])) for _, when, what in link_rules(link, C("facts"), verified, references)]))

    def firsts(every: Column) -> Column:
        return L.let(F.transform(every, lambda x: x["code"]), lambda codes: F.filter(every, lambda f, i: F.array_position(codes, f["code"]) == i + 1))

    return L.let(F.flatten(F.transform(links, each)), firsts)


def page_findings() -> Column:
    page, text = C("page"), F.length(F.trim(F.coalesce("body_text", F.lit(""))))
    seen, unseen = F.length(page["visible_text"]), F.length(page["hidden_text"])
    pictures = F.filter(page["images"], lambda i: ~i["is_pixel"])

    def form(f: Column) -> Column:
        action = L.dissect(f["action"])
        told = {"action": F.substring(f["action"], 1, 200), "inputs": F.array_join(F.slice(f["inputs"], 1, 8), ", ")}
        away = L.is_web(action) & (action["org"] != "") & (action["org"] != C("org"))
        return F.when(f["has_password"], finding("HTML_CREDENTIAL_FORM", 3, "critical", 0.90, "The message itself asks for a password.", told, hard="danger")).when(
            away, finding("HTML_FORM_OFFSITE", 3, "high", 0.68, say("A form sends what you type to ", action["org"], "."), told)
        )

    first = F.get(F.array_compact(F.transform(page["forms"], form)), F.lit(0))
    return gathered(
        first,
        F.when((unseen >= 1500) & (unseen > 1.5 * seen), finding("HTML_HIDDEN_TEXT", 3, "medium", 0.46, say(unseen, " characters of text are hidden."), {"hidden": unseen, "visible": seen})),
        F.when((F.size(pictures) > 0) & (seen < 60) & (text < 100), finding("HTML_IMAGE_ONLY", 3, "medium", 0.44, "The message is a picture with next to no text.", {"images": F.size(pictures)})),
        F.when(F.coalesce(page["meta_refresh"], F.lit("")) != "", finding("HTML_META_REFRESH", 3, "medium", 0.50, "The message tries to open another page by itself.", {"target": F.substring(page["meta_refresh"], 1, 200)})),
    )


def attachment_findings() -> Column:
    """One finding, or two, for each attachment that has a name or is not inline."""
    locked = N.mentions_password(F.concat_ws(" ", "body_text", "subject"))

    def each(a: Column) -> Column:
        name = F.coalesce(a["filename"], F.lit(""))
        ext, double, wrong = N.extension(name), N.double_extension(name), N.type_mismatch(name, a["content_type"])
        kind, told = N.category(N.extension(name)), {"filename": N.rendered(name), "type": a["content_type"]}
        by_kind = F.lit(None)
        for which, when, code, severity, weight, text in (
            ("executable", True, "ATTACHMENT_EXECUTABLE", "critical", 0.90, "An attachment is a program: "), ("script", True, "ATTACHMENT_SCRIPT", "critical", 0.88, "An attachment is a script: "),
            ("container", True, "ATTACHMENT_CONTAINER", "high", 0.72, "An attachment is a disk image or shortcut: "), ("macro_office", True, "ATTACHMENT_MACRO_DOCUMENT", "high", 0.74, "An attachment is a document with macros: "),
            ("web", True, "ATTACHMENT_HTML", "high", 0.72, "An attachment is a web page: "), ("archive", locked, "ATTACHMENT_LOCKED_ARCHIVE", "high", 0.74, "The message gives the password of an archive: "),
            ("onenote", True, "ATTACHMENT_ONENOTE", "high", 0.70, "An attachment is a notebook that can hold programs: "),
        ):
            found = finding(code, 3, severity, weight, say(text, name), told).cast(gathered_type()[6:-1])
            here = (kind == which) & when if isinstance(when, Column) else kind == which
            by_kind = F.when(here, found).otherwise(by_kind)
        bidi = finding("ATTACHMENT_RLO_FILENAME", 3, "critical", 0.95, say("An attachment's name is written to show as another: ", N.rendered(name)), told, hard="danger")
        twice = finding("ATTACHMENT_DOUBLE_EXTENSION", 3, "critical", 0.92, say("An attachment poses as .", double["decoy"], " but is .", double["real"], "."), told)
        type_ = finding("ATTACHMENT_TYPE_MISMATCH", 3, "medium", 0.48, say("An attachment named .", ext, " is declared as ", wrong, "."), told)
        return (
            F.when(F.coalesce(a["is_inline"], F.lit(False)) & (name == ""), F.array().cast(gathered_type()))
            .when(N.has_bidi(name), gathered(bidi)).when(double.isNotNull(), gathered(twice)).otherwise(gathered(by_kind, F.when(wrong.isNotNull(), type_)))
        )

    return F.flatten(F.transform("attachments", each))


def code_findings() -> Column:
    """Pictures that may hold codes, and the codes that a reader found (``qr_payloads``; null if none looked)."""
    page = C("page")
    inside = F.filter("attachments", lambda a: a["content_type"].startswith("image/"))
    data = F.filter(page["images"], lambda i: i["is_data"] & ~i["is_pixel"])
    thin = (F.length(page["visible_text"]) < 200) & (F.length(F.trim(F.coalesce("body_text", F.lit("")))) < 200)
    asked = ((F.size(inside) > 0) | (F.size(data) > 0)) & thin
    blind = finding("QR_UNSCANNED_IMAGE", 3, "info", 0.18, "A code in its picture could not be read.", {"images": F.greatest(F.size(inside), F.size(data))})

    def payload(p: Column) -> Column:
        link = L.dissect(p)
        web = F.coalesce(L.is_web(link), F.lit(False))
        known = F.coalesce(C("facts")[link["host"]]["known"], F.lit(False))
        opened = finding("QR_CODE_URL", 3, F.when(known, "low").otherwise("high"), F.when(known, 0.28).otherwise(0.70), say("A code in the message opens ", link["host"], "."), {"host": link["host"]})
        other = finding("QR_CODE_PRESENT", 3, "low", 0.30, "The message holds a code that is no link.", {"payload": F.substring(p, 1, 120)})
        return F.when(web, F.concat(gathered(opened), link_findings(F.array(link)))).otherwise(gathered(other))

    read = F.flatten(F.transform(F.slice(F.array_distinct("qr_payloads"), 1, 3), payload))
    return F.when(~asked, F.array().cast(gathered_type())).when(C("qr_payloads").isNull(), gathered(blind)).otherwise(read)


def content() -> Column:
    """Layer 3: links, HTML, attachments and codes."""
    return F.concat(link_findings(C("links")), page_findings(), attachment_findings(), code_findings())


def in_band(score: Column) -> Column:
    return score.between(*BAND)


def intent() -> Column:
    """Layer 4: what a classifier said the message asks for (struct ``intent``; null, or with an error, says nothing)."""
    i = C("intent")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(i["confidence"], F.lit(0.5))))
    kind, reason = F.coalesce(i["intent"], F.lit("benign")), F.trim(F.coalesce(i["one_line_reason"], F.lit("")))
    bad, told = kind != "benign", {"intent": kind, "confidence": sure, "reason": reason}
    flag = lambda name: F.coalesce(i[name], F.lit(False))
    rules = [F.when(flag("prompt_injection_attempt"), finding("PROMPT_INJECTION_IN_BODY", 4, "critical", 0.85, "It holds instructions meant for software that checks mail.", told))]
    for name, (severity, base) in INTENTS.items():
        what = finding(f"INTENT_{name.upper()}", 4, F.when(sure < 0.4, "medium").otherwise(severity), _round(base * (0.45 + 0.55 * sure)), say("Its request is of the kind ", name.replace("_", " "), ". ", reason), told)
        rules.append(F.when(kind == name, what))
    rules.append(F.when(flag("unusual_for_relationship") & bad, finding("INTENT_UNUSUAL_FOR_RELATIONSHIP", 4, "medium", 0.45, "This sender does not normally ask this.", told)))
    rules.append(F.when(flag("requests_secrecy"), finding("INTENT_REQUESTS_SECRECY", 4, "high", 0.62, "It asks you to keep it to yourself.", told)))
    calm = (kind == "benign") & (sure >= 0.7) & ~flag("prompt_injection_attempt") & ~flag("requests_secrecy")
    rules.append(F.when(calm, finding("INTENT_BENIGN", 4, "info", 0.40, "Its request is ordinary.", told, scope=[3, 4])))
    return F.when(i.isNull(), F.array().cast(gathered_type())).otherwise(gathered(*rules))
