"""Links taken apart and judged, as Column expressions that also work inside ``transform``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import CREDENTIAL_WORDS, FREE_HOSTING, REDIRECT_PARAMS, SHORTENERS, TRACKERS
from .domains import org_domain

URL = r"(?i)\b(?:(?:https?|ftp)://[^\s<>\"'\]\)]+|www\.[^\s<>\"'\]\)]+)"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
_HEX = "[0-9a-f]{1,4}"


def _ipv6() -> str:
    """Eight groups of hex digits, or fewer around one ``::``; the last two may be an IPv4 address."""
    forms = [f"(?:{_HEX}:){{7}}{_HEX}", f"(?:{_HEX}:){{6}}{IPV4[1:-1]}"]
    for left in range(8):
        most = 7 - left
        right = [f"(?:{_HEX}:){{0,{most - 1}}}{_HEX}"] * (most > 0) + [f"(?:{_HEX}:){{0,{most - 2}}}{IPV4[1:-1]}"] * (most > 1)
        forms.append((f"{_HEX}(?::{_HEX}){{{left - 1}}}" if left else "") + "::" + (f"(?:{'|'.join(right)})?" if right else ""))
    return f"^(?:{'|'.join(forms)})(?:%.+)?$"


IPV6 = _ipv6()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | host.rlike(IPV6)


def urls_in(text: Column | str) -> Column:
    """The URLs of a text, less closing marks."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.transform(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def dissect(href: Column, anchor: Column | None = None, source: Column | None = None) -> Column:
    """struct<href, anchor, source, scheme, host, port, path, query, userinfo, org>; null for what is no link.

    Text without a scheme is read as http; a colon among the first twelve characters counts as
    the end of a scheme.
    """
    anchor = F.coalesce(anchor, F.lit("")) if anchor is not None else F.lit("")
    source = source if source is not None else F.lit("text")

    def split(u: Column) -> Column:
        full = F.when(u.contains("://") | F.substring(u, 1, 12).contains(":"), u).otherwise(F.concat(F.lit("http://"), u))
        full = F.regexp_replace(full, r"[\t\r\n]", "")
        scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return F.struct(u.alias("href"), scheme.alias("scheme"), F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.-]*:", "").alias("rest"))

    def parts(s: Column) -> Column:
        net = F.regexp_extract(s["rest"], r"^//([^/?#]*)", 1)
        after = F.regexp_replace(s["rest"], r"^//[^/?#]*", "")
        return F.struct(
            s["href"].alias("href"), s["scheme"].alias("scheme"), net.alias("net"),
            F.regexp_extract(after, r"^([^?#]*)", 1).alias("path"), F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def hosted(p: Column) -> Column:
        place = F.substring_index(p["net"], "@", -1)
        raw = F.when(place.startswith("["), F.regexp_extract(place, r"^\[+([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1))
        broken = p["net"].contains("[") != p["net"].contains("]")
        return F.struct(
            p["href"].alias("href"), F.when(broken, "malformed").otherwise(p["scheme"]).alias("scheme"),
            F.when(broken, "").otherwise(F.lower(F.rtrim(F.trim(raw), F.lit(".")))).alias("host"),
            F.when(~place.startswith("["), F.regexp_extract(place, r":([0-9]{1,9})$", 1).try_cast("int")).alias("port"),
            F.when(broken, "").otherwise(p["path"]).alias("path"), F.when(broken, "").otherwise(p["query"]).alias("query"),
            F.when(p["net"].contains("@") & ~broken, F.regexp_extract(p["net"], r"^(.*)@", 1)).otherwise("").alias("userinfo"),
        )

    def whole(h: Column) -> Column:
        org = F.when(is_ip(h["host"]), h["host"]).otherwise(org_domain(h["host"]))
        return F.struct(
            h["href"].alias("href"), anchor.alias("anchor"), source.alias("source"), h["scheme"].alias("scheme"), h["host"].alias("host"), h["port"].alias("port"),
            h["path"].alias("path"), h["query"].alias("query"), h["userinfo"].alias("userinfo"), org.alias("org"),
        )

    def link(u: Column) -> Column:
        noise = (u == "") | u.startswith("#") | F.lower(u).rlike("^(?:mailto|tel|sms|callto):")
        return F.when(~noise, let(let(let(split(u), parts), hosted), whole))

    return let(F.trim(F.coalesce(href, F.lit(""))), link)


def is_web(link: Column) -> Column:
    return link["scheme"].isin("http", "https")


def host_suffix(host: Column, suffixes) -> Column:
    """The longest of ``suffixes`` that a host is or ends with after a dot; null if none."""
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda n: F.array_join(F.slice(F.split(host, r"\."), n, F.lit(64)), "."))
    return F.get(F.filter(tails, lambda t: t.isin(*suffixes)), F.lit(0))


def is_shortener(link: Column) -> Column:
    return link["org"].isin(*SHORTENERS) | link["host"].isin(*SHORTENERS)


def is_tracker(link: Column) -> Column:
    return host_suffix(link["host"], TRACKERS).isNotNull()


def free_hosting(link: Column) -> Column:
    return host_suffix(link["host"], FREE_HOSTING)


def _unquoted(text: Column) -> Column:
    """Percent sequences decoded, + kept; the text itself if they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def credential_words(link: Column) -> Column:
    tokens = F.split(F.lower(_unquoted(F.concat_ws(" ", link["path"], link["query"]))), "[^a-z0-9]+")
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(w) for w in CREDENTIAL_WORDS])))


def query_params(query: Column) -> Column:
    """array<struct<key, value>> of a query string in order; pairs without a value are left out."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+"))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), plain(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))


def redirect_target(link: Column) -> Column:
    """The first parameter value that is a URL and whose name says it leads on."""
    named = F.filter(query_params(link["query"]), lambda p: F.lower(p["key"]).isin(*REDIRECT_PARAMS))
    urls = F.filter(F.transform(named, lambda p: _unquoted(p["value"])), lambda v: v.contains("://") | v.startswith("//"))
    return F.get(urls, F.lit(0))


def claimed_host(link: Column) -> Column:
    """The host that a link's text names, if it is of another organisation than its target."""
    text = F.trim(link["anchor"])

    def claim(c: Column) -> Column:
        host, org = c["host"], c["org"]
        other = (org != "") & (link["org"] != "") & (org != link["org"])
        return F.when(host.contains(".") & other, host)

    spoken = text.contains(" ") | (text == "") | (F.length(text) > 200)
    return F.when(is_web(link) & ~spoken, let(dissect(text), claim))
