"""Identifiers replaced before text leaves: the shape of a request stays, numbers and secrets go."""

from __future__ import annotations

import re

from pyspark.sql import Column

from .pieces import by_row

# What is recognised, in the order in which it is replaced.
MARKUP = re.compile(r"<!--.*?-->|<!\[endif\]>?|<!\[if[^\]]*\]>?|<[a-zA-Z/!][^>]{0,400}>", re.S)
CSS = re.compile(r"[a-zA-Z-]+\s*:\s*[^;{}]{1,60};(?:\s*[a-zA-Z-]+\s*:\s*[^;{}]{1,60};){2,}")
URL = re.compile(r"https?://[^\s<>\"')\]]+", re.I)
ETH = re.compile(r"\b0x[a-fA-F0-9]{40}\b")
BTC = re.compile(r"\b(?:bc1[a-z0-9]{20,60}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b")
IBAN = re.compile(r"\b[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]{2,4}){2,8}\b")
CARD = re.compile(r"\b(?:\d[ -]?){13,19}\b")
SORT_CODE = re.compile(r"\b\d{2}[- ]\d{2}[- ]\d{2}\b")
LABELLED = re.compile(
    r"\b(iban|swift|bic|account|acct|a/c|routing|aba|sort\s?code|wallet|beneficiary)\b\s*(?:number|no\.?|code|#)?\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9 -]{4,38}[A-Za-z0-9])", re.I
)
PROSE = re.compile(
    r"(?:details?|information|info|number|numbers|manager|name|holder|balance|statement|summary|team|is|are|was|has|have|will|to|for|of|and|the|below|above|attached|updated|new|old)\b", re.I
)
EMAIL = re.compile(r"[\w.+-]+@([\w.-]+\.\w{2,})")
PHONE = re.compile(r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)")
DIGITS = re.compile(r"\b\d{6,}\b")
SHOWN_SEGMENTS, LONGEST_SEGMENT = 2, 24


def plain(text: str | None) -> str:
    """A body without tags, conditional comments and runs of style declarations."""
    out = MARKUP.sub(" ", text or "")
    return " ".join((CSS.sub(" ", out) if out.count(";") >= 3 and ":" in out else out).split())


def _site(m: re.Match) -> str:
    """A URL's scheme, host and at most two short segments of its path."""
    scheme, _, rest = m[0].partition("://")
    place, _, path = re.split("[?#]", rest, maxsplit=1)[0].partition("/")
    segments = [s for s in path.split("/") if s]
    shown = [s if len(s) <= LONGEST_SEGMENT else "[TOKEN]" for s in segments[:SHOWN_SEGMENTS]]
    return "/".join([f"{scheme}://{place.rpartition('@')[2] if '@' in place else place}", *shown])


def _number(name: str):
    """Replaces a match up to its last group with a digit; words that the pattern took along stay."""

    def run(m: re.Match) -> str:
        groups = m[0].split(" ")
        last = max((k for k, g in enumerate(groups) if re.search(r"\d", g)), default=None)
        return m[0] if last is None else " ".join([name, *groups[last + 1 :]])

    return run


def _labelled(m: re.Match) -> str:
    says_code = re.search(r"\d", m[2]) or m[1].lower() in ("swift", "bic")
    return f"{m[1]} [ACCOUNT]" if says_code and not PROSE.match(m[2].strip()) else m[0]


_DIGIT = re.compile(r"\d")
#: (pattern, what to put, what every match of it holds: texts without that are not searched)
STEPS = (
    (URL, _site, re.compile("://")), (ETH, "[WALLET]", re.compile("0x")), (BTC, "[WALLET]", _DIGIT), (IBAN, _number("[IBAN]"), _DIGIT),
    (CARD, _number("[CARD-NUMBER]"), _DIGIT), (SORT_CODE, "[SORT-CODE]", _DIGIT), (LABELLED, _labelled, re.compile("")),
    (EMAIL, r"[USER]@\1", re.compile("@")), (PHONE, "[PHONE]", _DIGIT), (DIGITS, "[NUMBER]", _DIGIT),
)


def redact(text: str | None, own: str | None = None) -> str:
    out = plain(text)
    if own:
        out = out.replace(own, "[YOUR-ADDRESS]")
    for pattern, put, mark in STEPS:
        if mark.search(out):
            out = pattern.sub(put, out)
    return out


def leaks(text: str, redacted: str, shortest: int = 6) -> list[str]:
    """Words with digits of a text that are still in its redacted form; a URL may stay only if there was nothing to strip from it."""
    words = {w.strip(".,;:!?()[]<>\"'") for w in plain(text).split()}
    kept = {w for w in words if len(w) >= shortest and re.search(r"\d", w) and w in redacted}
    return sorted(w for w in kept if not URL.fullmatch(w) or URL.sub(_site, w) != w)


def redacted(text: Column | str, own: Column | str | None = None) -> Column:
    return by_row(redact, "string", text, *([] if own is None else [own]))
