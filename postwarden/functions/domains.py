"""Domain names: organisation, providers, look-alikes, mixed scripts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import CONFUSABLES, COUSIN_AFFIXES, FREEMAIL, MULTI_SUFFIXES, SCRIPTS

SHORTEST_NAME = 4
_ORG = r"(?:\A|\.)([^.]*\.(?:" + "|".join(map(re.escape, sorted(MULTI_SUFFIXES))) + r")|[^.]*\.[^.]*|[^.]*)\z"


def _clean(domain: Column | str) -> Column:
    d = F.coalesce(F.col(domain) if isinstance(domain, str) else domain, F.lit(""))
    return F.trim(F.lower(F.trim(d)), F.lit("."))


def org_domain(domain: Column | str) -> Column:
    """The registrable domain: two labels, or three under a suffix of two."""
    return F.regexp_extract(_clean(domain), _ORG, 1)


def name_label(domain: Column | str) -> Column:
    return F.substring_index(org_domain(domain), ".", 1)


def is_freemail(domain: Column | str) -> Column:
    return org_domain(domain).isin(*FREEMAIL) | F.lower(F.coalesce(F.col(domain) if isinstance(domain, str) else domain, F.lit(""))).isin(*FREEMAIL)


def same_org(a: Column | str, b: Column | str) -> Column:
    x, y = org_domain(a), org_domain(b)
    return (x != "") & (y != "") & (x == y)


def skeleton(label: Column | str) -> Column:
    """A label as it looks at a glance: glyphs that pass for another replaced in a fixed order."""
    out = F.lower(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    for a, b in (("-", ""), ("_", ""), *CONFUSABLES):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def edits(a: str, b: str, most: int = 4) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1])]
            if min(i, j) > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                options.append(table[i - 2][j - 2] + 1)
            table[i][j] = min(options)
    return min(table[-1][-1], most + 1)


def edits_of(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edits(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return run(a, b)


def imitation(candidate: Column | str, known: Column | str, distance: Column) -> Column:
    """How ``candidate`` imitates ``known``: struct<kind, confidence>, null if it does not.

    ``distance`` is the edits between their labels, or anything over 2.
    """
    c_org, k_org = org_domain(candidate), org_domain(known)
    c, k = F.substring_index(c_org, ".", 1), F.substring_index(k_org, ".", 1)
    at = F.call_function("locate", k, c)
    extra = F.trim(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(k), F.length(c))), F.lit("-_."))
    cousin = c.contains(k) & (F.length(c) > F.length(k))
    kind = lambda name, sure: F.struct(F.lit(name).alias("kind"), F.lit(sure).alias("confidence"))
    none = (c_org == "") | (k_org == "") | (c_org == k_org) | (c == "") | (F.length(k) < SHORTEST_NAME)
    return (
        F.when(none, F.lit(None))
        .when(c == k, kind("tld_swap", 0.80))
        .when(skeleton(c) == skeleton(k), kind("visual", 0.95))
        .when((distance == 1) & (F.length(k) >= 5), kind("typo", 0.85))
        .when((distance == 2) & (F.length(k) >= 9), kind("typo", 0.70))
        .when(cousin & extra.isin(*COUSIN_AFFIXES), kind("cousin", 0.80))
        .when(cousin & (extra != "") & (F.length(extra) <= 12), kind("cousin", 0.60))
    )


def scripts_in(text: str) -> set[str]:
    names = (unicodedata.name(c, "") for c in text if c.isalpha())
    return {next((s for s in SCRIPTS if n.startswith(s)), "") for n in names} - {""}


def unicode_trick(domain: str | None) -> str | None:
    """mixed_script if a label mixes alphabets, punycode if an IDN is not plain, null otherwise."""
    if not domain:
        return None
    decoded = None
    if "xn--" in domain.lower():
        try:
            decoded = domain.encode("ascii").decode("idna")
        except (UnicodeError, ValueError):
            decoded = None
    shown = decoded or domain
    plain = shown.isascii()
    if (decoded or not plain) and any(len(scripts_in(x)) > 1 for x in shown.split(".")):
        return "mixed_script"
    return "punycode" if decoded and not plain else None


def unicode_trick_of(domain: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(unicode_trick)

    return run(domain)


def _variants(word: str, most: int) -> list[str]:
    """A word less up to ``most`` of its letters: two words within that many edits have one in common."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return sorted(out)


def blocking_keys(role: str):
    """Keys under which a candidate's label meets the known labels it may imitate, as a UDF of the label.

    Known labels offer their letters, skeleton and shortened forms; candidates the same, and
    every part of theirs that could be a known label inside a cousin domain.
    """

    @F.pandas_udf("array<string>")
    def run(label: pd.Series) -> pd.Series:
        out = []
        for x in label:
            keys = {f"= {x}", f"~ {skeleton_text(x)}"}
            keys.update(f"- {v}" for v in _variants(x, 2 if len(x) >= 7 else 1 if len(x) >= 4 else 0))
            if role == "candidate":
                keys.update(f"= {x[i:j]}" for i in range(len(x)) for j in range(i + SHORTEST_NAME, len(x) + 1))
            out.append(sorted(keys))
        return pd.Series(out)

    return run


def skeleton_text(label: str) -> str:
    out = label.lower()
    for a, b in (("-", ""), ("_", ""), *CONFUSABLES):
        out = out.replace(a, b)
    return out


# the same in DuckDB SQL
def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_tail(d: str, n: int) -> str:
    return f"array_to_string(string_split({d}, '.')[-{n}:], '.')"


def sql_org(d: str) -> str:
    d = f"trim(lower(trim(coalesce({d}, ''))), '.')"
    return f"(CASE WHEN {sql_tail(d, 2)} IN ({sql_list(MULTI_SUFFIXES)}) THEN {sql_tail(d, 3)} ELSE {sql_tail(d, 2)} END)"


def sql_skeleton(label: str) -> str:
    out = f"lower(coalesce({label}, ''))"
    for a, b in (("-", ""), ("_", ""), *CONFUSABLES):
        out = f"replace({out}, '{a}', '{b}')"
    return out
