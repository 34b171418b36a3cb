"""Mail addresses and display names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import TITLES

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def domain_of(address: Column | str) -> Column:
    """What stands after the last @, in lower case, less outer blanks and last dots; '' without @."""
    a = _text(address)
    return F.when(a.contains("@"), F.rtrim(F.lower(F.trim(F.substring_index(a, "@", -1))), F.lit("."))).otherwise("")


def local_of(address: Column | str) -> Column:
    """What stands before the last @, or all of it without one, trimmed and in lower case."""
    a = _text(address)
    return F.lower(F.trim(F.when(a.contains("@"), F.regexp_extract(a, r"(?s)^(.*)@", 1)).otherwise(a)))


def _bare(address: Column | str) -> Column:
    a = F.trim(_text(address))
    inside = F.regexp_extract(a, r"<([^<>]*)>\s*$", 1)
    return F.trim(F.regexp_replace(F.trim(F.when(inside != "", inside).otherwise(a)), r"^[<>]+|[<>]+$", ""))


def normal_address(address: Column | str) -> Column:
    """local@domain in lower case; a name in front of <address> goes."""
    b = _bare(address)
    return F.when(domain_of(b) != "", F.concat(local_of(b), F.lit("@"), domain_of(b))).otherwise(local_of(b))


def canonical_address(address: Column | str) -> Column:
    """The mailbox an address reaches: no +tag; at Gmail no dots and one domain."""
    b = _bare(address)
    local, domain = F.substring_index(local_of(b), "+", 1), domain_of(b)
    gmail = domain.isin("gmail.com", "googlemail.com")
    return (
        F.when(domain == "", local_of(b))
        .when(gmail, F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@gmail.com")))
        .otherwise(F.concat(local, F.lit("@"), domain))
    )


def emails_in(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_text(text), F.lit(EMAIL), F.lit(0)), F.lower)


def name_key(name: Column | str) -> Column:
    """A display name less case, marks, titles and order: its first four words, sorted."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim(_text(name))), r"[^a-z0-9\s]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*TITLES))
    return F.array_join(F.array_sort(F.slice(words, 1, 4)), " ")


# the same in DuckDB SQL
def sql_domain_of(a: str) -> str:
    return f"(CASE WHEN contains(coalesce({a},''),'@') THEN rtrim(lower(trim(regexp_extract({a}, '@([^@]*)$', 1))), '.') ELSE '' END)"


def sql_local_of(a: str) -> str:
    return f"lower(trim(CASE WHEN contains(coalesce({a},''),'@') THEN regexp_extract({a}, '^(.*)@', 1) ELSE coalesce({a},'') END))"


def sql_canonical(a: str) -> str:
    local, domain = f"split_part({sql_local_of(a)}, '+', 1)", sql_domain_of(a)
    return f"(CASE WHEN {domain} = '' THEN {sql_local_of(a)} WHEN {domain} IN ('gmail.com','googlemail.com') THEN replace({local}, '.', '') || '@gmail.com' ELSE {local} || '@' || {domain} END)"


def sql_name_key(a: str) -> str:
    titles = ",".join(f"'{t}'" for t in TITLES)
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower(trim(coalesce({a},''))), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({titles}))"
    return f"array_to_string(list_sort({words}[1:4]), ' ')"
