"""Attachments by their names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import BIDI, DOCUMENT_LOOKING, EXPECTED_TYPES, EXTENSIONS, PASSWORD_HINT

_BIDI = "[" + BIDI + "]"


def extensions(filename: Column) -> Column:
    """The dotted parts after the first, of at most twenty characters, in lower case.

    Compatibility characters are as the mail parser left them: it writes names in NFKC.
    """
    name = F.rtrim(F.trim(F.regexp_replace(F.coalesce(filename, F.lit("")), _BIDI, "")), F.lit(". "))
    parts = F.split(name, r"\.", -1)
    return F.transform(F.filter(F.slice(parts, 2, 1000), lambda p: (p != "") & (F.length(p) <= 20)), F.lower)


def extension(filename: Column) -> Column:
    return F.coalesce(F.get(F.reverse(extensions(filename)), F.lit(0)), F.lit(""))


def has_bidi(filename: Column) -> Column:
    return F.coalesce(filename, F.lit("")).rlike(_BIDI)


def rendered(filename: Column) -> Column:
    """A name as it shows when a right-to-left override turns its tail round."""
    at = F.instr(filename, "‮")
    return F.when(at > 0, F.concat(F.substring(filename, F.lit(1), at - 1), F.reverse(F.substring(filename, at + 1, F.length(filename))))).otherwise(filename)


def category(ext: Column) -> Column:
    out = None
    for name, known in EXTENSIONS.items():
        out = F.when(ext.isin(*known), name) if out is None else out.when(ext.isin(*known), name)
    return out


def double_extension(filename: Column) -> Column:
    """struct<decoy, real> if a harmless extension stands before a dangerous last one."""
    tail = F.reverse(extensions(filename))
    real, decoy = F.get(tail, F.lit(0)), F.get(tail, F.lit(1))
    return F.when(decoy.isin(*DOCUMENT_LOOKING) & category(real).isin("executable", "script", "container"), F.struct(decoy.alias("decoy"), real.alias("real")))


def type_mismatch(filename: Column, content_type: Column) -> Column:
    """The declared type, if it contradicts the extension."""
    actual = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    ext, wrong = extension(filename), F.lit(False)
    for name, types in EXPECTED_TYPES.items():
        wrong = wrong | ((ext == name) & ~actual.isin(*types))
    return F.when(wrong & ~actual.isin("", "application/octet-stream"), actual)


def mentions_password(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + PASSWORD_HINT)
