"""Quality rules: repetition rules inside a document and line frequency across documents.

Only DataFrame expressions are used. A line is normalised (lower case, digits to 0, blanks
collapsed) and hashed; the distinct documents of each host that hold it are counted. A line
that more than ``min_docs`` documents and more than ``max_share`` of its host's documents
hold is boilerplate: it is removed everywhere but in the document with the smallest id. A
document that loses more than ``max_lost`` of its words is depleted and not kept.

Defined cases: a null text has no words and fails the base rules; a null host is a host of
its own; repeated rows of a document are one document to the count and each gets its row; rows
without a doc_id are not counted as documents;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let, words_of

WINDOW = 8


def _covered(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the array holds twice or more."""
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def repeated(pairs: Column) -> Column:
        twin = lambda x, j, d: F.coalesce(x["h"] == F.get(pairs, j + d)["h"], F.lit(False))
        starts = F.transform(F.filter(pairs, lambda x, j: twin(x, j, -1) | twin(x, j, 1)), lambda x: x["i"])
        fold = F.aggregate(
            F.sort_array(starts),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        )
        return fold["n"]

    return let(
        hashes,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
        ),
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.col(text)
    inside = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), _covered(w).alias("r")))
    lines = let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    n, repeats = F.col("_in")["n"].cast("long"), F.col("_in")["r"].cast("long")
    return docs.withColumn("_in", inside).withColumns(
        {
            "n_words": n,
            "word_chars": F.coalesce(F.length(F.regexp_replace(t, BLANKS, "")), F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long"),
            "n_dup_lines": lines.cast("long"),
            "n_repeat_words": repeats,
            "base_failed": (n < 20) | (100 * repeats > 30 * n),
        }
    ).drop("_in")


def _normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, BLANKS, " ")), "[0-9]", "0"))


def line_table(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row a line: host, its hash, the document, its words, and 1 for the first such line of the row."""
    pairs = F.sort_array(F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))))
    marked = let(
        pairs,
        lambda p: F.transform(p, lambda x, j: F.struct(x["h"].alias("h"), x["w"].alias("w"), F.coalesce(x["h"] != F.get(p, j - 1)["h"], F.lit(True)).cast("int").alias("first"))),
    )
    return docs.select(F.col(host).alias("host"), F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.inline(marked))


def boilerplate(lines: DataFrame, hosts: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """Lines above the limits: host, h, n_docs and the document that keeps the line."""
    holders = lines.where("first = 1").select("host", "h", "doc").distinct()
    counts = holders.groupBy("host", "h").agg(F.count("doc").alias("n_docs"), F.min("doc").alias("keeper")).where(F.col("n_docs") > min_docs)
    sizes = hosts.withColumnRenamed("host", "of")
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "h", "n_docs", "keeper")


def apply_line_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, max_share: float = 0.01, max_lost: float = 0.5
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, removed_words and n_removed_lines of each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    lines = line_table(docs, "doc_id", "text", "host")
    bad = boilerplate(lines, docs.select("host", "doc_id").distinct().groupBy("host").agg(F.count("doc_id").alias("host_docs")), min_docs, max_share)
    bad = bad.select(F.col("host").alias("bad_host"), F.col("h").alias("bad_h"), "keeper")
    hit = lines.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("h") == F.col("bad_h"))).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    once = hit.groupBy("doc", "body", "h").agg((F.sum("w") / F.sum("first")).alias("w"), (F.count("*") / F.sum("first")).alias("lines"))
    lost = once.groupBy("doc", "body").agg(F.sum("w").cast("long").alias("removed_words"), F.sum("lines").cast("long").alias("n_removed_lines"))
    base = base_rules(docs.withColumn("row_body", F.xxhash64("text"))).drop("text", "host")
    out = base.join(lost, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row_body") == F.col("body")), "left")
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (removed <= max_lost * F.col("n_words"))).alias("kept"),
        removed.alias("removed_words"), F.coalesce(F.col("n_removed_lines"), F.lit(0)).alias("n_removed_lines"),
    )


def op1_line_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return apply_line_rules(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM g),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM c) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
ln AS (SELECT doc_id, source, unnest(l) AS line FROM d),
nl AS (SELECT doc_id, source, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
       lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g')) AS h FROM ln),
hs AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (SELECT nl.source, h, min(doc_id) AS keeper FROM nl JOIN hs ON nl.source IS NOT DISTINCT FROM hs.source
        GROUP BY nl.source, h, hs.n HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.01 * hs.n),
lost AS (SELECT doc_id, sum(w)::BIGINT AS removed_words, count(*)::BIGINT AS n_removed_lines
         FROM nl JOIN bad ON nl.source IS NOT DISTINCT FROM bad.source AND nl.h = bad.h WHERE doc_id <> keeper GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(removed_words, 0) <= 0.5 * n_words AS kept,
       coalesce(removed_words, 0)::BIGINT AS removed_words, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
FROM b LEFT JOIN lost ON b.doc_id = lost.doc_id
"""
