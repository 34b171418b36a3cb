"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on full shingle sets.

A document's set is its distinct word shingles as 64-bit hashes. Two seeded permutations of
2**20 places give all signature coordinates: sigma places each shingle, and coordinate k is
the smallest value of pi, shifted round by k, over the places. BANDS bands of ROWS coordinates
make the candidate buckets; at Jaccard 0.8 a pair misses all buckets with a chance of
(1 - 0.8**5)**40, 1.3e-7.

Documents with the same set are one class, named by its smallest doc_id; only classes go on.
Inside a bucket no pairs are listed. Every member is compared with the bucket's smallest: first
by two bits of each coordinate (a pair at Jaccard 0.8 differs in 30 of 200 on average; one that
differs in more than MOST_APART, over five standard deviations, 1e-7, goes no further), then on
the full sets. What these links connect needs no more comparing, so a group of thousands of
mutual near copies costs one comparison a member. Documents in buckets that are still apart
are joined once more, exactly, by a prefix filter on their rarest shingles.

Defined cases: a null text and a text without words have the empty set, linked with nothing;
a null doc_id is linked with nothing, has a null component and is kept; rows that share a
doc_id are one document, each with its row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .common import stored, table
from .components import components
from .hashing import mixed, windows, word_hashes

PLACES = 1 << 20
ROWS, BANDS = 5, 40
PERCENT = 80
#: Longs that hold one bit of all coordinates, and how many coordinates may differ in two bits in a pair that is compared.
LONGS, MOST_APART = 4, 57


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    return np.unique(windows(word_hashes(words), width, seed=width))


class Circulant:
    """Signatures from two permutations, the second shifted round once for each coordinate."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.sigma = rng.permutation(PLACES).astype(np.int32)
        pi = rng.permutation(PLACES).astype(np.int32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: ROWS * BANDS]]), ROWS * BANDS)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.sigma[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
        best = np.full(ROWS * BANDS, PLACES, np.int32)
        for i in range(0, len(places), 2048):
            np.minimum(best, self.shifts[places[i : i + 2048]].min(axis=0), out=best)
        return best

    def bands(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)

    def sketch(self, signature: np.ndarray) -> np.ndarray:
        """The two lowest bits of all coordinates, the first LONGS words the lower."""
        planes = [np.packbits((signature >> k) & 1).tobytes().ljust(8 * LONGS, b"\0") for k in (0, 1)]
        return np.frombuffer(b"".join(planes), np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant()
        for batch in batches:
            ids, sizes, classes, bands, sketches = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                signature = maker.signature(s)
                bands.append(maker.bands(signature) if len(s) else np.empty(0, np.int64))
                sketches.append(maker.sketch(signature))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), _lists(bands), _lists(sketches)], names=["doc_id", "n_shingles", "cls", "bands", "sketch"])
        del maker
        give_back()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, sets = [], [], []
            for doc, text, cls in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), width)
                if xxhash.xxh3_128_digest(s.tobytes()) == cls.as_py():
                    ids.append(doc.as_py())
                    classes.append(cls.as_py())
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["id", "cls", "set"])
        give_back()

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs, by their full sets. A member's set moves once a pair; a pivot's once."""
    one = pairs.join(sets.select(F.col("id").alias("ib"), F.col("set").alias("sb")), F.col("b") == F.col("ib")).select("a", "b", "sb")
    two = one.join(sets.select(F.col("id").alias("ia"), F.col("set").alias("sa")), F.col("a") == F.col("ia")).select("a", "b", "sa", "sb")
    return two.mapInArrow(_compare(percent), "a long, b long, linked boolean")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, s in zip(batch.column(0), batch.column(1), strict=True):
            found = np.frombuffer(s.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc.as_py())), pa.array(found)], names=["id", "token"])


def _prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``live`` (rep, label) with different labels that a prefix filter can't rule out.

    Shingles are put in one order, rare ones first. Sets of n and m shingles that meet the
    threshold share at least o = percent (n + m) / (100 + percent); so they have a common
    shingle among the first n - o + 1 of one and m - o + 1 of the other. Only pairs with a
    common shingle that stands early enough in both go on.
    """
    own = live.select(F.col("rep").alias("r"), "label")
    tokens = stored(sets.join(own.select("r"), F.col("id") == F.col("r"), "left_semi").mapInArrow(_tokens, "id long, token long"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).select(F.col("token").alias("t"), "df")
    ranked = tokens.join(df, F.col("token") == F.col("t")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    n = F.size("s")
    prefix = ranked.select("id", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("pos", "x"))
    prefix = prefix.where("x.df > 1").select("id", "n", "pos", F.col("x.token").alias("token")).join(own, F.col("id") == F.col("r")).select("id", "n", "pos", "token", "label")
    apart = prefix.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("token").alias("t"))
    prefix = stored(prefix.join(apart, F.col("token") == F.col("t"), "left_semi"))
    other = prefix.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("token").alias("token2"), F.col("label").alias("label2"))
    shared = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    enough = (100 + percent) * shared >= percent * (F.col("n") + F.col("n2"))
    return prefix.join(other, (F.col("token") == F.col("token2")) & (F.col("id") < F.col("id2")) & (F.col("label") != F.col("label2")) & enough).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _class_sets(docs: DataFrame, sig: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, cls, set, own) of the classes ``wanted`` (rep, cls), each once however many rows hold it; ``own`` is a number of the class."""
    texts = docs.join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "cls")
    sets = texts.mapInArrow(_sets(width), "id long, cls binary, set binary")
    rows = sig.select("doc_id", "cls").join(wanted.select("rep", F.col("cls").alias("c")), (F.col("doc_id") == F.col("rep")) & (F.col("cls") == F.col("c")), "left_semi")
    again = stored(rows.groupBy("doc_id", "cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("i"), F.col("cls").alias("c")))
    if not again.isEmpty():
        sets = stored(sets)
        same = (F.col("id") == F.col("i")) & (F.col("cls") == F.col("c"))
        once = sets.join(again, same, "left_semi").groupBy("id", "cls").agg(F.min("set").alias("set"))
        sets = sets.join(again, same, "left_anti").union(once)
    return stored(sets.withColumn("own", F.monotonically_increasing_id()))


def link_classes(docs: DataFrame, sig: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Components (node, label) of the classes that have a link to another class; ``sig`` has a row (doc_id, cls) for each row of ``docs``."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("p")).where("c > 1").select(F.col("key").alias("k"), "p")
    members = stored(keys.join(shared, F.col("key") == F.col("k")).select("key", "rep", "p"))
    wanted = members.select("rep").distinct().join(classes.select(F.col("rep").alias("r"), "cls"), F.col("rep") == F.col("r")).select("rep", "cls")
    sets = _class_sets(docs, sig, wanted, width)

    # every member against its bucket's smallest
    facts = classes.select(F.col("rep").alias("r"), F.col("n_shingles").alias("n"), "sketch")
    pairs = members.where("rep <> p").select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(facts, F.col("b") == F.col("r")).select("a", "b", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    pairs = pairs.join(facts, F.col("a") == F.col("r")).select("a", "b", "nb", "sb", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    differ = [F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i))).bitwiseOR(F.get("sa", F.lit(i + LONGS)).bitwiseXOR(F.get("sb", F.lit(i + LONGS))))) for i in range(LONGS)]
    pairs = pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (sum(differ[1:], differ[0]) <= MOST_APART)).select("a", "b")
    links = stored(_verified(pairs, sets, percent).where("linked").select("a", "b"))
    labels = components(links)

    # the members of buckets that are not connected so far, against each other
    named = members.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    apart = named.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi and c > 2").select(F.col("key").alias("k"))
    live = stored(named.join(apart, F.col("key") == F.col("k"), "left_semi").select("rep", "label").distinct())
    if live.isEmpty():
        return labels
    # a document with several texts has a set for each; here they count apart, under their own numbers
    mine = sets.select(F.col("own").alias("id"), "set")
    more = _verified(_prefix_pairs(sets.select("id", "own").join(live, F.col("id") == F.col("rep")).select(F.col("own").alias("rep"), "label"), mine, percent), mine, percent)
    more = more.where("linked").select("a", "b")
    for end in ("a", "b"):
        of = sets.select(F.col("own").alias("o"), F.col("id").alias("i"))
        more = more.join(of, F.col(end) == F.col("o")).withColumn(end, F.col("i")).drop("o", "i")
    return components(links.union(more))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = stored(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, cls binary, bands array<long>, sketch array<long>"))
    real = sig.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("cls").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "sketch"), "doc_id").alias("x"))
    classes = stored(classes.select("cls", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.bands").alias("bands"), F.col("x.sketch").alias("sketch")))
    same = sig.select("doc_id", "n_shingles", "cls").join(classes.select(F.col("cls").alias("c"), "rep"), F.col("cls") == F.col("c"), "left")
    # rows that share a doc_id tie their classes together
    tied = real.join(classes.select(F.col("cls").alias("c"), "rep"), F.col("cls") == F.col("c")).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    labels = link_classes(docs, sig, classes, width, percent)
    tied = stored(tied)
    if not tied.isEmpty():
        labels = components(tied.union(labels.select("label", "node")))
    out = same.join(labels, F.col("rep") == F.col("node"), "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    comp = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("label", "rep"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near duplicates; all rows of a kept doc_id stay, whatever further columns there are."""
    gone = near_duplicates(docs, width=width).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
        ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, unnest(s) AS g FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
e AS (SELECT i.a, i.b FROM i JOIN c p ON p.rep = i.a JOIN c q ON q.rep = i.b WHERE 100 * k >= 80 * (p.n + q.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT rep, rep FROM c UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n),
l AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.m, s.doc_id)::BIGINT AS component_id, coalesce(l.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN l ON l.n = c.rep
"""
