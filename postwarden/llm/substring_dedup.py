"""Substring dedup by seed and extend, in two exchanges of keys between blocks of documents.

Seeds. The anchor of a window of ``span`` words is the leftmost smallest hash among its runs of
``seed`` words (winnowing), so equal windows have equal anchors at equal places. The blocks'
distinct anchors meet in buckets, and each block learns which of its anchors other documents hold.

Extension. The occurrences of shared anchors are joined by anchor in buckets: each brings the
words around it, as 64-bit hashes, as far as a window with this anchor can reach. There the matches
of one anchor are extended word by word to the left and to the right, all at once: step by
step, a group of occurrences that agree so far is parted by its next word. A match that is
extended l words to the left and the rest to the right is a whole window; where a smaller
document is in the same group both ways, the window repeats. Windows that touch or overlap join
into maximal repeats, which are removed.

No pair of documents is ever listed, and equal surroundings in a block are sent once, so a
passage in thousands of documents costs one entry a block and anchor.

Defined cases: a null text has no words; texts shorter than ``span`` words lose nothing; rows
with a null doc_id take no part; rows that share a doc_id do not remove from each other, as
neither id is smaller; empty tables give empty results. Words are the runs of characters
other than blanks, unchanged.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cuts, give_back, joined_bits, pack, rows, texts
from .common import table
from .hashing import mixed, windows, word_hashes
from .packing import opened, packed_blocks

SPAN = 13


def anchors(hashes: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``span`` words, the smallest hash of its runs of ``seed`` words, and how far in the leftmost of them begins."""
    runs = windows(hashes, seed, seed=1)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low, at = runs[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, span - seed + 1):
        less = runs[i : i + n] < low
        at[less] = i
        np.minimum(low, runs[i : i + n], out=low)
    return low, at


class Block:
    """The documents of one block as one run of word hashes, and the keys it sends, found again from the texts."""

    def __init__(self, docs: pa.Table, span: int, seed: int):
        self.span, self.seed = span, seed
        self.table = docs
        ids, hashes = [], [np.empty(0, np.uint64)]
        for doc, text in texts(docs):  # the words themselves are split again where they are needed, to hold one text's at a time
            ids.append(doc)
            hashes.append(word_hashes(text.split()))
        sizes = np.array([len(h) for h in hashes[1:]], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = np.concatenate(hashes)
        self.ids = np.array([-1 if doc is None else doc for doc in ids], np.int64)
        full = np.where([doc is None for doc in ids], 0, np.maximum(sizes - span + 1, 0)).astype(np.int64) if len(sizes) else sizes
        #: where windows start, and whose they are
        self.owner = np.repeat(np.arange(len(sizes)), full)
        self.starts = np.arange(len(self.owner)) - np.repeat(np.cumsum(full) - full - self.begin[:-1], full)

    def words(self):
        return (text.split() for _, text in texts(self.table))

    def occurrences(self):
        """The anchors of all windows, each place once: keys, places, owners, and the first window and how many windows have it."""
        if not len(self.starts):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none, none, none
        low, at = anchors(self.hashes, self.span, self.seed)
        place = self.starts + at[self.starts]
        head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (self.owner[1:] != self.owner[:-1])]))
        return low[self.starts[head]], place[head], self.owner[head], head, np.diff(np.concatenate([head, [len(place)]]))

    def seeds(self):
        """The distinct anchors, whether two documents of the block hold each, and each occurrence's anchor."""
        keys, _, owners, *_ = self.occurrences()
        if not len(keys):
            return keys, np.empty(0, bool), np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        first, doc = np.flatnonzero(new), self.ids[owners[order]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return keys[order][first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), number

    def around(self, elsewhere):
        """The occurrences of shared anchors by distinct surroundings: their anchors (sorted), words around, smallest document;
        then the surroundings of each occurrence, its place, owner, first window and windows.

        ``elsewhere(keys)`` tells which anchors other blocks hold.
        """
        distinct, here, number = self.seeds()
        keys, place, owner, head, many = self.occurrences()
        chosen = np.flatnonzero((here | elsewhere(distinct))[number]) if len(keys) else np.empty(0, np.int64)
        keys, place, owner, head, many = keys[chosen], place[chosen], owner[chosen], head[chosen], many[chosen]
        reach = self.span - self.seed
        side = np.concatenate([np.arange(-reach, 0), np.arange(self.seed, self.seed + reach)])
        at = place[:, None] + side
        inside = (at >= self.begin[owner][:, None]) & (at < self.begin[owner + 1][:, None])
        words = np.where(inside, np.maximum(self.hashes[np.clip(at, 0, max(len(self.hashes) - 1, 0))] if len(at) else np.empty(at.shape, np.uint64), np.uint64(1)), np.uint64(0))
        if not len(keys):
            return keys, words, np.empty(0, np.int64), chosen, place, owner, head, many
        told = np.zeros(len(keys), np.uint64)
        for column in words.T:
            told = mixed(told + column)
        order = np.lexsort((told, keys))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (words[order][1:] != words[order][:-1]).any(axis=1)])
        first, of = np.flatnonzero(new), np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return keys[order][first], words[order][first], np.minimum.reduceat(self.ids[owner[order]], first), of, place, owner, head, many


def extended(keys: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """[occurrence, l]: whether an occurrence of the same anchor in a smaller document agrees in l words to the left and the rest to the right.

    ``words``: those to the left in text order, then those to the right, as many; 0 where a text has none.
    """
    reach = words.shape[1] // 2
    group = _numbered(keys, np.zeros(len(keys), np.uint64))
    left, right = [group], [group]
    for i in range(reach):
        left.append(_numbered(left[-1].astype(np.uint64), words[:, reach - 1 - i]))
        right.append(_numbered(right[-1].astype(np.uint64), words[:, reach + i]))
    out = np.zeros((len(keys), reach + 1), bool)
    for n in range(reach + 1):
        both = left[n].astype(np.uint64) << np.uint64(32) | right[reach - n].astype(np.uint64)
        order = np.argsort(both, kind="stable")
        new = np.concatenate([[True], both[order][1:] != both[order][:-1]])
        out[order, n] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1] < doc[order]
    return out


def _numbered(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Groups parted by a word, numbered from 0."""
    # the sum and the word tell the group: multiplying by an odd number loses nothing
    order, new = sorted_pairs(mixed(word + group * np.uint64(0x9E3779B97F4A7C15)), word)
    out = np.empty(len(order), np.uint32)
    out[order] = np.cumsum(new) - 1
    return out


def sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, by ``a``, and where each pair is new."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    if (y != y[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]).any():  # equal in a alone
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return order, new


def _elsewhere(bits: dict[int, bytes], n: int):
    return lambda keys: joined_bits(bits, cuts(keys, n))


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes() if len(x) and 0 <= x.min() and x.max() < 1 << 32 else x.tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.int64 if len(x) == 8 * n else np.uint32).astype(np.int64)


SENT, ANSWER = "block long, bucket long, a binary, b binary, doc binary", "block long, bucket long, kind int, bits binary"


def _sent(block: int, at: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, doc: np.ndarray | None = None) -> pa.Table:
    part = lambda x, r: x[at[r] : at[r + 1]]
    full = [r for r in range(len(at) - 1) if at[r + 1] > at[r]]
    return rows(
        block=([block] * len(full), pa.int64()),
        bucket=(full, pa.int64()),
        a=([part(a, r).tobytes() for r in full], pa.binary()),
        b=([None if b is None else part(b, r).tobytes() for r in full], pa.binary()),
        doc=([None if doc is None else _packed(part(doc, r)) for r in full], pa.binary()),
    )


def _bits_of(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {r: b for r, k, b in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "bits")), strict=True) if k == kind}


def _answer(sent: pa.Table, kind: int, bits: list[np.ndarray]) -> pa.Table:
    n = sent.num_rows
    return rows(block=(sent.column("block").to_pylist(), pa.int64()), bucket=(sent.column("bucket").to_pylist(), pa.int64()), kind=([kind] * n, pa.int32()), bits=([pack(b) for b in bits], pa.binary()))


def _meet_anchors(sent: pa.Table) -> pa.Table:
    """Which keys two blocks or more have sent."""
    keys = [np.frombuffer(x, np.uint64) for x in sent.column("a").to_pylist()]
    _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return _answer(sent, 1, np.split(count[number] > 1, np.cumsum([len(k) for k in keys])[:-1]))


def _meet_around(sent: pa.Table) -> pa.Table:
    """Which windows around its anchors a block holds that a smaller document holds too."""
    a = [np.frombuffer(x, np.uint64) for x in sent.column("a").to_pylist()]
    sizes = [len(x) for x in a]
    words = [np.frombuffer(x, np.uint64).reshape(n, -1) for x, n in zip(sent.column("b").to_pylist(), sizes, strict=True)]
    doc = np.concatenate([_unpacked(x, n) for x, n in zip(sent.column("doc").to_pylist(), sizes, strict=True)])
    smaller = extended(np.concatenate(a), np.concatenate(words), doc)
    return _answer(sent, 2, [x.ravel() for x in np.split(smaller, np.cumsum(sizes)[:-1])])


def _covered(docs: Block, anchor_bits: dict[int, bytes], window_bits: dict[int, bytes], n: int) -> dict[int, np.ndarray]:
    """By document's number, which of its words lie in a repeat."""
    keys, _, least, of, place, owner, head, many = docs.around(_elsewhere(anchor_bits, n))
    if not len(keys):
        return {}
    wide = docs.span - docs.seed + 1
    smaller = joined_bits(window_bits, cuts(keys, n) * wide).reshape(-1, wide)
    window = np.repeat(head - np.cumsum(many) + many, many) + np.arange(many.sum())  # the windows of each occurrence
    per = np.repeat(np.arange(len(of)), many)
    start = docs.starts[window]
    hit = start[smaller[of[per], place[per] - start] | (least[of[per]] < docs.ids[owner[per]])]
    edge = np.bincount(hit, minlength=len(docs.hashes) + 1) - np.bincount(hit + docs.span, minlength=len(docs.hashes) + 1)
    inside = np.cumsum(edge) > 0
    touched = np.unique(np.searchsorted(docs.begin, hit, side="right") - 1)
    return {k: inside[docs.begin[k] : docs.begin[k + 1]] for k in touched.tolist()}


def repeats(covered: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of covered words as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def without(text: str, covered: np.ndarray) -> str:
    """A text less its covered words; what stands between kept words stays, a gap becomes its first blank run."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, last = [], None
    for k, (a, b) in enumerate(spans):
        if covered[k]:
            continue
        if last is not None:
            out.append(text[spans[last][1] : spans[last + 1][0]])
        out.append(text[a:b])
        last = k
    return "".join(out)


def substring_dedup(docs: DataFrame, result, schema: str, span: int = SPAN, seed: int | None = None) -> DataFrame:
    """``result(table, Block, covered)`` of each block; ``docs`` has doc_id and text, and what ``result`` reads. ``seed`` is half of ``span`` if not given."""
    seed = max(1, span // 2) if seed is None else seed
    if not 0 < seed <= span:
        raise ValueError("seed must be between 1 and span")
    # rows without a doc_id take no part: any block will do, but not one for all
    blocks, n = packed_blocks(docs.withColumn("doc_id", F.col("doc_id").cast("long")), F.coalesce("doc_id", F.xxhash64("text")))

    def seeds(t: pa.Table) -> pa.Table:
        keys, *_ = Block(opened(t), span, seed).seeds()
        give_back()
        return _sent(t.column("block")[0].as_py(), cuts(keys, n), keys)

    def extend(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("a", "b", "doc")}})
        keys, words, least, *_ = Block(opened(t), span, seed).around(_elsewhere(_bits_of(answers, 1), n))
        give_back()
        return _sent(key[0].as_py(), cuts(keys, n), keys, words, least)

    def finish(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(t := opened(t), span, seed)
        out = result(t, own, _covered(own, _bits_of(answers, 1), _bits_of(answers, 2), n))
        del own
        give_back()
        return out

    first = blocks.groupBy("block").applyInArrow(seeds, SENT).groupBy("bucket").applyInArrow(_meet_anchors, ANSWER)
    second = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(extend, SENT).groupBy("bucket").applyInArrow(_meet_around, ANSWER)
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(finish, schema)


def _digests(t: pa.Table, own: Block, covered: dict[int, np.ndarray]) -> pa.Table:
    removed, sha = [], []
    counts = np.diff(own.begin)
    for k, words in enumerate(own.words()):
        kept = words
        if k in covered:
            kept = [w for w, c in zip(words, covered[k].tolist(), strict=True) if not c]
        removed.append(len(words) - len(kept))
        sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeat_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id and the maximal repeats of each document, as arrays of first word and end."""

    def spans(t: pa.Table, own: Block, covered: dict[int, np.ndarray]) -> pa.Table:
        found = [repeats(covered[k]) if k in covered else [] for k in range(t.num_rows)]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": t.column("doc_id"), "repeats": pa.array([[{"first": a, "end": b} for a, b in x] for x in found], kind)})

    return substring_dedup(docs.select("doc_id", "text"), spans, "doc_id long, repeats array<struct<first: long, end: long>>", span)


def cut_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with the repeats cut from their texts (n_chars follows); a document of which nothing is left goes."""
    names = docs.columns

    def cut(t: pa.Table, own: Block, covered: dict[int, np.ndarray]) -> pa.Table:
        out = t.column("text").to_pylist()
        for k, c in covered.items():
            out[k] = without(out[k], c)
        gone = np.array([k not in covered or not covered[k].all() for k in range(t.num_rows)], bool)
        t = t.set_column(t.column_names.index("text"), "text", pa.array(out, pa.string()))
        if "n_chars" in names:
            size = [None if x is None else len(x) if k in covered else n for k, (x, n) in enumerate(zip(out, t.column("n_chars").to_pylist(), strict=True))]
            t = t.set_column(t.column_names.index("n_chars"), "n_chars", pa.array(size, t.column("n_chars").type))
        return t.select(names).filter(pa.array(gone))

    return substring_dedup(docs, cut, docs.schema, span)


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g) WHERE least < doc_id),
c AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT w.doc_id, w.w, coalesce(c.p, []) AS p FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
l AS (SELECT doc_id, len(w) AS n, len(p) AS r, CASE WHEN len(p) = 0 THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(p, j)) END AS kept FROM k)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM l
"""
