r"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts become their pre-tokens, the matches of the pre-tokenizer's pattern, with positions. They
are counted off chunk by chunk (texts of some millions of characters, where they lie: no text
is shuffled): each distinct pre-token of a chunk goes once to a bucket by its hash, its positions
to the task that will put the chunk together. A bucket encodes each distinct pre-token once, by
the public vocabulary's ranks; the ids go back to the chunk and are joined to the positions, by
which it is reassembled. Both sorts of rows leave in one exchange, which both steps read. Decoding joins the ids with the token-byte table (50,256 entries, read by every
worker from the vocabulary file: a map-side join).

What moves is one compressed row a chunk and bucket: words, positions as differences, ids. A row
a pre-token would move several times the input.

Pre-tokens are found in two steps: a text is cut at each space or line feed that follows a
character other than white space, which no match of the pattern spans; then each distinct piece
is cut by the pattern once a chunk.

Defined cases: a null text is empty: no ids, empty bytes; rows are independent, so repeated
rows each get their result; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blocks import give_back
from .common import shuffle_partitions, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of the texts of a chunk, if it has more than one text.
CHUNK = 16_000_000
_LOADED: dict[str, tuple] = {}
_AFTER_BLANK = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str, pattern: str | None = None):
    """(tiktoken encoding, bytes of each id), read once a worker."""
    if path not in _LOADED:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = coder, [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
    return _LOADED[path]


def words(text: str) -> list[str]:
    """The pieces of a text that can be encoded by themselves; joined, they are the text."""
    if not text:
        return []
    if "\0" in text or _AFTER_BLANK.search(text):
        return _CUT.split(text)
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


@functools.cache
def splitter(pattern: str | None = None):
    import regex

    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    return regex.compile(pattern)


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pre_tokens(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of some texts, the number of each in order, and how many each text has."""
    pieces, runs = Numbers(), []
    for text in texts:
        parts = words(text or "")
        runs.append(np.fromiter(map(pieces.__getitem__, parts), np.int32, len(parts)))
    tokens, split, starts, flat = Numbers(), splitter().findall, [0], []
    for piece in pieces:
        flat.extend(map(tokens.__getitem__, split(piece)))
        starts.append(len(flat))
    whole, starts = np.concatenate([np.empty(0, np.int32), *runs]), np.array(starts, np.int64)
    sizes = np.diff(starts)[whole]
    ends = np.cumsum(sizes)
    order = np.array(flat, np.int32)[np.repeat(starts[whole] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, runs)])]
    return list(tokens), order, np.diff(upto)


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _spread(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _squeezed_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers, byte planes apart."""
    return _squeeze(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread_numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_spread(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cut_up(flat: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Keys below CHUNKS are buckets, others chunks.
CHUNKS = 1 << 62
SENT = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("lengths", "flat", "counts", "places", "ids", "sizes", "nulls"))])
CODED = pa.schema([("key", pa.int64()), ("bucket", pa.int64()), ("n_ids", pa.binary()), ("codes", pa.binary())])
_KINDS = {pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _rows(schema: pa.Schema, found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, schema=schema)


def _sent_chunk(chunk: int, ids: list[int | None], texts: list[str | None], n: int) -> list[dict]:
    """For each bucket a row to it, of the chunk's pre-tokens, and one to the chunk, of their positions; and one, with ``ids``, of its documents."""
    tokens, order, sizes = pre_tokens(texts)
    raw = [t.encode() for t in tokens]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    bucket = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    rank = np.empty(len(raw), np.int64)
    by_bucket = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
    by_bucket = by_bucket[np.argsort(bucket[by_bucket], kind="stable")]
    rank[by_bucket] = np.arange(len(raw))
    places = np.argsort(rank[order], kind="stable")  # by pre-token in that order, then by position
    counts = np.bincount(rank[order], minlength=len(raw))
    edge, at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))]), np.concatenate([[0], np.cumsum(counts)])
    out = [{"key": CHUNKS + chunk, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "sizes": sizes.astype(np.int64).tobytes(), "nulls": np.array([i is None for i in ids]).tobytes()}]
    for r in np.flatnonzero(np.diff(edge)).tolist():
        own = [raw[i] for i in by_bucket[edge[r] : edge[r + 1]].tolist()]
        part = places[at[edge[r]] : at[edge[r + 1]]].astype(np.uint32)
        out.append({"key": r, "chunk": CHUNKS + chunk, "bucket": r, "lengths": _squeezed_numbers(np.fromiter(map(len, own), np.int64, len(own))), "flat": _squeeze(b"".join(own))})
        out.append({"key": CHUNKS + chunk, "bucket": r, "counts": _squeezed_numbers(counts[edge[r] : edge[r + 1]]), "places": _squeezed_numbers(np.diff(part, prepend=np.uint32(0)))})
    return out


def _joined(parts: pa.Table, coded: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's rows and its buckets' answers: doc_ids, pre-tokens of each document, and all ids with where each pre-token's begin."""
    told = next(r for r in parts.select(["ids", "sizes", "nulls"]).to_pylist() if r["ids"] is not None)
    ids = pa.array(np.frombuffer(told["ids"], np.int64), mask=np.frombuffer(told["nulls"], bool))
    sizes = np.frombuffer(told["sizes"], np.int64)
    answers = {r["bucket"]: r for r in coded.to_pylist()}
    places, lengths, first, codes, base = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, "<u4")], 0
    for r in parts.select(["bucket", "counts", "places"]).to_pylist():
        if r["counts"] is not None:
            told = answers[r["bucket"]]
            counts, n_ids, code = _spread_numbers(r["counts"]), _spread_numbers(told["n_ids"]).astype(np.int64), _spread_numbers(told["codes"])
            places.append(np.cumsum(_spread_numbers(r["places"]), dtype=np.uint32).astype(np.int64))
            lengths.append(np.repeat(n_ids, counts))
            first.append(np.repeat(base + np.cumsum(n_ids) - n_ids, counts))
            codes.append(code)
            base += len(code)
    places, codes = np.concatenate(places), np.concatenate(codes)
    width, source = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    width[places], source[places] = np.concatenate(lengths), np.concatenate(first)
    ends = np.cumsum(width)
    flat = codes[np.repeat(source - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, sizes, flat, np.concatenate([[0], ends])


def encode_blocks(docs: DataFrame, result, schema: str, path: str | None = None) -> DataFrame:
    """``result(doc_ids, ids of each document as little-endian unsigned 32-bit arrays)`` of each chunk of ``docs`` (doc_id long, text)."""
    path = path or vocabulary_path()
    n = shuffle_partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK:
                    yield from _rows(SENT, _sent_chunk(chunk, ids, texts, n)).to_batches()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield from _rows(SENT, _sent_chunk(chunk, ids, texts, n)).to_batches()
        del ids, texts
        give_back()

    def encode(sent: pa.Table) -> pa.Table:
        out = []
        if sent.column("key")[0].as_py() < CHUNKS:
            coder, _ = tokenizer(path)
            known: dict[bytes, list[int]] = {}
            for r in sent.select(["chunk", "bucket", "lengths", "flat"]).to_pylist():
                own = []
                for w in _cut_up(_spread(r["flat"]), _spread_numbers(r["lengths"])):
                    code = known.get(w)
                    if code is None:
                        code = known[w] = coder._encode_single_piece(w)
                    own.append(code)
                n_ids, codes = (_squeezed_numbers(np.array(x, np.int64)) for x in ([len(c) for c in own], [x for c in own for x in c]))
                out.append({"key": r["chunk"], "bucket": r["bucket"], "n_ids": n_ids, "codes": codes})
        return _rows(CODED, out)

    def assemble(key, parts: pa.Table, coded: pa.Table) -> pa.Table:
        if key[0].as_py() < CHUNKS:
            return result(pa.array([], pa.int64()), iter(()))
        ids, sizes, flat, starts = _joined(parts, coded)
        cuts = starts[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = result(ids, (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)))
        del flat, starts
        give_back()
        return out

    sent = docs.select("doc_id", "text").mapInArrow(send, _ddl(SENT)).repartition(n, "key")
    coded = sent.groupBy("key").applyInArrow(encode, _ddl(CODED))
    return sent.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(assemble, schema)


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each text."""
    from pyspark.sql import functions as F

    def ids(docs_: pa.Array, codes: Iterator[np.ndarray]) -> pa.Table:
        out = [c.view(np.int32) for c in codes]
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        return pa.table({"doc_id": docs_, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *out])))})

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return encode_blocks(docs, ids, "doc_id long, ids array<int>", path)


def decode_ids(coded: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``coded`` with the bytes of its ids; ids null gives null."""
    from pyspark.sql import functions as F

    path = path or vocabulary_path()

    @F.pandas_udf("binary")
    def decoded(x):
        tokens = tokenizer(path)[1]
        return x.map(lambda v: None if v is None else b"".join(tokens[i] for i in v))

    return coded.withColumn(to, decoded(ids))


def _digests(path: str):
    def run(docs: pa.Array, codes: Iterator[np.ndarray]) -> pa.Table:
        tokens = tokenizer(path)[1]
        n, ids, decoded = [], [], []
        for code in codes:
            n.append(len(code))
            ids.append(hashlib.sha256(code.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, code.tolist()))).hexdigest())
        return pa.table({"doc_id": docs, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return run


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of what they decode to."""
    path = path or vocabulary_path()
    return encode_blocks(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
