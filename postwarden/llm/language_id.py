"""Language ID by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. A text is its runs of
letters in lower case, each with a word mark in front; the probability of a word in a
language is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities (a forward pass), and a text's is the product over its words. The language of
the largest posterior wins; the score is that posterior. Pieces and words may have any length:
the pass looks back as far as the vocabulary's longest piece and is rescaled on the way.

Piece probabilities are learned per language by expectation-maximisation (forward and
backward passes over distinct words), from documents outside the held-out fifth only. Learning,
not scoring, has documented bounds: a seeded sample of about ``per_lang`` documents a language,
and of their words of up to SHORT letters the ``most_words`` most frequent.

Defined cases: null texts and texts without a letter (``str.isalpha``) are ``und`` with score 0,
and so is everything if nothing can be learned; equal posteriors go to the first language by code
point; a null doc_id is not held out and not learned from; rows are independent; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

VOCABULARY = "piece_bpe_32k.model"
PER_LANG, MOST_WORDS, MOST_LANGS, ROUNDS = 1500, 100_000, 500, 3
UNKNOWN = 1e-7
#: Words of up to SHORT letters are passed over many at a time; each letter's factor LIFT keeps their sums far from a double's ends.
SHORT, LIFT = 64, 1e3
#: Bytes of remembered scores in a worker, and characters of texts that are scored together.
REMEMBERED, TOGETHER = 64 << 20, 2_000_000
_RUNS = re.compile(r"[^\W\d_]+")
_PIECES: dict[str, dict[str, int]] = {}


def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of text, from 1; 0 stands for a character that no piece covers."""
    if path not in _PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        _PIECES[path] = {p: i for i, p in enumerate(plain, 1)}
    return _PIECES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def words_of_text(text: str) -> Counter:
    """How often each run of letters stands in a text, in lower case."""
    found = Counter(_RUNS.findall(text.lower()))
    for run in [w for w in found if not w.isalpha()]:  # the pattern takes numerals such as fractions along
        n = found.pop(run)
        for w in "".join(c if c.isalpha() else " " for c in run).split():
            found[w] += n
    return found


def _longest(vocabulary: dict[str, int]) -> int:
    return max(map(len, vocabulary), default=1)


def _lattices(words: list[str], vocabulary: dict[str, int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """For words of one length: their numbers and the ids [word, end, length] of the pieces that end there, -1 for none."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(k)
    get, longest = vocabulary.get, _longest(vocabulary)
    for n, numbers in by_length.items():
        reach = min(n, longest)
        spans = [(j - k, j) for k in range(1, reach + 1) for j in range(k, n + 1)]
        at = (np.array([b - 1 for _, b in spans]), np.array([b - a - 1 for a, b in spans]))
        for i in range(0, len(numbers), 2048):
            part = numbers[i : i + 2048]
            ids = np.full((len(part), n, reach), -1, np.int32)
            ids[:, at[0], at[1]] = [[get(m[a:b], -1) for a, b in spans] for m in ("▁" + words[k] for k in part)]
            single = ids[:, :, 0]
            single[single < 0] = 0
            yield part, ids


def lifted(chance: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """Chances [piece, language] times LIFT for each letter, and a row of zeros for the id -1."""
    lengths = np.ones(len(chance))
    lengths[list(vocabulary.values())] = list(map(len, vocabulary))
    return np.vstack([chance * (LIFT**lengths)[:, None], np.zeros((1, chance.shape[1]))])


def _forward(ids: np.ndarray, padded: np.ndarray) -> list[np.ndarray]:
    ahead = [np.ones((len(ids), padded.shape[1]))]
    for j in range(ids.shape[1]):
        total = np.zeros_like(ahead[0])
        for k in range(min(ids.shape[2], j + 1)):
            at = ids[:, j, k]
            if (at >= 0).any():
                total += ahead[j - k] * padded[at]
        ahead.append(total)
    return ahead


def _long_log(word: str, chance: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """Log probability [language] of one word of any length; only the last sums are held, divided by the newest."""
    text, longest, get = "▁" + word, _longest(vocabulary), vocabulary.get
    last, log = np.zeros((longest, chance.shape[1])), np.zeros(chance.shape[1])  # the sums up to each of the last places, by place modulo longest
    last[0] = 1.0
    for j in range(1, len(text) + 1):
        found = [(i, k) for i in range(max(0, j - longest), j) if (k := get(text[i:j], 0 if i == j - 1 else -1)) >= 0]
        total = (last[[i % longest for i, _ in found]] * chance[[k for _, k in found]]).sum(axis=0)
        last[j % longest] = total
        last /= total
        log += np.log(total)
    return log


def word_logs(words: list[str], chance: np.ndarray, vocabulary: dict[str, int]) -> np.ndarray:
    """Log probability [word, language] over all segmentations."""
    logs = np.zeros((len(words), chance.shape[1]))
    short, padded = [k for k, w in enumerate(words) if len(w) <= SHORT], lifted(chance, vocabulary)
    for numbers, ids in _lattices([words[k] for k in short], vocabulary):
        logs[[short[k] for k in numbers]] = np.log(_forward(ids, padded)[-1]) - ids.shape[1] * np.log(LIFT)
    for k, w in enumerate(words):
        if len(w) > SHORT:
            logs[k] = _long_log(w, chance, vocabulary)
    return logs


def learn(counts: dict[str, int], vocabulary: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its counts of words of up to SHORT letters, by expectation-maximisation."""
    words = sorted(w for w in counts if len(w) <= SHORT)
    n, lattices = len(vocabulary) + 1, [(np.array([counts[words[k]] for k in part], np.float64), ids) for part, ids in _lattices(words, vocabulary)]
    chance = None
    for _ in range(rounds):
        seen = np.full(n, 0.05)
        if chance is None:  # every piece found anywhere counts
            for w, ids in lattices:
                seen += np.bincount(ids[ids >= 0], np.broadcast_to(w[:, None, None], ids.shape)[ids >= 0], minlength=n)
        else:
            padded = lifted(chance[:, None], vocabulary)
            for w, ids in lattices:
                ahead = [x[:, 0] for x in _forward(ids, padded)]
                length, reach = ids.shape[1:]
                back = [np.zeros(len(ids)) for _ in range(length)] + [np.ones(len(ids))]
                for j in range(length - 1, -1, -1):
                    for k in range(min(reach, j + 1)):
                        at = ids[:, j, k]
                        through = padded[at, 0] * back[j + 1]
                        seen += np.bincount(np.maximum(at, 0), np.where(at >= 0, w * ahead[j - k] * through / ahead[-1], 0.0), minlength=n)
                        back[j - k] += through
        chance = seen / seen.sum()
        chance[0] = UNKNOWN
    return chance


class Scorer:
    """Posterior of each language for texts; short words' scores are remembered up to a bound."""

    def __init__(self, chance: np.ndarray, prior: np.ndarray, vocabulary: dict[str, int]):
        self.chance, self.prior, self.vocabulary = chance, prior, vocabulary
        self.known: dict[str, int] = {}
        self.logs = np.empty((max(1024, REMEMBERED // (8 * len(prior))), len(prior)))

    def _learn_words(self, counts: list[Counter]) -> None:
        fresh = {w for c in counts for w in c if w not in self.known and len(w) <= SHORT}
        if len(self.known) + len(fresh) > len(self.logs):
            self.known = {}
            fresh = {w for c in counts for w in c if len(w) <= SHORT}
            if len(fresh) > len(self.logs):
                self.logs = np.empty((len(fresh), len(self.prior)))
        fresh, first = sorted(fresh), len(self.known)
        if fresh:
            self.logs[first : first + len(fresh)] = word_logs(fresh, self.chance, self.vocabulary)
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def posteriors(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """None for a text without a letter."""
        counts = [words_of_text(t or "") for t in texts]
        self._learn_words(counts)
        for c in counts:
            if not c:
                yield None
                continue
            total = self.prior.copy()
            for w in [w for w in c if len(w) > SHORT]:
                total += c.pop(w) * _long_log(w, self.chance, self.vocabulary)
            if c:
                total += np.fromiter(c.values(), np.float64, len(c)) @ self.logs[np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))]
            odds = np.exp(total - total.max())
            yield odds / odds.sum()


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in groups of about TOGETHER characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def train(docs: DataFrame, per_lang: int, path: str, most_words: int = MOST_WORDS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, chances [piece, language], log priors) from ``docs`` of doc_id, text and lang."""
    use = docs.where("text is not null and lang is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    sizes = use.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    some = use.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of_text(text))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items() if len(w) <= SHORT]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def learned(t: pa.Table) -> pa.Table:
        counts = dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True))
        return pa.table({"lang": t.column("lang").slice(0, 1), "chance": pa.array([learn(counts, pieces(path)).tobytes()], pa.binary())})

    counts = some.select("text", "lang").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts = counts.withColumn("rank", F.row_number().over(common)).where(F.col("rank") <= most_words).drop("rank")
    rows = {r["lang"]: np.frombuffer(r["chance"]) for r in counts.groupBy("lang").applyInArrow(learned, "lang string, chance binary").collect()}
    if not rows:
        return None
    langs = sorted(rows)
    known = {r["lang"]: r["count"] for r in sizes}
    prior = np.log(np.array([known[x] for x in langs], float))
    return langs, np.stack([rows[x] for x in langs], axis=1), prior


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, path: str | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred and score."""
    path = path or default_path()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    model = train(docs, per_lang, path)
    if model is None:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, at most MOST_LANGS

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, chance, prior = shared.value
        scorer = Scorer(chance, prior, pieces(path))
        for batch in batches:
            best, score = [], []
            for group in _together(batch.column(2).to_pylist()):
                for odds in scorer.posteriors(group):
                    best.append("und" if odds is None else langs[int(odds.argmax())])
                    score.append(0.0 if odds is None else float(odds.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held, "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
