"""Redaction and pages are made by pieces: memory does not grow with a batch, rows stay in order."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postwarden.functions import markup, pieces, redaction

WORDS = "call +44 20 7946 0000 or write to me@x.example, see https://x.example/a/b/c?d=1 "
PAGES = '<p>some text</p><a href="https://x.example/a">a link</a><img src="x.png"> '


@pytest.fixture
def made(monkeypatch):
    """Which functions a column's batches go to: what a worker would run, run here."""
    found = []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: found.append(f) or (lambda *columns: None))
    return found


def peak(f, batch: pa.Array) -> tuple[int, int]:
    """The rows that come back, and the largest MB that Python held at once meanwhile."""
    tracemalloc.start()
    try:
        rows = sum(len(x) for x in f(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_redaction_holds_a_piece_of_a_batch(spark, made):
    redaction.redacted("text")
    rows, mb = peak(made[0], pa.array([f"{k} {WORDS * 50}" for k in range(1000)]))
    assert rows == 1000 and mb < 3  # texts and results of all rows: 7 MB


def test_redaction_by_pieces_is_that_of_each_row(spark):
    texts = [None if k % 11 == 0 else "" if k % 7 == 0 else f"{k} {WORDS}" * (3500 if k == 500 else k % 5) for k in range(1300)]
    owns = [None if k % 3 else "me@x.example" for k in range(1300)]
    rows = spark.createDataFrame([*zip(range(1300), texts, owns, strict=True)], "k int, text string, own string").coalesce(1)
    found = rows.select("k", redaction.redacted("text").alias("plain"), redaction.redacted("text", "own").alias("own"), redaction.redacted(F.lit("7654321")).alias("same")).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(k, redaction.redact(t), redaction.redact(t, o), "[NUMBER]") for k, (t, o) in enumerate(zip(texts, owns, strict=True))]
    assert rows.limit(0).select(redaction.redacted("text")).collect() == []


def test_pieces_end_by_rows_or_characters():
    batches = [(pa.array(["x"] * 1200),), (pa.array([], pa.string()),), (pa.array(["y" * pieces.MOST_CHARS, None, "z"]),)]
    assert [len(x) for x in pieces.results(iter(batches), str, pa.string())] == [500, 500, 200, 1, 2]


def test_pages_hold_a_piece_of_a_batch(spark, made):
    markup.page("html")
    rows, mb = peak(made[0], pa.array([f"{k} {PAGES * 20}" for k in range(700)]))
    assert rows == 700 and mb < 5


def test_pages_by_pieces_are_those_of_each_row(spark):
    html = [None if k % 11 == 0 else "" if k % 7 == 0 else f"<h1>{k}</h1>{PAGES}" * (4000 if k == 500 else k % 5) for k in range(1300)]
    rows = spark.createDataFrame([*enumerate(html)], "k int, html string").coalesce(1)
    found = rows.select("k", markup.page("html").alias("p")).orderBy("k").collect()
    assert [r.p.asDict(recursive=True) for r in found] == [markup.read(h) for h in html]
