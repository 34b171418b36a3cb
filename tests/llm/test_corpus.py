"""The corpus operators against DuckDB, brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from conftest import DATA, duck, plain
from pyspark.sql import functions as F

from postwarden.llm import ann, bpe, grading, language_id, license_scan, line_rules, mixing, near_dedup, registry, substring_dedup, tool_chat

DOC = "doc_id long, text string, lang string, source string, n_chars long, block long, label string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 9, "x") for i, t, s in rows], DOC)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (None, "no id at all " * 8, "b"), (5, "same words here " * 10, "b"), (5, "same words here " * 10, "b"),
    (6, "w" * 20_000, "c"), (7, " ".join(f"v{k}" for k in range(9_000)), "c"), (8, "é漢 \x00 ünï ﬁ 1٢", "c"),
]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert plain(registry.QUERIES[name](spark, DATA).toPandas()) == duck(registry.ORACLES[name])


OPERATORS = {
    "op1": lambda d: line_rules.apply_line_rules(d), "op3": lambda d: license_scan.scan_licenses(d), "op4": lambda d: mixing.mix(d, "doc_id", "text", F.array("source"))[0],
    "op5": lambda d: substring_dedup.substring_dedup(d.select("doc_id", "text"), substring_dedup._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string"),
    "op6": lambda d: near_dedup.near_duplicates(d), "op8": lambda d: bpe.encoded_digests(d), "op10": lambda d: language_id.identify(d),
    "op2": lambda d: grading.grade(d, d.sparkSession.createDataFrame([(4, 1), (5, 2), (7, 0), (6, 2)], "id long, grade int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    """Every row gets a result, whatever is in it; an empty table gives none."""
    found = OPERATORS[name](docs(spark, ODD)).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((r[0] for r in ODD), key=str)
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_line_rules_keep_the_first_holder(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    body = lambda k: " ".join(f"word{letters(k)}x{letters(j)}" for j in range(30))
    rows = [(k, f"Shared banner number {k % 10} of this host\n{body(k)}", "h") for k in range(60)]
    rows += [(100 + k, "only the banner " * 8 + "\nonly the banner " * 2, "h") for k in range(3)]
    found = {r["doc_id"]: r for r in line_rules.apply_line_rules(docs(spark, rows), min_docs=5, max_share=0.05).collect()}
    assert found[0]["n_removed_lines"] == 0 and found[1]["n_removed_lines"] == 1 and found[1]["kept"]
    assert found[100]["base_failed"] and not found[100]["kept"]


@pytest.mark.parametrize("more, removed", [(19, 0), (20, 1)])
def test_line_rules_count_a_repeated_document_once(spark, more, removed):
    """A document in 30 rows is one holder of its lines, and one document of its host."""
    body = lambda k: " ".join(f"word{chr(97 + k)}{chr(97 + j)}" for j in range(25))
    rows = [(0, f"the shared line\n{body(0)}", "h")] * 30 + [(k, f"the shared line\n{body(k)}", "h") for k in range(1, more + 1)]
    found = line_rules.apply_line_rules(docs(spark, rows), max_share=0.9).collect()
    assert len(found) == len(rows) and {r["n_removed_lines"] for r in found if r["doc_id"]} == {removed} and {r["n_removed_lines"] for r in found if not r["doc_id"]} == {0}


def test_repeated_words_by_brute_force(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choice("ab c d".split()) for _ in range(random.randint(0, 60))), "s") for k in range(60)]

    def brute(text):
        w = text.split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)})

    found = {r["doc_id"]: r["n_repeat_words"] for r in line_rules.base_rules(docs(spark, rows)).collect()}
    assert found == {k: brute(t) for k, t, _ in rows}


def test_classifier_orders_grades(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("lmnoprst") for _ in range(5))
    rows, rated = [], []
    for k in range(600):
        g = k % 3
        rows.append((k, " ".join([word() for _ in range(40)] + ["vile"] * (g < 2) + ["###$$$"] * 20 * (g < 1)), "s"))
        rated.append((k, g))
    train = spark.createDataFrame(rated[:400], "id long, grade int")
    found = {r["doc_id"]: r for r in grading.grade(docs(spark, rows), train).collect()}
    held = [(found[k], g) for k, g in rated[400:]]
    assert np.mean([r["kept"] == (g == 2) for r, g in held]) > 0.95
    mean = [np.mean([r["expected_grade"] for r, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_ratings_take_the_lowest(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["id"]: r["grade"] for r in grading.ratings(labels).collect()} == {1: 1, 2: 1, 4: 2}


def test_no_ratings_keep_all(spark):
    found = grading.grade(docs(spark, ODD), spark.createDataFrame([], "id long, grade int")).collect()
    assert all(r["kept"] and r["tail_prob"] is None for r in found)


@pytest.mark.parametrize("text, name", [
    ("x y z\nReleased under the MIT License.\nmore", "mit"), ("licensed under cc-by-nc 4.0", "cc-by-nc-4.0"), ("This work is licensed\nunder the GNU General Public\nLicense, version 3", "gpl-3.0"), ("nothing of the kind here", None),
])
def test_licenses(spark, text, name):
    assert license_scan.scan_licenses(docs(spark, [(1, text, "s")])).first()["license"] == name


def test_licenses_in_longer_lines_and_in_full(spark, tmp_path):
    full = {n: t for n, _, t in license_scan.TEMPLATES + license_scan.LICENCES}
    bsd, rng = full["bsd-3-clause/text"], random.Random(5)
    texts = [
        "We ship it here. Released under the MIT License. See the site for more", f"intro words\n\n{bsd.replace('SPECIAL, ', '')}\n\nmore", full["bsd-2-clause/text"], full["bsd"],
        "x " * 50 + full["mit/full"] + " y" * 60, "the license " * 3000, "of the author " * 40 + "\n" + full["zlib/text"][:300], None, "", "word",
    ]
    for n in sorted(full):  # words lost, doubled and exchanged, inside one long line
        words = full[n].split()
        for share in (0.0, 0.04, 0.12):
            kept = [rng.choice(words) if rng.random() < share else w for w in words if rng.random() >= share / 2]
            texts.append(f"before it {' '.join(kept)} and after it")
    d = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    d.coalesce(1).write.parquet(f"{tmp_path}/documents")
    found = license_scan.scan_licenses(d)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [rows[i]["license"] for i in range(6)] == ["mit", "bsd-3-clause/text", "bsd-2-clause/text", "bsd", "mit/full", None]
    assert plain(found.toPandas()) == duck(license_scan.OP3_SQL, str(tmp_path))


def test_targets_and_flow():
    sizes, weights = {"a": 10, "b": 100, "c": 100, "d": 100}, {"a": 3, "b": 1, "c": 2, "d": 3}
    t = mixing.weighted_targets(sizes, weights)
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(310) and t["c"] == pytest.approx(2 * t["b"])
    # x belongs to both sources; fresh words of p are used before any is repeated
    supply, quotas = {("p",): 100, ("q",): 50, ("p", "q"): 60}, {"p": 130, "q": 70}
    given = mixing.route(supply, quotas)
    best = min(
        (sum(cost(g, s) for g, s in zip(gs, (100, 50, 60), strict=True)), gs)
        for gs in itertools.product(range(0, 301, 10), range(0, 151, 10), range(0, 181, 10))
        if sum(gs) == 200 and gs[0] <= 130 and gs[1] <= 70
    )
    assert sum(given.values()) == 200 and sum(cost(given[k], supply[k]) for k in supply) == best[0]


def cost(words, size):
    return sum(c * max(0, min(size, words - k * size)) for k, c in enumerate(mixing.PASS_COSTS))


def test_mix_meets_targets(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = d.select("doc_id", "source").join(registry.QUERIES["op4_source_mix"](spark, DATA), "doc_id").toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("size", "sum"), told=("source_size", "max"))
    assert (by["size"] == by["told"]).all() and ((by.taken - by.target).abs() <= 0.06 * by.target).all()
    assert (rows.taken <= 3 * rows["size"]).all()
    again = registry.QUERIES["op4_source_mix"](spark, DATA).toPandas()
    assert dict(zip(rows.doc_id, rows.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


@pytest.mark.parametrize("target, copies", [(20_000, 1), (26_000, 1), (39_000, 1), (9_000, 3)])
def test_mix_goes_on_after_a_long_document(spark, target, copies):
    """What no longer fits is left out of the order; the short documents behind it are taken, and repeated rows together."""
    rows = [(k, "w " * 10, "s") for k in range(2000) for _ in range(copies)] + [(5000 + k, "w " * 20_000, "s") for k in range(2)]
    for seed in range(3):
        taken, _ = mixing.mix(docs(spark, rows), "doc_id", "text", F.array("source"), quotas={"s": float(target)}, seed=seed)
        found = taken.collect()
        assert 0 <= target - sum(r["taken"] for r in found) < 10 * copies and max(r["times"] for r in found) <= 3
        assert len({(r["doc_id"], r["times"]) for r in found}) == 2002


def test_overlapping_sources(spark):
    rows = [(k, "w " * 20, "s") for k in range(90)]
    member = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("p"), F.lit("q"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("p"))).otherwise(F.array(F.lit("q")))
    taken, _ = mixing.mix(docs(spark, rows), "doc_id", "text", member, quotas={"p": 900.0, "q": 300.0})
    assert abs(taken.agg(F.sum("taken")).first()[0] - 1200) <= 20


def brute_repeats(rows, span):
    seen, out = {}, {}
    for i, t, _ in rows:
        w = (t or "").split()
        for k in range(len(w) - span + 1):
            g = tuple(w[k : k + span])
            seen[g] = min(seen.get(g, i), i)
    for i, t, _ in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - span + 1) if seen[tuple(w[k : k + span])] < i for j in range(k, k + span)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_substrings_by_brute_force(spark):
    random.seed(11)
    rows, passages = [], [[random.choice("abcdefgh") + str(random.randint(0, 9)) for _ in range(random.randint(13, 70))] for _ in range(6)]
    for k in range(120):
        words = []
        for _ in range(random.randint(0, 5)):
            p = random.choice(passages)
            a = random.randint(0, len(p) - 5)
            words += random.choice([[random.choice("xyz") for _ in range(random.randint(1, 30))], p, p[a : a + random.randint(5, 40)]])
        rows.append((k, " ".join(words), "s"))
    found = substring_dedup.substring_dedup(docs(spark, rows).select("doc_id", "text"), substring_dedup._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    want = {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in brute_repeats(rows, 13).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in found.collect()} == want


def test_extension_by_brute_force():
    """Occurrences of few anchors with few words around them, cut off at the texts' ends."""
    rng = np.random.default_rng(12)
    keys, words, doc = rng.integers(1, 4, 300).astype(np.uint64), rng.integers(1, 3, (300, 8)).astype(np.uint64), rng.integers(0, 50, 300)
    words[:40, 0] = words[20:60, 7] = 0
    found = substring_dedup.extended(keys, words, doc)
    for n in range(5):
        least = {}
        window = lambda i, n=n: (keys[i], *words[i, 4 - n : 8 - n])
        for i in range(300):
            least[window(i)] = min(least.get(window(i), 99), doc[i])
        assert found[:, n].tolist() == [bool(least[window(i)] < doc[i]) for i in range(300)]


@pytest.mark.parametrize("seed", [1, 4, 13])
def test_substrings_with_any_seed(spark, seed):
    """Periodic texts, whose anchors stand in many places of one window, and rows without a doc_id."""
    random.seed(seed)
    rows = [(k, " ".join(["a b"] * random.randint(0, 20) + [random.choice("abc") for _ in range(random.randint(0, 30))]), "s") for k in range(40)]
    found = substring_dedup.substring_dedup(docs(spark, rows + [(None, rows[3][1], "s")]).select("doc_id", "text"), substring_dedup._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string", seed=seed)
    want = {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in brute_repeats(rows, 13).items()}
    got = found.collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got if r["doc_id"] is not None} == want and [r["n_removed"] for r in got if r["doc_id"] is None] == [0]


def test_cut_texts_keep_their_lines(spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, f"first\n{shared}\nend", "s"), (2, f"my own\nlines  here\n{shared}\nlast one", "s"), (3, shared, "s")]
    found = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs(spark, rows), span=50).collect()}
    assert found[1]["text"] == rows[0][1] and found[2]["text"] == "my own\nlines  here\nlast one" and found[2]["n_chars"] == len(found[2]["text"]) and 3 not in found
    spans = {r["doc_id"]: r["repeats"] for r in substring_dedup.repeat_spans(docs(spark, rows), 50).collect()}
    assert [(x["first"], x["end"]) for x in spans[2]] == [(4, 64)]


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_brute_force(spark, width):
    """Groups of copies with few and many edits, most of them near the threshold."""
    random.seed(width)
    rows, k = [], 0
    for _ in range(8):
        base = [f"w{random.randint(0, 400)}" for _ in range(random.randint(20, 120))]
        for _ in range(25):
            words = list(base)
            for _ in range(random.choice([0, 1, 2, 4, 6, 8, 12])):
                words[random.randrange(len(words))] = random.choice(["Alpha", "w7", f"w{random.randint(0, 400)}"])
            rows.append((k, " ".join(words), "s"))
            k += 1
    rows += [(k, "one", "s"), (k + 1, "ONE", "s"), (k + 2, "", "s"), (k + 3, None, "s")]
    found = near_dedup.near_duplicates(docs(spark, rows), width=width).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("twice", ["same text", "two texts"])
def test_near_duplicates_with_repeated_rows(spark, twice):
    """100 and 101 are near copies that meet only in buckets with smaller documents, none of them a near copy; a second row of 100 takes no link."""
    shared = [f"s{k}" for k in range(100)]
    rows = [(p, " ".join(shared + [f"p{p}x{k}" for k in range(16)]), "s") for p in range(60)]
    rows += [(i, " ".join(shared + [f"d{i}x{k}" for k in range(10)]), "s") for i in (100, 101)]
    rows.append(rows[60] if twice == "same text" else (100, " ".join(f"z{k}" for k in range(110)), "s"))
    found = near_dedup.near_duplicates(docs(spark, rows), width=1).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted((i, 100 if i == 101 else i) for i, _, _ in rows)


def test_prefix_filter_loses_no_pair(spark):
    random.seed(2)
    sets = {k: {random.randint(0, 60) for _ in range(random.randint(10, 40))} for k in range(60)}
    for k in range(0, 60, 3):
        sets[k + 1] = set(sets[k]) ^ {random.randint(0, 60) for _ in range(3)}
    live = spark.createDataFrame([(k, k) for k in sets], "rep long, label long")
    table = spark.createDataFrame([(k, bytearray(np.array(sorted(s), np.int64).tobytes())) for k, s in sets.items()], "id long, set binary")
    found = {(r["a"], r["b"]) for r in near_dedup._prefix_pairs(live, table, 80).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= found


def test_components_of_a_long_path(spark):
    from postwarden.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_neighbours_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 16))
    v[200:240] = v[7]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, None), (350, [0.0] * 16), (301, [None] * 16), (302, [float("nan")] * 16), (303, [1.0]), (None, [1.0] * 16)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(unit @ unit[q], 12)
        want = [int(i) for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in found} == set(range(0, 300, 50))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 0


def test_neighbours_of_repeated_queries(spark):
    """Equal query rows are one query: k different neighbours; another vector under the same vec_id is a query of its own."""
    v = np.random.default_rng(2).standard_normal((40, 8))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(0, v[0].tolist())] * 4 + [(0, v[1].tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(rank, int(i)) for q in (0, 1) for rank, i in enumerate((i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i), 1) if rank <= 5]
    assert sorted((r["rank"], r["vec_id"]) for r in found) == sorted(want)


def test_neighbours_of_any_scale_and_length(spark):
    """Components of 1e200 and norms of 1e-200 give the scores of their plain multiples; vectors of another length meet their like; further columns are ignored."""
    rng = np.random.default_rng(3)
    v, short = rng.standard_normal((60, 16)), rng.standard_normal((7, 3))
    scale = [10.0 ** rng.integers(-200, 200) for _ in v]
    rows = [(k, (x * s).tolist(), 1, "x") for k, (x, s) in enumerate(zip(v, scale, strict=True))] + [(100 + k, x.tolist(), 2, "y") for k, x in enumerate(short)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, key string"), F.col("id") % 50 == 0, k=8).collect()
    for at, of, offset in ((0, v, 0), (50, v, 0), (100, short, 100)):
        unit = of / np.linalg.norm(of, axis=1, keepdims=True)
        s = unit @ unit[at - offset]
        want = [int(i) + offset for i in np.argsort(-s) if i != at - offset][:8]
        mine = sorted((r for r in found if r["query_id"] == at), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == want and [r["score"] for r in mine] == pytest.approx([s[i - offset] for i in want], abs=1e-12)


def test_neighbours_pass_no_copies_through_the_driver(spark, monkeypatch):
    """Nothing is broadcast, however small the estimate; several shares of several chunks give the rows of brute force, ties and repeated ids included."""
    v = np.random.default_rng(4).standard_normal((400, 12))
    v[100:140] = v[50]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(50, v[3].tolist()), (7, v[50].tolist())]
    monkeypatch.setattr(ann, "SHARE", 8000, raising=False)
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9), F.col("id") % 50 == 0, k=6)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ids, every = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[q], 12)
        want += [(int(ids[q]), rank, int(ids[i])) for rank, i in enumerate((i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]), 1) if rank <= 6]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == sorted(want)


def test_shares_of_an_index():
    """One a partition where there are chunks enough, and no more vectors in one than a task can hold."""
    vectors = 20_000_000
    assert [ann.shares_for(n, n * 512, 200) for n in (0, 1, 50_000)] == [1, 1, 13]
    assert ann.shares_for(1_000_000, 512_000_000, 200) == 200 and vectors * 512 / ann.shares_for(vectors, vectors * 512, 12) <= ann.SHARE


def test_a_share_is_searched_as_by_brute_force():
    """Bars carried from chunk to chunk bar nothing that belongs to the k best."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.standard_normal((90, 24)), 10, axis=0) + 0.2 * rng.standard_normal((900, 24))
    v[300:330] = v[0]
    ids = rng.permutation(900)
    turned = v @ ann.rotation(24).T
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    codes, f = np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(24)
    chunks = [ann.held_chunk(ids[i : i + n], v[i : i + n], codes[i : i + n], f[i : i + n]) for i, n in ((0, 3), (3, 200), (203, 1), (204, 696))]
    of, near, scores = ann.search_chunks(ids[:40], v[:40], chunks, 5)
    norms = np.sqrt(ann.in_order(v, v))
    for q in range(40):
        s = np.where(ids == ids[q], -2, ann.in_order(v, v[q : q + 1]) / (norms * norms[q]))
        best = np.lexsort((ids, -s))[:5]
        assert near[of == q].tolist() == ids[best].tolist() and scores[of == q].tolist() == s[best].tolist()


@pytest.mark.parametrize("rows, target", [([(1, 40)] * 50, 1531), ([(1, 40)] * 50, 4591), ([(1, 40)] * 50 + [(2, 7)] * 9, 2050), ([(None, 10)] * 30 + [(3, 1000)], 95)])
def test_mix_takes_repeated_rows_one_by_one(spark, rows, target):
    """Rows of one document are taken in any number, evenly, and the gap is smaller than the smallest document."""
    d = docs(spark, [(i, "w " * n, "s") for i, n in rows])
    taken, _ = mixing.mix(d, "doc_id", "text", F.array("source"), quotas={"s": float(target)})
    found = taken.collect()
    assert 0 <= target - sum(r["taken"] for r in found) < min(n for _, n in rows) and all(0 <= r["times"] <= 3 for r in found)
    for key in set(rows):
        times = [r["times"] for r in found if (r["doc_id"], r["size"]) == key]
        assert len(times) == rows.count(key) and max(times) - min(times) <= 1


def test_filling_by_brute_force():
    random.seed(9)
    for _ in range(200):
        offers = [{"size": random.randint(1, 40), "spare": random.randint(0, 6)} for _ in range(random.randint(1, 5))]
        offers.sort(key=lambda c: -c["size"])
        need = random.randint(0, 400)
        sums = {0}
        for c in offers:
            sums = {x + n * c["size"] for x in sums for n in range(c["spare"] + 1)}
        chosen = mixing.filling(offers, need)
        assert sum(c["size"] * n for c, n in chosen) == max(x for x in sums if x <= need) and all(n <= c["spare"] for c, n in chosen)
    assert sum(c["size"] * n for c, n in mixing.filling([{"size": 3, "spare": 10**12}], 10**12)) == 10**12 - 1


def test_bpe_as_the_library_does(spark):
    coder, _ = bpe.tokenizer(bpe.vocabulary_path())
    random.seed(4)
    odd = ["".join(random.choice(" \n\t  \0ab'sé1. \r　漢\x1c") for _ in range(random.randint(0, 40))) for _ in range(300)]
    rows = [(k, t, "s") for k, t in enumerate([*odd, *(t for _, t, _ in ODD if t)])]
    assert all("".join(bpe.words(t)) == t for _, t, _ in rows)
    coded = bpe.encode_texts(docs(spark, rows))
    found = {r["doc_id"]: r for r in bpe.decode_ids(coded).collect()}
    for k, t, _ in rows:
        assert list(found[k]["ids"]) == coder.encode_ordinary(t) and bytes(found[k]["decoded"]).decode() == t
    digests = {r["doc_id"]: r for r in bpe.encoded_digests(docs(spark, rows)).collect()}
    for k, t, _ in rows:
        ids = np.array(coder.encode_ordinary(t), "<u4").tobytes()
        assert digests[k]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and digests[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and digests[k]["n_tokens"] == len(ids) // 4


def merged(token, ranks):
    """Byte pairs merged by rank, the lowest first, the leftmost of equals: what the vocabulary's ranks mean."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_bpe_by_its_ranks(spark):
    """Whole documents against the pattern and an independent merge loop; chunks of few characters give the same."""
    import base64

    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    known = {}
    want = {}
    for i, t in texts.items():
        tokens = bpe.splitter().findall(t or "")
        for w in set(tokens) - known.keys():
            known[w] = merged(w.encode(), ranks)
        want[i] = [x for w in tokens for x in known[w]]
    found = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert found == want
    few = list(texts.items())[:7]
    told = [r for k in range(0, 7, 3) for r in bpe._sent_chunk(k, [i for i, _ in few[k : k + 3]], [t for _, t in few[k : k + 3]], 5)]
    assert sum(r.get("ids") is not None for r in told) == 3 and {r["key"] for r in told if r["key"] < bpe.CHUNKS} == set(range(5))


def chat(spark, rows):
    found = tool_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")).collect()
    return sorted(found, key=lambda r: (str(r["conv_id"]), r["position"]))


def test_tool_calls_are_linked_and_ordered(spark):
    calls = json.dumps({"tool_calls": [{"id": "b", "name": "fetch", "arguments": {"url": {"$result": "a"}}}, {"id": "a", "name": "search", "arguments": {"query": "x", "limit": 2}}, {"id": "c", "name": "search", "arguments": {"limit": "two"}}]})
    result = lambda of: json.dumps({"tool_call_id": of, "content": {"z": 1, "a": "é"}})
    rows = [(1, 0, "user", "go", "k"), (1, 1, "assistant", calls, "k"), (1, 5, "user", "and?", "k"), (1, 2, "tool", result("b"), "k"), (1, 3, "tool", result("a"), "k"), (1, 4, "tool", result("zz"), "k"), (1, 5, "user", "and?", "k")]
    found = chat(spark, rows)
    assert [r["position"] for r in found] == list(range(6)) and found[1]["n_calls"] == 3 and found[1]["n_valid"] == 2 and found[1]["n_answered"] == 2
    states = {json.loads(r["message"]).get("tool_call_id"): r["result_state"] for r in found if r["role"] == "tool"}
    assert states == {"a": "linked", "b": "linked", "zz": "orphan"} and found[-1]["copies"] == 2
    assert [json.loads(r["message"]).get("tool_call_id") for r in found[2:4]] == ["a", "b"]  # b needs a
    assert found[3]["message"] == '{"content":{"a":"é","z":1},"role":"tool","tool_call_id":"b"}'


def called(*calls, **more):
    return json.dumps({"tool_calls": [{"id": i, "name": "fetch", "arguments": {"url": [{"$result": n} for n in needs]}} for i, *needs in calls]} | more)


def test_calls_come_after_results_of_later_turns(spark):
    """b, of turn 1, names the result of a, of turn 3 and answered in turn 5; c names the result of b; z names a result without a call."""
    result = lambda of: json.dumps({"tool_call_id": of, "content": of})
    rows = [(1, 0, "assistant", called(["c", "b"]), "k"), (1, 1, "assistant", called(["b", "a"]), "k"), (1, 2, "tool", result("b"), "k"), (1, 3, "assistant", called(["a"]), "k"), (1, 5, "tool", result("a"), "k"), (1, 6, "user", "and?", "k"), (1, 4, "assistant", called(["z", "o"]), "k"), (1, 7, "tool", result("o"), "k")]
    found = [json.loads(r["message"]) for r in chat(spark, rows)]
    assert [m.get("tool_call_id") or m.get("content") or m["tool_calls"][0]["id"] for m in found] == ["a", "a", "b", "b", "c", "and?", "o", "z"] and found[0]["role"] == "assistant"
    inside = chat(spark, [(1, 0, "assistant", called(["y", "x"], ["x"], ["w", "y"]), "k"), (1, 0, "tool", result("y"), "k"), (1, 0, "tool", result("x"), "k")])
    assert [c["id"] for c in json.loads(inside[0]["message"])["tool_calls"]] == ["x", "y", "w"] and [json.loads(r["message"])["tool_call_id"] for r in inside[1:]] == ["x", "y"]


def test_cycles_end(spark):
    calls = json.dumps({"tool_calls": [{"id": "a", "name": "fetch", "arguments": {"url": {"$result": "b"}}}, {"id": "b", "name": "fetch", "arguments": {"url": {"$result": "a"}}}]})
    frame = spark.createDataFrame([(1, 0, "assistant", calls)], "conv_id long, turn long, role string, text string")
    assert tool_chat.format_chats(frame, most_levels=3).first()["cyclic"]


def test_long_chains_are_no_cycles(spark):
    """70 calls in a chain are in order and on no cycle; of p and q, which need each other, and r, which follows them, only r is not on one."""
    rows = [(1, 100 - k, "assistant", called([f"k{k}", f"k{k - 1}"]), "k") for k in range(70)] + [(1, 100 - k, "tool", json.dumps({"tool_call_id": f"k{k}", "content": k}), "k") for k in range(70)]
    found = chat(spark, rows + [(2, 0, "assistant", called(["p", "q"]), "k"), (2, 1, "assistant", called(["q", "p"]), "k"), (2, 2, "assistant", called(["r", "q"]), "k")])
    assert [r["cyclic"] for r in found] == [False] * 140 + [True, True, False]
    assert [json.loads(r["message"]).get("content") for r in found[:140] if r["role"] == "tool"] == list(range(70))


def test_chats_keep_all_content(spark):
    """Text beside calls, further keys, and calls that can't be linked are kept; the latter are not valid."""
    odd = [{"name": "search", "arguments": {"query": "x"}}, 5, {"id": "a", "type": "function", "name": "search", "arguments": {"query": "x"}}]
    rows = [(1, 0, "assistant", json.dumps({"content": "Let me look", "tool_calls": odd, "role": "bot", "at": 3}), "k"), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1, "is_error": True}), "k"), (1, 2, "assistant", json.dumps({"content": "x", "tool_calls": [None]}), "k")]
    found = chat(spark, rows)
    assert json.loads(found[0]["message"]) == {"role": "assistant", "_role": "bot", "content": "Let me look", "tool_calls": odd, "at": 3}
    assert json.loads(found[1]["message"]) == {"role": "tool", "tool_call_id": "a", "content": 1, "is_error": True} and found[1]["result_state"] == "linked"
    assert json.loads(found[2]["message"]) == {"role": "assistant", "content": "x", "tool_calls": [None]}
    assert [(r["n_calls"], r["n_valid"], r["n_answered"]) for r in found] == [(3, 1, 1), (0, 0, 0), (1, 0, 0)]


def test_odd_chats(spark):
    rows = [(None, 0, "user", "x", "k"), (1, None, None, None, "k"), (1, 0, "assistant", "{not json", "k"), (1, 1, "tool", '{"tool_call_id": 1}', "k"), (1, 2, "assistant", '{"tool_calls": 5}', "k")]
    found = chat(spark, rows)
    assert len(found) == 5 and all(json.loads(r["message"])["role"] for r in found)
    assert chat(spark, []) == []


@pytest.mark.parametrize("value, schema, ok", [
    ({"query": "x"}, tool_chat.SCHEMAS["search"], True), ({}, tool_chat.SCHEMAS["search"], False), ({"query": 1}, tool_chat.SCHEMAS["search"], False), ({"query": "x", "more": 1}, tool_chat.SCHEMAS["search"], False),
    ([1, 2], {"type": "array", "items": {"type": "integer"}}, True), ([1, "2"], {"type": "array", "items": {"type": "integer"}}, False), (True, {"type": "integer"}, False), ("b", {"enum": ["a"]}, False),
])
def test_schemas(value, schema, ok):
    assert tool_chat.fits(value, schema) is ok


SMALL = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "abbab": 6}


def all_ways(text):
    """Every segmentation, as lists of piece ids; 0 for a character that no piece covers."""
    if not text:
        return [[]]
    heads = [(n, SMALL[text[:n]]) for n in range(1, len(text) + 1) if text[:n] in SMALL] + ([(1, 0)] if text[0] not in SMALL else [])
    return [[k, *rest] for n, k in heads for rest in all_ways(text[n:])]


@pytest.mark.parametrize("word", ["ab", "aab", "bab", "b", "abbabcab", "xyz"])
def test_forward_sums_all_segmentations(word):
    chance = np.array([1e-7, 0.2, 0.3, 0.1, 0.2, 0.15, 0.05])
    want = np.log(sum(np.prod(chance[way]) for way in all_ways("▁" + word)))
    assert language_id.word_logs([word], chance[:, None], SMALL)[0, 0] == pytest.approx(want)
    assert language_id._long_log(word, chance[:, None], SMALL)[0] == pytest.approx(want)


def test_words_of_any_length():
    """From 1 to 200 letters, and one of 30,000: plain sums of logarithms agree with both passes."""
    path = language_id.default_path()
    vocabulary = language_id.pieces(path)
    rng = np.random.default_rng(8)
    chance = rng.random((len(vocabulary) + 1, 2)) ** 8
    chance /= chance.sum(axis=0)
    chance[0] = 1e-7
    logs, longest = np.log(chance), max(map(len, vocabulary))

    def brute(word):
        text, ahead = "▁" + word, [np.zeros(2)]
        for j in range(1, len(text) + 1):
            ways = [ahead[i] + logs[k] for i in range(max(0, j - longest), j) if (k := vocabulary.get(text[i:j], 0 if i == j - 1 else None)) is not None]
            ahead.append(np.logaddexp.reduce(ways, axis=0))
        return ahead[-1]

    letters = "relationship professional international the of and straße été 漢"
    words = ["".join(letters[i % len(letters)] for i in range(n, 2 * n)).replace(" ", "") or "a" for n in [*range(1, 200, 3), 30_000]]
    np.testing.assert_allclose(language_id.word_logs(words, chance, vocabulary), [brute(w) for w in words], rtol=1e-9)
    assert longest == max(len(p) for p in vocabulary) and "▁relationship" in vocabulary


def test_learning_is_plain_expectation_maximisation():
    counts = {"ab": 5, "abbab": 3, "b": 2, "ac": 1}
    found = language_id.learn(counts, SMALL, rounds=3)
    chance = np.full(7, 0.05)
    for w, n in counts.items():
        text = "▁" + w
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            k = SMALL.get(text[i:j], 0 if j == i + 1 else None)
            chance[k] += n if k is not None else 0
    for step in range(3):
        if step:
            seen = np.full(7, 0.05)
            for w, n in counts.items():
                ways = all_ways("▁" + w)
                share = np.array([np.prod(chance[way]) for way in ways])
                for way, p in zip(ways, share / share.sum(), strict=True):
                    np.add.at(seen, way, n * p)
            chance = seen
        chance = chance / chance.sum()
        chance[0] = language_id.UNKNOWN
    np.testing.assert_allclose(found, chance, rtol=1e-9)


def test_posteriors_by_brute_force():
    """Texts of repeated, long and odd words; few scores are remembered, so that they are cleared in between."""
    rng, prior = np.random.default_rng(5), np.log([3.0, 1.0, 2.0])
    chance = rng.random((7, 3)) / 7
    scorer = language_id.Scorer(chance, prior, SMALL)
    scorer.logs = scorer.logs[:5]
    random.seed(6)
    texts = [" ".join("".join(random.choice("aAbBcé") for _ in range(random.choice([1, 3, 90]))) for _ in range(random.randint(1, 8))) for _ in range(40)] + [None, "½ ² 12_"]
    for group in ([t] for t in texts):
        (found,) = scorer.posteriors(group)
        words = [w for w in (group[0] or "").lower().split() if w.isalpha()]
        if not words:
            assert found is None
            continue
        total = prior + language_id.word_logs(words, chance, SMALL).sum(axis=0)
        np.testing.assert_allclose(found, np.exp(total - total.max()) / np.exp(total - total.max()).sum(), rtol=1e-9)


def test_languages_held_out(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) and (found.lang_pred == found.lang).mean() > 0.9 and found.score.between(0, 1).all()


def test_language_of_nothing(spark):
    found = {r["doc_id"]: r for r in language_id.identify(docs(spark, [(1, None, "s"), (2, "123 !", "s"), (5, "½ ²", "s"), (3, "the words of it " * 9, "s"), (4, "and more of the same " * 9, "s")])).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[5]["lang_pred"] == "und" and found[1]["score"] == 0.0


def test_pipeline(spark):
    import corpus_pipeline as cp
    from postwarden.llm.common import stored

    docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs_]
    for _, stage in cp.STAGES:
        frames.append(stored(stage(spark, frames[-1], DATA)))
    assert all(f.columns == docs_.columns for f in frames[:-1])
    graded = {r["doc_id"] for r in grading.grade(docs_, grading.ratings(spark.read.parquet(f"{DATA}/labels.parquet"))).where("kept").collect()}
    assert {r["doc_id"] for r in frames[1].collect()} == graded
    rows = [(r["doc_id"], r["text"], r["source"]) for r in frames[1].collect()]
    firsts = {i for i, c in brute_components(rows, 5).items() if i == c}
    assert {r["doc_id"] for r in frames[2].collect()} == firsts
    left = brute_repeats([r for r in rows if r[0] in firsts], 50)
    assert {r["doc_id"]: r["text"].split() for r in frames[3].collect()} == {i: w for i, w in left.items() if w or not dict((a, b) for a, b, _ in rows)[i].split()}
    assert frames[4].select("doc_id").distinct().join(frames[3].select("doc_id"), "doc_id", "left_anti").count() == 0
    coder, _ = bpe.tokenizer(bpe.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    assert frames[5].count() == frames[4].count() and all(r["n_tokens"] == len(coder.encode_ordinary(texts[r["doc_id"]])) for r in frames[5].collect())


STAGE_COLUMNS = "_id long, _p string, _n long, _times long, _copy long, _gone long, row long, id long, copies long, many long, times long, at long, size long, pattern string"


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tmp_path, k):
    """Clashing columns are kept, empty tables give empty results, and odd rows have the results that the stage's text names."""
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{j % 977}x{j}" for j in range(300_000))  # some 4 MB
    shared = " ".join(f"s{j}" for j in range(60))
    rows = [*ODD, (20, long, "c"), (21, long, "c"), (22, shared, "a"), (23, f"begin {shared} end", None), (23, f"begin {shared} end", None)]
    extra = [f"{k}: {t}" for k, t in (c.split() for c in STAGE_COLUMNS.split(", "))]
    d = docs(spark, rows)
    for name, kind in (c.split(": ") for c in extra):
        d = d.withColumn(name, F.lit(7).cast(kind))
    stage = cp.STAGES[k][1]
    found = stage(spark, d, str(tmp_path)).collect()
    assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    ids = sorted((r["doc_id"] for r in found), key=str)
    every = sorted((r[0] for r in rows), key=str)
    if k < 4:
        assert all(list(r.asDict()) == d.columns and r["_copy"] == 7 and r["pattern"] == "7" for r in found)
    texts = {(r["doc_id"], r["text"]) for r in found} if k < 4 else set()
    if k == 0:  # one rated document, which passes: nothing is told against any word
        assert ids == sorted((i for i, t, _ in rows if (t or "").split()), key=str)
    elif k == 1:
        assert ids == sorted((i for i in every if i != 21 and i != 23), key=str)
        assert (20, long) in texts and (5, ODD[5][1]) in texts
    elif k == 2:
        assert ids == sorted((i for i in every if i != 21), key=str) and (23, "begin end") in texts and (5, ODD[5][1]) in texts
    elif k == 3:
        assert {i for i in ids} <= set(every) and not {1, 2, 3} & set(ids) and all(ids.count(i) <= 3 * every.count(i) for i in set(ids))
    else:
        tokens = {(r["doc_id"], r["n_tokens"]) for r in found}
        assert ids == every and {(1, 0), (2, 0)} <= tokens and {r["decoded_sha256"] for r in found if r["doc_id"] == 20} == {hashlib.sha256(long.encode()).hexdigest()}
