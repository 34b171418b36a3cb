"""Mixing sources to target weights by min-cost flow over membership patterns.

1. Documents are aggregated by membership pattern (the sorted set of sources they belong to).
2. The driver routes words from patterns to source quotas. A pattern offers its words once
   at cost 1, a second time at cost 2 and a third time at cost 4: repeating costs more with
   each pass, so the flow uses fresh words first. Only the patterns' sums come to the driver;
   more than ``max_patterns`` of them is an error, not a cut.
3. A pattern that is to give F of its S words takes every document F // S times, and one more
   time those that come first in a seeded order, until F is reached. The cut in that order is
   found from three histograms of 1024 bins of the order's key, so no pattern is sorted or
   gathered in one task. Where the order stops at documents that no longer fit, those larger
   than what is missing are left out and the order goes on with the rest, to its end, and then
   with repeats. After each cut one document of each size class is offered, new ones before
   repeats, and the offers whose sizes add up closest to what is missing fill the last gap;
   cuts end when less is missing than the smallest document that may still be taken.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; repeated rows (of one document and size; without a doc_id, of one size) count one
by one and are taken one by one: the order takes all of them or none, the last gap may be filled
with any number of them, dealt out evenly; empty tables give empty results; further columns, of
whatever names, are ignored or kept. The result depends on the rows and the seed alone.
"""

from __future__ import annotations

import functools
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, stored, table

#: Costs of taking a pattern's words the first, second and third time.
PASS_COSTS = (1, 2, 4)
#: The order's key has LEVELS digits of BINS values each.
BINS, LEVELS = 1024, 3
END = BINS**LEVELS
STEPS = "steps array<struct<start: long, stop: long, most: long>>"
SEED = 17


def weighted_targets(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total, left, capped = float(sum(sizes.values())), set(sizes), {}
    while left:
        rest, w = total - sum(capped.values()), sum(weights[k] for k in left)
        share = {k: rest * weights[k] / w for k in left}
        over = {k for k in left if share[k] > most * sizes[k]}
        if not over:
            return {k: float(share.get(k, capped.get(k, 0.0))) for k in sizes}
        capped |= {k: float(most * sizes[k]) for k in over}
        left -= over
    return {k: capped[k] for k in sizes}


def route(supply: dict[tuple, int], quotas: dict, costs: tuple = PASS_COSTS) -> dict[tuple, int]:
    """Words that each pattern gives to its sources in a flow of largest value and least cost.

    Successive shortest paths with node potentials left out: the graph has one node a pattern
    and a source, and few distinct costs, so each path is found by queue-based relaxation.
    """
    names, arcs, graph = {}, [], {}

    def node(key) -> int:
        return names.setdefault(key, len(names))

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph.setdefault(x, []).append(len(arcs))
            arcs.append([y, r, c])

    start, end = node("start"), node("end")
    for p in sorted(supply, key=repr):
        for cost in costs:
            arc(start, node(("p", p)), supply[p], cost)
        for s in p:
            arc(node(("p", p)), node(("s", s)), supply[p] * len(costs), 0)
    for s in sorted(quotas, key=repr):
        arc(node(("s", s)), end, quotas[s], 0)
    while True:
        best, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for k in graph.get(x, ()):
                y, room, cost = arcs[k]
                if room > 0 and best[x] + cost < best.get(y, 1 << 60):
                    best[y], via[y] = best[x] + cost, k
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        if end not in via:
            break
        path, y = [], end
        while y != start:
            path.append(via[y])
            y = arcs[via[y] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room
    given = {p: 0 for p in supply}
    for p in supply:
        for k in graph.get(names[("p", p)], ()):
            if k % 2 and arcs[k][0] == start:
                given[p] += arcs[k][1]
    return given


def _pattern_frame(spark, rows: list[tuple], fields: str) -> DataFrame:
    return spark.createDataFrame(rows, f"at array<string>, {fields}")


def filling(offers: list, need: int, most: int = 1 << 18) -> list[tuple]:
    """(offer, copies) that come closest to ``need`` from below: largest first while it is over ``most``, then by subset sums."""
    chosen, items = {}, []
    for k, c in enumerate(offers):
        taken = min(c["spare"], max(0, need - most + c["size"] - 1) // c["size"], need // c["size"])
        if taken:
            chosen[k] = taken
            need -= taken * c["size"]
        left, part = min(c["spare"] - taken, need // c["size"]), 1
        while left > 0:  # 1, 2, 4, ... copies at once make up any number
            items.append((k, min(part, left)))
            left, part = left - part, 2 * part
    reached = [1]
    for k, n in items:
        reached.append(reached[-1] | (reached[-1] << n * offers[k]["size"]) & ((2 << need) - 1) if need <= most else 1)
    total = reached[-1].bit_length() - 1
    for (k, n), before in zip(reversed(items), reversed(reached[:-1]), strict=True):
        if not before >> total & 1:
            chosen[k] = chosen.get(k, 0) + n
            total -= n * offers[k]["size"]
    return [(offers[k], n) for k, n in chosen.items()]


def _edges(sized: DataFrame, live: dict[tuple, tuple[int, int]]) -> dict[tuple, tuple[int, int]]:
    """For patterns with (start, need): the first place of the order, from start on, where what fits ``need`` no longer fits the rest, and that rest."""
    rest, edge, ends = {p: need for p, (_, need) in live.items()}, dict.fromkeys(live, 0), {}
    for level in range(LEVELS):
        at = _pattern_frame(sized.sparkSession, [(list(p), *live[p], edge[p]) for p in edge], "start long, most long, edge long")
        part = sized.join(F.broadcast(at), _same("pattern", F.col("at"))).where((F.col("size") > 0) & (F.col("size") * F.col("many") <= F.col("most")) & (F.col("u") >= F.col("start")))
        if level:
            part = part.where(F.shiftright("u", 10 * (LEVELS - level)) == F.col("edge"))
        at_bin = F.shiftright("u", 10 * (LEVELS - 1 - level)).bitwiseAND(BINS - 1).alias("bin")
        bins: dict[tuple, dict[int, int]] = {p: {} for p in edge}
        for r in part.groupBy("pattern", at_bin).agg(F.sum("size").alias("words")).collect():  # at most BINS rows a pattern
            bins[tuple(r["pattern"])][r["bin"]] = r["words"]
        for p in list(edge):
            k = 0
            while k < BINS and rest[p] >= bins[p].get(k, 0):
                rest[p] -= bins[p].get(k, 0)
                k += 1
            edge[p] = edge[p] * BINS + k
            if k == BINS:  # nothing that fits is left in the order
                ends[p] = END
                del edge[p]
        if not edge:
            break
    return {p: (ends.get(p, edge.get(p)), rest[p]) for p in live}


def _in_steps() -> Column:
    """How often the order takes a row: the steps of its pattern that it lies in and that it fits, with the rows that equal it."""
    return F.size(F.filter("steps", lambda s: (F.col("u") >= s["start"]) & (F.col("u") < s["stop"]) & (F.col("size") * F.col("many") <= s["most"])))


def _offers(sized: DataFrame, state: list[tuple]) -> dict[tuple, tuple[list, int]]:
    """By pattern, one document of each size class that still fits, new ones before repeats, and the words of the smallest."""
    at = _pattern_frame(sized.sparkSession, state, f"whole long, need long, {STEPS}")
    part = sized.join(F.broadcast(at), _same("pattern", F.col("at"))).withColumn("more", _in_steps())
    spare = ((len(PASS_COSTS) - F.col("whole") - F.col("more")) * F.col("many")).alias("spare")
    fits = part.where((F.col("size") > 0) & (F.col("size") <= F.col("need")) & (spare > 0))
    one = F.struct("size", "u", "pick", spare)
    classes = fits.groupBy("pattern", F.floor(8 * F.log2("size")).alias("class")).agg(F.min_by(one, F.struct("more", "u", "pick", "size")).alias("c"), F.min("size").alias("least"))
    found: dict[tuple, tuple[list, int]] = {}
    for r in sorted(classes.collect(), key=lambda r: (-r["c"]["size"], r["c"]["u"])):  # at most some 300 classes a pattern
        offers, least = found.get(tuple(r["pattern"]), ([], r["least"]))
        found[tuple(r["pattern"])] = [*offers, r["c"]], min(least, r["least"])
    return found


def select_documents(sized: DataFrame, given: dict[tuple, int], supply: dict[tuple, int]) -> DataFrame:
    """``sized`` (pattern, size, many, u, pick) with ``copies``, how often each row and those that equal it, ``many`` in all, are taken together."""
    spark = sized.sparkSession
    whole = {p: given[p] // supply[p] if supply[p] else 0 for p in supply}
    need = {p: given[p] - whole[p] * supply[p] for p in supply}
    steps: dict[tuple, list] = {p: [] for p in supply}
    best = {p: (need[p], [], []) for p in supply}  # what is missing, steps and fill of the closest choice so far
    live = {p: (0, 0) for p in supply if need[p] > 0}  # extra copies already offered, start in the order
    while live:
        cuts = _edges(sized, {p: (start, need[p]) for p, (_, start) in live.items()})
        for p, (stop, rest) in cuts.items():
            layer, start = live[p]
            steps[p] = [*steps[p], (start, stop, need[p])]
            # a place whose documents fit one by one, but not together, is passed over
            live[p] = (layer + 1, 0) if stop == END else (layer, stop + (rest == need[p]))
            need[p] = rest
        offered = _offers(sized, [(list(p), whole[p], need[p], steps[p]) for p in live])
        for p in list(live):
            offers, least = offered.get(p, ([], 0))
            fill = filling(offers, need[p])
            gap = need[p] - sum(c["size"] * n for c, n in fill)
            if gap < best[p][0]:
                best[p] = gap, steps[p], fill
            if not offers or gap < least or whole[p] + live[p][0] >= len(PASS_COSTS):
                del live[p]
    at = _pattern_frame(spark, [(list(p), whole[p], best[p][1]) for p in supply], f"whole long, {STEPS}")
    part = sized.join(F.broadcast(at), _same("pattern", F.col("at"))).drop("at")
    picks = [(list(p), c["u"], c["pick"], c["size"], n) for p in supply for c, n in best[p][2]]
    extra = spark.createDataFrame(picks, "of array<string>, fill_u long, fill_pick long, fill_size long, fill long")
    mine = _same("pattern", F.col("of")) & (F.col("u") == F.col("fill_u")) & (F.col("pick") == F.col("fill_pick")) & (F.col("size") == F.col("fill_size"))
    out = part.withColumn("more", _in_steps() + F.lit(0)).join(F.broadcast(extra), mine, "left")
    copies = (F.col("whole") + F.col("more")) * F.col("many") + F.coalesce("fill", F.lit(0))
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")).drop("whole", "steps", "more", "of", "fill_u", "fill_pick", "fill_size", "fill")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``times``: the ``copies`` of a key dealt out evenly to its ``many`` rows, the rest to some of them.

    Rows are counted off in two steps, inside the partitions in which they stand (``at``) and over
    these, so that a key with very many rows is not gathered in one task.
    """
    if "at" not in rows.columns:
        rows = rows.withColumn("at", F.spark_partition_id())
    even = rows.where("copies % many = 0").withColumn("times", F.expr("copies div many")).drop("at")
    odd = stored(rows.where("copies % many <> 0"))
    if odd.isEmpty():
        return even
    inside = Window.partitionBy(*key, "at").orderBy(F.lit(0))
    earlier = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = odd.groupBy(*key, "at").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"of_{k}") for k in (*key, "at")], "before")
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in (*key, "at")])
    numbered = odd.withColumn("k", F.row_number().over(inside)).join(counts, same)
    times = F.expr("copies div many") + (F.col("k") + F.col("before") <= F.expr("copies % many")).cast("long")
    return even.unionByName(numbered.withColumn("times", times).select(*even.columns))


def _same(pattern: str, other: Column) -> Column:
    return F.col(pattern).eqNullSafe(other)


def mix(docs: DataFrame, doc_id: str, text: str, members: Column, weights=None, quotas=None, seed: int = SEED, max_patterns: int = 20_000) -> DataFrame:
    """One row a document: doc_id, members, size, times and taken (words), copies and many of its equal rows, and the sources' table.

    ``members`` is the array of a document's sources. ``weights(names)`` gives each source's
    weight; ``quotas`` may set the words of each source instead.
    """
    pattern = F.array_sort(F.array_distinct(members))
    rows = docs.select(F.col(doc_id).alias("doc_id"), pattern.alias("pattern"), count_words(F.col(text)).alias("size"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "size")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    sized = stored(rows.select("*", own.bitwiseAND(END - 1).alias("u"), F.shiftright(own, 30).alias("pick")))
    again = sized.groupBy("pattern", "u", "pick", "size").agg(F.count("*").alias("many")).where("many > 1")
    again = stored(again.select(F.col("pattern").alias("of"), F.col("u").alias("u2"), F.col("pick").alias("pick2"), F.col("size").alias("size2"), "many"))
    if again.isEmpty():
        sized = sized.withColumn("many", F.lit(1).cast("long"))
    else:
        same = _same("pattern", F.col("of")) & (F.col("u") == F.col("u2")) & (F.col("pick") == F.col("pick2")) & (F.col("size") == F.col("size2"))
        sized = stored(sized.join(again, same, "left").select(*sized.columns, F.coalesce("many", F.lit(1)).alias("many")))
    sums = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    supply = {tuple(r["pattern"]): r["words"] for r in sums}
    names = sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in supply.items() if s in p) for s in names}
    if quotas is None:
        quotas = weighted_targets(sizes, (weights or repeating_weights)(names))
        grand = sum(supply.values())
        scale = grand / (sum(sizes.values()) or 1)  # words of several sources count once
        quotas = {s: q * scale for s, q in quotas.items()}
    given = route(supply, {s: round(q) for s, q in quotas.items()})
    out = dealt(select_documents(sized, given, supply) if supply else sized.withColumn("copies", F.lit(0).cast("long")), "pattern", "u", "pick", "size")
    shown = docs.sparkSession.createDataFrame([(s, sizes[s], float(quotas[s])) for s in names], "member string, source_size long, target double")
    return out.withColumn("taken", F.col("times") * F.col("size")), shown


def repeating_weights(names: list) -> dict:
    """1, 2, 3, 1, ... along the names in order."""
    return {s: 1 + i % 3 for i, s in enumerate(names)}


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, its source's size and target, words taken and how often."""
    taken, sources = mix(table(spark, sf_dir, "documents"), "doc_id", "text", F.array("source"))
    sources = F.broadcast(sources)  # at most max_patterns names
    return (
        taken.join(sources, F.col("pattern")[0].eqNullSafe(F.col("member")), "left")
        .select("doc_id", "size", "source_size", "target", "taken", "times")
    )


def taken_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, columns unchanged."""
    taken, _ = mix(docs, doc_id, text, F.array(source))
    chosen = taken.groupBy(F.col("doc_id").alias("id"), F.col("pattern").alias("of"), F.col("size").alias("words")).agg(F.max("copies").alias("copies"), F.max("many").alias("many")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.array(source).alias("pattern"), count_words(F.col(text)).alias("size"), F.spark_partition_id().alias("at"))
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & _same("pattern", F.col("of")) & (F.col("size") == F.col("words")))
    rows = dealt(rows.select("row", "doc_id", "pattern", "size", "copies", "many", "at"), "doc_id", "pattern", "size")
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
