"""Order of random call graphs by brute force, and JSON that other parsers refuse."""

import json
import random

from postwarden.llm import tool_chat


def formatted(spark, rows):
    found = tool_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return sorted(found, key=lambda r: (r["conv_id"], r["position"]))


def brute_order(rows):
    """(order of rows by place and level, ids of calls on a cycle) of one conversation, by fixpoints over the whole graph."""
    messages = [json.loads(t) if r != "user" else {} for _, _, r, t in rows]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][1]):
        for c in messages[k].get("tool_calls", ()):
            first.setdefault(c["id"], (k, [x["$result"] for x in c["arguments"]["url"]]))
    named_too = first.keys() | {m["tool_call_id"] for m in messages if "tool_call_id" in m}
    need, own = {}, {k: rows[k][1] for k in range(len(rows))}
    for k, m in enumerate(messages):
        if "tool_calls" in m:
            for c in m["tool_calls"]:
                need.setdefault(k, set()).update(x["$result"] for x in c["arguments"]["url"] if x["$result"] in named_too and first.get(x["$result"], (None,))[0] != k)
        elif m.get("tool_call_id") in first:
            call, named = first[m["tool_call_id"]]
            need[k] = {call, *(n for n in named if n in named_too)}
            need.setdefault(m["tool_call_id"], set()).add(k)
        elif "tool_call_id" in m:
            need.setdefault(k, set())
            need.setdefault(m["tool_call_id"], set()).add(k)
    for c, (k, _) in first.items():
        need.setdefault(c, set()).add(k)
        need.setdefault(k, set())

    def fixed(step, now):
        while (then := step(now)) != now:
            now = then
        return now

    place = fixed(lambda p: {x: max([p[x], *(p[y] for y in need[x])]) for x in need}, {x: own.get(x, -1) for x in need})
    reach = lambda graph: fixed(lambda seen: {x: s.union(*(seen[y] for y in s)) for x, s in seen.items()}, {x: set(graph[x]) for x in graph})

    after = reach(need)
    level = fixed(lambda lv: {x: 1 + max((lv[y] for y in after[x] if x not in after[y]), default=0) for x in need}, dict.fromkeys(need, 1))
    calls = reach({c: {n for n in named if n in first} for c, (_, named) in first.items()})
    at = lambda k: (place.get(k, own[k]), level.get(k, 0), rows[k][1], rows[k][2], rows[k][3])
    return sorted(range(len(rows)), key=at), {c for c, s in calls.items() if c in s}


def random_chat(seed, cycles):
    random.seed(seed)
    names = [f"c{k}" for k in range(random.randint(1, 14))]
    random.shuffle(names)
    rows, left = [], list(names)
    while left:
        own = [left.pop() for _ in range(min(len(left), random.randint(1, 3)))]
        earlier = lambda c: names if cycles else names[: names.index(c)]
        calls = [{"id": c, "name": "fetch", "arguments": {"url": [{"$result": n} for n in random.sample(earlier(c), min(len(earlier(c)), random.randint(0, 2)))]}} for c in own]
        rows.append((seed, random.randint(0, 12), "assistant", json.dumps({"tool_calls": calls})))
    rows += [(seed, random.randint(0, 12), "tool", json.dumps({"tool_call_id": random.choice([*names, "gone"]), "content": k})) for k in range(random.randint(0, 16))]
    return rows + [(seed, k, "user", f"and {k}") for k in range(0, 13, 4)]


def test_random_call_graphs(spark):
    chats = {seed: random_chat(seed, cycles=seed % 3 == 0) for seed in range(90)}
    chats[90] = [(90, 300 - k, "assistant", json.dumps({"tool_calls": [{"id": f"k{k}", "name": "fetch", "arguments": {"url": [{"$result": f"k{k - 1}"}]}}]})) for k in range(200)]
    found = formatted(spark, [r for rows in chats.values() for r in rows])
    for seed, rows in chats.items():
        order, cyclic = brute_order(rows) if seed < 90 else (range(200), set())
        mine = [r for r in found if r["conv_id"] == seed]
        assert [(r["turn"], r["role"]) for r in mine] == [(rows[k][1], rows[k][2]) for k in order], seed
        for r, k in zip(mine, order, strict=True):
            told, given = json.loads(r["message"]), json.loads(rows[k][3]) if rows[k][2] != "user" else {}
            assert told.get("tool_call_id") == given.get("tool_call_id") and {c["id"] for c in told.get("tool_calls", ())} == {c["id"] for c in given.get("tool_calls", ())}
            assert r["cyclic"] == any(c["id"] in cyclic for c in given.get("tool_calls", ()))


ONE = '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": %s}}]}'


ODD = [
    (ONE % "2", 1, 1), (ONE % "2.5", 1, 0), (ONE % "2.0", 1, 1), (ONE % "Infinity", 0, 0), (ONE % "-Infinity", 0, 0), (ONE % "NaN", 0, 0), (ONE % "1e999", 0, 0), (ONE % ("9" * 5000), 0, 0),
    (ONE % ("[" * 1500 + "]" * 1500), 0, 0), (ONE % ("[" * 100_000 + "]" * 100_000), 0, 0), (ONE % ("[" * 150 + "]" * 150), 1, 0), (ONE.replace('"x"', r'"\ud800 x"') % "1", 1, 1), (ONE.replace('"a"', r'"\udfff"') % "1", 1, 1),
]


def test_odd_json(spark):
    """JSON that others refuse is plain text; lone surrogates are replaced."""
    found = formatted(spark, [row for k, (text, *_) in enumerate(ODD) for row in ((k, 0, "assistant", text), (k, 1, "tool", '{"tool_call_id": NaN}'))])
    assert len(found) == 2 * len(ODD)
    for row, (text, n_calls, n_valid) in zip(found[::2], ODD, strict=True):
        assert (row["n_calls"], row["n_valid"]) == (n_calls, n_valid)
        assert json.loads(row["message"]).get("content") == text if not n_calls else "\\ud" not in row["message"]
