"""Cheapest repairs against a search over all edits, and on awkward rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from paperspark.llm import repair
from paperspark.llm.common import prepare

ROW = "conv_id long, turn int, role string, text string, gone int, fault string"
WORD_CHAR = re.compile(r"[^\x20\x09-\x0D]")
ROLES = ["user", "assistant", "system", "tool", "u2", "", "user", "assistant"]


def searched(rows):
    """Least cost, then least initials, by looking at all sequences of edits
    in that order."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, after, out = heapq.heappop(heap)
        if i == len(rows) and after in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        if (i, after, audit) in seen:
            continue
        seen.add((i, after, audit))
        role = "assistant" if after == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, (role, ""))))
        if i == len(rows):
            continue
        mine, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, after, out))
        if fault in ("b", "d"):
            continue
        more = cost + (3 if fault == "t" else 0)
        heapq.heappush(heap, (more + 3, audit + "R", i + 1, role[0], (*out, (role, text))))
        if mine[:1] == role[0] or (mine[:1] == "s" and after == ""):
            heapq.heappush(heap, (more, audit + "K", i + 1, mine[0], (*out, (mine, text))))


def plain(rows):
    """Cost and initials by whole strings instead of nodes."""
    nothing, system, user, assistant = range(4)
    goes = {nothing: user, system: user, user: assistant, assistant: user}

    def inserted(states):
        for to, sources in ((user, (nothing, system, assistant)), (assistant, (user,))):
            found = [states[to]] if to in states else []
            found += [(states[s][0] + 3, states[s][1] + "I") for s in sources if s in states]
            states[to] = min(found)
        return states

    states = inserted({nothing: (0, "")})
    for role, _, fault in rows:
        found = {}
        for s, (cost, audit) in states.items():
            found.setdefault(s, []).append((cost + 4, audit + "D"))
            if fault in ("b", "d"):
                continue
            more = cost + (3 if fault == "t" else 0)
            found.setdefault(goes[s], []).append((more + 3, audit + "R"))
            if role[:1] == "s" and s == nothing:
                found.setdefault(system, []).append((more, audit + "K"))
            elif role[:1] == ("a" if goes[s] == assistant else "u"):
                found.setdefault(goes[s], []).append((more, audit + "K"))
        states = inserted({s: min(v) for s, v in found.items()})
    return min(states[s] for s in (nothing, assistant) if s in states)


def folded(rows):
    program = repair.Repair()
    for row in rows:
        program.row(*row)
    return program


def random_rows(rng, n, roles=ROLES, faults=("", "", "", "t", "b", "d")):
    return [(rng.choice(roles), f"t{k}", rng.choice(faults)) for k in range(n)]


@pytest.mark.parametrize("settle", [10, 2048])
def test_short_conversations_equal_the_search(monkeypatch, settle):
    monkeypatch.setattr(repair, "SETTLE_AFTER", settle)
    rng = random.Random(1)
    for _ in range(500):
        rows = random_rows(rng, rng.randint(0, 7))
        assert folded(rows).result() == searched(rows), rows


def test_long_conversations_equal_whole_strings(monkeypatch):
    monkeypatch.setattr(repair, "SETTLE_AFTER", 60)
    rng = random.Random(2)
    for _ in range(30):
        rows = random_rows(rng, rng.randint(100, 500), rng.choices(ROLES, k=3), rng.choices(["", "t", "b", "d"], k=3))
        assert folded(rows).result()[:2] == plain(rows)


def test_colliding_hashes_change_nothing(monkeypatch):
    """With a hash that is the same for all, every comparison is verified."""
    monkeypatch.setattr(repair, "HASH_PRIME", 1)
    rng = random.Random(3)
    for _ in range(200):
        rows = random_rows(rng, rng.randint(0, 7))
        assert folded(rows).result() == searched(rows)


def test_least_initials_by_common_prefixes():
    rng = random.Random(4)
    for _ in range(300):
        words = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 6))) for _ in range(12)]
        nodes = {"": repair.Node(None, "")}
        for word in words:
            for k in range(1, len(word) + 1):
                if word[:k] not in nodes:
                    nodes[word[:k]] = repair.Node(nodes[word[:k - 1]], word[k - 1])
        for a in words:
            for b in words:
                assert repair.less(nodes[a], nodes[b]) == (a < b)


def test_settled_prefixes_are_let_go():
    rng = random.Random(5)
    for faults in (("", "t"), ("b",), ("", "t", "b", "d")):
        program = folded(random_rows(rng, 20_000, ["user", "assistant"], faults))
        depths = [b.node.depth for b in program.states.values()]
        assert max(depths) - program.root.depth < 4000 < len("".join(program.settled))


def expected(rows):
    """The whole operator, row by row: ``(conv_id, turn, role, text)``."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            name = ":".join(" " if x is None else str(x) for x in (conv, turn))
            kind = zlib.crc32(name.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in kept:
            chars = WORD_CHAR.findall(text)
            fault = ("b" if not chars else "d" if (role, text) in seen else "" if chars[-1] in ".!?" else "t")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[0] for r in kept if r[0] is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        faults = [m[2] for m in marked]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), illegal, *searched(marked))
    return out


def test_rows(spark):
    prepare(spark)
    rng = random.Random(6)
    texts = ["Yes.", "No", "", " \t", "Why?", "é 日本!", "a.b", None, "Yes.", "x " * 40_000 + ".", "end.\n ", "end. "]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice([*ROLES, None]), rng.choice(texts))
            for conv in range(60) for _ in range(rng.randint(1, 5))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Hi."))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROW).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damage(frame)).collect()}
    assert got == expected(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired(repair.damage(frame.limit(0))).collect() == []


def test_one_long_conversation(spark):
    prepare(spark)
    rows = [(1, k, "user" if k % 2 else "assistant", f"text {k}" + "." * (k % 5 > 0), 0, "") for k in range(20_000)]
    r = repair.repaired(repair.damage(spark.createDataFrame(rows, ROW).repartition(6))).first()
    assert len(r["audit"]) >= 18_000 and r["gaps"] > 500
    assert (r["cost"], r["audit"]) == plain_of_damage([x[:4] for x in rows])


def plain_of_damage(rows):
    kept, seen, marked = [], set(), []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [("user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for role, text in kept:
        fault = "b" if not text.strip() else "d" if (role, text) in seen else "" if text[-1] in ".!?" else "t"
        seen.add((role, text))
        marked.append((role, text, fault))
    return plain(marked)


def test_texts_are_shuffled_once(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a", 0, "")], ROW)
    plan = repair.repaired(repair.damage(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
