"""Conversation repair against a plain dynamic program over whole conversations, and the search against enumeration."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from pressroute.llm import conversation_repair as repair
from pressroute.llm.queries import LLM_QUERIES

BASE = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case:
            row = (conv, turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
            yield from [row] * (2 if case == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Least (cost, audit) and the repaired lines: every node keeps its best prefix, rows taken one after the other."""
    kinds = faults(rows)

    def inserted(best):
        for _ in range(3):
            for state in list(best):
                cost, audit, lines = best[state]
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", lines + [f"{role}:"])
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        return best

    best = {"": (0, "", [])}
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for (_, _, role, text), kind in zip(rows, kinds):
        new = {}

        def offer(state, entry):
            if state not in new or entry[:2] < new[state][:2]:
                new[state] = entry

        stays = 5 if kind == "truncated" else 0
        for state, (cost, audit, lines) in inserted(best).items():
            offer(state, (cost + 2, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                if (state, role[:1]) in follows:
                    offer(follows[state, role[:1]], (cost + stays, audit + "K", lines + [f"{role}:{text}"]))
                forced = "assistant" if state == "u" else "user"
                offer(forced[0], (cost + 1 + stays, audit + "R", lines + [f"{forced}:{text}"]))
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def brute_report(ids, rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)

    def place(r):
        return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(key(r)).digest())

    def key(r):
        conv = "" if r[0] is None else f"={r[0]}"
        return f"{len(conv.encode())}{conv}{len(r[2].encode())}:{r[2]}{r[3]}".encode()

    out = []
    for conv in set(ids):
        mine = sorted(by[conv], key=place)
        kinds, turns = faults(mine), {r[1] for r in mine if r[1] is not None}
        cost, audit, lines = brute_repair(mine)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        assert LEGAL.fullmatch("".join(line[:1] for line in lines))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, LLM_QUERIES["op12_conversation_repair"](spark, BASE).collect()), key=repr)
    assert got == brute_report([r[0] for r in rows], list(damaged(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_the_least_cost_and_audit(seed):
    rng = random.Random(seed)
    for _ in range(40):
        rows = [(rng.choice("ssuuuaax"), rng.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(rng.randint(0, 3))]
        want = min(((cost, audit) for cost, audit in enumerated(rows)), default=None)
        assert repair.cheapest_edits(rows)[:2] == want


def enumerated(rows, most=1):
    """All legal audits with at most ``most`` inserts at each place."""
    choices = []
    for initial, fault in rows:
        stays = 5 * (fault == 3)
        choices.append([("D", 2, "")] + ([] if fault in (1, 2) else [("K", stays, initial), ("R", 1 + stays, "u"), ("R", 1 + stays, "a")]))
    inserts = [("I" * n, 5 * n, "".join(p)) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    for picks in itertools.product(*itertools.chain.from_iterable((inserts, c) for c in choices), inserts):
        if LEGAL.fullmatch("".join(p[2] for p in picks)):
            yield sum(p[1] for p in picks), "".join(p[0] for p in picks)


def random_rows(seed, conversations=25, longest=40):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.choice([0, 1, 2, 5, longest])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "u", "tool", "", None]),
                         rng.choice(["Yes.", "no", "", " \t", None, "Why?", "ok!", "x" * 500, "ünd.", f"t{rng.randint(0, 30)}."])))
    return rows


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_long_conversations_in_blocks(spark, block_rows):
    """A conversation with half of all rows spans ranges and blocks; nulls, ties, repeated rows and foreign roles are in."""
    rows = random_rows(block_rows)
    rows += [(77, t % 300, "user" if t % 2 else "assistant", f"line {t % 211}{'.' if t % 5 else ''}") for t in range(len(rows))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    plan = repair.plan_repairs(df, block_rows=block_rows)
    got = sorted(map(tuple, repair.repair_report(df, df, plan).collect()), key=repr)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == brute_report([r[0] for r in rows], clean)
    lines = defaultdict(list)
    for r in sorted(repair.apply_repairs(df, repair.plan_repairs(df, block_rows=block_rows)).collect(), key=lambda r: r.place):
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {g[0]: g[-1] for g in got} == {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c, *_ in got}


def test_empty_and_clashing_columns(spark):
    schema = "conv_id string, turn int, role string, text string, row long, fault string, said int"
    rows = [("a", 0, "user", "Hi.", 1, "x", 2), ("a", 1, "assistant", "Yes", 1, "y", 3), ("b", None, "system", "S.", 0, "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repair_report(df, df, repair.plan_repairs(df)).collect()}
    assert got == {"a": (4, "DD"), "b": (2, "D")}
    none = df.where("false")
    assert repair.repair_report(none, none, repair.plan_repairs(none)).count() == 0
    report = repair.repair_report(df, none, repair.plan_repairs(none)).orderBy("conv_id").collect()
    assert [tuple(r)[1:] for r in report] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2
