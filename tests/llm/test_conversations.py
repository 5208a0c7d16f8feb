import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from monthloom.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def every_audit(leads, fault):
    """Least (cost, audit) by trying all edits from the back."""
    n, after = len(leads), {0: (2, 1), 1: (2,), 2: (3,), 3: (2,)}

    @lru_cache(None)
    def least(i, state, inserted):
        found = [(0, "")] if i == n and state in (0, 3) else []

        def follow(letter, cost, rest):
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1]))

        if inserted < 4:
            for s in after[state]:
                if s != 1:
                    follow("I", 3, least(i, s, inserted + 1))
        if i < n:
            follow("D", 4, least(i + 1, state, 0))
            if fault[i] != C.GONE:
                more = 3 if fault[i] == C.CUT else 0
                for s in after[state]:
                    if s == leads[i]:
                        follow("K", more, least(i + 1, s, 0))
                    if s != 1:
                        follow("R", 3 + more, least(i + 1, s, 0))
        return min(found) if found else None

    return least(0, 0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_edits(seed):
    r = random.Random(seed)
    for _ in range(1500):
        n = r.randrange(0, 10)
        leads = bytes(r.choice([0, 1, 2, 3, 2, 3]) for _ in range(n))
        fault = bytes(r.choice([0, 0, 0, 1, 2]) for _ in range(n))
        assert C.cheapest(leads, fault) == every_audit(leads, fault)


def test_long_conversation_in_proportion():
    n = 50_000
    leads = bytes((2, 3)[k % 2] for k in range(n))
    assert C.cheapest(leads, bytes(n)) == (0, "K" * n)
    cost, audit = C.cheapest(bytes([2]) * n, bytes(n))
    assert cost == 3 * n // 2 and len(audit) == n and set(audit) == {"K", "R"}


def plain_report(rows):
    """The query's rows, one conversation after the other."""
    out = {}
    space = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = space(role), space(text)
            h = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            if h == 1:
                text = ""
            if h == 2:
                text = "".join(x for x in text if x not in ".!?")
            if h == 4:
                role = "user"
            after += [(turn is not None, turn or 0, role, text, turn)] * (0 if h == 0 else 2 if h == 3 else 1)
        after.sort(key=lambda x: x[:4])
        turns = [x[4] for x in after if x[4] is not None]
        seen, kinds = set(), []
        for _, _, role, text, _ in after:
            bare = text.strip(SPACE)
            kinds.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        leads = bytes({"s": 1, "u": 2, "a": 3}.get(x[2][:1], 0) for x in after)
        cost, audit = every_audit(leads, bytes({0: 0, 1: 1, 2: 1, 3: 2}[k] for k in kinds))
        odd, lines, at = len(audit.replace("D", "")) % 2, [], 0
        for letter in audit:
            role, text = (after[at][2], after[at][3]) if letter != "I" else ("", "")
            at += letter != "I"
            if letter != "D":
                k = len(lines) - odd
                lines.append(f"{role if letter == 'K' else 'system' if k < 0 else ('user', 'assistant')[k % 2]}:{text}")
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(after, after[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def reported(df):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_report_against_plain(spark):
    r, rows = random.Random(9), []
    for conv in range(150):
        turn = r.randrange(-2, 3)
        for _ in range(r.randrange(1, 12)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ußer"])
            text = r.choice(["Gut.", "gut", "Really?  ", "\t\n", "", None, "So!\x0b", "Ünd. dann", "Gut."])
            rows.append((conv, turn, role, text))
            turn += r.choice([1, 1, 1, 3])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (900, None, "user", "No turn."), (900, 4, "assistant", "Late.")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS h1", "'x' AS audit", "2 AS `__copies`")
    assert reported(C.report(df)) == plain_report(rows)
    assert C.report(df.limit(0)).collect() == []


def test_repaired_rows(spark):
    long = "word " * 1_000_000 + "end."
    rows = [("c", 1, "user", "One."), ("c", 2, "user", "Two."), ("c", 3, "assistant", long), ("c", 4, "assistant", "cut"), ("d", 1, "assistant", "Alone.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    plans = C.plans(df)
    audits = {r["conv_id"]: (r["cost"], r["audit"]) for r in plans.collect()}
    assert audits == {c: every(rows, c) for c in "cd"}
    fixed = C.repaired(df, plans).collect()
    by = {c: [(x["position"], x["role"]) for x in fixed if x["conv_id"] == c] for c in "cd"}
    for c in "cd":
        assert [p for p, _ in by[c]] == list(range(len(by[c])))
        roles = "".join(x[0] for _, x in by[c])
        assert roles == "" or roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2)
    assert any(x["text"] == long for x in fixed)
    assert C.repaired(df.limit(0), plans.limit(0)).collect() == []


def every(rows, conv):
    mine = [r for r in rows if r[0] == conv]
    leads = bytes({"s": 1, "u": 2, "a": 3}[r[2][0]] for r in mine)
    return every_audit(leads, bytes(0 if r[3][-1] in ".!?" else 2 for r in mine))


def test_one_turn_many_rows(spark):
    """Rows of one turn have an order of their own; all copies of a row but the first are duplicates."""
    rows = [(1, 5, "user", "Same.")] * 30 + [(1, None, "assistant", "Early.")] * 2 + [(1, 5, "assistant", "Other.")]
    got = C.plans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (got["gaps"], got["duplicate"], got["blank"]) == (0, 30, 0) and got["audit"].count("D") >= 30
