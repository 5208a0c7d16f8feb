import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from monthloom.llm import linededup as L

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, known=None, min_docs=3, min_length=20):
    """Kept texts of ``docs`` by the lines of ``known`` (the same documents if none are given)."""
    holders = defaultdict(set)
    for d, t in known if known is not None else docs:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_length:
                holders[key].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            who = holders.get(line.strip(SPACE).translate(LOWER), set())
            if len(who) < min_docs or d == max((x for x in who if x is not None), default=None):
                stay.append(line)
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], r["__lines"]["n_lines"], r["__lines"]["n_dropped"], r["__lines"]["text"]) for r in df.collect()), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    pool = [f"Zeile Nummer {k} wird öfter gebraucht{'!' * r.randrange(4)}" for k in range(30)] + ["short", "ä" * 19, "ä" * 20, "x" * 79, " ", ""]
    docs = []
    for d in range(n):
        lines = [r.choice(pool) for _ in range(r.randrange(6))] + [f"only in document {d} and nowhere else"] * r.randrange(2)
        lines = [r.choice(["", " ", "\t", "\x0b"]) + (x.upper() if x.isascii() and r.random() < 0.3 else x) + r.choice(["", "\r", "  "]) for x in lines]
        r.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    return docs


@pytest.fixture(params=["by filters", "by join"])
def way(request, monkeypatch):
    if request.param == "by join":
        monkeypatch.setattr(L, "FILTER_BYTES", -1)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_against_plain(spark, way):
    docs = corpus(1)
    df = frame(spark, docs)
    assert rows(L.kept(df, L.build(df))) == plain(docs)


def test_reversible(spark):
    first, second, third = corpus(2), [(d + 1000, t) for d, t in corpus(3)], [(d + 500, t) for d, t in corpus(4)]
    a, b, c = (frame(spark, x) for x in (first, second, third))
    index = L.insert(L.insert(L.build(a), b), c)
    every = first + second + third
    assert rows(L.kept(frame(spark, every), index)) == plain(every)
    assert rows(L.kept(a, index)) == plain(first, every)
    # A batch that comes twice is counted once.
    again = L.insert(index, b)
    counts = lambda i: sorted(map(tuple, i.counts.collect()))
    assert counts(again) == counts(index)
    # Without the second batch the index is as if it had never come, in counts, references and filters.
    back = L.delete(again, b.select("doc_id"))
    never = L.insert(L.build(a), c)
    assert counts(back) == counts(never)
    assert sorted(map(str, back.references.collect())) == sorted(map(str, never.references.collect()))
    held = [(r["k1"], r["k2"]) for r in never.held().collect()]
    k1, k2 = (np.array([h[j] for h in held], np.int64) for j in (0, 1))
    shards = L.Shards(back.filters.collect(), back.shards)
    assert shards.may_hold(k1, k2).all() and int((shards.cells > 0).sum()) == len(held)
    assert rows(L.kept(a, back)) == plain(first, first + third)
    assert rows(L.kept(a, L.delete(back, c.select("doc_id")))) == plain(first)


def test_cases(spark, way):
    line = "a line of text that is long enough"
    long = "\n".join(["word " * 200_000, line, "tail"])
    docs = [(1, line), (1, line), (2, f"  {line.upper()}\r\n\n"), (3, f"{line}\n{line}\nx"), (None, line), (None, None), (4, ""), (5, None), (6, long), (7, "\n\n")]
    df = frame(spark, docs).selectExpr("*", "'kept' AS `__gone`", "1 AS `a.b`", "2 AS `__lines`", "3 AS k1")
    out = L.kept(df, L.build(df))
    assert out.columns == ["doc_id", "text", "__gone", "a.b", "k1", "__lines"]
    assert rows(out) == plain(docs)
    kept = {r["doc_id"]: r["__lines"] for r in out.collect() if r["doc_id"] is not None}
    assert kept[6]["n_dropped"] == 0 and kept[3] == ("x", 3, 2) and kept[5] == ("", 1, 0) and kept[4] == ("", 1, 0)
    digest = {r["doc_id"]: r["kept_sha256"] for r in L.digest(out).collect()}
    assert digest[3] == hashlib.sha256(b"x").hexdigest() and digest[5] == hashlib.sha256(b"").hexdigest()
    empty = df.limit(0)
    index = L.build(empty)
    assert L.kept(empty, index).collect() == []
    assert rows(L.kept(df, index)) == plain(docs, [])
    assert rows(L.kept(df, L.insert(index, df))) == plain(docs)
    assert L.delete(index, df.select("doc_id")).counts.collect() == []


def test_more_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    docs = [(d, "\n".join(f"line {k} that many documents share" for k in range(200))) for d in range(4)]
    df = frame(spark, docs)
    index = L.build(df)
    assert index.shards == 32 and index.filters.count() <= 32
    assert rows(L.kept(df, index)) == plain(docs)
    grown = L.insert(L.build(df.limit(0)), df)
    assert grown.shards == 32 and rows(L.kept(df, grown)) == plain(docs)


def test_cuckoo_holds_and_forgets():
    r = np.random.default_rng(5)
    k1, k2 = (r.integers(-(2**63), 2**63 - 1, 6000) for _ in range(2))
    k2[:40] = k2[0]
    k1[:40] = k1[0]  # more equal fingerprints than two buckets hold
    steps = list(zip(*(x.tolist() for x in L._slots(k1, k2)), strict=True))
    cuckoo = L.Cuckoo.sized(1000)
    for s in steps:
        cuckoo.add(*s)
    assert len(cuckoo.tables) > 1

    def may(a, b):
        return L.Shards([{"shard": 0, "tables": cuckoo.dump()}], 1).may_hold(a, b)

    assert may(k1, k2).all()
    other = (r.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    assert may(*other).mean() < 0.01
    for s in steps[:3000]:
        cuckoo.remove(*s)
    assert may(k1[3000:], k2[3000:]).all() and may(k1[40:3000], k2[40:3000]).mean() < 0.01
    for s in steps[3000:]:
        cuckoo.remove(*s)
    assert not any(any(t) for t in cuckoo.tables)
    with pytest.raises(ValueError):
        cuckoo.remove(*steps[0])
