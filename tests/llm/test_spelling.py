import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from monthloom.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs, every=97, length=5, least=3):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root)
    return out


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(seed, size, letters="abcdeéß"):
    r = random.Random(seed)
    n = {}
    while len(n) < size:
        w = "".join(r.choice(letters) for _ in range(r.randrange(5, 9)))
        n[w] = r.choice([3, 3, 4, 6, 9, 30, 200])
        if r.random() < 0.7:
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + r.choice(letters) + w[k:]])
            if len(v) >= 5:
                n[v] = r.choice([3, 5, 12, 60])
    return n


@pytest.mark.parametrize("seed, tile", [(1, 1024), (2, 7)])
def test_variants_against_all_pairs(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(S, "TILE", tile)  # small tiles: blocks are cut
    monkeypatch.setattr(S, "ROW_BYTES", 2000)
    n = vocabulary(seed, 700)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(S.variants(df)) == plain_variants(n)


def test_one_block_of_anagrams(spark, monkeypatch):
    """Words of the same letters all share a block, whose tiles meet; none of them is near another."""
    monkeypatch.setattr(S, "TILE", 50)
    r = random.Random(3)
    words = {"".join(r.sample("abcdefgh", 8)) for _ in range(600)}
    n = dict.fromkeys(words, 3) | {"abcdefg": 9, "abcdefgg": 40, "bcdefgh": 3}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(S.variants(df)) == plain_variants(n)


def test_count_words(spark):
    words = ["Häuser", "HÄUSER", "Straße", "abcde", "abcd", "ÿÿÿÿÿ", "naïve", "x" * 70_000, "日本語テキスト", "l'été d'hiver", "a_b_c", "wordone×wordtwo"]
    r = random.Random(4)
    docs = [(d, " ".join(r.choice(words) for _ in range(40)) + "ɐopen œuvre") for d in range(60)]
    docs += [(None, "Straße Straße nothing"), (7, None), (8, ""), (5, docs[5][1]), (9, "letters" * 400_000 + " " + "ends here " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS `__id`")
    for every in (0, 5, 97):
        rows = S.count_words(df, misspell_every=every).collect()
        got = {r["word"]: r["n"] for r in rows}
        assert len(got) == len(rows) and got == plain_counts(docs, every)


def test_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_BYTES", 1000)
    docs = [(d, "some words come back again and again while others wander") for d in range(500)]
    rows = S.count_words(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), misspell_every=97).collect()
    assert {r["word"]: r["n"] for r in rows} == plain_counts(docs)


def test_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(S.count_words(empty)).collect() == []
    one = spark.createDataFrame([("single", 3)], "word string, n long")
    assert found(S.variants(one)) == {"single": (3, 0, None, None, "single")}
    # Ties of n: the first in code-point order; a form needs twice the count; forms lead on to a root.
    n = {"word": 3, "words": 6, "wordz": 6, "wordß": 6, "swords": 12, "swordsé": 11, "abcdef": 5, "abcdeg": 9}
    assert found(S.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_very_long_words(spark):
    base = "ab" * 30_000
    n = {base: 30, base[:-1]: 3, base[1:]: 3, base[:500] + "c" + base[501:]: 4, base + "zz": 3, "a" * 300: 3, "a" * 301: 9, "a" * 299 + "é": 3}
    assert found(S.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_verified_against_plain():
    import numpy as np

    r = random.Random(6)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(400)})
    letters, begins = S._letters(pa.array(words))
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and len(words[j]) - len(words[i]) in (0, 1)]
    x, y = (np.array(c) for c in zip(*pairs))
    want = [one_edit(words[i], words[j]) for i, j in pairs]
    assert S._verified(x, y, letters, begins).tolist() == want
