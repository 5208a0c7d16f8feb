import random

import duckdb
import pandas as pd
import pytest

from checks.compare import canonical
from monthloom.llm import quality
from monthloom.llm.oracles import _quality

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    out = []
    for d in range(400):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None])
        lines = [" ".join(word() for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 8))]
        kind = r.random()
        if kind < 0.1:
            lines += lines[:2] + ["", "  "]
        elif kind < 0.15:
            lines = [x.replace(" ", " ###$$$ ") for x in lines]
        elif kind < 0.2:
            lines = [" ".join([word()] * 40)]
        elif kind < 0.25:
            lines = [x.replace(" ", "") for x in lines]
        elif kind < 0.3:
            phrase = [word() for _ in range(9)]
            lines = [" ".join([word(), *phrase, word(), word(), *phrase, *phrase[:5]])] + lines
        out.append((d, r.choice(["\n", "\r\n", "\t"]).join(lines), lang, source))
    out += [(900, None, "en", "a"), (901, "", "xx", "only"), (902, " \n\t ", "en", None), (903, "w " * 50_000, "en", "a")]
    out += [(904, "a b c d e f g h", "en", "a"), (905, "a b c d e f g h a b c d e f g h", "en", "a"), (906, "a a a a a a a a a", "en", "a")]
    return out


def test_against_sql(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    got = quality.judged(docs).select("doc_id", *[f"__q.{c}" for c in COLUMNS])
    con = duckdb.connect()
    con.register("d", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"]))
    cur = con.execute(f"WITH {_quality('d')} SELECT doc_id, {', '.join(COLUMNS)} FROM judged")
    want = cur.fetchall()
    assert canonical(got.collect(), got.columns) == canonical(want, [c[0] for c in cur.description])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[-1])


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a")] * 3, "doc_id long, text string, lang string, source string")
    assert quality.keep_good(docs).count() == 3
    assert quality.keep_good(docs.limit(0)).collect() == []


@pytest.mark.parametrize("v", [0, 1, 15, 16, 17, 31, 32, 100, 1000, 12345, 10**9])
def test_bins(spark, v):
    b = quality.bin_of(quality.F.lit(v))
    low, high = quality.bin_bounds(b)
    got = spark.range(1).select(b.alias("b"), low.alias("low"), high.alias("high")).first()
    assert got["low"] <= v <= got["high"] and got["high"] - got["low"] <= v / 8


def test_merged_sketches_are_sketches_of_the_union(spark):
    docs = spark.createDataFrame([(t, a, s) for _, t, a, s in rows()], "text string, lang string, source string")
    whole = quality.merged(quality.sketch(docs)).collect()
    parts = quality.sketch(docs.where("source = 'a'")).unionByName(quality.sketch(docs.where("source is null or source <> 'a'")))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, quality.merged(parts).collect()))
