import math
import re

import pytest

from monthloom.llm import tokencounts as T
from monthloom.llm.queries import op5, tokenizer_file

VOCABULARY = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return T.load_pieces(VOCABULARY)[0]


def viterbi(raw, pieces):
    """Best score and fewest pieces, from scratch."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
    for end in range(1, len(raw) + 1):
        for a in range(max(0, end - 128), end):
            s = pieces.get(raw[a:end])
            if s is not None:
                got = (s + best[a][0], best[a][1] - 1)
                best[end] = max(best[end], got)
    return -best[-1][1]


def test_trie_scores_shared_prefixes_once(pieces):
    words = [b"", b" in", b" inter", b" internal", b" internals", b" zz", "über".encode()]
    trie = T.Trie(pieces, 128)
    assert trie.counts(sorted(words)) == [viterbi(w, pieces) for w in sorted(words)]
    assert trie.visits == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_whole_table_against_plain_scores(spark, pieces):
    sf, known = "/root/testdata/sf0.001", {}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(T.PRETOKEN, r["text"] or "")
        for w in words:
            if w not in known:
                known[w] = viterbi(w.encode(), pieces)
        want.append((r["doc_id"], len(words), sum(known[w] for w in words)))
    assert sorted(map(tuple, op5(spark, sf).collect())) == sorted(want)


def test_odd_rows(spark, pieces):
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (None, "ab ab", 7), (4, "x" * 20_000, 7), (4, "日本 語", 7), (4, "日本 語", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for remembered, slice_rows in ((600_000, 2000), (0, 1)):
        got = [tuple(r) for r in T.count_tokens(docs, VOCABULARY, remembered=remembered, slice_rows=slice_rows).collect()]
        want = [(d, len(w), sum(viterbi(x.encode(), pieces) for x in w)) for d, t, _ in rows for w in [re.findall(T.PRETOKEN, t or "")]]
        assert got == want
    assert T.count_tokens(docs.limit(0), VOCABULARY).collect() == []
