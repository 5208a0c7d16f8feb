import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from monthloom.llm import packing as P
from monthloom.llm.queries import op6, tokenizer_file

CAPS = (16, 32, 64)


def plain_pack(lengths, caps, cost):
    """Best fit by looking at every open bin."""
    left, bins, where = sum(lengths), [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fits = [(c - u, b) for b, (c, u) in enumerate(bins) if c - u >= need and c - u > 0]
        if fits:
            b = min(fits, key=lambda x: (x[0], -x[1]))[1]
        else:
            c = min((c for c in sorted(caps) if c >= need), key=lambda c: (cost.of(c) / min(c, max(left, 1)), c))
            bins.append([c, 0])
            b = len(bins) - 1
        where[i] = (b, bins[b][1])
        bins[b][1] += need
        left -= need
    return where, [(min(c for c in caps if c >= u), u) for _, u in bins]


@pytest.mark.parametrize("seed", range(6))
def test_block_against_plain_search(seed):
    r = random.Random(seed)
    lengths = [r.randrange(0, 65) for _ in range(r.choice([0, 1, 5, 300]))]
    cost = P.Cost(fixed=r.choice([0, 4]), quadratic=r.choice([0, 1 / 64]))
    bins, offsets, capacity, used = P.pack_block(np.array(lengths, np.int64), CAPS, cost)
    where, final = plain_pack(lengths, CAPS, cost)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == where
    assert list(zip(capacity.tolist(), used.tolist(), strict=True)) == final


def valid(rows, lengths, caps):
    """Every document's pieces are all there, no bin overlaps or overflows, and every bin is as small as can be."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["bin_id"]].append(r)
    total = defaultdict(int)
    for d, n in lengths:
        total[d] += max(n or 0, 0)
    assert {d: sum(r["length"] for r in v) for d, v in by_doc.items()} == dict(total)
    for inside in by_bin.values():
        at = 0
        for r in sorted(inside, key=lambda r: (r["bin_offset"], r["length"])):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["used"] for r in inside} == {at}
        assert {r["capacity"] for r in inside} == {min(c for c in caps if c >= at)}


def test_cases(spark):
    lengths = [(1, 5), (2, 0), (3, None), (4, 64), (5, 65), (6, 640), (7, 700), (8, -3), (1, 5), (None, 9), (None, 9), (None, None)]
    docs = spark.createDataFrame([(*x, 0) for x in lengths], "doc_id long, length int, bin_id int")
    rows = P.pack(docs, capacities=CAPS, block_pieces=3).collect()
    valid(rows, lengths, CAPS)
    pieces = sorted(r["piece"] for r in rows if r["doc_id"] == 7)
    assert pieces == list(range(11)) and sum(r["doc_id"] == 6 for r in rows) == 10
    assert P.pack(docs.limit(0), capacities=CAPS).collect() == []


def token_lengths(docs):
    """Ids of the tokenizer and the end id."""
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [(r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op6(spark, sf).collect()
    valid(rows, token_lengths(docs), (512, 1024, 2048, 4096, 8192))
    bins = {r["bin_id"]: (r["capacity"], r["used"]) for r in rows}
    assert sum(u for _, u in bins.values()) >= 0.97 * sum(c for c, _ in bins.values())
