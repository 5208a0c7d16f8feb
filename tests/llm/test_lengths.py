"""What is packed is as long as its token ids."""

from collections import Counter

from tokenizers import Tokenizer

from monthloom.llm import packing as P
from monthloom.llm.queries import op2, op6, tokenizer_file, with_length

CAPS = (512, 1024, 2048, 4096, 8192)


def test_length_is_tokens_and_end(spark):
    texts = ["The unbelievable Donaudampfschiff.", "日本語の文章は空白を持たない。" * 1500, "aGVsbG8gd29ybGQ" * 2000, "  a\n b ", "", None, "The unbelievable Donaudampfschiff."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    lengths = with_length(docs)
    assert {r["doc_id"]: r["length"] for r in lengths.collect()} == want
    assert want[1] > 8192 and want[5] == 1
    pieces = P.pack(lengths, capacities=CAPS).collect()
    assert sum(r["doc_id"] == 1 for r in pieces) == -(-want[1] // 8192)
    assert all(r["used"] <= r["capacity"] for r in pieces)
    assert with_length(docs.limit(0)).collect() == []


def test_packed_as_written(spark):
    sf = "/root/testdata/sf0.001"
    packed = Counter()
    for r in op6(spark, sf).collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {r["doc_id"]: r["n_tokens"] for r in op2(spark, sf).collect()}
