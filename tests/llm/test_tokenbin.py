import zlib

import numpy as np
import pytest

from monthloom.llm import tokenbin
from monthloom.llm.common import scratch
from monthloom.llm.queries import op2, tokenizer_file

SF = "/root/testdata/sf0.001"
ODD = [
    (5, "two  blanks and \n line ends \n\n"),
    (1, None),
    (2, ""),
    (3, "'s first, it's \x00 zero\x00, tabs\t and a wide one   x"),
    (9, "x" * 30_000 + " " + "word " * 5_000),
    (9, "again the same id"),
    (9, "again the same id"),
    (None, "no id <|endoftext|> here"),
    (7, " leading, 12345 ²½ ünïcödé  日本語 трудно 'quoted' a'b !!?? "),
    (8, "\n\n\n"),
    (4, " "),
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return lambda text: [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]


def expected(rows, plain):
    start, out = 0, []
    for doc_id, text in rows:
        ids = plain(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_against_plain_encoding(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = expected([(r["doc_id"], r["text"]) for r in docs], plain)
    assert sorted(tuple(r) for r in op2(spark, SF).collect()) == want


@pytest.mark.parametrize("length", [7, 2048])
def test_odd_texts_nulls_and_repeated_ids(spark, plain, length):
    docs = spark.createDataFrame([(a, b, 1) for a, b in ODD], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tokenbin.write_and_read(docs, tokenizer_file("byte_bpe_50k.json"), length).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 5, 7, 8, 9, 9, 9]
    by_crc = {(i, zlib.crc32(np.array(plain(t), "<u4").tobytes())): len(plain(t)) for i, t in ODD}
    assert sorted((r[0] or 0, r[3], r[2]) for r in got) == sorted((i or 0, c, by_crc[i, c]) for i, t in ODD for c in [zlib.crc32(np.array(plain(t), "<u4").tobytes())])
    starts = [0, *np.cumsum([r[2] for r in got]).tolist()]
    assert [r[1] for r in got] == starts[:-1]


def test_random_access(spark, plain):
    folder = scratch(spark, "random-access")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = tokenbin.write_corpus(docs, folder, tokenizer_file("byte_bpe_50k.json"), 64, batch_rows=5, partitions=3)
    for f in manifest.collect():
        flat = np.concatenate([ids for _, ids in tokenbin.documents_of(f["path"])])
        assert len(flat) == f["n_ids"]
        for row in {0, 1, f["n_rows"] // 2, f["n_rows"] - 1}:
            ids, mask = tokenbin.sequence(f["path"], row)
            real = flat[row * 64 : row * 64 + 64]
            assert len(ids) == 64 and mask.sum() == len(real) and (ids[: len(real)] == real).all()
    with pytest.raises(IndexError):
        tokenbin.sequence(f["path"], f["n_rows"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenbin.write_and_read(docs, tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_memory_of_stretches_is_bounded(plain):
    encoder = tokenbin.Encoder(tokenizer_file("byte_bpe_50k.json"), room=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for i in range(0, 20, 1):
        assert np.frombuffer(encoder([texts[i]])[0], encoder.dtype).tolist() == plain(texts[i])[:-1]
    assert np.frombuffer(encoder(texts)[7], encoder.dtype).tolist() == plain(texts[7])[:-1]
