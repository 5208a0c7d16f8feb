import random


import numpy as np
import pyarrow as pa
import pytest

from monthloom.llm import licenses as L
from monthloom.llm import shingles as S
from monthloom.llm.common import text_buffers
from monthloom.llm.queries import op10

TEMPLATES = {
    **L.NOTICES,
    "long": " ".join(f"clause{i}" for i in range(45)),
    "repeats": "as is as is as is as is as is without warranty of any kind",
    "none": " -- ",
}


def brute(docs, index):
    """Every window of every class held against every template."""
    out = []
    for doc, text in docs:
        words, counts = S.word_hashes(*text_buffers(pa.array([text], pa.string())), S.ALNUM)
        for name, shingles, m, need, c, k in index.entries:
            h = S.folded(words, np.arange(max(0, len(words) - k + 1)), k)
            stride, blocks = L.geometry(c)
            held = [len(np.unique(w[np.isin(w, shingles)])) for a in range(0, len(h), stride) for w in [h[a : a + stride * blocks]]]
            good = [x for x in held if x >= need]
            if good:
                out.append((doc, name, max(good) / m))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(500)}"
    rows = []
    for d in range(150):
        parts = [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 3)):
            name = r.choice(sorted(TEMPLATES))
            w = TEMPLATES[name].split()
            if r.random() < 0.4:
                w[r.randrange(len(w))] = word()
            parts += [x.upper() if r.random() < 0.2 else x for x in w] + [word() for _ in range(r.randrange(0, 30))]
        rows.append((d, " ".join(parts)))
    return [*rows, (900, None), (901, ""), (902, "mit " * 3000), (3, rows[3][1]), (None, L.NOTICES["MIT"])]


def test_against_every_window(spark, docs):
    index = L.Templates(sorted(TEMPLATES), [TEMPLATES[n] for n in sorted(TEMPLATES)], 5, 0.8, 2, 1e-4, 7)
    assert {e[0] for e in index.entries} == set(TEMPLATES) - {"none"}
    frame = spark.createDataFrame([(*x, "") for x in docs], "doc_id long, text string, license_id string").repartition(3)
    got = sorted(((r["doc_id"], r["license_id"], r["containment"]) for r in L.scan(frame, TEMPLATES).collect()), key=str)
    want = brute(docs, index)
    missed = len(want) - len(got)
    assert set(got) <= set(want) and len({g[:2] for g in got}) == len({w[:2] for w in want}) and missed == 0


def test_bands_keep_their_promise():
    index = L.Templates(sorted(TEMPLATES), [TEMPLATES[n] for n in sorted(TEMPLATES)], 5, 0.8, 2, 1e-4, 7)
    assert (1 - index.least_similarity**2) ** index.bands <= 1e-4
    assert [L.ladder(m) for m in (1, 2, 3, 4, 5, 6, 7, 9, 13, 17, 25)] == [1, 2, 3, 4, 6, 6, 8, 12, 16, 24, 32]


def test_every_notice_of_the_table_is_found(spark):
    sf = "/root/testdata/sf0.01"
    want = {
        (r["doc_id"], name)
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
        for name, notice in L.NOTICES.items()
        if notice in (r["text"] or "")
    }
    got = {(r["doc_id"], r["license_id"]) for r in op10(spark, sf).collect() if r["containment"] == 1}
    assert want and want <= got


def test_no_templates_no_rows(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert L.scan(frame, {}).collect() == [] and L.scan(frame, {"x": "  "}).collect() == []
    assert L.scan(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="exceed"):
        L.scan(frame, {"x": "a" * 100}, template_bytes=10)
