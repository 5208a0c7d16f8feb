"""Every stage against SQL or a plain computation over what the stage before it kept."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from monthloom.llm import langid
from monthloom.llm.common import stored
from monthloom.llm.oracles import SQL, _quality
from tests.llm.test_packing import token_lengths, valid

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, frames = docs.columns, {}, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        frames[name] = docs
        if name != "packing":
            assert docs.columns == columns
            kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    rows = frames["documents"].collect()

    learned = langid.learn(frames["documents"].where(langid.fold_of(F.col("doc_id")) != 2).select("text", "lang"))
    encoders = langid._encoders(learned, 3)
    want = []
    for r in rows:
        lang, _, margin, n = langid.classify(r["text"], encoders, 4096)
        if lang != "und" and not (margin < 0.005 and n >= 200):
            want.append(r["doc_id"])
    assert kept["language"] == sorted(want)

    def over(name):
        con = duckdb.connect()
        con.register("documents", frames[name].toPandas())
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
        return con

    good = over("language").execute(f"WITH {_quality('documents')} SELECT doc_id FROM judged WHERE kept").fetchall()
    assert kept["quality"] == sorted(x[0] for x in good)
    first = over("quality").execute(f"SELECT doc_id FROM ({SQL['op4']}) WHERE doc_id = component_id OR n_shingles = 0").fetchall()
    assert kept["near_copies"] == sorted(x[0] for x in first)
    unseen = over("near_copies").execute(f"SELECT doc_id FROM ({SQL['op1']}) WHERE NOT contaminated").fetchall()
    assert kept["benchmark"] == sorted(x[0] for x in unseen)

    valid(frames["packing"].collect(), token_lengths(frames["benchmark"].collect()), (512, 1024, 2048, 4096, 8192))
    assert len(kept["benchmark"]) > 0.5 * len(rows)

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, frames["packing"].collect()))
