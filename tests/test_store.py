"""A saved run counts once, whole, however often it was tried."""

import uuid

import pytest

from monthloom.session import shared_folder
from monthloom.sources import store


def params(spark, n, level):
    return spark.createDataFrame([(f"p{k}", "HoltWinters", f'{{"alpha":{level}}}') for k in range(n)], "product string, model string, params_json string")


def test_repeated_and_broken_attempts(spark, monkeypatch):
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    assert store.param_store_read(spark, path).isEmpty()

    def dies(*_):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.param_store_save(params(spark, 5, 0.9), path, "2024")
    assert store.param_store_read(spark, path).isEmpty()
    store.param_store_save(params(spark, 3, 0.1), path, "2024")
    store.param_store_save(params(spark, 3, 0.2), path, "2024")  # the same run again
    store.param_store_save(params(spark, 2, 0.3), path, "2025")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.param_store_save(params(spark, 5, 0.9), path, "2026")
    rows = sorted((r["run_ts"], r["product"], r["params_json"]) for r in store.param_store_read(spark, path).collect())
    assert rows == [("2024", f"p{k}", '{"alpha":0.2}') for k in range(3)] + [("2025", f"p{k}", '{"alpha":0.3}') for k in range(2)]
    latest = {r["product"]: r["params_json"] for r in store.param_store_latest(store.param_store_read(spark, path)).collect()}
    assert latest == {"p0": '{"alpha":0.3}', "p1": '{"alpha":0.3}', "p2": '{"alpha":0.2}'}
    assert [r[0] for r in store.run_list(store.param_store_read(spark, path)).collect()] == ["2025", "2024"]
