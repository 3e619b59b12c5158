import pytest
from pyspark.sql import functions as F

from memlattice import config
from memlattice.sources import sinks


def test_config(spark):
    s = config.parsed('{"runtime":{"n_ctx":1000},"search":{"top_k":3},"KV":{"resident_budget":"2k"}}', top_k=5)
    assert (s.n_ctx, s.top_k, s.resident_budget) == (1000, 5, 2048)
    for bad in ('{"x":{}}', '{"search":{"k":1}}', "[]", '{"search":{"top_k":-1}}', '{"KV":{"resident_budget":"2q"}}'):
        with pytest.raises(ValueError):
            config.parsed(bad)


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", 0.5, 10.0, 0.0), ("b", 0.7, 20.0, 0.0)], "repo string, ndcg10 double, p50_ms double, index_ms double")
    assert sinks.run_summary(r).first()["avg_ndcg10"] == 0.6
    assert [x["repo"] for x in sinks.remaining_work(r, r.limit(1), "repo").collect()] == ["b"]
    sinks.write_csv(r, str(tmp_path / "u"))
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).count() == 2
    assert sinks.stored_results(spark, str(tmp_path / "none"), "repo string").count() == 0
    m = spark.createDataFrame([("f1", "flat")], "fingerprint string, structure string")
    assert not sinks.must_rebuild(m, "f1", "flat") and sinks.must_rebuild(m, "f2", "flat")
    with pytest.raises(ValueError):
        sinks.must_rebuild(m, "f1", "nested")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "t")).select("path", "modificationTime", "length")
    assert sinks.tree_fingerprint(files).first()[0].startswith("tree-")
    assert spark.range(1).select(sinks.ordered_ints(F.lit("3, 1,3"))).first()[0] == [3, 1]
