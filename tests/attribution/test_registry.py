from gradloom import __main__ as cli
from gradloom.sources import labels, registry


def small(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0, float(i % 5)], i % 3) for i in range(120)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_setting(spark, tmp_path):
    s = registry.load("embeddings-softmax", spark, small(spark, tmp_path))
    assert s.test.count() == 3 and len(s.task.checkpoints) == 3 and 4500 < s.members.count() < 7500
    assert "embeddings-softmax" in registry.names()


def test_command_line(spark, tmp_path, monkeypatch):
    at = small(spark, tmp_path)
    cli.main(["grad_dot", at, f"{at}/out"])
    assert spark.read.parquet(f"{at}/out").count() == 360


def test_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "pmod(id * 7919, 97) * 44278013 + pmod(id, 3) as h")
    order = sorted((r.h, r.id) for r in df.collect())
    for want in (0, 1, 51, 52, 1234, 4999, 5000):
        got = {r.id for r in df.where(labels.smallest_hashes(df, want, "h", "id")).collect()}
        assert got == {i for _, i in order[:want]}
    assert labels.hash_batches(df, 4).select("batch").distinct().count() == 4
