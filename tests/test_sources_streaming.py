import pytest
from pyspark.sql import functions as F

from tidemark.sources import schemas, tables
from tidemark.streaming import weekly


def test_scan_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "item_id string, actor_id string")
    df.write.parquet(str(tmp_path / "content"))
    got = tables.scan(spark, str(tmp_path / "content"), "content_items")
    assert got.columns == schemas.CONTENT_ITEMS.names and spark.sql("SELECT count(*) FROM content_items").first()[0] == 1
    with pytest.raises(ValueError):
        tables.scan(spark, "x", "nope")
    path = tables.write_processed(df, str(tmp_path), "primary", "fraud", 1, "20250101")
    assert path.endswith("primary_fraud_1_20250101.parquet") and spark.read.parquet(path).count() == 1
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    frame = df.withColumn("review_week", F.to_date(F.lit("2025-01-06")))
    tables.append_review_queue(frame, str(tmp_path / "queue"))
    tables.append_review_queue(frame, str(tmp_path / "queue"))
    assert spark.read.parquet(str(tmp_path / "queue")).count() == 2
    assert tables.load_or_generate(spark, str(tmp_path / "absent"), lambda s: s.range(3)).count() == 3


def test_flags(spark):
    df = spark.sql("SELECT true AS is_safe, named_struct('a', true, 'b', false) AS category")
    flat = tables.flatten_flags(df)
    assert tables.flag_columns(flat) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.flag_columns(flat.select("is_safe"))


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_weekly_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('v', 0.9D, TIMESTAMP'2025-01-06 01:00:00'), ('v', 0.1D, TIMESTAMP'2025-01-12 23:00:00'), ('v', 0.9D, TIMESTAMP'2025-01-13 00:00:00'), ('v', 0.9D, TIMESTAMP'2025-02-13 00:00:00') t(classifier_label, classifier_score, created_at)")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    got = {str(r.week): (r.n_corpus, r.n_positive) for r in run(weekly.weekly_observed(stream), "observed").collect()}
    assert got == {"2025-01-06": (2, 1), "2025-01-13": (1, 1)}


def test_cusum_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, 0.02) for k in range(4)], "k string, t int, x double")
    rows.coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c"))
    got = run(weekly.cusum_stream(stream, "k", "t", "x", 0.01, 0.002, 0.02), "cusum").orderBy("t").collect()
    assert [round(r.cusum, 6) for r in got] == [0.008, 0.016, 0.024, 0.032] and [r.alarm for r in got] == [False, False, True, True]
