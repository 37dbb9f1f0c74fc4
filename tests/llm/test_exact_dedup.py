import hashlib

from pyspark.sql import functions as F

from bytelake.llm.exact_dedup import drop_exact_duplicates, exact_dedup

ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "a c"), (6, "x" * 100_000), (7, "x" * 100_000), (8, "x" * 99_999 + "y"), (2, "a b"), (None, "a c"), (9, "é"), (10, "é")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("kept", F.lit("clash")).withColumn("_n", F.lit(1)).repartition(3)


def test_matches_brute_force(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dropping_keeps_one_row_of_each_text(spark):
    df = frame(spark, ROWS)
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted(
        [(2, "a b"), (4, ""), (5, "a c"), (7, "x" * 100_000), (8, "x" * 99_999 + "y"), (10, "é")]
    )


def test_empty_table(spark):
    df = frame(spark, ROWS).limit(0)
    assert exact_dedup(df).count() == 0 and drop_exact_duplicates(df).count() == 0


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(df)
    assert got.filter("kept").count() == 2001 and got.agg(F.max("group_size")).first()[0] == 1000
