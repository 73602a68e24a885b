"""Results are tables that can be written and read back."""

from culvert import catalog

catalog.load()


def test_columns_that_differ_in_case_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "false")  # a session not made by build_session
    try:
        out = catalog.QUERIES["coverage_crosstab"](spark, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / "out"))
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.columns == out.columns and {"Other", "other"} <= set(back.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
