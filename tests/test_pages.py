from pyspark.sql import functions as F

from gleaner.operators.pages import PagedResult, numbered


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = numbered(rows, [F.desc("k")]).collect()
    assert sorted((r._row, r.k) for r in got) == [(i, 999 - i) for i in range(1000)]


def test_a_page_reads_its_stretch_and_a_version_is_made_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made) * 1000).select(F.col("id").alias("k")).repartition(5)

    pages = PagedResult(spark, str(tmp_path), build, [F.col("k")], stretch=100)
    assert [r.k for r in pages.page("v1", 3, 25).collect()] == list(range(75, 100))
    assert [r.k for r in pages.page("v1", 1, 150).collect()] == list(range(150, 300))
    assert [r.k for r in pages.page("v1", 39, 25).collect()] == list(range(975, 1000)) and pages.page("v1", 40, 25).count() == 0
    assert made == [1]  # an unchanged version is not computed again
    files = [r.f for r in pages.touched("v1", 3, 25).select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) == 1 and "_stretch=0" in files[0]
    plan = pages.page("v1", 3, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_stretch" in plan  # other folders are not opened
    assert pages.page("v2", 79, 25).count() == 25 and made == [1, 1]
    again = PagedResult(spark, str(tmp_path), build, [F.col("k")], stretch=100)
    assert again.page("v2", 79, 25).count() == 25 and made == [1, 1]


def test_no_rows(spark, tmp_path):
    pages = PagedResult(spark, str(tmp_path), lambda: spark.range(0), [F.col("id")])
    assert pages.page("v", 0, 10).count() == 0 and pages.page("v", 5, 10).columns == ["id"]
