"""Tables written as advised, and what their footers say."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout


def test_folders_ranges_and_order(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") * 7919 % 500).alias("user"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(1_700_000_000 + F.col("id") % 3 * 86400)).alias("at"), F.col("id").cast("string").alias("v"))
    path = f"file://{tmp_path}/t"
    layout.write_laid_out(rows, path, {"strategy": "COLUMN", "column": "at", "column_type": "TIMESTAMP", "granularity": "DAY"}, ["user"], files=12)
    back = spark.read.parquet(path)
    assert back.drop("at_date").exceptAll(rows).count() == 0 and back.count() == 3000
    assert back.where("at is null").count() == 60 and back.select("at_date").distinct().count() == 4
    found = layout.ranges(spark, path, "user").collect()
    assert sum(r.rows for r in found) == 3000
    one = layout.must_open(layout.ranges(spark, path, "user"), 40, 41).count()
    assert one < len(found) and {r.file for r in found if r.least <= 41 and r.most >= 40} == {r.file for r in layout.must_open(layout.ranges(spark, path, "user"), 40, 41).collect()}
    for r in found:
        own = [x.user for x in spark.read.parquet(r.file).select("user").collect()]
        assert own == sorted(own) and (min(own), max(own)) == (r.least, r.most)


def test_choices(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.date(2024, 1, 5), datetime.datetime(2024, 1, 5, 10, 30))], "id int, day date, at timestamp_ntz")
    for n, (choice, folder) in enumerate((({"strategy": "COLUMN", "column": "day", "column_type": "DATE"}, "day"), ({"strategy": "COLUMN", "column": "at", "column_type": "TIMESTAMP", "granularity": "HOUR"}, "at_hour"), ({"strategy": "INGESTION_TIME"}, "_partition_date"))):
        layout.write_laid_out(rows, f"file://{tmp_path}/{n}", choice, ["id"])
        assert any(p.name.startswith(folder + "=") for p in (tmp_path / str(n)).iterdir())
    assert (tmp_path / "1" / "at_hour=2024-01-05-10").is_dir()
    layout.write_laid_out(rows, f"file://{tmp_path}/plain")
    assert layout.ranges(spark, f"file://{tmp_path}/plain", "day").first()["least"] == datetime.date(2024, 1, 5)
    for choice, columns in (({"strategy": "COLUMN", "column": "none"}, []), ({}, ["none"])):
        with pytest.raises(ValueError, match="no column"):
            layout.write_laid_out(rows, f"file://{tmp_path}/no", choice, columns)
