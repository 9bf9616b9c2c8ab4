"""Snapshot freshness, reload and export."""

import datetime
import glob
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import storage

from conftest import SMALL


def test_snapshot_is_fresh_after_build(spark):
    path = storage.build_snapshot(spark, SMALL)
    assert storage.fresh_snapshot(spark, SMALL) is not None
    assert storage.is_fresh(spark, path, *storage._sources(SMALL))


@pytest.fixture
def own(spark):
    """A source folder and a snapshot built from it."""
    d = tempfile.mkdtemp(prefix="ll-fresh-")
    src, snap = os.path.join(d, "src"), os.path.join(d, "snap")
    spark.range(3).write.parquet(src)
    time.sleep(0.05)
    storage.write_snapshot(spark.range(3).withColumn("year", F.lit(2020)), snap, [src, os.path.join(d, "absent")])
    return src, snap, os.path.join(d, "absent")


def test_stale_when_source_changes(spark, own):
    src, snap, absent = own
    assert storage.is_fresh(spark, snap, [src], [absent])
    assert not storage.is_fresh(spark, snap, [src, absent])  # a missing source is never fresh
    assert storage.last_modified(spark, [absent]) == 0.0
    spark.range(5).write.mode("append").parquet(src)
    assert not storage.is_fresh(spark, snap, [src], [absent])
    storage.refresh(spark, [src])


def test_an_append_does_not_make_a_stale_snapshot_fresh(spark, own):
    src, snap, absent = own
    spark.range(5).write.mode("append").parquet(src)
    assert storage.append_part(spark.range(2).withColumn("year", F.lit(2021)), snap, ("x", 0)) == 2
    assert not storage.is_fresh(spark, snap, [src], [absent])


def test_damaged_or_unpublished_parts_are_not_used(spark, own):
    src, snap, absent = own
    manifest = storage.read_manifest(spark, snap)
    # a part that was written but never published is not read
    storage.write_part(spark.range(7).withColumn("year", F.lit(1)), snap, "base-other")
    assert storage.read_snapshot(spark, snap).count() == 3 and storage.is_fresh(spark, snap, [src], [absent])
    part = glob.glob(f"{snap}/data/part={manifest['parts'][0]['name']}/**/part-*.parquet", recursive=True)[0]
    os.remove(part)
    assert not storage.is_fresh(spark, snap, [src], [absent])


def test_rebuild_keeps_appended_parts_and_old_readers(spark, own):
    src, snap, absent = own
    storage.append_part(spark.range(10, 12).withColumn("year", F.lit(2021)), snap, ("x", 0))
    reader = storage.read_snapshot(spark, snap)
    storage.write_snapshot(spark.range(4).withColumn("year", F.lit(2020)), snap, [src])
    assert reader.count() == 5  # the replaced base is still there for who reads it
    assert storage.read_snapshot(spark, snap).count() == 6
    assert storage.vacuum(spark, snap, keep_seconds=0) == 1
    assert storage.read_snapshot(spark, snap).count() == 6


def test_freshness_report(spark):
    storage.build_snapshot(spark, SMALL)
    r = storage.freshness_report(spark, SMALL).first()
    assert r["snapshot_is_fresh"] is True and r["snapshot_rows"] == 6000 and r["snapshot_parts"] >= 1
    assert abs(r["source_last_modified"].timestamp() - os.path.getmtime(f"{SMALL}/lineitem.parquet")) < 86400 * 3660


def test_freshness_window_can_be_turned_off(spark):
    storage.build_snapshot(spark, SMALL)
    a = storage.fresh_snapshot(spark, SMALL)
    assert storage.fresh_snapshot(spark, SMALL) is a
    assert storage.fresh_snapshot(spark, SMALL, ttl=0) is not a


def test_csv_export_loses_nothing(spark):
    from ledgerlens.sources.load import read_sales
    texts = ["plain", "two\nlines", "cr\r\nlf", 'quo"te', '"', "back\\slash", "\\", "\\N", "\\\\N", " lead", "trail ", "", None, "a,b",
             "\ttab", "'", "\\n", "\\\n", "\\\\n", "\\r\r\\", "\n", "\\\\\\N"]
    d = tempfile.mkdtemp(prefix="ll-csv-")
    when = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([(str(i), when, t) for i, t in enumerate(texts)], "invoice_no string, invoice_date timestamp, company string")
    storage.export_csv(df.repartition(3), f"{d}/out")
    got = {int(r["invoice_no"]): r for r in read_sales(spark, f"{d}/out", fmt="csv").collect()}
    assert [got[i]["company"] for i in range(len(texts))] == texts
    assert {r["invoice_date"] for r in got.values()} == {when}


def test_a_large_part_file_is_read_by_several_tasks(spark):
    from ledgerlens.sources.load import read_sales
    d = tempfile.mkdtemp(prefix="ll-csv-")
    df = spark.range(20_000).select(F.col("id").cast("string").alias("invoice_no"),
                                    F.concat(F.lit('a "quoted",\nline\\n '), F.col("id").cast("string"), F.lit("\r\n")).alias("company"))
    storage.export_csv(df.coalesce(1), f"{d}/out")
    assert len(glob.glob(f"{d}/out/part-*.csv")) == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = read_sales(spark, f"{d}/out", fmt="csv")
        assert back.rdd.getNumPartitions() > 3
        assert back.select("invoice_no", "company").exceptAll(df).count() == 0 and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_exports_with_line_breaks_in_quotes_are_read(spark):
    """Files of others, and exports of earlier versions: no marker, one task per file."""
    from ledgerlens.sources.load import read_sales
    d = tempfile.mkdtemp(prefix="ll-csv-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.csv", "w", newline="") as f:
        f.write('Invoice No,Company/Individual\n1,"two\nlines, ""x"""\n2,\\\\N\n3,\\N\n4,back\\n\n')
    rows = {r["invoice_no"]: r["company"] for r in read_sales(spark, f"{d}/in", fmt="csv").collect()}
    assert rows == {"1": 'two\nlines, "x"', "2": "\\N", "3": None, "4": "back\\n"}


def test_missing_sales_source_raises(spark):
    import pytest
    from pyspark.errors import AnalysisException

    from ledgerlens.sources.load import read_sales
    with pytest.raises(AnalysisException):
        read_sales(spark, "/nonexistent/sales.parquet")


def test_product_codes_from_file(spark):
    from ledgerlens.sources.load import product_categories, read_product_codes
    d = tempfile.mkdtemp(prefix="ll-codes-")
    spark.createDataFrame([("chair", "F"), ("lamp", " l "), ("chair", "L")],
                          "Description string, `Landscape or Furniture` string") \
        .write.option("header", True).csv(f"{d}/codes")
    cats = {r["description"]: r["category"]
            for r in product_categories(read_product_codes(spark, f"{d}/codes")).collect()}
    assert cats == {"chair": "Furniture", "lamp": "Landscape"}
    assert read_product_codes(spark, f"{d}/absent") is None
    assert product_categories(read_product_codes(spark, f"{d}/absent")) is None


def test_category_lookup_is_reused_and_refresh_forgets_it(spark):
    from ledgerlens import sources
    a = sources.category_lookup(spark, SMALL)
    assert sources.category_lookup(spark, SMALL) is a
    storage.refresh(spark, [SMALL])
    assert sources.category_lookup(spark, SMALL) is not a
