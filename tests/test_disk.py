"""What writing, refreshing and merging leave on disk, and that slices lose no line."""

import glob
import gzip
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import session, sources
from ledgerlens.sources import compaction, corrections, exports, storage
from ledgerlens.sources.manifest import read_manifest
from ledgerlens.streaming.refresh import refresh_snapshot

HEADER = "Invoice No,Invoice Date,Qty,Company/Individual\n"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="ll-disk-")


def put(path: str, numbers, qty: int = 1) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = HEADER + "".join(f"{i},{'' if i % 7 == 0 else f'{2000 + i % 4}-02-0{1 + i % 9}'},{qty},c {i % 3}\n" for i in numbers)
    with (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")) as f:
        f.write(text)


def rows_of(df) -> list:
    return sorted((tuple(map(str, r)) for r in df.select("invoice_no", "invoice_date", "qty", "company", "year").collect()))


def shuffle_files(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_part_leaves_no_shuffle_files(spark, folder):
    before = shuffle_files(spark)
    lines = spark.range(2000).select(F.col("id").alias("invoice_no"), (F.col("id") % 5 + 2000).cast("int").alias("year"))
    storage.append_part(lines, f"{folder}/snap")
    storage.export_csv(lines.repartition(3, "year"), f"{folder}/out")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


def test_the_sessions_setting_is_back_after_the_last_user(spark):
    assert spark.conf.get(session.FREE_SHUFFLES, None) is None
    with session.shuffles_freed(spark):
        with pytest.raises(ValueError), session.shuffles_freed(spark):
            raise ValueError
        assert spark.conf.get(session.FREE_SHUFFLES, None) == "true"
    assert spark.conf.get(session.FREE_SHUFFLES, None) is None


def test_compressed_exports_are_bounded_and_read_back(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "COMPRESSED_LINES", 40)
    df = spark.range(100).select(F.col("id").cast("string").alias("invoice_no"), F.concat(F.lit("a\n\\b,\""), F.col("id").cast("string")).alias("company"))
    storage.export_csv(df.coalesce(1), f"{folder}/out", "gzip")
    files = glob.glob(f"{folder}/out/part-*.csv.gz")
    assert len(files) == 3
    assert exports.header_of(spark, files[0]) == ("invoice_no", "company")
    back = sources.load.read_sales(spark, f"{folder}/out", fmt="csv").select("invoice_no", "company")
    assert back.count() == 100 and back.exceptAll(df).count() == 0


def test_lines_without_a_file_have_no_hashes(spark, folder):
    storage.append_part(spark.range(5), f"{folder}/snap")
    put(f"{folder}/in/a.csv", range(5))
    refresh_snapshot(spark, f"{folder}/in", f"{folder}/other", f"{folder}/ckpt")
    for snap, hashed in (("snap", 0), ("other", 5)):
        kept = spark.read.parquet(f"{folder}/{snap}/data")
        assert [kept.filter(F.col(c).isNotNull()).count() for c in storage.HASHES] == [hashed] * 2


def _refreshed(spark, folder: str) -> tuple[list, list]:
    """Four exports, then two corrected and one added; the lines before and after."""
    for name, numbers in {"a.csv": range(30), "b.csv.gz": range(30, 60), "c.csv": range(60, 70), "d.csv.gz": range(70, 90)}.items():
        put(f"{folder}/in/{name}", numbers)
    run = (spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt")
    assert refresh_snapshot(*run) == 90
    first = rows_of(storage.read_snapshot(spark, f"{folder}/snap"))
    put(f"{folder}/in/a.csv", range(1, 30))
    put(f"{folder}/in/b.csv.gz", [*range(35, 60), 40, 40], qty=2)
    put(f"{folder}/in/e.csv", range(90, 100))
    refresh_snapshot(*run)
    return first, rows_of(storage.read_snapshot(spark, f"{folder}/snap"))


def test_slices_lose_no_line(spark, folder, monkeypatch):
    """Appended, corrected and merged in many slices as in one."""
    whole = _refreshed(spark, f"{folder}/whole")
    sizes = {"append": [], "merge": []}
    written = storage.write_part

    def write(df, path, name, rollup=None, more=()):
        sizes["merge" if name.startswith("merged") else "append"].append(1 + len(more))
        return written(df, path, name, rollup, more)

    for module in (storage, corrections, compaction):
        monkeypatch.setattr(module, "write_part", write)
    monkeypatch.setattr(storage, "SLICE_BYTES", 1)
    assert _refreshed(spark, f"{folder}/slices") == whole
    assert sizes["append"][0] == 4 and max(sizes["append"][1:]) > 1
    parts = len(read_manifest(spark, f"{folder}/slices/snap")["parts"])
    assert parts > 1 and compaction.compact(spark, f"{folder}/slices/snap", fan_in=parts) == 1
    assert sizes["merge"] == [sizes["merge"][0]] and sizes["merge"][0] > 4  # undated lines among them
    assert rows_of(storage.read_snapshot(spark, f"{folder}/slices/snap")) == whole[1]
    # rollups of all slices add up to the table's
    now = read_manifest(spark, f"{folder}/slices/snap")
    lines = storage.read_rollups(spark, f"{folder}/slices/snap", now).filter("dimension = 'line'").agg(F.sum("lines")).first()[0]
    assert lines == len(whole[1])


def test_only_lines_of_corrected_exports_are_looked_up(spark, folder):
    _refreshed(spark, folder)
    now = read_manifest(spark, f"{folder}/snap")
    assert [[e.rpartition("/")[2] for e in r["exports"]] for r in now["removals"]] == [["a.csv", "b.csv.gz"]]
    # a removal of an earlier version does not say which
    old = {**now, "removals": [{k: v for k, v in r.items() if k != "exports"} for r in now["removals"]]}
    assert rows_of(storage.read_snapshot(spark, f"{folder}/snap")) == rows_of(storage.read_snapshot(spark, f"{folder}/snap", manifest=old))


def test_lines_are_not_shuffled_for_a_small_lookup(spark, folder):
    """The product list may be large where its categories are few."""
    parts = spark.range(20_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("word colour"), F.col("id") % 5).alias("p_name"),
                                       F.lit("Brand#3").alias("p_brand"), F.lit(1).alias("p_size"))
    parts.write.parquet(f"{folder}/part.parquet")
    lookup = sources.stored_categories(session.configure(spark), folder)
    assert sorted(map(tuple, lookup.collect())) == sorted(map(tuple, sources.categories(spark, folder).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        lines = spark.range(10).select(F.concat(F.lit("Brand#3 colour"), F.col("id") % 7).alias("short_description"))
        plan = sources.with_category(lines, lookup)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
