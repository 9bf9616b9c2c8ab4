"""Exports that change: columns in any order, corrected files, stale bases, parallel writers and merges of parts."""

import os
import shutil
import tempfile
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import sources
from ledgerlens.sources import compaction, corrections, exports, manifest, storage
from ledgerlens.sources.fixtures import SALES_SOURCE_TABLES, sales_lines, table_paths
from ledgerlens.sources.load import read_sales
from ledgerlens.streaming.refresh import refresh_snapshot

from conftest import SMALL


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="ll-change-")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def lines(df, columns=("invoice_no", "invoice_date", "company", "qty", "total_price", "colour")):
    return Counter(tuple(str(v) for v in r) for r in df.select(*[c for c in columns if c in df.columns]).collect())


ORDERS = ("Invoice No,Invoice Date,Company/Individual,Qty,Total Price\nINV0,2020-04-01,Zed,1,10\n",
          "Invoice Date,Invoice No,Total Price,Qty,Company/Individual\n2020-05-01,INV1,100,2,Acme\n",
          "Colour,Total Price,Shelf,Invoice No,Invoice Date\nred,7.5,A3,INV2,2020-06-01\n")


def test_columns_are_found_by_header(spark, folder):
    for i, text in enumerate(ORDERS):
        put(f"{folder}/in/b{i}/part.csv", text)
        refresh_snapshot(spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt")
    got = storage.read_snapshot(spark, f"{folder}/snap")
    want = read_sales(spark, f"{folder}/in", fmt="csv")
    assert lines(got) == lines(want)
    assert {(r["invoice_no"], r["company"], float(r["total_price"]), r["qty"], r["colour"]) for r in got.collect()} == {
        ("INV0", "Zed", 10.0, 1.0, None), ("INV1", "Acme", 100.0, 2.0, None), ("INV2", None, 7.5, 0.0, "red")}
    # all three in one batch
    refresh_snapshot(spark, f"{folder}/in", f"{folder}/once", f"{folder}/ckpt2")
    assert lines(storage.read_snapshot(spark, f"{folder}/once")) == lines(want)


def test_drift_is_reported(spark, folder):
    for i, text in enumerate(ORDERS):
        put(f"{folder}/in/b{i}.csv", text)
    rows = {os.path.basename(r["export"]): r for r in exports.drift_report(spark, f"{folder}/in").collect()}
    assert rows["b2.csv"]["unknown"] == ["Shelf"] and "qty" in rows["b2.csv"]["absent"]
    assert "qty" not in rows["b1.csv"]["absent"] and "order_date" in rows["b1.csv"]["absent"]
    refresh_snapshot(spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt")
    kept = {os.path.basename(r["export"]): r["unknown"] for r in storage.lineage(spark, f"{folder}/snap").collect()}
    assert kept == {"b0.csv": [], "b1.csv": [], "b2.csv": ["Shelf"]}


def test_headers_of_every_kind(spark, folder):
    put(f"{folder}/a.csv", '﻿Invoice No," Qty ","odd\nname",Qty\n1,2,x,3\n')
    put(f"{folder}/empty.csv", "")
    put(f"{folder}/only header.csv", "Invoice No,Qty\n")
    header = exports.header_of(spark, f"{folder}/a.csv")
    assert header == ("Invoice No", " Qty ", "odd\nname", "Qty")
    assert exports.resolve(header)[0] == {"invoice_no": 0, "qty": 1}
    assert exports.resolve(header)[2] == ["odd\nname", "Qty"]
    rows = exports.read_exports(spark, exports.drift(spark, exports.list_exports(spark, folder)), with_export=True).collect()
    assert [(r["invoice_no"], r["qty"]) for r in rows] == [("1", "2")]
    assert rows[0]["_export"] in {f["export"] for f in exports.list_exports(spark, folder)}


OWN = ("invoice_no", "invoice_date", "company", "qty")
HEADER = "Invoice No,Invoice Date,Qty,Company/Individual\n"


def corrected(n, twice=()):
    rows = [f"{i},2020-01-{i % 28 + 1:02d},{i % 5},company {i % 7}" for i in n] + [f"{i},2021-01-01,9,twice" for i in twice]
    return HEADER + "\n".join(rows) + "\n"


def test_a_corrected_export_replaces_its_lines(spark, folder):
    put(f"{folder}/in/a.csv", corrected(range(40), [1, 1, 1]))
    put(f"{folder}/in/b.csv", corrected(range(40)))  # the same lines in another file stay
    run = lambda: refresh_snapshot(spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt")
    assert run() == 83
    before = storage.read_manifest(spark, f"{folder}/snap")
    changed = corrected(range(1, 40), [1, 1, 1, 1]).replace("\n5,2020-01-06,0,", "\n5,2020-01-06,77,")
    put(f"{folder}/in/a.csv", changed + "39,2020-01-12,4,company 4\n")  # one removed, one changed, two doubled
    assert run() == 1
    after = storage.read_manifest(spark, f"{folder}/snap")
    assert {p["name"] for p in before["parts"]} < {p["name"] for p in after["parts"]}  # nothing was rewritten
    assert sum(r["rows"] for r in after["removals"]) == 1 + 1 + 1 + 3
    assert lines(storage.read_snapshot(spark, f"{folder}/snap"), OWN) == lines(read_sales(spark, f"{folder}/in", fmt="csv"), OWN)
    assert run() == 0
    # taken out for good by a merge, whatever comes later
    put(f"{folder}/in/c.csv", corrected([5]))
    put(f"{folder}/in/b.csv", corrected(range(3)))
    assert run() == 1 - 37
    assert compaction.compact(spark, f"{folder}/snap", fan_in=2, keep_seconds=0) > 0
    assert storage.read_manifest(spark, f"{folder}/snap")["removals"] == []
    assert lines(storage.read_snapshot(spark, f"{folder}/snap"), OWN) == lines(read_sales(spark, f"{folder}/in", fmt="csv"), OWN)
    assert run() == 0
    os.remove(f"{folder}/in/c.csv")
    assert run() == 0  # a file that is gone keeps its lines


def test_a_folder_written_again_is_one_export(spark, folder):
    """Spark's part files have new names every time; the folder is the export."""
    all_lines = sales_lines(spark, SMALL).limit(300).cache()
    run = lambda **k: refresh_snapshot(spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt", **k)
    storage.export_csv(all_lines.repartition(5), f"{folder}/in/a")
    assert run(max_files=2) == 300  # files of one export in several batches
    odd = F.col("qty").cast("int") % 2 == 1
    storage.export_csv(all_lines.filter(odd).repartition(3), f"{folder}/in/a")
    assert run() == all_lines.filter(odd).count() - 300
    assert lines(storage.read_snapshot(spark, f"{folder}/snap")) == lines(read_sales(spark, f"{folder}/in", fmt="csv"))
    assert run() == 0 and storage.lineage(spark, f"{folder}/snap").count() == 1


def test_nulls_and_empty_values_are_different_lines(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("company", "type", "status")])
    df = spark.createDataFrame([(None, "a", ""), ("a", None, ""), ("", "a", None), ("a", "", None), ("a", None, "")], schema)
    assert df.select(*storage.line_hashes(df)).distinct().count() == 4


def copy_of(folder, tables=SALES_SOURCE_TABLES):
    for t in tables:
        shutil.copy(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
        old = time.time() - 100
        os.utime(f"{folder}/{t}.parquet", (old, old))
    return folder


def test_appended_rows_stay_when_a_source_changes(spark, folder):
    sf = copy_of(folder)
    path = storage.build_snapshot(spark, sf)
    assert refresh_snapshot(spark, _exported(spark, f"{folder}/in/a", 10), path, f"{folder}/ckpt", sources.categories(spark, sf)) == 10
    assert sources.sales(spark, sf).count() == 6010
    want = sources.sales(spark, sf).groupBy("product_category").count().collect()
    os.utime(f"{folder}/lineitem.parquet")
    storage.forget_freshness()
    stale = sources.sales(spark, sf)
    assert not storage.is_fresh(spark, path, *storage._sources(sf))
    assert stale.count() == 6010 and "product_category" in stale.columns
    assert sorted(map(str, stale.groupBy("product_category").count().collect())) == sorted(map(str, want))
    names = {p["name"] for p in storage.export_parts(storage.read_manifest(spark, path))}
    time.sleep(0.05)
    storage.build_snapshot(spark, sf)
    now = storage.read_manifest(spark, path)
    assert {p["name"] for p in storage.export_parts(now)} == names and len(now["parts"]) == 2  # only the base was built anew
    assert sources.sales(spark, sf).count() == 6010
    # a changed product list: lines of exports get their category from it
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_brand", F.lit("Brand#3"))
    part.toPandas().to_parquet(f"{folder}/part.parquet")
    storage.build_snapshot(spark, sf)
    rows = storage.read_parts(spark, path, storage.read_manifest(spark, path), storage.export_parts(storage.read_manifest(spark, path)))
    fresh = sources.with_category(rows.drop("product_category"), sources.categories(spark, sf))
    assert lines(rows, ("invoice_no", "product_category")) == lines(fresh, ("invoice_no", "product_category"))


def test_lost_parts_of_exports_are_an_error(spark, folder):
    sf = copy_of(folder)
    path = storage.build_snapshot(spark, sf)
    refresh_snapshot(spark, _exported(spark, f"{folder}/in/a", 10), path, f"{folder}/ckpt")
    name = storage.export_parts(storage.read_manifest(spark, path))[0]["name"]
    shutil.rmtree(storage.part_path(path, name).removeprefix("file:"))
    storage.forget_freshness()
    with pytest.raises(RuntimeError, match="missing or damaged"):
        sources.sales(spark, sf)


def _exported(spark, path, n):
    storage.export_csv(sales_lines(spark, SMALL).limit(n), path)
    return os.path.dirname(path)


def test_parallel_appends_are_all_there(spark, folder):
    snap = f"{folder}/snap"
    storage.write_snapshot(spark.range(3).withColumn("year", F.lit(2020)), snap)
    with ThreadPoolExecutor(8) as pool:
        rows = list(pool.map(lambda i: storage.append_part(
            spark.range(10 * i, 10 * i + 2).withColumn("year", F.lit(2021)), snap, (f"stream {i}", 0)), range(8)))
    now = storage.read_manifest(spark, snap)
    assert rows == [2] * 8 and len(now["parts"]) == 9 and now["version"] == 9
    assert storage.read_snapshot(spark, snap).count() == 3 + 16
    assert sorted(now["applied"]) == [f"stream {i}" for i in range(8)]


def test_a_version_is_published_once(spark, folder):
    assert manifest.publish(spark, folder, {"parts": ["a"]}, 1)
    assert not manifest.publish(spark, folder, {"parts": ["b"]}, 1)
    assert manifest.read_manifest(spark, folder)["parts"] == ["a"]
    with ThreadPoolExecutor(8) as pool:
        wins = list(pool.map(lambda i: manifest.publish(spark, folder, {"parts": [i]}, 2), range(8)))
    assert sum(wins) == 1 and manifest.read_manifest(spark, folder)["parts"] == [wins.index(True)]
    assert not [n for n in os.listdir(f"{folder}/manifests") if n.endswith(".tmp")]


def test_a_batch_counts_once_even_after_a_merge(spark, folder):
    df = spark.range(5).withColumn("year", F.lit(2020))
    assert storage.append_part(df, folder, ("s", 0)) == 5 and storage.append_part(df, folder, ("s", 0)) == 0
    assert storage.append_part(df, folder, ("s", 1)) == 5
    assert compaction.compact(spark, folder, fan_in=2) == 1
    assert storage.append_part(df, folder, ("s", 0)) == 0 and storage.append_part(df, folder, ("s", 1)) == 0
    assert storage.read_snapshot(spark, folder).count() == 10


def test_parts_grow_with_the_logarithm_of_batches():
    """A thousand batches of any size, planned as ``compact`` does."""
    for size in (lambda i: 1000, lambda i: 1 << (i % 24), lambda i: 3_000_000):
        parts, rewritten, most = [], 0, 0
        for i in range(1000):
            parts.append({"name": str(i), "bytes": size(i), "seq": i, "rows": 1})
            while group := compaction.plan_merge(parts, 4):
                names = {p["name"] for p in group}
                parts = [p for p in parts if p["name"] not in names] + [{
                    "name": group[0]["name"], "bytes": sum(p["bytes"] for p in group), "seq": i,
                    "rows": sum(p["rows"] for p in group), "merges": max(p.get("merges", 0) for p in group) + 1}]
                rewritten += sum(p["rows"] for p in group)
            most = max(most, len(parts))
        assert sum(p["rows"] for p in parts) == 1000
        assert most <= 3 * 12 and rewritten <= 1000 * 12


def test_readers_never_see_a_mixture(spark, folder):
    snap = f"{folder}/snap"
    for i in range(9):
        storage.append_part(spark.range(i * 10, i * 10 + 10).withColumn("year", F.lit(2000 + i % 2)), snap, ("s", i))
    old = storage.read_snapshot(spark, snap)
    seen, done = [], []

    def read():
        while not done:
            seen.append(storage.read_snapshot(spark, snap).select("id").agg(F.count("id"), F.sum("id")).first())

    with ThreadPoolExecutor(1) as pool:
        reader = pool.submit(read)
        merges = compaction.compact(spark, snap, fan_in=3)
        done.append(1)
        reader.result()
    assert merges == 4 and len(storage.read_manifest(spark, snap)["parts"]) == 1
    assert {tuple(r) for r in seen} == {(90, sum(range(90)))}
    assert old.count() == 90 and storage.read_snapshot(spark, snap).count() == 90
    # young folders stay for their readers, then go, and old versions with them
    assert storage.vacuum(spark, snap, keep_seconds=3600) == 0
    assert storage.vacuum(spark, snap, keep_seconds=0) == 12
    assert storage.read_snapshot(spark, snap).count() == 90
    assert len(manifest.versions(spark, snap)) <= manifest.KEPT_VERSIONS
    assert "retired" in storage.read_manifest(spark, snap) and storage.read_manifest(spark, snap)["retired"] == []


def test_a_merge_that_lost_its_parts_is_planned_anew(spark, folder):
    for i in range(2):
        storage.append_part(spark.range(2).withColumn("year", F.lit(2000)), folder, ("s", i))
    now = storage.read_manifest(spark, folder)
    compaction._merge(spark, folder, now, now["parts"], None)
    with pytest.raises(manifest.Conflict):
        compaction._merge(spark, folder, now, now["parts"], None)
    assert storage.read_snapshot(spark, folder).count() == 4


def test_unchanged_exports_are_not_compared(spark, folder):
    put(f"{folder}/in/a.csv", corrected(range(3)))
    refresh_snapshot(spark, f"{folder}/in", f"{folder}/snap", f"{folder}/ckpt")
    assert corrections.changed_exports(spark, exports.list_exports(spark, f"{folder}/in"), f"{folder}/snap").count() == 0
    assert corrections.apply_corrections(spark, f"{folder}/in", f"{folder}/snap") == (0, 0)
    assert corrections.apply_corrections(spark, f"{folder}/absent", f"{folder}/snap") == (0, 0)
    assert corrections.apply_corrections(spark, f"{folder}/in", f"{folder}/none") == (0, 0)


def test_a_merge_that_is_merged_again_is_not_written_between(spark, folder):
    for i in range(4):
        storage.append_part(spark.range(i * 10, i * 10 + 10).withColumn("year", F.lit(2000 + i % 2)), folder, ("s", i))
        assert compaction.compact(spark, folder, fan_in=2, smallest=1) == (0, 1, 0, 2)[i]
    parts = storage.read_manifest(spark, folder)["parts"]
    assert [(p["rows"], p["merges"]) for p in parts] == [(40, 2)]
    assert storage.vacuum(spark, folder, keep_seconds=0) == 5  # the batches and the first two merged
    assert sorted(r["id"] for r in storage.read_snapshot(spark, folder).collect()) == list(range(40))


def test_planned_merges_end_as_single_ones_do():
    for fan_in in (2, 3, 4):
        one, many = [], []
        for i in range(60):
            size = 1 << (i % 7 + 18)
            for parts in (one, many):
                parts.append({"name": f"p{i}", "bytes": size, "seq": i})
            while group := compaction.plan_merge(one, fan_in):
                names = {p["name"] for p in group}
                one = [p for p in one if p["name"] not in names] + [{
                    "name": f"m{i}-{group[0]['name']}", "bytes": sum(p["bytes"] for p in group), "seq": i,
                    "merges": max(p.get("merges", 0) for p in group) + 1}]
            while planned := compaction.plan_merges(many, fan_in):
                names = {p["name"] for p in planned[0]["of"]}
                many = [p for p in many if p["name"] not in names] + [{
                    "name": f"m{i}-{planned[0]['of'][0]['name']}", "bytes": planned[0]["bytes"], "seq": i, "merges": planned[0]["merges"]}]
            assert sorted((p["bytes"], p.get("merges", 0)) for p in one) == sorted((p["bytes"], p.get("merges", 0)) for p in many)


def test_an_export_is_named_without_regular_expressions(spark, folder):
    put(f"{folder}/in/a b.csv", corrected(range(3)))
    files = exports.drift(spark, exports.list_exports(spark, f"{folder}/in"))
    rows = exports.read_csv_exports(spark, files, with_export=True)
    assert {r["_export"] for r in rows.collect()} == {f["export"] for f in files}
    assert "regexp" not in rows._jdf.queryExecution().toString().lower().replace("rlike", "")  # one key per line
