"""Reports from rollups equal those from the lines, and read nothing but rollups."""

import os
import tempfile
import time
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerlens import sources
from ledgerlens.operators import kpis, reports, rollups
from ledgerlens.operators.filters import SalesFilter
from ledgerlens.plans import catalog
from ledgerlens.sources import compaction, corrections, storage
from ledgerlens.streaming.refresh import refresh_snapshot

from conftest import SMALL

REPORTS = ["monthly_revenue", "revenue_by_type", "quarterly_revenue", "revenue_by_status", "revenue_by_payment", "top_products",
           "item_type_counts", "product_table", "colour_revenue", "colour_units", "top_towns"]


@pytest.fixture(scope="module")
def snapshot(spark):
    return catalog._corrected_snapshot(spark, SMALL)


def rollup_of(spark, path):
    return storage.read_rollups(spark, path, storage.read_manifest(spark, path))


def same(a, b):
    assert a.columns == b.columns
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


@pytest.mark.parametrize("name", REPORTS)
def test_report_equals_the_line_scan(spark, snapshot, name):
    path, lines = snapshot
    assert storage.read_manifest(spark, path)["removals"]
    same(getattr(rollups, name)(rollup_of(spark, path)), getattr(reports, name)(lines))


def test_a_date_range_equals_the_filtered_lines(spark, snapshot):
    path, lines = snapshot
    flt = SalesFilter(date_start="1994-03-05", date_end="1996-11-30")
    part = rollups.between(rollup_of(spark, path), "1994-03-05", "1996-11-30")
    for name in REPORTS:
        same(getattr(rollups, name)(part), getattr(reports, name)(flt.apply(lines)))


def test_profile_values_and_growth(spark, snapshot):
    path, lines = snapshot
    rollup = rollup_of(spark, path)
    same(rollups.data_profile(rollup, lines.columns), kpis.data_profile(lines))
    same(rollups.filter_values(rollup), kpis.filter_values(lines))
    same(rollups.growth(rollup, lines), kpis.growth(lines))


@pytest.mark.parametrize("hour", [0, 7, 23])
def test_growth_with_times_of_day(spark, hour):
    """Lines at every hour, some exactly on a window's edge and a second beside it."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) - F.col("id") * 50_021)
    edges = [0, 30, 60, 90, 180, 365, 730]
    lines = spark.range(1500).select(at.alias("invoice_date"), (F.col("id") % 97).cast("decimal(30,6)").alias("total_price"))
    last = F.timestamp_seconds(F.lit(1_600_000_000 + 3600 * hour))
    for n in edges:
        for s in (-1, 0, 1):
            if n or s < 1:
                extra = spark.range(1).select((last - F.make_interval(days=F.lit(n), secs=F.lit(-s))).alias("invoice_date"),
                                              F.lit(1000 + n + s).cast("decimal(30,6)").alias("total_price"))
                lines = lines.unionByName(extra)
    lines = lines.withColumns({"qty": F.lit(1.0), "year": F.year("invoice_date")}).cache()
    same(rollups.growth(rollups.roll_up(lines), lines), kpis.growth(lines))


def test_empty_and_undated_lines(spark):
    lines = sources.clean_sales(sources.sales_lines(spark, SMALL)).withColumn("product_category", F.lit(None).cast("string"))
    for some in (lines.limit(0), lines.where("invoice_date IS NULL")):
        rollup = rollups.roll_up(some)
        for name in REPORTS:
            same(getattr(rollups, name)(rollup), getattr(reports, name)(some))
        same(rollups.growth(rollup, some), kpis.growth(some))
        same(rollups.data_profile(rollup, some.columns), kpis.data_profile(some))


def test_rollups_add_up_and_subtract(spark):
    lines = sources.clean_sales(sources.sales_lines(spark, SMALL))
    whole, third = rollups.roll_up(lines), F.col("invoice_no") % 3 == 0
    apart = rollups.roll_up(lines.where(third)).unionByName(rollups.roll_up(lines.where(~third)))
    left = whole.unionByName(rollups.negative(rollups.roll_up(lines.where(~third))))
    rows = lambda df: sorted(map(str, df.select(*rollups.KEYS, *rollups.MEASURES).collect()))
    assert rows(rollups.merged(apart)) == rows(whole)
    assert rows(rollups.merged(left)) == rows(rollups.roll_up(lines.where(third)))


def test_reports_read_rollups_only(spark):
    path = storage.build_snapshot(spark, SMALL)
    for name in REPORTS + ["data_profile", "filter_values"]:
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        scans = [x for x in plan.split("\n") if "InMemoryFileIndex" in x or "Location:" in x]
        assert scans and all("/rollups/" in x for x in scans), name
    plan = catalog.QUERIES["growth"](spark, SMALL)._jdf.queryExecution().toString()
    assert "/rollups/" in plan and "/data/" in plan and "PushedFilters" in plan
    assert path


def test_merges_keep_rollups_right(spark):
    base = tempfile.mkdtemp(prefix="ll-roll-")
    lines = sources.sales_lines(spark, SMALL).limit(600).cache()
    for i in range(3):
        storage.export_csv(lines.where(F.col("invoice_no") % 3 == i), f"{base}/in/e{i}")
        refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    time.sleep(0.01)
    storage.export_csv(lines.where("invoice_no % 3 = 1 AND invoice_no % 2 = 0"), f"{base}/in/e1")
    refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    check = lambda: same(rollups.item_type_counts(rollup_of(spark, f"{base}/snap")),
                         reports.item_type_counts(storage.read_snapshot(spark, f"{base}/snap")))
    check()
    assert compaction.compact(spark, f"{base}/snap", fan_in=2, keep_seconds=0) > 0
    check()
    left = set(os.listdir(f"{base}/snap/rollups"))
    assert left == {f"part={p['name']}" for p in storage.read_manifest(spark, f"{base}/snap")["parts"]}
    storage.append_part(spark.range(2), f"{base}/other")
    assert storage.read_rollups(spark, f"{base}/other", storage.read_manifest(spark, f"{base}/other")) is None


def test_merged_parts_have_the_sum_of_their_rollups(spark, monkeypatch):
    """No line is rolled up again by a merge, also where a correction took lines out."""
    base = tempfile.mkdtemp(prefix="ll-roll-")
    lines = sources.sales_lines(spark, SMALL).limit(600).cache()
    for i in range(3):
        storage.export_csv(lines.where(F.col("invoice_no") % 3 == i), f"{base}/in/e{i}")
        refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    time.sleep(0.01)
    storage.export_csv(lines.where("invoice_no % 3 = 1 AND invoice_no % 2 = 0"), f"{base}/in/e1")
    refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    roll_up = rollups.roll_up
    with monkeypatch.context() as m:
        m.setattr(rollups, "roll_up", lambda *a: pytest.fail("lines rolled up again"))
        assert compaction.compact(spark, f"{base}/snap", fan_in=2, keep_seconds=0) > 0
    rows = lambda df: sorted(map(str, df.select(*rollups.KEYS, *rollups.MEASURES).collect()))
    parts = storage.read_manifest(spark, f"{base}/snap")["parts"]
    assert len(parts) == 1 and rows(rollup_of(spark, f"{base}/snap")) == rows(roll_up(storage.read_snapshot(spark, f"{base}/snap")))


def test_parts_of_other_columns_are_rolled_up_anew(spark):
    base = tempfile.mkdtemp(prefix="ll-roll-")
    lines = sources.clean_sales(sources.sales_lines(spark, SMALL).limit(50))
    for _ in range(2):
        storage.append_part(lines.withColumn("product_category", F.lit("Furniture")), f"{base}/snap")
    storage.write_snapshot(lines, f"{base}/snap")
    now = storage.read_manifest(spark, f"{base}/snap")
    assert storage.parts_rollup(spark, f"{base}/snap", now, storage.export_parts(now)) is None
    assert compaction.compact(spark, f"{base}/snap", fan_in=2, keep_seconds=0) == 1
    rows = lambda df: sorted(map(str, df.select(*rollups.KEYS, *rollups.MEASURES).collect()))
    assert rows(rollups.merged(rollup_of(spark, f"{base}/snap"))) == rows(rollups.roll_up(storage.read_snapshot(spark, f"{base}/snap")))


def test_sums_are_exact_and_built_in_whole_numbers(spark):
    """Amounts of up to 24 digits and six decimals, of both signs; the sums are of longs."""
    texts = ["123456789012345678901234.654321", "-999999999999999999999999.999999", "999999999999.999999", "1000000000000.000000",
             "-1000000000000.000001", "-0.000001", "0.015625", "-7.250000", "0", None]
    amounts = [None if t is None else Decimal(t) for t in texts]
    rows = [(f"k{i % 3}", a, 1.5 * i) for i, a in enumerate(amounts * 3)] + [("none", None, 0.0)]
    lines = spark.createDataFrame(rows, "type string, total_price decimal(30,6), qty double").withColumn(
        "invoice_date", F.lit("2020-01-02").cast("timestamp"))
    rollup = rollups.roll_up(lines)
    got = {(r["dimension"], r["value"]): (r["revenue"], r["units"], r["lines"], r["cells"]) for r in rollup.collect()}
    with localcontext(prec=60):
        for key in ("k0", "k1", "k2", "none"):
            own = [r for r in rows if r[0] == key]
            paid = [r[1] for r in own if r[1] is not None]
            assert got["type", key] == (sum(paid) if paid else None, Decimal(sum(r[2] for r in own)), len(own), len(own) - len(paid))
    assert "sum(revenue_low" in rollup._jdf.queryExecution().toString()


def test_a_correction_reads_its_exports_once_and_sorts_by_hash(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="ll-roll-")
    lines = sources.sales_lines(spark, SMALL).limit(200).cache()
    storage.export_csv(lines, f"{base}/in/e")
    refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    time.sleep(0.01)
    storage.export_csv(lines.where("invoice_no % 3 = 1"), f"{base}/in/e")
    plans, write = [], corrections.write_part
    monkeypatch.setattr(corrections, "write_part", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or write(df, *a))
    refresh_snapshot(spark, f"{base}/in", f"{base}/snap", f"{base}/ckpt")
    assert len(plans) == 1 and "FileScan csv" not in plans[0] and "Join LeftSemi, ((_h1" in plans[0].replace("(((", "((")
    check = storage.read_snapshot(spark, f"{base}/snap")
    assert check.count() == lines.where("invoice_no % 3 = 1").count()
    same(rollups.item_type_counts(rollup_of(spark, f"{base}/snap")), reports.item_type_counts(check))
