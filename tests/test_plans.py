"""Physical plans: pushdown, pruning, bounded broadcasts, no Python in the hot path."""

from ledgerlens import sources
from ledgerlens.operators import kpis as K
from ledgerlens.operators import reports as R
from ledgerlens.plans.catalog import FILTERS
from ledgerlens.sources import storage

from conftest import SMALL


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_snapshot_scan(spark):
    storage.build_snapshot(spark, SMALL)
    s = sources.sales(spark, SMALL)
    p = plan(FILTERS["filter_combined"].apply(s))
    assert "PushedFilters" in p and "type" in p.split("PushedFilters")[1]
    assert "PartitionFilters" in p and "year" in p.split("PartitionFilters")[1]


def test_report_reads_only_needed_columns(spark):
    p = plan(R.monthly_revenue(sources.sales(spark, SMALL)))
    scans = [line for line in p.splitlines() if "ReadSchema" in line or "Scan parquet" in line]
    assert scans and all("company" not in line for line in scans)


def test_no_python_udf_in_reports(spark):
    s = sources.sales(spark, SMALL)
    for df in (K.kpis(s), K.growth(s), R.customer_value(s), R.colour_summary(s)):
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_lookup_side_is_broadcast_when_small(spark):
    from ledgerlens.sources.fixtures import sales_lines
    from ledgerlens.sources.load import clean_sales, with_category
    df = with_category(clean_sales(sales_lines(spark, SMALL)), sources.categories(spark, SMALL))
    assert "BroadcastHashJoin" in plan(df)


def test_lookup_join_shuffles_beyond_the_threshold(spark):
    from ledgerlens.sources.fixtures import sales_lines
    from ledgerlens.sources.load import clean_sales, with_category
    def run():
        df = with_category(clean_sales(sales_lines(spark, SMALL)), sources.categories(spark, SMALL))
        got = df.groupBy("product_category").count().collect()
        return plan(df), sorted((r[0] or "", r[1]) for r in got)
    _, small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, large = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small == large
    assert "coalesce(short_description" in p and "SortMergeJoin" in p


def test_growth_prunes_year_partitions(spark):
    storage.build_snapshot(spark, SMALL)
    p = plan(K.growth(sources.sales(spark, SMALL)))
    pruned = [x for x in p.split("PartitionFilters: [")[1:] if "subquery" in x.split("]")[0]]
    assert pruned and "year" in pruned[0].split("]")[0]


def test_colour_breakdown_aggregates_one_product(spark):
    storage.build_snapshot(spark, SMALL)
    df = R.colour_breakdown(sources.sales(spark, SMALL))
    p = plan(df)
    assert "ExistingRDD" not in p and "subquery" in p.lower()  # nothing was checkpointed to build it
    assert df.count() > 1


def test_colour_breakdown_keeps_no_table_of_orders(spark):
    """Orders are counted from sorted lines: no aggregate is keyed by the order."""
    p = plan(R.colour_breakdown_all(sources.sales(spark, SMALL)))
    keys = [line.split("functions=")[0] for line in p.splitlines() if "Aggregate(keys=" in line]
    assert "Window" in p and keys and not [k for k in keys if "invoice_no" in k]
