"""Session helpers: results-relevant settings and the shared folder."""

from ledgerlens.session import checkpoint_dir, configure, shared_root


def test_configure_sets_utc_and_a_checkpoint_dir(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert checkpoint_dir(spark)


def test_shared_root_follows_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_root(spark) == root.rstrip("/")
    else:
        assert shared_root(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")
