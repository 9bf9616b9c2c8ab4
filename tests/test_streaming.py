"""Incremental snapshot refresh: each export file is taken exactly once, next to the base."""

import os
import subprocess
import sys
import tempfile

from ledgerlens import sources
from ledgerlens.sources import storage
from ledgerlens.sources.manifest import commit
from ledgerlens.sources.fixtures import sales_lines
from ledgerlens.streaming import refresh
from ledgerlens.streaming.refresh import refresh_snapshot

from conftest import SMALL


def test_refresh_takes_new_files_once(spark):
    base = tempfile.mkdtemp(prefix="ll-stream-")
    lines = sales_lines(spark, SMALL)
    n = lines.count()
    storage.export_csv(lines, f"{base}/incoming/batch-1")
    args = (spark, f"{base}/incoming", f"{base}/snapshot", f"{base}/ckpt")
    assert refresh_snapshot(*args) == n
    assert refresh_snapshot(*args) == 0          # nothing new: nothing appended
    storage.export_csv(lines.limit(10), f"{base}/incoming/batch-2")
    assert refresh_snapshot(*args) == 10
    snap = storage.read_snapshot(spark, f"{base}/snapshot")
    assert snap.count() == n + 10
    assert "year" in snap.columns


def test_refresh_adds_to_a_built_snapshot(spark):
    """Build, append into the same snapshot with the default checkpoint: reports see both."""
    path = storage.build_snapshot(spark, SMALL)
    before = sources.sales(spark, SMALL).count()
    base = tempfile.mkdtemp(prefix="ll-stream-")
    storage.export_csv(sales_lines(spark, SMALL).limit(10), f"{base}/incoming/a")
    assert refresh_snapshot(spark, f"{base}/incoming", path, categories=sources.categories(spark, SMALL)) == 10
    now = sources.sales(spark, SMALL)
    assert now.count() == before + 10
    assert dict(now.dtypes)["invoice_no"] == "bigint"
    storage.export_csv(sales_lines(spark, SMALL).limit(5), f"{base}/incoming/b")
    assert refresh_snapshot(spark, f"{base}/incoming", path) == 5
    assert sources.sales(spark, SMALL).count() == before + 15
    # leave the shared snapshot as the sources have it
    commit(spark, path, lambda before, _: {**before, "parts": storage.base_parts(before)})
    storage.forget_freshness()


def test_a_replayed_batch_counts_once(spark):
    base = tempfile.mkdtemp(prefix="ll-stream-")
    df = sources.clean_sales(sales_lines(spark, SMALL).limit(20))
    assert storage.append_part(df, f"{base}/snap", ("stream", 0)) == 20
    assert storage.append_part(df, f"{base}/snap", ("stream", 0)) == 0
    assert storage.read_snapshot(spark, f"{base}/snap").count() == 20


def test_default_checkpoint_is_the_same_in_every_process():
    code = "from ledgerlens.streaming.refresh import stream_key; print(stream_key('/in/', '/snap'))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = {subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONHASHSEED": seed},
                            capture_output=True, text=True, check=True).stdout.strip() for seed in ("1", "2")}
    assert names == {refresh.stream_key("/in", "/snap/")}
