"""Snapshots, freshness, reload and export.

A snapshot is a folder in the cluster's shared checkpoint folder:

* ``data/part=<name>/year=<y>/``: parts of the table, each written once and never changed.
* ``lineage/part=<name>/``: for a part made of exports, which ones, as they were.
* ``removals/part=<name>/``: hashes of lines that corrected exports no longer hold, with the
  parts they are taken out of (``corrections``).
* ``rollups/part=<name>/dimension=<d>/``: a part's lines added up by report key and day
  (``operators.rollups``); ``taken/part=<name>/``: the same of the lines a removal takes out.
* ``manifests/``: versions that name what makes up the table (``manifest``).

The base part is built from the source tables and belongs to them: when they change, only it is
built again. All other parts were made of export files and stay, whatever happens to the
base. Readers follow the newest version only, so half-written parts are never read and writers
do not disturb readers or each other.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rollups
from ..schema import DERIVED_COLUMNS, SALES_SCHEMA
from ..session import configure, scratch_dir, shared_root, shuffles_freed
from .exports import EXPORT, INLINE_MARK, states
from .fixtures import PRODUCT_SOURCE_TABLES, SALES_SOURCE_TABLES, table_paths
from .manifest import commit, file_system, forget_versions, read_manifest, retire

T_ = TypeVar("T_")

# Bump when the cleaned table's definition or layout changes, so old snapshots are ignored.
SNAPSHOT_VERSION = 3

# Column order of the cleaned, enriched table (``year`` is the partition column).
SNAPSHOT_COLUMNS = [f.name for f in SALES_SCHEMA.fields] + DERIVED_COLUMNS + ["product_category"]

# Parts stay for long and are read a few times: smaller files at some more CPU time.
PART_COMPRESSION = "zstd"
# A part of more (compressed) bytes for each core is written in slices, one job each: the shuffle files of
# one are gone before the next begins, so they do not grow with the part.
SLICE_BYTES = 32 << 20

# What a line needs to be rolled up.
ROLLED_COLUMNS = ("invoice_date", "total_price", "qty")

# A line's identity in parts made of exports: its file and 128 bits of its values (null without a file).
HASHES = ("_h1", "_h2")
IDENTITY = (EXPORT, *HASHES)
# in joins the hashes come first: rows are sorted by the first key, and exports share long names
IDENTITY_KEYS = [*HASHES, EXPORT]
IDENTITY_SCHEMA = T.StructType([T.StructField(EXPORT, T.StringType())] + [T.StructField(c, T.LongType()) for c in HASHES])
# ``as_of`` is the version the state was recorded in, null for the part's own
LINEAGE_SCHEMA = "export string, mtime long, bytes long, files long, absent array<string>, unknown array<string>, as_of long"


def snapshot_path(spark: SparkSession, sf_dir: str) -> str:
    key = hashlib.sha1(f"{sf_dir.rstrip('/')}|v{SNAPSHOT_VERSION}".encode()).hexdigest()[:16]
    return f"{shared_root(spark)}/ledgerlens-snapshots/{key}"


# --- files --------------------------------------------------------------------

def path_state(spark: SparkSession, path: str) -> dict | None:
    """Modification time (epoch ms), file count and bytes of a file or folder; None when absent.

    Two calls to the file system; no job and no file is opened. A folder's own time changes
    when files come or go; a file rewritten in place shows by its size.
    """
    fs, p = file_system(spark, path)
    try:
        summary = fs.getContentSummary(p)
        return {"mtime": fs.getFileStatus(p).getModificationTime(),
                "files": summary.getFileCount(), "bytes": summary.getLength()}
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return None
        raise


def last_modified(spark: SparkSession, paths: list[str]) -> float:
    """S5 helper: newest modification time (epoch seconds); 0 when absent."""
    states = [s for s in (path_state(spark, p) for p in paths) if s]
    return max((s["mtime"] for s in states), default=0) / 1000


# --- parts ----------------------------------------------------------------------

def part_path(path: str, name: str, kind: str = "data") -> str:
    return f"{path}/{kind}/part={name}"


def _complete(spark: SparkSession, path: str, parts: list[dict]) -> bool:
    """Every part is there with the files and bytes it was published with."""
    for part in parts:
        state = path_state(spark, part_path(path, part["name"]))
        if state is None or (state["files"], state["bytes"]) != (part["files"], part["bytes"]):
            return False
    return True


def line_hashes(df: DataFrame) -> list[Column]:
    """128 bits of a line's source values, nulls told apart from empty values."""
    columns = [f.name for f in SALES_SCHEMA.fields if f.name in df.columns]
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in enumerate(HASHES)]


def slice_bytes(spark: SparkSession) -> int:
    return SLICE_BYTES * max(1, spark.sparkContext.defaultParallelism)


def in_slices(spark: SparkSession, items: list[T_], size: Callable[[T_], int]) -> list[list[T_]]:
    """``items`` in their order, in groups of up to ``slice_bytes`` (at least one each)."""
    limit, groups, held = slice_bytes(spark), [], 0
    for item in items:
        if not groups or held + size(item) > limit:
            groups.append([])
            held = 0
        groups[-1].append(item)
        held += size(item)
    return groups


def _write_lines(df: DataFrame, target: str) -> None:
    writer = df.write
    if "year" in df.columns:
        order = ["year", "invoice_date"] if "invoice_date" in df.columns else ["year"]
        rows = df.hint("rebalance", "year")
        # hashes do not compress: they are made behind the shuffle
        rows = with_identity(rows) if EXPORT in df.columns and HASHES[0] not in df.columns else rows
        writer = rows.sortWithinPartitions(*order).write.partitionBy("year")
    elif EXPORT in df.columns and HASHES[0] not in df.columns:
        writer = with_identity(df).write
    writer.mode("append").option("compression", PART_COMPRESSION).parquet(target)


def write_part(df: DataFrame, path: str, name: str, rollup: DataFrame | None = None, more: Sequence[DataFrame] = ()) -> dict:
    """Write one part, partitioned by year for date-range pruning, and its ``rollup``, by default
    made of the lines as they were written. ``more`` are further slices of its lines, written one
    after another. Lines with a file get their hashes here unless they have them.

    The ``rebalance`` hint clusters rows by year before the write, and AQE splits a big year
    over several tasks and merges small ones, so each task writes about one advisory-size
    file. Within a task rows are sorted by invoice date, so row groups carry narrow date
    ranges. Names are new for every attempt: nothing under a reader is overwritten.
    """
    spark, target = df.sparkSession, part_path(path, name)
    with shuffles_freed(spark):
        for lines in (df, *more):
            _write_lines(lines, target)
        state, written = path_state(spark, target), spark.read.schema(df.schema).parquet(target)
        lines = written.drop(*IDENTITY)
        rolled = set(ROLLED_COLUMNS) <= set(df.columns)
        if rolled:
            ((rollups.roll_up(lines) if rollup is None else rollup).hint("rebalance", "dimension")
             .write.partitionBy("dimension").option("compression", PART_COMPRESSION).parquet(part_path(path, name, "rollups")))
        return {"name": name, "rows": written.count(), "files": state["files"], "bytes": state["bytes"], "rolled": rolled,
                "columns": sorted(lines.columns)}


def table_schema(manifest: dict) -> T.StructType:
    return T.StructType.fromJson(manifest["schema"])


def as_table(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns and types of a table; each line's file stays if it is known."""
    fields = [*schema.fields, *([IDENTITY_SCHEMA[EXPORT]] if EXPORT in df.columns else [])]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in fields])


def read_parts(spark: SparkSession, path: str, manifest: dict, parts: list[dict], identity: bool = False) -> DataFrame:
    """The rows of some parts without those that were taken out again; with ``identity`` also
    each line's export and hashes (null in the base) and its ``part``."""
    schema = table_schema(manifest)
    stored = T.StructType([*schema.fields, *IDENTITY_SCHEMA.fields, T.StructField("part", T.StringType())])
    wanted = [*schema.names, *((*IDENTITY, "part") if identity else ())]
    groups: dict[tuple[str, ...], list[dict]] = {}
    for part in parts:
        taken = tuple(r["name"] for r in manifest.get("removals", []) if part["name"] in r["parts"])
        groups.setdefault(taken, []).append(part)
    tables = []
    for taken, members in groups.items():
        rows = (spark.read.schema(stored).option("basePath", f"{path}/data")
                .parquet(*[part_path(path, p["name"]) for p in members]))
        if taken:
            # a removal holds for the parts it names only, so later copies of a line stay
            gone = spark.read.schema(IDENTITY_SCHEMA).parquet(*[part_path(path, name, "removals") for name in taken]).distinct()
            named = [r.get("exports") for r in manifest["removals"] if r["name"] in taken]
            if all(named):
                # only lines of these exports can be gone; the others are not shuffled
                among = F.coalesce(F.col(EXPORT).isin(sorted(set().union(*named))), F.lit(False))
                tables.append(rows.filter(~among).select(*wanted))
                rows = rows.filter(among)
            rows = rows.join(gone, IDENTITY_KEYS, "left_anti")
        tables.append(rows.select(*wanted))
    if not tables:
        return spark.createDataFrame([], T.StructType([f for f in stored.fields if f.name in wanted]))
    df = tables[0]
    for other in tables[1:]:
        df = df.unionByName(other)
    return df


def _year_bytes(spark: SparkSession, path: str, part: str) -> dict[str | None, int]:
    """Bytes of a part's years (None: undated lines)."""
    fs, folder = file_system(spark, part_path(path, part))
    years = {s.getPath().getName().removeprefix("year="): s.getPath() for s in fs.listStatus(folder) if s.isDirectory()}
    return {None if y == "__HIVE_DEFAULT_PARTITION__" else y: fs.getContentSummary(p).getLength() for y, p in years.items()}


def read_part_slices(spark: SparkSession, path: str, manifest: dict, parts: list[dict], identity: bool = False) -> list[DataFrame]:
    """``read_parts`` in slices of up to ``SLICE_BYTES`` for each core: neighbouring years of all parts, or some of
    the parts of one year. A year of one part is not split further."""
    schema = table_schema(manifest)
    kind = schema["year"].dataType if "year" in schema.names else None
    whole = [read_parts(spark, path, manifest, parts, identity)]
    if not isinstance(kind, T.IntegralType) or sum(p["bytes"] for p in parts) <= slice_bytes(spark):
        return whole
    by_year: dict[str | None, list[tuple[dict, int]]] = {}
    for part in parts:
        for year, size in _year_bytes(spark, path, part["name"]).items():
            by_year.setdefault(year, []).append((part, size))

    def rows(members: list[dict], years: list[str | None]) -> DataFrame:
        of_years = F.col("year").isin([int(y) for y in years if y is not None])
        return read_parts(spark, path, manifest, members, identity).filter(
            F.coalesce(of_years, F.lit(False)) | (F.col("year").isNull() if None in years else F.lit(False)))

    out, years = [], sorted(by_year, key=lambda y: (y is None, int(y or 0)))
    for group in in_slices(spark, years, lambda y: sum(size for _, size in by_year[y])):
        units = in_slices(spark, by_year[group[0]], lambda u: u[1]) if len(group) == 1 else [[(p, 0) for p in parts]]
        out += [rows([part for part, _ in unit], group) for unit in units]
    return out or whole


def base_parts(manifest: dict) -> list[dict]:
    return [p for p in manifest["parts"] if p["kind"] == "base"]


def export_parts(manifest: dict) -> list[dict]:
    return [p for p in manifest["parts"] if p["kind"] != "base"]


def write_snapshot(df: DataFrame, path: str, sources: list[str] | None = None) -> str:
    """Write the cleaned table as the snapshot's new base and publish it.

    Parts made of exports stay part of the table. Errors are raised, not swallowed.
    """
    spark = df.sparkSession
    state = {p: path_state(spark, p) for p in sources or []}  # taken before the sources are read
    built_at = int(time.time() * 1000)
    base = {**write_part(df, path, f"base-{uuid.uuid4().hex}"), "kind": "base"}

    def change(before: dict | None, version: int) -> dict:
        before = before or {"parts": [], "removals": [], "applied": {}}
        return {**before, "parts": [{**base, "seq": version}, *export_parts(before)], "sources": state, "built_at": built_at,
                "schema": json.loads(df.schema.json()), "retired": retire(before, [p["name"] for p in base_parts(before)])}

    commit(spark, path, change)
    return path


def with_export(df: DataFrame) -> DataFrame:
    """Rows with their file, null if it is not known."""
    return df if EXPORT in df.columns else df.withColumn(EXPORT, F.lit(None).cast("string"))


def with_identity(df: DataFrame) -> DataFrame:
    """Rows as a part of exports holds them. Only a file's lines are ever corrected: others need no hashes."""
    df = with_export(df)
    hashes = [F.when(F.col(EXPORT).isNotNull(), h).alias(name) for name, h in zip(HASHES, line_hashes(df))]
    return df.select(*[c for c in df.columns if c not in IDENTITY], EXPORT, *hashes)


def write_lineage(spark: SparkSession, path: str, name: str, files: list[dict]) -> None:
    rows = [(*(e[c] for c in ("export", "mtime", "bytes", "files", "absent", "unknown")), None) for e in states(files)]
    spark.createDataFrame(rows, LINEAGE_SCHEMA).coalesce(1).write.parquet(part_path(path, name, "lineage"))


def append_part(df: DataFrame, path: str, batch: tuple[str, int] | None = None, files: list[dict] | None = None,
                more: Sequence[DataFrame] = ()) -> int:
    """Add rows (``df`` and further slices) to a snapshot as a part of its own.

    Columns are cast to the snapshot's types; without a snapshot the part starts one. ``batch``
    (a stream's name and its batch number) is applied once: a batch at or below the last one
    of its stream is left out. ``files`` are the exports that the rows came from. Other
    writers may publish meanwhile. Returns the rows added.
    """
    spark = df.sparkSession
    empty = {"parts": [], "removals": [], "applied": {}, "sources": {}, "built_at": None,
             "schema": json.loads(T.StructType([f for f in df.schema.fields if f.name not in IDENTITY]).json())}
    now = read_manifest(spark, path) or empty
    if batch and now["applied"].get(batch[0], -1) >= batch[1]:
        return 0
    name = f"append-{uuid.uuid4().hex}"
    slices = [with_export(as_table(rows, table_schema(now))) for rows in (df, *more)]
    part = {**write_part(slices[0], path, name, None, slices[1:]), "kind": "append", "lineage": bool(files)}
    if files:
        write_lineage(spark, path, name, files)
    added = []

    def change(before: dict | None, version: int) -> dict | None:
        before = before or empty
        added.clear()
        if batch and before["applied"].get(batch[0], -1) >= batch[1]:
            return None
        added.append(part["rows"])
        applied = {**before["applied"], **({batch[0]: batch[1]} if batch else {})}
        return {**before, "parts": [*before["parts"], {**part, "seq": version}], "applied": applied}

    commit(spark, path, change)
    return sum(added)


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None,
                  manifest: dict | None = None) -> DataFrame:
    """S3: the table that the newest version describes, in its original column order."""
    manifest = manifest or read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no published snapshot at {path}")
    df = read_parts(spark, path, manifest, manifest["parts"])
    return df.select(*(columns or df.columns))


def read_rollups(spark: SparkSession, path: str, manifest: dict) -> DataFrame | None:
    """The table's lines added up by report key and day, from what its parts keep; None if a part
    keeps nothing (its rows are no sales lines)."""
    if not manifest["parts"] or not all(p.get("rolled") for p in manifest["parts"]):
        return None

    def read(kind: str, names: list[str], extra: str = "") -> DataFrame:
        return (spark.read.schema(rollups.ROLLUP_SCHEMA + extra).option("basePath", f"{path}/{kind}")
                .parquet(*[part_path(path, n, kind) for n in names]))

    columns = [*rollups.KEYS, *rollups.MEASURES]
    added = read("rollups", [p["name"] for p in manifest["parts"] if p["rows"]] or [manifest["parts"][0]["name"]]).select(*columns)
    removals = manifest.get("removals", [])
    if not removals:
        return added  # reports add the parts up
    # of a removal count the lines of the parts that it still holds for
    holds = F.array(*[F.concat_ws("/", F.lit(r["name"]), F.lit(p)) for r in removals for p in r["parts"]])
    taken = read("taken", [r["name"] for r in removals], ", part string, holder string").filter(
        F.array_contains(holds, F.concat_ws("/", "part", "holder")))
    return rollups.merged(added.unionByName(rollups.negative(taken.select(*columns))))


def parts_rollup(spark: SparkSession, path: str, manifest: dict, parts: list[dict]) -> DataFrame | None:
    """The rollup of the rows that ``read_parts`` gives for some parts, added up from their own; None
    if one keeps none or was rolled up with other columns than the table has now."""
    columns, names = sorted(table_schema(manifest).names), {p["name"] for p in parts}
    if not all(p.get("columns") == columns for p in parts):
        return None
    removals = [{**r, "parts": [p for p in r["parts"] if p in names]} for r in manifest.get("removals", [])]
    rollup = read_rollups(spark, path, {**manifest, "parts": parts, "removals": [r for r in removals if r["parts"]]})
    return None if rollup is None else rollups.merged(rollup)


def lineage(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """Per export: its state and columns when it was last read, in which version, and the parts
    with its lines (export, mtime, bytes, files, absent, unknown, as_of, parts)."""
    manifest = manifest or read_manifest(spark, path)
    parts = [p for p in (manifest or {"parts": []})["parts"] if p.get("lineage")]
    schema = LINEAGE_SCHEMA + ", part string"
    if not parts:
        return spark.createDataFrame([], LINEAGE_SCHEMA + ", parts array<string>")
    rows = (spark.read.schema(schema).option("basePath", f"{path}/lineage")
            .parquet(*[part_path(path, p["name"], "lineage") for p in parts]))
    order = spark.createDataFrame([(p["name"], p["seq"]) for p in parts], "part string, seq long")
    state = F.struct("mtime", "bytes", "files", "absent", "unknown", "as_of")
    return (rows.join(F.broadcast(order), "part")  # one row per part of the table
            .withColumn("as_of", F.coalesce("as_of", "seq"))
            .groupBy("export").agg(F.max_by(state, "as_of").alias("last"), F.sort_array(F.collect_set("part")).alias("parts"))
            .select("export", "last.*", "parts"))


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 3600) -> int:
    """Remove folders that left the table at least ``keep_seconds`` ago (readers may still hold
    younger ones), folders as old that were never published, and old versions; how many."""
    manifest, now, removed = read_manifest(spark, path), time.time() * 1000, 0
    if manifest is None:
        return 0
    due = {r["name"] for r in manifest.get("retired", []) if now - r["at"] >= keep_seconds * 1000}
    waiting = {r["name"] for r in manifest.get("retired", [])} - due
    named = waiting | {p["name"] for p in manifest["parts"]} | {r["name"] for r in manifest.get("removals", [])}
    for kind in ("data", "lineage", "removals", "rollups", "taken"):
        fs, folder = file_system(spark, f"{path}/{kind}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            name = status.getPath().getName().removeprefix("part=")
            if name in due or (name not in named and now - status.getModificationTime() >= keep_seconds * 1000):
                removed += bool(fs.delete(status.getPath(), True))
    if due:
        commit(spark, path, lambda before, _: {**before, "retired": [r for r in before.get("retired", []) if r["name"] not in due]})
    forget_versions(spark, path)
    return removed


# --- freshness --------------------------------------------------------------------

def is_fresh(spark: SparkSession, snapshot: str, sources: list[str],
             product_list: list[str] | None = None, manifest: dict | None = None) -> bool:
    """A published, complete base that is strictly newer than every source file, each source
    being as it was when the base was built (an absent product list stays absent)."""
    manifest = manifest or read_manifest(spark, snapshot)
    if manifest is None or manifest["built_at"] is None or not _complete(spark, snapshot, base_parts(manifest)):
        return False
    for path in [*sources, *(product_list or [])]:
        state = path_state(spark, path)
        if state is None and path in sources:
            return False
        if state != manifest["sources"].get(path) or (state and state["mtime"] >= manifest["built_at"]):
            return False
    return True


def forget_freshness() -> None:
    """Drop remembered freshness decisions (after a source is known to have changed)."""
    _FRESH.clear()


def _sources(sf_dir: str) -> tuple[list[str], list[str]]:
    sales = table_paths(sf_dir, SALES_SOURCE_TABLES)
    return sales, [p for p in table_paths(sf_dir, PRODUCT_SOURCE_TABLES) if p not in sales]


def build_snapshot(spark: SparkSession, sf_dir: str) -> str:
    """Build the cleaned, enriched table from the sources and store it as the base. Parts made
    of exports stay; they get the product categories anew if the product list has changed
    since they did."""
    from . import clean_sales, sales_lines, stored_categories, with_category
    from .compaction import rewrite
    configure(spark)
    lookup = stored_categories(spark, sf_dir)
    df = with_category(clean_sales(sales_lines(spark, sf_dir)), lookup)
    path = snapshot_path(spark, sf_dir)
    forget_freshness()
    sales, products = _sources(sf_dir)
    before = read_manifest(spark, path)
    lists = table_paths(sf_dir, PRODUCT_SOURCE_TABLES)
    changed = before and any(path_state(spark, p) != before["sources"].get(p) for p in lists)
    write_snapshot(df, path, sales + products)
    if changed and export_parts(before):
        rewrite(spark, path, export_parts, lambda rows: with_category(rows, lookup))
    vacuum(spark, path)
    return path


# A positive freshness decision is reused for this long within one application, as the source
# reuses its loaded table; within it a changed source is not seen. 0 checks on every call. A
# stale or missing snapshot is always checked again.
FRESH_TTL_SECONDS = 300
_FRESH: dict[tuple[str, str], tuple[float, DataFrame, dict]] = {}


def fresh_snapshot(spark: SparkSession, sf_dir: str, ttl: float | None = None) -> DataFrame | None:
    """The stored table if its base is fresh, else None."""
    ttl = FRESH_TTL_SECONDS if ttl is None else ttl
    path = snapshot_path(spark, sf_dir)
    key = (spark.sparkContext.applicationId, path)
    for old in [k for k, entry in _FRESH.items() if time.monotonic() - entry[0] >= ttl]:
        del _FRESH[old]
    if key in _FRESH:
        return _FRESH[key][1]
    manifest = read_manifest(spark, path)
    if manifest is None or not is_fresh(spark, path, *_sources(sf_dir), manifest=manifest):
        return None
    _check_exports(spark, path, manifest)
    df = read_snapshot(spark, path, manifest=manifest)
    df = df.select(*[c for c in SNAPSHOT_COLUMNS if c in df.columns])
    _FRESH[key] = (time.monotonic(), df, manifest)
    return df


def fresh_rollups(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The rollups of the version that ``fresh_snapshot`` reads, None without one."""
    if fresh_snapshot(spark, sf_dir) is None:
        return None
    path = snapshot_path(spark, sf_dir)
    entry = _FRESH.get((spark.sparkContext.applicationId, path))
    return read_rollups(spark, path, entry[2] if entry else read_manifest(spark, path))


def _check_exports(spark: SparkSession, path: str, manifest: dict) -> None:
    if not _complete(spark, path, export_parts(manifest)):
        raise RuntimeError(f"parts made of exports are missing or damaged in {path}; they cannot be built again from the tables")


def with_appended(spark: SparkSession, sf_dir: str, base: DataFrame, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``base``, just derived from the sources because the stored base is stale or absent, and the
    lines of exports that were appended to the snapshot, their categories looked up again."""
    path = snapshot_path(spark, sf_dir)
    manifest = read_manifest(spark, path)
    if manifest is None or not export_parts(manifest):
        return base
    _check_exports(spark, path, manifest)
    appended = enrich(read_parts(spark, path, manifest, export_parts(manifest)).drop("product_category"))
    return base.unionByName(appended.select(*[
        (F.col(f.name) if f.name in appended.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema.fields]))


def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 and A26 as a table: whether the stored base would be used, the snapshot's rows and
    parts, and when the sources last changed."""
    path = snapshot_path(spark, sf_dir)
    manifest = read_manifest(spark, path)
    sales, products = _sources(sf_dir)
    fresh = manifest is not None and is_fresh(spark, path, sales, products, manifest)
    changed = last_modified(spark, sales)
    rows = 0
    if manifest:
        rows = (read_snapshot(spark, path, manifest=manifest).count() if manifest.get("removals")
                else sum(p["rows"] for p in manifest["parts"]))
    row = (fresh, rows,
           len(manifest["parts"]) if manifest else 0, changed or None)
    return spark.createDataFrame(
        [row], "snapshot_is_fresh boolean, snapshot_rows long, snapshot_parts long, changed double").select(
        "snapshot_is_fresh", "snapshot_rows", "snapshot_parts",
        F.timestamp_millis((F.col("changed") * 1000).cast("long")).alias("source_last_modified"))


def snapshot_roundtrip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` as a snapshot under a fresh path and read it back."""
    path = scratch_dir(spark, "roundtrip")
    write_snapshot(df, path)
    return read_snapshot(spark, path, df.columns)


def refresh(spark: SparkSession, paths: list[str]) -> None:
    """Forget cached file listings, data, freshness decisions and lookups for changed
    sources."""
    from . import forget_lookups
    forget_freshness()
    forget_lookups()
    for p in paths:
        spark.catalog.refreshByPath(p)


# --- export -----------------------------------------------------------------------

# Null marker in exported CSV, so an empty text value ('') stays distinct from null.
CSV_NULL = "\\N"
# One set of options for writer and reader: RFC 4180 quoting, nothing trimmed.
CSV_OPTIONS = {
    "header": "true", "nullValue": CSV_NULL, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
# Exports of others may hold line breaks inside quoted values: a file is then one task's work.
# Ours write them in line (``in_line``), so that many tasks read one file.
CSV_READ_OPTIONS = {**CSV_OPTIONS, "multiLine": "true", "inferSchema": "false", "lineSep": "\n"}
CSV_INLINE_OPTIONS = {**CSV_READ_OPTIONS, "multiLine": "false"}


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unguard_null_marker(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text of exports with line breaks in quotes: what reads like the null marker had one more
    backslash."""
    return df.withColumns({c: F.when(F.col(c).rlike(r"^\\\\+N$"), F.substring(c, 2, 2 ** 31 - 1)).otherwise(F.col(c))
                           for c in columns or _text_columns(df)})


def in_line(df: DataFrame) -> DataFrame:
    """Text without line breaks: backslash, line feed and carriage return as a backslash and a letter
    (a text that reads like the null marker then has two backslashes)."""
    def code(c: str) -> Column:
        escaped = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return df.withColumns({c: code(c) for c in _text_columns(df)})


def from_in_line(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What ``in_line`` was made of: between double backslashes the others stand for line breaks."""
    def text(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return df.withColumns({c: F.when(F.contains(F.col(c), F.lit("\\")), F.array_join(F.transform(
        F.split(F.col(c), r"\\\\", -1), text), "\\")).otherwise(F.col(c)) for c in columns or _text_columns(df)})


# Lines of a compressed part file, which one task reads as a whole.
COMPRESSED_LINES = 500_000


def export_csv(df: DataFrame, path: str, compression: str | None = None) -> str:
    """Export with a header row, no index; ``load.read_sales(fmt="csv")`` reads it back.

    Written as a directory of part files (one per task) rather than funnelled
    through a single task; with a ``compression`` (``gzip``) of bounded part files. The marker ``_INLINE``
    is there before the first file is.
    """
    fs, folder = file_system(df.sparkSession, path)
    fs.delete(folder, True)
    fs.mkdirs(folder)
    fs.create(file_system(df.sparkSession, f"{path}/{INLINE_MARK}")[1]).close()
    options = {**CSV_OPTIONS, "emptyValue": '""', "lineSep": "\n"}
    if compression:
        options |= {"compression": compression, "maxRecordsPerFile": COMPRESSED_LINES}
    with shuffles_freed(df.sparkSession):
        in_line(df).write.mode("append").options(**options).csv(path)
    return path


def export_roundtrip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Export to CSV under a fresh path and load it back through the S1 reader."""
    from .load import read_sales
    path = scratch_dir(spark, "export")
    export_csv(df, path)
    return read_sales(spark, path, fmt="csv")
