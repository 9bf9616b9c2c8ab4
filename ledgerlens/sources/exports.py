"""Sales exports: files found by their headers, whatever the order of their columns.

Files of one header are read by one plan with that header's own layout, the plans are united by
column name. A column a file does not have is null there; columns nobody knows are left out;
``drift`` reports both.

An export is a file, or a folder that a job has marked complete (``_SUCCESS``): such a folder is
written, and written again, as a whole, under new file names.
"""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EXPECTED_COLUMNS, OPTIONAL_COLUMNS, SOURCE_NAMES
from .manifest import file_system

KNOWN_COLUMNS = EXPECTED_COLUMNS + list(OPTIONAL_COLUMNS.values())
HEADER_BYTES = 1 << 16
EXPORT = "_export"
# in a folder whose texts hold line breaks in line (``storage.in_line``)
INLINE_MARK = "_INLINE"


def _key(path) -> str:
    """A path in one spelling."""
    uri = path.toUri().toString()
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _describe(status, folder: str | None, inline: bool) -> dict:
    path = status.getPath()
    return {"path": path.toString(), "export": folder or _key(path), "in_folder": folder is not None, "inline": inline,
            "mtime": status.getModificationTime(), "bytes": status.getLen()}


def list_exports(spark: SparkSession, path: str) -> list[dict]:
    """Data files at and below ``path``: path, export (the key of the file or of its complete
    folder), in_folder, inline, mtime (ms) and bytes."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    if fs.getFileStatus(root).isFile():
        mark = spark._jvm.org.apache.hadoop.fs.Path(fs.getFileStatus(root).getPath().getParent(), INLINE_MARK)
        return [_describe(fs.getFileStatus(root), None, fs.exists(mark))]
    found, folders = [], [root]
    while folders:
        folder = folders.pop()
        inside = list(fs.listStatus(folder))
        marks = {s.getPath().getName() for s in inside} & {"_SUCCESS", INLINE_MARK}
        complete = _key(folder) if "_SUCCESS" in marks else None
        for status in inside:
            if status.getPath().getName().startswith(("_", ".")):
                continue
            if status.isDirectory():
                folders.append(status.getPath())
            else:
                found.append(_describe(status, complete, INLINE_MARK in marks))
    return found


def describe(spark: SparkSession, paths: list[str]) -> list[dict]:
    """The same for given files, in their order."""
    out, marks = [], {}
    for path in paths:
        fs, p = file_system(spark, path)
        status = fs.getFileStatus(p)
        folder = status.getPath().getParent()
        key = _key(folder)
        if key not in marks:
            marks[key] = [fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, m)) for m in ("_SUCCESS", INLINE_MARK)]
        out.append(_describe(status, key if marks[key][0] else None, marks[key][1]))
    return out


def states(files: list[dict]) -> list[dict]:
    """One row per export: its newest time, bytes and files, and the columns its files lack or
    nobody knows."""
    out: dict[str, dict] = {}
    for f in files:
        s = out.setdefault(f["export"], {"export": f["export"], "mtime": 0, "bytes": 0, "files": 0, "absent": [], "unknown": []})
        s["mtime"], s["bytes"], s["files"] = max(s["mtime"], f["mtime"]), s["bytes"] + f["bytes"], s["files"] + 1
        for kind in ("absent", "unknown"):
            s[kind] += [c for c in f.get(kind, []) if c not in s[kind]]
    return list(out.values())


def _export_column(in_folder: bool) -> Column:
    path = F.col("_metadata.file_path")
    key = F.when(F.startswith(path, F.lit("file:")), F.concat(F.lit("file:/"), F.ltrim(F.substring(path, 6, 2 ** 31 - 1), F.lit("/")))
                 ).otherwise(path)
    if in_folder:
        key = F.substring(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, "/", -1)) - 1)
    return key.alias(EXPORT)


# Text of a compressed file is about so many times as large.
COMPRESSED_TIMES = 6
COMPRESSED_ENDS = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")


def compressed_bytes(file: dict) -> int:
    """About the bytes that a file has, or would have, compressed."""
    return file["bytes"] if file["path"].endswith(COMPRESSED_ENDS) else file["bytes"] // COMPRESSED_TIMES


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The first record of a CSV file, which may be compressed."""
    fs, p = file_system(spark, path)
    codec = None
    if path.endswith(COMPRESSED_ENDS):
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p)
        if fs.getFileStatus(p).getLen() == 0:
            return ()
    stream = fs.open(p)
    try:
        stream = codec.createInputStream(stream) if codec is not None else stream
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(
            spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEADER_BYTES)))
    finally:
        stream.close()
    return tuple(next(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")), ()))


def resolve(header: tuple[str, ...]) -> tuple[dict[str, int], list[str], list[str]]:
    """Place of every known column in a header, the expected columns that are absent and the
    names that nobody knows (the second of two equal ones included)."""
    names = {**SOURCE_NAMES, **OPTIONAL_COLUMNS}
    places, unknown = {}, []
    for i, name in enumerate(header):
        column = names.get(name.strip(), name.strip())
        if column in KNOWN_COLUMNS and column not in places:
            places[column] = i
        else:
            unknown.append(name)
    return places, [c for c in EXPECTED_COLUMNS if c not in places], unknown


def drift(spark: SparkSession, files: list[dict]) -> list[dict]:
    """``files`` with their header, absent and unknown columns."""
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: header_of(spark, f["path"]), files))
    out = []
    for f, header in zip(files, headers):
        _, absent, unknown = resolve(header)
        out.append({**f, "header": header, "absent": absent, "unknown": unknown})
    return out


def read_csv_exports(spark: SparkSession, files: list[dict], with_export: bool = False) -> DataFrame:
    """CSV exports (from ``drift``) as text columns by name; a known column that no file has
    is not there. ``with_export`` adds each row's file as ``_export``."""
    from .storage import CSV_INLINE_OPTIONS, CSV_READ_OPTIONS, from_in_line, unguard_null_marker
    groups: dict[tuple[tuple[str, ...], bool, bool], list[str]] = {}
    for f in files:
        groups.setdefault((tuple(f["header"]), f["in_folder"] and with_export, f["inline"]), []).append(f["path"])
    parts = []
    for (header, in_folder, inline), paths in groups.items():
        places, _, _ = resolve(header)
        layout = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(1, len(header)))])
        raw = spark.read.schema(layout).options(**(CSV_INLINE_OPTIONS if inline else CSV_READ_OPTIONS)).csv(paths)
        own = [F.col(f"c{i}").alias(c) for c, i in places.items()]
        if with_export:
            own.append(_export_column(in_folder))
        decode = from_in_line if inline else unguard_null_marker
        parts.append(decode(raw.select(*own), list(places)) if places else raw.select(*own))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*[c for c in [*KNOWN_COLUMNS, EXPORT] if c in rows.columns])


def read_exports(spark: SparkSession, files: list[dict], fmt: str = "csv", with_export: bool = False) -> DataFrame:
    """Exports of any format, their known columns by name; CSV needs the headers (``drift``)."""
    if fmt == "csv":
        return read_csv_exports(spark, files, with_export)
    from .load import normalise_names
    parts = []
    for in_folder in (False, True):
        paths = [f["path"] for f in files if f["in_folder"] == in_folder]
        if paths:
            raw = normalise_names(spark.read.format(fmt).option("mergeSchema", "true").load(paths))
            own = [F.col(c) for c in raw.columns if c in KNOWN_COLUMNS]
            parts.append(raw.select(*own, *([_export_column(in_folder)] if with_export else [])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drift_report(spark: SparkSession, path: str) -> DataFrame:
    """Per export at ``path``: the expected columns it lacks and those nobody knows."""
    rows = [(e["export"], e["absent"], e["unknown"]) for e in states(drift(spark, list_exports(spark, path)))]
    return spark.createDataFrame(rows, "export string, absent array<string>, unknown array<string>")
