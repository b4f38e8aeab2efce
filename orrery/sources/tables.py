"""Tables that change by small commits: base folders, deltas, and one manifest for all tables of a version.

    root/data/<name>-<id>/          Parquet, written once and never changed
    root/manifests/<version>.json   for each table the parts that make it up, in order

A commit writes its rows and the keys that they replace, as new folders, and then one small
manifest, which is created only if no file of that name exists: of two writers of one version
one fails and numbers anew. A manifest that a killed driver left without an end is skipped,
and later versions are numbered past it. What several tables get in one commit, readers see
together. A batch that is committed twice, after a failure, counts once.

Reading merges: rows of a part are replaced where a later part names their key. The number of
replaced keys is in the manifest; up to BROADCAST_KEYS of them are broadcast, beyond that
the join is shuffled. :func:`compact` writes a table's rows as one part again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEYS = 500_000
#: Batches that are remembered; a stream repeats only its last one.
BATCHES = 1000


@dataclass
class Change:
    """Rows to add to a table; keys whose earlier rows go, and the column that they are in."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    key: str | None = None


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _manifest(spark: SparkSession, root: str, version: int) -> dict | None:
    """The manifest of a version; none if it was never finished."""
    fs, path = _fs(spark, f"{root}/manifests/{version:012d}.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Every version that was begun, finished or not."""
    fs, path = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The newest finished manifest, or that of ``version``; an empty one if there is none."""
    for n in [version] if version is not None else reversed(numbers(spark, root)):
        found = _manifest(spark, root, n)
        if found is not None:
            return found
    if version is not None:
        raise ValueError(f"no version {version}")
    return {"version": 0, "tables": {}, "batches": {}}


def _publish(spark: SparkSession, root: str, manifest: dict) -> int:
    """Creates the manifest under the next free number, unless another commit came first."""
    version = max(numbers(spark, root), default=0) + 1
    fs, path = _fs(spark, f"{root}/manifests/{version:012d}.json")
    if state(spark, root)["version"] != manifest["version"]:
        raise FileExistsError(f"another commit came after version {manifest['version']}")
    try:
        stream = fs.create(path, False)
    except Exception as error:
        raise FileExistsError(f"another commit came after version {manifest['version']}") from error
    try:
        stream.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
    finally:
        stream.close()
    return version


def _written(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/data/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def commit(spark: SparkSession, root: str, changes: Mapping[str, Change], batch: str | None = None, attempts: int = 5) -> int:
    """Makes a new version with all the changes, or gives the one that ``batch`` made before."""
    now = state(spark, root)
    if batch is not None and batch in now["batches"]:
        return now["batches"][batch]
    parts = {}
    for name, change in changes.items():
        part = {"rows": _written(change.rows, root, name) if change.rows is not None else None, "gone": None, "gone_count": 0, "key": change.key}
        if change.gone is not None:
            part["gone"] = _written(change.gone.select(change.key).distinct(), root, f"{name}-gone")
            part["gone_count"] = spark.read.parquet(part["gone"]).count()
        parts[name] = part
    for attempt in range(attempts):
        now = state(spark, root)
        if batch is not None and batch in now["batches"]:
            return now["batches"][batch]
        tables = dict(now["tables"])
        for name, part in parts.items():
            tables[name] = [*tables.get(name, []), part]
        version = max(numbers(spark, root), default=0) + 1
        batches = now["batches"] | ({batch: version} if batch is not None else {})
        batches = dict(list(batches.items())[-BATCHES:])
        try:
            return _publish(spark, root, now | {"tables": tables, "batches": batches})
        except FileExistsError:
            if attempt == attempts - 1:
                raise
    raise AssertionError


def tables(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    return sorted(state(spark, root, version)["tables"])


def _merged(spark: SparkSession, parts: list[dict], first: int = 0) -> DataFrame:
    """The rows of the parts from ``first`` on whose key no later part names."""
    rows, gone, keys = None, None, 0
    for at, part in enumerate(parts):
        if part["rows"] and at >= first:
            own = spark.read.parquet(part["rows"]).withColumn("_part", F.lit(at))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if part["gone"] and at > first:
            own = spark.read.parquet(part["gone"]).withColumn("_gone", F.lit(at))
            gone, keys = own if gone is None else gone.unionByName(own), keys + part["gone_count"]
    if rows is None:
        return _merged(spark, parts).limit(0)
    if gone is None:
        return rows.drop("_part")
    key = next(p["key"] for p in parts if p["key"])
    last = gone.groupBy(key).agg(F.max("_gone").alias("_gone"))
    joined = rows.join(F.broadcast(last) if keys <= BROADCAST_KEYS else last, key, "left")
    return joined.where(F.col("_gone").isNull() | (F.col("_part") >= F.col("_gone"))).select(*[c for c in rows.columns if c != "_part"])


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a table, without those whose key a later part names."""
    parts = state(spark, root, version)["tables"].get(name)
    if not parts:
        raise ValueError(f"no table {name} in {root}")
    return _merged(spark, parts)


def compact(spark: SparkSession, root: str, *names: str, partition_by: str | None = None) -> int:
    """Writes tables as one part each; a commit in between makes it fail rather than get lost."""
    now = state(spark, root)
    new = dict(now["tables"])
    for name in names or now["tables"]:
        rows = read(spark, root, name, now["version"])
        path = f"{root}/data/{name}-{uuid.uuid4().hex}"
        (rows.write.partitionBy(partition_by) if partition_by else rows.write).parquet(path)
        key = next((p["key"] for p in now["tables"][name] if p["key"]), None)
        new[name] = [{"rows": path, "gone": None, "gone_count": 0, "key": key}]
    return _publish(spark, root, now | {"tables": new})


def restore(spark: SparkSession, root: str, version: int) -> int:
    """Makes the state of an earlier version the newest."""
    now, old = state(spark, root), state(spark, root, version)
    return _publish(spark, root, now | {"tables": old["tables"]})


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Deletes manifests but the last ``keep`` and folders that none of those names; gives the number of folders.

    Run it while nothing is being committed: a commit's folders are in no manifest until it ends.
    """
    every = numbers(spark, root)
    kept = [m for n in every[-keep:] if (m := _manifest(spark, root, n))]
    used = {p[k].rpartition("/")[2] for m in kept for parts in m["tables"].values() for p in parts for k in ("rows", "gone") if p[k]}
    for n in every[:-keep]:
        fs, path = _fs(spark, f"{root}/manifests/{n:012d}.json")
        fs.delete(path, False)
    fs, path = _fs(spark, f"{root}/data")
    dead = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in used] if fs.exists(path) else []
    for old in dead:
        fs.delete(old, True)
    return len(dead)


def changes(spark: SparkSession, root: str, name: str, since: int, version: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(rows that came, rows that went) between two versions; none if they can't be told, as the table was compacted in between.

    Rows that went are looked for in the older version by the keys that were replaced since.
    """
    old, new = state(spark, root, since)["tables"].get(name, []), state(spark, root, version)["tables"].get(name, [])
    if new[: len(old)] != old or not old or not new:
        return None
    keys = [(spark.read.parquet(p["gone"]), p["gone_count"]) for p in new[len(old) :] if p["gone"]]
    came, went = _merged(spark, new, len(old)), _merged(spark, old)
    if not keys:
        return came, went.limit(0)
    gone = keys[0][0]
    for k, _ in keys[1:]:
        gone = gone.unionByName(k)
    gone = gone.distinct()
    few = sum(n for _, n in keys) <= BROADCAST_KEYS
    return came, went.join(F.broadcast(gone) if few else gone, gone.columns[0], "left_semi")
