"""Publishing tables as a whole: a folder for each version, and one pointer that is swapped when all of it is written and has been checked.

A reader goes by the pointer, so it sees the old tables or the new ones, never a mixture and never half of one; a job that fails leaves the pointer
where it was. What was written is counted and hashed on its way out and again when read back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Put text into path's pointer by one rename over the old one."""
    jvm = spark._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), over)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: version, and for each table its rows and checksum; None where nothing has been published."""
    fs, at = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/{POINTER}", wholetext=True).first().value)


def _told(df: DataFrame) -> list:
    text = F.to_json(F.struct(*df.columns))
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(text)), F.lit(0)).alias("checksum")]


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Write tables as JSON lines into a new version under path and make it the current one; returns the version's name.

    Fails, leaving the version before in place, if a task fails or what is read back is not what was written. Earlier versions stay (see prune).
    """
    spark = next(iter(tables.values())).sparkSession
    version, told = f"v-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        seen = Observation()
        where = f"{path}/{version}/{name}"
        df.observe(seen, *_told(df)).write.json(where, ignoreNullFields=False)
        told[name] = {"rows": seen.get["rows"], "checksum": seen.get["checksum"], "schema": df.schema.json()}
        back = spark.read.schema(df.schema).json(where)
        found = back.agg(*_told(back)).first()
        if (found.rows, found.checksum) != (told[name]["rows"], told[name]["checksum"]):
            raise OSError(f"{where} holds {found.rows} rows that are not the {told[name]['rows']} written")
    _swap(spark, path, json.dumps({"version": version, "tables": told}))
    return version


def read_current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version; it stays that version's, whatever is published later."""
    now = current(spark, path)
    if now is None or name not in now["tables"]:
        raise FileNotFoundError(f"{path} has no published table {name}")
    return spark.read.schema(StructType.fromJson(json.loads(now["tables"][name]["schema"]))).json(f"{path}/{now['version']}/{name}")


def prune(spark: SparkSession, path: str) -> int:
    """Remove all versions but the current one; returns how many. For when no reader of an earlier one is left."""
    now, (fs, at), gone = current(spark, path), _fs(spark, path), 0
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("v-") and (now is None or name != now["version"]):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def publish_network(network, path: str) -> str:
    """The documents of a Network: nodes, edges, counters, detached and collapsed tracks, merges and candidates, as one version."""
    return publish(network._asdict(), path)


def publish_manifest(entries: DataFrame, path: str) -> str:
    """A manifest as one version: a row for each track, by route_id, which no two may share."""
    many = F.count("*").over(Window.partitionBy("route_id")) > 1
    checked = F.when(many, F.raise_error(F.concat(F.lit("Duplicate route id in a manifest: "), "route_id"))).otherwise(F.col("route_id"))
    return publish({"manifest": entries.withColumn("route_id", checked.cast("string"))}, path)

