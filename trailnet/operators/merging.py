"""Merging places under several names: complete-link clusters of alias candidates, and the merged records."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import haversine
from .graph import components


def _merge(batches, radius_m: float):
    """(place, merged) of candidates that lie component by component, each nearest first; a component is held at a time."""
    schema = None

    def flat():
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield from batch.to_pylist()

    for rows in _many(itertools.groupby(flat(), lambda r: r["component"])):
        kind = schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*(x for own in rows for x in _groups(own, radius_m)), strict=True)], names=["place", "merged"])


def _many(groups, least: int = 10_000):
    """Groups as lists, some together that have so many rows."""
    some, n = [], 0
    for _, own in groups:
        some.append(list(own))
        n += len(some[-1])
        if n >= least:
            yield some
            some, n = [], 0
    if some:
        yield some


def _groups(rows: list[dict], radius_m: float) -> list[tuple]:
    where: dict = {}
    groups: dict = {}
    for r in rows:
        for p in "ab":
            if r[p] not in where:
                where[r[p]] = r[p]
                groups[r[p]] = [(r[p], r[f"{p}_lat"], r[f"{p}_lon"])]
        x, y = where[r["a"]], where[r["b"]]
        if x != y and all(haversine(u[1], u[2], v[1], v[2]) <= radius_m for u in groups[x] for v in groups[y]):
            for u in groups[y]:
                where[u[0]] = x
            groups[x] += groups.pop(y)
    return [(u[0], min(v[0] for v in own)) for own in groups.values() for u in own]


def complete_link(places: DataFrame, candidates: DataFrame, radius_m: float) -> DataFrame:
    """(place, merged): the least place of each merged group; places(place, lat, lon), candidates(a, b, distance_m, a_name, b_name).

    Candidates are taken nearest first, ties by the names in lower case, then by a and b; two groups merge only if every place of one is within radius_m
    of every place of the other. The order matters only within a component of candidates, so each component is one group of rows: some places that share part
    of a name and lie near each other.
    """
    labels = components(places.select(F.col("place").alias("node")), candidates.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    at = places.select("place", "lat", "lon").join(labels.withColumnRenamed("node", "place"), "place")
    side = lambda p: at.select(F.col("place").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), *([F.col("component")] if p == "a" else []))
    rows = candidates.select("a", "b", "distance_m", F.lower("a_name").alias("a_name"), F.lower("b_name").alias("b_name")).join(side("a"), "a").join(side("b"), "b")

    kind = dict(places.dtypes)["place"]
    order = ["component", "distance_m", "a_name", "b_name", "a", "b"]
    merged = rows.select(*order, "a_lat", "a_lon", "b_lat", "b_lon").repartition("component").sortWithinPartitions(*order).mapInArrow(lambda batches: _merge(batches, radius_m), f"place {kind}, merged {kind}")
    return places.select("place").join(merged, "place", "left").select("place", F.coalesce("merged", "place").alias("merged"))


def merged_records(places: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per merged place of places(place, name, lat, lon, observations, routes): longest name, all names, weighted position, routes, whether several were merged."""
    own = places.join(merged, "place")
    w = F.greatest(F.lit(1.0), F.col("observations").cast("double"))
    return own.groupBy("merged").agg(
        F.max_by("name", F.struct(F.length(F.trim("name")), F.lower("name"), "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_list("place")).alias("places"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"),
        F.sum("observations").alias("observations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"), (F.count("*") > 1).alias("automatic"),
    )


def remap(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """edges(from_key, to_key, ...) with merged places in the ends' stead."""
    for c in ("from_key", "to_key"):
        edges = edges.join(merged.withColumnsRenamed({"place": c, "merged": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return edges
