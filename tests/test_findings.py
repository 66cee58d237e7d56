"""Queries held against their SQL, or against brute force, on tables where they once failed."""

import duckdb

from trailnet.operators import merging, points, route, spatial
from trailnet.operators.folds import haversine
from trailnet.plans import registry


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def equals_sql(spark, folder, name, **tables):
    """The rows of a query over tables (DataFrames), which are held against its SQL's."""
    db = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    found = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert rows == want
    return rows


def test_display_rules_beyond_gib(spark, tmp_path):
    customers = spark.createDataFrame([(k,) for k in (0, 1, 1023, 32767, 32768, 900_000)], "c_custkey long")
    rows = equals_sql(spark, tmp_path, "display_rules", customer=customers)
    assert any("1024.00 GiB" in r for r in rows)


def test_heading_curves_at_north_and_at_ties(spark, tmp_path):
    # Bearings a hair to the west of north, and a longitude that ends in 5 at its seventh decimal.
    customers = spark.createDataFrame([(k,) for k in (2160, 3600, 10800, 32976, 83880, 88560, 7, 15000)], "c_custkey long")
    rows = equals_sql(spark, tmp_path, "heading_curves", customer=customers)
    assert any(r[0] == 360.0 for r in rows)


def test_clusters_are_numbered_by_position_whatever_the_order_of_rows(spark):
    # All rows have one latitude, whose mean over many copies differs in its last bits with their number.
    rows = [(1000 * c + i, "x", 40.1, -3.0 + 0.1 * c) for c, n in enumerate((7, 49, 3, 10, 31, 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "place long, name string, lat double, lon double")
    got = {r.component: r.cluster_index for r in spatial.cluster_places(df, "place", "name", 5000.0).collect()}
    assert got == {1000 * c: c + 1 for c in range(6)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark):
    # The planner takes the cells around points for as small as the points.
    p = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.001)], "place int, lat double, lon double")
    pairs = spatial.near_pairs(p, "place", 500.0)
    assert "Broadcast" not in plan(pairs) and [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]


def test_samples_of_lines_are_no_rows(spark):
    pts = points.along(spark.createDataFrame([(t, i, 0.0001 * t, 0.001 * i) for t in (1, 2) for i in range(3)], "track int, seq int, lat double, lon double"))
    got = route.compare_geometry(spark.createDataFrame([(1, 2)], "a int, b int"), pts)
    text = plan(got)
    assert "Generate" not in text and "Broadcast" not in text and got.first()["class"] == "SAME"


def test_complete_link_takes_components_as_rows(spark):
    places = spark.createDataFrame([(k, float(k // 2), 0.0001 * (k % 2)) for k in range(40)], "place int, lat double, lon double")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1, 11.1, "a", "ab") for k in range(20)], "a int, b int, distance_m double, a_name string, b_name string")
    got = merging.complete_link(places, pairs, 5000.0)
    assert "FlatMapGroupsInPandas" not in plan(got) and {(r.place, r.merged) for r in got.collect()} == {(k, k - k % 2) for k in range(40)}


def stored_counts(monkeypatch):
    """How many rows each frame has that spatial writes from now on."""
    counts, write = [], spatial.stored

    def spy(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(spatial, "stored", spy)
    return counts


def test_variants_at_one_spot_ask_once(spark, monkeypatch):
    places = [(k, n, float(k % 3), 0.0, [f"r{k % 2}"]) for k, n in enumerate(["azofra", "cirena", "villazofra"] * 20)]
    variants = [(k, n, 0.1 * (k % 2), 0.0, "r1") for k, n in enumerate(["azofra", "zofra", "gran villazofra", "other", None] * 12)]
    p = spark.createDataFrame(places, "place int, name string, lat double, lon double, routes array<string>")
    v = spark.createDataFrame(variants, "variant int, name string, lat double, lon double, route string")
    counts = stored_counts(monkeypatch)
    got = {r.variant: (r.place, r.by_alias) for r in spatial.attach_variants(v, p, p.select("name").distinct()).collect()}
    assert counts and max(counts[0], counts[-1]) <= 10  # of 60 variants
    for k, n, lat, _, route in variants:
        same = [x for x in places if x[1] == n]
        alike = [x for x in places if n and (x[1] in n or n in x[1])]
        own = same or [x for x in alike if route in x[4]] or alike
        best = min(((haversine(lat, 0.0, x[2], x[3]), x[0]) for x in own), default=(0, None))[1]
        assert got[k] == (best, None if best is None else not same)


def test_alias_pairs_of_places_at_one_spot(spark, monkeypatch):
    rows = [(k, ("azofra", "villazofra", "cirena", None)[k % 4], 0.01 * (k % 3), 0.0 if k % 5 else 1.0) for k in range(60)]
    counts = stored_counts(monkeypatch)
    got = spatial.alias_pairs(spark.createDataFrame(rows, "place int, name string, lat double, lon double"), "place", "name", 1500.0)
    want = {(a[0], b[0], a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and a[1] != b[1] and (a[1] in b[1] or b[1] in a[1]) and haversine(*a[2:], *b[2:]) <= 1500.0}
    assert sorted((r.a, r.b, r.a_name, r.b_name) for r in got.collect()) == sorted(want)
    assert len(want) > 100 and counts[1] < 20  # pairs of spots


def test_diameters_compare_spots(spark, monkeypatch):
    rows = [(k, "xy"[k % 2], float(k % 5), 0.0) for k in range(200)] + [(900, "z", 1.0, 1.0), (901, "n", None, None)]
    counts = stored_counts(monkeypatch)
    got = {r["name"]: r.diameter_m for r in spatial.diameters(spark.createDataFrame(rows, "place int, name string, lat double, lon double"), ["name"], "place").collect()}
    far = haversine(0.0, 0.0, 4.0, 0.0)
    assert {k: round(v, 3) for k, v in got.items()} == {"x": round(far, 3), "y": round(far, 3), "z": 0.0, "n": 0.0} and counts == [12]


def test_equal_segments_are_compared_once(spark):
    seg = spark.createDataFrame([(t, s, 0.0, 0.0, 0.0, 0.01) for t in range(9, -1, -1) for s in range(5)], "track int, segment int, lat1 double, lon1 double, lat2 double, lon2 double")
    report = {}
    got = spatial.nearest_segment(spark.createDataFrame([(1, 0.001, 0.005)], "query int, lat double, lon double"), seg, report=report).first()
    assert (got.track, got.segment) == (0, 0) and report["comparisons"] == 1
