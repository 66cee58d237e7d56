import itertools
import math
import random

from pyspark.sql import functions as F

from trailnet.operators import graph, merging, network, points, route
from trailnet.operators.folds import haversine


def test_complete_link_merges_no_chains(spark):
    unit = 4000 / (math.pi * 6371008.8 / 180)
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, unit, 0.0), (3, 2 * unit, 0.0), (4, 9.0, 9.0)], "place int, lat double, lon double")
    c = spark.createDataFrame([(1, 2, 4000.0, "aaaaa", "aaaaab"), (2, 3, 4000.1, "aaaaab", "aaaaabc")], "a int, b int, distance_m double, a_name string, b_name string")
    assert sorted(map(tuple, merging.complete_link(p, c, 5000.0).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_orientation_is_the_best_of_all(spark):
    r = random.Random(2)
    rows = [(g, k, *(r.uniform(0, 0.1) for _ in range(4))) for g in range(4) for k in range(g + 1)]
    df = spark.createDataFrame(rows, "route int, track int, alat double, alon double, blat double, blon double")
    got = {x.route: (x.cost_m, list(x.flags)) for x in route.orient_spine(df).collect()}
    for g in range(4):
        own = [x[2:] for x in rows if x[0] == g]

        def cost(flags):
            ends = [((x[2], x[3]), (x[0], x[1])) if f else ((x[0], x[1]), (x[2], x[3])) for x, f in zip(own, flags)]
            return sum(haversine(*a[1], *b[0]) for a, b in itertools.pairwise(ends))

        best = min(itertools.product([False, True], repeat=g + 1), key=lambda f: (round(cost(f), 6), sum(f)))
        assert abs(got[g][0] - cost(best)) < 1e-6 and got[g][1] == list(best)


def test_geometries(spark):
    line = lambda t, off, back=False: [(t, i, off, 0.001 * (9 - i if back else i)) for i in range(10)]
    pts = points.along(spark.createDataFrame(line(1, 0.0) + line(2, 0.0) + line(3, 0.0001, True) + line(4, 0.0007) + line(5, 1.0), "track int, seq int, lat double, lon double"))
    pairs = spark.createDataFrame([(1, k) for k in (2, 3, 4, 5)], "a int, b int")
    assert {r.b: r["class"] for r in route.compare_geometry(pairs, pts).collect()} == {2: "IDENTICAL", 3: "SAME", 4: "NEAR", 5: "ALTERNATIVE"}


def test_measuring(spark):
    tracks = spark.createDataFrame([("r", 1, 0.0), ("r", 2, 100.0)], "route string, track int, base_m double")
    gaps = spark.createDataFrame([("r", 1, 7.0)], "route string, track int, gap_m double")
    q = spark.createDataFrame([(1, "r", 1, 90.0, 2, 5.0), (2, "r", 2, 5.0, 1, 90.0)], "query int, route string, from_track int, from_m double, to_track int, to_m double")
    assert {r["query"]: r.distance_m for r in route.same_route_m(q, tracks, gaps).collect()} == {1: 22.0, 2: 22.0}
    node = lambda t, s: (t, s)
    e = spark.createDataFrame([(node(1, 0), node(1, 1), 100.0), (node(1, 1), node(2, 0), 7.0), (node(2, 0), node(2, 1), 50.0)], "src struct<track:int,side:int>, dst struct<track:int,side:int>, weight double")
    x = spark.createDataFrame([(1, 1, 90.0, 100.0, 2, 5.0, 50.0)], "query int, from_track int, from_m double, from_len double, to_track int, to_m double, to_len double")
    assert route.cross_route_m(x, e).first().distance_m == 22.0


def test_tree_marks_cycles_and_forest_joins_all(spark):
    e = spark.createDataFrame([("C", "B", "1"), ("B", "C", "2"), ("B", "A", "3")], "src string, dst string, caption string")
    rows = route.group_tree(e, F.lit("C")).orderBy("sort_path").collect()
    assert [(r.depth, r.place, r.cycle) for r in rows] == [(0, "C", False), (1, "B", False), (2, "A", False), (2, "C", True)]
    n = spark.createDataFrame([(i,) for i in range(5)], "node int")
    c = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 1.0), (2, 3, 9.0), (0, 4, 8.0)], "src int, dst int, gap_m double")
    assert sorted((r.src, r.dst) for r in graph.spanning_gaps(n, c).collect()) == [(0, 1), (0, 4), (1, 2), (3, 4)]


def test_endpoint_graph(spark):
    ends = [("r", 1, 0, 0.0, 0.0, "a", 5.0), ("r", 1, 1, 0.0, 0.01, "b", 5.0), ("r", 2, 0, 0.0, 0.02, "b", 6.0), ("r", 2, 1, 0.0, 0.03, None, 6.0)]
    g = network.endpoint_graph(spark.createDataFrame(ends, "route string, track int, side int, lat double, lon double, place string, length_m double"))
    assert sorted((r.kind, tuple(r.src), tuple(r.dst)) for r in g.collect()) == [("GAP", (1, 1), (2, 0)), ("TRACK", (1, 0), (1, 1)), ("TRACK", (2, 0), (2, 1)), ("TRANSFER", (1, 1), (2, 0))]


def test_places_count_over_all_numbers(spark):
    from trailnet.functions import names

    r = random.Random(4)
    rows = [(k, r.choice(["1", "2", "2", "2", "10", ""]) + r.choice(["", "a", "B"]), f"n{k:04d}") for k in range(400)]
    df = spark.createDataFrame(rows, "id int, section string, label string")
    got = {x.id: x.place for x in route.placed(df, names.section_order(F.col("section"), F.col("label"))).collect()}

    def key(x):
        digits = x[1].rstrip("aB")
        return (digits == "", int(digits or 0), x[1][len(digits):].lower(), x[1].lower(), x[2])

    assert got == {x[0]: i for i, x in enumerate(sorted(rows, key=key), 1)}


def test_section_sort_is_the_place_in_the_whole_sort(spark, tmp_path):
    from trailnet.plans import routes

    rows = [(k, ("AUTO", "bike", "Cars")[k * 7 % 3], f"Customer#{k * 37 % 211:09d}") for k in range(211)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    want = sorted(rows, key=lambda x: (x[0] % 50, x[1][0].lower(), x[2].lower()))
    assert {x.c_custkey: x.place for x in routes.section_sort(spark, str(tmp_path)).collect()} == {x[0]: i for i, x in enumerate(want, 1)}


def test_tree_has_all_levels(spark):
    e = spark.createDataFrame([(f"p{k:02d}", f"p{k + 1:02d}", "x") for k in range(24)] + [("p24", "p22", "back")], "src string, dst string, caption string")
    rows = route.group_tree(e, F.lit("p00")).orderBy("sort_path").collect()
    assert [(r.depth, r.place, r.cycle) for r in rows] == [(k, f"p{k:02d}", False) for k in range(25)] + [(25, "p22", True)]


def test_bridges_are_the_shortest_of_all_chains(spark, tmp_path):
    from trailnet.plans import joins

    r = random.Random(6)
    n = 67
    rows = [(k, round(r.uniform(-999, 9999), 2)) for k in range(n)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    steps, ends = {}, set()
    for k, x in rows:
        m, a, b = float(abs(math.floor(x))), k * 7919 % n, k * k % n
        for d, w in ((b, m), ((a * 31 + 7) % n, m * 2 + 1000)):
            if a != d:
                steps.setdefault(a, {})[d] = min(w, steps.get(a, {}).get(d, w))
        if a != b * 3 % n:
            ends.add((a, b * 3 % n, k % 50 * 1000.0))
    best = {}

    def walk(start, goal, bound, path, length):
        if path[-1] == goal:
            best[start, goal] = min(best.get((start, goal), (math.inf,)), (length, len(path) - 1, path))
        elif len(path) <= 8:
            for d, w in steps.get(path[-1], {}).items():
                if d not in path and length + w <= bound:
                    walk(start, goal, bound, [*path, d], length + w)

    for start, goal, gap in ends:
        walk(start, goal, max(100_000.0, 3 * gap), [start], 0.0)
    assert any(h > 5 for _, h, _ in best.values()) and any(x > 12_000 for x, _, _ in best.values())
    got = {(x.start, x.goal): (x.length_m, x.hops, [int(p) for p in x.path.split(">")]) for x in joins.bridges_bounded(spark, str(tmp_path)).collect()}
    assert got == best
