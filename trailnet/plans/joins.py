"""Queries on places, tracks and the network between them, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import network as K
from ..operators import spatial as S
from .frames import PLACES_SQL, POINTS_SQL, TRACKS_SQL, haversine_sql, places, points, rounded, rounded_sql, table, tracks

R = rounded_sql
RADIUS_M = 5000.0


def membership(spark, sf_dir):
    return K.membership(tracks(spark, sf_dir))


def catalog(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("length_m", F.col("length_m").cast("decimal(18,2)"))
    return K.catalog(t).select("route", "tracks", "primary_tracks", F.col("length_m").cast("double").alias("length_m"))


def edge_families(spark, sf_dir):
    r = K.edge_families(tracks(spark, sf_dir), F.col("track") % 3)
    return r.select("edge_id", "from_key", "to_key", F.col("family_index").cast("long").alias("family_index"), "families", "kind", "tracks", "length_min_m", "length_max_m", "representative", F.array_join("routes", "|").alias("routes"))


def logical_edges(spark, sf_dir):
    return K.logical_edges(tracks(spark, sf_dir))


def network_stats(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return K.network_stats(t, K.edge_families(t, F.col("track") % 3))


def degree(spark, sf_dir):
    return K.degrees(_sparse(spark, sf_dir))


def weak_components(spark, sf_dir):
    r = K.ranked_components(_sparse(spark, sf_dir))
    return r.select("place", F.col("component_id").cast("long").alias("component_id"), "places")


def _sparse(spark, sf_dir):
    """Suppliers as edges between places, few enough to leave several components."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    return s.select(F.lit("all").alias("route"), F.col("s_suppkey").alias("track"), (F.col("s_suppkey") * 7919 % n).alias("from_key"), (F.col("s_suppkey") * F.col("s_suppkey") % n).alias("to_key"), F.col("s_acctbal").alias("length_m"), F.lit(True).alias("primary"))


SPARSE_SQL = """SELECT s_suppkey AS track, s_suppkey * 7919 % n AS from_key, s_suppkey * s_suppkey % n AS to_key, s_acctbal AS length_m FROM supplier, (SELECT count(*) AS n FROM supplier)"""


def sources_sinks(spark, sf_dir):
    t = _sparse(spark, sf_dir).withColumn("route", (F.col("track") % 5).cast("string"))
    return K.topology(t).select("route", "places", "pairs", "components", "sources", "sinks", "branches", "merges", "parallel_pairs")


def cyclic_places(spark, sf_dir):
    e = _sparse(spark, sf_dir).where("from_key <> to_key").select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"))
    return G.cyclic(e).select(F.col("node").alias("place"), "scc")


def topology_hist(spark, sf_dir):
    t = _sparse(spark, sf_dir).withColumn("route", (F.col("track") % 17).cast("string"))
    return K.class_histogram(K.topology(t))


def shortest_path(spark, sf_dir):
    e = _sparse(spark, sf_dir).where("from_key <> to_key").select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"), F.abs(F.floor("length_m")).cast("double").alias("weight"))
    first = e.agg(F.min("src").alias("source"))
    return G.shortest_paths(e, first).select("source", "node", "distance_m")


def _branched(spark, sf_dir):
    """(src, dst, length_m) and (start, goal, gap_m): the sparse edges and one more from each place, so that there are chains to choose from, and a goal for each edge."""
    s = _sparse(spark, sf_dir).select("track", "from_key", "to_key", F.abs(F.floor("length_m")).cast("double").alias("m"))
    n = table(spark, sf_dir, "supplier").count()
    way = lambda dst, m: F.struct(dst.alias("dst"), m.alias("length_m"))
    more = way((F.col("from_key") * 31 + 7) % n, F.col("m") * 2 + 1000)
    e = s.select(F.col("from_key").alias("src"), F.explode(F.array(way(F.col("to_key"), F.col("m")), more)).alias("w")).select("src", "w.*").where("src <> dst")
    ends = s.select(F.col("from_key").alias("start"), (F.col("to_key") * 3 % n).alias("goal"), ((F.col("track") % 50) * 1000).cast("double").alias("gap_m"))
    return e, ends.where("start <> goal").distinct()


def bridges_bounded(spark, sf_dir):
    e, ends = _branched(spark, sf_dir)
    return G.bounded_paths(e, ends, max_hops=8, stretch=3.0, least_bound_m=100_000.0).select("start", "goal", F.col("hops").cast("long").alias("hops"), "length_m", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def stale_ids(spark, sf_dir):
    local, remote = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return K.stale(local, remote, ["id"])


def sync_status(spark, sf_dir):
    remote = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2((F.col("p_size") % 4).cast("string"), 256).alias("sum"))
    local = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha2((F.col("c_nationkey") % 4).cast("string"), 256).alias("sum"), (F.col("c_acctbal") >= 0).alias("valid"))
    return K.sync_status(remote, local, ["id"], "sum", update=True)


def same_name_clusters(spark, sf_dir):
    r = S.cluster_places(places(spark, sf_dir).where("primary"), "place", "name", RADIUS_M)
    return r.select("name", F.col("component").alias("first_place"), F.col("cluster_count").alias("clusters"), "observations", rounded(F.col("lat"), 7).alias("lat"), rounded(F.col("lon"), 7).alias("lon"))


def place_centroids(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("n", F.col("place") % 5)
    return S.weighted_centroid(p, ["name"], "n").select("name", rounded(F.col("lat"), 7).alias("lat"), rounded(F.col("lon"), 7).alias("lon"), "n")


def cluster_diameters(spark, sf_dir):
    return S.diameters(places(spark, sf_dir), ["name"], "place").select("name", rounded(F.col("diameter_m"), 1).alias("diameter_m"))


def alias_pairs(spark, sf_dir):
    p = places(spark, sf_dir)
    # Of a name with a space, the first word is another name, which the whole holds.
    p = p.withColumn("name", N.normalize_place(F.when(F.col("place") % 3 == 0, F.substring_index("name", " ", 1)).otherwise(F.col("name"))))
    return S.alias_pairs(p, "place", "name", RADIUS_M).select("a", "b", "a_name", "b_name", rounded(F.col("distance_m")).alias("distance_m"))


ALIAS_SQL = f"""SELECT place, regexp_replace(lower(CASE WHEN place % 3 = 0 THEN split_part(name, ' ', 1) ELSE name END), '[^a-z0-9]', '', 'g') AS name, lat, lon, "primary", route FROM ({PLACES_SQL})"""


def nearest_place(spark, sf_dir):
    p = places(spark, sf_dir)
    return S.nearest(p.where("NOT primary").withColumnRenamed("place", "q"), "q", p.where("primary"), "place", 3000.0).select("query", "place", rounded(F.col("distance_m")).alias("distance_m"))


def nearest_track(spark, sf_dir):
    # Tracks are set apart, by their number, over ten latitudes.
    p = points(spark, sf_dir).withColumn("lat", F.col("lat") + (F.col("track") % 10).cast("double") / F.lit(20.0) + F.col("track").cast("double") / F.lit(1e7))
    w = Window.partitionBy("track").orderBy("seq")
    seg = p.select("track", F.col("seq").alias("segment"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 IS NOT NULL")
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), (F.lit(40.0) + (F.col("c_custkey") % 10).cast("double") / F.lit(20.0)).alias("lat"), (F.lit(-3.0) + (F.col("c_custkey") % 41).cast("double") / F.lit(10000.0)).alias("lon"))
    return S.nearest_segment(q, seg).select("query", "track", rounded(F.col("distance_m"), 2).alias("distance_m"))


def attach_variants(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("name", N.normalize_place(F.when(~F.col("primary") & (F.col("place") % 3 == 0), F.substring_index("name", " ", 1)).otherwise(F.col("name"))))
    main = p.where("primary").select("place", "name", "lat", "lon", F.array("route").alias("routes"))
    v = p.where("NOT primary").select(F.col("place").alias("variant"), "name", "lat", "lon", "route")
    return S.attach_variants(v, main, main.select("name").distinct()).select("variant", "place", "by_alias", rounded(F.col("distance_m")).alias("distance_m"))


QUERIES = {f.__name__: f for f in (
    membership, catalog, edge_families, logical_edges, network_stats, degree, weak_components, sources_sinks, cyclic_places, topology_hist, shortest_path, bridges_bounded,
    stale_ids, sync_status, same_name_clusters, place_centroids, cluster_diameters, alias_pairs, nearest_place, nearest_track, attach_variants)}

FAMILIES_SQL = f"""SELECT *, row_number() OVER (PARTITION BY from_key, to_key ORDER BY first) AS family_index, count(*) OVER (PARTITION BY from_key, to_key) AS families FROM (
    SELECT from_key, to_key, track % 3 AS f, count(*) AS tracks, min(length_m) AS length_min_m, max(length_m) AS length_max_m, arg_min(track, (length_m, track)) AS representative,
    string_agg(DISTINCT route, '|' ORDER BY route) AS routes, min(track) AS first FROM ({TRACKS_SQL}) WHERE from_key <> to_key GROUP BY from_key, to_key, track % 3)"""
KIND_SQL = "CASE WHEN families > 1 THEN 'ALTERNATIVE' WHEN tracks > 1 THEN 'SHARED' ELSE 'SINGLE' END"
EDGES_SQL = f"SELECT DISTINCT from_key AS s, to_key AS d FROM ({SPARSE_SQL}) WHERE from_key <> to_key"
REACH_SQL = f"WITH RECURSIVE e AS ({EDGES_SQL}), r(s, d) AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s)"


def _topology_sql(parts: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT CAST(track % {parts} AS VARCHAR) AS route, from_key, to_key FROM ({SPARSE_SQL})),
        e AS (SELECT route, from_key AS s, to_key AS d, count(*) AS n FROM t WHERE from_key <> to_key GROUP BY ALL),
        v AS (SELECT route, s AS p FROM e UNION SELECT route, d FROM e),
        u(route, p, l) AS (SELECT route, p, p FROM v UNION SELECT u.route, CASE WHEN e.s = u.p THEN e.d ELSE e.s END, u.l FROM u JOIN e ON e.route = u.route AND (e.s = u.p OR e.d = u.p)),
        r(route, s, d) AS (SELECT route, s, d FROM e UNION SELECT r.route, r.s, e.d FROM r JOIN e ON r.route = e.route AND r.d = e.s),
        g AS (SELECT v.route, v.p, (SELECT count(*) FROM e WHERE e.route = v.route AND e.d = v.p) AS i, (SELECT count(*) FROM e WHERE e.route = v.route AND e.s = v.p) AS o,
              (SELECT min(l) FROM u WHERE u.route = v.route AND u.p = v.p) AS c, (SELECT count(*) FROM r WHERE r.route = v.route AND r.s = v.p AND r.d = v.p) AS y FROM v),
        k AS (SELECT route, count(*) AS places, count(DISTINCT c) AS components, count(*) FILTER (i = 0) AS sources, count(*) FILTER (o = 0) AS sinks, count(*) FILTER (o > 1) AS branches,
              count(*) FILTER (i > 1) AS merges, count(*) FILTER (y > 0) AS loops FROM g GROUP BY route),
        x AS (SELECT route, count(*) AS pairs, count(*) FILTER (n > 1) AS parallel_pairs FROM e GROUP BY route),
        z AS (SELECT a.route, coalesce(places, 0) AS places, coalesce(pairs, 0) AS pairs, coalesce(components, 0) AS components, coalesce(sources, 0) AS sources, coalesce(sinks, 0) AS sinks,
              coalesce(branches, 0) AS branches, coalesce(merges, 0) AS merges, coalesce(parallel_pairs, 0) AS parallel_pairs, coalesce(loops, 0) AS loops
              FROM (SELECT DISTINCT route FROM t) a LEFT JOIN k ON a.route = k.route LEFT JOIN x ON a.route = x.route)"""


NEAR = haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")
ORACLE_SQL = {
    "membership": f"SELECT place, list_sort(list_distinct(list(route))) AS routes FROM (SELECT from_key AS place, route FROM ({TRACKS_SQL}) UNION ALL SELECT to_key, route FROM ({TRACKS_SQL})) GROUP BY place",
    "catalog": f"""SELECT route, count(*) AS tracks, count(*) FILTER ("primary") AS primary_tracks, CAST(sum(CAST(length_m AS DECIMAL(18, 2))) AS DOUBLE) AS length_m FROM ({TRACKS_SQL}) GROUP BY ROLLUP (route)""",
    "edge_families": f"""SELECT concat(from_key, '>', to_key, '#', family_index) AS edge_id, from_key, to_key, family_index, families, {KIND_SQL} AS kind, tracks, length_min_m, length_max_m, representative, routes FROM ({FAMILIES_SQL})""",
    "logical_edges": f"""SELECT from_key, to_key, count(*) AS tracks, min(length_m) AS length_min_m, max(length_m) AS length_max_m, bool_or(NOT "primary") AS contains_variant FROM ({TRACKS_SQL}) GROUP BY from_key, to_key""",
    "network_stats": f"""WITH f AS ({FAMILIES_SQL}) SELECT (SELECT count(*) FROM orders) AS tracks, (SELECT count(*) FROM ({TRACKS_SQL}) WHERE from_key = to_key) AS collapsed, count(*) AS edges,
        count(*) FILTER ({KIND_SQL} = 'SHARED') AS shared, count(*) FILTER ({KIND_SQL} = 'ALTERNATIVE') AS alternative, CAST(sum(tracks) AS BIGINT) AS edge_tracks,
        (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY from_key, to_key HAVING count(*) > 1)) AS alternative_pairs,
        (SELECT CAST(sum(m - 1) AS BIGINT) FROM (SELECT sum(tracks) AS m FROM f GROUP BY from_key, to_key)) AS parallel_tracks FROM f""",
    "degree": f"""WITH p AS (SELECT DISTINCT from_key, to_key FROM ({SPARSE_SQL}) WHERE from_key <> to_key)
        SELECT place, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, sum(i) > 1 AS is_merge, sum(o) > 1 AS is_branch FROM (SELECT from_key AS place, 0 AS i, 1 AS o FROM p UNION ALL SELECT to_key, 1, 0 FROM p) GROUP BY place""",
    "weak_components": f"""WITH RECURSIVE e AS ({EDGES_SQL}), v AS (SELECT s AS p FROM e UNION SELECT d FROM e), u(p, l) AS (SELECT p, p FROM v UNION SELECT CASE WHEN e.s = u.p THEN e.d ELSE e.s END, u.l FROM u JOIN e ON e.s = u.p OR e.d = u.p),
        c AS (SELECT p, min(l) AS c FROM u GROUP BY p), k AS (SELECT c, count(*) AS places, row_number() OVER (ORDER BY count(*) DESC, c) AS component_id FROM c GROUP BY c) SELECT p AS place, component_id, places FROM c JOIN k USING (c)""",
    "sources_sinks": f"{_topology_sql(5)} SELECT route, places, pairs, components, sources, sinks, branches, merges, parallel_pairs FROM z",
    "topology_hist": f"""{_topology_sql(17)}, q AS (SELECT CASE WHEN pairs = 0 THEN 'EMPTY' WHEN components > 1 THEN 'DISCONNECTED' WHEN branches > 0 OR merges > 0 OR loops > 0 THEN 'NETWORK'
        WHEN sources = 1 AND sinks = 1 THEN 'LINEAR' ELSE 'OTHER' END AS t FROM z) SELECT c AS topology, (SELECT count(*) FROM q WHERE t = c) AS routes FROM (SELECT unnest(['EMPTY', 'LINEAR', 'NETWORK', 'DISCONNECTED', 'OTHER']) AS c)""",
    "cyclic_places": f"{REACH_SQL} SELECT a.s AS place, min(a.d) AS scc FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY a.s",
    "shortest_path": f"""WITH RECURSIVE e AS (SELECT from_key AS s, to_key AS d, CAST(abs(floor(length_m)) AS DOUBLE) AS w FROM ({SPARSE_SQL}) WHERE from_key <> to_key), b AS (SELECT s, d, w FROM e UNION ALL SELECT d, s, w FROM e),
        p(n, x, h) AS (SELECT min(s), CAST(0 AS DOUBLE), 0 FROM e UNION ALL SELECT q.d, min(q.x), min(q.h) FROM (SELECT b.d, p.x + b.w AS x, p.h + 1 AS h FROM p JOIN b ON p.n = b.s WHERE p.h < 40) q GROUP BY q.d)
        SELECT (SELECT min(s) FROM e) AS source, n AS node, min(x) AS distance_m FROM p GROUP BY n""",
    "bridges_bounded": f"""WITH RECURSIVE m AS (SELECT track, from_key AS s, to_key AS d, CAST(abs(floor(length_m)) AS DOUBLE) AS w, (SELECT count(*) FROM supplier) AS n FROM ({SPARSE_SQL})),
        e AS (SELECT s, d, min(w) AS w FROM (SELECT s, d, w FROM m UNION ALL SELECT s, (s * 31 + 7) % n, w * 2 + 1000 FROM m) WHERE s <> d GROUP BY ALL),
        q AS (SELECT DISTINCT s AS start, d * 3 % n AS goal, greatest(CAST(100000 AS DOUBLE), 3 * CAST(track % 50 * 1000 AS DOUBLE)) AS most FROM m WHERE s <> d * 3 % n),
        p(start, goal, most, pos, x, path, h) AS (SELECT start, goal, most, start, CAST(0 AS DOUBLE), [start], 0 FROM q UNION ALL SELECT p.start, p.goal, p.most, e.d, p.x + e.w, list_append(p.path, e.d), p.h + 1 FROM p JOIN e ON p.pos = e.s
            WHERE p.h < 8 AND p.pos <> p.goal AND NOT list_contains(p.path, e.d) AND p.x + e.w <= p.most),
        b AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY x, h, path) AS k FROM p WHERE pos = goal) SELECT start, goal, CAST(h AS BIGINT) AS hops, x AS length_m, array_to_string(path, '>') AS path FROM b WHERE k = 1""",
    "stale_ids": "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)",
    "sync_status": """WITH r AS (SELECT p_partkey AS id, p_size % 4 AS s FROM part), l AS (SELECT c_custkey AS id, c_nationkey % 4 AS s, c_acctbal >= 0 AS valid FROM customer)
        SELECT coalesce(r.id, l.id) AS id, CASE WHEN r.id IS NULL THEN 'STALE' WHEN l.id IS NULL THEN 'NEW' WHEN NOT valid THEN 'REPAIRED' WHEN r.s = l.s THEN 'UNCHANGED' ELSE 'UPDATED' END AS status FROM r FULL JOIN l ON r.id = l.id""",
    "same_name_clusters": f"""WITH RECURSIVE p AS (SELECT * FROM ({PLACES_SQL}) WHERE "primary"), e AS (SELECT x.place AS s, y.place AS d FROM p x JOIN p y ON x.name = y.name AND x.place <> y.place AND {NEAR} <= 5000),
        u(p, l) AS (SELECT place, place FROM p UNION SELECT e.d, u.l FROM u JOIN e ON e.s = u.p AND u.l < e.d), c AS (SELECT p, min(l) AS c FROM u GROUP BY p),
        k AS (SELECT name, c.c, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM c JOIN p ON c.p = p.place GROUP BY name, c.c)
        SELECT name, c AS first_place, count(*) OVER (PARTITION BY name) AS clusters, n AS observations, {R('lat', 7)} AS lat, {R('lon', 7)} AS lon FROM k""",
    "place_centroids": f"""SELECT name, {R('sum(lat * greatest(1, place % 5)) / sum(greatest(1, place % 5))', 7)} AS lat, {R('sum(lon * greatest(1, place % 5)) / sum(greatest(1, place % 5))', 7)} AS lon, CAST(sum(place % 5) AS BIGINT) AS n FROM ({PLACES_SQL}) GROUP BY name""",
    "cluster_diameters": f"""WITH p AS ({PLACES_SQL}) SELECT x.name, {R(f'coalesce(max({NEAR}), CAST(0 AS DOUBLE))', 1)} AS diameter_m FROM p x LEFT JOIN p y ON x.name = y.name AND x.place < y.place GROUP BY x.name""",
    "alias_pairs": f"""WITH p AS ({ALIAS_SQL}) SELECT x.place AS a, y.place AS b, x.name AS a_name, y.name AS b_name, {R(NEAR)} AS distance_m FROM p x JOIN p y ON x.place < y.place AND x.name <> y.name
        AND (contains(x.name, y.name) OR contains(y.name, x.name)) AND abs(x.lat - y.lat) < 0.05 WHERE {NEAR} <= 5000""",
    "nearest_place": f"""WITH p AS ({PLACES_SQL}), b AS (SELECT x.place AS query, min(({NEAR}, y.place)) AS m FROM p x JOIN p y ON NOT x."primary" AND y."primary" AND abs(x.lat - y.lat) < 0.03 AND {NEAR} <= 3000 GROUP BY x.place)
        SELECT p.place AS query, b.m[2] AS place, {R('b.m[1]')} AS distance_m FROM p LEFT JOIN b ON p.place = b.query WHERE NOT p."primary" """,
    # The nearest track is on the query's own latitude; those on others are more than 5 km away.
    "nearest_track": f"""WITH p AS (SELECT track, seq, lat + CAST(track % 10 AS DOUBLE) / 20 + CAST(track AS DOUBLE) / CAST(10000000 AS DOUBLE) AS lat, lon FROM ({POINTS_SQL})),
        s AS (SELECT track, track % 10 AS k, lat AS a, lon AS o, lead(lat) OVER w AS b, lead(lon) OVER w AS p FROM p WINDOW w AS (PARTITION BY track ORDER BY seq)),
        q AS (SELECT c_custkey AS query, c_custkey % 10 AS k, CAST(40 AS DOUBLE) + CAST(c_custkey % 10 AS DOUBLE) / 20 AS lat, CAST(-3 AS DOUBLE) + CAST(c_custkey % 41 AS DOUBLE) / 10000 AS lon FROM customer),
        h AS (SELECT *, greatest(CAST(0.2 AS DOUBLE), abs(cos(radians((lat + a + b) / 3)))) AS w FROM q JOIN s USING (k) WHERE b IS NOT NULL),
        g AS (SELECT *, radians(p - o) * w * 6371008.8 AS x, radians(b - a) * 6371008.8 AS y, radians(lon - o) * w * 6371008.8 AS px, radians(lat - a) * 6371008.8 AS py FROM h),
        t AS (SELECT *, CASE WHEN x * x + y * y > 1e-9 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (px * x + py * y) / (x * x + y * y))) ELSE CAST(0 AS DOUBLE) END AS t FROM g)
        SELECT query, arg_min(track, square) AS track, {R("arg_min(d, square)", 2)} AS distance_m FROM (SELECT *, (px - x * t) * (px - x * t) + (py - y * t) * (py - y * t) AS square, {haversine_sql('lat', 'lon', 'a + (b - a) * t', 'o + (p - o) * t')} AS d FROM t) GROUP BY query""",
    "attach_variants": f"""WITH p AS ({ALIAS_SQL.replace("WHEN place", 'WHEN NOT "primary" AND place')}), m AS (SELECT * FROM p WHERE "primary"), v AS (SELECT * FROM p WHERE NOT "primary"),
        c AS (SELECT x.place AS variant, y.place, CASE WHEN x.name = y.name THEN 0 ELSE 1 END AS tier, x.route = y.route AS same, {NEAR} AS d FROM v x JOIN m y ON x.name = y.name OR (length(x.name) >= 5 AND length(y.name) >= 5
              AND (contains(x.name, y.name) OR contains(y.name, x.name)) AND x.name NOT IN (SELECT name FROM m))),
        b AS (SELECT variant, min((tier, CASE WHEN tier = 1 AND same THEN 0 ELSE 1 END, d, place)) AS m FROM c GROUP BY variant)
        SELECT v.place AS variant, b.m[4] AS place, b.m[1] = 1 AS by_alias, {R('b.m[3]')} AS distance_m FROM v LEFT JOIN b ON v.place = b.variant""",
}
