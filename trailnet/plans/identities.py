"""Place identity and the network of places from tracks, end to end, and the SQL of the former."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..operators import identity as I
from ..operators.graph import stored
from .frames import haversine_sql, rounded, rounded_sql, table

_COLUMNS, _STEP, _DIGITS, _LETTERS = 100, 0.25, "0123456789", "abcdefghij"


def walks(spark, sf_dir):
    """A track for each order between two places of a grid, named by letters for digits; some have longer names, some lie apart, some run backwards."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    way = (n % 4 + 1).cast("int")
    row, column = F.floor(F.col("o_custkey") / _COLUMNS), F.col("o_custkey") % _COLUMNS
    over = column + F.element_at(F.array(*map(F.lit, (1, 0, 1, -1))), way)
    over = F.when(over == _COLUMNS, _COLUMNS - 2).when(over < 0, 1).otherwise(over)
    to_row = row + F.when(way > 1, 1).otherwise(0)
    shift = (n % 7 - 3).cast("double") * F.lit(0.00005)
    at = lambda r, apart: F.lit(-25.0) + (r % 200).cast("double") * F.lit(_STEP) + shift + F.when(apart, F.lit(0.1)).otherwise(F.lit(0.0))
    lon = lambda c: F.lit(-12.0) + c.cast("double") * F.lit(_STEP)
    name = lambda k: F.translate(F.lpad(k.cast("string"), 8, "0"), _DIGITS, _LETTERS)
    longer = lambda m: F.when(n % m == 0, "villa").otherwise("")
    start = F.concat(F.when(n % 13 == 0, "ramal").otherwise(""), name(F.col("o_custkey")), longer(11))
    goal = F.concat(name(to_row * _COLUMNS + over), longer(17))
    df = o.select(
        n.alias("track"), F.concat(F.lit("R"), row.cast("string")).alias("route"), F.lpad(n.cast("string"), 9, "0").alias("section"), (n % 5 != 0).alias("primary"), start.alias("from_key"), goal.alias("to_key"),
        (n % 6 == 0).alias("reversed"), at(row, n % 9 == 0).alias("flat"), lon(column).alias("flon"), at(to_row, F.lit(False)).alias("tlat"), lon(over).alias("tlon"), (F.floor(n / 8) % 3).cast("double").alias("bend"),
    )
    swap = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a))
    df = df.select("*", swap("flat", "tlat").alias("alat"), swap("flon", "tlon").alias("alon"), swap("tlat", "flat").alias("blat"), swap("tlon", "flon").alias("blon"))
    df = df.withColumn("mlat", (F.col("alat") + F.col("blat")) / 2 + F.col("bend") * F.lit(0.00011)).withColumn("mlon", (F.col("alon") + F.col("blon")) / 2)
    length = haversine_m("alat", "alon", "mlat", "mlon") + haversine_m("mlat", "mlon", "blat", "blon")
    return df.select("*", F.initcap("from_key").alias("from_name"), F.initcap("to_key").alias("to_name"), length.alias("length_m"), F.lit(3).alias("points")).drop("flat", "flon", "tlat", "tlon", "bend")


def walk_points(walks):
    """(track, seq, along_m, lat, lon): the beginning, the middle and the end of each."""
    stops = F.array(*[F.struct(F.lit(i).alias("seq"), F.col(f"{p}lat").alias("lat"), F.col(f"{p}lon").alias("lon")) for i, p in enumerate("amb")])
    p = walks.select("track", F.explode(stops).alias("s")).select("track", "s.*")
    w = Window.partitionBy("track").orderBy("seq")
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0))
    return p.withColumn("_step", step).withColumn("along_m", F.sum("_step").over(w)).drop("_step")


def _network(spark, sf_dir):
    t = stored(walks(spark, sf_dir))
    return I.global_network(t, walk_points(t))


def place_occurrences(spark, sf_dir):
    return I.place_identity(walks(spark, sf_dir)).occurrences.select("track", "role", "name", "place")


def place_records(spark, sf_dir):
    p = I.place_identity(walks(spark, sf_dir)).places
    return p.select("place", "name", "observations", "attached", F.array_join("routes", "|").alias("routes"), "cluster_index", "cluster_count", "source", rounded(F.col("lat"), 5).alias("lat"), rounded(F.col("lon"), 5).alias("lon"))


def variant_attachments(spark, sf_dir):
    return I.place_identity(walks(spark, sf_dir)).attachments.select("track", "role", "place", rounded(F.col("distance_m"), 0).alias("distance_m"), "outside", "reason")


def network_nodes(spark, sf_dir):
    n = _network(spark, sf_dir).nodes
    return n.select("place", "name", "observations", "incoming", "outgoing", "is_merge", "is_branch", "component_id", F.array_join("routes", "|").alias("routes"), F.array_join("incoming_edges", "|").alias("incoming_edges"), F.array_join("outgoing_edges", "|").alias("outgoing_edges"))


def network_edges(spark, sf_dir):
    e = _network(spark, sf_dir).edges
    return e.select("edge_id", "from_key", "to_key", "family_index", "families", "kind", "tracks", "representative", F.array_join("routes", "|").alias("routes"), rounded(F.col("length_min_m")).alias("length_min_m"), rounded(F.col("length_max_m")).alias("length_max_m"))


def network_report(spark, sf_dir):
    c = _network(spark, sf_dir).counters
    return c.select(*[F.col(x).cast("long").alias(x) for x in c.columns])


QUERIES = {f.__name__: f for f in (place_occurrences, place_records, variant_attachments, network_nodes, network_edges, network_report)}

_OVER = f"(o_custkey % {_COLUMNS} + [1, 0, 1, -1][o_orderkey % 4 + 1])"
_OVER = f"(CASE {_OVER} WHEN {_COLUMNS} THEN {_COLUMNS - 2} WHEN -1 THEN 1 ELSE {_OVER} END)"
_TO_ROW = f"(o_custkey // {_COLUMNS} + CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE 1 END)"
_D = lambda x: f"CAST({x} AS DOUBLE)"
_LAT = lambda r: f"{_D(-25)} + {_D(f'{r} % 200')} * {_D(_STEP)} + {_D('o_orderkey % 7 - 3')} * {_D(0.00005)}"
_LON = lambda c: f"{_D(-12)} + {_D(c)} * {_D(_STEP)}"
_NAME = lambda k: f"translate(lpad(CAST({k} AS VARCHAR), 8, '0'), '{_DIGITS}', '{_LETTERS}')"
WALKS_SQL = f"""
    SELECT o_orderkey AS track, 'R' || (o_custkey // {_COLUMNS}) AS route, o_orderkey % 5 <> 0 AS prime, o_orderkey % 6 = 0 AS back,
           CASE WHEN o_orderkey % 13 = 0 THEN 'ramal' ELSE '' END || {_NAME('o_custkey')} || CASE WHEN o_orderkey % 11 = 0 THEN 'villa' ELSE '' END AS from_key,
           {_NAME(f'({_TO_ROW} * {_COLUMNS} + {_OVER})')} || CASE WHEN o_orderkey % 17 = 0 THEN 'villa' ELSE '' END AS to_key,
           {_LAT(f'(o_custkey // {_COLUMNS})')} + CASE WHEN o_orderkey % 9 = 0 THEN {_D(0.1)} ELSE {_D(0)} END AS flat, {_LON(f'(o_custkey % {_COLUMNS})')} AS flon,
           {_LAT(_TO_ROW)} + {_D(0)} AS tlat, {_LON(_OVER)} AS tlon FROM orders"""


def _cluster_sql(n: str, source: str) -> str:
    """The clusters of the ends in source: each end's least end in steps of 5 km, then places by position."""
    metres = haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")
    return f"""
{n}_near AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM {source} x JOIN {source} y ON x.name = y.name AND x.lat BETWEEN y.lat - 0.05 AND y.lat + 0.05 WHERE {metres} <= 5000),
{n}_reach(id, l) AS (SELECT a, min(b) FROM {n}_near GROUP BY a UNION SELECT p.a, min(r.l) FROM {n}_near p JOIN {n}_reach r ON r.id = p.b GROUP BY p.a),
{n}_label AS (SELECT id, min(l) AS l FROM {n}_reach GROUP BY id),
{n}_group AS (SELECT name, l, avg(lat) AS lat, avg(lon) AS lon, count(*) AS observations, min(track) AS first, list_sort(list_distinct(list(route))) AS routes FROM {source} JOIN {n}_label USING (id) GROUP BY name, l),
{n}_index AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lat, lon, first) AS i, count(*) OVER (PARTITION BY name) AS c FROM {n}_group),
{n}_place AS MATERIALIZED (SELECT l, CASE WHEN c > 1 THEN name || '@' || i ELSE name END AS place, name, round(lat, 7) AS lat, round(lon, 7) AS lon, observations, routes, i, c FROM {n}_index),"""


IDENTITY_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM ({WALKS_SQL}) WHERE NOT starts_with(from_key, 'ramal')),
ends AS MATERIALIZED (
  SELECT track * 2 AS id, track, route, prime, 'from' AS role, from_key AS name, flat AS lat, flon AS lon, tlat AS olat, tlon AS olon, back FROM t
  UNION ALL SELECT track * 2 + 1, track, route, prime, 'to', to_key, tlat, tlon, flat, flon, back FROM t),
main AS MATERIALIZED (SELECT * FROM ends WHERE prime),
{_cluster_sql("p", "main")}
-- The way round of the other tracks: as they lie (from the geometry's beginning) or reversed, by the nearest centres of their names.
guess AS (
  SELECT e.track, e.role, g.turned, min({haversine_sql("CASE WHEN e.back = g.turned THEN e.lat ELSE e.olat END", "CASE WHEN e.back = g.turned THEN e.lon ELSE e.olon END", "p.lat", "p.lon")}) AS d
  FROM (SELECT * FROM ends WHERE NOT prime) e, (SELECT unnest([false, true]) AS turned) g LEFT JOIN p_place p ON p.name = e.name GROUP BY ALL),
scored AS (SELECT track, turned, coalesce(sum(d), 0) AS s, count(d) AS n FROM guess GROUP BY ALL),
way AS (SELECT track, turned FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s, -n, turned) AS k FROM scored) WHERE k = 1),
other AS MATERIALIZED (
  SELECT e.id, e.track, e.route, e.role, e.name, CASE WHEN e.back = w.turned THEN e.lat ELSE e.olat END AS lat, CASE WHEN e.back = w.turned THEN e.lon ELSE e.olon END AS lon
  FROM ends e JOIN way w ON w.track = e.track WHERE NOT e.prime),
-- Names hold each other only where one is the other and 'villa': the join on what is before it loses nothing.
bare AS (SELECT *, regexp_replace(name, 'villa$', '') AS stem FROM p_place),
match AS (
  SELECT o.id, p.place, CASE WHEN o.name = p.name THEN 0 ELSE 1 END AS tier, list_contains(p.routes, o.route) AS own, {haversine_sql("o.lat", "o.lon", "p.lat", "p.lon")} AS d
  FROM other o JOIN bare p ON p.stem = regexp_replace(o.name, 'villa$', '') AND (contains(o.name, p.name) OR contains(p.name, o.name))),
taken AS MATERIALIZED (SELECT id, arg_min(place, (tier, CASE WHEN tier = 1 AND own THEN 0 ELSE 1 END, d, place)) AS place, min((tier, CASE WHEN tier = 1 AND own THEN 0 ELSE 1 END, d, place)) AS m FROM match GROUP BY id),
left_over AS MATERIALIZED (SELECT * FROM other WHERE id NOT IN (SELECT id FROM taken)),
{_cluster_sql("v", "left_over")}
occurrence AS (
  SELECT track, role, e.name, place FROM main e JOIN p_label USING (id) JOIN p_place USING (l)
  UNION ALL SELECT track, role, name, place FROM other JOIN taken USING (id)
  UNION ALL SELECT track, role, e.name, place FROM left_over e JOIN v_label USING (id) JOIN v_place USING (l))
"""
ORACLE_SQL = {
    "place_occurrences": f"{IDENTITY_SQL} SELECT track, role, name, place FROM occurrence",
    "place_records": f"""{IDENTITY_SQL}, held AS (SELECT place, count(*) AS n, list(DISTINCT route) AS r FROM other JOIN taken USING (id) GROUP BY place)
        SELECT place, name, observations, coalesce(n, 0) AS attached, array_to_string(list_sort(list_distinct(list_concat(routes, coalesce(r, [])))), '|') AS routes, i AS cluster_index, c AS cluster_count, 'primary_tracks' AS source,
               {rounded_sql('lat', 5)} AS lat, {rounded_sql('lon', 5)} AS lon FROM p_place LEFT JOIN held USING (place)
        UNION ALL SELECT place, name, observations, observations, array_to_string(routes, '|'), i, c, 'variant_only_tracks', {rounded_sql('lat', 5)}, {rounded_sql('lon', 5)} FROM v_place""",
    "variant_attachments": f"""{IDENTITY_SQL} SELECT track, role, place, {rounded_sql('round(m[3], 1)', 0)} AS distance_m, m[3] > 5000 AS outside,
        CASE WHEN m[1] = 1 THEN 'variant_endpoint_name_alias_primary_place' ELSE 'variant_endpoint_exact_name_primary_place' END AS reason FROM other JOIN taken USING (id)""",
}

_AT = "total / 100 * i"
_MID = lambda a, m, b: f"CASE WHEN {_AT} < leg THEN {a} + ({m} - {a}) * ({_AT} / leg) ELSE {m} + ({b} - {m}) * least(CAST(1 AS DOUBLE), ({_AT} - leg) / (total - leg)) END"
_SEP = haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")
#: Places whose names hold each other lie a few metres apart or kilometres: two at most are merged, so the lesser of both stands for them.
NETWORK_SQL = f"""{IDENTITY_SQL},
placed AS MATERIALIZED (
  SELECT place, name, lat, lon, observations, list_sort(list_distinct(list_concat(routes, coalesce(r, [])))) AS routes FROM p_place LEFT JOIN (SELECT place, list(DISTINCT route) AS r FROM other JOIN taken USING (id) GROUP BY place) USING (place)
  UNION ALL SELECT place, name, lat, lon, observations, routes FROM v_place),
stemmed AS (SELECT *, regexp_replace(name, 'villa$', '') AS stem FROM placed),
alias AS MATERIALIZED (SELECT x.place AS a, y.place AS b FROM stemmed x JOIN stemmed y ON x.stem = y.stem AND x.name <> y.name WHERE {_SEP} <= 5000),
canon AS MATERIALIZED (SELECT place, least(place, coalesce(m, place)) AS c FROM placed LEFT JOIN (SELECT a AS place, min(b) AS m FROM alias GROUP BY a) USING (place)),
record AS MATERIALIZED (
  SELECT c AS place, arg_max(upper(name[1]) || substr(name, 2), (length(name), name)) AS name, sum(observations) AS observations, list_sort(list_distinct(flatten(list(routes)))) AS routes FROM placed JOIN canon USING (place) GROUP BY c),
walk AS MATERIALIZED (
  SELECT *, {haversine_sql("alat", "alon", "mlat", "mlon")} AS leg, {haversine_sql("alat", "alon", "mlat", "mlon")} + {haversine_sql("mlat", "mlon", "blat", "blon")} AS total FROM (
    SELECT *, (alat + blat) / 2 + CAST(track // 8 % 3 AS DOUBLE) * CAST(0.00011 AS DOUBLE) AS mlat, (alon + blon) / 2 AS mlon FROM (
      SELECT track, route, CASE WHEN back THEN tlat ELSE flat END AS alat, CASE WHEN back THEN tlon ELSE flon END AS alon, CASE WHEN back THEN flat ELSE tlat END AS blat, CASE WHEN back THEN flon ELSE tlon END AS blon FROM t))),
own AS MATERIALIZED (
  SELECT w.*, f.c AS f, g.c AS g FROM walk w JOIN (SELECT track, c FROM occurrence JOIN canon USING (place) WHERE role = 'from') f USING (track) JOIN (SELECT track, c FROM occurrence JOIN canon USING (place) WHERE role = 'to') g USING (track)),
sample AS MATERIALIZED (SELECT track, f, g, total, i, {_MID("alat", "mlat", "blat")} AS lat, {_MID("alon", "mlon", "blon")} AS lon FROM own, (SELECT unnest(range(101)) AS i) WHERE f <> g),
apart AS (
  SELECT x.track AS a, y.track AS b, max(CASE WHEN x.i = y.i THEN {_SEP} END) AS fwd, max(CASE WHEN x.i = 100 - y.i THEN {_SEP} END) AS rev, abs(any_value(x.total) - any_value(y.total)) / greatest(any_value(x.total), any_value(y.total)) AS diff
  FROM sample x JOIN sample y ON x.f = y.f AND x.g = y.g AND x.track <> y.track AND (x.i = y.i OR x.i = 100 - y.i) GROUP BY x.track, y.track),
alike AS MATERIALIZED (SELECT a, b FROM apart WHERE least(fwd, rev) <= 30 AND diff <= 0.02),
kin(track, l) AS (SELECT track, track FROM own WHERE f <> g UNION SELECT a.b, k.l FROM kin k JOIN alike a ON a.a = k.track),
family AS (SELECT track, min(l) AS l FROM kin GROUP BY track),
ranked AS (
  SELECT f AS from_key, g AS to_key, l, count(*) AS tracks, min(total) AS shortest, max(total) AS longest, arg_min(track, (total, track)) AS representative, list_sort(list_distinct(list(route))) AS routes, min((route, track)) AS first
  FROM own JOIN family USING (track) GROUP BY f, g, l),
edge AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY from_key, to_key ORDER BY first) AS family_index, count(*) OVER (PARTITION BY from_key, to_key) AS families FROM ranked),
named_edge AS MATERIALIZED (SELECT *, from_key || '>' || to_key || '#' || family_index AS edge_id FROM edge),
bond AS MATERIALIZED (SELECT from_key AS a, to_key AS b FROM edge UNION SELECT to_key, from_key FROM edge),
part(place, l) USING KEY (place) AS (
  SELECT a, min(least(a, b)) FROM bond GROUP BY a
  UNION ALL SELECT x.place, x.l FROM (SELECT b.b AS place, min(p.l) AS l FROM part p JOIN bond b ON b.a = p.place GROUP BY b.b) x JOIN recurring.part q ON q.place = x.place WHERE x.l < q.l),
size AS (SELECT l, row_number() OVER (ORDER BY count(*) DESC, l) AS component_id FROM part GROUP BY l)
"""
ORACLE_SQL["network_edges"] = f"""{NETWORK_SQL} SELECT edge_id, from_key, to_key, family_index, families, CASE WHEN families > 1 THEN 'ALTERNATIVE' WHEN tracks > 1 THEN 'SHARED' ELSE 'SINGLE' END AS kind, tracks, representative,
    array_to_string(routes, '|') AS routes, {rounded_sql('shortest')} AS length_min_m, {rounded_sql('longest')} AS length_max_m FROM named_edge"""
ORACLE_SQL["network_nodes"] = f"""{NETWORK_SQL}, goes AS (SELECT from_key AS place, count(*) AS n, string_agg(edge_id, '|' ORDER BY edge_id) AS ids FROM named_edge GROUP BY 1), comes AS (SELECT to_key AS place, count(*) AS n, string_agg(edge_id, '|' ORDER BY edge_id) AS ids FROM named_edge GROUP BY 1)
    SELECT place, name, observations, coalesce(c.n, 0) AS incoming, coalesce(g.n, 0) AS outgoing, coalesce(c.n, 0) >= 2 AS is_merge, coalesce(g.n, 0) >= 2 AS is_branch, component_id, array_to_string(routes, '|') AS routes,
           coalesce(c.ids, '') AS incoming_edges, coalesce(g.ids, '') AS outgoing_edges FROM part JOIN size USING (l) JOIN record USING (place) LEFT JOIN goes g USING (place) LEFT JOIN comes c USING (place)"""
ORACLE_SQL["network_report"] = f"""{NETWORK_SQL} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM size) AS weak_components, (SELECT count(*) FROM edge) AS edge_families, (SELECT CAST(sum(tracks - 1) AS BIGINT) FROM edge) AS merged_duplicate_source_tracks,
    (SELECT count(DISTINCT (from_key, to_key)) FROM edge) AS logical_pairs, (SELECT count(DISTINCT (from_key, to_key)) FROM edge WHERE families > 1) AS alternative_pairs, (SELECT count(*) FROM ({WALKS_SQL}) WHERE starts_with(from_key, 'ramal')) AS detached_variant_tracks,
    (SELECT count(*) FROM own WHERE f = g) AS collapsed_alias_connector_tracks, (SELECT count(DISTINCT name) FROM p_place WHERE c > 1) + (SELECT count(DISTINCT name) FROM v_place WHERE c > 1) AS spatially_split_normalized_names,
    (SELECT count(*) FROM canon WHERE place <> c) AS automatic_alias_merges, (SELECT count(*) FROM alias x JOIN canon p ON p.place = x.a JOIN canon q ON q.place = x.b WHERE x.a < x.b AND p.c <> q.c AND (p.c IN (SELECT place FROM part) OR q.c IN (SELECT place FROM part))) AS alias_candidates,
    (SELECT count(*) FROM taken) AS variant_endpoints_attached_to_primary_places, (SELECT count(*) FROM taken WHERE m[3] > 5000) AS variant_endpoints_forced_outside_radius"""
