"""Queries along routes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import points as P
from ..operators import route as R
from ..sources import kml
from .frames import POINTS_SQL, fixes, haversine_sql, points, rounded, rounded_sql, table, tracks


def _ends(spark, sf_dir):
    p = points(spark, sf_dir)
    e = p.groupBy("track").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("s"), F.max_by(F.struct("lat", "lon"), "seq").alias("e"))
    return e.select((F.col("track") % 10).alias("route"), "track", F.col("s.lat").alias("alat"), F.col("s.lon").alias("alon"), F.col("e.lat").alias("blat"), F.col("e.lon").alias("blon"))


def orientation_dp(spark, sf_dir):
    r = R.orient_spine(_ends(spark, sf_dir))
    return r.select("route", rounded(F.col("cost_m"), 2).alias("cost_m"), F.col("reversals").cast("long").alias("reversals"), F.size("flags").cast("long").alias("tracks"))


def orientation_greedy(spark, sf_dir):
    return R.orient_greedy(_ends(spark, sf_dir)).select("route", F.size("flags").cast("long").alias("tracks"), F.array_join(F.transform("flags", lambda x: x.cast("int").cast("string")), "").alias("flags"))


def next_place(spark, sf_dir):
    f = fixes(spark, sf_dir)
    stops = tracks(spark, sf_dir).select((F.col("track") % 16).alias("route"), F.col("track").alias("place"), F.col("length_m").alias("at_m"))
    # Of places at one position the least comes first.
    stops = stops.groupBy("route", "at_m").agg(F.min("place").alias("place"))
    q = f.select(F.col("event_id").alias("query"), (F.col("event_id") % 16).alias("route"), ((F.col("event_id") * 7919) % 500000).cast("double").alias("at_m"))
    return R.next_place(stops, q).select("query", "place", rounded(F.col("distance_m"), 2).alias("distance_m"))


def normalize_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    raw = F.regexp_replace("p_name", " ", "_la_")
    return p.select("p_name", N.normalize_place(F.col("p_name")).alias("key"), N.title_words(raw).alias("title"), N.is_pseudo(F.concat(F.when(F.length("p_name") % 2 == 0, "Ramal ").otherwise("la "), "p_name")).alias("pseudo"))


def section_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat((F.col("c_custkey") % 50).cast("string"), F.substring("c_mktsegment", 1, 1)).alias("section"), "c_name")
    return R.placed(c, N.section_order(F.col("section"), F.col("c_name"))).select("c_custkey", "section", "place")


def index_links(spark, sf_dir):
    return kml.links(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.col("place").cast("long").alias("place"), "href")


def formatted(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.format_duration(F.floor(F.abs("c_acctbal"))).alias("duration"), N.darken(F.format_string("#%06X", F.col("c_custkey") * 7 % 16777216), F.lit(0.5)).alias("color"))


QUERIES = {f.__name__: f for f in (orientation_dp, orientation_greedy, next_place, normalize_names, section_sort, index_links, formatted)}

ENDS_SQL = f"""SELECT track % 10 AS route, track, row_number() OVER (PARTITION BY track % 10 ORDER BY track) AS k, arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS blat, arg_max(lon, seq) AS blon
    FROM ({POINTS_SQL}) GROUP BY track"""


def _gap(a: str, b: str) -> str:
    return haversine_sql(f"p.{a}lat", f"p.{a}lon", f"e.{b}lat", f"e.{b}lon")


HEX = "upper(printf('%06x', c_custkey * 7 % 16777216))"
ORACLE_SQL = {
    # The cost forward and reversed, each with its reversals; of equal costs the one with fewer.
    "orientation_dp": f"""WITH RECURSIVE e AS MATERIALIZED ({ENDS_SQL}), p(route, k, f, fn, r, rn, alat, alon, blat, blon) AS (SELECT route, k, CAST(0 AS DOUBLE), 0, CAST(0 AS DOUBLE), 1, alat, alon, blat, blon FROM e WHERE k = 1 UNION ALL
        SELECT route, k, a[1], a[2], b[1], b[2], alat, alon, blat, blon FROM (SELECT e.route, e.k, least((p.f + {_gap('b', 'a')}, p.fn), (p.r + {_gap('a', 'a')}, p.rn)) AS a,
        least((p.f + {_gap('b', 'b')}, p.fn + 1), (p.r + {_gap('a', 'b')}, p.rn + 1)) AS b, e.alat, e.alon, e.blat, e.blon FROM p JOIN e ON e.route = p.route AND e.k = p.k + 1))
        SELECT route, {rounded_sql('m[1]', 2)} AS cost_m, CAST(m[2] AS BIGINT) AS reversals, k AS tracks FROM (SELECT route, max(k) AS k, arg_max(least((f, fn), (r, rn)), k) AS m FROM p GROUP BY route)""",
    "orientation_greedy": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, lead(alat) OVER w AS na, lead(alon) OVER w AS no, lead(blat) OVER w AS nb, lead(blon) OVER w AS np FROM ({ENDS_SQL}) WINDOW w AS (PARTITION BY route ORDER BY k)),
        p(route, k, flag, flags, alat, alon, blat, blon) AS (SELECT route, k, coalesce(first, false), CAST(CAST(coalesce(first, false) AS INT) AS VARCHAR), alat, alon, blat, blon FROM (SELECT *,
          least({haversine_sql('alat', 'alon', 'na', 'no')}, {haversine_sql('alat', 'alon', 'nb', 'np')}) < least({haversine_sql('blat', 'blon', 'na', 'no')}, {haversine_sql('blat', 'blon', 'nb', 'np')}) AS first FROM e WHERE k = 1) UNION ALL
        SELECT route, k, flag, flags || CAST(CAST(flag AS INT) AS VARCHAR), alat, alon, blat, blon FROM (SELECT e.route, e.k, p.flags, CASE WHEN p.flag THEN {_gap('a', 'b')} < {_gap('a', 'a')} ELSE {_gap('b', 'b')} < {_gap('b', 'a')} END AS flag,
          e.alat, e.alon, e.blat, e.blon FROM p JOIN e ON e.route = p.route AND e.k = p.k + 1))
        SELECT route, max(k) AS tracks, arg_max(flags, k) AS flags FROM p GROUP BY route""",
    "next_place": f"""SELECT query, place, {rounded_sql('d', 2)} AS distance_m FROM (SELECT q.query, s.place, s.at_m - q.at_m AS d FROM (SELECT event_id AS query, event_id % 16 AS route, CAST(event_id * 7919 % 500000 AS DOUBLE) AS at_m FROM events) q
        ASOF LEFT JOIN (SELECT o_orderkey % 16 AS route, o_totalprice AS at_m, min(o_orderkey) AS place FROM orders GROUP BY ALL) s ON q.route = s.route AND q.at_m <= s.at_m)""",
    "normalize_names": """SELECT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' la ') AS title, length(p_name) % 2 = 0 AS pseudo FROM (SELECT DISTINCT p_name FROM part)""",
    "section_sort": """SELECT c_custkey, section, row_number() OVER (ORDER BY c_custkey % 50, lower(substr(c_mktsegment, 1, 1)), lower(section), lower(c_name)) AS place
        FROM (SELECT *, concat(c_custkey % 50, substr(c_mktsegment, 1, 1)) AS section FROM customer)""",
    "index_links": """SELECT page_id, CAST(i AS BIGINT) AS place, hrefs[i + 1] AS href FROM (SELECT page_id, hrefs, unnest(range(len(hrefs))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS hrefs FROM pages))""",
    "formatted": f"""SELECT c_custkey, CASE WHEN m >= 60 THEN concat(m // 60, ' h ', lpad(CAST(m % 60 AS VARCHAR), 2, '0'), ' min') ELSE concat(m, ' min') END AS duration,
        concat('#', upper(printf('%02x%02x%02x', r, g, b))) AS color FROM (SELECT c_custkey, CAST(floor(floor(abs(c_acctbal)) / 60) AS BIGINT) AS m,
        {', '.join(f"CAST(floor(CAST(('0x' || substr({HEX}, {k}, 2)) AS INTEGER) * 0.5 + 0.5) AS INTEGER) AS {c}" for k, c in ((1, 'r'), (3, 'g'), (5, 'b')))} FROM customer)""",
}
