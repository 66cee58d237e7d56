"""Place identity and the network against a plain reading of their rules."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailnet.operators import identity as I
from trailnet.operators.folds import haversine

TRACKS = "track long, route string, section string, primary boolean, from_key string, to_key string, from_name string, to_name string, alat double, alon double, blat double, blon double, reversed boolean, length_m double, points int"
RADIUS = 5000.0


def world(seed=4, n=90):
    rng = random.Random(seed)
    towns = {"azofra": (42.42, -2.80), "cirena": (42.44, -2.94), "granon": (42.45, -3.02), "belorado": (42.42, -3.19), "vitoria": (42.85, -2.67), "estella": (42.67, -2.03)}
    tracks = []
    for k in range(n):
        a, b = rng.sample(sorted(towns), 2) if k % 4 else ("azofra", "cirena")
        spot = lambda t: (towns[t][0] + rng.uniform(-1, 1) * 0.0001, towns[t][1] + rng.uniform(-1, 1) * 0.0001)
        p, q = spot(a), spot(b)
        if k % 10 == 3:
            p = (p[0] + 0.2, p[1])
        back = k % 5 == 2
        (alat, alon), (blat, blon) = (q, p) if back else (p, q)
        a = "vitoriagasteiz" if a == "vitoria" and k % 2 else "ramal norte" if k % 17 == 5 else f"solo{k % 3}" if k % 19 == 4 else a
        b = None if k == 50 else "estellalizarra" if b == "estella" and k % 3 == 0 else b
        tracks.append((k, f"ES{k % 3}", f"{k:02d}", k % 19 != 4 and k % 3 != 0, a, b, (a or "").title(), (b or "").title() or None, alat, alon, blat, blon, back, 0.0, 3))
    mids = {t[0]: ((t[8] + t[10]) / 2 + (t[0] // 4 % 3) * 0.0012, (t[9] + t[11]) / 2) for t in tracks}
    length = lambda t: haversine(t[8], t[9], *mids[t[0]]) + haversine(*mids[t[0]], t[10], t[11])
    return [(*t[:13], length(t), 3) for t in tracks], mids


def clusters(obs):
    """Ends of one name in steps of up to the radius, in the order of their numbers."""
    groups = []
    for o in obs:
        near = [g for g in groups if any(haversine(*o[3:5], *x[3:5]) <= RADIUS for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [o]]
    mean = lambda g, i: sum(x[i] for x in g) / len(g)
    return sorted(groups, key=lambda g: (mean(g, 3), mean(g, 4), min(x[0] for x in g)))


def brute_identity(tracks):
    named = [t for t in tracks if t[4] and t[5] and not t[4].startswith("ramal")]
    at = lambda t, role, back: (t[8:10] if (role == "from") != back else t[10:12])
    place_of, places = {}, {}

    def add(obs, source):
        by = defaultdict(list)
        for o in obs:
            by[o[2]].append(o)
        for name, own in by.items():
            found = clusters(own)
            for i, g in enumerate(found, 1):
                key = name if len(found) == 1 else f"{name}@{i}"
                places[key] = [name, round(sum(x[3] for x in g) / len(g), 7), round(sum(x[4] for x in g) / len(g), 7), len(g), {x[5] for x in g}, source]
                for x in g:
                    place_of[x[0], x[1]] = key

    see = lambda t, back: [(t[0], role, t[4] if role == "from" else t[5], *at(t, role, back), t[1]) for role in ("from", "to")]
    add([o for t in named if t[3] for o in see(t, t[12])], I.PRIMARY)
    main, rest, attached, extra = dict(places), [], {}, defaultdict(set)
    for t in named:
        if t[3]:
            continue
        ways = []
        for back in (False, True):
            d = [min((haversine(*o[3:5], *p[1:3]) for p in main.values() if p[0] == o[2]), default=None) for o in see(t, back)]
            known = [x for x in d if x is not None]
            ways.append((sum(known), -len(known), back))
        for o in see(t, min(ways)[2]):
            exact = [k for k, p in main.items() if p[0] == o[2]]
            alias = [k for k, p in main.items() if min(len(p[0]), len(o[2])) >= 5 and (p[0] in o[2] or o[2] in p[0])]
            options = exact or [k for k in alias if o[5] in main[k][4]] or alias
            if not options:
                rest.append(o)
                continue
            d, key = min((haversine(*o[3:5], *main[k][1:3]), k) for k in options)
            place_of[o[0], o[1]] = key
            attached[o[0], o[1]] = (key, round(d, 1), d > RADIUS, not exact)
            extra[key].add(o[5])
    add(rest, I.VARIANT_ONLY)
    for key, routes in extra.items():
        places[key] = [*places[key][:4], places[key][4] | routes, places[key][5]]
    return place_of, places, attached


def brute_network(tracks, mids):
    place_of, places, attached = brute_identity(tracks)
    merged = {k: {k} for k in places}
    pairs = [(haversine(*places[a][1:3], *places[b][1:3]), a, b) for a, b in itertools.combinations(sorted(places), 2) if places[a][0] != places[b][0] and (places[a][0] in places[b][0] or places[b][0] in places[a][0])]
    pairs = [p for p in pairs if p[0] <= RADIUS]
    for _, a, b in sorted(pairs):
        if merged[a] is not merged[b] and all(haversine(*places[x][1:3], *places[y][1:3]) <= RADIUS for x in merged[a] for y in merged[b]):
            union = merged[a] | merged[b]
            for x in union:
                merged[x] = union
    to = {k: min(g) for k, g in merged.items()}
    told = [t for t in tracks if t[4] and t[5]]
    detached = [t for t in told if t[4].startswith("ramal")]
    own = [(t, to[place_of[t[0], "from"]], to[place_of[t[0], "to"]]) for t in told if t not in detached]
    by = defaultdict(list)
    for t, a, b in own:
        if a != b:
            by[a, b].append(t)
    line = {}
    for t, _, _ in own:
        pts, leg = [t[8:10], mids[t[0]], t[10:12]], haversine(*t[8:10], *mids[t[0]])
        total, line[t[0]] = t[13], []
        for k in range(101):
            at = total / 100 * k
            (p, q, s) = (pts[0], pts[1], at / leg) if at < leg else (pts[1], pts[2], min(1.0, (at - leg) / (total - leg)))
            line[t[0]].append((p[0] + (q[0] - p[0]) * s, p[1] + (q[1] - p[1]) * s))
    edges = {}
    for (a, b), ts in by.items():
        groups = []
        for t in ts:
            same = lambda x, t=t: abs(x[13] - t[13]) / max(x[13], t[13]) <= 0.02 and min(max(haversine(*p, *q) for p, q in zip(line[t[0]], way, strict=True)) for way in (line[x[0]], line[x[0]][::-1])) <= 30
            near = [g for g in groups if any(same(x) for x in g)]
            groups = [g for g in groups if g not in near] + [sum(near, []) + [t]]
        for i, g in enumerate(sorted(groups, key=lambda g: min(t[1:3] for t in g)), 1):
            edges[f"{a}>{b}#{i}"] = (sorted(t[0] for t in g), len(groups), min(g, key=lambda t: (t[13], t[0]))[0])
    return edges, detached, [t for t, a, b in own if a == b], to, attached, by


def test_identity_against_brute_force(spark):
    tracks, _ = world()
    df = spark.createDataFrame(tracks, TRACKS)
    place_of, places, attached = brute_identity(tracks)
    for frame in (df, df.orderBy(F.desc("track")).repartition(7)):
        got = I.place_identity(frame)
        assert {(r.track, r.role): r.place for r in got.occurrences.collect()} == place_of
        found = {r.place: [r["name"], r.lat, r.lon, r.observations, set(r.routes), r.source] for r in got.places.collect()}
        assert found == {k: [p[0], pytest.approx(p[1], abs=1e-7), pytest.approx(p[2], abs=1e-7), *p[3:]] for k, p in places.items()}
        assert {(r.track, r.role): (r.place, r.distance_m, r.outside, r.reason.startswith("variant_endpoint_name_alias")) for r in got.attachments.collect()} == attached
        assert {(r["name"], r.source) for r in got.splits.collect()} == {(p[0], p[5]) for k, p in places.items() if "@" in k}
    assert any(a[3] for a in attached.values()) and any(p[5] == I.VARIANT_ONLY for p in places.values()) and any("@" in k for k in places)


def test_network_against_brute_force(spark):
    tracks, mids = world()
    points = [(t[0], i, along, *p) for t in tracks for i, (along, p) in enumerate(((0.0, t[8:10]), (haversine(*t[8:10], *mids[t[0]]), mids[t[0]]), (t[13], t[10:12])))]
    got = I.global_network(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(points, "track long, seq int, along_m double, lat double, lon double"))
    edges, detached, collapsed, to, attached, by = brute_network(tracks, mids)
    assert {r.edge_id: (r.tracks, r.families, r.representative) for r in got.edges.collect()} == {k: (len(ts), n, rep) for k, (ts, n, rep) in edges.items()}
    nodes = {r.place: (r.incoming, r.outgoing) for r in got.nodes.collect()}
    ends = [k.split("#")[0].split(">") for k in edges]
    assert nodes == {p: (sum(b == p for _, b in ends), sum(a == p for a, _ in ends)) for p in {x for e in ends for x in e}}
    c = got.counters.first().asDict()
    assert (c["nodes"], c["edge_families"], c["logical_pairs"]) == (len(nodes), len(edges), len(by))
    assert c["alternative_pairs"] == sum(n > 1 for n in {k.split("#")[0]: n for k, (_, n, _) in edges.items()}.values())
    assert (c["detached_variant_tracks"], c["collapsed_alias_connector_tracks"]) == (len(detached), len(collapsed))
    assert c["automatic_alias_merges"] == sum(k != v for k, v in to.items()) > 0
    assert c["merged_duplicate_source_tracks"] == sum(len(ts) - 1 for ts, _, _ in edges.values()) > 0
    assert (c["variant_endpoints_attached_to_primary_places"], c["variant_endpoints_forced_outside_radius"]) == (len(attached), sum(a[2] for a in attached.values()))


def test_empty_and_least_radius(spark):
    none = spark.createDataFrame([], TRACKS)
    assert I.place_identity(none).occurrences.count() == 0
    with pytest.raises(ValueError, match="1000"):
        I.place_identity(none, 999.0)
