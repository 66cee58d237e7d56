"""Checks that are part of a plan: they pass rows on, or stop the job and say why."""

import pytest

from trailnet.operators import records


def test_scope(spark):
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    assert sorted(r.code for r in records.in_scope(codes("ES10c", "PT01a", "IT01a", None)).collect()) == ["ES10c", "PT01a"]
    with pytest.raises(Exception, match="out of scope: FR02b"):
        records.in_scope(codes("ES10c", "FR02b")).collect()


def test_points(spark):
    points = lambda *p: spark.createDataFrame(p, "track int, lat double, lon double")
    got = records.valid_points(points((1, 42.0, -3.0), (1, 42.1, -3.0), (1, None, 5.0), (2, 42.0, -3.0), (3, None, None))).collect()
    assert [r.track for r in got] == [1, 1]
    with pytest.raises(Exception, match="out of range in track 7"):
        records.valid_points(points((1, 42.0, -3.0), (7, 91.0, 0.0), (7, 1.0, 1.0))).collect()


def test_places(spark):
    seen, places = spark.createDataFrame([("o1", "a"), ("o2", "b")], "occurrence string, key string"), spark.createDataFrame([("a", "A"), ("b", "B")], "key string, place string")
    assert sorted(r.place for r in records.required_places(seen, places).collect()) == ["A", "B"]
    with pytest.raises(Exception, match="no place for b"):
        records.required_places(seen, places.where("key = 'a'")).collect()
