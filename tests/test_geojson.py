import json

import pytest
from pyspark.sql import functions as F

from ductwise.sources import geojson


def feature(fid, kind, geometry, coordinates, **more):
    props = {"id": fid, "object_type": kind, **more}
    return {"type": "Feature", "properties": {k: v for k, v in props.items() if v is not ...}, "geometry": {"type": geometry, "coordinates": coordinates}}


SQUARE = [[[37.0, 55.0], [37.001, 55.0], [37.001, 55.001], [37.0, 55.001], [37.0, 55.0]]]
FEATURES = [
    feature(1, "source", "Point", [37.0, 55.0]),
    feature("n1", "heat_network", "LineString", [[37.0, 55.0], [37.01, 55.0]], diameter=200, flow_tph=100.0),
    feature("n2", "heat_network", "LineString", [[37.01, 55.0], [37.02, 55.0]], diameter=210.0),
    feature("n3", "heat_network", "Point", [37.0, 55.0], diameter=200),
    feature("n4", "heat_network", "LineString", [[37.0, 55.0], [37.0, 55.0]], diameter=200),
    feature("n5", "heat_network", "LineString", [[37.0, 55.0], [37.1, 55.0]]),
    feature("n6", "heat_network", "LineString", [[37.0, 55.0], [37.1, 55.0]], diameter="200"),
    feature("n7", "heat_network", "LineString", [[37.0, 55.0], [37.1, 55.0]], diameter=200.5),
    feature("n1", "heat_chamber", "Point", [37.01, 55.0]),
    feature("b1", "restriction", "Polygon", SQUARE, restriction_type="OKS"),
    feature("b2", "restriction", "MultiPolygon", [SQUARE], restriction_type="metro"),
    feature("b3", "restriction", "Polygon", [SQUARE[0][:-1]], restriction_type="park"),
    feature("b4", "restriction", "MultiPoint", [[37.0, 55.0], [37.1, 55.1]], restriction_type="road"),
    feature("f1", "oks_future", "Polygon", SQUARE, flow_tph=-1),
    feature("f2", "oks_future", "Polygon", SQUARE, flow_tph="3"),
    feature("p1", "oks_connection_point", "Point", [537.0, 55.0]),
    feature("x", "tower", "Point", [37.0, 55.0]),
    feature("g", "source", "Point", "here"),
    feature("", "source", "Point", [37.0, 55.0]),
    {"type": "Feature", "id": 77, "properties": {"object_type": "heat_chamber"}, "geometry": {"type": "Point", "coordinates": [37.0, 55.0]}},
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [37.0, 55.0]}},
    {"type": "Feature", "properties": {"id": 5, "object_type": "source"}, "geometry": None},
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("geo") / "small.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    return geojson.checked(geojson.scan(spark, str(path))).cache()


def test_first_failing_check_wins(rows):
    got = {(r["seq"], r["code"]) for r in rows.where("code is not null").collect()}
    assert got == {
        (3, "feature.geometry_type"), (4, "feature.invalid_geometry"), (5, "feature.missing_attribute"), (6, "feature.attribute_type"), (7, "feature.attribute_type"),
        (11, "feature.invalid_geometry"), (13, "feature.negative_flow"), (14, "feature.attribute_type"), (15, "feature.coordinates_out_of_range"), (16, "feature.unknown_object_type"),
        (17, "feature.bad_geometry"), (18, "feature.no_id"), (20, "feature.no_properties"), (21, "feature.no_geometry"),
    }


def test_good_features_are_typed(rows):
    good = {r["seq"]: r for r in geojson.typed(rows).collect()}
    assert good[0]["fid"] == "1" and good[0]["id_is_number"] and good[19]["fid"] == "77"
    assert good[9]["object_type"] == "oks_existing" and good[9]["restriction_type"] is None and good[10]["restriction_type"] == "metro"
    assert abs(good[1]["length_m"] - 639.6) < 1 and abs(good[9]["area_m2"] - 63.96 * 111.4) < 60
    assert len(good[12]["parts"]) == 2
    assert [r["seq"] for r in geojson.core_first(geojson.typed(rows)).where("fid = 'n1'").collect()] == [1]


def test_issues_and_overview(rows):
    got = {(r["code"], r["severity"], r["feature_id"]) for r in geojson.issues(rows).collect()}
    assert {("restriction.building", "INFO", "b1"), ("restriction.unknown_type", "WARNING", "b2"), ("network.nonstandard_dn", "WARNING", "n2"), ("feature.duplicate_id", "ERROR", "n1"), ("feature.no_properties", "ERROR", "#20")} <= got
    assert {r["object_type"]: r["n"] for r in geojson.overview(geojson.typed(rows)).collect()}["heat_network"] == 2


def test_files_that_are_none(spark, tmp_path):
    for name, text, code in (("a", '{"type": "Feature"}', "file.not_feature_collection"), ("b", '{"type": "FeatureCollection"}', "file.no_features")):
        (tmp_path / name).write_text(text)
        assert [r["code"] for r in geojson.file_issue(spark, str(tmp_path / name)).collect()] == [code]


def test_store_and_lines(spark, rows, tmp_path):
    geojson.store(geojson.typed(rows), str(tmp_path / "ds"))
    back = spark.read.parquet(str(tmp_path / "ds")).where("object_type = 'heat_network'")
    assert back.count() == 2
    out = geojson.typed(rows).where("seq in (0, 1)").select("fid", "object_type", F.lit(1).alias("variant_id"), "lonlat", F.create_map(F.lit("diameter"), F.lit("200")).alias("attributes"))
    parsed = sorted((json.loads(r["value"]) for r in geojson.result_lines(out).collect()), key=lambda f: str(f["properties"]["id"]))
    assert parsed[0] == {"type": "Feature", "properties": {"id": 1, "object_type": "source", "variant_id": 1, "diameter": 200}, "geometry": {"type": "Point", "coordinates": [37.0, 55.0]}}
    assert parsed[1]["geometry"]["coordinates"] == [[37.0, 55.0], [37.01, 55.0]]
