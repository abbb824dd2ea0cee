import json
import random

import pytest
from pyspark.sql import functions as F

from ductwise.sources import collection, geojson
from tests.test_geojson import FEATURES


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(n, seed):
    rng = random.Random(seed)
    texts = ['}', '{"', '\\', '\\"}', 'a\\\\"b{', 'й}]', '', 'x' * 3000, '"}{[', "\n}\t"]
    return [
        {"type": "Feature", "id": i, "properties": {"id": i, "object_type": "restriction", "name": rng.choice(texts) * rng.randint(1, 3), "more": [{"a": [rng.choice(texts)]}]},
         "geometry": {"type": "Point", "coordinates": [37.0 + i / 1000, 55.0]}}
        for i in range(n)
    ]


@pytest.mark.parametrize("indent,unicode", [(None, False), (2, True)])
def test_split_document_is_the_document(spark, tmp_path, small_splits, indent, unicode):
    want = made(120, 1)
    document = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "}{\"["}}, "features": want, "after": [[1, 2], {"type": "x"}]}
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=not unicode), encoding="utf-8")
    rows = collection.features(spark, str(path))
    blocks = collection.records(spark, str(path)).select("block").distinct().count()
    assert blocks > 20
    assert collection.records(spark, str(path)).rdd.getNumPartitions() > 4
    got = [json.loads(r["text"]) for r in sorted(rows.collect(), key=lambda r: (r["block"], r["number"]))]
    assert [f for f in got if isinstance(f, dict) and f.get("type") == "Feature"] == want


def test_same_rows_as_the_plain_reader(spark, tmp_path, small_splits):
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    plain, split = (geojson.checked(geojson.scan(spark, str(path), split=s)).orderBy("seq") for s in (False, True))
    columns = ["fid", "object_type", "kind", "code", "lonlat", F.col("props").cast("string").alias("props")]
    assert plain.select(*columns).collect() == split.select(*columns).collect()
    assert split.select("seq").distinct().count() == len(FEATURES)


def test_several_files_and_files_without_features(spark, tmp_path, small_splits):
    for name, n in (("a", 30), ("b", 0), ("c", 7)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"features": made(n, n), "type": "FeatureCollection"}) + "\n\n")
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("")
    got = collection.features(spark, str(tmp_path)).groupBy("file").count().collect()
    assert sorted((r["file"][-6], r["count"]) for r in got) == [("a", 30), ("c", 7)]
