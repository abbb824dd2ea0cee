"""GeoJSON features: scan, ordered checks, diagnostics, and the result sink.

A feature becomes a row (seq, fid, object_type, restriction_type, props, kind, parts, envelope, length_m, area_m2). `parts` are
the rings or lines of its geometry as arrays of (x, y) in metres of zone 37 north; `lonlat` holds the same in degrees.
Validity means: rings closed with four points or more and an area, lines with a length; crossing edges are not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwise.functions import geometry as geo
from ductwise.functions import reference as ref
from ductwise.sources import collection

# Fixed values of the input format: allowed geometries and required attributes of each object type.
_AREA, _ANY = ("Polygon", "MultiPolygon"), ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
TYPES = {
    "source": (("Point",), {}),
    "heat_network": (("LineString",), {"diameter": "int"}),
    "heat_chamber": (("Point",), {}),
    "oks_connection_point": (("Point",), {}),
    "oks_future": (_AREA, {"flow_tph": "number"}),
    "oks_existing": (_AREA, {}),
    "restriction": (_ANY, {"restriction_type": "string"}),
}
_FEATURE = "struct<id variant, properties variant, geometry struct<type string, coordinates string>>"
_LINE = "array<array<double>>"
_NUMBER = "^(BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL)"


def scan(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """(seq, feature) of a FeatureCollection, or of files with a feature on each line, which Spark splits between tasks.

    With `split` one FeatureCollection, too, is read by many tasks; seq then rises in the order of the document, but not by ones.
    The schema is given, never inferred: ids may be numbers and strings in one file.
    """
    if split:
        rows = collection.features(spark, path).withColumn("feature", F.from_json("text", _FEATURE.replace("struct<id", "struct<type string, id", 1)))
        # a split holds fewer features than bytes, so its place in the file plus the number in it never repeats
        return rows.where("feature.type = 'Feature'").select((F.col("block") + F.col("number")).alias("seq"), F.col("feature").dropFields("type").alias("feature"))
    if lines:
        rows = spark.read.schema(_FEATURE.removeprefix("struct<").removesuffix(">")).json(path)
        return rows.select(F.monotonically_increasing_id().alias("seq"), F.struct("id", "properties", "geometry").alias("feature"))
    rows = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("features").alias("seq", "feature")).withColumn("seq", F.col("seq").cast("long"))


def file_issue(spark: SparkSession, path: str) -> DataFrame:
    """One row (code) for a file that is no FeatureCollection or holds no features; none for a good file."""
    rows = spark.read.schema(f"type string, features array<{_FEATURE}>").option("multiLine", True).json(path)
    code = F.when(F.col("type").isNull() & F.col("features").isNull(), "file.not_object").when(~F.col("type").eqNullSafe(F.lit("FeatureCollection")), "file.not_feature_collection").when(F.col("features").isNull(), "file.no_features")
    return rows.select(code.alias("code")).where("code is not null")


def attribute(name: str, kind: str) -> Column:
    """A property, or null if it is absent or of another JSON type: a number in a string is no number."""
    found = F.variant_get("props", f"$.{name}", "variant")
    text = F.schema_of_variant(found)
    if kind == "string":
        return F.when(text == "STRING", F.try_variant_get("props", f"$.{name}", "string"))
    return F.when(text.rlike(_NUMBER), F.try_variant_get("props", f"$.{name}", "double"))


def _text(props: str, name: str) -> Column:
    return F.try_variant_get(props, f"$.{name}", "string")


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def parts_of(kind: Column, coordinates: Column) -> Column:
    """Rings, lines or single points of any geometry; null if the coordinates do not fit the kind."""
    read = lambda schema: F.from_json(coordinates, schema)
    lines = lambda x: F.transform(x, _points)
    return (
        F.when(kind == "Point", lines(F.array(F.array(read("array<double>")))))
        .when(kind == "LineString", lines(F.array(read(_LINE))))
        .when(kind == "MultiPoint", F.transform(read(_LINE), lambda p: _points(F.array(p))))
        .when(kind.isin("Polygon", "MultiLineString"), lines(read(f"array<{_LINE}>")))
        .when(kind == "MultiPolygon", lines(F.flatten(read(f"array<array<{_LINE}>>"))))
    )


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """Polygons as arrays of rings, the outer one first; null for other geometry."""
    rings = lambda x: F.transform(x, _points)
    return F.when(kind == "Polygon", F.array(rings(F.from_json(coordinates, f"array<{_LINE}>")))).when(kind == "MultiPolygon", F.transform(F.from_json(coordinates, f"array<array<{_LINE}>>"), rings))


def _every_point(parts: Column, test) -> Column:
    return F.forall(parts, lambda line: F.forall(line, test))


def checked(features: DataFrame) -> DataFrame:
    """One row for each feature with `code`, the first check it fails, in their order; null if it passes all."""
    rows = features.select("seq", F.col("feature.properties").alias("props"), F.col("feature.id").alias("_id"), F.col("feature.geometry.type").alias("kind"), F.col("feature.geometry.coordinates").alias("_c"))
    fid = F.coalesce(F.nullif(_text("props", "id"), F.lit("")), F.nullif(F.try_variant_get("_id", "$", "string"), F.lit("")))
    number_id = F.schema_of_variant(F.coalesce(F.variant_get("props", "$.id", "variant"), F.col("_id"))).rlike(_NUMBER)
    rows = rows.withColumns({"fid": fid, "id_is_number": F.coalesce(number_id, F.lit(False)), "object_type": _text("props", "object_type"), "lonlat": parts_of(F.col("kind"), F.col("_c")), "polygons": polygons_of(F.col("kind"), F.col("_c"))})
    allowed, missing, wrong = F.lit(False), F.lit(False), F.lit(False)
    for name, (kinds, needs) in TYPES.items():
        own = F.col("object_type") == name
        allowed = allowed | (own & F.col("kind").isin(*kinds))
        for a, kind in needs.items():
            found = F.variant_get("props", f"$.{a}", "variant")
            absent = found.isNull() | (F.schema_of_variant(found) == "VOID")
            missing = missing | (own & absent)
            value = attribute(a, "number")
            fits = value.isNotNull() & (value == F.rint(value)) if kind == "int" else value.isNotNull() if kind == "number" else value.isNotNull() | attribute(a, "string").isNotNull()
            wrong = wrong | (own & ~absent & ~fits)
    ring = F.col("object_type").isin(*[t for t, (k, _) in TYPES.items() if k is _AREA]) | F.col("kind").isin(*_AREA)
    first_last = lambda r: (F.element_at(r, 1).x == F.element_at(r, -1).x) & (F.element_at(r, 1).y == F.element_at(r, -1).y)
    bad_ring = ring & F.exists("lonlat", lambda r: (F.size(r) < 4) | ~F.when(F.size(r) > 0, first_last(r)).otherwise(False) | (geo.ring_area(r) == 0))
    bad_line = F.col("kind").isin("LineString", "MultiLineString") & F.forall("lonlat", lambda x: geo.line_length(x) == 0)
    empty = F.col("kind").isNull() | (F.size("lonlat") == 0) | F.exists("lonlat", lambda x: F.size(x) == 0)
    code = (
        F.when(F.col("props").isNull(), "feature.no_properties")
        .when(F.col("fid").isNull(), "feature.no_id")
        .when(F.col("object_type").isNull() | ~F.col("object_type").isin(*TYPES), "feature.unknown_object_type")
        .when(F.col("kind").isNotNull() & (~F.col("kind").isin(*_ANY) | F.col("lonlat").isNull() | ~_every_point(F.col("lonlat"), lambda p: p.x.isNotNull() & p.y.isNotNull())), "feature.bad_geometry")
        .when(empty, "feature.no_geometry")
        .when(~allowed, "feature.geometry_type")
        .when(~_every_point(F.col("lonlat"), lambda p: p.x.between(-180, 180) & p.y.between(-90, 90)), "feature.coordinates_out_of_range")
        .when(missing, "feature.missing_attribute")
        .when(wrong, "feature.attribute_type")
        .when(attribute("flow_tph", "number") < 0, "feature.negative_flow")
        .when(bad_ring | bad_line, "feature.invalid_geometry")
    )
    return rows.withColumn("code", code).drop("_id", "_c")


def typed(rows: DataFrame) -> DataFrame:
    """Features that pass, with outlines of buildings re-typed, projected geometry, envelope, length and area."""
    restriction = F.when(F.col("object_type") == "restriction", _text("props", "restriction_type"))
    building = F.lower(restriction) == "oks"
    good = rows.where("code is null").withColumn("restriction_type", restriction)
    good = good.withColumns({"object_type": F.when(building, "oks_existing").otherwise(F.col("object_type")), "restriction_type": F.when(~building, F.col("restriction_type"))})
    xy = lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", geo.utm_forward(p.x, p.y), strict=True)])
    good = good.withColumn("parts", F.transform("lonlat", lambda line: F.transform(line, xy)))
    polygons = F.transform("polygons", lambda rings: F.transform(rings, lambda r: F.transform(r, xy)))
    over = lambda f, c: f(F.transform(F.flatten("parts"), lambda p: p[c]))
    lines, rings = F.col("kind").isin("LineString", "MultiLineString"), F.col("kind").isin(*_AREA)
    total = lambda f: F.aggregate(F.transform("parts", f), F.lit(0.0), lambda a, x: a + x)
    envelope = {"minx": over(F.array_min, "x"), "miny": over(F.array_min, "y"), "maxx": over(F.array_max, "x"), "maxy": over(F.array_max, "y")}
    return good.withColumns(envelope | {"length_m": F.when(lines, total(geo.line_length)), "area_m2": F.when(rings, geo.area_of(polygons))}).drop("code", "polygons")


def issues(rows: DataFrame) -> DataFrame:
    """(code, severity, feature_id, seq): failed checks, and remarks on features that pass; repeated ids as errors."""
    ref_id = F.coalesce("fid", F.concat(F.lit("#"), F.col("seq").cast("string")))
    failed = rows.where("code is not null").select("code", F.lit("ERROR").alias("severity"), ref_id.alias("feature_id"), "seq")
    good, kind = rows.where("code is null"), _text("props", "restriction_type")
    restriction = F.col("object_type") == "restriction"
    known = F.lower(kind).isin("oks") | kind.isin(*[r[0] for r in ref.RULES])
    remark = lambda test, code, severity: good.where(test).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("fid").alias("feature_id"), "seq")
    dn = attribute("diameter", "number")
    out = failed.unionByName(remark(restriction & (F.lower(kind) == "oks"), "restriction.building", "INFO"))
    out = out.unionByName(remark(restriction & ~known, "restriction.unknown_type", "WARNING"))
    out = out.unionByName(remark(F.col("object_type").isin("heat_network", "heat_chamber") & dn.isNotNull() & ~dn.isin(*[p[0] for p in ref.PIPES]), "network.nonstandard_dn", "WARNING"))
    again = good.groupBy("fid").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")
    return out.unionByName(again.select(F.lit("feature.duplicate_id").alias("code"), F.lit("ERROR").alias("severity"), F.col("fid").alias("feature_id"), "seq"))


def core_first(good: DataFrame) -> DataFrame:
    """Of network and consumer features with one id the first stays; obstacles all stay."""
    from pyspark.sql import Window as W

    core = ~F.col("object_type").isin("restriction", "oks_existing")
    r = F.row_number().over(W.partitionBy("fid", core).orderBy("seq"))
    return good.withColumn("_r", r).where(~core | (F.col("_r") == 1)).drop("_r")


def store(good: DataFrame, path: str) -> None:
    """The typed features as Parquet by object type, so that a scan of the core types reads only those."""
    good.withColumn("props", F.to_json("props")).write.partitionBy("object_type").parquet(path)


def overview(good: DataFrame) -> DataFrame:
    """(object_type, n, length, area) of a data set."""
    return good.groupBy("object_type").agg(F.count("*").alias("n"), F.round(F.sum("length_m"), 1).alias("length"), F.round(F.sum("area_m2"), 1).alias("area"))


def result_lines(rows: DataFrame, decimals: int = 8) -> DataFrame:
    """Result features as GeoJSON text, one to a row: (fid, object_type, variant_id, lonlat, attributes as a map of JSON text).

    Ids that are whole numbers without leading zeros become numbers again. Coordinates are rounded half up. Kinds: a line
    of several points, a point, or null for rows without geometry.
    """
    whole = F.col("fid").rlike("^(0|-?[1-9][0-9]{0,17})$")
    number = lambda x: ref.round_half_up(x, decimals).cast("decimal(20,8)").cast("double").cast("string")
    point = lambda p: F.concat(F.lit("["), number(p.x), F.lit(","), number(p.y), F.lit("]"))
    line = F.transform(F.element_at("lonlat", 1), point)
    geometry = F.when(F.col("lonlat").isNull(), "null").when(F.size(line) == 1, F.concat(F.lit('{"type":"Point","coordinates":'), F.element_at(line, 1), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(line, ","), F.lit("]}")))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    own = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit(',"'), e.key, F.lit('":'), F.coalesce(e.value, F.lit("null")))), "")
    properties = F.concat(F.lit('{"id":'), F.when(whole, F.col("fid")).otherwise(quoted(F.col("fid"))), F.lit(',"object_type":"'), F.col("object_type"), F.lit('","variant_id":'), F.col("variant_id").cast("string"), own, F.lit("}"))
    return rows.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))
