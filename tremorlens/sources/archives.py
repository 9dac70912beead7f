"""Vendor archives: ZIPs of point shapefiles or GeoJSON layers.

Archives are opened once and become rows, one for each member; layers are then read member by
member, so one archive's layers spread over tasks.  GeoJSON is read by Spark's JSON functions,
shapefiles column by column: coordinates and attributes are strided views of their files, never a
loop over features.  What could not be read comes back as a frame of its own.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlens.functions.text import fold
from tremorlens.functions.web import first_present
from tremorlens.plans.joins import skew_join

# Fixed values of the two formats: file code, shape types that begin with x and y of one point, header sizes, field size, marks.
SHP_CODE, SHP_HEADER, POINT_TYPES = 9994, 100, (1, 11, 21)
DBF_HEADER, DBF_FIELD, DBF_END, DBF_DELETED = 32, 32, 0x0D, 0x2A
#: What a broken or encrypted member raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError, IndexError, OSError)

MEMBER_SCHEMA = "path string, package_sha string, name string, body binary, problem string"
LAYER_SCHEMA = "path string, package_sha string, layer string, idx bigint, lon double, lat double, properties map<string,string>, problem string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives with their hash and length; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content", "length", F.sha2("content", 256).alias("package_sha"))


def members(archives: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """One row for each member with one of the endings; an archive or member that cannot be read is a row with a problem."""
    import pyarrow as pa

    names = [part.split()[0] for part in MEMBER_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def bodies(content: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except UNREADABLE as error:
            yield None, None, type(error).__name__
            return
        for name in archive.namelist():
            if name.lower().endswith(endings):
                try:
                    yield name, archive.read(name), None
                except UNREADABLE as error:
                    yield name, None, type(error).__name__

    def run(batches):
        for batch in batches:
            for path, sha, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in bodies(content):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, sha, *found), kinds, strict=True)], names=names)

    return archives.select("path", "package_sha", "content").mapInArrow(run, MEMBER_SCHEMA)


def _records(shapes: bytes) -> np.ndarray:
    """Place of each record's content: one stride if all are alike, else by their lengths."""
    if len(shapes) < SHP_HEADER or int.from_bytes(shapes[:4], "big") != SHP_CODE:
        raise ValueError("no shapefile")
    rest = len(shapes) - SHP_HEADER
    if rest < 8:
        return np.zeros(0, dtype=np.int64)
    size = 2 * int.from_bytes(shapes[SHP_HEADER + 4 : SHP_HEADER + 8], "big")
    even = SHP_HEADER + 8 + np.arange(rest // (size + 8)) * (size + 8)
    lengths = np.frombuffer(shapes, dtype=np.uint8)[(even - 4)[:, None] + np.arange(4)].copy().view(">u4").ravel()
    if rest % (size + 8) == 0 and (2 * lengths == size).all():
        return even
    places, at = [], SHP_HEADER + 8
    while at <= len(shapes):
        size = 2 * int.from_bytes(shapes[at - 4 : at], "big")
        if at + size <= len(shapes):
            places.append(at)
        at += size + 8
    return np.array(places, dtype=np.int64)


def _view(data: bytes, places: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of one kind at many places."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8)[places[:, None] + np.arange(width)].copy().view(kind).ravel()


def shape_points(shapes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each record is a point, and its x and y."""
    places = _records(shapes)
    is_point = np.isin(_view(shapes, places, "<i4"), POINT_TYPES)
    x, y = np.full(len(places), np.nan), np.full(len(places), np.nan)
    x[is_point], y[is_point] = _view(shapes, places[is_point] + 4, "<f8"), _view(shapes, places[is_point] + 12, "<f8")
    return is_point, x, y


def attribute_columns(table: bytes, encoding: str) -> tuple[np.ndarray, dict[str, list[str]]]:
    """Whether each record is deleted, and the text of every field by column."""
    count, header, width = (int.from_bytes(table[a:b], "little") for a, b in ((4, 8), (8, 10), (10, 12)))
    fields = np.frombuffer(table[DBF_HEADER : table.index(DBF_END, DBF_HEADER)], dtype=np.uint8)
    fields = fields[: len(fields) // DBF_FIELD * DBF_FIELD].reshape(-1, DBF_FIELD)
    count = min(count, (len(table) - header) // width)
    rows = np.frombuffer(table, dtype=np.uint8, count=count * width, offset=header).reshape(count, width)
    ends = 1 + np.cumsum(fields[:, 16].astype(int))
    columns = {}
    for field, end in zip(fields, ends, strict=True):
        cells = np.ascontiguousarray(rows[:, end - field[16] : end])
        raw = cells.view(f"S{field[16]}").ravel().tolist() if field[16] else [b""] * count
        try:
            text = [cell.decode(encoding) for cell in raw]
        except (UnicodeDecodeError, LookupError):
            text = [cell.decode("latin-1") for cell in raw]
        columns[bytes(field[:11]).partition(b"\0")[0].decode("latin-1")] = [t.replace("\0", "").strip() for t in text]
    return rows[:, 0] == DBF_DELETED, columns


def _layers(found: DataFrame) -> DataFrame:
    """Shapefile layers as features: the files of a layer meet by their common name."""
    import pyarrow as pa

    stem = F.regexp_replace("name", r"\.[A-Za-z]+$", "")
    ending = F.lower(F.regexp_extract("name", r"\.([A-Za-z]+)$", 1))
    parts = found.filter("problem IS NULL").groupBy("path", "package_sha", stem.alias("stem")).agg(
        *[F.max_by("body", F.when(ending == e, F.col("name"))).alias(e) for e in ("shp", "dbf", "prj", "cpg")]
    ).filter("shp IS NOT NULL AND dbf IS NOT NULL")
    names = [part.split()[0] for part in LAYER_SCHEMA.replace("map<string,string>", "map").split(", ")]

    def decode(shapes, table, projection, code_page):
        if projection and not projection.decode("latin-1").lstrip().upper().startswith("GEOGCS"):
            raise ValueError("projected")
        is_point, x, y = shape_points(shapes)
        deleted, columns = attribute_columns(table, (code_page or b"").decode("ascii", "ignore").strip() or "utf-8")
        n = min(len(is_point), len(deleted))
        keep = np.flatnonzero(is_point[:n] & ~deleted[:n])
        pairs = [[(name, values[k]) for name, values in columns.items() if values[k]] for k in keep.tolist()]
        return x[keep], y[keep], pairs

    def run(batches):
        for batch in batches:
            for path, sha, stem_name, *files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    x, y, pairs = decode(*files)
                    n, problem = len(x), None
                except UNREADABLE as error:
                    x = y = [None]
                    n, pairs, problem = 1, [None], str(error) if str(error) == "projected" else type(error).__name__
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n, pa.string()), pa.array([sha] * n, pa.string()), pa.array([stem_name.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(range(n), pa.int64()),
                        pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(pairs, pa.map_(pa.string(), pa.string())), pa.array([problem] * n, pa.string()),
                    ],
                    names=names,
                )

    return parts.mapInArrow(run, LAYER_SCHEMA).withColumn("geometry_type", F.when(F.col("problem").isNull(), "Point"))


def _geojson(found: DataFrame) -> DataFrame:
    """GeoJSON layers as features, by Spark's JSON functions; a layer that is no JSON is a row with a problem."""
    file_name = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"(?i)\.geojson$", "")
    parsed = F.from_json(F.decode("body", "utf-8"), "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = found.filter("problem IS NULL").select("path", "package_sha", F.element_at(F.split(file_name, "_"), -1).alias("layer"), parsed.alias("p"))
    rows = read.select("path", "package_sha", "layer", F.col("p._corrupt").isNotNull().alias("broken"), F.posexplode_outer("p.features").alias("idx", "f")).filter("broken OR f IS NOT NULL")
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return rows.select(
        "path", "package_sha", "layer", F.col("idx").cast("bigint").alias("idx"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"),
        F.map_filter("f.properties", lambda _, v: v.isNotNull()).alias("properties"), F.when(F.col("broken"), "unreadable").alias("problem"), F.col("f.geometry.type").alias("geometry_type"),
    )


def unpack(archives: DataFrame, kind: str, fragment: str = "") -> tuple[DataFrame, DataFrame]:
    """S13 (``kind='shapefile'``) and S14 (``kind='geojson'``): features, and what could not be read.

    Features: path, package_sha, layer, idx, lon, lat, properties, geometry_type; only members whose name holds ``fragment`` count.
    Problems: path, package_sha, name (of the member or layer, if known), problem.
    """
    found = members(archives, (".geojson",) if kind == "geojson" else (".shp", ".dbf", ".prj", ".cpg"))
    found = found.filter(F.col("name").isNull() | F.contains("name", F.lit(fragment)))
    layers = _geojson(found) if kind == "geojson" else _layers(found)
    problems = found.filter("problem IS NOT NULL").select("path", "package_sha", "name", "problem").unionByName(
        layers.filter("problem IS NOT NULL").select("path", "package_sha", F.col("layer").alias("name"), "problem")
    )
    return layers.filter("problem IS NULL").drop("problem"), problems


def aliased(properties: Column, *names: str) -> Column:
    """First non-empty of the column names a vendor has used."""
    return first_present(*[F.try_element_at(properties, F.lit(n)) for n in names])


def vendor_points(features: DataFrame) -> DataFrame:
    """The damage attributes under one name, whatever the layer called them."""
    p = F.col("properties")
    return features.filter(F.col("geometry_type") == "Point").select(
        "package_sha", "layer", "idx", "lon", "lat", aliased(p, "SensorID", "Sensor_ID", "d_SensorID").alias("sensor"),
        aliased(p, "SensorDate").alias("sensor_date"), aliased(p, "Main_Dmg", "d_Main_Dam", "Main_Damag").alias("grade"),
        aliased(p, "Grouped_Da", "d_Grouped_").alias("grade_group"), aliased(p, "Confidence", "d_Confiden").alias("confidence"),
        aliased(p, "FieldValid", "d_FieldVal").alias("field_validation"), aliased(p, "EventCode").alias("event_code"), aliased(p, "Notes").alias("notes"),
    )


def graded_points(features: DataFrame, layer: str = "UrbanP") -> DataFrame:
    """Points of the damage layer."""
    p = F.col("properties")
    return features.filter((F.col("layer") == layer) & (F.col("geometry_type") == "Point")).select(
        "path", "package_sha", "layer", "idx", "lon", "lat", aliased(p, "DAMAGE").alias("grade"), aliased(p, "TYPE").alias("kind"),
        aliased(p, "SOURCE").alias("sensor"), aliased(p, "SRC_DATE").alias("sensor_date"), aliased(p, "PROCESSING").alias("method"),
        aliased(p, "COPYRIGHT").alias("copyright"),
    )


def analysed_area(features: DataFrame, layer: str = "AreaOfInterest") -> DataFrame:
    """The surface the vendor says it looked at, in square kilometres."""
    hectares = F.try_element_at(F.col("properties"), F.lit("AREA_HA")).try_cast("double")
    first = features.filter(F.col("layer") == layer).groupBy("package_sha").agg(F.min_by(hectares, "idx").alias("_ha"))
    return first.select("package_sha", F.round(F.col("_ha") / 100, 2).alias("area_km2"))


def _joined(text: Column) -> Column:
    return F.regexp_replace(fold(text), " ", "")


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")


def place_from_name(rows: DataFrame, name: str, pattern: str, places: DataFrame) -> DataFrame:
    """Place written in a file name: exact catalogue match, else the literal split apart.

    ``pattern``'s group 1 is the place; ``places``: municipality, department.
    """
    tail = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    catalogue = places.groupBy(_joined(F.col("municipality")).alias("_k")).agg(F.min(F.struct("municipality", "department")).alias("_p"))
    joined = skew_join(rows.withColumn("_tail", tail).withColumn("_k", _joined(F.col("_tail"))), catalogue, ["_k"], "left")
    known = F.col("_p").isNotNull() & F.col("_tail").isNotNull()
    return joined.withColumn("place", F.when(known, F.col("_p.municipality")).otherwise(split_camel(F.col("_tail")))).withColumn(
        "place_origin", F.when(F.col("_tail").isNull(), "unknown").when(known, "catalogue").otherwise("file_name")
    ).withColumn("_department", F.when(known, F.col("_p.department"))).drop("_k", "_tail", "_p")


def department_with_origin(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Department from the catalogue, else from a product title, with its origin.

    ``rows`` come from :func:`place_from_name`; ``titles``: title.
    """
    shape = r"(?i)\bin\s+(.+?)\s+Town,\s*(.+?)\s+Department\b"
    stated = titles.filter(F.col("title").rlike(shape)).select(
        _joined(F.regexp_extract("title", shape, 1)).alias("_k"), F.trim(F.regexp_extract("title", shape, 2)).alias("_stated")
    ).groupBy("_k").agg(F.max("_stated").alias("_stated"))
    joined = skew_join(rows.withColumn("_k", _joined(F.col("place"))), stated, ["_k"], "left")
    return joined.withColumn("department", F.coalesce("_department", "_stated")).withColumn(
        "department_origin", F.when(F.col("_department").isNotNull(), "catalogue").when(F.col("_stated").isNotNull(), "product_title")
    ).drop("_k", "_department", "_stated")
