"""Loaders that settle ids, labels and geometry once, at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as G

#: Column names that may hold an id or a label, in order of preference.
ID_COLUMNS = ["FID", "OBJECTID", "ID", "id", "fid", "building_id", "district_id"]
LABEL_COLUMNS = ["label", "class", "category", "cluster", "type"]
NOT_FEATURES = ["fid", "OBJECTID", "id", "label", "geometry"]


def first_column(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def normal_id(df: DataFrame, position: str = "row_pos") -> Column:
    """The id column as a number; a text that is none by a stable hash; without an
    id (or NaN) the row's position + 1."""
    place = F.col(position).cast("long") + 1
    found = first_column(df, ID_COLUMNS)
    if found is None:
        return place
    value = F.col(f"`{found}`").cast("string")
    number = value.try_cast("double")
    text = F.when((F.trim(value) != "") & number.isNull(), text_id(value))
    return F.coalesce(F.when(~F.isnan(number), number.try_cast("long")), text, place)


def normal_label(df: DataFrame) -> Column:
    """The label column as a number, null for texts that are none."""
    found = first_column(df, LABEL_COLUMNS)
    if found is None:
        return F.lit(None).cast("int")
    number = F.col(f"`{found}`").cast("string").try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("int"))


def text_id(value: Column) -> Column:
    """A stable positive number for ids that are no numbers."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(2147483647))


def load_shapes(df: DataFrame, id_name: str, crs: str | None = None) -> DataFrame:
    """Canonical rows: id, geometry, box, label, row_pos; rows without a geometry
    stay, and a run lists them as failed.  ``crs`` other than None and EPSG:32650
    must be EPSG:4326, and is projected."""
    if "geometry" not in df.columns:
        raise ValueError("the table has no geometry")
    if crs not in (None, "EPSG:32650", "EPSG:4326"):
        raise ValueError(f"can't project from {crs}")
    shape = G.reproject(F.col("geometry")) if crs == "EPSG:4326" else F.col("geometry")
    out = df.select(normal_id(df).alias(id_name), shape.alias("geometry"), normal_label(df).alias("label"), "row_pos")
    return out.withColumn("box", F.when(F.size("geometry") > 0, G.bounds(F.col("geometry"))))


def crs_of(spark: SparkSession, path: str) -> str | None:
    """The reference system that the .prj file beside a shapefile names, None
    without one: EPSG:4326 for plain WGS 84, EPSG:32650 for its UTM zone 50 north."""
    found = spark.read.text(path.removesuffix(".shp") + ".prj", wholetext=True).first() if _exists(spark, path.removesuffix(".shp") + ".prj") else None
    if found is None:
        return None
    text = found["value"].upper().replace("_", " ")
    if "UTM ZONE 50N" in text:
        return "EPSG:32650"
    if text.lstrip().startswith("GEOGCS") and "WGS" in text and "84" in text:
        return "EPSG:4326"
    raise ValueError(f"can't project from {found['value'][:60]!r}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, where it has these columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df


def row_at(df: DataFrame, position: int) -> DataFrame:
    """The row of a position (from 0)."""
    return df.where(F.col("row_pos") == position)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def ordered_by_area(districts: DataFrame) -> DataFrame:
    """``district_id`` 0.. by ascending area, where the table has no id."""
    from terrafold.operators.spatial import numbered

    sized = districts.withColumn("area", G.area(F.col("geometry")))
    return numbered(sized.withColumn("_key", F.struct("area", "row_pos")), "_key", "district_id").drop("_key")


def with_attributes(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """District attributes on every row, except names that the rows have."""
    new = [c for c in attributes.columns if c not in rows.columns]
    return rows.join(attributes.select("district_id", *new), "district_id", "left")


def district_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Districts of files named ``district_<id>_...``; other names are ignored."""
    names = spark.read.format("binaryFile").load(folder).select("path")
    found = F.expr(r"try_cast(regexp_extract(path, 'district_(\\d+)_', 1) as bigint)")
    return names.select(found.alias("district_id")).where(F.col("district_id").isNotNull()).distinct().orderBy("district_id")
