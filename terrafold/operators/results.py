"""Keyed results: upsert, resume, summaries, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str = "district_id") -> DataFrame:
    """``existing`` without the keys of ``new``, and then ``new``."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(new, allowMissingColumns=True)


def write_upsert(new: DataFrame, path: str, key: str = "district_id") -> None:
    """The same on disk: only partitions of the new keys are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def pending(todo: DataFrame, done: DataFrame, key: str = "district_id") -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def with_predictions(buildings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions on building rows, null where there are none."""
    return buildings.join(predictions.select("district_id", "building_id", F.col("gat_label").cast("long"), F.col("spectral_cluster").cast("long")), ["district_id", "building_id"], "left")


def result_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("total_rows"), F.count_distinct("district_id").alias("districts"), F.count_distinct("gat_label").alias("labels"), F.count_distinct("spectral_cluster").alias("clusters")
    )


def run_summary(records: DataFrame) -> DataFrame:
    """Of records with district_id, num_nodes, embedding_dim."""
    return records.agg(F.count_distinct("district_id").alias("districts"), F.coalesce(F.sum("num_nodes"), F.lit(0)).alias("total_nodes"), F.max("embedding_dim").alias("embedding_dim"))


def export_cells(cells: DataFrame, path: str) -> None:
    """Raster cells by district, replacing only the districts given."""
    write_upsert(cells, path)


def export_matrix(edges: DataFrame, path: str) -> None:
    """One district's edges as a square CSV matrix, 0 where there is no edge: a line
    a building, ordered, of any number of buildings."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    names = ids.agg(F.array_sort(F.collect_list("id")).alias("ids"))  # one district's ids
    rows = edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "distance"))).alias("to"))
    cell = lambda i: F.coalesce(F.element_at("to", i), F.lit(0.0)).cast("string")
    own = ids.join(rows, F.col("id") == F.col("src"), "left").join(F.broadcast(names))
    line = F.concat_ws(",", F.col("id").cast("string"), F.when(F.col("to").isNull(), F.transform("ids", lambda i: F.lit("0.0"))).otherwise(F.transform("ids", cell)))
    head = names.select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("src,"), F.array_join(F.col("ids").cast("array<string>"), ",")).alias("value"))
    own.select("id", line.alias("value")).unionByName(head).orderBy(F.asc_nulls_first("id")).select("value").write.mode("overwrite").text(path)


def missing(wanted: DataFrame, found: DataFrame, key: str = "district_id") -> DataFrame:
    """(key) of what was asked for and isn't there."""
    return wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def export_raster(cells: DataFrame, grids: DataFrame, path: str, crs: str = "EPSG:32650", nodata: int = -999) -> None:
    """Raster cells by district, and beside them a row a district with the transform
    from cells to places, the size, the reference system and the value of no data."""
    write_upsert(cells, f"{path}/cells")
    g = F.col("grid")
    transform = F.array(g["xres"], F.lit(0.0), g["x0"], F.lit(0.0), -g["yres"], g["y1"])
    about = grids.select("district_id", transform.alias("transform"), g["width"].alias("width"), g["height"].alias("height"), F.lit(crs).alias("crs"), F.lit(nodata).alias("nodata"))
    write_upsert(about, f"{path}/about")


def prediction_record(nodes: DataFrame, forward: DataFrame, labels: DataFrame) -> DataFrame:
    """(district_id, building_id, original_label, embedding, logits, gat_label,
    spectral_cluster, final_label, error): all that inference knows of a node."""
    key = ["district_id", "building_id"]
    original = F.col("label").cast("long") if "label" in nodes.columns else F.lit(None).cast("long")
    return (
        nodes.select(*key, original.alias("original_label"))
        .join(forward.select(*key, "embedding", "logits"), key, "left")
        .join(labels.select(*key, "gat_label", "spectral_cluster", "final_label", "error"), key, "left")
    )


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
