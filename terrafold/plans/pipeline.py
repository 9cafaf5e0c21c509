"""The two runs: extraction of district graphs, and inference over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import adjacency, attention, features, graph, raster, results, similarity, spatial
from terrafold.plans.lineage import cut


def extract(districts: DataFrame, buildings: DataFrame, resolution: float = 1.0, buffer: float = 10.0, rounds: int = raster.ROUNDS) -> dict[str, DataFrame]:
    """Cells, regions and edges of districts (district_id, geometry) and buildings
    (building_id, geometry, row_pos).  Shapes that can't be taken are left out and listed
    in ``failed`` (district_id, building_id, error), so that they don't end the run;
    other shapes are repaired first.  ``missing`` has the districts without any cell."""
    bad_districts, bad_buildings = cut(spatial.faulty(districts, "district_id")), cut(spatial.faulty(buildings, "building_id"))
    none = F.lit(None).cast("long")
    failed = bad_districts.withColumn("building_id", none).select("district_id", "building_id", "error").unionByName(bad_buildings.withColumn("district_id", none).select("district_id", "building_id", "error"))
    wanted = districts
    sound = lambda df, bad, key: df.join(bad.select(key), key, "left_anti").where(F.size("geometry") > 0).withColumn("geometry", spatial.repair("geometry")).where(F.col("geometry").isNotNull())
    districts, buildings = cut(sound(districts, bad_districts, "district_id")), cut(sound(buildings, bad_buildings, "building_id"))
    clipped = cut(spatial.clip_to_districts(buildings, districts).join(buildings.select("building_id", F.col("row_pos").alias("position"), *(["label"] if "label" in buildings.columns else [])), "building_id"))
    gridded = districts.select("district_id", "geometry", raster.grid(G.bounds(F.col("geometry")), resolution, buffer).alias("grid"))
    cells = cut(raster.grow(raster.burn(clipped, gridded), rounds))
    edges = adjacency.adjacency_edges(adjacency.touching_regions(cells), clipped)
    return {
        "buildings": clipped,
        "cells": cells,
        "grids": gridded.select("district_id", "grid"),
        "regions": raster.region_areas(cells, resolution**2),
        "polygons": raster.placed(raster.region_polygons(cells), gridded),
        "edges": edges,
        "rejected": raster.rejected_ids(buildings),
        "failed": failed,
        "missing": results.missing(wanted, cells),
    }


def infer(nodes: DataFrame, edges: DataFrame, net: attention.Network, scaler: DataFrame, scale: float = 100.0) -> DataFrame:
    """(district_id, building_id, original_label, embedding, logits, gat_label,
    spectral_cluster, final_label, error) for nodes with raw features and edges with
    distances.  Nodes whose features aren't numbers have an error and no result."""
    size = scaler.count()
    right = F.col("features").isNotNull() & (F.size("features") == size) & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v))
    checked = nodes.withColumn("right", F.coalesce(right, F.lit(False)))
    bad = checked.where(~F.col("right")).select("district_id", "building_id", F.lit("features aren't numbers").alias("fault"))
    everything, nodes = nodes, checked.where("right").drop("right")
    edges = edges.join(bad.withColumnRenamed("building_id", "src"), ["district_id", "src"], "left_anti").join(bad.withColumnRenamed("building_id", "dst"), ["district_id", "dst"], "left_anti")
    linked = edges.where(F.col("distance") > 0)
    scaled = cut(features.standardize(nodes, scaler))
    out = cut(attention.forward(scaled, linked, net))
    labels = out.select("district_id", "building_id", "gat_label")
    pairs = similarity.pairwise_cosine(out.select("district_id", "building_id", F.col("embedding").alias("features")))
    clusters = similarity.spectral_clusters(similarity.affinity(pairs, linked, labels, scale))
    voted = similarity.voted_labels(labels.join(clusters, ["district_id", "building_id"], "left"))
    record = results.prediction_record(everything, out, voted)
    return record.join(bad, ["district_id", "building_id"], "left").withColumn("error", F.coalesce("fault", "error")).drop("fault")


def dataset(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs ready for training: indexed, labelled nodes and their edges."""
    own = graph.indexed_nodes(graph.labelled_nodes(nodes))
    return own, graph.indexed_edges(edges.where((F.col("distance") > 1e-6) & (F.col("src") != F.col("dst"))), own)


def prepared(extracted: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (with features and labels) and edges of an extraction, as tables read back."""
    buildings = extracted["buildings"]
    vectors = features.feature_vectors(features.building_features(buildings))
    if "label" in buildings.columns:
        vectors = vectors.join(buildings.select("district_id", "building_id", "label"), ["district_id", "building_id"], "left")
    return vectors, extracted["edges"]
