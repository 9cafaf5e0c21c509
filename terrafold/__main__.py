"""Command line: extraction of district graphs, training, and inference.

python -m terrafold extract DISTRICTS BUILDINGS OUT
python -m terrafold train GRAPHS OUT [--config YAML] [--resume CHECKPOINT]
python -m terrafold infer GRAPHS CHECKPOINT OUT
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import logs
from terrafold.operators import features, graph, results, training
from terrafold.plans import pipeline
from terrafold.plans.lineage import cut
from terrafold.sources import settings, shapefile, tables

GRAPH_TABLES = ("buildings", "edges")


def parsed(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="terrafold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    modes = parser.add_subparsers(dest="mode", required=True)
    extract = modes.add_parser("extract")
    for name in ("districts", "buildings", "out"):
        extract.add_argument(name)
    extract.add_argument("--crs", default=None, help="where there is no .prj file")
    extract.add_argument("--resolution", type=float, default=1.0)
    extract.add_argument("--buffer", type=float, default=10.0)
    train = modes.add_parser("train")
    train.add_argument("graphs")
    train.add_argument("out")
    train.add_argument("--config", default=None)
    train.add_argument("--resume", default=None)
    train.add_argument("--epochs", type=int, default=None)
    train.add_argument("--train-ratio", type=float, default=0.8)
    infer = modes.add_parser("infer")
    for name in ("graphs", "checkpoint", "out"):
        infer.add_argument(name)
    for mode in (extract, train, infer):
        mode.add_argument("--logs", default=None, help="a folder on the driver")
    return parser.parse_args(args)


def run_extract(spark: SparkSession, given: argparse.Namespace, log: logging.Logger) -> None:
    shapefile.register(spark)

    def load(path: str, key: str) -> DataFrame:
        return tables.load_shapes(spark.read.format("shapefile").load(path), key, tables.crs_of(spark, path) or given.crs)

    out = pipeline.extract(load(given.districts, "district_id"), load(given.buildings, "building_id"), given.resolution, given.buffer)
    for name, rows in out.items():
        if name in ("failed", "missing", "rejected"):
            rows = cut(rows)
            if n := rows.count():
                log.warning("%s: %d", name, n)
            rows.write.mode("overwrite").parquet(f"{given.out}/{name}")
        elif name not in ("cells", "grids"):
            results.write_upsert(rows, f"{given.out}/{name}")
    results.export_raster(out["cells"], out["grids"], f"{given.out}/raster")


def graphs_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return pipeline.prepared({k: spark.read.parquet(f"{folder}/{k}") for k in GRAPH_TABLES})


def run_train(spark: SparkSession, given: argparse.Namespace, log: logging.Logger) -> dict:
    overrides = {} if given.epochs is None else {"epochs": given.epochs}
    config = settings.train_config(given.config, **overrides) if given.config else training.TrainConfig(**overrides)
    if given.logs:
        settings.backup(config, f"{given.logs}/config.json")
    nodes, edges = graphs_of(spark, given.graphs)
    scaler = cut(features.feature_stats(nodes))
    own, links = (cut(t) for t in pipeline.dataset(features.standardize(nodes, scaler), edges))
    # the split is by district, a row each
    parts = cut(graph.split(own.select("district_id").distinct(), "district_id", given.train_ratio))
    side = lambda df, keep: df.join(parts.where(F.col("is_train") == keep).select("district_id"), "district_id", "left_semi")
    one = parts.where("is_train").limit(1).count() == 0 or parts.where("not is_train").limit(1).count() == 0
    train, val = ((own, links), None) if one else ((side(own, True), side(links, True)), (side(own, False), side(links, False)))
    start = None
    if given.resume:
        start, _, _ = training.load_checkpoint(spark, given.resume)

    def saved(state: dict, best: bool) -> None:
        name = "best" if best else f"epoch_{state['epoch']}"
        training.save_checkpoint(spark, state, scaler, config, f"{given.out}/checkpoints/{name}")
        log.info("epoch %d: %s", state["epoch"], state["history"][-1])

    state = training.train(*train, config, val, start, saved)
    training.save_checkpoint(spark, state, scaler, config, f"{given.out}/checkpoints/last")
    training.write_history(spark, state, f"{given.out}/history")
    training.history_rows(spark, state).write.mode("overwrite").parquet(f"{given.out}/metrics")
    return state


def run_infer(spark: SparkSession, given: argparse.Namespace, log: logging.Logger) -> None:
    nodes, edges = graphs_of(spark, given.graphs)
    net, scaler = training.saved_network(spark, given.checkpoint, nodes.select(F.size("features").alias("n")).first()["n"])
    record = cut(pipeline.infer(nodes, edges, net, scaler))
    if n := record.where(F.col("error").isNotNull()).count():
        log.warning("nodes without a full result: %d", n)
    results.write_upsert(record, f"{given.out}/predictions")
    results.result_summary(record).write.mode("overwrite").parquet(f"{given.out}/summary")


def main(args: list[str] | None = None) -> None:
    given = parsed(args)
    log = logs.set_up(given.logs)
    spark = SparkSession.builder.appName("terrafold").getOrCreate()
    {"extract": run_extract, "train": run_train, "infer": run_infer}[given.mode](spark, given, log)


if __name__ == "__main__":
    main()
