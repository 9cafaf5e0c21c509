"""Training of the attention network: gradients of district graphs, or of sampled batches
of large ones, are computed where the graphs are, and summed; the driver takes Adam steps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import batches, graph
from terrafold.operators.attention import SLOPE, Layer, Network, cross_entropy, forward, forward_numpy, smoothness_loss, weighted_loss
from terrafold.plans.lineage import cut, passing


@dataclass(frozen=True)
class TrainConfig:
    hidden: int = 64
    heads: int = 8
    layers: int = 3
    classes: int = 9
    epochs: int = 200
    patience: int = 100
    rate: float = 5e-4
    clip: float = 1.0
    lambda_smooth: float = 0.5
    temperature: float = 1.0
    seed: int = 42
    dropout: float = 0.6
    weight_decay: float = 5e-4
    min_delta: float = 1e-4
    fan_out: tuple[int, ...] = (15, 10)
    node_threshold: int = 2000
    batch_size: int = 1024
    graph_batches: int = 1
    accumulation: int = 1
    parallel_batches: int = 1
    checkpoint_interval: int = 50


def flat(net: Network) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in net.layers for p in (layer.weight, layer.source, layer.target, layer.bias)])


def unflat(net: Network, values: np.ndarray) -> Network:
    out, at = Network(), 0
    for layer in net.layers:
        parts = []
        for p in (layer.weight, layer.source, layer.target, layer.bias):
            parts.append(values[at : at + p.size].reshape(p.shape))
            at += p.size
        out.layers.append(Layer(*parts, layer.concat))
    return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def loss_and_gradient(
    net: Network, x: np.ndarray, edges: np.ndarray, distance: np.ndarray, y: np.ndarray, smooth: float = 0.0, temperature: float = 1.0, seeds: np.ndarray | None = None, masks: list[np.ndarray] | None = None
):
    """(loss, correct, gradient) of one graph: cross-entropy of the ``seeds`` (all
    nodes) plus ``smooth`` times the smoothness loss of all, backward through every
    layer; ``masks`` are those of dropout."""
    steps = forward_numpy(net, x, edges, masks)
    z, n = steps[-1]["z"], len(x)
    own = np.arange(n) if seeds is None else seeds
    lp = _log_softmax(z)
    loss = -lp[own, y[own]].mean()
    back = np.zeros_like(z)
    back[own] = (np.exp(lp[own]) - np.eye(z.shape[1])[y[own]]) / len(own)
    if smooth and len(edges):
        lt = _log_softmax(z / temperature)
        s, d = edges.T
        sim = np.exp(-distance / (distance.mean() + 1e-8)) / len(edges)
        p, q, diff = np.exp(lt[d]), np.exp(lt[s]), lt[d] - lt[s]
        kl = (p * diff).sum(1)
        loss += smooth * (kl * sim).sum()
        to_d = p * (diff - kl[:, None]) * sim[:, None] / temperature
        to_s = (q - p) * sim[:, None] / temperature
        np.add.at(back, d, smooth * to_d)
        np.add.at(back, s, smooth * to_s)
    grads = []
    for i in reversed(range(len(net.layers))):
        layer, st = net.layers[i], steps[i]
        if i < len(net.layers) - 1:
            back = back * np.where(st["y"] > 0, 1, np.exp(np.minimum(st["y"], 0)))
        heads, out = len(layer.weight), layer.weight.shape[2]
        g = back.reshape(n, heads, out).transpose(1, 0, 2) if layer.concat else np.repeat(back[None] / heads, heads, 0)
        src, dst, h, alpha, raw = (st[k] for k in ("src", "dst", "h", "alpha", "raw"))
        gh, gs, gt = np.zeros_like(h), np.zeros_like(layer.source), np.zeros_like(layer.target)
        for k in range(heads):
            np.add.at(gh[k], src, alpha[k, :, None] * g[k, dst])
            ga = (g[k, dst] * h[k, src]).sum(1)
            mean = np.zeros(n)
            np.add.at(mean, dst, alpha[k] * ga)
            ge = alpha[k] * (ga - mean[dst]) * np.where(raw[k] > 0, 1, SLOPE)
            es, et = np.zeros(n), np.zeros(n)
            np.add.at(es, src, ge)
            np.add.at(et, dst, ge)
            gh[k] += es[:, None] * layer.source[k] + et[:, None] * layer.target[k]
            gs[k], gt[k] = es @ h[k], et @ h[k]
        gw = np.einsum("ni,hno->hio", st["x"], gh, optimize=True)
        grads.append((gw, gs, gt, back.sum(0)))
        back = np.einsum("hno,hio->ni", gh, layer.weight, optimize=True)
        if masks is not None:
            back = back * masks[i]
    return loss, int((lp[own].argmax(1) == y[own]).sum()), np.concatenate([p.ravel() for layer in reversed(grads) for p in layer])


def dropped(net: Network, n: int, rate: float, rng: np.random.Generator) -> list[np.ndarray] | None:
    """Dropout masks of every layer's input, scaled so that means stay."""
    if not rate:
        return None
    return [(rng.random((n, layer.weight.shape[1])) >= rate) / (1 - rate) for layer in net.layers]


GRAPH = "district_id long, n long, loss double, correct long, gradient array<double>"


def _graph(key: tuple, rows: pd.DataFrame, links: pd.DataFrame, net: Network, config: TrainConfig, number: int, training: bool, seeded: bool) -> pd.DataFrame:
    """The row (columns GRAPH) of one graph or batch; none without nodes or seeds."""
    columns = ["district_id", "n", "loss", "correct", "gradient"]
    rows = rows.sort_values("building_id")
    # sums don't depend on the order in which edges arrive
    links = links.sort_values(["src", "dst", "distance"])
    ids, y = rows["building_id"].to_numpy(), rows["y"].to_numpy()
    seeds = np.flatnonzero(rows["is_seed"].to_numpy(bool)) if seeded else None
    if not len(ids) or (seeded and not len(seeds)):
        return pd.DataFrame(columns=columns)
    x = np.stack(rows["features"].to_list()).astype(float)
    e = np.stack([np.searchsorted(ids, links["src"]), np.searchsorted(ids, links["dst"])], 1) if len(links) else np.zeros((0, 2), int)
    rng = np.random.default_rng((config.seed, number, *(int(k) % 2**32 for k in key)))
    masks = dropped(net, len(x), config.dropout, rng) if training else None
    loss, correct, grad = loss_and_gradient(net, x, e, links["distance"].to_numpy(float), y, config.lambda_smooth, config.temperature, seeds, masks)
    if not np.isfinite(loss):
        raise ValueError(f"district {key[0]}: the loss is not finite")
    return pd.DataFrame([(key[0], len(x) if seeds is None else len(seeds), loss, correct, grad.tolist())], columns=columns)


def epoch(nodes: DataFrame, edges: DataFrame, net: Network, config: TrainConfig, number: int = 0, training: bool = True, by: tuple[str, ...] = ("district_id",)) -> DataFrame:
    """(district_id, n, loss, correct, gradient) of each graph, a group of ``by``.  Where
    nodes have ``is_seed``, the loss is that of the seeds, the smoothness that of all nodes."""
    seeded = "is_seed" in nodes.columns

    def run(key, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return _graph(key, rows, links, net, config, number, training, seeded)

    return nodes.groupBy(*by).cogroup(edges.groupBy(*by)).applyInPandas(run, GRAPH)


def batch_epoch(packed: DataFrame, net: Network, config: TrainConfig, number: int = 0) -> DataFrame:
    """``epoch`` of batches that are a row each, as ``batches.stepped`` writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, links = (pa.Table.from_struct_array(v).to_pandas() if (v := batch[c][i].values) is not None else pd.DataFrame(columns=["src", "dst", "distance"]) for c in ("members", "links"))
                key = batch["district_id"][i].as_py(), batch["step"][i].as_py()
                yield pa.RecordBatch.from_pandas(_graph(key, rows, links, net, config, number, True, True), preserve_index=False)

    return packed.mapInArrow(run, GRAPH)


#: Rows of the model's size that the driver gets from an epoch.
SUMS = 8


def summed(graphs: DataFrame, few: bool = False) -> tuple[float, float, np.ndarray, int]:
    """(loss, accuracy, gradient, nodes) over all graphs, weighted by their nodes, in one
    action: each task adds its graphs up, SUMS tasks add these up, the driver the rest.
    Where the graphs are ``few``, no more than SUMS, the driver gets them at once."""
    schema = "n long, loss double, correct long, gradient array<double>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss, correct, gradient = 0, 0.0, 0, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = np.asarray(row.gradient, float) * row.n
                n, loss, correct = n + int(row.n), loss + row.loss * row.n, correct + int(row.correct)
                gradient = own if gradient is None else gradient + own
        if n:
            yield pd.DataFrame({"n": [n], "loss": [loss / n], "correct": [correct], "gradient": [gradient / n]})

    partial = graphs.select("n", "loss", "correct", "gradient").mapInPandas(add, schema)
    rows = (graphs.select("n", "loss", "correct", "gradient") if few else partial.repartition(SUMS).mapInPandas(add, schema)).collect()
    n = sum(r["n"] for r in rows)
    if not n:
        raise ValueError("there are no graphs to train on")
    gradient = sum(np.array(r["gradient"]) * (r["n"] / n) for r in rows)
    return sum(r["loss"] * r["n"] for r in rows) / n, sum(r["correct"] for r in rows) / n, gradient, n


def evaluate(nodes: DataFrame, edges: DataFrame, net: Network, config: TrainConfig) -> tuple[float, float]:
    """(loss, accuracy) of whole graphs, without dropout.  Districts over
    ``node_threshold`` nodes go through the network by joins, the others a task each."""
    return _evaluated(_by_size(nodes, edges, config), net, config)


def _evaluated(parts: tuple[tuple[DataFrame, DataFrame] | None, Large | None], net: Network, config: TrainConfig) -> tuple[float, float]:
    (small, large), found = parts, []
    if small is not None:
        loss, accuracy, _, n = summed(epoch(*small, net, config, training=False))
        found.append((n, loss, accuracy))
    if large is not None:
        found.append(_evaluated_by_joins(large.nodes, large.edges, net, config))
    n, loss, accuracy = zip(*found, strict=True)
    return float(np.average(loss, weights=n)), float(np.average(accuracy, weights=n))


def _evaluated_by_joins(nodes: DataFrame, edges: DataFrame, net: Network, config: TrainConfig) -> tuple[int, float, float]:
    """(nodes, loss, accuracy) of districts of any size."""
    key = ["district_id", "building_id"]
    out = cut(forward(nodes, edges, net).join(nodes.select(*key, "y"), key))
    smooth = smoothness_loss(out, edges, config.temperature).withColumnRenamed("loss", "smooth")
    each = cross_entropy(out).join(smooth, "district_id").withColumn("loss", F.col("loss") + config.lambda_smooth * F.col("smooth"))
    hits = out.agg(F.count("*").alias("n"), F.avg((F.col("gat_label") == F.col("y")).cast("double")).alias("accuracy")).first()
    return hits["n"], weighted_loss(each).first()["loss"], hits["accuracy"]


@dataclass(frozen=True)
class Large:
    """Districts that are trained in sampled batches: ``steps`` numbers all batches."""

    nodes: DataFrame
    edges: DataFrame
    plan: DataFrame
    steps: DataFrame


def _by_size(nodes: DataFrame, edges: DataFrame, config: TrainConfig) -> tuple[tuple[DataFrame, DataFrame] | None, Large | None]:
    """The districts that are taken whole, and those over ``node_threshold`` nodes."""
    sizes = cut(graph.sampling_plan(nodes, config.node_threshold, config.batch_size))
    whole = sizes.where("is_full").limit(1).count() > 0
    plan = sizes.where("not is_full")
    if not plan.limit(1).count():
        if not whole:
            raise ValueError("there are no graphs to train on")
        return (nodes, edges), None
    own = lambda df, how: cut(df.join(plan.select("district_id"), "district_id", how))
    large = Large(own(nodes, "left_semi"), own(edges, "left_semi"), plan, cut(batches.numbered_batches(plan)))
    return (own(nodes, "left_anti"), own(edges, "left_anti")) if whole else None, large


class EarlyStopping:
    """Stops after ``patience`` values without gain; ``best`` is the best so far."""

    def __init__(self, patience: int, mode: str = "min", gain: float = 0.0):
        if mode not in ("min", "max"):
            raise ValueError("mode is min or max")
        self.patience, self.sign, self.gain = patience, 1 if mode == "min" else -1, gain
        self.best, self.bad = None, 0

    def is_better(self, value: float) -> bool:
        return self.best is None or self.sign * value < self.sign * self.best - self.gain

    def __call__(self, value: float) -> bool:
        if self.is_better(value):
            self.best, self.bad = value, 0
        else:
            self.bad += 1
        return self.bad >= self.patience


def _stepped(state: dict, gradient: np.ndarray, config: TrainConfig) -> None:
    """One Adam step, with weight decay and a clipped norm."""
    gradient = gradient + config.weight_decay * state["params"]
    gradient = gradient * min(1.0, config.clip / (np.linalg.norm(gradient) + 1e-12))
    state["steps"] += 1
    at = state["steps"]
    state["m"] = 0.9 * state["m"] + 0.1 * gradient
    state["v"] = 0.999 * state["v"] + 0.001 * gradient**2
    state["params"] = state["params"] - state["rate"] * (state["m"] / (1 - 0.9**at)) / (np.sqrt(state["v"] / (1 - 0.999**at)) + 1e-8)


def _graphs_of_epoch(groups: list[tuple[DataFrame, DataFrame]], large: Large | None, net: Callable[[], Network], config: TrainConfig, at: int) -> Iterator[tuple[DataFrame, bool]]:
    """(graphs, few) of all that makes a gradient each, by the network of the moment: the
    groups of whole districts, then the sampled batches in another order each epoch."""
    for own, links in groups:
        yield epoch(own, links, net(), config, at), False
    if large is None:
        return
    packed = batches.stepped(large.nodes, large.edges, large.plan, large.steps, config.fan_out, config.seed, at)
    # the driver makes a step each, so it knows their numbers; a batch may have got no seed
    found = sorted(r["step"] for r in packed.select("step").collect())
    order = np.random.default_rng((config.seed, at)).permutation(found).tolist()
    for k in range(0, len(order), config.parallel_batches):
        taken = order[k : k + config.parallel_batches]
        yield batch_epoch(packed.where(F.col("step").isin(taken)), net(), config, at), len(taken) <= SUMS


def train(
    nodes: DataFrame,
    edges: DataFrame,
    config: TrainConfig,
    val: tuple[DataFrame, DataFrame] | None = None,
    start: dict | None = None,
    saved: Callable[[dict, bool], None] | None = None,
) -> dict:
    """Trains and returns a state: parameters, Adam moments, epoch, history.  A
    state given as ``start`` is continued at its next epoch.  Districts up to
    ``node_threshold`` nodes are taken whole, in ``graph_batches`` groups; larger ones in
    batches of about ``batch_size`` seeds that joins sample anew each epoch, ``parallel_batches``
    at a time.  Every ``accumulation`` of these their mean gradient makes a step.  ``saved``
    is called with the state and whether it is the best so far, each time it is and every
    ``checkpoint_interval`` epochs."""
    inputs = len(nodes.select("features").first()["features"])
    net = Network.random(inputs, config.hidden, config.classes, config.layers, config.heads, config.seed)
    state = start or {"params": flat(net), "m": 0.0, "v": 0.0, "epoch": 0, "rate": config.rate, "history": [], "best": None, "best_params": None}
    state.setdefault("steps", state["epoch"])
    stop, stale = EarlyStopping(config.patience, gain=config.min_delta), 0
    stop.best = state["best"]
    small, large = _by_size(nodes, edges, config)
    checks = None if val is None else _by_size(*val, config)
    of_group = lambda df, b: df if config.graph_batches == 1 else df.where(F.pmod(F.xxhash64("district_id"), F.lit(config.graph_batches)) == b)
    groups = [] if small is None else [tuple(of_group(df, b) for df in small) for b in range(config.graph_batches)]
    groups = [g for g in groups if config.graph_batches == 1 or g[0].limit(1).count()]
    for at in range(state["epoch"] + 1, config.epochs + 1):
        seen, kept = [], []
        with passing(nodes.sparkSession):
            for graphs, few in _graphs_of_epoch(groups, large, lambda: unflat(net, state["params"]), config, at):
                loss, accuracy, gradient, n = summed(graphs, few)
                seen.append((n, loss, accuracy))
                kept.append(gradient)
                if len(kept) == config.accumulation:
                    _stepped(state, sum(kept) / len(kept), config)
                    kept = []
        if kept:
            _stepped(state, sum(kept) / len(kept), config)
        sizes = [n for n, *_ in seen]
        loss, accuracy = (float(np.average([s[k] for s in seen], weights=sizes)) for k in (1, 2))
        state["epoch"] = at
        with passing(nodes.sparkSession):
            checked, checked_accuracy = (loss, accuracy) if checks is None else _evaluated(checks, unflat(net, state["params"]), config)
        state["history"].append({"epoch": at, "train_loss": loss, "train_accuracy": accuracy, "val_loss": checked, "val_accuracy": checked_accuracy, "lr": state["rate"]})
        better = stop.is_better(checked)
        if better:
            state["best"], state["best_params"], stale = checked, state["params"], 0
        else:
            stale += 1
            if stale >= max(1, config.patience // 2):
                state["rate"], stale = state["rate"] / 2, 0
        if saved is not None and (better or at % config.checkpoint_interval == 0):
            saved(state, better)
        if stop(checked):
            break
    state["network"] = unflat(net, state["best_params"])
    return state


def history_rows(spark: SparkSession, state: dict) -> DataFrame:
    """(epoch, split, metric, value)."""
    rows = [(h["epoch"], *(k.split("_") if "_" in k else ("all", k)), float(v)) for h in state["history"] for k, v in h.items() if k != "epoch"]
    return spark.createDataFrame(rows, "epoch int, split string, metric string, value double")


def write_history(spark: SparkSession, state: dict, path: str) -> None:
    """The history as JSON lines, an epoch each."""
    spark.createDataFrame([(json.dumps(h),) for h in state["history"]], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_checkpoint(spark: SparkSession, state: dict, scaler: DataFrame, config: TrainConfig, path: str) -> None:
    """Parameters, moments, settings and the scaler under one path."""
    kept = {k: v for k, v in state.items() if k in ("epoch", "steps", "rate", "best", "history")}
    arrays = [(k, np.broadcast_to(state[k], state["params"].shape).tolist()) for k in ("params", "m", "v", "best_params") if state.get(k) is not None]
    spark.createDataFrame(arrays, "name string, data array<double>").write.mode("overwrite").parquet(f"{path}/arrays")
    spark.createDataFrame([(json.dumps(kept), json.dumps(vars(config)))], "state string, config string").write.mode("overwrite").parquet(f"{path}/state")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[dict, TrainConfig, DataFrame]:
    """A saved state; what an older one lacks has its default."""
    row = spark.read.parquet(f"{path}/state").first()
    arrays = {r["name"]: np.array(r["data"]) for r in spark.read.parquet(f"{path}/arrays").collect()}
    absent = {"m": 0.0, "v": 0.0, "epoch": 0, "rate": TrainConfig().rate, "history": [], "best": None, "best_params": arrays["params"]}
    known = {f.name for f in fields(TrainConfig)}
    settings = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(row["config"]).items() if k in known}
    return absent | json.loads(row["state"]) | arrays, TrainConfig(**settings), spark.read.parquet(f"{path}/scaler")


def saved_network(spark: SparkSession, path: str, inputs: int) -> tuple[Network, DataFrame]:
    """The best network of a checkpoint, for so many features, and its scaler."""
    state, config, scaler = load_checkpoint(spark, path)
    shape = Network.random(inputs, config.hidden, config.classes, config.layers, config.heads)
    return unflat(shape, np.asarray(state["best_params"])), scaler
