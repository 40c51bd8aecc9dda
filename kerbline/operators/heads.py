"""Training of a two-layer multi-label head on embeddings: one pass per epoch, the best epoch kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import metrics as M
from kerbline.operators.clusters import dense_head

# --- fixed values: training settings ---
HIDDEN, EPOCHS, BATCH, RATE, DECAY, PATIENCE, DROPOUT = 512, 40, 512, 1e-3, 1e-4, 5, 0.3
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
# --- end of fixed values ---
#: Rows that one task holds and trains on by itself between two averages.
ROWS_PER_TASK = 16_384
#: Numbers of the state that are merged as one row.
BLOCK = 8_192


@dataclass
class State:
    """All weights as one vector, with the moments of the optimiser and its number of steps."""

    shape: tuple[int, int, int]
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def layers(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, h, o = self.shape
        a, b, c = np.cumsum([d * h, h, h * o])
        flat = self.weights if flat is None else flat
        return flat[:a].reshape(d, h), flat[a:b], flat[b:c].reshape(h, o), flat[c:]


@dataclass
class Trained:
    """The weights of the best epoch, its thresholds, and loss and validation macro-AP of every epoch."""

    hidden: tuple[np.ndarray, np.ndarray]
    output: tuple[np.ndarray, np.ndarray]
    best_epoch: int = 0
    thresholds: dict[str, float] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)


def fresh(dim: int, hidden: int, labels: int, seed: int) -> State:
    """Weights and biases uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    size = dim * hidden + hidden
    weights = np.concatenate([rng.uniform(-1, 1, size) / np.sqrt(max(dim, 1)), rng.uniform(-1, 1, hidden * labels + labels) / np.sqrt(hidden)])
    return State((dim, hidden, labels), weights, np.zeros_like(weights), np.zeros_like(weights))


def step(state: State, x: np.ndarray, y: np.ndarray, positive: np.ndarray, rate: float, decay: float, dropout: float, rng: np.random.Generator) -> float:
    """One AdamW step on a batch; the mean weighted cross-entropy before it."""
    w1, b1, w2, b2 = state.layers()
    before = x @ w1 + b1
    kept = (before > 0) * (rng.random(before.shape) >= dropout) / (1.0 - dropout)
    hidden = before * kept
    z = hidden @ w2 + b2
    p = 1.0 / (1.0 + np.exp(-z))
    loss = positive * y * np.logaddexp(0.0, -z) + (1.0 - y) * np.logaddexp(0.0, z)
    dz = (p * (positive * y + 1.0 - y) - positive * y) / y.size
    dh = (dz @ w2.T) * kept
    slope = np.concatenate([(x.T @ dh).ravel(), dh.sum(0), (hidden.T @ dz).ravel(), dz.sum(0)])
    state.steps += 1
    state.first = BETA1 * state.first + (1 - BETA1) * slope
    state.second = BETA2 * state.second + (1 - BETA2) * slope * slope
    size = np.sqrt(state.second / (1 - BETA2**state.steps)) + EPSILON
    state.weights = state.weights * (1 - rate * decay) - rate * state.first / (1 - BETA1**state.steps) / size
    return float(loss.mean())


def _epoch(dealt: DataFrame, state: State, epoch: int, seed: int, batch: int, positive: np.ndarray, rate: float, decay: float, dropout: float) -> tuple[State, float]:
    """Every task goes through its rows from the same state; the outcomes are averaged by rows, block by block."""
    shipped = dealt.sparkSession.sparkContext.broadcast(state)

    def train(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        x, y = (np.stack(table.column(c).to_numpy(zero_copy_only=False)).astype(np.float64) for c in ("v", "y"))
        start = shipped.value
        own = State(start.shape, start.weights, start.first, start.second, start.steps)
        rng = np.random.default_rng((seed, epoch, table.column("deal")[0].as_py()))
        order, losses = rng.permutation(len(x)), []
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            losses.append(step(own, x[at], y[at], positive, rate, decay, dropout, rng))
        flat = np.concatenate([own.weights, own.first, own.second, [own.steps, np.mean(losses)]]) * len(x)
        blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "n": pa.array([len(x)] * len(blocks), pa.int64()), "part": pa.array(blocks, pa.list_(pa.float64()))})

    merged = dealt.mapInArrow(train, "block int, n long, part array<double>").groupBy("block")
    rows = merged.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")).orderBy("block").collect()  # the size of the head
    flat = np.concatenate([np.array(r["part"]) / r["n"] for r in rows])
    size = len(state.weights)
    return State(state.shape, flat[:size], flat[size : 2 * size], flat[2 * size : 3 * size], float(flat[-2])), float(flat[-1])


def _macro_ap(scored: DataFrame, labels: Sequence[str]) -> float:
    """Mean average precision over the labels that have both classes."""
    per = M.multilabel_per_label(scored.select(F.lit("val").alias("part"), *[f"{a}_{x}" for x in labels for a in "yp"]), {x: 0.5 for x in labels}, "part")
    return per.where("part = 'val'").agg(F.avg("ap")).first()[0] or 0.0


def train_heads(
    df: DataFrame, labels: Sequence[str], train: Column, val: Column, vector: str = "embedding", hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH,
    rate: float = RATE, decay: float = DECAY, patience: int = PATIENCE, dropout: float = DROPOUT, seed: int = 42,
) -> tuple[DataFrame, Trained]:
    """Linear, ReLU, dropout, linear for all labels `y_<label>` together; (all rows with `p_<label>`, what was trained).

    Positives are weighted by the negative-to-positive ratio of the train rows. Train rows are
    dealt once into tasks by their content. An epoch is one pass: each task runs AdamW over
    shuffled batches of its own rows from the common state, and weights and moments are
    averaged by rows; up to ROWS_PER_TASK rows that is plain mini-batch training.
    After each epoch the validation rows are scored; the weights of the first epoch with the
    highest macro average precision are kept, and training ends after `patience` epochs
    without a higher one. Thresholds are searched on the validation rows with the kept weights.
    """
    weights = {r["label"]: r["pos_weight"] for r in M.positive_weights(df.where(train), labels).collect()}
    rows = df.where(train).select(F.col(vector).cast("array<float>").alias("v"), F.array(*[F.col(f"y_{x}").cast("float") for x in labels]).alias("y"))
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not size[0] or df.where(val).isEmpty():
        raise ValueError("training needs train and validation rows")
    tasks = -(-size[0] // ROWS_PER_TASK)
    place = F.xxhash64("v", "y")
    dealt = rows.withColumn("deal", F.pmod(place, F.lit(tasks)).cast("int")).repartitionById(tasks, "deal").sortWithinPartitions("deal", place, "v").persist()
    held = df.where(val).select(vector, *[f"y_{x}" for x in labels]).persist()
    positive = np.array([float(weights[x]) for x in labels])
    state = fresh(size[1], hidden, len(labels), seed)
    best, history = (-1.0, 0, state), []
    for epoch in range(1, epochs + 1):
        state, loss = _epoch(dealt, state, epoch, seed, batch, positive, rate, decay, dropout)
        w1, b1, w2, b2 = state.layers()
        ap = _macro_ap(dense_head(held, (w1, b1), (w2, b2), labels, vector), labels)
        history.append({"epoch": epoch, "loss": loss, "val_macro_ap": ap})
        if ap > best[0]:
            best = (ap, epoch, state)
        elif epoch - best[1] >= patience:
            break
    w1, b1, w2, b2 = best[2].layers()
    scored = M.label_rows(dense_head(held, (w1, b1), (w2, b2), labels, vector), {x: 0.5 for x in labels}, [])
    found = M.threshold_search(scored, ["label"], F.col("y"), F.col("p"))
    thresholds = {r["label"]: r["threshold"] for r in found.collect()}
    dealt.unpersist()
    held.unpersist()
    return dense_head(df, (w1, b1), (w2, b2), labels, vector), Trained((w1, b1), (w2, b2), best[1], thresholds, history)
