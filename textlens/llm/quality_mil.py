"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage vector goes through a dense layer; a gated
attention network weighs the passages, and the weighted sum is scored. Only documents are
labelled: which passages matter is learned through the attention weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.batches import text_slices
from textlens.llm.common import held_out
from textlens.llm.labelled import training_sample
from textlens.llm.passages import WIDTH, encode_passages

SAMPLE_ROWS = 10_000
HIDDEN, GATE = 24, 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Weights of the encoder (w, b), the gated attention (v, u, a) and the scorer (c, d)."""

    centre: np.ndarray
    spread: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        sizes = np.diff(np.append(starts, len(x)))
        top = np.repeat(np.maximum.reduceat(e, starts), sizes)
        weight = np.exp(e - top)
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        bag = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        score = _sigmoid(bag @ p["c"] + p["d"][0])
        return {"z": z, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "score": score, "sizes": sizes}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, starts)
        out = (f["score"] - y) / len(y)
        over = np.repeat(out, f["sizes"])
        along = f["h"] @ p["c"]
        mean = np.repeat(f["bag"] @ p["c"], f["sizes"])
        de = over * f["weight"] * (along - mean)
        dtg = de[:, None] * p["a"]
        dt = dtg * f["g"] * (1 - f["t"] ** 2)
        dg = dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (over * f["weight"])[:, None] * p["c"] + dt @ p["v"].T + dg @ p["u"].T
        dz = dh * (1 - f["h"] ** 2)
        return {
            "w": f["z"].T @ dz, "b": dz.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["bag"].T @ out, "d": np.array([out.sum()]),
        }


def fit_attention(
    bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128,
    rate: float = 0.01, decay: float = 1e-4, seed: int = 3,
) -> AttentionModel:
    """Adam over the bags in a repeatable random order. No bags give a model that says 1/2."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    parts = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    if not bags:
        return AttentionModel(np.zeros(WIDTH), np.ones(WIDTH), {k: np.zeros(s) for k, s in shapes.items()})
    stacked = np.concatenate(bags)
    model = AttentionModel(stacked.mean(axis=0), stacked.std(axis=0) + 1e-3, parts)
    first = {k: np.zeros(s) for k, s in shapes.items()}
    second = {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.cumsum([0] + [len(bags[i]) for i in chosen[:-1]])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in model.gradients(x, starts, y[chosen]).items():
                g = g + decay * parts[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parts[k] -= now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = [x.tobytes() for x in encode_passages(batch["text"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch["y"]], ["x", "y"])


def train_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> AttentionModel:
    """Fit on about `sample_rows` labelled documents, encoded by the executors.

    The bound keeps the driver's share constant: passage vectors of that many documents.
    """
    sample = training_sample(docs, labels, label, sample_rows, id_col, text_col, longest=500 * 1024)
    rows = sample.mapInArrow(_encoded, "x binary, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))  # the same model however rows arrive
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit_attention(bags, np.array([r["y"] for r in rows], float))


def _scored(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bags = list(encode_passages(part["text"].to_pylist()))
            starts = np.cumsum([0] + [len(x) for x in bags[:-1]])
            scores = model.forward(np.concatenate(bags), starts)["score"]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, score` for every row: the probability of label 1, from the whole text alone.

    A null text is scored as an empty one, which is one passage without words. Null ids and
    repeated rows are kept; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_scored(model), f"id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document."""
    scored = score_quality(docs, train_quality(docs, labels, **options))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
