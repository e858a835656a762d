"""Fitting linear models on an objective of one's own by distributed gradients.

The design table holds a row's features as index and value arrays, its targets, its weight and
its fold. A fit packs its rows once into blocks of some 100 kB, whose arrays are bytes, so that a
scan costs Spark and Arrow no work for each number. A step is one scan of the blocks: every task
adds up loss and gradient of its rows at the points it was sent, and the sums are added in
Spark, part by part of the gradient, in a tree. The driver holds points and sums, whose size is
that of the model, never rows.

Several models share a scan. Each is an optimiser of its own (limited-memory BFGS) that says where
it wants loss and gradient next, and none of them sees what the others do, so a model fitted
together with others is the one it would be alone. `Heads` are models with features of their
own weights: objectives, labels, regularisations, and folds to leave out. `Shared` is one model
whose binary head and label heads look at the same few learned directions of the features, so
that the label objective shapes what the binary head sees.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.hashing import seeded_uniform
from textlens.session import stored

#: Coordinates of a gradient that travel together.
BLOCK = 1 << 14
#: Partitions whose sums one task of the tree adds.
FAN_IN = 64
#: Features of the rows that are packed together, unless one row has more; and their number.
PACK_VALUES = 1 << 16
PACK_ROWS = 1 << 12


# --- the table -----------------------------------------------------------------------


def hashed_fold(folds: int, seed: int = 42, key: str = "id") -> Column:
    """The fold of a row, from 0, by a hash of its key."""
    return F.floor(seeded_uniform("fold", seed, F.col(key)) * folds).cast("int")


def features_of(vector: str | Column) -> list[Column]:
    """`ix, val` of an MLlib vector column, without zeros if the vector is sparse."""
    return _features(F.unwrap_udt(vector))


def _features(v: Column) -> list[Column]:
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return [F.coalesce(v["indices"], every).alias("ix"), v["values"].alias("val")]


def design_rows(
    rows: DataFrame,
    vector: str | Column,
    targets: Column,
    weight: Column | None = None,
    fold: Column | None = None,
    key: str = "id",
) -> DataFrame:
    """The rows that fits read: `id, ix, val, targets, weight, fold`.

    Rows without a key, a vector or a target (null, or null inside) take no part.
    """
    # Generated, because a filter on a plain column would make each vector once more for each mention of it.
    once = F.explode(F.array(F.unwrap_udt(vector))).alias("_vector")
    given = rows.select(
        F.col(key).alias("id"),
        once,
        targets.cast("array<double>").alias("targets"),
        F.coalesce(F.lit(1.0) if weight is None else weight.cast("double"), F.lit(0.0)).alias("weight"),
        (F.lit(-1) if fold is None else fold.cast("int")).alias("fold"),
    )
    table = given.select("id", *_features(F.col("_vector")), "targets", "weight", "fold")
    whole = F.col("id").isNotNull() & F.col("ix").isNotNull() & F.col("targets").isNotNull()
    return table.where(whole & ~F.exists("targets", lambda t: t.isNull() | F.isnan(t)))


def design(
    rows: DataFrame,
    vector: str | Column,
    targets: Column,
    weight: Column | None = None,
    fold: Column | None = None,
    key: str = "id",
) -> DataFrame:
    """The stored table of `design_rows`, for rows that are fitted and read by themselves."""
    return stored(design_rows(rows, vector, targets, weight, fold, key), "design")


_PACKED = "ends binary, cols binary, at binary, val binary, targets binary, weight binary, fold binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in _PACKED.split(", ")]
    for batch in batches:
        lists, n = batch["ix"], batch.num_rows
        if not n:
            continue
        ends = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        ix, val = lists.flatten().to_numpy(), batch["val"].flatten().to_numpy()
        targets = batch["targets"].flatten().to_numpy().reshape(n, -1)
        weight, fold = batch["weight"].to_numpy(), batch["fold"].to_numpy()
        start = 0
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + PACK_VALUES, "right")) - 1
            stop = max(start + 1, min(stop, start + PACK_ROWS, n))
            part, values = slice(start, stop), slice(ends[start], ends[stop])
            cols, at = np.unique(ix[values], return_inverse=True)
            arrays = (
                (ends[start + 1 : stop + 1] - ends[start]).astype(np.int32),
                cols.astype(np.int32),
                at.astype(np.uint16 if len(cols) <= 1 << 16 else np.int32),
                val[values],
                targets[part],
                weight[part],
                fold[part],
            )
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names)
            start = stop


def _is_packed(table: DataFrame) -> bool:
    return "cols" in table.columns


def _blocks(table: DataFrame) -> DataFrame:
    if _is_packed(table):
        return table
    return table.select("ix", "val", "targets", "weight", "fold").mapInArrow(_pack, _PACKED)


def packed(table: DataFrame) -> DataFrame:
    """The stored blocks of a table of `design_rows`; blocks stay as they are."""
    return table if _is_packed(table) else stored(_blocks(table), "design-blocks")


class Block:
    """Packed rows as arrays. `cols` are the features that occur, `at` their places in it."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        of = lambda name, kind: np.frombuffer(batch[name][i].as_buffer(), kind)
        ends, self.cols, self.val = of("ends", np.int32), of("cols", np.int32).astype(np.intp), of("val", np.float64)
        self.n = len(ends)
        self.at = of("at", np.uint16 if len(self.cols) <= 1 << 16 else np.int32).astype(np.intp)
        self.sizes = np.diff(ends, prepend=0)
        self.filled = np.flatnonzero(self.sizes)
        self.starts = (ends - self.sizes)[self.filled]
        self.weight, self.fold = of("weight", np.float64), of("fold", np.int32)
        self.targets = of("targets", np.float64).reshape(self.n, -1)

    def dots(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(self.val * weights[self.cols][self.at], self.starts)
        return out

    def add_to(self, gradient: np.ndarray, per_row: np.ndarray) -> None:
        """Adds the gradient of `dots` against a number for each row."""
        gradient[self.cols] += np.bincount(self.at, self.val * np.repeat(per_row, self.sizes), len(self.cols))


class Rows:
    """A batch of rows with features as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch["ix"]
        self.n = batch.num_rows
        self.ix = lists.flatten().to_numpy()
        self.val = batch["val"].flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))

    def dots(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * weights[self.ix], self.n)


# --- objectives ----------------------------------------------------------------------


def loss_and_slope(logit: np.ndarray, target: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Focal loss of each row and its derivative by the logit; cross-entropy at gamma 0."""
    small = np.exp(-np.abs(logit))
    p = np.where(logit >= 0, 1.0, small) / (1.0 + small)
    loss = np.maximum(logit, 0.0) - logit * target + np.log1p(small)
    if gamma == 0:
        return loss, p - target
    miss = np.maximum(target * (1.0 - p) + (1.0 - target) * p, 1e-12)
    factor = miss**gamma
    falls = (2.0 * target - 1.0) * p * (1.0 - p)  # of the probability of the true class
    return factor * loss, factor * (p - target) - gamma * factor / miss * loss * falls


def squared_hinge(logit: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, its derivative by the logit, and the row's part of the dual objective."""
    sign = 2.0 * target - 1.0
    slack = np.maximum(0.0, 1.0 - sign * logit)
    return slack**2, -2.0 * sign * slack, 2.0 * slack - slack**2


@dataclass(frozen=True)
class Head:
    """One linear model: which target, which loss, and the fold that takes no part.

    A `margin` head is a support vector machine with squared hinge loss. Its intercept counts
    as a weight, so that the same sums also give a point of the dual problem: it ends when
    the two objectives are `gap` apart or less, which bounds how far either is from the best.
    """

    name: str
    target: int = 0
    gamma: float = 0.0
    reg: float = 0.01
    left_out: int | None = None
    margin: bool = False
    gap: float = 1e-3


@dataclass(frozen=True)
class Heads:
    """Independent heads over `size` features: the mean loss of each, weighted by row, plus
    `reg / 2` times the squared weights without the intercept."""

    heads: tuple[Head, ...]
    size: int

    def __len__(self) -> int:
        return len(self.heads)

    @property
    def names(self) -> list[str]:
        return [h.name for h in self.heads]

    def start(self) -> np.ndarray:
        return np.zeros(self.size + 1)

    def only(self, which: Sequence[int]) -> Heads:
        return Heads(tuple(self.heads[i] for i in which), self.size)

    def add(self, rows: Block, points: np.ndarray, loss: np.ndarray, gradient: np.ndarray) -> None:
        for k, head in enumerate(self.heads):
            w = rows.weight if head.left_out is None else np.where(rows.fold == head.left_out, 0.0, rows.weight)
            logit = rows.dots(points[k, :-1]) + points[k, -1]
            target, dual = rows.targets[:, head.target], 0.0
            if head.margin:
                value, slope, part = squared_hinge(logit, target)
                dual = w @ part
            else:
                value, slope = loss_and_slope(logit, target, head.gamma)
            loss[k] += (w @ value, w.sum(), dual)
            rows.add_to(gradient[k, :-1], w * slope)
            gradient[k, -1] += w @ slope

    def penalty(self, k: int, point: np.ndarray) -> tuple[float, np.ndarray]:
        head = self.heads[k]
        shrunk = head.reg * point
        shrunk[-1] *= head.margin
        return 0.5 * float(shrunk @ point), shrunk

    def settled(self, k: int, primal: float, dual: float, slope: np.ndarray) -> tuple[float, bool]:
        """The duality gap of a margin head, from mean sums at a point, and whether it is small enough."""
        head = self.heads[k]
        if not head.margin:
            return np.inf, False
        gap = primal - (dual - float(slope @ slope) / (2.0 * head.reg))
        return gap, gap <= head.gap

    def weights(self, points: Sequence[np.ndarray]) -> np.ndarray:
        """A row of weights and an intercept for each head."""
        return np.stack(list(points))


@dataclass(frozen=True)
class Shared:
    """A binary head (target 0, focal loss) and a head for each other target (cross-entropy,
    `label_weight` times its mean over all of them), all on `rank` learned directions."""

    size: int
    labels: int
    rank: int = 8
    gamma: float = 2.0
    label_weight: float = 0.3
    reg: float = 0.001
    seed: int = 42
    names: list[str] = field(default_factory=lambda: ["shared"])

    def __len__(self) -> int:
        return 1

    def _parts(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, heads = self.size * self.rank, 1 + self.labels
        b = a + self.rank * heads
        return point[:a].reshape(self.size, self.rank), point[a:b].reshape(self.rank, heads), point[b:]

    def start(self) -> np.ndarray:
        """Small random directions and heads, the same for the same seed."""
        draw = np.random.default_rng(self.seed)
        first = draw.normal(0.0, 0.1, self.size * self.rank + self.rank * (1 + self.labels))
        return np.concatenate([first, np.zeros(1 + self.labels)])

    def only(self, which: Sequence[int]) -> Shared:
        return self

    def add(self, rows: Block, points: np.ndarray, loss: np.ndarray, gradient: np.ndarray) -> None:
        directions, heads, bias = self._parts(points[0])
        hidden = np.stack([rows.dots(directions[:, r]) for r in range(self.rank)], axis=1)
        logits = hidden @ heads + bias
        value, slopes = loss_and_slope(logits[:, 0], rows.targets[:, 0], self.gamma)
        slopes = slopes[:, None]
        if self.labels:
            share = self.label_weight / self.labels
            cells, more = loss_and_slope(logits[:, 1:], rows.targets[:, 1:], 0.0)
            value = value + share * cells.sum(axis=1)
            slopes = np.hstack([slopes, share * more])
        slopes = slopes * rows.weight[:, None]
        loss[0] += (rows.weight @ value, rows.weight.sum(), 0.0)
        for_directions, for_heads, for_bias = self._parts(gradient[0])
        back = slopes @ heads.T
        for r in range(self.rank):
            rows.add_to(for_directions[:, r], back[:, r])
        for_heads += hidden.T @ slopes
        for_bias += slopes.sum(axis=0)

    def penalty(self, k: int, point: np.ndarray) -> tuple[float, np.ndarray]:
        shrunk = self.reg * point
        shrunk[len(point) - 1 - self.labels :] = 0.0
        return 0.5 * float(shrunk @ point), shrunk

    def settled(self, k: int, primal: float, dual: float, slope: np.ndarray) -> tuple[float, bool]:
        return np.inf, False

    def weights(self, points: Sequence[np.ndarray]) -> np.ndarray:
        """The heads over the features themselves: directions times heads."""
        directions, heads, bias = self._parts(points[0])
        return np.hstack([(directions @ heads).T, bias[:, None]])


# --- one scan ------------------------------------------------------------------------


def _partial_sums(objective, points):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = points.value
        loss, gradient = np.zeros((len(objective), 3)), np.zeros(at.shape)
        for batch in batches:
            for i in range(batch.num_rows):
                objective.add(Block(batch, i), at, loss, gradient)
        part = TaskContext.get().partitionId()
        for k in range(len(objective)):
            blocks = [(-1, loss[k])]
            blocks += [(b, gradient[k, b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-at.shape[1] // BLOCK))]
            kept = [(b, x) for b, x in blocks if b < 0 or x.any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k] * len(kept), pa.int32()),
                    pa.array([b for b, _ in kept], pa.int32()),
                    pa.array([part] * len(kept), pa.int32()),
                    pa.array([x.tobytes() for _, x in kept], pa.binary()),
                ],
                ["head", "block", "part", "sums"],
            )

    return run


def _added(group: pa.Table) -> pa.Table:
    """The sum of a block, in the order of the parts, so that a repeated step gives the same bits."""
    group = group.sort_by("part")
    total = np.zeros(len(group["sums"][0].as_buffer()) // 8)
    for sums in group["sums"]:
        total += np.frombuffer(sums.as_buffer())
    return group.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))


_SUMS = "head int, block int, part int, sums binary"


def gradient_sums(table: DataFrame, objective, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(loss, weight, dual)` and the gradient of every head at its point: one scan of the table."""
    sent = table.sparkSession.sparkContext.broadcast(points)
    try:
        sums = _blocks(table).mapInArrow(_partial_sums(objective, sent), _SUMS)
        levels = [F.lit(0)]
        if table.rdd.getNumPartitions() > FAN_IN:
            levels.insert(0, F.floor(F.col("part") / FAN_IN).cast("int"))
        for group in levels:
            sums = sums.withColumn("part_group", group).groupBy("head", "block", "part_group")
            sums = sums.applyInArrow(lambda key, rows: _added(rows.select(["head", "block", "part", "sums"])), _SUMS)
        found = sums.collect()
    finally:
        sent.destroy()
    loss, gradient = np.zeros((len(objective), 3)), np.zeros(points.shape)
    for row in found:
        into = loss[row["head"]] if row["block"] < 0 else gradient[row["head"], row["block"] * BLOCK :]
        values = np.frombuffer(row["sums"])
        into[: len(values)] = values
    return loss, gradient


# --- the optimiser -------------------------------------------------------------------


class Lbfgs:
    """Limited-memory BFGS that asks for loss and gradient at `point` and is told them."""

    _ARRAYS = ("point", "best", "gradient", "direction")
    _NUMBERS = ("loss", "step", "tries", "done", "steps", "gap")

    def __init__(self, start: np.ndarray, memory: int = 6, tolerance: float = 1e-7):
        self.point, self.memory, self.tolerance = start, memory, tolerance
        self.best = self.gradient = self.direction = np.zeros(0)
        self.loss, self.step, self.tries, self.done, self.steps, self.gap = np.inf, 0.0, 0, False, 0, np.inf
        self.moves: list[np.ndarray] = []
        self.changes: list[np.ndarray] = []
        self.losses: list[float] = []

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        self.steps += 1
        if len(self.best):
            slope = float(self.gradient @ self.direction)
            if not loss <= self.loss + 1e-4 * self.step * slope:  # also if it is not a number
                self.tries += 1
                rise = 2.0 * (loss - self.loss - self.step * slope)
                shorter = -slope * self.step**2 / rise if np.isfinite(loss) and rise > 0 else 0.0
                self.step = float(np.clip(shorter, 0.1 * self.step, 0.5 * self.step))
                self.done = self.tries > 30
                self.point = self.best + self.step * self.direction
                return
            move, change = self.point - self.best, gradient - self.gradient
            if move @ change > 1e-12 * (change @ change):
                self.moves = [*self.moves, move][-self.memory :]
                self.changes = [*self.changes, change][-self.memory :]
        self.best, self.gradient, self.loss, self.tries = self.point, gradient, float(loss), 0
        self.losses.append(self.loss)
        if np.abs(gradient).max(initial=0.0) <= self.tolerance:
            self.done = True
            return
        self.direction = -self._smoothed(gradient)
        if gradient @ self.direction >= 0:
            self.moves, self.changes, self.direction = [], [], -gradient
        self.step = 1.0 if self.moves else min(1.0, 1.0 / float(np.linalg.norm(gradient)))
        self.point = self.best + self.step * self.direction

    def _smoothed(self, gradient: np.ndarray) -> np.ndarray:
        """The inverse curvature times the gradient."""
        q, factors = gradient.copy(), []
        for move, change in zip(reversed(self.moves), reversed(self.changes)):
            a = (move @ q) / (move @ change)
            factors.append(a)
            q -= a * change
        if self.moves:
            q *= (self.moves[-1] @ self.changes[-1]) / (self.changes[-1] @ self.changes[-1])
        for move, change, a in zip(self.moves, self.changes, reversed(factors)):
            q += (a - (change @ q) / (move @ change)) * move
        return q

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {name: getattr(self, name) for name in self._ARRAYS}
        numbers = np.array([float(getattr(self, name)) for name in self._NUMBERS] + [self.memory, self.tolerance])
        lists = {"moves": self.moves, "changes": self.changes}
        np.savez(out, **arrays, numbers=numbers, losses=np.array(self.losses), **{k: np.array(v) for k, v in lists.items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Lbfgs:
        with np.load(io.BytesIO(raw)) as held:
            loss, step, tries, done, steps, gap, memory, tolerance = held["numbers"].tolist()
            out = cls(held["point"], int(memory), tolerance)
            out.best, out.gradient, out.direction = held["best"], held["gradient"], held["direction"]
            out.loss, out.step, out.tries, out.done, out.steps = loss, step, int(tries), bool(done), int(steps)
            out.gap = gap
            out.moves, out.changes = list(held["moves"]), list(held["changes"])
            out.losses = held["losses"].tolist()
        return out


def advance(table: DataFrame, objective, states: Sequence[Lbfgs], steps: int) -> int:
    """Up to `steps` scans, fewer once every head has settled; returns how many.

    A step gives each head that has not settled the loss and gradient it asked for.
    """
    for step in range(steps):
        active = [k for k, state in enumerate(states) if not state.done]
        if not active:
            return step
        loss, gradient = gradient_sums(table, objective.only(active), np.stack([states[k].point for k in active]))
        for at, k in enumerate(active):
            extra, slope = objective.penalty(k, states[k].point)
            total, state = max(loss[at, 1], 1e-300), states[k]
            primal, raw, point = loss[at, 0] / total + extra, gradient[at] / total, state.point
            state.tell(primal, raw + slope)
            if state.best is point:
                state.gap, enough = objective.settled(k, primal, loss[at, 2] / total, raw)
                state.done = state.done or enough
    return steps


def fit(table: DataFrame, objective, steps: int = 50, tolerance: float = 1e-7) -> list[Lbfgs]:
    """The optimiser of every head after up to `steps` scans; `best` and `losses` are its result."""
    table = packed(table)
    states = [Lbfgs(objective.start(), tolerance=tolerance) for _ in range(len(objective))]
    advance(table, objective, states, steps)
    return states


# --- scoring -------------------------------------------------------------------------


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))


def target_margins(table: DataFrame, weights: np.ndarray) -> DataFrame:
    """`targets, margins` (one logit a head) of every row of a design table or its blocks."""
    sent = table.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                logits = np.stack([block.dots(w[:-1]) + w[-1] for w in sent.value], axis=1)
                yield pa.RecordBatch.from_arrays([_lists(block.targets), _lists(logits)], ["targets", "margins"])

    return _blocks(table).mapInArrow(run, "targets array<double>, margins array<double>")


def margins(rows: DataFrame, weights: np.ndarray, *keep: str, key: str = "id") -> DataFrame:
    """`id`, the columns to keep and `margins` (one logit a head) of rows with `ix` and `val`.

    `weights` has a row for each head, the intercept last; it is broadcast: its size is
    the model's. A feature beyond its width is ignored.
    """
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        padded = np.zeros(w.shape[1])
        for batch in batches:
            part = Rows(batch)
            part.ix = np.minimum(part.ix, w.shape[1] - 1)
            out = np.empty((batch.num_rows, len(w)))
            for k in range(len(w)):
                padded[:-1] = w[k, :-1]
                out[:, k] = part.dots(padded) + w[k, -1]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], _lists(out)], [*names, "margins"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", margins array<double>"
    return rows.select(*names, "ix", "val").mapInArrow(run, schema)
