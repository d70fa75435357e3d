"""Moments of feature rows: mergeable, and enough to fit the model of normal hosts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hostweave.operators.detect import Reconstruction
from hostweave.operators.stats import STD_FLOOR


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and sums of products of deviations (features x features)."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(
            n, self.mean + gap * other.n / n,
            self.products + other.products + np.outer(gap, gap) * self.n * other.n / n,
        )

    def std(self) -> np.ndarray:
        return np.maximum(np.sqrt(np.maximum(np.diag(self.products), 0.0) / max(self.n, 1)), STD_FLOOR)

    def packed(self) -> list:
        return [self.n, self.mean.tolist(), self.products[np.triu_indices(len(self.mean))].tolist()]

    @staticmethod
    def unpacked(values: list) -> Moments:
        n, mean, upper = values
        products = np.zeros((len(mean), len(mean)))
        products[np.triu_indices(len(mean))] = upper
        return Moments(int(n), np.array(mean, float), products + np.triu(products, 1).T)


def no_moments(features: int) -> Moments:
    return Moments(0, np.zeros(features), np.zeros((features, features)))


class SlidingMoments:
    """Moments of a queue of snapshots, newest last, with their sum always at hand.

    Two stacks: new snapshots go to the back, whose sum is carried along; the oldest ones are taken
    from the front, where each entry has the sum of itself and the newer ones there. When the front is
    empty the back is turned over. So a snapshot costs a fixed number of merges, however long the queue.
    """

    def __init__(self, features: int):
        self.none = no_moments(features)
        self.front: list[tuple[int, Moments, Moments]] = []  # oldest last
        self.back: list[tuple[int, Moments]] = []
        self.back_sum = self.none

    def __len__(self) -> int:
        return len(self.front) + len(self.back)

    def push(self, ts: int, moments: Moments) -> None:
        self.back.append((ts, moments))
        self.back_sum = self.back_sum.merge(moments)

    def drop(self, n: int) -> None:
        """Take away the oldest ``n``."""
        for _ in range(n):
            if not self.front:
                self._turn(self.back)
                self.back, self.back_sum = [], self.none
            self.front.pop()

    def _turn(self, entries: list[tuple[int, Moments]]) -> None:
        joint = self.none
        for ts, m in reversed(entries):
            joint = m.merge(joint)
            self.front.append((ts, m, joint))

    def total(self) -> Moments:
        return self.front[-1][2].merge(self.back_sum) if self.front else self.back_sum

    def packed(self) -> dict:
        oldest_first = [(ts, m) for ts, m, _ in reversed(self.front)]
        return {"front": len(self.front), "entries": [[t, *m.packed()] for t, m in [*oldest_first, *self.back]]}

    @staticmethod
    def unpacked(values: dict, features: int) -> SlidingMoments:
        out = SlidingMoments(features)
        entries = [(int(t), Moments.unpacked(m)) for t, *m in values["entries"]]
        out._turn(entries[: values["front"]])
        for ts, m in entries[values["front"] :]:
            out.push(ts, m)
        return out


def snapshot_moments(df: DataFrame, cols: list[str], by: str = "snapshot_ts") -> dict[int, Moments]:
    """Moments of each snapshot. One partial aggregation over the rows; the driver receives a few
    hundred numbers per snapshot of the batch, however many hosts a snapshot has."""
    d = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in d]).alias("mean"),
        F.array(*[F.covar_pop(d[i], d[j]) for i, j in pairs]).alias("upper"),
    ).collect()
    return {int(r[by]): Moments.unpacked([r["n"], r["mean"], [v * r["n"] for v in r["upper"]]]) for r in rows}


def model_of(moments: Moments, cols: list[str], k: int) -> Reconstruction:
    """The linear autoencoder of :func:`detect.reconstruct_fit` from moments; ``k=0`` reconstructs
    every row by the mean. The largest entry of a component is positive."""
    std = moments.std()
    scale = std + 1e-6
    values, vectors = np.linalg.eigh(moments.products / max(moments.n, 1) / np.outer(scale, scale))
    order = np.argsort(-values)[:k]
    components = vectors[:, order].T
    if k:
        sign = np.sign(components[np.arange(len(order)), np.abs(components).argmax(axis=1)])
        components = components * sign[:, None]
    total = float(values.sum()) or 1.0
    return Reconstruction(
        tuple(cols), tuple(moments.mean.tolist()), tuple(std.tolist()), tuple(map(tuple, components.tolist())),
        tuple(float(max(values[i], 0.0)) / total for i in order),
    )
