"""Message passing over the host graph with given weights, as joins and grouped sums."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from hostweave.operators.scale_out import lookup_join
from hostweave.session import cut

NEGATIVE_SLOPE = 0.2


@dataclass(frozen=True)
class AttentionLayer:
    """Weights of one attention layer: ``heads`` blocks of ``dim`` outputs each.

    ``norm`` holds the evaluation form of a batch normalisation as (mean, variance, gamma, beta).
    ``activate`` turns on norm, ELU and the residual sum that follow all layers but the last.
    """

    weight: np.ndarray  # (heads * dim, inputs)
    att_src: np.ndarray  # (heads, dim)
    att_dst: np.ndarray  # (heads, dim)
    att_edge: np.ndarray  # (heads, dim)
    edge_weight: np.ndarray  # (heads * dim, edge inputs)
    bias: np.ndarray  # (heads * dim,)
    norm: tuple | None = None
    activate: bool = True
    eps: float = field(default=1e-5)

    @property
    def heads(self) -> int:
        return self.att_src.shape[0]

    @property
    def dim(self) -> int:
        return self.att_src.shape[1]


def _projected(nodes: DataFrame, layer: AttentionLayer, keys: list[str]) -> DataFrame:
    """Host vectors times the weight matrix, in Arrow batches, with the two score parts per head."""
    w, heads, dim = np.asarray(layer.weight, float), layer.heads, layer.dim
    a_src, a_dst = np.asarray(layer.att_src, float), np.asarray(layer.att_dst, float)
    types = dict(nodes.dtypes)

    def project(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
            h = (x @ w.T).reshape(len(pdf), heads, dim)
            yield pdf[keys].assign(
                x=pdf["x"], h=list(h.reshape(len(pdf), -1)),
                s_src=list((h * a_src).sum(-1)), s_dst=list((h * a_dst).sum(-1)),
            )

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{c} array<double>" for c in ("x", "h", "s_src", "s_dst")])
    return nodes.select(*keys, "x").mapInPandas(project, schema)


def _literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def neighbor_attention(nodes: DataFrame, edges: DataFrame, layer: AttentionLayer, by: tuple[str, ...] = ()) -> DataFrame:
    """One attention layer: nodes (by..., node, x) and edges (by..., src, dst, e) to (by..., node, x).

    Each host takes the weighted mean of its in-neighbours' projected vectors; weights are the
    softmax over its incoming edges of a leaky-linear score of source, target and edge. Self-loops
    are replaced by one loop per host whose edge score is the mean of its incoming ones. The
    weighted mean of a head is a grouped vector summary, which combines before the shuffle, so a
    host with very many neighbours is no hot spot.
    """
    heads, dim, keys = layer.heads, layer.dim, [*by, "node"]
    table = cut(_projected(nodes, layer, keys), "attention")
    edge_vec = np.einsum(
        "hdi,hd->hi", np.asarray(layer.edge_weight, float).reshape(heads, dim, -1), np.asarray(layer.att_edge, float)
    )

    def edge_score(h: int) -> Column:
        out = F.lit(0.0)
        for i, v in enumerate(edge_vec[h]):
            out = out + F.col("e")[i] * float(v)
        return out

    scores = [f"_e{h}" for h in range(heads)]
    real = edges.filter(F.col("src") != F.col("dst")).select(
        *by, "src", "dst", *[edge_score(h).alias(c) for h, c in enumerate(scores)]
    )
    loop_score = real.groupBy(*by, F.col("dst").alias("node")).agg(*[F.avg(c).alias(c) for c in scores])
    loops = table.select(*keys).join(loop_score, keys, "left").select(
        *by, F.col("node").alias("src"), F.col("node").alias("dst"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in scores]
    )
    links = real.unionByName(loops)
    links = lookup_join(links, table.select(*by, F.col("node").alias("src"), "s_src"), [*by, "src"])
    links = lookup_join(links, table.select(*by, F.col("node").alias("dst"), "s_dst"), [*by, "dst"])

    def leaky(c: Column) -> Column:
        return F.when(c > 0, c).otherwise(c * NEGATIVE_SLOPE)

    logits = [f"_l{h}" for h in range(heads)]
    scored = cut(links.select(
        *by, "src", "dst",
        *[leaky(F.col("s_src")[h] + F.col("s_dst")[h] + F.col(scores[h])).alias(c) for h, c in enumerate(logits)],
    ), "attention")
    # the usual shift by the largest score of the target keeps exp in range
    top = scored.groupBy(*by, "dst").agg(*[F.max(c).alias(f"_top{h}") for h, c in enumerate(logits)])
    weighted = lookup_join(scored, top, [*by, "dst"]).select(
        *by, "src", "dst", *[F.exp(F.col(c) - F.col(f"_top{h}")).alias(f"_w{h}") for h, c in enumerate(logits)]
    )
    # parallel edges become one row with the sum of their weights before it meets a wide vector
    weighted = weighted.groupBy(*by, "src", "dst").agg(*[F.sum(f"_w{h}").alias(f"_w{h}") for h in range(heads)])
    full = lookup_join(weighted, table.select(*by, F.col("node").alias("src"), "h"), [*by, "src"])
    means = full.groupBy(*by, F.col("dst").alias("node")).agg(*[
        Summarizer.mean(array_to_vector(F.slice("h", h * dim + 1, dim)), F.col(f"_w{h}")).alias(f"_m{h}") for h in range(heads)
    ])
    joined = F.concat(*[vector_to_array(F.col(f"_m{h}")) for h in range(heads)])
    out = means.select(*keys, F.zip_with(joined, _literal_array(layer.bias), lambda a, b: a + b).alias("_y"))
    if not layer.activate:
        return out.select(*keys, F.col("_y").alias("x"))
    if layer.norm is not None:
        mean, var, gamma, beta = (np.asarray(v, float) for v in layer.norm)
        factor = gamma / np.sqrt(var + layer.eps)
        shift = beta - mean * factor
        y = F.zip_with("_y", _literal_array(factor), lambda a, b: a * b)
        out = out.withColumn("_y", F.zip_with(y, _literal_array(shift), lambda a, b: a + b))
    out = out.withColumn("_y", F.transform("_y", lambda v: F.when(v > 0, v).otherwise(F.expm1(v))))
    if layer.weight.shape[0] == layer.weight.shape[1]:
        before = table.select(*keys, "x")
        return out.join(before, keys).select(*keys, F.zip_with("_y", "x", lambda a, b: a + b).alias("x"))
    return out.select(*keys, F.col("_y").alias("x"))


def attention_encode(nodes: DataFrame, edges: DataFrame, layers: list[AttentionLayer], by: tuple[str, ...] = ()) -> DataFrame:
    """A stack of layers. Each layer's result is written out, so the plan does not grow with depth."""
    edges = cut(edges.select(*by, "src", "dst", "e"), "attention")
    x = nodes
    for layer in layers:
        x = cut(neighbor_attention(x, edges, layer, by), "attention")
    return x


def mean_neighbor_features(nodes: DataFrame, edges: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a host's own features and those of its in-neighbours, over all parallel edges.

    Features stay scalar columns, so the sums combine before the shuffle inside generated code. The
    features are written once, since neighbours and the host itself read them; a host's own row is
    added to the sum over its neighbours. A host without features of its own has the neighbours' mean;
    nulls count as zero beside other values.
    """
    nodes = cut(nodes.select(*by, "node", *cols), "host-features")
    links = edges.filter(F.col("src") != F.col("dst"))
    # parallel edges first become one row with a weight
    weights = links.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("_w"))
    joined = lookup_join(weights, nodes.withColumnRenamed("node", "src"), [*by, "src"])
    around = joined.groupBy(*by, F.col("dst").alias("node")).agg(
        F.sum("_w").alias("_w"), *[F.sum(F.col(c) * F.col("_w")).alias(f"_s_{c}") for c in cols]
    )
    both = nodes.withColumn("_own", F.lit(1)).join(around, [*by, "node"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("_own") + zero("_w")
    known = lambda c: F.col(c).isNotNull() | F.col(f"_s_{c}").isNotNull()
    return both.select(
        *by, "node", *[F.when(known(c), (zero(c) + zero(f"_s_{c}")) / total).alias(c) for c in cols]
    )
