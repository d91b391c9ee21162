"""Approximate nearest neighbours by learned partitions.

A bounded sample is joined to its nearest neighbours and that graph is cut into balanced
parts; a small classifier learns in which parts a vector and its neighbours lie.  It then puts
every vector of the table into its most probable part, and sends a query to the several most
probable ones, where all vectors are ranked by their exact cosine.

Equal vectors are one candidate with the smallest vec_ids it may need, so a vector that a third of the
table repeats is neither a large part nor a large answer.  Parts and queries are
cut into blocks, so no task gets a whole part or all queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import written

SAMPLE = 4096  # vectors that the graph and the classifier are fitted on
NEAREST = 20
PARTS = 16
PROBES = 13  # 0.9 of the neighbours of vectors without any structure; far fewer do where there is some
OWN = 0.2  # weight of a vector's own part beside its neighbours'
BLOCK = 2048  # candidates or queries that meet in one task
SEED = 17


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest others of each unit vector of the sample."""
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    k = min(k, len(x) - 1)
    return np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(x), 0), np.int64)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node: parts of equal size with few edges between them.

    Halves again and again.  A half grows from the node farthest from a random one, always by
    the nodes with most edges into it; swaps then move pairs that save edges.
    """
    n = len(graph)
    both = [set() for _ in range(n)]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            both[a].add(b)
            both[b].add(a)
    label = np.zeros(n, np.int64)

    def halve(nodes: list[int], into: int, first: int) -> None:
        if into == 1 or len(nodes) < 2:
            label[nodes] = first
            return
        inside = set(nodes)
        left_parts = into // 2
        goal = len(nodes) * left_parts // into
        order, seen = [int(rng.choice(nodes))], set()
        seen.add(order[0])
        for node in order:  # breadth first: the last one reached is far away
            for other in both[node]:
                if other in inside and other not in seen:
                    seen.add(other)
                    order.append(other)
        left, gain = set(), dict.fromkeys(nodes, 0)
        frontier = {order[-1]}
        while len(left) < goal:
            node = max(frontier, key=gain.__getitem__) if frontier else next(x for x in nodes if x not in left)
            frontier.discard(node)
            left.add(node)
            for other in both[node]:
                if other in inside and other not in left:
                    gain[other] += 1
                    frontier.add(other)
        for _ in range(4):
            saved = {x: sum((y in left) != (x in left) for y in both[x] if y in inside) - sum((y in left) == (x in left) for y in both[x] if y in inside) for x in nodes}
            ours = sorted((x for x in nodes if x in left), key=lambda x: -saved[x])  # noqa: B023
            theirs = sorted((x for x in nodes if x not in left), key=lambda x: -saved[x])  # noqa: B023
            swaps = [(a, b) for a, b in zip(ours, theirs, strict=False) if saved[a] + saved[b] > 2][: max(len(nodes) // 20, 1)]
            for a, b in swaps:
                left.discard(a)
                left.add(b)
            if not swaps:
                break
        halve([x for x in nodes if x in left], left_parts, first)
        halve([x for x in nodes if x not in left], into - left_parts, first + left_parts)

    halve(list(range(n)), parts, 0)
    return label


def fit_classifier(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A network with one hidden layer that gives each part a score; trained by gradient steps with momentum."""
    hidden, target = 128, np.eye(parts)[label] * OWN
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), (1 - OWN) / graph.shape[1])
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    moved = [np.zeros_like(p) for p in w]
    scale = np.sqrt(x.shape[1])
    for epoch in range(40):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 128):
            own = order[k : k + 128]
            a = x[own] * scale
            h = np.maximum(a @ w[0] + w[1], 0)
            p = h @ w[2] + w[3]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p = (p - target[own]) / len(own)
            back = (p @ w[2].T) * (h > 0)
            for i, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                moved[i] = 0.9 * moved[i] - (0.1 if epoch < 30 else 0.02) * (g + 1e-4 * w[i])
                w[i] = w[i] + moved[i]
    return tuple(w)


def part_scores(w: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    return np.maximum(x * np.sqrt(x.shape[1]) @ w[0] + w[1], 0) @ w[2] + w[3]


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _route(w: tuple[np.ndarray, ...] | None, probes: int):
    """Adds the most probable parts of each vector, most probable first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if w is None:
                parts = [[0]] * batch.num_rows
            else:
                scores = part_scores(w, _unit(_stack(batch.column("v"))))
                parts = np.argsort(-scores, axis=1, kind="stable")[:, :probes].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    return run


def _rank(k: int):
    """The best k of one block for each query of its part, by exact cosine."""

    def run(key: tuple, queries, block):
        import pandas as pd

        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "score": [], "ids": []})
        a, b = np.stack(queries["v"].to_numpy()).astype(np.float64), np.stack(block["v"].to_numpy()).astype(np.float64)
        scores = (_unit(a) @ _unit(b).T)
        n = min(k + 1, scores.shape[1])  # its own vector may be among them
        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        # Ties with the last one stay in: vec_id decides among them.
        row, column = np.nonzero(scores >= least[:, None] - 1e-12)
        exact = np.array([cosine(a[i], b[j]) for i, j in zip(row, column, strict=True)])
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "score": exact, "ids": block["ids"].to_numpy()[column]})

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, parts: int = PARTS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    ``vectors`` has vec_id and embedding.  Queries are rows whose vec_id is divisible by
    ``every``, candidates all rows but those of the query's own vec_id; nearness is cosine in double
    precision, ties go to the smaller vec_id.  Null, empty and zero vectors, those with null or
    non-finite components, and rows without vec_id take no part; of vectors of several
    lengths only equal lengths are compared.  Rows that share a vec_id and vector are one.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.size("v").cast("int") > 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(good & finite).filter(F.exists("v", lambda x: x != 0)).distinct()
    rows = written(rows.withColumn("dim", F.size("v")), "vectors")
    # A query needs at most k + 1 of the vec_ids that share a vector: one may be its own.
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")))
    same = placed.filter(F.col("rn") <= k + 1).groupBy("dim", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    same = written(same, "distinct-vectors")
    out = None
    for dim in sorted(r["dim"] for r in same.select("dim").distinct().collect()):
        found = _nearest(rows.filter(F.col("dim") == dim), same.filter(F.col("dim") == dim), every, k, parts, probes)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(rows: DataFrame, same: DataFrame, every: int, k: int, parts: int, probes: int) -> DataFrame:
    sample = same.orderBy(F.xxhash64(F.lit(SEED), "v")).select("v").limit(SAMPLE).toPandas()["v"]
    x, rng, w = _unit(np.stack(sample.to_numpy())), np.random.default_rng(SEED), None
    if len(x) >= 8 * parts:
        graph = neighbour_graph(x, NEAREST)
        w = fit_classifier(x, balanced_parts(graph, parts, rng), graph, parts, rng)
    routed = same.select("v", "ids").mapInArrow(_route(w, 1), "v array<double>, ids array<long>, parts array<int>")
    routed = written(routed.select("v", "ids", F.col("parts")[0].alias("part")), "candidates")
    sizes = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a part
    blocks = F.create_map(*[F.lit(x) for p in sizes for x in (p, max(1, -(-sizes[p] // BLOCK)))])
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    groups = max(1, -(-queries.count() // BLOCK))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("ids"), blocks[F.col("part")]).cast("int"))
    routed = routed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.mapInArrow(_route(w, probes), "query_id long, v array<double>, parts array<int>")
    asked = asked.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), F.explode("parts").alias("part"))
    asked = asked.filter(F.col("part").isin(list(sizes))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))
    spot = ["part", "block", "group"]
    pairs = asked.groupBy(*spot).cogroup(routed.groupBy(*spot))
    found = pairs.applyInPandas(_rank(k), "query_id long, score double, ids array<long>")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").distinct()
    best = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score")
    )
