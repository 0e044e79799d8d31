"""The most similar vectors of every vector, by robust-pruned directed graphs (problem 3).

Unit vectors are spread over overlapping shards: centres are fitted on a bounded sample, and each vector belongs to the
shards of its ``ROUTES`` nearest centres. In a shard a directed graph is built: a greedy (beam) search from fixed
entries proposes neighbours of each new vector, relaxed distance pruning keeps diverse edges, and reverse edges are
pruned in the same way when a vector has too many. Then beam search answers every vector in each of its shards, and
the best of all shards are kept. A shard that is too large for one task is cut into parts at random; a vector is then
indexed in one part and searched in all of them. Equal vectors stand in the graph as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.runtime import bounded_broadcast, stage, width

#: Vectors on which the centres are fitted, at most.
SAMPLE = 20_000
ROUTES = 3
#: Vectors of a shard that are aimed at, and from which on a shard is cut into parts.
SHARD, SHARD_MOST = 6_000, 15_000
#: Vectors that one task answers; beyond, the vectors of a shard are dealt out to several tasks with the same graph.
ANSWERS = 60_000
DEGREE, SLACK, RELAX = 24, 12, 1.2
BUILD_BEAM, SEARCH_BEAM, STEP = 40, 32, 3


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """A directed graph over unit vectors; distances are 1 - cosine."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x, n = np.ascontiguousarray(x, np.float32), len(x)
        self.edges = np.full((n, DEGREE + SLACK), -1, np.int32)
        self.degree = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        near_mean = int(np.argmax(self.x @ self.x.mean(0))) if n else 0
        self.entries = np.unique(np.append(order[:15], near_mean)).astype(np.int32)
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]])
        done = len(self.entries)
        self._connect(order[:done], np.tile(order[:done], (done, 1)))
        while done < n:
            batch = order[done : done + min(done, 1024)]
            pool, _ = self.search(self.x[batch], None, BUILD_BEAM)
            self._connect(batch, pool)
            done += len(batch)

    def search(self, q: np.ndarray, start: np.ndarray | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of the rows of ``q``: ids (-1: none) and cosines of the best ``beam``, nearest first.

        Every row starts from the entries and, where given, from its own node in ``start``.
        """
        m, n = len(q), len(self.x)
        first = np.tile(self.entries, (m, 1))
        if start is not None:
            own = np.where(np.isin(start, self.entries), -1, start).astype(np.int32)
            first = np.concatenate([own[:, None], first], 1)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # stands for no node
        rows = np.arange(m)[:, None]

        def cosines(ids: np.ndarray) -> np.ndarray:
            got = np.matmul(self.x[np.maximum(ids, 0)], q[:, :, None])[:, :, 0]
            return np.where(ids >= 0, got, -2.0).astype(np.float32)

        ids, cos = first, cosines(first)
        seen[rows, np.where(ids >= 0, ids, n)] = True
        open_ = ids >= 0
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            cos = np.pad(cos, ((0, 0), (0, pad)), constant_values=-2)
            open_ = np.pad(open_, ((0, 0), (0, pad)))
        active = np.arange(m)
        while len(active):
            score = np.where(open_[active], cos[active], -3)
            pick = np.argpartition(-score, STEP - 1, axis=1)[:, :STEP]
            ok = np.take_along_axis(score, pick, 1) > -3
            live = ok.any(1)
            active, pick, ok = active[live], pick[live], ok[live]
            if not len(active):
                break
            a = active[:, None]
            open_[a, pick] = False
            new = self.edges[np.where(ok, ids[a, pick], 0)]
            new = np.where(ok[:, :, None], new, -1).reshape(len(active), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[a, np.where(new >= 0, new, n)]] = -1
            seen[a, np.where(new >= 0, new, n)] = True
            wide = int((new >= 0).sum(1).max(initial=0))
            if not wide:
                continue
            new = -np.sort(-new, axis=1)[:, :wide]
            got = np.matmul(self.x[np.maximum(new, 0)], q[active][:, :, None])[:, :, 0]
            got = np.where(new >= 0, got, -2.0)
            every, scores = np.concatenate([ids[active], new], 1), np.concatenate([cos[active], got], 1)
            opened = np.concatenate([open_[active], new >= 0], 1)
            best = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(every, best, 1)
            cos[active] = np.take_along_axis(scores, best, 1)
            open_[active] = np.take_along_axis(opened, best, 1)
        by = np.argsort(-cos, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(cos, by, 1)

    def prune(self, at: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """For each node in ``at``, at most DEGREE diverse ids of its row of ``pool`` (-1: none), nearest first.

        A candidate goes when one that is kept is nearer to it, by the factor RELAX, than the node is.
        """
        x = self.x
        pool = np.where(pool == at[:, None], -1, pool)
        v = x[np.maximum(pool, 0)]
        to = np.where(pool >= 0, np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, x[at][:, :, None])[:, :, 0])), np.inf)
        by = np.argsort(to, axis=1, kind="stable")
        pool, to = np.take_along_axis(pool, by, 1), np.take_along_axis(to, by, 1)
        v = np.take_along_axis(v, by[:, :, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
        alive = np.isfinite(to)
        out = np.full((len(at), DEGREE), -1, np.int32)
        rows = np.arange(len(at))
        for k in range(DEGREE):
            j = alive.argmax(1)
            ok = alive[rows, j]
            if not ok.any():
                break
            out[ok, k] = pool[rows, j][ok]
            alive &= ~((RELAX * between[rows, j] <= to) & ok[:, None])
            alive[rows, j] = False
        return out

    def _connect(self, nodes: np.ndarray, pool: np.ndarray) -> None:
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for a in range(0, len(nodes), 512):
            out[a : a + 512] = self.prune(nodes[a : a + 512], pool[a : a + 512])
        self.edges[nodes, :DEGREE] = out
        self.degree[nodes] = (out >= 0).sum(1)
        # Reverse edges, by their target.
        source, target = np.repeat(nodes, DEGREE)[out.ravel() >= 0].astype(np.int32), out.ravel()[out.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
        count = np.diff(np.append(first, len(target)))
        nth = np.arange(len(target)) - np.repeat(first, count)
        whole = DEGREE + SLACK
        # New edges that have no room wait in further columns; their targets are pruned.
        place = self.degree[target] + nth
        fits = place < whole
        self.edges[target[fits], place[fits]] = source[fits]
        full = np.unique(target[~fits])
        self.degree[target[fits]] = np.maximum(self.degree[target[fits]], place[fits] + 1)
        for a in range(0, len(full), 256):
            t = full[a : a + 256]
            inside = np.isin(target, t) & ~fits
            more = int((place[inside] - whole).max(initial=-1)) + 1
            cand = np.full((len(t), whole + more), -1, np.int32)
            cand[:, :whole] = self.edges[t]
            cand[np.searchsorted(t, target[inside]), place[inside]] = source[inside]
            kept = self.prune(t, cand)
            self.edges[t] = -1
            self.edges[t, :DEGREE] = kept
            self.degree[t] = (kept >= 0).sum(1)
            order = np.argsort(kept < 0, axis=1, kind="stable")  # no gaps
            self.edges[t, :DEGREE] = np.take_along_axis(kept, order, 1)


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centres of the sample ``x``, by spherical k-means with fixed choices."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c.astype(np.float32)


def similar_pairs(df: DataFrame, key: str, vector: str, dim: int, k: int, least: float) -> DataFrame:
    """(a, b, cosine): for each key a, its ``k`` most similar other keys b with a cosine of at least ``least``.

    Vectors that are null, of another length than ``dim``, hold a null or no finite number, or are all zero take no
    part, nor do null keys; of a key with several vectors the first in order of the array is taken. Ties in cosine go to
    the lesser key. Of a group of equal vectors larger than k each gets the k least other keys of the group, so the
    result grows with the rows, not with the square of the group. An empty table gives an empty result.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
    src = src.where(F.size("v") == dim).where(F.exists("v", lambda v: v != 0) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    one = stage(src.groupBy("key").agg(F.min("v").alias("v")).withColumn("cls", F.xxhash64("v")), "vectors")
    # Classes are equal vectors; where two of them have one hash (about n * n / 2 ** 65 are expected), both take another.
    same = one.groupBy("v").agg(F.first("cls").alias("cls"), F.count("*").alias("copies"))
    classes = stage(same.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(1 << 30))), "vector-classes")
    twice = [r[0] for r in classes.groupBy("cls").count().where("count > 1").select("cls").collect()]
    if twice:
        other = F.when(F.col("cls").isin(twice), F.xxhash64("v", F.lit(1))).otherwise(F.col("cls"))
        one, classes = one.withColumn("cls", other), classes.withColumn("cls", other)
    n = classes.count()
    least_tasks = min(width(spark), max(1, n // 200))
    centres_n = max(1, least_tasks, -(-n * ROUTES // SHARD))
    sample = classes.orderBy(F.xxhash64("part"), "cls").limit(SAMPLE).select("v").toPandas()["v"]
    centres = fit_centres(unit(np.stack(sample)), min(centres_n, len(sample))) if n else np.zeros((1, dim), np.float32)
    routes = min(ROUTES, len(centres))
    held = spark.sparkContext.broadcast(centres)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for p in batches:
            if len(p):
                near = np.argpartition(-(unit(np.stack(p["v"])) @ c.T), routes - 1, axis=1)[:, :routes]
                yield pd.DataFrame({"cls": p["cls"], "part": p["part"], "v": p["v"], "shards": list(near.astype(np.int32))})

    # Routes are found once and staged with the vector; sizes of shards are counted from them and joined, a row a centre.
    routed = stage(classes.select("cls", "part", "v").mapInPandas(route, "cls long, part long, v array<float>, shards array<int>"), "routes")
    sizes = routed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("size"))
    parts = lambda most: F.ceil(F.col("size") / most).cast("int")
    cut = routed.select("cls", "part", "v", F.explode("shards").alias("shard")).join(F.broadcast(sizes.select("shard", parts(SHARD_MOST).alias("parts"), parts(ANSWERS).alias("turns"))), "shard")
    cut = cut.withColumns({"own": F.pmod("part", "parts").cast("int"), "turn": F.pmod(F.xxhash64("part"), F.col("turns")).cast("int")})
    # A vector asks in its own turn of each part; in its own part it stands in the graph of every turn.
    places = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    asks = places(F.col("parts"), lambda i: F.struct(i.alias("at"), F.col("turn").alias("block"), F.lit(True).alias("asks")))
    stands = F.filter(places(F.col("turns"), lambda i: F.struct(F.col("own").alias("at"), i.alias("block"), F.lit(False).alias("asks"))), lambda x: x["block"] != F.col("turn"))
    cut = cut.select("shard", "own", "cls", "v", F.inline(F.concat(asks, stands)))

    def answer(p: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(p["v"]))
        cls = p["cls"].to_numpy()
        inside = np.flatnonzero((p["own"] == p["at"]).to_numpy())
        out = []
        if len(inside):
            g = Graph(x[inside])
            node = np.full(len(p), -1, np.int64)
            node[inside] = np.arange(len(inside))
            asking = np.flatnonzero(p["asks"].to_numpy())
            for a in range(0, len(asking), 512):
                q = asking[a : a + 512]
                ids, cos = g.search(x[q], node[q], max(SEARCH_BEAM, k + 1))
                row, col = np.nonzero((ids >= 0) & (cos >= least - 1e-4) & (ids != node[q][:, None]))
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                i, j = q[row], inside[ids[row, col]]
                exact = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64))
                out.append(pd.DataFrame({"a": cls[i], "b": cls[j], "cosine": exact}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    near = cut.groupBy("shard", "at", "block").applyInPandas(answer, "a long, b long, cosine double")
    near = near.where(F.col("cosine") >= least).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).select("a", "b", "cosine")
    best = stage(best, "near-classes")

    # From classes back to keys: of a class only its k + 1 least keys can be anyone's neighbour.
    ranked = one.select("key", "cls").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("key")))
    several = bounded_broadcast(classes.where("copies > 1").select("cls"), 100_000)
    twins = ranked.join(several, "cls", "left_semi")
    few = twins.where(F.col("r") <= k + 1)
    equal = twins.select("cls", F.col("key").alias("x")).join(few.select("cls", F.col("key").alias("y")), "cls").where("x <> y").select("x", "y", F.lit(1.0).alias("cosine"))
    other = best.join(one.select(F.col("cls").alias("a"), F.col("key").alias("x")), "a").join(ranked.where(F.col("r") <= k).select(F.col("cls").alias("b"), F.col("key").alias("y")), "b").select("x", "y", "cosine")
    every = equal.unionByName(other)
    top = every.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("r") <= k)
    return top.select(F.col("x").alias("a"), F.col("y").alias("b"), "cosine")
