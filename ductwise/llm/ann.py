"""Approximate nearest neighbours: adaptive dimension scan in the probed lists of a clustered index.

Vectors are scaled to length one and rotated at random, so that the squared distance over the first d of D dimensions is an
estimate of d/D of the whole. In each probed list the distance is summed block by block of columns; after each block, a
candidate whose partial distance is too large for its estimate to stay under the best found so far, at the error allowed for
d dimensions, is given up. What remains is scored with the exact cosine, in double precision, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ductwise.llm.common import saved, smallest_hashes

#: Dimensions to a column block, and how many standard errors of the estimate a candidate may be off before it is given up.
BLOCK, ERRORS = 16, 2.1
#: Most different vectors, and most queries, that meet in one group.
CHUNK, QUERIES = 8192, 1024


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def turned(self, v: np.ndarray) -> np.ndarray:
        return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.rotation

    def lists(self, turned: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each vector, nearest first."""
        far = (self.centres**2).sum(1) - 2 * turned @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, v) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", v, v)))


def scan(q: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs left by the adaptive scan: for each query its k nearest of the rotated x, and what it could not give up."""
    n, dims = len(x), x.shape[1]
    seed = x[: min(n, max(4 * k, 64))]
    bound = np.full(len(q), np.inf)
    if len(seed) >= k:
        d = (q**2).sum(1)[:, None] + (seed**2).sum(1) - 2 * q @ seed.T
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
    at = min(block, dims)
    part = (q[:, :at] ** 2).sum(1)[:, None] + (x[:, :at] ** 2).sum(1) - 2 * q[:, :at] @ x[:, :at].T
    limit = lambda d: d / dims * (1 + errors / np.sqrt(d)) ** 2 if d < dims else 1 + 1e-9
    a, b = np.nonzero(part <= (bound * limit(at))[:, None] + 1e-9)
    far = part[a, b]
    while at < dims and len(a):
        to = min(at + block, dims)
        far = far + ((q[a, at:to] - x[b, at:to]) ** 2).sum(1)
        at = to
        near = far <= bound[a] * limit(at) + 1e-9
        a, b, far = a[near], b[near], far[near]
    return a, b


def fit(vectors: DataFrame, n: int, sample_rows: int = 20_000, aim: float = 0.96, rounds: int = 8) -> Index:
    """Rotation, centres and the number of lists to probe, from the sample_rows vectors with the smallest hash.

    The centres grow with the square root of n. The probes are the fewest with which 200 of the sample find at least `aim`
    of their five nearest in the sample; more vectors lie closer and need no more.
    """
    rows = smallest_hashes(vectors.select("v"), "v", sample_rows).toPandas()["v"]
    v = np.stack([np.frombuffer(x, "<f8") for x in rows]).astype(np.float64)
    rng = np.random.default_rng(7)
    turn, r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    turned = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (turn * np.sign(np.diag(r)))
    count = int(np.clip(round(np.sqrt(n) / 2), 1, max(1, min(4096, len(v) // 8))))
    centres = turned[rng.choice(len(turned), count, replace=False)]
    index = Index(turn * np.sign(np.diag(r)), centres, count)
    for _ in range(rounds):
        own = index.lists(turned, 1)[:, 0]
        size = np.bincount(own, minlength=count)
        total = np.stack([np.bincount(own, turned[:, j], count) for j in range(turned.shape[1])], 1)
        index.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], index.centres)
    own, q = index.lists(turned, 1)[:, 0], turned[:200]
    k = min(5, len(turned) - 1)
    if k:
        near = q @ turned.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = index.lists(q, count)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(count)[None, :], 1)
        needed = np.take_along_axis(place, own[best], 1) + 1
        shares = (needed[:, :, None] <= np.arange(1, count + 1)).mean((0, 1))
        index.probes = int(np.argmax(shares >= aim)) + 1
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, all components finite; of the most common length."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(ok).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    width = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()

    def raw(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [np.asarray(x, "<f8").tobytes() for x in b["e"]]})

    return rows.where(F.size("e") == (width["n"] if width else 0)).mapInPandas(raw, "vec_id long, v binary")


def _search(shared, keep: int):
    def run(key: tuple, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index, empty = shared.value, pd.DataFrame({"q": [], "v_id": [], "score": []})
        if base.empty or asked.empty:
            return empty
        x = np.stack([np.frombuffer(v, "<f8") for v in base["v"]]).astype(np.float64)
        q = np.stack([np.frombuffer(v, "<f8") for v in asked["v"]]).astype(np.float64)
        tx, tq = index.turned(x), index.turned(q)
        ids, low, out = base["v_id"].to_numpy(), base["low"].to_numpy(), []
        for at in range(0, len(q), 64):
            a, b = scan(tq[at : at + 64], tx, min(keep, len(x)))
            score = cosines(q[at + a], x[b])
            order = np.lexsort((ids[b], low[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.searchsorted(a, a)
            top = np.arange(len(a)) - first < keep
            out.append(pd.DataFrame({"q": asked["q"].to_numpy()[at + a[top]], "v_id": ids[b[top]], "score": score[top]}))
        return pd.concat(out)

    return run


def _found(base: DataFrame, asked: DataFrame, index: Index, probes: int, keep: int) -> DataFrame:
    """(q, v_id, score): per query and group the best, ties to the smaller `low`, before groups are put together."""
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def place(n: int, *names: str):
        def run(batches):
            for b in batches:
                v = np.stack([np.frombuffer(x, "<f8") for x in b["v"]]).astype(np.float64) if len(b) else np.zeros((0, len(shared.value.rotation)))
                lists = shared.value.lists(shared.value.turned(v), n) if len(b) else np.zeros((0, n), np.int64)
                at = np.repeat(np.arange(len(b)), lists.shape[1])
                yield pd.DataFrame({**{name: b[name].to_numpy()[at] for name in names}, "v": b["v"].to_numpy()[at], "list": lists.ravel()})

        return run

    base = saved(base.select("v_id", "low", "v").mapInPandas(place(1, "v_id", "low"), "v_id long, low long, v binary, list int"))
    asked = saved(asked.select("q", "v").mapInPandas(place(probes, "q"), "q long, v binary, list int"))
    part = lambda name, most: F.greatest(F.lit(1), F.ceil(F.col(name) / most)).cast("int")
    sizes = base.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("m")), "list").select("list", part("n", CHUNK).alias("chunks"), part("m", QUERIES).alias("sets"))
    sizes = F.broadcast(sizes)  # a row for each list, 4096 at most
    x = base.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("v_id"), "chunks").cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    q = asked.join(sizes, "list").withColumn("set", F.pmod(F.xxhash64("q"), "sets").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ["list", "chunk", "set"]
    return x.select(*by, "v_id", "low", "v").groupBy(*by).cogroup(q.select(*by, "q", "v").groupBy(*by)).applyInPandas(_search(shared, keep), "q long, v_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sample_rows: int = 20_000, aim: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose vec_id is divisible by `every`, itself left out.

    Largest cosine first, ties to the smaller vec_id. Equal vectors are searched once and stand for their k + 1 smallest
    ids, which is all that a rank up to k can hold. A query that its lists give fewer than k candidates is searched again
    in all lists, so each gets k, or all there are. Vectors that are null, zero, not finite or of another length than most
    take no part; none, or one alone, gives no rows. Rows count one by one, also those with equal ids or vectors: a query is every
    such row, and its candidates are all rows but itself.
    """
    ids = saved(usable(vectors.select("vec_id", "embedding")).withColumn("row", F.monotonically_increasing_id()))
    ranked = ids.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))).where(f"r <= {k + 1}")
    listed = ranked.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    first = F.col("ids")[0]
    distinct = saved(listed.select("v", first["row"].alias("v_id"), first["vec_id"].alias("low"), "ids"))
    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    index = fit(distinct, n, sample_rows, aim)
    wanted = saved(ids.where(F.col("vec_id") % every == 0))
    asked = saved(wanted.groupBy("v").agg(F.min("row").alias("q")))
    queries = wanted.join(asked, "v").select("q", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))

    def answers(found: DataFrame, queries: DataFrame) -> DataFrame:
        near = found.join(distinct.select("v_id", "ids"), "v_id").select("q", "score", F.inline("ids"))
        near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))).where(f"r <= {k + 1}")
        near = near.join(queries, "q").where("row <> query_row")
        rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
        return near.withColumn("rank", rank).where(f"rank <= {k}").select("query_row", "query_id", "rank", "vec_id", "score")

    first = saved(answers(_found(distinct, asked, index, index.probes, k + 1), queries))
    if index.probes == len(index.centres):
        return first.drop("query_row")
    enough = min(k, ids.limit(k + 1).count() - 1)
    full = first.groupBy("query_row").count().where(f"count >= {enough}").select("query_row")
    short = saved(queries.join(full, "query_row", "left_anti"))
    if short.isEmpty():
        return first.drop("query_row")
    again = answers(_found(distinct, asked.join(short.select("q").distinct(), "q", "left_semi"), index, len(index.centres), k + 1), short)
    return first.join(full, "query_row", "left_semi").unionByName(again).drop("query_row")
