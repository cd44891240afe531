"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash of a unit vector: three rounds of random signs and a fast Hadamard transform (a pseudo-rotation), then the
nearest signed axis. Where these are too few, further pseudo-rotations make the hash finer, as many as the number of vectors
asks for; of the last only the first axes count, so that buckets keep their size at any scale. A query
probes, besides its own bucket, those next in the order of its projections. Index rows and probing queries of a bucket
meet in groups of bounded size (large buckets are split on both sides), which pass on the best of each query; these are
reranked exactly on the original vectors.

Equal vectors are one entry with a bounded number of ids, so a vector that a third of the rows share costs as much as any
other. Queries for which too few candidates turn up are compared with all vectors, in blocks of queries.

How many buckets are probed follows from the data: a bounded sample of queries is compared with all vectors, and the order
in which the sample would probe the buckets of its true neighbours says how many probes find enough of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.llm.common import materialize, small_side
from driftwarden.session import scratch_path

#: Hash tables, least number of buckets probed in each, and least number of vectors aimed at per bucket.
TABLES, PROBES, BUCKET_ROWS = 10, 8, 512
SEED = 5
#: Index rows, and queries, of one bucket that meet in a group.
GROUP_ROWS = 4096
#: Queries compared with all vectors at once, where candidates are too few.
BLOCK = 512
#: Queries whose true neighbours are looked up, the share of them that the probes must find, and the probes beyond which
#: buckets are made larger instead.
SAMPLE, AIM, MOST_PROBES = 128, 0.95, 32
#: Costs of buckets held at once.
COSTS = 1 << 22


def usable(vector: Column) -> Column:
    """Neither NULL, nor all zero, nor holding NULL or a non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform along the last axis, a power of two long, scaled to keep lengths."""
    shape, n, h = x.shape, x.shape[-1], 1
    while h < n:
        x = x.reshape(*shape[:-1], n // (2 * h), 2, h)
        x = np.stack([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], axis=-2)
        h *= 2
    return x.reshape(shape) / np.sqrt(n)


class CrossPolytope:
    """The hash functions of ``tables`` tables over vectors of ``dim`` components."""

    def __init__(self, dim: int, rows: int, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> None:
        self.dim, self.size = dim, 1 << max(0, dim - 1).bit_length()
        wanted = max(1.0, rows / bucket_rows)
        #: Axes that count in each part of the hash.
        self.axes = [int(min(self.size, max(1, 2 ** np.ceil(np.log2(wanted) - 1))))]
        while (wanted := wanted / (2 * self.size)) > 1:
            self.axes.append(int(min(self.size, max(1, 2 ** np.round(np.log2(wanted) - 1)))))
        self.fine = self.axes[1] if len(self.axes) > 1 else 0
        draw = np.random.default_rng(seed)
        self.signs = draw.choice([-1.0, 1.0], (tables, max(2, len(self.axes)), 3, self.size))
        self.count = int(np.prod([2 * a for a in self.axes], dtype=object))

    def projections(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Signed projections ``n x 2 axes`` of each part of the hash; the nearest axis has the largest."""
        x = np.zeros((len(vectors), self.size))
        x[:, :self.dim] = vectors
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for part, axes in enumerate(self.axes):
            y = x
            for signs in self.signs[table, part]:
                y = hadamard(y * signs)
            out.append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
        return out

    def buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        number = np.zeros(len(vectors), np.int64)
        for axes, part in zip(self.axes, self.projections(vectors, table)):
            number = number * 2 * axes + part.argmax(axis=1)
        return number

    def probes(self, vectors: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` likeliest buckets of each vector, by the squared distance that its projections would have to move.

        Parts are added one by one: the least sums are among the least of what came before and the least of the part.
        """
        number, cost = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
        for axes, part in zip(self.axes, self.projections(vectors, table)):
            moved = (part.max(axis=1, keepdims=True) - part) ** 2
            least = np.argsort(moved, axis=1, kind="stable")[:, :most]
            both = (cost[:, :, None] + np.take_along_axis(moved, least, 1)[:, None, :]).reshape(len(vectors), -1)
            numbers = (number[:, :, None] * 2 * axes + least[:, None, :]).reshape(len(vectors), -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :most]
            number, cost = np.take_along_axis(numbers, best, 1), np.take_along_axis(both, best, 1)
        return number

    def held(self, most: int) -> int:
        """Most costs that ``probes`` holds for a vector at once."""
        kept, largest = 1, 1
        for axes in self.axes:
            largest = max(largest, kept * min(most, 2 * axes))
            kept = min(most, kept * 2 * axes)
        return largest


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _buckets(vectors: DataFrame, hashes: CrossPolytope, probes: int | None, carry: bool) -> DataFrame:
    """``(bucket, rep)``, with the vector if carried, of all tables; a bucket's number includes its table."""
    step = max(1, min(4096, COSTS // hashes.held(probes or 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column(1), hashes.dim)
                for table in range(len(hashes.signs)):
                    b = hashes.probes(x, table, probes) if probes else hashes.buckets(x, table)[:, None]
                    rows = pa.array(np.repeat(np.arange(len(x)), b.shape[1]))
                    out = [pa.array((b + table * hashes.count).ravel()), *[c.take(rows) for c in part.columns[:1 + carry]]]
                    yield pa.RecordBatch.from_arrays(out, ["bucket", "rep", "vector"][:2 + carry])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("rep", "vector").mapInArrow(run, "bucket long, rep long" + f", vector {kind}" * carry)


def _candidates(reps: DataFrame, asked: DataFrame, hashes: CrossPolytope, probes: int, k: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(q, rep)``: per query the ``k + 1`` best of all probed buckets."""
    count = lambda v, p, name: _buckets(v, hashes, p, False).groupBy("bucket").agg(
        F.ceil(F.count("*") / group_rows).cast("int").alias(name))
    parts = small_side(materialize(count(reps, None, "s").join(count(asked, probes, "r"), "bucket"), "bucket-parts"))
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = _buckets(reps, hashes, None, True).join(parts, "bucket").select("bucket", part("s").alias("i"), every(F.col("r")).alias("j"), "rep", "vector")
    probing = _buckets(asked, hashes, probes, True).join(parts, "bucket").select("bucket", every(F.col("s")).alias("i"), part("r").alias("j"), "rep", "vector")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        left = left.sort_values("rep")
        reps, x = left["rep"].to_numpy(np.int64), np.stack(left["vector"]).astype(np.float64)
        out = []
        for at in range(0, len(right), 256):
            block = right.iloc[at:at + 256]
            scores = np.stack(block["vector"]).astype(np.float64) @ x.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k + 1]
            out.append(pd.DataFrame({"q": np.repeat(block["rep"].to_numpy(np.int64), best.shape[1]), "rep": reps[best].ravel(),
                                     "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out)

    keys = ["bucket", "i", "j"]
    scored = index.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInPandas(score, "q long, rep long, score double")
    best = scored.groupBy("q", "rep").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "rep"))
    return best.withColumn("rn", rank).where(f"rn <= {k + 1}").select("q", "rep")


def _inner_product(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(np.einsum("ij,ij->i", np.stack(a).astype(np.float64), np.stack(b).astype(np.float64)))


def _best(pairs: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``pairs (q, rep, score)`` to the ``k`` best rows of every query id; limits are applied before rows are multiplied."""
    per_q = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    top = pairs.withColumn("rn", F.row_number().over(per_q)).where(f"rn <= {k + 1}").drop("rn")
    # k + 1 different vectors hold the k best rows; of each, the k + 1 smallest ids are enough
    rows = top.join(members, "rep").withColumn("rn", F.row_number().over(
        Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(f"rn <= {k + 1}").drop("rn", "rep")
    ranked = rows.join(queries.select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id")), "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ranked.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _against_all(short: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame | None:
    """``(q, rep, score)`` of the queries ``short (q, vector)`` with every vector, the ``k + 1`` best of each task.

    The driver holds one block of queries at a time, and each block's result is written before the next one, so neither its
    memory nor the plan grows with their number.
    """
    path, after = scratch_path(vectors.sparkSession, "against-all"), None
    while True:
        block = (short if after is None else short.where(F.col("q") > after)).orderBy("q").limit(BLOCK).toPandas()
        if not len(block):
            return None if after is None else vectors.sparkSession.read.schema("q long, rep long, score double").parquet(path)
        ids, x = block["q"].to_numpy(np.int64), np.stack(block["vector"]).astype(np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps, scores = batch.column(0).to_numpy(), _matrix(batch.column(1), dim) @ x.T
                order = np.lexsort((np.broadcast_to(reps[:, None], scores.shape).T, -scores.T), axis=1)[:, :k + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, order.shape[1])), pa.array(reps[order].ravel()),
                    pa.array(np.take_along_axis(scores.T, order, 1).ravel())], ["q", "rep", "score"])

        vectors.select("rep", "vector").mapInArrow(run, "q long, rep long, score double").write.mode("append").parquet(path)
        after = int(ids[-1])


def probes_needed(hashes: CrossPolytope, asked: np.ndarray, true: list[np.ndarray], aim: float = AIM) -> int:
    """Fewest probes at which some table meets the share ``aim`` of the vectors ``true[i]`` of each query ``asked[i]``.

    One more than ``MOST_PROBES`` where those do not.
    """
    ranks = []
    for x, found in zip(asked, true):
        first = np.full(len(found), MOST_PROBES)
        for table in range(len(hashes.signs)):
            met = hashes.buckets(found, table)[:, None] == hashes.probes(x[None], table, MOST_PROBES)
            first = np.minimum(first, np.where(met.any(axis=1), met.argmax(axis=1), MOST_PROBES))
        ranks.append(first)
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    return int(ranks[int(np.ceil(aim * len(ranks))) - 1]) + 1 if len(ranks) else 1


def fitted(dim: int, n: int, tables: int, bucket_rows: int, seed: int, asked: np.ndarray, true: list[np.ndarray]) -> tuple[CrossPolytope, int]:
    """Hash functions and probes that find ``AIM`` of the sample's true neighbours; one table is enough where that takes all of its buckets."""
    while True:
        hashes = CrossPolytope(dim, n, tables, bucket_rows, seed)
        probes = max(PROBES, probes_needed(hashes, asked, true))
        if probes >= hashes.count <= MOST_PROBES:
            return CrossPolytope(dim, n, 1, bucket_rows, seed), hashes.count
        if probes <= MOST_PROBES:
            return hashes, probes
        bucket_rows *= 2


def _true_neighbours(asked: DataFrame, reps: DataFrame, dim: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A sample of queries and the ``k`` nearest other vectors of each."""
    sample = materialize(asked.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select(F.col("rep").alias("q"), "vector"), "sample")
    every = _against_all(sample, reps, dim, k)
    if every is None:
        return np.zeros((0, dim)), []
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "rep"))
    best = materialize(every.where("q <> rep").withColumn("rn", rank).where(f"rn <= {k}").select("q", "rep"), "sample-best")
    found = reps.join(F.broadcast(best), "rep").select("q", "vector").toPandas()
    of = {q: np.stack(g["vector"]).astype(np.float64) for q, g in found.groupby("q")}
    rows = sample.toPandas()
    return np.stack(rows["vector"]).astype(np.float64), [of.get(q, np.zeros((0, dim))) for q in rows["q"]]


def nearest(rows: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, probes: int | None = None,
            bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """``rows (vec_id, vector)`` to ``(query_id, rank, vec_id, score)``: the ``k`` nearest of rows whose id ``every`` divides.

    The score is the inner product in double precision; ties go to the smaller vec_id. Vectors that are NULL, zero, or hold
    NULL or a non-finite component, and rows without an id, take no part. Repeated rows of one id count once. All vectors
    must have one length; an empty table gives no rows. Without ``probes`` as many buckets are probed as a sample of the
    queries needs.
    """
    clean = materialize(rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", "vector").distinct(), "vectors")
    reps = materialize(clean.groupBy("vector").agg(F.min("vec_id").alias("rep")), "distinct-vectors")
    n, dim = reps.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = materialize(clean.join(reps, "vector").select("rep", "vec_id"), "members")
    queries = members.where(F.col("vec_id") % every == 0)
    # an id that occurs with several vectors is several rows; of each vector the smallest ids are enough
    few = members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(f"rn <= {k + 1}").drop("rn")
    asked = materialize(reps.join(queries.select("rep").distinct(), "rep", "left_semi"), "queries")
    if probes:
        hashes = CrossPolytope(dim, n, tables, bucket_rows, seed)
    else:
        hashes, probes = fitted(dim, n, tables, bucket_rows, seed, *_true_neighbours(asked, reps, dim, k))
    pairs = materialize(_candidates(reps, asked, hashes, probes, k), "candidates")
    scored = pairs.join(reps, "rep").join(asked.select(F.col("rep").alias("q"), F.col("vector").alias("asked")), "q").select(
        "q", "rep", F.pandas_udf(_inner_product, "double")("asked", "vector").alias("score"))
    found = materialize(_best(scored, few, queries, k), "neighbours")
    total = clean.count()
    lacking = queries.join(found.groupBy("query_id").count(), F.expr(f"vec_id = query_id AND count >= {min(k, total - 1)}"), "left_anti")
    lacking = materialize(lacking.join(asked, "rep").select(F.col("rep").alias("q"), "vec_id", "vector"), "lacking")
    rest = _against_all(lacking.select("q", "vector").dropDuplicates(["q"]), reps, dim, k)
    if rest is None:
        return found
    again = _best(rest, few, lacking.select(F.col("q").alias("rep"), "vec_id"), k)
    return found.join(lacking.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
