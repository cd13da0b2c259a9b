"""Exact top-k by inner product over norm buckets.

Vectors become integers floor(scale * x). Candidates are grouped by length (their norm) into buckets, a few powers of
a fixed ratio apart, and cut in blocks. For a query with a known lower bound t on its k-th score and a block whose
longest vector has norm m, a candidate counts only if cos(q, p) >= t / (|q| m), the block's local threshold c. If
c > 1 the block is skipped for that query. A high c calls for coordinate pruning: on the largest coordinates F of the
query's group, cos = q_F.p_F + q_R.p_R <= q_F.p_F + |q_R| |p_R| over unit vectors, so what stays under c is dropped. A low c
calls for length pruning: candidates shorter than t / |q| are dropped. Both decide for each query and candidate; the pairs
that are left are verified by whole integer products, one by one where they are few, so the result is exact.

The queries are taken in blocks of bounded size (``query_block`` rows), each broadcast against all candidates. Bounds t
come from a first pass over ``FIRST`` candidates of the longest buckets; a task returns only scores that reach its queries'
bounds, so what is shuffled doesn't grow with the tasks. Queries of one leading coordinate are searched together.

Defined cases: null vectors, and vectors that hold null or non-finite components, take no part; vectors are compared
with those of the same number of components; rows with equal id and vector count once (they are one row stored twice), rows
with equal id and other vectors each for themselves; a candidate with the query's id is the query's own; of equal scores the
smaller id comes first; a query with fewer candidates gets all of them; extra columns may have any name; empty tables give
no rows. Products are exact in 64 bits while the sum of squared components stays below 2^62; longer vectors are multiplied
as Python integers, and a score beyond 64 bits is reported, and compared, as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 256.0
#: Rows of queries broadcast at once; 64 components of 8 bytes make 4 MB.
QUERY_BLOCK = 8192
#: Queries and candidates scored at once in a task: 8 MB of scores.
QUERY_GROUP = 512
CANDIDATE_BLOCK = 2048
#: Candidates of the longest buckets that give the first bounds.
FIRST = 4096
#: Buckets are this factor apart in norm.
RATIO = 1.25
#: Stands for no score: below any product, and its negative fits 64 bits.
NONE = -(1 << 63) + 1
#: Local cosine threshold from which coordinates prune, and the share of pairs left below which these are verified singly.
COORDINATE_FROM = 0.5
SPARSE = 0.1


def integer_vectors(table: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, d array<double>, bucket int) of the rows that take part; v is null where squares pass 2^62,
    and d is null elsewhere."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), vector_col).where(good)
    # the floor of a double beyond 2^53 is itself; scaling may pass the range of doubles, then the largest double stands
    top = 1.7976931348623157e308
    whole = lambda c: F.least(F.greatest(c * scale, F.lit(-top)), F.lit(top))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * scale).cast("double")).otherwise(whole(c))).alias("d"))
    square = F.aggregate("d", F.lit(0.0), lambda a, c: a + c * c)
    fits = square < 2.0**62
    bucket = F.when(square == float("inf"), 1 << 20).when(square > 0, F.floor(F.log(F.sqrt(square)) / float(np.log(RATIO)))).otherwise(-1).cast("int")
    return rows.select("vec_id", F.when(fits, F.transform("d", lambda c: c.cast("long"))).alias("v"), F.when(~fits, F.col("d")).alias("d"), bucket.alias("bucket")).distinct()


def exact_dot(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer products; float64 multiplies them exactly where no sum can pass 2^53."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    return q @ p.T


def long_dot(q, p) -> np.ndarray:
    """Products of rows of whole-number floats or integers as Python integers, the nearest 64-bit number of each."""
    most = (1 << 63) - 1
    rows = [[int(x) for x in r] for r in q]
    out = np.empty((len(q), len(p)), np.int64)
    for j, r in enumerate(p):
        r = [int(x) for x in r]
        for i, s in enumerate(rows):
            out[i, j] = min(most, max(NONE + 1, sum(a * b for a, b in zip(s, r))))
    return out


class Searcher:
    """Keeps the k best of each query over the blocks of candidates given to it, among those that reach ``bound``."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, queries, k
        self.norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        self.unit = queries / np.maximum(self.norm, 1e-300)[:, None]
        self.score = np.full((len(ids), k), NONE)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bound = np.full(len(ids), NONE) if bound is None else bound
        self.products = 0  # whole products computed
        dims = queries.shape[1]
        # groups of queries that lead with the same coordinate, of bounded size, each with its own largest coordinates
        lead = np.abs(self.unit).argmax(1) if dims else np.zeros(len(ids), np.int64)
        order = np.lexsort((self.norm, lead))
        cuts = np.flatnonzero(np.diff(lead[order])) + 1
        parts = [g[i : i + QUERY_GROUP] for g in np.split(order, cuts) for i in range(0, len(g), QUERY_GROUP)]
        # small groups are joined: a group a coordinate is worth it only where it holds queries enough
        self.groups, held = [], []
        for g in parts:
            held.append(g)
            if sum(map(len, held)) >= QUERY_GROUP // 4:
                self.groups.append(np.concatenate(held))
                held = []
        if held:
            self.groups.append(np.concatenate(held))
        self.focus = [np.argsort(-(self.unit[g] ** 2).sum(0), kind="stable")[: max(1, dims // 4)] if dims else np.zeros(0, np.int64) for g in self.groups]

    def least(self, at: np.ndarray) -> np.ndarray:
        """Scores below these don't count."""
        return np.maximum(self.score[at, -1], self.bound[at])

    def block(self, ids: np.ndarray, p: np.ndarray) -> None:
        norm = np.sqrt((p.astype(np.float64) ** 2).sum(1))
        unit = p / np.maximum(norm, 1e-300)[:, None]
        for group, focus in zip(self.groups, self.focus):
            self.group_block(group, focus, ids, p, norm, unit)

    def group_block(self, group, focus, ids, p, norm, unit) -> None:
        least = self.least(group)
        bound = least.astype(np.float64)
        full = least > NONE
        longest = norm.max(initial=0.0)
        slack = 1 + 1e-9
        size = self.norm[group]
        # a local threshold of 0 or less prunes nothing
        local = np.where(full & (size > 0) & (longest > 0), bound / np.maximum(size * longest * slack, 1e-300), -2.0)
        local = np.where(full & (bound > 0) & ((size == 0) | (longest == 0)), 2.0, local)
        by_coordinate = np.flatnonzero((local <= 1) & (local >= COORDINATE_FROM))
        by_length = np.flatnonzero(local < COORDINATE_FROM)
        if len(by_length):
            need = np.where(full[by_length] & (bound[by_length] > 0) & (size[by_length] > 0), bound[by_length] / np.maximum(size[by_length] * slack, 1e-300), -1.0)
            self.verify(group[by_length], ids, p, norm[None, :] >= need[:, None])
        if len(by_coordinate):
            at = group[by_coordinate]
            near = self.unit[np.ix_(at, focus)]
            rest = np.sqrt(np.clip(1 - (near**2).sum(1), 0, None))
            far = np.sqrt(np.clip(1 - (unit[:, focus] ** 2).sum(1), 0, None))
            upper = (near @ unit[:, focus].T + np.outer(rest, far)) * (norm / max(longest, 1e-300)) + 1e-9
            self.verify(at, ids, p, upper >= local[by_coordinate][:, None])

    def verify(self, at: np.ndarray, ids: np.ndarray, p: np.ndarray, may: np.ndarray) -> None:
        """Whole products of the pairs that may count."""
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            return
        if may.mean() >= SPARSE:
            self.products += len(rows) * len(cols)
            self.take(at[rows], ids[cols], exact_dot(self.q[at[rows]], p[cols]))
            return
        i, j = np.nonzero(may)
        for cut in range(0, len(i), 1 << 16):
            r, c = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            self.products += len(r)
            self.pairs(at[r], ids[c], np.einsum("nd,nd->n", self.q[at[r]], p[c]))

    def take(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of all queries ``at`` with all candidates."""
        if not len(ids):
            return
        scores = np.where(ids[None, :] == self.ids[at][:, None], NONE, scores)
        cut = self.least(at)
        if len(ids) > 4 * self.k:  # the k best and all ties with the last of them
            cut = np.maximum(cut, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        rows, cols = np.nonzero((scores >= cut[:, None]) & (scores > NONE))
        self.merge(at[rows], ids[cols], scores[rows, cols])

    def pairs(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.least(at)) & (ids != self.ids[at])
        self.merge(at[keep], ids[keep], scores[keep])

    def merge(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        some = np.unique(at)
        rows = np.concatenate([np.searchsorted(some, at), np.repeat(np.arange(len(some)), self.k)])
        score = np.concatenate([scores, self.score[some].ravel()])
        who = np.concatenate([ids, self.who[some].ravel()])
        order = np.lexsort((who, -score, rows))
        rows, score, who = rows[order], score[order], who[order]
        pick = np.searchsorted(rows, np.arange(len(some)))[:, None] + np.arange(self.k)
        self.score[some], self.who[some] = score[pick], who[pick]

    def result(self):
        at, rank = np.nonzero(self.score > NONE)
        return self.ids[at], self.who[at, rank], self.score[at, rank]


class LongSearcher(Searcher):
    """The same for queries and candidates of which either is long: every product, as Python integers."""

    def __init__(self, ids: np.ndarray, queries: list, k: int):
        self.ids, self.rows, self.k, self.products = ids, queries, k, 0
        self.score = np.full((len(ids), k), NONE)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bound = np.full(len(ids), NONE)

    def block(self, ids: np.ndarray, p) -> None:
        self.products += len(self.ids) * len(ids)
        self.take(np.arange(len(self.ids)), ids, long_dot(self.rows, p))


def by_length(rows, vector: int) -> dict[int, tuple]:
    """{components: (ids, vectors)} of Arrow columns (vec_id, v, d)."""
    ids, values = np.asarray(rows.column(0)), rows.column(vector).to_pylist()
    sizes = np.array([-1 if v is None else len(v) for v in values], np.int64)
    return {int(n): (ids[sizes == n], [v for v in values if v is not None and len(v) == n]) for n in np.unique(sizes) if n >= 0}


def first_bounds(plain: dict[int, tuple], first, k: int) -> dict[int, np.ndarray]:
    """For each query its k-th best score among some candidates: no true k-th score is lower."""
    out = {}
    some = by_length(first, 1)
    for n, (ids, q) in plain.items():
        s = Searcher(ids, np.array(q, np.int64).reshape(len(q), n), k)
        who, p = some.get(n, (np.zeros(0, np.int64), []))
        p = np.array(p, np.int64).reshape(len(p), n)
        for i in range(0, len(p), CANDIDATE_BLOCK):
            s.block(who[i : i + CANDIDATE_BLOCK], p[i : i + CANDIDATE_BLOCK])
        out[n] = s.score[:, -1]
    return out


def top_k(table: DataFrame, k: int = 5, every: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.write("rows", integer_vectors(table))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    sizes = queries.agg(F.count("*")).first()[0]
    blocks = max(1, -(-sizes // query_block))
    queries = scratch.write("queries", queries.select("vec_id", "v", "d", F.pmod(F.xxhash64("vec_id", "v", "d"), F.lit(blocks)).cast("int").alias("block")))
    # A task gets whole runs of one bucket, the longest first, so that early bounds are high.
    candidates = scratch.write("candidates", rows.repartitionByRange(F.desc("bucket"), "vec_id").sortWithinPartitions(F.desc("bucket"), "vec_id").select("vec_id", "v", "d", "bucket"))
    first = candidates.where("v IS NOT NULL").orderBy(F.desc("bucket"), "vec_id").limit(FIRST).select("vec_id", "v").toArrow()
    for block in range(blocks):
        of = queries.where(F.col("block") == block).select("vec_id", "v", "d").toArrow()
        plain, large = by_length(of, 1), by_length(of, 2)
        # of every number of components: ids, vectors and bounds of plain queries, ids and vectors of long ones
        bounds = first_bounds(plain, first, k)
        sent = spark.sparkContext.broadcast(({n: (i, np.array(q, np.int64).reshape(len(q), n), bounds[n]) for n, (i, q) in plain.items()}, large))

        def run(batches, sent=sent):
            plain, large = sent.value
            search = {n: Searcher(i, q, k, b) for n, (i, q, b) in plain.items()}
            slow: dict = {}  # searchers of pairs with a long query or candidate

            def long_search(kind, n):
                if (kind, n) not in slow:
                    ids, q = large[n] if kind else plain[n][:2]
                    slow[kind, n] = LongSearcher(ids, q, k)
                return slow[kind, n]

            for batch in batches:
                ids, v = np.asarray(batch.column(0)), batch.column(1)
                bucket = np.asarray(batch.column(3))
                lengths = np.asarray(v.value_lengths().fill_null(-1))
                cut = np.concatenate(([0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (lengths[1:] != lengths[:-1])) + 1, [len(ids)]))
                for a, b in zip(cut[:-1], cut[1:]):
                    n = int(lengths[a]) if b > a else -2
                    if n == -1:
                        for m, (who, p) in by_length(batch.slice(a, b - a), 2).items():
                            for kind, known in ((0, plain), (1, large)):
                                if m in known:
                                    long_search(kind, m).block(who, p)
                    elif n >= 0 and (n in search or n in large):
                        p = np.array(v.slice(a, b - a).flatten()).reshape(b - a, n)
                        for i in range(0, b - a, CANDIDATE_BLOCK):
                            if n in search:
                                search[n].block(ids[a:b][i : i + CANDIDATE_BLOCK], p[i : i + CANDIDATE_BLOCK])
                            if n in large:
                                long_search(1, n).block(ids[a:b][i : i + CANDIDATE_BLOCK], p[i : i + CANDIDATE_BLOCK].tolist())
            for s in (*search.values(), *slow.values()):
                q, who, score = s.result()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])

        best = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
        # each task gives k rows a query at most, and few reach the first bounds; the maximum of an ordered array merges them
        ordered = lambda c: F.slice(F.sort_array(c, asc=False), 1, k)
        spread = best.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(ordered(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("less")))).alias("best"))
        folded = spread.groupBy("query_id").agg(ordered(F.flatten(F.collect_list("best"))).alias("best"))
        folded.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), (-F.col("b.less")).alias("vec_id"), F.col("b.score").alias("score")).write.mode("append").parquet(scratch.path("best"))
        sent.unpersist()
    scratch.drop("rows", "queries", "candidates")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(scratch.path("best"))
