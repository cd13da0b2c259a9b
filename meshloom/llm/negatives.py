"""Hard negatives by k-means inverted lists with stored radii.

Vectors become integers floor(scale * x). K-means centroids are fitted on a bounded sample; every row goes to the list of its
nearest centroid, and each list stores its radius, the greatest distance of a row from the centroid. By Cauchy-Schwarz a
row p of a list with centroid c and radius r scores between a.c - |a| r and a.c + |a| r with an anchor a. An anchor's
lists are visited by falling upper bound, those whose scores all lie outside the window asked for are skipped, and the
visit stops where the bound falls strictly below the k-th score found, so the result is exact whatever the centroids are.

In Spark this takes two passes. The first visits only the ``FIRST`` leading lists of each anchor and window; the k-th
scores found there hold back all other lists that can't matter from the second. A visit (list, the anchors that need
it) is a row, joined to the list's rows in parts of ``PART``; long lists are dealt to several keys, so one that holds a third
of all rows is spread. Tasks return k rows an anchor, window and part, and a limited window merges them. What is
broadcast are centroids, radii and sizes: ``LISTS`` at most for a number of components; no table is.

Positives are one window over the same label without bounds; the windows of the negatives follow from their scores.

Defined cases: rows with a null id, label or vector, or null or non-finite components, take no part; rows with equal id,
label and vector count once, rows with equal id and other vectors each for themselves, and a row with the anchor's id is
the anchor's own; vectors are compared with those of the same number of components, and lengths not in the sample have one
list around zero; ties go to the smaller id; anchors without positives, and positives without negatives, give no rows, so
neither do negative positive scores, whose window is empty; extra columns may have any name; empty tables give no rows.
Scores are exact; those beyond 64 bits are reported, and compared, as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few_and_heavy, settings

SCALE = 256.0
#: Rows that the centroids are fitted on, the most lists of a number of components, and rounds of k-means.
SAMPLE, LISTS, ROUNDS = 16384, 1024, 8
#: Anchors of a visit, rows of a part of a list, parts of a list under one key.
BLOCK, PART, PARTS = 256, 1024, 16
#: Lists that the first pass visits for each anchor and window.
FIRST = 4
MOST = (1 << 63) - 1
NONE = -MOST


def integer_rows(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, d array<double> of whole numbers, dims) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where(good)
    # doubles beyond 2^50 are whole; scaling may pass their range, then the greatest one stands
    top = F.lit(1.7976931348623157e308)
    whole = lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * scale).cast("double")).otherwise(F.least(F.greatest(c * scale, -top), top))
    return rows.select("vec_id", "label", F.transform("x", whole).alias("d"), F.size("x").alias("dims")).distinct()


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly picked rows."""
    x = np.clip(sample, -1e100, 1e100)
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)] if len(x) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where((size > 0)[:, None], total / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    half = 0.5 * (c * c).sum(1)
    step = max(1, (1 << 20) // len(c))
    for i in range(0, len(x), step):
        with np.errstate(all="ignore"):
            out[i : i + step] = np.nan_to_num(half - x[i : i + step] @ c.T, nan=np.inf).argmin(1)
    return out


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole doubles, as the nearest 64-bit numbers."""
    safe = 2.0**26 / max(1.0, q.shape[1] ** 0.5)  # products of such rows stay below 2^53
    big_q, big_p = (np.flatnonzero(np.abs(m).max(1, initial=0) > safe) for m in (q, p))
    with np.errstate(all="ignore"):
        out = np.nan_to_num(q @ p.T, nan=0, posinf=0, neginf=0)
    out[big_q] = 0
    out[:, big_p] = 0
    out = np.rint(out).astype(np.int64)

    def single(i, j):
        out[i, j] = min(MOST, max(NONE + 1, sum(int(a) * int(b) for a, b in zip(q[i], p[j]))))

    for i in big_q:
        for j in range(len(p)):
            single(i, j)
    for j in big_p:
        for i in range(len(q)):
            single(i, j)
    return out


def matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims) if dims else np.zeros((len(column), 0))


def runs(*keys: np.ndarray):
    """(begin, end) of the stretches of equal keys."""
    if len(keys[0]):
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(keys[0])])


class Lists:
    """The inverted lists: a table of parts, and what is known of each list on every worker."""

    def __init__(self, scratch: Scratch, rows: DataFrame, most: int = LISTS):
        spark = self.spark = scratch.spark
        self.scratch = scratch
        total = rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("dims", "d").toArrow()
        sizes = sample.column(0).to_numpy()
        fitted = {}
        for dims in np.unique(sizes).tolist():
            x = matrix(sample.column(1).combine_chunks().filter(pa.array(sizes == dims)), dims)
            fitted[dims] = centroids(x, min(most, len(x), int(np.ceil((total * len(x) / len(sizes)) ** 0.5))))
        sent = spark.sparkContext.broadcast(fitted)

        def assign(batches):
            for batch in batches:
                dims, where, far = np.asarray(batch.column(3)), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for n in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == n)
                    x, c = matrix(batch.column(2).take(pa.array(at)), n), sent.value.get(n, np.zeros((1, n)))
                    where[at] = nearest(x, c)
                    with np.errstate(all="ignore"):
                        far[at] = np.nan_to_num(np.sqrt(((x - c[where[at]]) ** 2).sum(1)), nan=np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), pa.array(far)], ["vec_id", "label", "d", "dims", "list", "far"])

        self.rows = scratch.write("assigned", rows.select("vec_id", "label", "d", "dims").mapInArrow(assign, "vec_id long, label long, d array<double>, dims int, list long, far double"))
        known = self.rows.groupBy("dims", "list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).orderBy("dims", "list").toArrow()
        about = {}
        dims = known.column(0).to_numpy()
        for a, b in runs(dims):
            at, n = known.column(1).to_numpy()[a:b], int(dims[a])
            about[n] = at, fitted.get(n, np.zeros((1, n)))[at], known.column(2).to_numpy()[a:b], known.column(3).to_numpy()[a:b]
        self.about = spark.sparkContext.broadcast(about)
        keys = ["dims", "list", "vec_id"]
        self.parts = scratch.write("parts", self.rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("dims", "list", "vec_id", "label", "d").mapInArrow(self.pack(), "dims int, list long, key long, ids array<long>, labels array<long>, d array<double>"))

    def pack(self):
        about = self.about

        def run(batches):
            for batch in batches:
                dims, where = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for a, b in runs(dims, where):
                    at, _, _, size = about.value[int(dims[a])]
                    keys = keys_of(size[np.searchsorted(at, where[a])])
                    for i in range(a, b, PART):
                        part = batch.slice(i, min(PART, b - i))
                        # any rule that spreads a list's parts over its keys will do
                        key = int(np.asarray(part.column(2))[0] & 0xFFFFFFFF) * 0x9E3779B1 % (1 << 32) % keys
                        arrays = [pa.array([int(x)]) for x in (where[a], key)]
                        yield pa.RecordBatch.from_arrays([pa.array([int(dims[a])], pa.int32()), *arrays, *(one_list(part.column(k)) for k in (2, 3)), one_list(part.column(4).flatten())], ["dims", "list", "key", "ids", "labels", "d"])

        return run

    def search(self, anchors: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        """(a, w, n, score, vec_id): the k best for each window of each anchor, n from 1; only of the leading lists if
        ``first``. anchors: a, vec_id, label, d, dims, list, windows array<struct<w, lo, hi, least>>; rows below ``least`` don't count."""
        about = self.about
        ordered = anchors.repartitionByRange("dims", "list", "a").sortWithinPartitions("dims", "list", "a").select("a", "vec_id", "label", "d", "dims", "windows")

        def visit(batches):
            for batch in batches:
                for a, b in runs(np.asarray(batch.column(4))):
                    for i in range(a, b, BLOCK):
                        yield from visits(batch.slice(i, min(BLOCK, b - i)), about.value, first)

        def score(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    yield best(batch.slice(row, 1), k, same)

        schema = "dims int, list long, key long, a array<long>, own array<long>, own_label array<long>, q array<double>, w array<int>, lo array<long>, hi array<long>, least array<long>"
        wanted = ordered.mapInArrow(visit, schema)
        found = wanted.join(self.parts, ["dims", "list", "key"]).select("dims", "a", "own", "own_label", "q", "w", "lo", "hi", "least", "ids", "labels", "d").mapInArrow(score, "a long, w int, score long, vec_id long")
        rank = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).select("a", "w", "n", "score", "vec_id")


def keys_of(size):
    """Keys that a list of so many rows is dealt to."""
    return -(-size // (PART * PARTS))


def one_list(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def score_bounds(q: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, lower, upper) of the scores of anchors (rows) with lists (columns), with room for rounding."""
    with np.errstate(all="ignore"):
        size = np.sqrt((q * q).sum(1))[:, None]
        middle = q @ c.T
        reach = size * radius * (1 + 1e-9) + 1e-9 * size * np.sqrt((c * c).sum(1)) + 1e-6
        return np.nan_to_num(middle), np.nan_to_num(middle - reach, nan=-np.inf), np.nan_to_num(middle + reach, nan=np.inf)


def needed(middle, lower, upper, lo, hi, least, first: bool) -> np.ndarray:
    """Which lists (columns) anchors (rows) visit for a window each."""
    lo, hi, least = (x.astype(np.float64)[:, None] for x in (lo, hi, least))
    room = 1e-9 * np.abs(hi) + 1e-9 * np.abs(lo)  # of numbers beyond 2^53
    bound = np.minimum(upper, hi + room)
    may = (lo <= hi) & (upper >= lo - room) & (lower <= hi + room)
    if not first:
        return may & (bound >= least - 1e-9 * np.abs(least))
    # by falling bound; of those that reach the window's top, the ones around it first
    order = np.lexsort((np.abs(middle - np.minimum(hi, 1e300)), np.where(may, -bound, np.inf)), axis=1)[:, :FIRST]
    leading = np.zeros_like(may)
    np.put_along_axis(leading, order, True, 1)
    return may & leading


def visits(block, about, first: bool):
    """Rows (dims, list, key, anchors, windows) of a block of anchors with one number of components."""
    dims = int(block.column(4)[0].as_py())
    lists, c, radius, size = about[dims]
    q, fields, counts = matrix(block.column(3), dims), block.column(5).flatten(), np.asarray(block.column(5).value_lengths())
    n, width = len(q), int(counts.max(initial=0))
    row = np.repeat(np.arange(n), counts)
    column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    w, lo, hi, least = np.zeros((n, width), np.int32), np.full((n, width), MOST), np.full((n, width), NONE), np.full((n, width), MOST)
    for name, of in (("w", w), ("lo", lo), ("hi", hi), ("least", least)):
        of[row, column] = np.asarray(fields.field(name))
    middle, lower, upper = score_bounds(q, c, radius)
    need = np.zeros(middle.shape, bool)
    for k in range(width):
        need |= needed(middle, lower, upper, lo[:, k], hi[:, k], least[:, k], first)
    for j in np.flatnonzero(need.any(0)):
        at = np.flatnonzero(need[:, j])
        pick = pa.array(at)
        own = [one_list(block.column(m).take(pick)) for m in (0, 1, 2)]
        numbers = [one_list(pa.array(x)) for x in (q[at].ravel(), *(of[at].ravel() for of in (w, lo, hi, least)))]
        for key in range(int(keys_of(size[j]))):
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([int(lists[j])]), pa.array([key]), *own, *numbers], ["dims", "list", "key", "a", "own", "own_label", "q", "w", "lo", "hi", "least"])


def best(row, k: int, same: bool):
    """The k best rows of a list's part for each window of a visit's anchors."""
    dims = row.column(0)[0].as_py()
    a, own, label, q, w, lo, hi, least, ids, labels, p = (np.asarray(row.column(i).flatten()) for i in range(1, 12))
    n, m = len(a), len(ids)
    scores = products(q.reshape(n, dims), p.reshape(m, dims))
    usable = ((label[:, None] == labels) == same) & (own[:, None] != ids)
    w, lo, hi, least = (x.reshape(n, -1) for x in (w, lo, hi, least))
    out = []
    for i in range(w.shape[1]):
        fits = usable & (scores >= np.maximum(lo[:, i], least[:, i])[:, None]) & (scores <= hi[:, i][:, None])
        value = np.where(fits, scores, NONE)
        cut = -np.partition(-value, k - 1, axis=1)[:, k - 1] if m > k else np.full(n, NONE)
        r, c = np.nonzero(fits & (value >= cut[:, None]))
        order = np.lexsort((ids[c], -value[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[keep], c[keep]
        out.append((a[r], w[r, i], value[r, c], ids[c]))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], ["a", "w", "score", "vec_id"])


def windows_of(rows: DataFrame) -> DataFrame:
    """(a, windows) of (a, w, lo, hi, least)."""
    return rows.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi", "least"))).alias("windows"))


def kth(found: DataFrame, k: int) -> DataFrame:
    """(a, w, least): the k-th scores of the windows that have so many."""
    return found.where(F.col("n") == k).select("a", "w", F.col("score").alias("least"))


def mined(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, lists: int = LISTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    ``every`` and each of its best ``positives`` of the same label, the best ``negatives`` of other labels whose score is
    ``low`` to ``high`` percent of the positive's."""
    spark = table.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.write("rows", integer_rows(table))
    # a written table of vectors is many times its file, by which Spark would choose it for a broadcast
    with few_and_heavy(spark, 64), settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        index = Lists(scratch, rows, lists)
        anchors = scratch.write("anchors", index.rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("a", F.monotonically_increasing_id()))

        def both_passes(name, asked, k, same):
            """asked: (a, w, lo, hi)"""
            none = F.lit(NONE).alias("least")
            leading = index.search(anchors.join(windows_of(asked.select("*", none)), "a"), k, same, first=True)
            leading = scratch.write(f"{name}-kth", kth(leading, k))
            known = asked.join(leading, ["a", "w"], "left").select("a", "w", "lo", "hi", F.coalesce("least", none).alias("least"))
            return scratch.write(name, index.search(anchors.join(windows_of(known), "a"), k, same, first=False))

        every_score = anchors.select("a", F.lit(0).alias("w"), F.lit(NONE).alias("lo"), F.lit(MOST).alias("hi"))
        near = both_passes("positives", every_score, positives, True)
        # exact beyond 64 bits: the products are decimals, rounded up and down
        share = lambda percent: F.col("score").cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")
        asked = near.select("a", (F.col("n") - 1).alias("w"), F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi")).where("lo <= hi")
        asked = scratch.write("asked", asked)
        far = both_passes("negatives", asked, negatives, False)
    pairs = near.select("a", (F.col("n") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # these joins run when the result is read, under settings of the caller
    pairs = pairs.join(anchors.select("a", F.col("vec_id").alias("anchor_id")).hint("merge"), "a")
    out = far.select("a", "w", F.col("n").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge").join(pairs, ["a", "w"])
    scratch.drop_but("positives", "negatives", "anchors")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, p.vec_id AS vec_id, q.label = p.label AS same,
         CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id AND len(q.v) = len(p.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND CAST(30 AS HUGEINT) * positive_score <= CAST(100 AS HUGEINT) * s.score AND CAST(100 AS HUGEINT) * s.score <= CAST(90 AS HUGEINT) * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10"""
