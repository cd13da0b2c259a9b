"""Near copies for the pipeline: SimHash candidates over five-word shingles, then exact Jaccard.

Texts -> ASCII lower case -> words between ASCII white space -> the set of their five-word shingles (a shorter text is
one shingle). Two texts are linked when their sets have a Jaccard similarity of ``least`` (0.8) or more; a group is what
links connect. op10's contract (three words, radius 3) isn't touched by the values here.

Candidates meet in one of ``BANDS`` buckets, each keyed by ``ROWS`` minimum hashes of the set: at Jaccard 0.8 a pair
meets with probability 1 - (1 - 0.8^5)^20 = 0.9996. Buckets connect to components (stars, no pairs). Within a component
64-bit SimHash fingerprints are compared bit-sliced; ``RADIUS`` 24 lies far above the 10 bits that differ on average at
Jaccard 0.8. Each pair within it, of classes not linked yet, is held against the whole sets. Components of over
``BLOCK`` sets are cut in blocks, and each pair of blocks meets in a task of its own.

Defined cases: a null text counts as empty; texts without words are one group; texts with equal sets are one group
whatever their ids; a null doc_id is chosen only where a group has no other; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_row, connected_components, text_or_empty
from .simhash import close_pairs, merge
from .words import STEP, batches_of, grams, mix, words_of

SHINGLE = 5
LEAST = 0.8
RADIUS = 24
BANDS = 20
ROWS = 5
BLOCK = 256
#: White space becomes a space, all else stays.
SPACES = bytes(32 if chr(c).isspace() and c < 128 and c not in (28, 29, 30, 31) else c for c in range(256))
_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
FLIP, FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): text i has the sorted distinct shingle hashes from bounds[i] to bounds[i + 1]."""
    words = words_of([t.lower() for t in texts], SPACES)
    at, h = grams(words, k)
    owner = words.owner[at]
    count = np.bincount(words.owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(words.owner, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = i < count[short]
            whole[more] = whole[more] * np.uint64(STEP) + words.hash[first[more] + i]
        owner, h = np.concatenate((owner, short)), np.concatenate((h, mix(whole)))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[new], h[new]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), h


def features(texts: list[bytes], banded: bool = True):
    """(nodes, fingerprints, band keys, bounds, hashes) of texts; a node names a set, 0 the empty one."""
    bounds, h = shingle_sets(texts)
    some = np.flatnonzero(np.diff(bounds))
    node, fp = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    if len(some):
        start = bounds[some]
        node[some] = mix(np.add.reduceat(mix(h ^ np.uint64(STEP)), start))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        fp[some] = np.packbits(ones * 2 > np.diff(bounds)[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        for band in range(BANDS if banded else 0):
            key = np.zeros(len(some), np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                key = key * np.uint64(STEP) + np.minimum.reduceat((h ^ FLIP[i]) * FACTOR[i], start)
            keys[some, band] = mix(key)
    return node, fp, keys, bounds, h


def links_of(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS):
    """Links (u, v) that connect all pairs of the sets within the radius whose Jaccard similarity is ``least`` or more."""
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    nodes, fps, sets = nodes[order], np.ascontiguousarray(fps[order]), [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    values, index = np.unique(flat, return_inverse=True)
    label = np.arange(n)
    mark = np.zeros(len(values), np.int32)
    for a, b in close_pairs(fps, np.full(n, n), radius):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        for i, js in zip(a[first], np.split(b, first[1:])):
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            own = index[start[i] : start[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[index], start)[js]
            mark[own] = 0
            js = js[both >= least * (size[i] + size[js] - both) - 1e-9]
            if len(js):
                label = merge(label, np.full(len(js), i), js)
    hung = np.flatnonzero(label != np.arange(n))
    return nodes[hung], nodes[label[hung]]


def near_links(scratch: Scratch, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links of sets (root, n, node, fp, set): n is the number of sets of the component ``root``."""
    rows = rows.withColumn("g", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "fp", "set")
    keys = ["root", "lo", "hi"]

    def run(batches):
        key, held = None, []

        def settle():
            if len(held) > 1:
                nodes, fps = (np.array(c, np.int64) for c in list(zip(*held))[:2])
                u, v = links_of(nodes, fps.view(np.uint64), [np.frombuffer(s, np.uint64) for _, _, s in held])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for *now, node, fp, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    yield from settle()
                    key, held = now, []
                held.append((node, fp, hashes))
        yield from settle()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns of ``docs``: the smallest doc_id (null last), then the smallest text hash;
    of rows equal in both, any one."""
    scratch = Scratch(docs.sparkSession, "near")

    def banded(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in batches_of(texts, 1 << 20):
                node, _, keys, _, _ = features(texts[i:j])
                keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(node.view(np.int64)), keys], ["doc_id", "h", "node", "keys"])

    def whole(batches):
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for i, j in batches_of(texts, 1 << 20):
                _, fp, _, bounds, h = features(texts[i:j], False)
                sets = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(3)), pa.array(fp.view(np.int64)), pa.array(sets, pa.binary())], ["root", "n", "node", "fp", "set"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    own = scratch.write("own", own.mapInArrow(banded, "doc_id long, h long, node long, keys array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    sets = scratch.write("sets", own.groupBy("node").agg(F.min(F.struct(row.alias("w"), "keys")).alias("m")).select("node", "m.w", "m.keys"))
    rows = sets.select("node", F.posexplode("keys").alias("band", "key"))
    heads = rows.groupBy("band", "key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = rows.join(heads, ["band", "key"]).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    met = scratch.write("met", connected_components(scratch, scratch.write("edges", edges), "met-cc"))
    key_of = lambda w: [F.coalesce(F.col(f"{w}doc_id").cast("long"), F.lit(0)).alias("key_id"), F.col(f"{w}doc_id").isNull().alias("key_none")]
    keys = ["key_id", "key_none", "key_h"]
    sizes = scratch.write("sizes", met.groupBy("root").agg(F.count("*").alias("n")))  # written: else the count would take the join's exchange, unsummed
    members = met.join(sizes, "root").join(sets, "node").select("root", "n", "node", *key_of("w."), F.col("w.h").alias("key_h"))
    members = scratch.write("members", members)
    texts = docs.select(*key_of(""), F.xxhash64(text_or_empty()).alias("key_h"), text_or_empty().alias("text"))
    texts = texts.join(members, keys).select("root", "n", "node", "text")
    hashes = scratch.write("hashes", texts.mapInArrow(whole, "root long, n long, node long, fp long, set binary").dropDuplicates(["node"]))
    links = scratch.write("links", near_links(scratch, hashes).distinct())
    roots = scratch.write("roots", connected_components(scratch, links))
    of = sets.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "w")
    first = of.groupBy("root").agg(F.min("w").alias("w")).select(*key_of("w."), F.col("w.h").alias("key_h"))
    first = scratch.write("first", first)
    scratch.drop("own", "sets", "edges", "met", "sizes", "members", "hashes", "links", "roots")
    keyed = docs.select(as_row(docs), *key_of(""), F.xxhash64(text_or_empty()).alias("key_h"))
    return keyed.join(first, keys).groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
