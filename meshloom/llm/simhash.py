"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: text -> ASCII lower case -> words between ASCII white space -> shingles -> XXH64; a bit is set when
set in over half of the shingle hashes. Linking: the 64 bits are cut in six blocks; two fingerprints within 3 bits agree
wholly on three blocks (pigeonhole), so each of the 20 choices of three is a table, and rows that agree on its 32 bits
form a bucket. A bucket is compared vertically: plane b holds bit
b of 64 fingerprints a machine word, one XOR gives bit b of 64 differences, carry-save counters add these up, and a
word is abandoned once all of its 64 distances exceed the radius.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; rows
with equal fingerprints are one group whatever their ids; a null doc_id keeps its row, and never becomes a component's
id unless the whole component has null ids; repeated rows come back as often as they came; of ties the smallest id
names the component; very long texts are hashed whole, in pieces; extra columns may have any name; empty tables give none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_row, connected_components, text_or_empty

SEED = 42
#: Fingerprints of a bucket that meet in one task at most (two such blocks); larger buckets are cut in blocks.
BLOCK = 1024
#: Shingles hashed at once, to bound memory for very long texts.
PIECE = 1 << 16


def simhash(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE)
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp) of every row: h is the text's hash, fp its fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit i of row b, counted from the lowest bit of its first word, is bit b of fingerprint i."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    padded[:n] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int, at_once: int = 1 << 17):
    """Yields arrays (i, j), i < j < ends[i], of the positions whose fingerprints differ in at most radius bits.

    ends[i]: where the bucket of position i ends. Compares position i with whole words of 64 positions.
    """
    n = len(fps)
    if n < 2:
        return
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    planes = bit_planes(fps)
    width = radius.bit_length()
    start = (1 << width) - 1 - radius  # the counters begin here and run over at radius + 1
    first = np.arange(n) // 64
    spans = np.maximum((ends - 1) // 64 - first + 1, 0)
    spans[ends - np.arange(n) < 2] = 0
    begin = 0
    cum = np.cumsum(spans)
    while begin < n:
        base = cum[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(cum, base + at_once, "right")))
        size = spans[begin:stop]
        q = np.repeat(np.arange(begin, stop), size)
        if not len(q):
            begin = stop
            continue
        word = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + first[q]
        over = np.zeros(len(q), np.uint64)
        low = q - word * 64 + 1  # bits below this belong to earlier positions
        over |= np.where(low >= 64, full, np.where(low > 0, (np.uint64(1) << np.clip(low, 0, 63).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
        high = ends[q] - word * 64  # bits from this on belong to later buckets
        over |= np.where(high >= 64, np.uint64(0), full << np.clip(high, 0, 63).astype(np.uint64))
        own = fps[q]
        counters = [np.full(len(q), full if start >> c & 1 else np.uint64(0)) for c in range(width)]
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - (own >> np.uint64(b) & np.uint64(1)))
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if b >= 7 and b % 4 == 3:
                alive = np.flatnonzero(over != full)
                if not len(alive):
                    break
                if len(alive) < 0.75 * len(q):
                    q, word, own, over = q[alive], word[alive], own[alive], over[alive]
                    counters = [c[alive] for c in counters]
        alive = np.flatnonzero(over != full)
        if len(alive):
            hit, bit = np.nonzero(np.unpackbits((~over[alive]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[alive][hit], word[alive][hit] * 64 + bit
        begin = stop


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; label[x] <= x is the smallest member of x's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up := label[label], label):
            label = up


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bits of each choice of ``blocks - radius`` blocks, as signed 64-bit masks: two fingerprints within the radius agree
    on one choice at least."""
    if radius >= blocks:
        raise ValueError("the radius must be less than the number of blocks")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:])]
    masks = [sum(chosen) for chosen in itertools.combinations(whole, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(scratch: Scratch, distinct: DataFrame, radius: int = 3, blocks: int = 6, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that connect all pairs within the radius.

    Six blocks and a radius of 3 make 20 tables with keys of 32 bits or more, so buckets stay small up to 2^32 rows.
    Within a bucket only a star from each class's smallest member is returned, so that thousands of near copies give
    as many links, not their square. A bucket of over ``block`` rows is cut in g blocks by hash, and each pair of
    blocks meets in a task of its own, which compares all of their rows: exact, and no task holds over two blocks.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius, blocks)])
    rows = distinct.select("fp", F.posexplode(masks).alias("band", "mask")).select("fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = scratch.write("counts", rows.groupBy("band", "key").count().where("count > 1"))
    rows = rows.join(counts, ["band", "key"]).withColumn("g", F.ceil(F.col("count") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("band", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    keys = ["band", "key", "lo", "hi"]

    def run(batches):
        rest = None
        for batch in batches:
            part = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)])
            rest = part if rest is None else np.concatenate([rest, part], axis=1)
            if rest.shape[1] >= 1 << 15:
                new = np.flatnonzero((rest[:4, 1:] != rest[:4, :-1]).any(0)) + 1
                if len(new):
                    yield from links(rest[:, : new[-1]])
                    rest = rest[:, new[-1] :]
        if rest is not None and rest.shape[1]:
            yield from links(rest)

    def links(part):
        fps = np.ascontiguousarray(part[4]).view(np.uint64)
        n = len(fps)
        new = np.concatenate(([0], np.flatnonzero((part[:4, 1:] != part[:4, :-1]).any(0)) + 1, [n]))
        ends = np.repeat(new[1:], np.diff(new))
        label = np.arange(n)
        for a, b in close_pairs(fps, ends, radius):
            label = merge(label, a, b)
        hung = np.flatnonzero(label != np.arange(n))
        signed = fps.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[hung]), pa.array(signed[label[hung]])], ["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long")


def classes(scratch: Scratch, own: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``own``: root names the class, a fingerprint of it."""
    distinct = scratch.write("distinct", own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.write("edges", near_links(scratch, distinct.select("fp"), radius, blocks).distinct())
    roots = scratch.write("roots", connected_components(scratch, edges))
    named = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write("named", named)
    moved = scratch.write("moved", roots.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id"))
    of = distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    of = scratch.write("of", of)
    scratch.drop("counts", "edges", "roots", "named", "moved", "distinct")
    return of


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest doc_id reachable by links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write("own", fingerprints(docs, shingle))
    of = classes(scratch, own, radius, blocks)
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 6) -> DataFrame:
    """One row of each group, all columns of ``docs``: the smallest doc_id (null last), then the smallest text hash;
    of rows equal in both, any one."""
    scratch = Scratch(docs.sparkSession, "representatives")
    own = scratch.write("own", fingerprints(docs, shingle))
    of = classes(scratch, own, radius, blocks)
    first = own.join(of, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("w"))
    first = scratch.write("first", first.select(F.coalesce("w.doc_id", F.lit(0)).alias("key_id"), F.col("w.none").alias("key_none"), F.col("w.h").alias("key_h")))
    keys = ["key_id", "key_none", "key_h"]
    keyed = docs.select(as_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_none"), F.xxhash64(text_or_empty()).alias("key_h"))
    return keyed.join(first, keys).groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
