"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts become lower-case words. The n-grams of the benchmark items (five words) are the seeds. A document and an item
are aligned when they share a seed, in however many documents it stands, unless fewer than ``least`` of the item's words
occur around the shared seeds at all: the score cannot be above that share, so nothing is lost. Words align locally with
+1 for a match and -1 for a mismatch or a gap; the score over the item's word count is 1 for a whole copy, and edits
lower it. A document is contaminated at ``least`` or more.

The benchmark's seeds are broadcast in slices of bounded size (``slice_chars`` characters of items), one pass over the
documents for each slice, or over those that a bitmap of all seeds lets through, where there are many slices; documents
are never shuffled.

Defined cases: null and empty texts match nothing; items of fewer than n words take no part; repeated rows come back
as often as they came, and repeated items count once; of an item's equal scores the earliest place counts; very long texts are
searched whole; null ids stay null; extra columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_row, sifted, text_or_empty
from .words import batches_of, grams, words_of

NGRAM = 5
LEAST = 0.5
SLICE_CHARS = 16 << 20
#: Bits of the bitmap of all seeds that spares documents without any the passes of many slices: 8 MB.
SEED_BITS = 26


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of the short word sequence a within b: score, and where it starts and ends in b."""

    def best(a, b):
        at = np.arange(1, len(b) + 1)
        row, top, where = np.zeros(len(b) + 1, np.int64), 0, 0
        for word in a:
            new = np.maximum(row[:-1] + np.where(b == word, 1, -1), row[1:] - 1)
            # gaps in a: the best of new[k] - (j - k) over k <= j
            new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + at) - at, 0)
            row = np.concatenate(([0], new))
            j = int(row.argmax())
            if row[j] > top:
                top, where = int(row[j]), j
        return top, where

    score, end = best(a, b)
    if not score:
        return 0, 0, 0
    _, back = best(a[::-1], b[:end][::-1])
    return score, end - back, end


class Seeds:
    """The n-grams of a slice of the benchmark: hash and item of each, sorted, and the words and id of each item."""

    def __init__(self, hash: np.ndarray, item: np.ndarray, words: list[np.ndarray], ids: list[int | None]):
        self.hash, self.item, self.words, self.ids = hash, item, words, ids

    @classmethod
    def of(cls, items: list[tuple[int | None, bytes]], n: int = NGRAM) -> Seeds:
        words = words_of([t for _, t in items])
        at, h = grams(words, n)
        order = np.lexsort((words.owner[at], h))
        h, item = h[order], words.owner[at][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        bounds = np.searchsorted(words.owner, np.arange(1, len(items)))
        return cls(h[new], item[new], np.split(words.hash, bounds), [i for i, _ in items])

    def parts(self) -> tuple:
        """Plain values that workers can read without this module."""
        return self.hash, self.item, self.words, self.ids

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, index of the seed) of every match."""
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        some = np.flatnonzero(hi > lo)
        size = (hi - lo)[some]
        return np.repeat(some, size), np.repeat(lo[some] - np.cumsum(size) + size, size) + np.arange(size.sum())


def found_in(seeds: Seeds, text: bytes, words: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, seed: np.ndarray, least: float):
    """(item, score, first, last character) of the benchmark items that one document holds; at: word positions."""
    for item in np.unique(seeds.item[seed]):
        mine = seeds.item[seed] == item
        target = seeds.words[item]
        n, places = len(target), np.unique(at[mine])
        cuts = np.flatnonzero(np.diff(places) > 2 * n) + 1
        best = (0, 0, 0)
        for part in np.split(places, cuts):
            lo, hi = max(0, part[0] - 2 * n), min(len(words), part[-1] + 2 * n)
            if np.isin(target, words[lo:hi]).sum() < least * n:  # each match takes a word of the item: a bound on the score
                continue
            score, a, b = align(target, words[lo:hi])
            best = max(best, (score, -(lo + a), lo + b))
        score, a, b = best[0] / n, -best[1], best[2]
        if score >= least:
            first, last = int(start[a]), int(end[b - 1])
            chars = len(text[:first].decode("utf-8", "ignore"))
            yield seeds.ids[item], score, chars, chars + len(text[first:last].decode("utf-8", "ignore"))


FOUND = "doc_id long, item_id long, score double, start long, end long"


def seeded(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The rows that may hold a seed of any item: a bitmap of all seeds, of bounded size, decides."""

    def of_items(batches):
        for batch in batches:
            _, h = grams(words_of(batch.column(1).cast(pa.binary()).to_pylist()), n)
            h = h & np.uint64((1 << SEED_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int32)), pa.array(np.uint64(1) << (h & np.uint64(63))).view(pa.int64())], ["word", "bits"])

    table = items.mapInArrow(of_items, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (SEED_BITS - 6), np.int64)
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bitmap = sent.value.view(np.uint64)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keep = np.zeros(len(texts), bool)
            for i, j in batches_of(texts):
                words = words_of(texts[i:j])
                at, h = grams(words, n)
                h = h & np.uint64((1 << SEED_BITS) - 1)
                hit = bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
                keep[i + words.owner[at[hit > 0]]] = True
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, least: float = LEAST, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, score, start, end): documents and the items they hold; start and end in code points."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(text_or_empty()).alias("text")).distinct()
    chars, = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slices = max(1, -(-chars // slice_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty()).alias("text"))
    if slices > 1:  # documents without any seed are read once, not once a slice
        rows = scratch.write("seeded", seeded(rows, items, n))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").toArrow()
        seeds = Seeds.of([(i, t.encode()) for i, t in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist())], n)
        sent = spark.sparkContext.broadcast(seeds.parts())

        def match(batches, sent=sent):
            seeds = Seeds(*sent.value)
            for batch in batches:
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                out = []
                for i, j in batches_of(texts):
                    words = words_of(texts[i:j])
                    at, h = grams(words, n)
                    where, seed = seeds.hits(h)
                    at = at[where]
                    owner = words.owner[at]
                    for d in np.unique(owner):
                        a, b = np.searchsorted(words.owner, [d, d + 1])
                        mine = owner == d
                        rows = found_in(seeds, texts[i + d], words.hash[a:b], words.start[a:b], words.end[a:b], at[mine] - a, seed[mine], least)
                        out += [(batch.column(0)[int(i + d)].as_py(), *r) for r in rows]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "start", "end"])

        rows.mapInArrow(match, FOUND).write.mode("append").parquet(scratch.path("found"))
        sent.unpersist()
    scratch.drop("seeded")
    return spark.read.schema(FOUND).parquet(scratch.path("found"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text holds no benchmark item; a row that shares its id, null or not, with others isn't judged by
    them. Rows that a bitmap of the bad ones holds back are never shuffled."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    rows = docs.select(as_row(docs), F.xxhash64("doc_id", text_or_empty()).alias("doc_id"), text_or_empty().alias("text"))
    bad = scratch.write("bad", contaminated(rows.select("doc_id", "text"), benchmark).select("doc_id").distinct())
    rows = rows.select("row", "doc_id")
    maybe = sifted(scratch, rows, bad, "bad", ("doc_id",)).join(bad, "doc_id", "left_anti").select("row.*")
    return sifted(scratch, rows, bad, "bad", ("doc_id",), inside=False).select("row.*").unionByName(maybe)
