"""Removal of lines that an earlier document holds, by two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of ``least`` code points (10) or more
count. Two filters of ``BITS`` bits hold the keys seen in a document once and twice: each task fills its own pair, where a
bit that was set in ``once`` before is set in ``twice`` too, and pairs merge bit by bit: twice = t1 | t2 | (o1 & o2), once =
o1 | o2. A key held by two documents has all its bits in ``twice``; few others have. Only those suspected keys are
shuffled, as 128-bit digests with the document's id, its smallest and greatest id confirm them exactly, and each
occurrence outside the smallest goes. Digests are pre-aggregated in each task; of the confirmed ones, those with a
thousandth of all occurrences or more (a thousand at most, so they are broadcast) are joined without a shuffle, so a line
that a third of all documents hold falls to no single task. Texts that lose no line are never shuffled.

The filters' size is fixed: some 10^7 different keys are told apart well (2 bits each), at 3 * 10^7 a sixth of the
single ones is suspected, and far beyond nearly all are. Then the digests of all lines shuffle once, as a plain grouping
would have it; results are the same.

Defined cases: a null text is empty, and an empty text is one empty line; rows with one id are one document, whatever their
texts; null ids are larger than any id, and those with equal texts are one document; ties can't be, as the smallest id is
unique; very long texts are split line by line, and very long lines are keys like others; repeated rows get their result
each; other columns are never read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sifted, text_or_empty

LEAST = 10
#: Bits of each filter, 16 MB: tasks hold two of them, one is broadcast. Bits in a row of a filter.
BITS, SEGMENT = 1 << 27, 1 << 16
SPACE = b" \t\n\x0b\x0c\r"
#: A confirmed key with this share of all suspected occurrences is joined by broadcast.
HOT_SHARE = 1000
#: Rows of an Arrow batch that are held as Python objects at once.
ROWS = 256


def line_keys(text: bytes, least: int = LEAST) -> dict[bytes, list[int]]:
    """{digest of the key: numbers of its lines} of the keys that count."""
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE).lower()  # bytes: A-Z only
        if len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "replace")) >= least):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(number)
    return found


def places(digests: np.ndarray, size: int) -> np.ndarray:
    """Bits of a filter of ``size`` (a power of two) for digests (n, 2) of uint64: one from each half."""
    return (digests & np.uint64(size - 1)).astype(np.int64)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def add(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def see(once: np.ndarray, twice: np.ndarray, digests: np.ndarray) -> None:
    """Adds a document's different keys, or those of several documents one after the other."""
    at, count = np.unique(places(digests, 8 * len(once)), return_counts=True)
    add(twice, at[has(once, at) | (count > 1)])
    add(once, at)


def row_keys(batch, text: int):
    """(row, keys of its text) of a batch, a few rows' texts at a time."""
    for i in range(0, batch.num_rows, ROWS):
        for k, value in enumerate(batch.column(text).slice(i, ROWS).to_pylist()):
            yield i + k, line_keys(value)


def repeated_bits(texts: DataFrame, size: int = BITS) -> np.ndarray:
    """The filter ``twice`` of all documents, of ``size`` bits."""
    step = SEGMENT // 8

    def fill(batches):
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        held = []
        for batch in batches:
            for _, keys in row_keys(batch, 0):
                held.extend(keys)
                if len(held) > 1 << 16:
                    see(once, twice, np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2))
                    held = []
        if held:
            see(once, twice, np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2))
        used = np.flatnonzero(once.reshape(-1, step).any(1))
        for i in range(0, len(used), 64):
            at = used[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array([b[s * step : (s + 1) * step].tobytes() for s in at]) for b in (once, twice))], ["segment", "once", "twice"])

    def merge(batches):
        now: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if s in now:
                    once, twice = now[s]
                    o, t = once | o, twice | t | (once & o)
                now[s] = o, t
        rows = [(s, t.tobytes()) for s, (_, t) in now.items() if t.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["segment", "twice"])

    parts = texts.select("text").mapInArrow(fill, "segment long, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(merge, "segment long, twice binary").toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for s, t in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()):
        bits[s * step : (s + 1) * step] = np.frombuffer(t, np.uint8)
    return bits


def suspects(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, g, doc, t, numbers): keys, as two halves of a digest, whose bits are all set, with their lines in a text."""
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def find(batches):
        twice = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            rows, numbers, digests = [], [], []
            for k, keys in row_keys(batch, 2):
                rows.extend([k] * len(keys))
                numbers.extend(keys.values())
                digests.extend(keys)
            both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            pick = np.flatnonzero(has(twice, places(both, 8 * len(twice))).all(1))
            at, halves = np.array(rows, np.int64)[pick], both[pick].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([numbers[i] for i in pick], pa.list_(pa.int32()))], ["h", "g", "doc", "t", "numbers"]
            )

    return texts.select("doc", "t", "text").mapInArrow(find, "h long, g long, doc long, t long, numbers array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, t, text bytes, doc_id): doc orders the documents, t tells texts of one id apart."""
    text = text_or_empty()
    h = F.xxhash64(text)
    nameless = F.lit(1 << 62) + h.bitwiseAND(F.lit((1 << 61) - 1))
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, nameless).alias("doc"), h.alias("t"), F.encode(text, "UTF-8").alias("text"), own.alias("doc_id"))


def deduplicated(docs: DataFrame, size: int = BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept (bytes) of every row."""
    scratch = Scratch(docs.sparkSession, "lines")
    texts = keyed(docs)
    found = scratch.write("suspects", suspects(texts, repeated_bits(texts, size)))
    keys = found.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    keys = scratch.write("keys", keys.where("first < last").select("h", "g", "first", "n"))
    least = found.count() // HOT_SHARE + 1
    hot, rest = keys.where(F.col("n") >= least).drop("n"), keys.where(F.col("n") < least).drop("n")
    # at most HOT_SHARE keys have so many of the occurrences
    marked = found.join(F.broadcast(hot), ["h", "g"], "left")
    later = marked.where(F.col("first").isNotNull()).unionByName(marked.where(F.col("first").isNull()).drop("first").join(rest, ["h", "g"]))
    gone = later.where("doc <> first").groupBy("doc", "t").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    gone = scratch.write("gone", gone)
    scratch.drop("suspects", "keys")

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                total, dropped, digest, kept = [], [], [], []
                for text, numbers in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    lines, out = text.split(b"\n"), set(numbers or ())
                    kept.append(b"\n".join([line for k, line in enumerate(lines) if k not in out]))
                    total.append(len(lines))
                    dropped.append(len(out))
                    digest.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary"
    hit = sifted(scratch, texts, gone, "gone").join(gone, ["doc", "t"], "left").select("doc_id", "text", "numbers").mapInArrow(cut, schema)
    whole = F.col("text").cast("string")
    breaks = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
    miss = sifted(scratch, texts, gone, "gone", inside=False)
    miss = miss.select("doc_id", (breaks + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    return hit.unionByName(miss)


LINES_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
