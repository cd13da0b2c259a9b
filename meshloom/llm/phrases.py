"""Collocations from generalised suffix automata, one per shard and language, cut at five words.

A shard's automaton recognises the runs of up to ``DEPTH`` words of its pieces. Its states are classes of runs that end at
the same places; a state stores its longest run, the length of its shortest one, the number of its ends (endpos) and its
suffix link, the state of the next shorter suffix. As depth is bounded, the states are made by sorting the ends by their
words read backwards: groups of equal backward runs are the nodes of the reversed suffix tree, and a node with as many ends
as its only child is of the child's class. A state gives one row, its longest run with shortest length and count; these
unfold along the class into counts of every run, which one grouping adds up over all shards. A candidate is subsumed if
a run longer by one word occurs as often: its first word dropped is the suffix link of that run, its last word dropped the
mirror of it. Longer ones needn't be looked at: a run between two equally frequent ones is as frequent.

What can't reach ``least`` (100) occurrences is held back before automata are built, each by a bitmap of fixed size that
lets all through that may: a word must be frequent itself (counted exactly by hash), and a run must fall in a bucket of
the counters that, over all shards, has been hit so often, as must all runs inside it. The counters are 2^25 bytes a task, the
bitmaps 4 MB each. Past some 5 GB of text the buckets fill and hold back less, so more rows reach the grouping; the counts
are exact at any size, but for two words of a shard, or of the corpus's frequent ones, with one 64-bit hash.

Defined cases: null texts are empty, null languages ``und``; each row counts, repeated ones too, and ids are not read; texts
without words give nothing; very long texts are cut into shards between pieces, so that memory is bounded by the shard and
the longest piece; ties go to the more frequent, then to the phrase first in byte order, and cuts of equal score to the
shortest first part; extra columns are never read; empty tables give no rows. Scores are exact up to counts of 10^15 and
10^17 words a language.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .words import BACK, STEP, mix, powers

DEPTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text of a shard, and those hashed at once.
SHARD, CHUNK = 1 << 23, 1 << 20
#: Counters of runs and bits of a bitmap; counters that travel as one row.
COUNTERS, SEGMENT = 1 << 25, 1 << 16
#: Bytes that end a piece, and those that part words inside one.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

END = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]")
#: Piece ends become line feeds, white space inside pieces spaces.
PLAIN = bytes(10 if c in PIECE_ENDS else 32 if c in SPACES else c for c in range(256))


class Run(NamedTuple):
    """Words of a shard in order: hashes, pieces, and with ``names`` the bytes of each hash."""

    hash: np.ndarray
    piece: np.ndarray
    names: dict[int, bytes]


def stretches(text: bytes):
    """The text in parts of about CHUNK bytes, cut after a piece."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        end = END.search(text, at + CHUNK)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def words_in(parts: list[bytes], salt: int, named: bool) -> Run:
    """The words of the parts, lower-cased; ``salt`` tells languages apart."""
    hashes, pieces, names, last = [], [], {}, 0
    held, size = [], 0
    for k, part in enumerate(parts):
        held.append(part.lower().translate(PLAIN))  # bytes: A-Z only
        size += len(part)
        if size < CHUNK and k + 1 < len(parts):
            continue
        joined = b"\n".join([b"", *held, b""])
        held, size = [], 0
        flat = np.frombuffer(joined, np.uint8)
        end = flat == 10
        gap = np.flatnonzero(end | (flat == 32))
        a, b = gap[:-1] + 1, gap[1:]
        a, b = a[b > a], b[b > a]
        total = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(BACK, len(flat)), dtype=np.uint64)))
        h = mix((total[b] - total[a]) * powers(STEP, len(flat))[a] + np.uint64(salt))
        hashes.append(h)
        pieces.append(np.cumsum(end)[a] + last)
        last += int(end.sum())
        if named:
            each, first = np.unique(h, return_index=True)
            for x, i, j in zip(each.tolist(), a[first].tolist(), b[first].tolist()):
                if x not in names:
                    names[x] = joined[i:j]
    return Run(np.concatenate(hashes), np.concatenate(pieces), names) if hashes else Run(np.zeros(0, np.uint64), np.zeros(0, np.int64), names)


def shards(batches, named: bool = False):
    """(language, words) of the rows (lang, text) of Arrow batches, of about SHARD bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            salt = int.from_bytes(lang.encode()[:64].ljust(8, b"\0"), "little") % (1 << 61) + len(lang)
            yield lang, words_in(parts, int(mix(np.array([salt], np.uint64))[0]), named)

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for piece in stretches(text):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size >= SHARD:
                        yield from out()
                        held, size = {}, 0
    yield from out()


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(COUNTERS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def frequent_words(run: Run, bits: np.ndarray) -> Run:
    """The words that may be frequent; a word left out ends a piece."""
    keep = has(bits, run.hash)
    piece = np.cumsum(~keep | np.concatenate(([False], run.piece[1:] != run.piece[:-1])))
    return Run(run.hash[keep], piece[keep], run.names)


def grams(run: Run, depth: int = DEPTH):
    """For n from 2 on: (whether the n words ending at each word are in one piece, their hash)."""
    h = run.hash
    before = h
    for n in range(2, depth + 1):
        inside = np.zeros(len(h), bool)
        inside[n - 1 :] = run.piece[n - 1 :] == run.piece[: max(0, len(h) - n + 1)]
        now = np.zeros(len(h), np.uint64)
        # the n words ending here: the n - 1 that end one word before, and this one
        now[1:] = (before[:-1] + np.uint64(n)) * np.uint64(STEP) + h[1:]
        before = now
        yield inside, mix(now)


class Automaton(NamedTuple):
    """States: length of the longest run, of the shortest, ends, one place where it ends, state of the suffix link (or -1)."""

    length: np.ndarray
    least: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray


def automaton(word: np.ndarray, reach: np.ndarray, depth: int = DEPTH) -> Automaton:
    """Of a sequence of word numbers; ``reach``: how many words ending at each place count (0: none)."""
    places = np.flatnonzero(reach > 0)
    back = np.full((depth, len(places)), -1, np.int64)
    for d in range(depth):
        at = reach[places] > d
        back[d, at] = word[places[at] - d]
    order = np.lexsort(back[::-1])
    back, places = back[:, order], places[order]
    differs = np.zeros(len(places), bool)
    node, count, first = [], [], []
    for d in range(depth):
        differs[1:] |= back[d, 1:] != back[d, :-1]
        differs[:1] = True
        at = np.flatnonzero(back[d] >= 0)
        # the first place of a group that is deep enough starts a node
        starts = differs[at] | np.concatenate((np.ones(min(1, len(at)), bool), back[d, at[1:] - 1] < 0))
        group = np.cumsum(starts) - 1
        own = np.full(len(places), -1)
        own[at] = group
        node.append(own)
        count.append(np.bincount(group) if len(group) else np.zeros(0, np.int64))
        first.append(at[starts])
    # a node with as many ends as a child is of the child's class
    absorbed = [np.zeros(len(c), bool) for c in count]
    least = [np.full(len(c), d + 1) for d, c in enumerate(count)]
    parent = [np.zeros(0, np.int64)]
    for d in range(1, depth):
        up = node[d - 1][first[d]]
        same = count[d - 1][up] == count[d]
        absorbed[d - 1][up[same]] = True
        least[d][same] = least[d - 1][up[same]]
        parent.append(up)
    number, state, total = [np.full(len(c), -1) for c in count], [], 0
    for d in range(depth):
        top = np.flatnonzero(~absorbed[d])
        number[d][top] = np.arange(total, total + len(top))
        total += len(top)
        state.append(top)
    link = []
    for d in range(depth):
        to = np.full(len(state[d]), -1)
        at = state[d]
        for e in range(d, 0, -1):  # up to the node above the shortest run, which ends its own class
            leaves = least[d][state[d]] == e + 1
            at = parent[e][at]
            to[leaves] = number[e - 1][at[leaves]]
        link.append(to)
    join = lambda xs: np.concatenate([x[s] for x, s in zip(xs, state)])
    return Automaton(np.repeat(np.arange(1, depth + 1), [len(s) for s in state]), join(least), join(count), places[join(first)], np.concatenate(link))


def reach_of(run: Run, bits: np.ndarray | None, depth: int = DEPTH) -> np.ndarray:
    """How many words ending at each word count: all runs inside them may be frequent."""
    out = np.ones(len(run.hash), np.int64)
    ok = np.ones(len(run.hash), bool)
    for inside, h in grams(run, depth):
        before = np.concatenate(([False], ok[:-1]))
        ok = ok & before & inside
        if bits is not None:
            ok[ok] = has(bits, h[ok])
        out += ok
    return out


def states(run: Run, bits: np.ndarray | None, depth: int = DEPTH):
    """(run of words, least, count) of each state of a shard."""
    each, word = np.unique(run.hash, return_inverse=True)
    a = automaton(word, reach_of(run, bits, depth), depth)
    name = [run.names[h] for h in each.tolist()]
    for n, least, count, end in zip(a.length.tolist(), a.least.tolist(), a.count.tolist(), a.end.tolist()):
        yield b" ".join([name[w] for w in word[end - n + 1 : end + 1].tolist()]).decode("utf-8", "replace"), least, count


def bitmap(h: DataFrame) -> np.ndarray:
    """Bits of the hashes in column h, which may be many: at most 2^19 rows come of them."""
    low = F.col("h").bitwiseAND(F.lit(COUNTERS - 1))
    rows = h.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(COUNTERS // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out.view(np.uint8)


def count_words(batches):
    for _, run in shards(batches):
        h, count = np.unique(run.hash, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], ["h", "count"])


def run_bitmap(texts: DataFrame, words, least: int, depth: int) -> np.ndarray:
    """Bits of the buckets that runs of frequent words hit ``least`` times or more."""
    most = min(least, 255)

    def fill(batches):
        counters = np.zeros(COUNTERS, np.uint8)
        bits = np.frombuffer(words.value, np.uint8)
        for _, run in shards(batches):
            for inside, h in grams(frequent_words(run, bits), depth):
                at, count = np.unique((h[inside] & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
                counters[at] = np.minimum(counters[at] + count, most)
        for s in range(0, COUNTERS, SEGMENT):
            at = np.flatnonzero(counters[s : s + SEGMENT])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s // SEGMENT]), pa.array([at.astype("<u2").tobytes()]), pa.array([counters[s + at].tobytes()])], ["segment", "at", "count"])

    def merge(batches):
        now: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, count in zip(*(c.to_pylist() for c in batch.columns)):
                sums = now.setdefault(s, np.zeros(SEGMENT, np.uint8))
                at = np.frombuffer(at, "<u2")
                sums[at] = np.minimum(sums[at].astype(np.int64) + np.frombuffer(count, np.uint8), most)
        for s, sums in now.items():
            if (sums >= most).any():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(sums >= most, bitorder="little").tobytes()])], ["segment", "bits"])

    parts = texts.mapInArrow(fill, "segment long, at binary, count binary").repartition("segment")
    merged = parts.mapInArrow(merge, "segment long, bits binary").toArrow()
    out, step = np.zeros(COUNTERS // 8, np.uint8), SEGMENT // 8
    for s, b in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()):
        out[s * step : (s + 1) * step] = np.frombuffer(b, np.uint8)
    return out


def run_counts(texts: DataFrame, words, runs, depth: int) -> DataFrame:
    """(lang, phrase, f) of the runs that may be frequent, and (lang, null, n) of all words."""

    def build(batches):
        first, second = np.frombuffer(words.value, np.uint8), np.frombuffer(runs.value, np.uint8)
        for lang, run in shards(batches, named=True):
            rows = [(None, 0, len(run.hash)), *states(frequent_words(run, first), second, depth)]
            for i in range(0, len(rows), 1 << 14):
                phrase, least, count = zip(*rows[i : i + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase)), pa.array(phrase, pa.string()), pa.array(least, pa.int32()), pa.array(count, pa.int64())], ["lang", "phrase", "least", "count"])

    found = texts.mapInArrow(build, "lang string, phrase string, least int, count long")
    suffix = F.expr("CASE WHEN phrase IS NULL THEN array(phrase) ELSE transform(sequence(least, regexp_count(phrase, ' ') + 1), k -> substring_index(phrase, ' ', -k)) END")
    return found.select("lang", F.explode(suffix).alias("phrase"), "count").groupBy("lang", "phrase").agg(F.sum("count").alias("f"))


def mined(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    counted = texts.mapInArrow(count_words, "h long, count long").groupBy("h").agg(F.sum("count").alias("f"))
    words = spark.sparkContext.broadcast(bitmap(counted.where(F.col("f") >= least)).tobytes())
    runs = spark.sparkContext.broadcast(run_bitmap(texts, words, least, depth).tobytes())
    counts = scratch.write("counts", run_counts(texts, words, runs, depth).where((F.col("f") >= least) | F.col("phrase").isNull()))
    totals = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    counts = counts.where("phrase IS NOT NULL")
    found = counts.select("lang", "phrase", F.col("f").alias("a"), (F.regexp_count("phrase", F.lit(" ")) + 1).alias("size")).where("size > 1")
    found = scratch.write("found", found)
    # what is left of a run without its first word (its suffix link) and without its last
    shorter = F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - size)"), F.expr("substring_index(phrase, ' ', size - 1)"))).alias("phrase")
    longer = found.where("size > 2").select("lang", shorter, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(a AS decimal(15, 0)) * cast(1000 AS decimal(4, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inner_ AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m) WHERE m < size AND i + m - 1 <= size
), kept AS (
  SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL) USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
  FROM kept, (SELECT unnest(range(1, 5)) AS k) WHERE k < size
), s AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, cuts.k,
         CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
