"""Exact removal of repeated byte strings by grouped hashes of their windows, in place of a suffix array.

No suffix order, longest previous factors or smaller neighbours are computed: what decides is only whether a window of
``length`` bytes stood earlier, which is equality of truncated suffixes and the order of their places.

A byte goes when a string of ``length`` bytes (100) that covers it also starts earlier: in a document with a smaller
id, or before in the same one. So a suffix matters only up to its first ``length`` bytes. Suffixes equal that far lie
side by side in suffix order; ordered by place within such a run, a suffix has an earlier match of ``length`` bytes exactly
if it isn't first in its run: the first copy stays, later ones go. Runs are found without the order, in two levels.
1. Each suffix belongs to an anchor: the smallest hash among the ``seed``-byte strings in its first ``length`` bytes.
   Equal prefixes have equal anchors. Runs of suffixes with one anchor travel as one row: the anchor's hash, the hash
   of all the bytes of the run, and the place. Rows are range-partitioned by (anchor, bytes, place), which cuts hot keys
   across tasks, and sorted. Rows equal in both hashes to an earlier one are all later copies. Anchors whose rows differ
   (or lie at the edge of a task) may still share some suffixes.
2. Of these, one row of each kind unfolds into its suffixes, sorted by the hash of their prefixes and place, and each
   that isn't first of its run is a later copy. What runs across the edges of tasks is settled by one row an edge.

Whole runs are compared by 128 bits of hashes, single suffixes by one 64-bit hash of the bytes they share with their
neighbours in the cell and 7 bytes as they are. The flagged starts of a document meet its text once, at the end.

Defined cases: a null text is empty; null ids count as larger than any id, rows with equal null-id texts as one
document; rows with equal id and text are one document, and each gets its result; rows with equal id but different
texts are ordered by a 24-bit hash of the text; very long texts are hashed in pieces of half a MB that overlap, so every
window counts; other columns are never read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sifted, text_or_empty
from .words import BACK, STEP, mix, powers

LENGTH = 100
SEED = 36
#: Bytes of text hashed at once; positions within fit the low bits of a hash.
PIECE = 1 << 19
#: Rows of an Arrow batch that are held as Python objects at once.
ROWS = 1024

#: A random value for each byte, from a fixed rule.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


class Hashes:
    """Hashes of all substrings of a run of bytes, as differences of prefix sums scaled to their start."""

    def __init__(self, flat: np.ndarray):
        self.up = powers(STEP, len(flat) + 1)
        total = np.cumsum(BYTE[flat] * powers(BACK, len(flat)), dtype=np.uint64)
        self.total = np.concatenate(([np.uint64(0)], total))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.up[start] + (end - start).astype(np.uint64))


def pieces(texts: list[bytes], length: int = LENGTH):
    """(bytes, text number, offset in the text) of stretches that hold each window of ``length`` bytes once.

    Short texts share a piece, long ones are cut; yields (flat, owner of each window start or -1, offset of it).
    """
    parts, size = [], 0

    def out():
        flat = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        owner, at = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        i = 0
        for k, off, p in parts:
            n = max(0, len(p) - length + 1)
            owner[i : i + n] = k
            at[i : i + n] = np.arange(off, off + n)
            i += len(p)
        return flat, owner, at

    for k, text in enumerate(texts):
        for off in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[off : off + PIECE + length - 1]
            if parts and size + len(part) > PIECE:
                yield out()
                parts, size = [], 0
            parts.append((k, off, part))
            size += len(part)
    if parts:
        yield out()


def anchor_runs(texts: list[bytes], length: int = LENGTH, seed: int = SEED):
    """Yields (text, first start, starts - 1, anchor hash, hash of all bytes) of the runs of windows, as arrays."""
    window = length - seed + 1
    low = np.uint64((1 << 22) - 1)
    for flat, owner, at in pieces(texts, length):
        if len(flat) < length:
            continue
        hashes = Hashes(flat)
        start = np.arange(len(flat) - seed + 1)
        grams = hashes.of(start, start + seed)
        least = (grams & ~low) | start.astype(np.uint64)
        width = 1
        while width * 2 <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        where = (least & low).astype(np.int64)
        own = owner[: len(where)]
        new = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (own[1:] != own[:-1]))))
        last = np.concatenate((new[1:], [len(where)])) - 1
        good = own[new] >= 0
        new, last = new[good], last[good]
        if len(new):
            anchor = grams[where[new]]
            # the anchor's place within the run is part of what must be equal
            whole = mix(hashes.of(new, last + length) ^ ((where[new] - new).astype(np.uint64) << np.uint64(8)) ^ (last - new).astype(np.uint64))
            yield own[new], at[new], last - new, anchor, whole


#: Windows of a run whose offsets from the anchor share a cell of 8 have a core in common, and at most 7 bytes beside it.
CELL = 8


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, t, text bytes, doc_id): doc and t order the documents, and name them."""
    text = text_or_empty()
    nameless = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc"), F.crc32(F.encode(text, "UTF-8")).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("t"), F.encode(text, "UTF-8").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def sorted_groups(batches, keys: int, most: int = 1 << 16):
    """Yields (columns, first, last) of runs of whole groups, equal in the first ``keys`` long columns, of a sorted
    stream; first and last say whether the run begins or ends with a group at the edge of the task."""
    held, size, opened = [], 0, True

    def joined():
        return [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(c) for c in batch.columns])
        size += batch.num_rows
        if size >= most:
            cols = joined()
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) + 1
            if len(new):
                yield [c[: new[-1]] for c in cols], opened, False
                opened = False
                cols = [c[new[-1] :] for c in cols]
            held, size = [cols], len(cols[0])
            most = max(most, 2 * size)
    if held:
        yield joined(), opened, True


def changes(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; true for the first."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return out


def places_among(bounds: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each row of ``keys`` how many of the sorted rows of ``bounds`` aren't above it, compared column by column."""
    out = np.searchsorted(bounds[0], keys[0], "left")
    if not len(bounds[0]):
        return out
    tied = np.flatnonzero(bounds[0][np.minimum(out, len(bounds[0]) - 1)] == keys[0])
    if len(tied) and len(keys) > 1:
        hot = np.isin(bounds[0], keys[0][tied])
        few = [b[hot] for b in bounds]
        own = np.concatenate((np.zeros(len(few[0])), np.ones(len(tied))))  # of equal rows the bound comes first
        order = np.lexsort((own, *(np.concatenate((b, k[tied])) for b, k in zip(few[::-1], keys[::-1]))))
        upto = np.cumsum(own[order] == 0)[own[order] == 1]
        before = np.searchsorted(few[0], keys[0][tied], "left")
        out[tied[order[own[order] == 1] - len(few[0])]] += upto - before[order[own[order] == 1] - len(few[0])]
    return out


def ranged(texts: DataFrame, work, schema: str, keys: list[str], split: int) -> DataFrame:
    """The rows that ``work`` (for mapInArrow) makes of ``texts``, range-partitioned by the first ``split`` keys, all
    long and at the same columns, and sorted by ``keys`` within partitions.

    The ranges come from some documents (four for each partition, 4000 at least), so that the whole corpus is worked on
    once; repartitionByRange would do it a second time for its own sample.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, max(4000, 4 * parts) / max(1, texts.count()))
    few = max(16, -(-120 * parts // max(1, texts.rdd.getNumPartitions())))

    def some_keys(batches):
        """At most ``few`` rows of a task, so that the driver gets a bounded number, and no task gets all."""
        rows = [np.stack([np.asarray(batch.column(i)) for i in range(split)]) for batch in work(batches)]
        if rows:
            rows = np.concatenate(rows, axis=1)
            pick = np.random.default_rng(1).permutation(rows.shape[1])[:few]
            yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in rows], keys[:split])

    some = texts.sample(share, seed=1).mapInArrow(some_keys, ", ".join(f"{k} long" for k in keys[:split])).toArrow()
    columns = [c.to_numpy() for c in some.columns]
    order = np.lexsort(columns[::-1])
    order = order[(np.arange(1, parts) * len(order)) // parts] if len(order) else order
    bounds = [c[order] for c in columns]

    def dealt(batches):
        for batch in work(batches):
            part = places_among(bounds, [np.asarray(batch.column(i)) for i in range(split)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "range"])

    rows = texts.mapInArrow(dealt, f"{schema}, range int")
    return rows.repartitionById(parts, F.col("range")).drop("range").sortWithinPartitions(*keys)


def level_one(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(kind, h, doc, p): runs that are later copies (0), and one of each kind of run where an anchor's runs differ (1).

    p packs t, the first start and the number of further starts: t << 39 | start << 7 | starts - 1.
    """

    def anchors(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                doc, t = np.asarray(part.column(0)), np.asarray(part.column(1)).astype(np.int64)
                for own, at, more, anchor, whole in anchor_runs(part.column(2).to_pylist(), length, seed):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc[own]), pa.array(t[own] << 39 | at << 7 | more)], ["h", "f", "doc", "p"])

    def compare(batches):
        for (h, f, doc, p), first, last in sorted_groups(batches, 1):
            once = changes(h, f, doc, p)  # repeated rows are one document
            h, f, doc, p = h[once], f[once], doc[once], p[once]
            new_h, new = changes(h), changes(h, f)
            group = np.cumsum(new_h) - 1
            differ = np.bincount(group, new) > 1
            if first:
                differ[0] = True
            if last:
                differ[-1] = True
            for kind, at in ((0, np.flatnonzero(~new)), (1, np.flatnonzero(new & differ[group]))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(h[at]), pa.array(doc[at]), pa.array(p[at])], ["kind", "h", "doc", "p"])

    rows = ranged(texts.select("doc", "t", "text"), anchors, "h long, f long, doc long, p long", ["h", "f", "doc", "p"], 4)
    return rows.mapInArrow(compare, "kind int, h long, doc long, p long")


def cells_of(flat: np.ndarray, h: np.ndarray, a: np.ndarray, n: np.ndarray, stop: np.ndarray, length: int, seed: int):
    """Cells of the runs with anchor hash h, first start a, further starts n, in texts that stop at ``stop``: number of
    the run, core hash, where the core starts, and the bytes left and right of it; bits 56 to 61 of left hold the first
    and last window of the cell."""
    hashes = Hashes(flat)
    tries = (a + n)[:, None] + np.arange(length - seed + 1)
    inside = tries <= np.minimum(a + length - seed, stop - seed)[:, None]
    at = np.where(inside, tries, 0)
    same = (hashes.of(at, at + seed) == h.view(np.uint64)[:, None]) & inside
    anchor = tries[np.arange(len(a)), same.argmax(1)]
    out = []
    for c in range((length - seed) // CELL + 1):
        core = anchor - CELL * c  # windows of this cell start 0 to 7 bytes before
        lo, hi = np.maximum(core - (a + n), 0), np.minimum(core - a, CELL - 1)
        ok = np.flatnonzero(lo <= hi)
        if not len(ok):
            continue
        core, lo, hi = core[ok], lo[ok], hi[ok]
        end = core + length - CELL + 1
        left, right = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
        for k in range(CELL - 1):
            # bytes that no window of the cell reaches are zero, so none is read beyond the text
            left |= np.where(k < hi, flat[np.maximum(core - 1 - k, 0)], 0).astype(np.int64) << (8 * k)
            right |= np.where(k < CELL - 1 - lo, flat[np.minimum(end + k, len(flat) - 1)], 0).astype(np.int64) << (8 * k)
        hashed = mix(hashes.of(core, end) ^ np.uint64(c + 1))
        out.append((ok, hashed.view(np.int64), core, left | (lo << 59) | (hi << 56), right))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def level_two(scratch: Scratch, texts: DataFrame, runs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc, t, a, n) of single windows that are later copies, among the runs of kind 1."""
    wanted = runs.where("kind = 1").select("doc", F.shiftright("p", 39).cast("int").alias("t"), "h", "p").groupBy("doc", "t").agg(F.collect_list(F.struct("h", "p")).alias("runs"))
    wanted = scratch.write("wanted", wanted)
    some = sifted(scratch, texts, wanted, "wanted")
    joined = some.join(wanted, ["doc", "t"]).select("doc", "t", "text", "runs").dropDuplicates(["doc", "t"])

    def unfold(batches):
        for batch in batches:
            docs, ts = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            offsets, inner = np.asarray(batch.column(3).offsets), batch.column(3).values
            h, p = np.asarray(inner.field(0)), np.asarray(inner.field(1))
            start, more = p >> 7 & 0xFFFFFFFF, p & 127
            held, size = [], 0  # (row, runs, offset of the part in its text, part)

            def out():
                flat = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
                base = np.cumsum([0, *(len(x[3]) for x in held)])
                which = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
                runs = np.concatenate([x[1] for x in held])
                off, row = np.array([x[2] for x in held])[which], np.array([x[0] for x in held])[which]
                run, core, at, left, right = cells_of(flat, h[runs], start[runs] - off + base[which], more[runs], base[which + 1], length, seed)
                place = at - base[which[run]] + off[run]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (core, docs[row[run]], ts[row[run]] << 32 | place, left, right)], ["core", "doc", "q", "l", "r"])

            for k in range(batch.num_rows):
                text, own = batch.column(2)[k].as_py(), np.arange(offsets[k], offsets[k + 1])
                for off in range(0, len(text), PIECE):
                    mine = own[(start[own] >= off) & (start[own] < off + PIECE)]
                    if len(mine):
                        part = text[off : off + PIECE + 4 * length]
                        held.append((k, mine, off, part))
                        size += len(part)
                        if size >= PIECE:
                            yield out()
                            held, size = [], 0
            if held:
                yield out()

    def compare(batches):
        """Later windows (kind 0), and the first windows of the groups at a task's edges (kind 1)."""
        for (core, doc, q, left, right), first, last in sorted_groups(batches, 1):
            once = changes(core, doc, q, left, right)
            core, doc, q, left, right = core[once], doc[once], q[once], left[once], right[once]
            group = np.cumsum(changes(core)) - 1
            size = np.bincount(group)
            edge = np.zeros(len(size), bool)
            edge[:1], edge[-1:] = first, last
            use = np.flatnonzero((size > 1)[group] | edge[group])
            lo, hi = left[use] >> 59 & 7, left[use] >> 56 & 7
            for j in range(CELL):
                at = use[(lo <= j) & (j <= hi)]
                x, y = left[at] & ((1 << 8 * j) - 1), right[at] & ((1 << 8 * (CELL - 1 - j)) - 1)
                order = np.lexsort((at, y, x, core[at]))
                at, x, y = at[order], x[order], y[order]
                if not len(at):
                    continue
                new = changes(core[at], x, y)
                for kind, pick in ((0, ~new), (1, new & edge[group[at]])):
                    k = at[pick]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(core[k]), pa.array(np.full(len(k), j, np.int32)), pa.array(x[pick]), pa.array(y[pick]), pa.array(doc[k]), pa.array(q[k])], ["kind", "core", "j", "x", "y", "doc", "q"])

    keys = ["core", "doc", "q"]
    cells = scratch.write("cells", joined.mapInArrow(unfold, "core long, doc long, q long, l long, r long"))  # else unfolded twice, for the ranges' sample too
    cells = cells.repartitionByRange(*keys).sortWithinPartitions(*keys)
    windows = scratch.write("windows", cells.mapInArrow(compare, "kind int, core long, j int, x long, y long, doc long, q long"))
    edges = windows.where("kind = 1")
    same = ["core", "j", "x", "y"]
    firsts = edges.groupBy(*same).agg(F.min(F.struct("doc", "q")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = scratch.write("firsts", firsts)
    later = edges.join(firsts, same).where(F.struct("doc", "q") > F.col("least")).select("doc", "q", "j")
    later = windows.where("kind = 0").select("doc", "q", "j").unionByName(later)
    return later.select("doc", F.shiftright("q", 32).cast("int").alias("t"), (F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("j")).alias("a"), F.lit(0).cast("long").alias("n"))


def removed_spans(start: np.ndarray, more: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [begin, end) of a document whose windows start .. start + more are later copies."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], (start + more + length)[order]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[new], np.concatenate((reach[new[1:] - 1], reach[-1:]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[Scratch, DataFrame, DataFrame]:
    """The scratch tables, the keyed documents, and (doc, t, starts array<struct<a, n>>) of those with later copies."""
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = keyed(docs)
    runs = scratch.write("runs", level_one(texts, length, seed))
    whole = runs.where("kind = 0").select("doc", F.shiftright("p", 39).cast("int").alias("t"), F.expr("shiftright(p, 7) & 4294967295").alias("a"), F.expr("p & 127").cast("long").alias("n"))
    single = level_two(scratch, texts, runs, length, seed)
    flagged = whole.unionByName(single).groupBy("doc", "t").agg(F.collect_set(F.struct("a", "n")).alias("starts"))
    flagged = scratch.write("flagged", flagged)
    scratch.drop_but("flagged")
    return scratch, texts, flagged


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (removed [begin, end) in bytes)."""
    scratch, texts, flagged = repeated_spans(docs, length, seed)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin:long,end:long>>"
    kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, starts in zip(batch.column(0), batch.column(1), batch.column(2)):
                text, starts = text.as_py(), starts.values
                begin, end = (np.zeros(0, np.int64),) * 2
                if starts is not None and len(starts):
                    begin, end = removed_spans(np.asarray(starts.field(0)), np.asarray(starts.field(1)), length)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((doc_id.as_py(), len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept, [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    hit = sifted(scratch, texts, flagged, "flagged").join(flagged, ["doc", "t"], "left").select("doc_id", "text", "starts").mapInArrow(cut, schema)
    zero = F.lit(0).cast("long")
    miss = sifted(scratch, texts, flagged, "flagged", inside=False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"), F.from_json(F.lit("[]"), "array<struct<begin:long,end:long>>").alias("spans"))
    return hit.unionByName(miss)
