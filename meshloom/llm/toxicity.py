"""Toxicity scores from a factorization machine over hashed terms.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): beside a weight for each
term, the vectors v give one to each pair of terms, such as an insult with the mention of a group.

Terms are whole words and byte n-grams (5, 7 and 8 bytes, a word's leading space included, after lower-casing), hashed
to 2^22 slots; x_i is log2(1 + occurrences), at most 3. Whole texts are hashed, n-grams all at once per Arrow batch.
Fitting takes a bounded sample of labelled rows (``most`` of each label, those with the smallest hashes, and at most
``most_bytes`` of text, both of them parameters), keeps at
most ``terms`` slots, and runs AdaGrad on these. Terms are kept that surely tell the labels apart by chi square, alone
or as a pair: of the ``PAIRED`` most frequent whole words, all pairs' joint occurrences are tested, so that words that
matter only together stay. Both labels count alike while learning; w0 is then moved to the label share of the table.

Defined cases: a null or empty text has no terms and gets the score of w0; rows with null ids or labels teach nothing;
rows that repeat teach once; very long texts count whole, in pieces; extra columns may have any name; with
labelled rows of one label only, or without any, every score is nearly that label (0 where there is none); where no term
surely tells the labels apart, scores come from the frequent words, one for each four sampled rows, and ``told`` is false, so that
a caller needn't act on them; repeated rows come back as often as they came; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, text_or_empty
from .words import batches_of

SLOTS = 1 << 22
GRAMS = (5, 7, 8)
THRESHOLD = 0.3
#: Labelled rows that are collected at most, of each label, and terms that are kept.
MOST = 3000
#: Bytes of text that are collected at most, of each label (one text more may begin below the bound).
MOST_BYTES = 32 << 20
TERMS = 4096
FACTORS = 8
#: Chi square that a term needs: about one in a million terms that say nothing passes.
SURE = 24.0
#: Whole words whose pairs are tested, and the chi square that a pair needs, there being a thousand times as many tests.
PAIRED = 2048
SURE_PAIR = 40.0
#: Whole words that are kept because they are frequent, whatever they tell alone or with one other word: their vectors
#: may still add up to groups of words that matter together.
FREQUENT = 1024
#: Sampled rows for each frequent word that is kept, so that few rows don't meet many weights.
ROWS_A_WORD = 4
#: Bytes hashed at once.
PIECE = 1 << 19

#: Bytes that end a word: all that isn't a letter, a digit or part of a multi-byte character.
BREAKS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def term_slots(texts: list[bytes], column: np.ndarray | None = None, sizes=GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every term occurrence of the texts, whole; non-ASCII letters are lower-cased beforehand.

    With a column for each slot, only terms with one of 0 or more, as that column; sizes: those of the n-grams.
    """
    rows, slots = [], []

    def add(owner, slot):
        if column is not None:
            slot = column[slot].astype(np.int64)
            owner, slot = owner[slot >= 0], slot[slot >= 0]
        rows.append(owner)
        slots.append(slot)

    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        flat = np.frombuffer(b"\x00".join([b"", *(b" " + t.translate(BREAKS) + b" " for t in texts[begin:end]), b""]), np.uint8)
        owner = np.cumsum(flat == 0) - 1 + begin
        x = flat.astype(np.uint64)
        space = (flat == 32) | (flat == 0)
        for n in sizes:
            if len(flat) < n:
                continue
            h = np.zeros(len(flat) - n + 1, np.uint64)
            bad = np.zeros(len(h), bool)
            for i in range(n):
                part = x[i : i + len(h)]
                h = h * np.uint64(0x100000001B3) + part
                bad |= flat[i : i + len(h)] == 0
                if i:
                    bad |= space[i : i + len(h)] & (i < n - 1)  # within a word and its two spaces
            ok = np.flatnonzero(~bad)
            add(owner[ok], mixed(h[ok], n))
        cut = np.flatnonzero(space)
        a, b = cut[:-1] + 1, cut[1:]
        a, b = a[b > a], b[b > a]
        # a word's hash is a difference of prefix sums, scaled to its start
        step = np.uint64(0x9E3779B97F4A7C15 | 1)
        inverse = np.uint64(pow(int(step), -1, 1 << 64))
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(flat), inverse, np.uint64))))
        up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(flat), step, np.uint64))))
        total = np.concatenate(([np.uint64(0)], np.cumsum((x + np.uint64(1)) * power[: len(x)], dtype=np.uint64)))
        add(owner[a], mixed((total[b] - total[a]) * up[a], 0))
        begin = end
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(slots)


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind + 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(42)).astype(np.int64)


def counted(rows: np.ndarray, slots: np.ndarray):
    """(row, slot, x) with one entry for each term of a row."""
    key, n = np.unique(rows * SLOTS + slots, return_counts=True)
    return key // SLOTS, key % SLOTS, np.minimum(np.log2(1.0 + n), 3.0)


def paired_terms(texts: list[bytes], labels: np.ndarray, most: int = PAIRED, sure: float = SURE_PAIR, frequent: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, best chi square) of whole words whose joint occurrence with another tells the labels apart, and more so
    than either word alone; and the slots of the most frequent words."""
    frequent = FREQUENT if frequent is None else frequent
    n, positive = len(labels), labels.sum()
    parts = [(i + r, s) for i in range(0, n, 64) for r, s, _ in [counted(*term_slots(texts[i : i + 64], sizes=()))]]
    row, slot = (np.concatenate(p) for p in zip(*parts))
    held = np.bincount(slot, minlength=SLOTS).astype(np.int32)
    slots = np.flatnonzero((held >= 3) & (held < n))
    by_count = slots[np.argsort(-held[slots], kind="stable")]
    common, slots = by_count[:frequent], np.sort(by_count[:most])
    at = np.full(SLOTS, -1, np.int32)
    at[slots] = np.arange(len(slots))
    row, col = row[at[slot] >= 0], at[slot[at[slot] >= 0]]
    del held, at, slot, parts
    x = np.zeros((n, len(slots)), np.float32)
    x[np.argsort(np.argsort(-labels, kind="stable"))[row], col] = 1  # toxic rows first
    one, other = x[: int(positive)], x[int(positive) :]

    def chi_square(a, b):
        c, d = positive - a, n - positive - b
        return (a * d - b * c) ** 2 * n / np.maximum((a + b) * (c + d) * positive * (n - positive), 1e-9)

    alone = chi_square(one.sum(0, dtype=np.float64), other.sum(0, dtype=np.float64))
    best = np.zeros(len(slots))
    for i in range(0, len(slots), 128):  # all pairs, a slice of rows at a time to bound memory
        a, b = ((m[:, i : i + 128].T @ m).astype(np.float64) for m in (one, other))
        chi = chi_square(a, b)
        chi[(chi < sure) | (chi <= 1.5 * np.maximum(alone[i : i + 128, None], alone)) | (a + b < 3)] = 0
        best[i : i + 128] = chi.max(1, initial=0)
    return slots[best > 0], best[best > 0], common


class FactorizationMachine:
    """Weights over the kept terms; column maps a slot to its term or -1."""

    def __init__(self, column: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, told: bool = False):
        self.column, self.w0, self.w, self.v = column, w0, w, v
        #: Whether some term or pair surely tells the labels apart.
        self.told = told

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, epochs: int = 25, rate: float = 0.1, decay: float = 1e-4, seed: int = 7, share: float | None = None) -> FactorizationMachine:
        """share: that of toxic rows among all labelled ones, where the texts are a sample that changes it."""
        none = cls(np.full(SLOTS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, factors)))
        n = len(labels)
        positive = int(labels.sum())
        if not positive or positive == n:
            none.w0 = 20.0 if positive else -20.0
            return none
        seen = np.zeros((2, SLOTS), np.int32)
        for i in range(0, n, 64):  # counts only; terms are hashed again below, once few of them are kept
            r, s, _ = counted(*term_slots(texts[i : i + 64]))
            for label in (0, 1):
                np.add.at(seen[label], s[labels[i + r] == label], 1)
        kept = np.flatnonzero(seen.sum(0) >= 3)
        a, b = seen[1, kept].astype(np.float64), seen[0, kept].astype(np.float64)
        del seen
        c, d = positive - a, n - positive - b
        chi = (a * d - b * c) ** 2 * n / np.maximum((a + b) * (c + d) * positive * (n - positive), 1e-9)
        sure = np.flatnonzero(chi >= SURE)
        alone = dict(zip(kept[sure].tolist(), chi[sure].tolist()))
        pairs, best, common = paired_terms(texts, labels)
        value = {s: max(x, alone.get(s, 0.0)) for s, x in zip(pairs.tolist(), best.tolist())}
        value = alone | value
        kept = np.array(sorted(value, key=lambda s: (-value[s], s))[:terms], np.int64)
        told = len(kept) > 0
        kept = np.unique(np.concatenate((kept, common[: n // ROWS_A_WORD])))
        share = positive / n if share is None else share
        prior = float(np.log(share / (1 - share)))
        if not len(kept):
            none.w0 = prior
            return none
        none.column[kept] = np.arange(len(kept))
        parts = [(i + r, k, x) for i in range(0, n, 64) for r, k, x in [counted(*term_slots(texts[i : i + 64], none.column))]]
        row, col, x = (np.concatenate(p) for p in zip(*parts))
        rng = np.random.default_rng(seed)
        weight = np.where(labels > 0, n / 2 / positive, n / 2 / (n - positive))  # both labels count alike
        w0, w, v = 0.0, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))
        g0, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full(v.shape, 1e-8)
        start = np.searchsorted(row, np.arange(n + 1))
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, 128):
                batch = np.sort(order[i : i + 128])
                size = start[batch + 1] - start[batch]
                pick = np.repeat(start[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())
                r, k, y = np.repeat(np.arange(len(batch)), size), col[pick], x[pick]
                sums, out = cls.forward(w0, w, v, r, k, y, len(batch))
                err = (1 / (1 + np.exp(-out)) - labels[batch]) * weight[batch]
                e = err[r] * y
                dw = np.bincount(k, e, len(kept)) / len(batch)
                dv = e[:, None] * (sums[r] - v[k] * y[:, None])
                touched = np.unique(k)
                at = np.searchsorted(touched, k)
                dv = np.stack([np.zeros(len(touched)), *(np.bincount(at, dv[:, f], len(touched)) for f in range(factors))], 1)[:, 1:] / len(batch)
                d0 = err.mean()
                g0 += d0 * d0
                w0 -= rate * d0 / np.sqrt(g0)
                dw = dw[touched] + decay * w[touched]
                gw[touched] += dw * dw
                w[touched] -= rate * dw / np.sqrt(gw[touched])
                dv += decay * v[touched]
                gv[touched] += dv * dv
                v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
        return cls(none.column, w0 + prior, w, v, told)

    @staticmethod
    def forward(w0, w, v, row, col, x, n):
        vx = v[col] * x[:, None]
        sums = np.stack([np.zeros(n), *(np.bincount(row, vx[:, f], n) for f in range(v.shape[1]))], 1)[:, 1:]
        squares = np.bincount(row, (vx * vx).sum(1), n)
        return sums, np.clip(w0 + np.bincount(row, w[col] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), -30, 30)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.w):
            return np.full(len(texts), 1 / (1 + np.exp(-self.w0)))
        out = np.empty(len(texts))
        for i, j in batches_of(texts, PIECE):  # memory stays that of one piece, however many rows a batch has
            row, col, x = counted(*term_slots(texts[i:j], self.column))
            out[i:j] = self.forward(self.w0, self.w, self.v, row, col, x, j - i)[1]
        return 1 / (1 + np.exp(-out))

    def parts(self) -> tuple:
        """Plain arrays that ``of_parts`` makes the machine of; workers need not have this module to read them."""
        return np.flatnonzero(self.column >= 0), self.w0, self.w, self.v

    @classmethod
    def of_parts(cls, slots, w0, w, v) -> FactorizationMachine:
        column = np.full(SLOTS, -1, np.int32)
        column[slots] = np.arange(len(slots))
        return cls(column, w0, w, v)


def held_out():
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def lowered():
    return F.encode(F.lower(text_or_empty()), "UTF-8").alias("text")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, factors: int = FACTORS) -> FactorizationMachine:
    """Fits on a sample of documents of each label, none of them held out: at most ``most`` rows and ``most_bytes`` bytes
    of text (one row at least)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    toxic, all_rows = marked.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    few = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        few = part if few is None else few.unionByName(part)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered()).withColumns({"h": F.xxhash64("text"), "size": F.octet_length("text").cast("long")})
    # ids may repeat without bound: texts, not ids, are what is bounded, by number and size, before any is collected
    found = own.join(F.broadcast(few.distinct()), "doc_id").select("doc_id", "h", "size", "toxic").distinct()
    chosen = None
    for label in (0, 1):
        part = found.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    table = chosen.orderBy("toxic", F.xxhash64("doc_id"), "doc_id", "h").toPandas()
    upto = table.groupby("toxic")["size"].cumsum() - table["size"]
    kept = table[upto < most_bytes][["doc_id", "h", "toxic"]]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(list(kept.itertuples(index=False, name=None)), "doc_id long, h long, toxic int")
    rows = own.join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text")).orderBy("doc_id", "toxic", "h").toArrow()
    return FactorizationMachine.fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy().astype(np.float64), factors=factors, share=toxic / max(1, all_rows))


def scored(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted): row holds all columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.parts())
    inner = docs.select(as_row(docs), lowered())

    def run(batches):
        machine = FactorizationMachine.of_parts(*sent.value)
        for batch in batches:
            scores = machine.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["row", "score", "predicted"])

    return inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), threshold)
    return rows.select("row.doc_id", "score", "predicted").select("doc_id", held_out().alias("held_out"), "score", "predicted")
