"""Direct solution of symmetric positive definite systems by substructures, over tables, for any number of cases.

Linked nodes of a mesh that is numbered row by row differ by its width at most, so blocks of that many numbers are linked to
their two neighbours only. ``STRIP`` rows of blocks make a strip, whose last block parts it from the next one. A task
eliminates the inner blocks of one strip of one case, which leaves a matrix between the two separators beside it. Neighbours
are then merged in pairs, each pair in a task of its own, by eliminating the separator between them; the separators'
values come back in the opposite order, and the strips are solved with them. Rounds grow with the logarithm of the strips, and
a task holds blocks of the width, never a system, unless that is one strip. Systems whose numbers span ``SMALL`` at most lie
in one stretch of rows sorted by case, and batches of them are factored at once.

Matrices between a strip's separators grow with the square of the width, and a wide mesh has many strips. Rows of more than
``LONG`` nodes, whose links all lead to the eight nodes around, are dissected both ways instead: the last row and column of a
tile of ``TILE`` by ``TILE`` nodes part it from the next ones, a task eliminates a tile's inner nodes, and regions are merged in pairs,
down and across in turn, by eliminating what lies within. A region's matrix is between the nodes around it, so all of a level
take as much room as the mesh has nodes, times a constant, and only the last few are large.

Numbers that differ by more than ``WIDEST`` are left to iterations. A case that isn't positive definite gives NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables, only_marked_broadcasts

#: Span of node numbers up to which systems are factored in batches, widest block, nodes and blocks of a strip at most.
SMALL, WIDEST, STRIP_NODES, STRIP = 64, 2048, 16384, 32
#: Row length from which a mesh is dissected both ways, and nodes along a tile's side.
LONG, TILE = 200, 32
#: Tasks of a shuffle at most.
TASKS = 256


def raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.float64).tobytes()


def matrix(value: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(value).reshape(rows, -1) if rows else np.zeros((0, 0))


def eliminated(pivot: np.ndarray, right: np.ndarray, definite: bool = True) -> np.ndarray:
    """pivot^-1 right; NaN where the pivot isn't positive definite, or only where it is singular if it needn't be."""
    try:
        if len(pivot) and definite:
            np.linalg.cholesky(pivot)
        return np.linalg.solve(pivot, right)
    except np.linalg.LinAlgError:
        return np.full(right.shape, np.nan)


class Blocks:
    """Entries of one strip as dense blocks: first and last block of the strip, and its inner ones."""

    def __init__(self, k: pd.DataFrame, lo: int, width: int):
        i, j = (k[c].to_numpy(np.int64) - lo for c in ("row", "col"))
        self.width = width
        self.at = {}
        key = np.stack([i // width, j // width], 1)
        v = k["v"].to_numpy(np.float64)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, i, j, v = key[order], i[order] % width, j[order] % width, v[order]
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(v)]):
            if b > a:
                self.at[int(key[a, 0]), int(key[a, 1])] = i[a:b], j[a:b], v[a:b]

    def block(self, p: int, q: int, present: np.ndarray | None = None) -> np.ndarray:
        """Rows of block p, columns of block q; with ``present``, ones on the diagonal of numbers that no row has."""
        out = np.zeros((self.width, self.width))
        if (p, q) in self.at:
            np.add.at(out, self.at[p, q][:2], self.at[p, q][2])
        if present is not None:
            missing = np.flatnonzero(~present)
            out[missing, missing] = 1.0
        return out


def loads(f: pd.DataFrame, lo: int, width: int):
    """Case ids, and right-hand sides and present numbers of each block."""
    ids, column = np.unique(f["case_id"].to_numpy(np.int64), return_inverse=True)
    i = f["row"].to_numpy(np.int64) - lo
    out, present = {}, {}
    for p in np.unique(i // width).tolist():
        here = i // width == p
        out[p], present[p] = np.zeros((width, len(ids))), np.zeros(width, bool)
        np.add.at(out[p], (i[here] % width, column[here]), f["v"].to_numpy(np.float64)[here])
        present[p][i[here] % width] = True
    none = np.zeros(width, bool)
    return ids, lambda p: out.get(p, np.zeros((width, len(ids)))), lambda p: present.get(p, none)


def condense(k: pd.DataFrame, f: pd.DataFrame, strip: int, lo: int, width: int, per: int, blocks: int, definite: bool = True):
    """(separator before?, after?, matrix, right-hand sides) between the separators of a strip."""
    ids, load, present = loads(f, lo, width)
    at = Blocks(k, lo, width)
    first, last = strip * per, min(strip * per + per, blocks) - 1
    after = last == strip * per + per - 1
    inner = range(first, last if after else last + 1)
    n = width if strip else 0
    left = np.zeros((n, n))
    g = np.zeros((n, len(ids)))
    lower = at.block(first - 1, first) if n else np.zeros((0, width))  # left separator's rows
    upper = at.block(first, first - 1) if n else np.zeros((width, 0))
    pivot, b = at.block(first, first, present(first)), load(first)
    for i in inner:
        step = at.block(i, i + 1) if i < last else np.zeros((width, 0))
        back = at.block(i + 1, i) if i < last else np.zeros((0, width))
        x = eliminated(pivot, np.hstack([upper, step, b]), definite)
        xl, xs, xb = x[:, :n], x[:, n : n + step.shape[1]], x[:, n + step.shape[1] :]
        left, g = left - lower @ xl, g - lower @ xb
        if i < last:
            pivot = at.block(i + 1, i + 1, present(i + 1)) - back @ xs
            upper, lower, b = -back @ xl, -lower @ xs, load(i + 1) - back @ xb
    if not after:
        return bool(n), False, left, g
    return bool(n), True, np.block([[left, lower], [upper, pivot]]), np.vstack([g, b])


def inner_solution(k: pd.DataFrame, f: pd.DataFrame, lo: int, width: int, definite: bool = True) -> pd.DataFrame:
    """(case_id, node_id, u) of the inner blocks, whose separators' part has been moved into the load."""
    ids, load, present = loads(f, lo, width)
    at = Blocks(k, lo, width)
    i = f["row"].to_numpy(np.int64) - lo
    numbers = range(int(i.min()) // width, int(i.max()) // width + 1)
    kept, pivot, b = [], at.block(numbers[0], numbers[0], present(numbers[0])), load(numbers[0])
    for p in numbers:
        x = eliminated(pivot, np.hstack([at.block(p, p + 1), b]), definite)
        kept.append((x[:, :width], x[:, width:]))
        if p < numbers[-1]:
            back = at.block(p + 1, p)
            pivot, b = at.block(p + 1, p + 1, present(p + 1)) - back @ kept[-1][0], load(p + 1) - back @ kept[-1][1]
    u = {}
    for p in reversed(numbers):
        step, x = kept.pop()
        u[p] = x - step @ u[p + 1] if p + 1 in u else x
    values = np.vstack([u[p] for p in numbers])[i - numbers[0] * width, np.searchsorted(ids, f["case_id"].to_numpy(np.int64))]
    return pd.DataFrame({"case_id": f["case_id"].to_numpy(), "node_id": f["row"].to_numpy(), "u": values})


def small(k: DataFrame, f: DataFrame, lo: int, span: int, tasks: int) -> DataFrame:
    """(case_id, node_id, u) of systems whose numbers span little: entries and loads sorted by case, batches factored at once."""
    at = lambda c: (F.col(c) - lo).cast("int")
    rows = k.select("case_id", at("row").alias("i"), at("col").alias("j"), "v").unionByName(f.select("case_id", at("row").alias("i"), F.lit(span).alias("j"), "v"))
    rows = rows.repartition(tasks, "case_id").sortWithinPartitions("case_id")

    def run(batches):
        rest = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(p) for p in zip(rest, now)]
            # the last case may go on in the next batch
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [c[cut:] for c in now]
            if cut:
                yield solved([c[:cut] for c in now])
        if rest is not None and len(rest[0]):
            yield solved(rest)

    def solved(columns):
        case, i, j, v = columns
        ids, at = np.unique(case, return_inverse=True)
        full = np.bincount((at * span + i) * (span + 1) + j, v, len(ids) * span * (span + 1)).reshape(len(ids), span, span + 1)
        present = np.zeros((len(ids), span), bool)
        present[at[j == span], i[j == span]] = True
        a = full[:, :, :span] + np.eye(span) * ~present[:, :, None]
        try:
            np.linalg.cholesky(a)
            x = np.linalg.solve(a, full[:, :, span:])[:, :, 0]
        except np.linalg.LinAlgError:
            x = np.stack([eliminated(p, b)[:, 0] for p, b in zip(a, full[:, :, span:])])
        where, number = np.nonzero(present)
        return pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(number + lo), pa.array(x[where, number])], ["case_id", "node_id", "u"])

    return rows.mapInArrow(run, "case_id long, node_id long, u double")


def extent(k: DataFrame):
    """Least and greatest number, the greatest difference of linked ones, and about how many cases there are."""
    cases = F.approx_count_distinct("case_id") if "case_id" in k.columns else F.lit(1)
    return k.agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max(F.abs(F.col("row") - F.col("col"))).alias("width"), cases.alias("cases")).first()


def rows_of(k: DataFrame, lo: int, width: int) -> tuple[int, int] | None:
    """(first number of a row of the mesh, at or before lo, and how many a row has) if all links lead to the eight nodes around;
    None if there are no such numbers."""
    some = [(at, n) for n in (width - 1, width, width + 1) if n >= LONG for at in sorted({lo, lo - lo % n}, reverse=True)]
    if not some:
        return None
    place = lambda c, at, n: (F.floor((F.col(c) - at) / n), F.pmod(F.col(c) - at, F.lit(n)))
    far = [F.max(F.greatest(*[F.abs(p - q) for p, q in zip(place("row", *one), place("col", *one))])).alias(f"at{i}") for i, one in enumerate(some)]
    found = k.agg(*far).first()
    return next((one for one, x in zip(some, found) if x <= 1), None)


class Region:
    """A matrix and right-hand sides over sorted node numbers, of which some are eliminated."""

    def __init__(self, ids: np.ndarray, loads: int):
        self.ids, self.a, self.g = ids, np.zeros((len(ids), len(ids))), np.zeros((len(ids), loads))

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def split(self, inside: np.ndarray, definite: bool):
        """(numbers inside, around, solution inside for unit values around and for the loads), and what is left around."""
        i, b = np.flatnonzero(inside), np.flatnonzero(~inside)
        x = eliminated(self.a[np.ix_(i, i)], np.hstack([self.a[np.ix_(i, b)], self.g[i]]), definite)
        back = self.a[np.ix_(b, i)]
        return self.ids[i], self.ids[b], x, self.a[np.ix_(b, b)] - back @ x[:, : len(b)], self.g[b] - back @ x[:, len(b) :]


def long_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def tiles(tables: Tables, name: str, k: DataFrame, f: DataFrame, lo: int, n: int, rows: int, loads: int, cases: int, definite: bool) -> DataFrame:
    """(case_id, node_id, u) for K(of, row, col, v), f(of, case_id, row, v) on a mesh of so many rows of n numbers."""
    tile = TILE
    size = (-(-rows // tile), -(-n // tile))  # tiles down and across
    number = lambda c: F.col(c) - lo
    down = lambda *cs: F.floor(F.floor(F.greatest(*[number(c) for c in cs]) / n) / tile).cast("long")
    across = lambda *cs: F.floor(F.greatest(*[F.pmod(number(c), F.lit(n)) for c in cs]) / tile).cast("long")
    # an entry lies in the tile of its greater row and column, which both of its nodes are in or beside
    k = k.select("of", down("row", "col").alias("i"), across("row", "col").alias("j"), number("row").alias("row"), number("col").alias("col"), "v")
    f = f.select("of", F.floor(F.floor(number("row") / n) / tile).cast("long").alias("i"), F.floor(F.pmod(number("row"), F.lit(n)) / tile).cast("long").alias("j"), "case_id", number("row").alias("row"), "v")
    tasks = lambda regions: int(max(1, min(TASKS, 2 * regions * cases)))
    key = ["of", "i", "j"]
    by = lambda t, regions: t.repartition(tasks(regions), *key).groupBy(*key)

    def within(ids, i, j, h, w, whole):
        """Which numbers lie in a region of h by w nodes and not on its last row or column."""
        r, c = ids // n, ids % n
        return np.full(len(ids), True) if whole else (r >= i * h) & (r < i * h + h - 1) & (c >= j * w) & (c < j * w + w - 1)

    def leaf(part, load):
        ids, column = np.unique(load["case_id"].to_numpy(np.int64), return_inverse=True)
        row, col, at = (t[c].to_numpy(np.int64) for t, c in ((part, "row"), (part, "col"), (load, "row")))
        region = Region(np.unique(np.concatenate([row, col, at])), len(ids) if len(ids) else loads)
        np.add.at(region.a, (region.at(row), region.at(col)), part["v"].to_numpy(np.float64))
        if len(at):
            np.add.at(region.g, (region.at(at), column), load["v"].to_numpy(np.float64))
        return ids, region

    def first(of, part, load):
        _, region = leaf(part, load)
        _, around, _, a, g = region.split(within(region.ids, of[1], of[2], tile, tile, False), definite)
        return pd.DataFrame({"of": [of[0]], "i": [of[1]], "j": [of[2]], "ids": [around.tobytes()], "a": [raw(a)], "g": [raw(g)]})

    fronts = tables.write(f"{name}-front-0", by(k, size[0] * size[1]).cogroup(by(f, size[0] * size[1])).applyInPandas(first, "of long, i long, j long, ids binary, a binary, g binary"))
    levels, h, w = [], 1, 1  # tiles of a region down and across
    while not levels or max(size) > 1:
        vertical = size[0] >= size[1]
        h, w = (2 * h, w) if vertical else (h, 2 * w)
        size = (-(-size[0] // 2), size[1]) if vertical else (size[0], -(-size[1] // 2))
        whole = max(size) == 1

        def merge(of, part):
            part = part.sort_values(["was_i", "was_j"])
            own = [long_ids(v) for v in part["ids"]]
            region = Region(np.unique(np.concatenate(own)), loads)
            for ids, a, g in zip(own, part["a"], part["g"]):
                at = region.at(ids)
                region.a[np.ix_(at, at)] += matrix(a, len(ids))
                region.g[at] += matrix(g, len(ids)).reshape(len(ids), loads)
            inner, around, x, a, g = region.split(within(region.ids, of[1], of[2], h * tile, w * tile, whole), definite)
            children = [(int(i), int(j), v) for i, j, v in zip(part["was_i"], part["was_j"], part["ids"])]
            children += [(-1, -1, b"")] * (2 - len(children))
            out = {"ids": around.tobytes(), "a": raw(a), "g": raw(g), "inner": inner.tobytes(), "x": raw(x)}
            out |= {f"{c}{m}": v for m, child in enumerate(children) for c, v in zip(("i", "j", "ids"), child)}
            return pd.DataFrame({"of": [of[0]], "i": [of[1]], "j": [of[2]], **{c: [v] for c, v in out.items()}})

        pairs = fronts.select("of", F.shiftright("i", int(vertical)).alias("i"), F.shiftright("j", int(not vertical)).alias("j"), F.col("i").alias("was_i"), F.col("j").alias("was_j"), "ids", "a", "g")
        child = ", ".join(f"i{m} long, j{m} long, ids{m} binary" for m in range(2))
        fronts = tables.write(f"{name}-front-{len(levels) + 1}", by(pairs, size[0] * size[1]).applyInPandas(merge, f"of long, i long, j long, ids binary, a binary, g binary, inner binary, x binary, {child}"))
        # what goes back needs no matrices: only those of two levels are on disk at once
        kept = tables.write(f"{name}-part-{len(levels)}", fronts.drop("a", "g"))
        tables.drop(f"{name}-front-{len(levels)}")
        levels.append((kept, size[0] * size[1]))
    tables.drop(f"{name}-front-{len(levels)}")

    def spread(batches):
        """Values within a region from those around it; to each of the two that it was made of, the values around that."""
        for part in batches:
            out = []
            for _, r in part.iterrows():
                inner, around = long_ids(r["inner"]), long_ids(r["ids"])
                x = matrix(r["x"], len(inner)).reshape(len(inner), len(around) + loads)
                u = x[:, len(around) :]
                if len(around):
                    beside = matrix(r["u"], len(around))
                    u = u - x[:, : len(around)] @ beside
                    u = np.vstack([u, beside])
                ids = np.concatenate([inner, around])
                order = np.argsort(ids)
                ids, u = ids[order], u[order]
                for m in range(2):
                    if r[f"i{m}"] >= 0:
                        own = long_ids(r[f"ids{m}"])
                        out.append((r["of"], r[f"i{m}"], r[f"j{m}"], own.tobytes(), raw(u[np.searchsorted(ids, own)])))
            yield pd.DataFrame(out, columns=["of", "i", "j", "ids", "u"])

    known = None
    for level in range(len(levels) - 1, -1, -1):
        some, regions = levels[level]
        some = some.withColumn("u", F.lit(None).cast("binary")) if known is None else some.join(known.select(*key, "u"), key)
        known = tables.write(f"{name}-known-{level}", some.repartition(tasks(regions), *key).mapInPandas(spread, "of long, i long, j long, ids binary, u binary"))
        tables.drop(f"{name}-part-{level}", *[f"{name}-known-{level + 1}"] * (level + 1 < len(levels)))

    def last(of, part, load):
        told = load["u"].notna().to_numpy()
        mine = load[~told]
        ids, region = leaf(part, mine)
        u = np.zeros((len(region.ids), loads))
        inside = within(region.ids, of[1], of[2], tile, tile, False)
        if told.any():
            one = load[told].iloc[0]
            around = long_ids(one["ids"])
            u[region.at(around)] = matrix(one["u"], len(around)).reshape(len(around), loads)
        _, around, x, _, _ = region.split(inside, definite)
        u[inside] = x[:, len(around) :] - x[:, : len(around)] @ u[~inside]
        at, case = mine["row"].to_numpy(np.int64), mine["case_id"].to_numpy(np.int64)
        return pd.DataFrame({"case_id": case, "node_id": at + lo, "u": u[region.at(at), np.searchsorted(ids, case)]})

    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = f.select(*key, "case_id", "row", "v", null("ids", "binary"), null("u", "binary")).unionByName(known.select(*key, null("case_id", "long"), null("row", "long"), null("v", "double"), "ids", "u"))
    count = -(-rows // tile) * -(-n // tile)
    return tables.write(f"{name}-inner", by(k, count).cogroup(by(both, count)).applyInPandas(last, "case_id long, node_id long, u double"))


def solve(tables: Tables, name: str, k: DataFrame, f: DataFrame, parts: int = 1, definite: bool = True) -> DataFrame | None:
    """(case_id, node_id, u) of K u = f for K([case_id,] row, col, v) and f(case_id, row, v), which has a row for each row of K
    (in each case of f, if K is shared); written, systems of a small span in so many ``parts``. A shared K
    needn't be symmetric, nor ``definite``, if no block that is eliminated is singular. None where the numbers are too far apart."""
    shared = "case_id" not in k.columns
    # tasks return long ids, whatever type the cases' table has
    k, f = (t.withColumns({c: F.col(c).cast("long") for c in ("case_id", "row", "col") if c in t.columns}) for t in (k, f))
    found = extent(k)
    if found.lo is None:
        return None
    lo, span, width = found.lo, found.hi - found.lo + 1, max(1, found.width)
    if not shared and span <= SMALL:
        return tables.write(f"{name}-u", small(k, f, lo, span, parts))
    grid = rows_of(k, lo, width)
    if grid:
        at, n = grid
        of = F.lit(0).cast("long") if shared else F.col("case_id")
        right = f.select("case_id").distinct().count() if shared else 1
        with only_marked_broadcasts(tables.spark):
            return tiles(tables, name, k.select(of.alias("of"), "row", "col", "v"), f.select(of.alias("of"), "case_id", "row", "v"), at, n, -(-(found.hi + 1 - at) // n), right, found.cases, definite)
    if width > WIDEST:
        return None
    width = min(span, max(width, 16))  # few tiny blocks cost more than one
    blocks = -(-span // width)
    per = max(2, min(STRIP, STRIP_NODES // width))
    strips = -(-blocks // per)
    block = lambda c: F.floor((F.col(c) - lo) / width).cast("long")
    strip = lambda c: F.floor(block(c) / per).cast("long")
    outer = lambda c: block(c) % per == per - 1
    of = F.lit(0).cast("long") if shared else F.col("case_id")
    k = k.select(of.alias("of"), "row", "col", "v")
    f = f.select(of.alias("of"), "case_id", "row", "v")
    tasks = lambda groups: int(max(1, min(TASKS, 2 * groups * found.cases)))
    by = lambda rows: rows.repartition(tasks(strips), "of", "strip").groupBy("of", "strip")

    def leaf(key, part, load):
        before, after, a, g = condense(part, load, int(key[1]), lo, width, per, blocks, definite)
        return pd.DataFrame({"of": [key[0]], "at": [key[1]], "before": [before], "after": [after], "a": [raw(a)], "g": [raw(g)]})

    def merge(key, part):
        part = part.sort_values("at")
        one = part.iloc[0]
        if len(part) == 1:
            return pd.DataFrame({"of": [key[0]], "at": [key[1]], "before": [one["before"]], "after": [one["after"]], "a": [one["a"]], "g": [one["g"]], "t": [None]})
        two = part.iloc[1]
        l, r = width * bool(one["before"]), width * bool(two["after"])
        a, b = matrix(one["a"], l + width), matrix(two["a"], width + r)
        ga, gb = matrix(one["g"], l + width), matrix(two["g"], width + r)
        mid = eliminated(a[l:, l:] + b[:width, :width], np.hstack([a[l:, :l], b[:width, width:], ga[l:] + gb[:width]]), definite)
        rim = np.vstack([a[:l, l:], b[width:, :width]])
        whole = np.zeros((l + r, l + r))
        whole[:l, :l], whole[l:, l:] = a[:l, :l], b[width:, width:]
        g = np.vstack([ga[:l], gb[width:]])
        out = {"a": raw(whole - rim @ mid[:, : l + r]), "g": raw(g - rim @ mid[:, l + r :]), "t": raw(mid)}
        return pd.DataFrame({"of": [key[0]], "at": [key[1]], "before": [l > 0], "after": [r > 0], **{c: [v] for c, v in out.items()}})

    front = "of long, at long, before boolean, after boolean, a binary, g binary"
    separators = None
    ids = None
    if strips > 1 or blocks == per:
        at = F.greatest(strip("row"), strip("col"))
        fronts = tables.write(f"{name}-front-0", by(k.withColumn("strip", at)).cogroup(by(f.withColumn("strip", strip("row")))).applyInPandas(leaf, front))
        ids = f.select("case_id").distinct().agg(F.sort_array(F.collect_list("case_id")).alias("cases")).first().cases if shared else None
        depth = max(0, (strips - 1).bit_length())
        levels = []
        for level in range(1, depth + 1):
            pairs = fronts.select("of", F.col("at").alias("was"), "before", "after", "a", "g").withColumn("pair", F.shiftright("was", 1)).withColumnRenamed("was", "at")
            fronts = tables.write(f"{name}-front-{level}", pairs.repartition(tasks(-(-strips >> level)), "of", "pair").groupBy("of", "pair").applyInPandas(merge, front + ", t binary"))
            levels.append(fronts)

        def top(batches):
            for part in batches:
                for _, r in part.iterrows():
                    if r["after"]:
                        x = eliminated(matrix(r["a"], width), matrix(r["g"], width), definite)
                        yield pd.DataFrame({"of": [r["of"]], "sep": [strips - 1], "x": [raw(x)]})

        known = tables.write(f"{name}-known-{depth}", fronts.select("of", "after", "a", "g").mapInPandas(top, "of long, sep long, x binary"))
        for level in range(depth, 0, -1):
            half = 1 << (level - 1)
            lower = levels[level - 1].where("t IS NOT NULL").select("of", "before", "after", "t", (F.col("at") * 2 * half - 1).alias("ls"), (F.col("at") * 2 * half + half - 1).alias("ms"), F.least((F.col("at") + 1) * 2 * half - 1, F.lit(strips - 1)).alias("rs"))
            for side in ("l", "r"):
                lower = lower.join(known.select("of", F.col("sep").alias(f"{side}s"), F.col("x").alias(f"{side}x")), ["of", f"{side}s"], "left")

            def down(batches):
                for part in batches:
                    out = []
                    for _, r in part.iterrows():
                        mid = matrix(r["t"], width)
                        n = width * (bool(r["before"]) + bool(r["after"]))
                        rim = [matrix(r[c], width) for c, on in (("lx", r["before"]), ("rx", r["after"])) if on]
                        x = mid[:, n:] - (mid[:, :n] @ np.vstack(rim) if rim else 0.0)
                        out.append((r["of"], r["ms"], raw(x)))
                    yield pd.DataFrame(out, columns=["of", "sep", "x"])

            middle = lower.repartition(tasks(-(-strips >> level)), "of", "ms").mapInPandas(down, "of long, sep long, x binary")
            known = tables.write(f"{name}-known-{level - 1}", known.unionByName(middle))

        def numbers(batches):
            for part in batches:
                for _, r in part.iterrows():
                    x = matrix(r["x"], width)
                    cases = np.array(ids or [r["of"]], np.int64)
                    row = lo + ((r["sep"] + 1) * per - 1) * width + np.arange(width)
                    yield pd.DataFrame({"of": r["of"], "case_id": np.tile(cases, width), "row": np.repeat(row, len(cases)), "u": x.ravel()})

        separators = tables.write(f"{name}-separators", known.mapInPandas(numbers, "of long, case_id long, row long, u double"))
        links = k.where(~outer("row") & outer("col")).join(separators.withColumnRenamed("row", "col"), ["of", "col"])
        moved = links.groupBy("of", "case_id", "row").agg((-F.sum(F.col("v") * F.col("u"))).alias("v"))
        inside = f.where(~outer("row"))
        f_in = inside.unionByName(moved).groupBy("of", "case_id", "row").agg(F.sum("v").alias("v"))
        k_in = k.where(~outer("row") & ~outer("col"))
    else:
        f_in, k_in = f, k

    def inner(key, part, load):
        return inner_solution(part, load, lo, width, definite)

    out = by(k_in.withColumn("strip", strip("row"))).cogroup(by(f_in.withColumn("strip", strip("row")))).applyInPandas(inner, "case_id long, node_id long, u double")
    out = tables.write(f"{name}-inner", out)
    if separators is None:
        return out
    # blocks are padded: separators hold only the numbers that have rows
    rows = f.where(outer("row")).select("of", "case_id", "row").join(separators, ["of", "case_id", "row"]).select("case_id", F.col("row").alias("node_id"), "u")
    return out.unionByName(rows)

