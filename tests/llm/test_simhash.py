import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split() if w]
    if not words:
        return 0
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    least = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), format(f, "016x"), str(least.get(c))) for (i, _), f, c in zip(rows, fps, comp))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_matches_brute_force_on_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_nulls_empty_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "a b"), (7, "One two"), (2, "one TWO"), (2, "one TWO"), (11, long), (12, "É x"), (13, "é x")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, band string")
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_are_all_close_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.repeat(base, 9)
    for _ in range(4):
        fps ^= np.where(rng.random(len(fps)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64), np.uint64(0))
    rng.shuffle(fps)
    cut = np.array([0, 1, 70, 70 + 129, len(fps)])
    ends = np.repeat(cut[1:], np.diff(cut))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, ends[i]) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    found = [(int(i), int(j)) for a, b in simhash.close_pairs(fps, ends, radius, at_once=97) for i, j in zip(a, b)]
    assert len(found) == len(set(found)) and set(found) == want


def test_hot_bucket_in_blocks_loses_no_link(spark, tmp_path):
    from meshloom.llm.common import Scratch

    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    scratch = Scratch(spark, "test")
    links = simhash.near_links(scratch, spark.createDataFrame(signed, "fp long"), block=16)
    from meshloom.llm.common import connected_components

    roots = {r.node: r.root for r in connected_components(scratch, links).collect()}
    values = [s for s, in signed]
    mask = (1 << 64) - 1
    near = {v: [u for u in values if ((u ^ v) & mask).bit_count() <= 3] for v in values}
    for v in values:
        seen, todo = {v}, [v]
        while todo:
            for u in near[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        assert roots.get(v, v) == min(seen)
    assert spark.range(1).select(F.lit(1)).count() == 1
