import random

import numpy as np

from meshloom.llm import decontaminate
from meshloom.llm.words import BREAKS


def words(t):
    return (t or "").lower().encode().translate(BREAKS).split()


def local(a, b):
    """Smith-Waterman, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = max(0, old[j - 1] + (1 if x == y else -1), old[j] - 1, row[j - 1] - 1)
            best = max(best, row[j])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, lo, hi = decontaminate.align(np.array(a), np.array(b))
        assert score == local(a, b) == (local(a, b[lo:hi]) if hi > lo else 0)


def test_whole_table_equals_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {}
    for d in docs.collect():
        w = words(d.text)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, t in items:
            if have & {tuple(t[k : k + 5]) for k in range(len(t) - 4)} and (s := local(t, w) / len(t)) >= 0.5:
                want[d.doc_id, i] = round(s, 9)
    assert got == want and want


def test_edited_copies_common_passages_and_edge_cases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = [w if i % 9 else word() for i, w in enumerate(item)]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{noise(50)} {' '.join(item).title()}! {noise(20)}") for i in range(300)]
    rows += [(1000, f"{noise(50)} {' '.join(edited)} {noise(9)}"), (1001, None), (1002, ""), (None, " ".join(item)), (1003, noise(50_000) + " " + " ".join(item)), (1004, noise(60)), (1004, noise(60)), (1005, " ".join(item[:12]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, "too short"), (None, noise(30))], "item_id long, text string")
    for slice_chars in (1 << 20, 40):
        out = decontaminate.contaminated(docs, bench, slice_chars=slice_chars).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == sorted([*range(300), 1000, -1, 1003]) and {r.item_id for r in out} == {7}
    text = dict(rows)
    for r in out:
        if r.doc_id in text and r.doc_id != 1000:
            assert words(text[r.doc_id][r.start : r.end]) == [w.encode() for w in item]
    kept = [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()]
    assert sorted(kept) == [1001, 1002, 1004, 1004, 1005]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_edited_copies_of_an_item_in_many_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (20, 40)]
    rows, want = [], set()
    for k, item in enumerate(items):
        rows += [(1000 * k + i, " ".join([word() for _ in range(30)] + item)) for i in range(20)]
        for i in range(20, 320):
            copy = list(item)
            for at in rng.sample(range(len(item)), len(item) // (5 if i % 2 else 4)):
                copy[at] = word()
            rows.append((1000 * k + i, " ".join([word() for _ in range(10)] + copy + [word() for _ in range(10)])))
    for d, text in rows:
        w = text.split()
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, t in enumerate(items):
            if have & {tuple(t[i : i + 5]) for i in range(len(t) - 4)} and local(t, w) / len(t) >= 0.5:
                want.add((d, k))
    rows += [(5000 + i, " ".join(word() for _ in range(20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 300


def test_clean_rows_that_share_an_id_stay(spark):
    rng = random.Random(7)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (1, "clean text"), (2, "other"), (None, item), (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.decontaminated(docs, bench).collect()) == [(0, "clean"), (1, "clean text"), (1, "clean text"), (2, "other")]
