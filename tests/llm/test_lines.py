import hashlib
import random

import numpy as np
import pytest

from meshloom.llm import lines

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for n, (i, ls) in enumerate(split):
        name = (i is None, i if i is not None else rows[n][1] or "")
        for line in ls:
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(name)
    out = []
    for n, (i, ls) in enumerate(split):
        name = (i is None, i if i is not None else rows[n][1] or "")
        kept = [line for line in ls if len(key(line)) < 10 or min(holders[key(line)]) == name]
        out.append((str(i), len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(lines.deduplicated(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bits", [1 << 27, 1 << 17])
def test_hot_lines_odd_rows_and_a_full_filter(spark, bits):
    rng = random.Random(bits)
    word = lambda: "".join(rng.choice("abcdefgÉéZ") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    rows = []
    for i in range(300):
        own = [rng.choice(pool) if rng.random() < 0.3 else " ".join(word() for _ in range(5)) for _ in range(rng.randrange(0, 12))]
        own += ["Share this with a friend\r"] * (i % 3) + ["  \tshare THIS with a friend"] * (i % 2)
        rows.append((i * 7 % 300, "\n".join(own)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "éééééééééé"), (504, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"), (505, "123456789\n123456789\n1234567890\n1234567890"), (506, "123456789\n 1234567890 \n1234567890\x0b")]
    rows += [(507, "x" * 300_000 + "\n" + "a line " * 40_000), (508, "x" * 300_000), (509, "\n".join(f"numbered line {k}" for k in range(20_000))), (510, "numbered line 19999")]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, doc string, numbers string").repartition(6)
    assert got(lines.deduplicated(docs, bits)) == brute(rows)


def test_rows_of_one_id_null_ids_and_empty_tables(spark):
    one, two = "the first long line", "the second long line"
    rows = [(1, f"{one}\n{one}"), (1, f"{one}\n{one}"), (1, two), (2, f"{two}\n{one}\nx"), (None, one), (None, one), (None, "only here, but twice"), (None, "only here, but twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(lines.deduplicated(docs)) == brute(rows)
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_few_single_lines_are_suspected_and_kept_text_is_given(spark):
    rows = [(i, "\n".join(f"line {i} of number {k}" for k in range(50)) + "\nthe same for all") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = lines.keyed(docs)
    bits = lines.repeated_bits(texts)
    found = lines.suspects(texts, bits).count()
    assert 2000 <= found < 2000 + 0.01 * 100_000
    kept = {r.doc_id: bytes(r.kept).decode() for r in lines.deduplicated(docs).collect()}
    assert kept[0] == rows[0][1] and kept[7] == rows[7][1].rsplit("\n", 1)[0]


def test_filters_merge_like_one():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    planes = []
    for part in (keys, keys[:1500], keys[:700]):
        once, twice = np.zeros(lines.BITS // 8, np.uint8), np.zeros(lines.BITS // 8, np.uint8)
        lines.see(once, twice, part)
        planes.append((once, twice))
    (o1, t1), (o2, t2), (o3, t3) = planes
    o, t = o1 | o2, t1 | t2 | (o1 & o2)
    o, t = o | o3, t | t3 | (o & o3)
    seen = lines.has(t, lines.places(keys, lines.BITS)).all(1)
    assert seen[:1500].all() and seen[1500:].mean() < 0.01
