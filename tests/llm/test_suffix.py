import hashlib
import random

import numpy as np
import pytest

from meshloom.llm import suffix


def brute(rows, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha) by a set of all windows, documents in order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.drop("kept", "spans").collect())


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(suffix.deduplicated(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_shared_passages_periods_and_hot_groups(spark, piece, monkeypatch):
    rng = random.Random(piece)
    some = lambda n, of="abcdefgh ": "".join(rng.choice(of) for _ in range(n))
    hot, passage = some(230), some(400)
    texts = [some(rng.randrange(60)) + hot + some(rng.randrange(300)) for _ in range(150)]
    texts += [some(80) + passage[rng.randrange(200) :][: rng.randrange(90, 220)] + some(50) for _ in range(60)]
    texts += ["a" * 1500, "b" + "a" * 400, "ab" * 400, hot, hot, "", None, "é" * 90, "é" * 49 + "x", some(3000) * 2, "x" * 99, "y" * 100, "y" * 100]
    edited = [list(passage) for _ in range(40)]
    for e in edited:
        e[rng.randrange(400)] = "Z"
    texts += ["".join(e) for e in edited]
    rows = list(enumerate(texts)) + [(None, passage)]
    rng.shuffle(rows)
    monkeypatch.setattr(suffix, "PIECE", piece)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, doc string").repartition(7)
    assert got(suffix.deduplicated(docs)) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    a, b = "".join(random.Random(1).choices("abcdef", k=300)), "".join(random.Random(2).choices("abcdef", k=300))
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (None, b), (None, b), (3, b[:150])], "doc_id long, text string")
    out = suffix.deduplicated(docs).collect()
    removed = sorted((str(r.doc_id), r.n_removed) for r in out)
    assert removed == [("1", 0), ("1", 0), ("2", 300), ("3", 0), ("None", 150), ("None", 150)]
    assert suffix.deduplicated(docs.limit(0)).count() == 0
