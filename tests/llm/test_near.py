import random

from meshloom.llm import near


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept(rows):
    """Ids of the smallest row of each group, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and find(i) != find(j):
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append((d is None, d or 0))
    return sorted(min(v) for v in least.values())


def test_near_copies_at_jaccard_from_0_8_leave_one_row(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(0, 600, 3):  # edits at one to four places of 100 to 200 words: Jaccard about 0.7 to 0.95
        text = [word() for _ in range(rng.randrange(100, 200))]
        rows.append((i, " ".join(text)))
        for j in (1, 2):
            copy = list(text)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i + j, " ".join(copy)))
    one = [word() for _ in range(120)]  # a group of many near copies, cut in blocks
    for i in range(150):
        copy = list(one)
        copy[rng.randrange(120)] = word()
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, None), (2001, " \n"), (2002, "a b"), (2003, "A\tb"), (None, "a b c"), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, n int")
    monkeypatch.setattr(near.near_links, "__defaults__", (16,))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near.representatives(docs).collect())
    assert got == kept(rows)
    assert near.representatives(docs.limit(0)).count() == 0


def test_recall_of_bands_and_radius_at_jaccard_0_8():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    met = pairs = 0
    while pairs < 1000:
        a = [word() for _ in range(rng.choice((15, 60, 200)))]
        b = list(a)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = word()
        x, y = " ".join(a), " ".join(b)
        if a != b and 0.8 <= jaccard(shingles(x), shingles(y)) < 0.86:
            _, fp, keys, _, _ = near.features([x.encode(), y.encode()])
            pairs += 1
            met += bool((keys[0] == keys[1]).any()) and (int(fp[0]) ^ int(fp[1])).bit_count() <= near.RADIUS
    assert met / pairs >= 0.995


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    text = [f"w{i}" for i in range(200)]
    edited = [w if i not in (50, 120) else "other" for i, w in enumerate(text)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(edited)), (3, " ".join(text[:100]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
