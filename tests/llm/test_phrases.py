import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from meshloom.llm import phrases

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in candidates.items():
        gone |= {(lang, w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and candidates.get((lang, w[i:j])) == a}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, x, y) in enumerate(sorted(ps)[:top]))


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 20 and got(phrases.mined(docs)) == want


@pytest.mark.parametrize("shard,counters", [(1 << 23, 1 << 26), (3000, 1 << 16)])
def test_odd_rows_and_full_counters(spark, monkeypatch, shard, counters):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "CHUNK", shard // 4)
    monkeypatch.setattr(phrases, "COUNTERS", counters)
    cloudpickle.register_pickle_by_value(phrases)
    rng = random.Random(shard)
    vocabulary = ["New", "york", "É", "é", "sky", "scraper", "a b", "x-1", "(the)", "İ"]
    some = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ! "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und", "en"]), some(rng.randrange(0, 60))) for _ in range(400)]
    rows += [("en", "one two three four five six " * 300), ("en", "aa " * 500), ("fr", None), ("fr", ""), (None, "\t \n"), ("x", "just these words")] + [("en", rows[0][1])] * 30
    docs = spark.createDataFrame([(i, t, x, "c", 1) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    try:
        for least, top in ((100, 2000), (7, 5)):
            assert got(phrases.mined(docs, least, top)) == brute(rows, least, top)
        assert phrases.mined(docs.limit(0)).count() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def test_states_are_the_classes_of_equal_ends():
    rng = np.random.default_rng(0)
    piece = np.sort(rng.integers(0, 40, 600))
    word = rng.integers(0, 4, 600)
    run = phrases.Run(word.astype(np.uint64) + np.uint64(7), piece, {})
    a = phrases.automaton(word, phrases.reach_of(run, None))
    ends = {}
    for i in range(600):
        for k in range(1, 6):
            if i - k + 1 >= 0 and piece[i - k + 1] == piece[i]:
                ends.setdefault(tuple(word[i - k + 1 : i + 1]), set()).add(i)
    classes = {}
    for w, e in ends.items():
        classes.setdefault(frozenset(e), []).append(w)
    text = lambda s: tuple(word[a.end[s] - a.length[s] + 1 : a.end[s] + 1])
    assert len(a.length) == len(classes)
    for s in range(len(a.length)):
        own = classes[frozenset(ends[text(s)])]
        assert max(map(len, own)) == a.length[s] and min(map(len, own)) == a.least[s] and len(ends[text(s)]) == a.count[s]
        assert a.link[s] == -1 if a.least[s] == 1 else text(a.link[s]) == text(s)[-(a.least[s] - 1) :]


def test_scores_beyond_64_bits(spark):
    sql = "(cast(a AS decimal(15, 0)) * cast(1000 AS decimal(4, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))"
    a, n, left, right = 999_999_999_999_989, 99_999_999_999_999_977, 123_456_789_012_345, 999_999_999_999_991
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(sql).first()[0]
    assert row == 1000 * a * n // (left * right)
