import random
import re

import corpus_pipeline
from meshloom.llm import secrets, simhash


def make(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    item = some(30)
    rows = [(i, some(80), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, some(60) + " vileword badger " + some(20), "en", "s0", 0) for i in range(60)]
    rows += [(300 + i, rows[5][1], "en", "s1", 0) for i in range(9)] + [rows[7]]
    rows += [(400 + i, some(20) + " " + item + " " + some(20), "en", "s2", 0) for i in range(5)]
    rows += [(500, "the token = " + "0f" * 16 + " " + some(50), "en", "s0", 0), (501, None, None, None, None), (None, some(70), "en", "s0", 0)]
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("vileword" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, some(25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, rows


def test_each_stage_takes_effect_and_keeps_clean_rows(spark, tmp_path):
    docs, rows = make(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    kept, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert kept.columns == docs.columns
        seen.append(sorted(kept.select("doc_id", "text").collect(), key=str))
    ids = lambda x: sorted(str(r.doc_id) for r in x)
    assert ids(seen[0]) == sorted(str(r[0]) for r in rows if r[0] is None or not 200 <= r[0] < 300)
    # brute force over the first stage's rows: groups by pairwise distance
    fps = [(r.doc_id, simhash.simhash((r.text or "").encode())) for r in seen[0]]
    near = {i for i, f in fps if i is not None and not any(j is not None and j < i and (f ^ g).bit_count() <= 3 for j, g in fps)}
    assert {r.doc_id for r in seen[1]} == near | {None} and len(seen[1]) == len(near) + 1
    assert ids(seen[2]) == sorted(str(r.doc_id) for r in seen[1] if r.doc_id is None or not 400 <= r.doc_id < 500)
    before = {r.doc_id: r.text for r in seen[2]}
    for r in seen[3]:
        assert r.text == (secrets.redact(before[r.doc_id], secrets.scan(before[r.doc_id])) if before[r.doc_id] else before[r.doc_id])
    assert "[SECRET]" in next(r.text for r in seen[3] if r.doc_id == 500) and len(seen[3]) == len(seen[2])
    share = sum(len(re.findall(r"\S+", r.text or "")) for r in seen[4]) / sum(len(re.findall(r"\S+", r.text or "")) for r in seen[3])
    assert 0.6 < share < 0.9


def test_run_on_empty_documents(spark, tmp_path):
    docs, _ = make(spark, tmp_path / "full")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
