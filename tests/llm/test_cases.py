"""Every operator and stage with extra columns called like the internal ones, and with null, empty, long, tied and repeated
rows: none fails, and none confuses its own columns with the table's."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshloom.llm import chaining, decontaminate, html, lines, mixing, near, negatives, phrases, queries, secrets, simhash, suffix, topk, toxicity, warc

CLASH = (
    "row text_ blob findings digest first original h t doc p e fp node keys n g mine other root component_id fingerprint score predicted held_out toxic"
    " probability mix_tokens mix_source mix_probability ratio w word bit bits sieve_word sieve_bits range seed item_id start end none key_id key_h new size kind"
).split()


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    one = some(70)
    return [(0, one), (1, one), (1, one), (1, some(30)), (2, None), (3, ""), (None, one), (None, None), (4, "token = abcdef12 " + some(20)), (5, some(160_000)), (6, " \t\n"), (50, "é" * 400)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 3 else None, "s", None if t is None else len(t)) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(7)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


@pytest.fixture(scope="module")
def bench(spark, docs):
    return spark.createDataFrame([(1, texts()[0][1]), (1, texts()[0][1]), (2, None), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit("x"))


def rows(df):
    return sorted(map(str, df.collect()))


OPERATORS = {
    "op1": lambda d, *_: suffix.deduplicated(d).drop("kept", "spans"),
    "op2": lambda d, *_: secrets.secret_report(d),
    "op3": lambda d, *_: chaining.passages(d),
    "op5": lambda d, *_: mixing.mixed(d).select("doc_id", "mix_source", "mix_tokens"),
    "op8": lambda d, _, b: decontaminate.contaminated(d, b),
    "op9": lambda d, l, _: toxicity.toxicity(d, l),
    "op10": lambda d, *_: simhash.near_duplicates(d),
    "op11": lambda d, *_: lines.deduplicated(d).drop("kept"),
    "op13": lambda d, *_: phrases.mined(d, least=2),
    "toxic rows": lambda d, l, _: toxicity.scored(d, toxicity.fit(d, l)).select("row.doc_id", "score"),
    "near": lambda d, *_: near.representatives(d).select("doc_id", "text"),
    "simhash rows": lambda d, *_: simhash.representatives(d).select("doc_id", "text"),
    "clean": lambda d, _, b: decontaminate.decontaminated(d, b).select("doc_id", "text"),
    "redacted": lambda d, *_: secrets.redacted_documents(d).select("doc_id", "text", "n_chars"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(docs, wide, labels, bench, name):
    run = OPERATORS[name]
    plain = rows(run(docs, labels, bench))
    assert rows(run(wide, labels, bench)) == plain
    assert run(wide.limit(0), labels, bench).count() == 0


def test_stages_keep_all_columns(spark, wide, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, str(tmp_path))
        if k < 4:
            assert out.columns == wide.columns, name
        assert {r.row for r in out.select("row").collect()} <= {"clash"}, name


@pytest.mark.parametrize("empty", ["labels", "benchmark"])
def test_empty_side_tables(spark, docs, labels, bench, tmp_path, empty):
    (labels.limit(0) if empty == "labels" else labels).write.parquet(f"{tmp_path}/labels.parquet")
    (bench.limit(0) if empty == "benchmark" else bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 30), (1, "u", "<p>" + "word " * 30), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "x" * 1_000_000)], "page_id long, url string, html string")
    wide = pages.withColumns({c: F.lit("clash") for c in [*CLASH, "text", "n_chars"]})
    assert rows(html.extracted(wide)) == rows(html.extracted(pages)) and rows(warc.round_trip(wide)) == rows(warc.round_trip(pages))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 120, 10)] + [(0, [0.0, 1.0]), (0, [5.0, 1.0]), (None, [1.0, 1.0]), (7, None)], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(vectors.withColumns({c: F.lit("x") for c in ("v", "d", "x", "bucket", "block")}))) == rows(topk.top_k(vectors))
    vectors = vectors.withColumn("label", (F.col("vec_id") / 10 % 2).cast("int"))
    wide = vectors.withColumns({c: F.lit("x") for c in ("d", "x", "list", "a", "w", "n", "key", "dims", "windows", "least", "score")})
    assert rows(negatives.mined(wide, every=20, low=1, high=99)) == rows(negatives.mined(vectors, every=20, low=1, high=99)) != []


def test_queries_have_the_contracts_columns(spark, sf):
    want = {
        "op1_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op2_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op4_html_extraction": "page_id url text n_chars",
        "op7_warc_round_trip": "page_id payload_bytes payload_digest record_type refers_to",
        "op9_toxicity": "doc_id held_out score predicted",
        "op10_simhash_near_dedup": "doc_id fingerprint component_id",
        "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256",
        "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op13_phrase_collocations": "lang rank phrase a l r n score",
    }
    made = queries.queries()
    assert sorted(int(name[2:].split("_")[0]) for name in made) == list(range(1, len(made) + 1))
    for name, columns in want.items():
        assert made[name](spark, sf).columns == columns.split()
