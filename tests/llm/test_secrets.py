import hashlib
import re
import time

from meshloom.llm import secrets
from meshloom.llm.common import Scratch


def brute(text):
    found = []
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for order, (kind, pattern, group, least) in enumerate((("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [x for *_, x in sorted(found)]


TEXTS = [
    None,
    "",
    'é Password: "abcDEF123" and AKIA' + "A" * 16 + " " + "0f" * 12,
    "token=short token = longer_value api_key='x1y2z3w4' APIKEY:" + "ab12" * 6,
    "toſen Key ſecret = nomatch99 secret = match99x",
    "x" * 200_000 + " passwd=qwertz123",
    'é Password: "abcDEF123" and AKIA' + "A" * 16 + " " + "0f" * 12,
]


def test_report_matches_brute_force(spark, sf):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "clash"), (2, TEXTS[2], "clash")]
    rows += [(r.doc_id + 100, r.text, "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string").repartition(7)
    out = secrets.secret_report(docs).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), *(sum(x.startswith(k) for x in brute(t)) for k in ("assign:", "access:", "hex:"))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in out) == want
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_ledger_scans_only_unseen_blobs_and_versions(spark):
    ledger = Scratch(spark, "ledger").path("l")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    first = sorted(secrets.scan_versions(docs, ledger).collect())
    n = spark.read.parquet(ledger).count()
    assert n == len({t or "" for t in TEXTS})
    assert sorted(secrets.scan_versions(docs, ledger).collect()) == first
    assert spark.read.parquet(ledger).count() == n
    secrets.scan_versions(docs.union(spark.createDataFrame([(99, "new token=abcdefgh")], docs.schema)), ledger)
    assert spark.read.parquet(ledger).count() == n + 1
    secrets.scan_versions(docs, ledger, rule_version="other")
    assert spark.read.parquet(ledger).where("rule_version = 'other'").count() == n


def test_a_later_run_with_the_same_ledger_scans_nothing_and_finds_all_paths(spark, monkeypatch):
    ledger = Scratch(spark, "ledger").path("l")
    history = [(v, p, f"version {v} of {p} token = abcdef{v}") for v in range(3) for p in ("a", "b")] + [(9, "c", "version 0 of a token = abcdef0")]
    docs = spark.createDataFrame([(10 * v + i, t) for i, (v, _, t) in enumerate(history)], "doc_id long, text string")
    first = sorted(secrets.secret_report(docs, ledger).collect())
    assert all(r.n_assign == 1 for r in first) and spark.read.parquet(ledger).count() == 6
    spark.conf.set("meshloom.secrets.ledger", ledger)
    try:
        assert sorted(secrets.secret_report(docs).collect()) == first
    finally:
        spark.conf.unset("meshloom.secrets.ledger")
    assert spark.read.parquet(ledger).count() == 6


def test_rules_are_linear(spark):
    for text in ("eyJ" * 300_000, "token" * 200_000, "-----BEGIN PRIVATE KEY-----" * 30_000, "xoxa-" * 100_000, "ghp_" * 100_000):
        began = time.time()
        secrets.scan(text)
        assert time.time() - began < 5


def test_redaction_removes_findings_only(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, blob string, findings string, n_chars long")
    out = {r.doc_id: r for r in secrets.redacted_documents(docs).collect()}
    for i, t in enumerate(TEXTS):
        if t and secrets.scan(t):
            assert out[i].text == secrets.redact(t, secrets.scan(t)) and out[i].n_chars == len(out[i].text)
        else:
            assert out[i].text == t
        assert out[i].blob == "en" and out[i].findings == "s"
    assert len(secrets.redacted_documents(docs.union(docs)).collect()) == 2 * len(TEXTS) and secrets.redacted_documents(docs.limit(0)).count() == 0
