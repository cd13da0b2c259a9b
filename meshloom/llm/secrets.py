"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger is a table of
(rule_version, blob, findings): one row for each blob scanned under a rule version. A scan hashes the given versions,
scans one copy of each blob that the ledger lacks under the present rule version, appends these rows, and joins the
findings back to every path (row) that holds the blob. Only ids are compared with the ledger; a text moves only when its
blob may be new, and then once for each task that holds copies.

A ledger lives at the path given, or that ``meshloom.secrets.ledger`` names in the session; without either, a run has its
own. A run whose blobs are all known scans nothing.

Defined cases: a null text is the empty blob, which holds no finding; repeated rows and equal texts (ties) are scanned
once and each gets the findings; very long texts are scanned whole, in time linear in their length; null ids stay; extra
columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_row, sifted, text_or_empty

#: Kinds in the order that breaks ties, pattern, group and length that a match needs. The first three are
#: the base rules.
RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,32}PRIVATE KEY-----", 0, 64),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 24),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
FINDINGS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of the rules."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def joined(findings) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in findings)


def blob_of(text_col: str = "text"):
    return F.sha2(F.encode(text_or_empty(text_col), "UTF-8"), 256)


def scan_versions(versions: DataFrame, ledger: str, text_col: str = "text", rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, findings) of the blobs that hold any, among all that the ledger knows afterwards; reads and extends the
    ledger at the path ``ledger``."""
    spark = versions.sparkSession
    blobs = versions.select(blob_of(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    if known.isEmpty():
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    else:
        scratch = Scratch(spark, "unseen")
        ids = scratch.write("ids", blobs.select("blob").distinct().join(known, "blob", "left_anti"))
        unseen = sifted(scratch, blobs, ids, "unseen", ("blob",)).groupBy("blob").agg(F.first("text").alias("text")).join(ids, "blob", "left_semi")

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py(), rules)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, FINDINGS_ARROW)], ["blob", "findings"])

    scanned = unseen.mapInArrow(run, f"blob string, findings {FINDINGS}")
    scanned.withColumn("rule_version", F.lit(rule_version)).select("rule_version", "blob", "findings").write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])


def ledger_of(scratch: Scratch, ledger: str | None) -> str:
    return ledger or scratch.spark.conf.get("meshloom.secrets.ledger", None) or scratch.path("ledger")


def read_ledger(spark, ledger: str) -> DataFrame:
    schema = f"rule_version string, blob string, findings {FINDINGS}"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def redact(text: str, findings) -> str:
    """The text with each finding replaced by [SECRET]; overlapping findings become one."""
    out, at = [], 0
    for _, start, end in sorted(findings, key=lambda f: (f[1], -f[2])):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The documents with their secrets redacted and n_chars counted anew where the text changed. Texts without findings
    are never shuffled."""
    scratch = Scratch(docs.sparkSession, "redact")
    found = scan_versions(docs.select("text"), ledger_of(scratch, ledger))
    rows = docs.select(as_row(docs), blob_of().alias("blob"))
    maybe = sifted(scratch, rows, found, "found", ("blob",)).join(found, "blob", "left").select("row", F.col("row.text").cast("string").alias("text"), "findings")
    same = sifted(scratch, rows, found, "found", ("blob",), inside=False).select("row")

    def run(batches):
        for batch in batches:
            new = [redact(t.as_py(), [(f["kind"], f["start"], f["end"]) for f in fs.as_py()]) if fs.is_valid else None for t, fs in zip(batch.column(1), batch.column(2))]
            size = [None if t is None else len(t) for t in new]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(size, pa.int64())], ["row", "new", "size"])

    out = maybe.mapInArrow(run, f"row {docs.select(as_row(docs)).schema['row'].dataType.simpleString()}, new string, size long")
    fresh = {"text": "new", "n_chars": "size"}
    kind = dict(docs.dtypes)
    changed = out.select(*[F.coalesce(F.col(fresh[c]).cast(kind[c]), F.col("row")[c]).alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])
    return changed.unionByName(same.select("row.*"))


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scan_versions(docs.select("text"), ledger_of(scratch, ledger))
    found = docs.select("doc_id", blob_of().alias("blob")).join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.from_json(F.lit("[]"), FINDINGS)))
    write = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(write(base), 256).alias("base_sha256"), write("findings").alias("spans"))
