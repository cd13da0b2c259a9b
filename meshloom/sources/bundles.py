"""Mode bundles: fields on a staggered grid as Parquet beside a manifest of digests; files and runs by digest."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.evidence import canonical, digest
from meshloom.operators.mesh import ContractError

COLUMNS = ["component", "i", "j", "k", "re", "im"]


def content_digest(rows: DataFrame) -> str:
    """SHA-256 of sums of row hashes: the same for any order and partitions of the rows."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    return hashlib.sha256(",".join(str(x) for x in rows.agg(*words, F.count("*")).first()).encode()).hexdigest()


def write_bundle(fields: DataFrame, path: str, metadata: dict) -> dict:
    """Writes fields(component, i, j, k, re, im) and a manifest row; an existing bundle is never overwritten."""
    spark = fields.sparkSession
    rows = fields.select(*COLUMNS)
    rows.write.mode("errorifexists").parquet(f"{path}/fields")
    written = spark.read.parquet(f"{path}/fields")
    manifest = {"schema": "mode-bundle-1", "content": content_digest(written), "rows": written.count(), "metadata": metadata}
    spark.createDataFrame([(canonical(manifest), digest(manifest))], "manifest string, digest string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str, most_rows: int = 1 << 27) -> tuple[DataFrame, dict]:
    """The fields and the manifest; a changed manifest, changed fields or too many rows are errors."""
    row = spark.read.parquet(f"{path}/manifest").first()
    manifest = json.loads(row.manifest)
    if digest(manifest) != row.digest or manifest["schema"] != "mode-bundle-1":
        raise ContractError("the manifest isn't what was written")
    if manifest["rows"] > most_rows:
        raise ContractError(f"the bundle has {manifest['rows']} rows, the bound is {most_rows}")
    fields = spark.read.parquet(f"{path}/fields").select(*COLUMNS)
    if content_digest(fields) != manifest["content"]:
        raise ContractError("the fields aren't what was written")
    return fields, manifest


def lowered(fields: DataFrame, most: float = 5e-6) -> tuple[DataFrame, DataFrame]:
    """The fields in single precision, and one row (worst, norm_error, ok): greatest error over the greatest value, and
    relative error in norm."""
    single = fields.withColumns({c: F.col(c).cast("float").cast("double") for c in ("re", "im")})
    both = fields.withColumns({f"{c}_s": F.col(c).cast("float").cast("double") for c in ("re", "im")})
    far = F.hypot(F.col("re") - F.col("re_s"), F.col("im") - F.col("im_s"))
    size = F.hypot("re", "im")
    report = both.agg((F.max(far) / F.max(size)).alias("worst"), (F.sqrt(F.sum(far * far)) / F.sqrt(F.sum(size * size))).alias("norm_error"))
    return single, report.withColumn("ok", (F.col("worst") <= most) & (F.col("norm_error") <= most))


def coordinate_digest(points: DataFrame, axes: list[str]) -> str:
    """Digest of points by their exact coordinates, in no order."""
    return content_digest(points.select(*[F.hex(F.col(a).cast("string").cast("binary")).alias(a) for a in axes]))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def sha256_file(path: str, piece: int = 1 << 20) -> str:
    """SHA-256 of one local file, read in pieces."""
    if piece <= 0 or not os.path.isfile(path):
        raise ContractError(f"{path} is no file")
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(piece):
            out.update(data)
    return out.hexdigest()


#: Roles and states of a run's record.
ROLES = ("canonical_numerical", "raw_provenance", "descriptor", "input", "log", "report")
PROCESS = ("not_run", "succeeded", "failed")
CONVERGENCE = ("converged", "not_converged", "not_evaluated")
EVIDENCE = ("not_evaluated", "passed", "failed", "blocked")


@dataclass(frozen=True)
class RunManifest:
    """What ran, on what, and how it ended; its digest names it."""

    run_id: str
    created_at: str
    backend: str
    version: str
    problem: str
    authorized: bool
    process: str = "not_run"
    convergence: str = "not_evaluated"
    evidence: str = "not_evaluated"
    artifacts: tuple[tuple[str, str, str, int], ...] = ()  # path, role, sha256, size
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        named = all(isinstance(x, str) and x and x == x.strip() for x in (self.run_id, self.backend, self.version))
        hashed = all(len(h) == 64 and set(h) <= set("0123456789abcdef") for h in (self.problem, *(a[2] for a in self.artifacts)))
        states = self.process in PROCESS and self.convergence in CONVERGENCE and self.evidence in EVIDENCE
        paths = [a[0] for a in self.artifacts]
        if not (named and hashed and states) or len(set(paths)) != len(paths) or any(a[1] not in ROLES or a[3] < 0 or a[0].startswith("/") or ".." in a[0].split("/") for a in self.artifacts):
            raise ContractError("a run manifest's names, digests, states or artifacts are wrong")
        if datetime.fromisoformat(self.created_at).tzinfo is None:
            raise ContractError("a run's time needs a zone")
        if self.process == "not_run" and self.convergence != "not_evaluated":
            raise ContractError("what didn't run hasn't converged")

    def data(self) -> dict:
        names = ("run_id", "created_at", "backend", "version", "problem", "authorized", "process", "convergence", "evidence", "metadata")
        return {n: getattr(self, n) for n in names} | {"artifacts": [list(a) for a in self.artifacts]}

    def json(self) -> str:
        return canonical(self.data())

    def digest(self) -> str:
        return digest(self.data())

    @classmethod
    def of(cls, text: str) -> RunManifest:
        data = json.loads(text)
        return cls(**{**data, "artifacts": tuple(tuple(a) for a in data["artifacts"])})


def iso_instant(text):
    """A Column: the instant of ISO-8601 text with a zone; text without one is an error."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.to_timestamp(text)).otherwise(F.raise_error(F.concat(F.lit("no zone: "), text)).cast("timestamp"))


def finite(value: float, positive: bool = False) -> float:
    """The number, or an error on what is no finite (positive) number."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or positive and value <= 0:
        raise ContractError("a finite" + " positive" * positive + " number is needed")
    return float(value)
