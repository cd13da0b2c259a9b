"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). Token weights of the cells are raked: each round scales them so
that the sums by source, then by language, then by topic, equal the targets. A cell's ratio of raked to observed weight
gives its documents' probability min(1, lambda * ratio), with lambda calibrated so that the tokens expected to be kept
are the stated share of all. A document is kept when a uniform number made from its id is below its probability, so
runs agree and copies of an id share their fate.

Targets are powers of the observed shares: 1 keeps a marginal, 0 makes its values equal. Cells, not documents, are
iterated on, until the marginals are met; targets that contradict each other can't be, and how far the worst marginal is
off is returned with every row, as mix_error (over the tolerance of 1e-6 only then, or where 256 rounds don't do).

Defined cases: null and empty texts have no tokens and probability 1 (they weigh nothing); null source or language is
a value of its own, "(none)"; a row with a null id makes its number from its text; rows are decided one by one, so repeated
rows are kept or left together; very long texts count whole; cells with equal ratios (ties) share a probability; extra
columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_row, text_or_empty

#: Powers of the observed token shares that the three marginals shall have.
TARGETS = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.7}
#: Share of all tokens to keep.
KEEP = 0.75
#: Rounds of raking in a block, each of which sets the three marginals in turn.
ROUNDS = 4
#: Greatest difference of a marginal from its target that counts as met, and the most blocks.
TOLERANCE, MOST = 1e-6, 64
#: Up to so many cells a block runs in one task, where its windows need no shuffle.
ONE_TASK = 1 << 14

TOKENS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|{}<>=_0-9]"


def with_cells(docs: DataFrame, topic=None) -> DataFrame:
    """(row, mix_tokens, mix_source, mix_lang, mix_topic, _number): row holds all columns, _number lies in [0, 1). topic: a
    column expression; documents without one are told apart by the form of their text."""
    text = text_or_empty()
    none = F.lit("(none)")
    own = none if topic is None else topic
    # a number from the id, or from the text where there is none
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))
    number = F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = docs.select(
        as_row(docs), F.regexp_count(text, F.lit(TOKENS)).cast("long").alias("mix_tokens"), F.regexp_count(text, F.lit(SYMBOLS)).alias("_symbols"), F.length(text).alias("_chars"),
        F.coalesce(F.col("source").cast("string"), none).alias("mix_source"), F.coalesce(F.col("lang").cast("string"), none).alias("mix_lang"), own.cast("string").alias("_topic"), number.alias("_number"),
    )
    form = F.when(F.col("_symbols") * 10 > F.col("_chars"), "symbols").when(F.col("mix_tokens") < 100, "brief").when(F.col("mix_tokens") >= 1000, "long").otherwise("prose")
    return rows.withColumn("mix_topic", form if topic is None else F.coalesce("_topic", none)).drop("_symbols", "_chars", "_topic")


def with_goals(cells: DataFrame, targets=TARGETS) -> DataFrame:
    """cells with w, their tokens, and for each marginal the share that its value shall have, goal_<name>."""
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for name, power in targets.items():
        share = cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
        whole = share.agg(F.sum("raw").alias("whole"))
        out = out.join(share.crossJoin(F.broadcast(whole)).select(name, (F.col("raw") / F.col("whole")).alias(f"goal_{name}")), name)
    return out


def raked(cells: DataFrame, scratch: Scratch, targets=TARGETS, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """cells (the three marginals, tokens > 0) with w, the raked weights, which sum to 1, and error, the largest difference
    of a marginal from its goal. Blocks of ``ROUNDS`` rounds run until no marginal is off by more than the tolerance, or a
    block lowers the error by less than a thousandth (such targets contradict each other; the marginal set last holds
    then), or ``most`` blocks are done."""
    now = scratch.write("raked-0", with_goals(cells, targets))
    few = now.count() <= ONE_TASK
    error = float("inf")
    for k in range(1, most + 1):
        block = now.coalesce(1) if few else now
        for _ in range(ROUNDS):
            for name in targets:
                block = block.withColumn("w", F.col("w") * F.col(f"goal_{name}") / F.sum("w").over(Window.partitionBy(name)))
        now = scratch.write(f"raked-{k}", block)
        scratch.drop(f"raked-{k - 1}")
        before, error = error, margin_error(now, targets)
        if error <= tolerance or error > 0.999 * before:
            break
    return now.select(*targets, "tokens", "w", F.lit(error).alias("error"))


def margin_error(weighted: DataFrame, targets=TARGETS) -> float:
    """The largest difference between a marginal of the weights and its goal."""
    rows = weighted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("margin"), F.col(n).alias("value"), F.col(f"goal_{n}").alias("goal"), "w") for n in targets])))
    sums = rows.groupBy("margin", "value").agg(F.abs(F.sum("w") - F.first("goal")).alias("off"))
    return sums.agg(F.max("off")).first()[0] or 0.0


def probabilities(weighted: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds probability = min(1, lambda * w / tokens), lambda such that the expected tokens are ``keep`` of all."""
    cells = weighted.withColumn("ratio", F.col("w") / F.col("tokens"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    bound = float("inf")  # cells with a ratio of this or more are kept whole
    while True:
        whole, rest = cells.agg(F.coalesce(F.sum(F.when(F.col("ratio") >= bound, F.col("tokens"))), F.lit(0)), F.sum(F.when(F.col("ratio") < bound, F.col("w")))).first()
        scale = (keep * total - whole) / rest if rest else 0.0
        new = 1 / scale if scale > 0 else bound
        if not rest or new >= bound:
            break
        bound = new
    return cells.withColumn("probability", F.when(F.col("ratio") >= bound, 1.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * scale)))


def mixed(docs: DataFrame, targets=TARGETS, keep: float = KEEP, topic=None) -> DataFrame:
    """The kept documents: all their columns with mix_source, mix_lang, mix_topic, mix_tokens, mix_probability and mix_error,
    which take the place of columns so called."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = with_cells(docs, topic)
    names = list(targets)
    cells = scratch.write("cells", rows.where("mix_tokens > 0").groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")))
    weights = scratch.write("weights", raked(cells, scratch, targets))
    error = weights.agg(F.max("error")).first()[0] or 0.0
    chances = scratch.write("chances", probabilities(weights, keep).select(*names, "probability"))
    scratch.drop_but("chances")
    out = rows.join(chances, names, "left").withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.col("probability")).otherwise(1.0)).withColumn("mix_error", F.lit(error))
    added = [*names, "mix_tokens", "mix_probability", "mix_error"]
    return out.where(F.col("_number") < F.col("mix_probability")).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mixing_sql(table: str = "documents", targets=TARGETS, keep: float = KEEP) -> str:
    """DuckDB SQL for the rows of ``mixed`` as op5 returns them."""
    names = list(targets)
    steps = [f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS mix_source, coalesce(lang, '(none)') AS mix_lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKENS}')) AS BIGINT) AS mix_tokens
  FROM {table}
), t AS (
  SELECT *, CASE WHEN len(regexp_extract_all(text, '{SYMBOLS}')) * 10 > length(text) THEN 'symbols'
         WHEN mix_tokens < 100 THEN 'brief' WHEN mix_tokens >= 1000 THEN 'long' ELSE 'prose' END AS mix_topic
  FROM d
), c AS MATERIALIZED (
  SELECT {", ".join(names)}, sum(mix_tokens) AS tokens FROM t WHERE mix_tokens > 0 GROUP BY ALL
)"""]
    for name, power in targets.items():
        steps.append(f"g_{name} AS MATERIALIZED (SELECT {name}, raw / sum(raw) OVER () AS goal FROM (SELECT {name}, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS raw FROM c GROUP BY 1))")
    joins = " ".join(f"JOIN g_{n} USING ({n})" for n in names)
    columns = ", ".join(["tokens", *names, *(f"goal_{n}" for n in names)])
    steps.append("w0 AS MATERIALIZED (SELECT c.*, CAST(tokens AS DOUBLE) AS w, " + ", ".join(f"g_{n}.goal AS goal_{n}" for n in names) + f" FROM c {joins})")
    block = "u"
    for n in names * ROUNDS:
        block = f"(SELECT * REPLACE (w * goal_{n} / sum(w) OVER (PARTITION BY {n}) AS w) FROM {block})"
    off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {n}) - goal_{n})" for n in names)
    # blocks of rounds; a state has the error of its marginals and that before it
    steps.append(f"""u AS (
  SELECT {columns}, w, 0 AS k, CAST('inf' AS DOUBLE) AS error, CAST('inf' AS DOUBLE) AS before FROM w0
  UNION ALL
  SELECT {columns}, w, k + 1, max(off) OVER (), error FROM (SELECT *, greatest({off}) AS off FROM {block} AS b)
  WHERE k < {MOST} AND (k = 0 OR (error > {TOLERANCE} AND (k = 1 OR error <= 0.999 * before)))
), w AS MATERIALIZED (SELECT * FROM u WHERE k = (SELECT max(k) FROM u))""")
    # lambda: the cells by falling ratio; the first j of them whole, the others scaled
    steps.append(f"""r AS MATERIALIZED (
  SELECT *, w / tokens AS ratio, sum(tokens) OVER (ORDER BY w / tokens DESC) AS upto, sum(w) OVER (ORDER BY w / tokens DESC) AS w_upto,
         sum(tokens) OVER () AS total, sum(w) OVER () AS w_total FROM w
), l AS (
  SELECT max(s) AS scale FROM (
    SELECT {keep} * max(total) / max(w_total) AS s, max(ratio) AS next FROM r
    UNION ALL
    SELECT ({keep} * total - upto) / (w_total - w_upto), (SELECT max(r2.ratio) FROM r r2 WHERE r2.ratio < r.ratio) FROM r WHERE w_total - w_upto > 1e-12
  ) WHERE s > 0 AND s * next <= 1
), p AS (SELECT {", ".join(names)}, least(1.0, ratio * scale) AS probability FROM r, l)
SELECT doc_id, mix_source, mix_lang, mix_topic, mix_tokens, round(CASE WHEN mix_tokens > 0 THEN probability ELSE 1 END, 6) AS probability
FROM t LEFT JOIN p USING ({", ".join(names)})
WHERE CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text)), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} < CASE WHEN mix_tokens > 0 THEN probability ELSE 1 END""")
    return ",\n".join(steps)
