"""Read scores over the order tables: suppliers stand for archives, orders modulo 20 for molecules, lines for reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import scalars
from lamina.functions.labels import KNOWN
from lamina.operators import decisions, votes

#: Fixed value: truth of archives, dealt by number.
CATEGORIES = ("BCH", "Convolutional", "LDPC", "Polar", "no_ecc", "HEDGES", "DNA-Aeon", "BCH", "Polar")
PRESENCE, ENERGY, PROXY = 0.36, -5.3, 0.8
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")

#: Logits and presence, the same text in Spark and DuckDB.
EXPRESSIONS = {
    "archive_id": "l_suppkey",
    "molecule_id": "l_orderkey % 20",
    "x0": "l_quantity / 25.0 + ((l_suppkey * 7 + 0) % 11) / 2.0",
    "x1": "l_discount * 20.0 + ((l_suppkey * 7 + 3) % 11) / 2.0",
    "x2": "l_tax * 25.0 + ((l_suppkey * 7 + 6) % 11) / 2.0",
    "x3": "l_extendedprice / 50000.0 + ((l_suppkey * 7 + 9) % 11) / 2.0",
    "presence": "(l_quantity + (l_suppkey % 13) * 4) / 100.0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logits() -> list[Column]:
    return [F.col(f"x{i}") for i in range(4)]


def category(archive: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (archive * 5 % len(CATEGORIES)).cast("int") + 1)


def read_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(table(spark, sf_dir, "lineitem"))


def scored_lines(lines: DataFrame) -> DataFrame:
    return lines.select(*[F.expr(e).alias(n) for n, e in EXPRESSIONS.items()], *ORDER).withColumn("category", category(F.col("archive_id")))


def vote_values() -> dict[str, Column]:
    p = scalars.softmax(logits())
    return {
        "ecc_score": F.col("presence"),
        **{f"p{i}": c for i, c in enumerate(p)},
        **{f"m{i}": c for i, c in enumerate(logits())},
        "energy_score": scalars.energy(logits()),
        "proxy_score": scalars.softmax_entropy(p),
    }


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per archive: scores, closed-set label and truth."""
    return archives_of(read_scores(spark, sf_dir))


def archives_of(reads: DataFrame) -> DataFrame:
    voted = votes.two_level(reads, vote_values())
    return voted.withColumn("closed", scalars.argmax([F.col(f"p{i}") for i in range(4)], KNOWN)).withColumn("truth", category(F.col("archive_id")))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archives(spark, sf_dir)
    outputs = decisions.frozen(F.col("ecc_score"), F.col("energy_score"), F.col("proxy_score"), F.col("closed"), PRESENCE, ENERGY, PROXY)
    return a.select("*", *[c.alias(n) for n, c in outputs.items()])


_softmax = ", ".join(f"exp(x{i} - m) / (exp(x0 - m) + exp(x1 - m) + exp(x2 - m) + exp(x3 - m)) AS p{i}" for i in range(4))
_argmax = "CASE " + " ".join(f"WHEN p{i} = greatest(p0, p1, p2, p3) THEN '{k}'" for i, k in enumerate(KNOWN)) + " END"
_list = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
#: The same in SQL, as common table expressions reads, scored, archives, decided.
READS = f"reads AS (SELECT {', '.join(f'{e} AS {n}' for n, e in EXPRESSIONS.items())}, {', '.join(ORDER)}, {_list}[CAST(l_suppkey * 5 % {len(CATEGORIES)} AS INT) + 1] AS category FROM lineitem)"
SCORED = READS + f""", scored AS (
  SELECT *, -(m + ln(exp(x0 - m) + exp(x1 - m) + exp(x2 - m) + exp(x3 - m))) AS energy,
    -(p0 * ln(greatest(p0, 1e-15)) + p1 * ln(greatest(p1, 1e-15)) + p2 * ln(greatest(p2, 1e-15)) + p3 * ln(greatest(p3, 1e-15))) AS entropy
  FROM (SELECT *, {_softmax} FROM (SELECT *, greatest(x0, x1, x2, x3) AS m FROM reads)))"""
_inner = ", ".join(f"avg({c}) AS {n}" for n, c in {"ecc_score": "presence", "p0": "p0", "p1": "p1", "p2": "p2", "p3": "p3", "m0": "x0", "m1": "x1", "m2": "x2", "m3": "x3", "energy_score": "energy", "proxy_score": "entropy"}.items())
_outer = ", ".join(f"avg({n}) AS {n}" for n in ("ecc_score", "p0", "p1", "p2", "p3", "m0", "m1", "m2", "m3", "energy_score", "proxy_score"))
ARCHIVES = SCORED + f""", archives AS (
  SELECT *, {_argmax} AS closed, {_list}[CAST(archive_id * 5 % {len(CATEGORIES)} AS INT) + 1] AS truth
  FROM (SELECT archive_id, {_outer}, count(*) AS molecules, sum(n) AS reads
    FROM (SELECT archive_id, molecule_id, {_inner}, count(*) AS n FROM scored GROUP BY archive_id, molecule_id) GROUP BY archive_id))"""
DECIDED = ARCHIVES + f""", decided AS (
  SELECT *, CASE WHEN ecc_score < {PRESENCE} THEN 'no_ecc' WHEN energy_score > {ENERGY} THEN 'unknown_ecc' ELSE closed END AS energy_only,
    CASE WHEN ecc_score < {PRESENCE} THEN 'no_ecc' WHEN proxy_score > {PROXY} THEN 'unknown_ecc' ELSE closed END AS proxy_only,
    CASE WHEN ecc_score < {PRESENCE} THEN 'no_ecc' WHEN energy_score > {ENERGY} AND proxy_score > {PROXY} THEN 'unknown_ecc'
      WHEN energy_score > {ENERGY} OR proxy_score > {PROXY} THEN 'uncertain_ecc' ELSE closed END AS three_state
  FROM archives)"""
