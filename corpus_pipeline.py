"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet and reads it again as the next one's documents.

* quality rules: rejected documents go; of the others, lines that break a rule;
* near-duplicates: of each component of near copies, the document of least id stays
  (of rows that share an id, one; a row without an id only if none of them has one);
* decontamination: documents that a benchmark contaminates go;
* secrets: every span found is masked in the text;
* mixing: documents that the mix does not take go; ``taken`` has the words taken,
  repeats counted, ``copies`` how often the document goes in.

All but the last stage return the columns of documents, with ``n_chars`` (if there is
such a column) kept in step with the text. Columns beside those named here pass
through; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality_rules, secrets, simhash
from tidemark.llm.common import durable, read, where_computed
from tidemark.session import checkpoint_dir


def _with_text(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The input columns, inside the struct ``row`` so far, with a new text."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(where_computed(quality_rules.assess(docs), F.col("kept")), docs.columns, F.col("clean_text"))


def _dedup_key(docs: DataFrame) -> Column:
    """The id, or a number beyond all ids from the text's hash: rows without an id are copies like any others, and leave rows with one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(F.struct("*").alias("row"), _dedup_key(docs).alias("key"), F.col("text"))
    labels = simhash.near_duplicates(keyed, id_col="key")
    stay = durable(labels.where(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count("*").alias("rows")))
    once = keyed.join(stay.where("rows = 1").select(F.col("id").alias("key")), "key", "left_semi").select("row.*")
    again = stay.where("rows > 1").select(F.col("id").alias("key"))
    if again.isEmpty():
        return once
    repeated = keyed.join(again, "key", "left_semi")
    return once.unionByName(repeated.groupBy("key").agg(F.min_by("row", F.struct("text")).alias("row")).select("row.*"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    found = decontaminate.scan(rows, read(spark, sf_dir, "benchmark"), carry=("row",))
    judged = found.withColumn("n_hit", decontaminate.hit_words())
    return judged.where(~decontaminate.contaminated()).select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs)
    # A text without secrets stays as it is, null too.
    masked = F.when(F.size("spans") > 0, secrets.mask(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    return _with_text(found, docs.columns, masked)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(docs, F.array("source"))
    own = ["size", "taken", "copies"]
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in own]
    return where_computed(mixed, F.col("taken") > 0).select(*kept, "size", "taken", (F.col("taken") / F.col("size")).cast("long").alias("copies"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mixing", mix_stage),
]

#: Fingerprint links and the flow are not for SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each result is a table in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
