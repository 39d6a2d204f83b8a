"""Helpers shared by the operators: input tables, Python workers, durable cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, ship_package

# A word is a run without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder, and cut its lineage.

    The files survive a lost executor. They are written to the folder in
    ``spark.checkpoint.dir`` (see ``tidemark.session.checkpoint_dir``).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_python(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers."""
    ship_package(spark)
    return spark


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without an array: word starts are non-spaces after a space or the start."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0).cast("long")).otherwise((spaces + 1).cast("long"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], item_type: str) -> Column:
    """``emit(state, x)`` of every item in order, the state before it carried on by ``step(state, x)``.

    An array that grows item by item is copied at every step, so results are gathered
    in pieces of about the square root of the array's size.
    """
    none = F.array().cast(f"array<{item_type}>")

    def piece(state: Column, xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(state.alias("state"), none.alias("out")),
            lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x).cast(item_type))).alias("out")),
        )

    def whole(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), F.size(xs) - 1, width),
            F.struct(zero.alias("state"), none.alias("out")),
            lambda acc, at: let(piece(acc["state"], F.slice(xs, at + 1, width)), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], got["out"]).alias("out"))),
            lambda acc: acc["out"],
        )

    return let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a computed column holds, filtered above the steps that compute it.

    The optimizer copies a condition's expressions down through projections, which
    would put a text's word array into every step of a lambda over it. A condition on
    a non-deterministic column, here always true, stays where it is.
    """
    return df.withColumn("__stay", F.spark_partition_id()).where(condition & (F.col("__stay") >= 0)).drop("__stay")
