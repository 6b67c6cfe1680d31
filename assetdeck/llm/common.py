"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetdeck.session import shared_dir

#: A word: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back with the same schema.

    A lost executor costs only what comes after; the reread table also has a known size, so the optimizer
    broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold`` and else plans a join whose skewed
    partitions adaptive execution can split.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside ``extra``, so no column name of the input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[c.alias(n) for n, c in extra.items()])


def with_text(row: str, columns: list[str], text: Column) -> list[Column]:
    """The columns of a packed row with ``text`` replaced and ``n_chars``, where present, brought in line."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [(new[c] if c in new else F.col(f"{row}.`{c}`")).alias(c) for c in columns]
