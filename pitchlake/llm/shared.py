"""Helpers common to the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import checkpoint_folder, written

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's shared checkpoint folder (``spark.checkpoint.dir``) and go on from there."""
    return written(df)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of the frame's own (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """The frame's columns but for those named; an operator's own columns replace these."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def schema_with(df: DataFrame, keep: list[str], **added: T.DataType) -> T.StructType:
    """The schema of the kept columns (all nullable), then the added ones."""
    by = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([T.StructField(c, by[c]) for c in keep] + [T.StructField(c, t) for c, t in added.items()])


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by '|'; SQL engines agree on it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the session's ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
