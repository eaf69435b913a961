"""Declared schemas and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "time", "category", "raw")])
ITEM = T.StructType(
    [
        T.StructField("hash_id", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("source_date", T.TimestampType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("bullets", T.ArrayType(T.StringType(), False)),
        T.StructField("raw", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("item_ord", T.IntegerType()),
    ]
)
PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "html")])
DEDUPE_REPLY = "ids array<string>"
SUMMARY_REPLY = "items array<struct<hash_id:string,title:string,bullets:array<string>>>"


def validate(df: DataFrame, schema: T.StructType, name: str = "input") -> DataFrame:
    """``df`` with the columns of ``schema`` in its order; extra columns go. A missing column or one of
    another type is an error at once, before any row is read. NTZ timestamps count as instants."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = []
    for f in schema.fields:
        if f.name not in have:
            wrong.append(f"{f.name} is missing")
        elif have[f.name].simpleString().removesuffix("_ntz") != f.dataType.simpleString():
            wrong.append(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    return df.select(*[F.col(f.name).cast(f.dataType) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in schema.fields])


def sound_rows(schema: T.StructType = ITEM) -> Column:
    """Whether a row keeps the NOT NULL constraints; for quarantine rather than failure."""
    ok = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            ok = ok & F.col(f.name).isNotNull()
    return ok
