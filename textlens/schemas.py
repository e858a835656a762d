"""Explicit schemas of every source; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# Keys are kept as they are written: a key such as "t_0" must not be lost.
CORPUS = _struct(
    ("id", T.StringType()),
    ("art_id", T.StringType()),
    ("keyword", T.StringType()),
    ("country", T.StringType()),
    ("text", T.StringType()),
    ("label", T.StringType()),
)

UNLABELLED = T.StructType(CORPUS.fields[:5])

LABELS = _struct(("id", T.StringType()), ("label", T.StringType()))

# A processed split has the corpus columns, with the label of the label file.
SPLIT = CORPUS

SCORES = _struct(
    ("id", T.StringType()), ("model_id", T.StringType()), ("score", T.DoubleType())
)

HISTORY = _struct(
    ("epoch", T.LongType()),
    ("loss", T.DoubleType()),
    ("dev_f1", T.DoubleType()),
    ("dev_p", T.DoubleType()),
    ("dev_r", T.DoubleType()),
)

RUNS = T.StructType([*HISTORY.fields, T.StructField("run_id", T.StringType())])

# Label names in vector order (fixed values).
LABEL_NAMES = (
    "Unbalanced Power Relations",
    "Shallow Solution",
    "Presupposition",
    "Authority Voice",
    "Metaphor",
    "Compassion",
    "The Poorer, the Merrier",
)


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
