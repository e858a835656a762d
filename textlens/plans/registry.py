"""Registered queries and the SQL each one is checked against.

The SQL is written independently of the operators, in another engine's dialect, and
goes the plain way (correlated counts, whole-table windows) where the operator does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def shaped(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, so that two engines' sums can be compared."""
    return df.select(
        *[
            F.round(F.col(f.name), 6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: shaped(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = BASE + sql
        return build

    return register


def u(*parts: str) -> str:
    """SQL of the seeded uniform number; parts are SQL expressions."""
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return (
        f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT"
        f" / 4294967296.0::DOUBLE)"
    )


# Blank-separated pieces of a text.
BLANKS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
PIECES = f"list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda p: p <> '')"

_SCORE = " + ".join(
    f"round(0.65::DOUBLE * {u(repr(str(m)), 'id')} + 0.35::DOUBLE * y, 6)" for m in (1, 2, 3)
)

# lab: labels; ex: with text; tok: with tokens; sc: scored; lg: with logits.
BASE = rf"""
WITH lab AS (
  SELECT doc_id AS id, 1 - quality AS l0, toxic AS l1,
         CASE WHEN (1 - quality) + toxic > 0 THEN 1 ELSE 0 END AS y
  FROM labels),
ex AS (
  SELECT lab.*, d.source AS keyword, d.lang AS country, d.text
  FROM lab LEFT JOIN documents d ON d.doc_id = lab.id),
tok AS (
  SELECT *, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), []) AS toks FROM ex),
raw_sc AS (
  SELECT *, round(({_SCORE}) / 3, 6) AS score, len({PIECES}) AS n_ws FROM ex),
sc AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM raw_sc),
lg AS (
  SELECT *, ln(s / (1 - s)) AS logit
  FROM (SELECT *, greatest(least(score, 0.999999::DOUBLE), 0.000001::DOUBLE) AS s FROM sc)),
cm AS (
  SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
         count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn
  FROM sc),
size AS (
  SELECT count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM ex)
"""
