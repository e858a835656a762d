"""Joining the inputs and checking the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions import seeded_uniform
from textlens.operators import joins, quality
from textlens.operators.compare_tree import compare_by_tree
from textlens.plans import fixtures as fx
from textlens.plans.registry import query, u
from textlens.plans.scalar_queries import label_strings, shifted_labels
from textlens.sources import number_rows

_SHIFTED = "SELECT lab.id * 3 AS id, lab.y FROM lab"


def _repeated(rows, purpose: str):
    """The rows, some of them (told by a hash) twice."""
    again = rows.filter(seeded_uniform(purpose, F.col("id")) < 0.2)
    return rows.unionByName(again)


def _repeated_sql(relation: str, purpose: str) -> str:
    return (
        f"(SELECT * FROM {relation} UNION ALL SELECT * FROM {relation}"
        f" WHERE {u(repr(purpose), 'id')} < 0.2)"
    )


_DOCS = "(SELECT doc_id AS id, source AS keyword, lang AS country, text FROM documents)"


@query(
    "attach_text",
    f"""SELECT l.id, l.y::INTEGER AS y, d.keyword, d.country, d.text
    FROM {_repeated_sql(f"({_SHIFTED})", "labels")} l
    LEFT JOIN {_repeated_sql(_DOCS, "texts")} d ON d.id = l.id""",
)
def _(spark, sf):
    labels = _repeated(shifted_labels(spark, sf), "labels").drop("label_vec")
    texts = _repeated(fx.corpus(spark, sf), "texts")
    return joins.attach_text(labels, texts).select("id", "y", "keyword", "country", "text")


@query(
    "missing_text",
    f"""SELECT l.id, l.y::INTEGER AS y FROM ({_SHIFTED}) l
    LEFT JOIN documents d ON d.doc_id = l.id WHERE d.text IS NULL""",
)
def _(spark, sf):
    rows = joins.missing_text(shifted_labels(spark, sf), fx.corpus(spark, sf))
    return rows.select("id", "y")


@query(
    "align_by_position",
    """SELECT doc_id - 1 + 1 AS row_id, doc_id AS id, source AS keyword, lang AS country
    FROM documents""",
)
def _(spark, sf):
    documents = fx.table(spark, sf, "documents")
    first = number_rows(documents.select("doc_id", "source"))
    second = number_rows(documents.select("lang"))
    zipped = joins.align_by_position(first, second)
    return zipped.select(
        "row_id",
        F.col("doc_id").alias("id"),
        F.col("source").alias("keyword"),
        F.col("lang").alias("country"),
    )


@query("lookup_by_key", "SELECT id, pred, text FROM sc WHERE y = 1 AND pred = 0")
def _(spark, sf):
    missed = fx.scored_labels(spark, sf).filter("y = 1 AND pred = 0").select("id", "pred")
    return joins.lookup_by_key(missed, fx.corpus(spark, sf)).select("id", "pred", "text")


@query(
    "labels_of_subset",
    "SELECT id, l0::DOUBLE AS l0, l1::DOUBLE AS l1 FROM sc WHERE y = 1 AND pred = 0",
)
def _(spark, sf):
    missed = fx.scored_labels(spark, sf).filter("y = 1 AND pred = 0")
    rows = joins.labels_of_subset(missed, fx.labels(spark, sf))
    return rows.select("id", F.col("label_vec")[0].alias("l0"), F.col("label_vec")[1].alias("l1"))


def _edited(rows):
    """A copy of the corpus with some rows gone and some cells changed, told by a hash."""
    key = F.col("id")
    country = F.when(seeded_uniform("null", key) < 0.05, None).otherwise(F.col("country"))
    text = F.when(seeded_uniform("edit", key) < 0.1, F.upper("text")).otherwise(F.col("text"))
    return rows.filter(seeded_uniform("drop", key) >= 0.05).select(
        "id", "keyword", country.alias("country"), text.alias("text")
    )


_EDITED = f"""(SELECT id, keyword,
      CASE WHEN {u("'null'", "id")} < 0.05 THEN NULL ELSE country END AS country,
      CASE WHEN {u("'edit'", "id")} < 0.1 THEN upper(text) ELSE text END AS text
    FROM {_DOCS} WHERE {u("'drop'", "id")} >= 0.05)"""


_COMPARE_SQL = f""", l AS (SELECT * FROM {_DOCS}), r AS (SELECT * FROM {_EDITED})
    SELECT l.id, NULL::VARCHAR AS column_name, 'left_only' AS problem
    FROM l WHERE l.id NOT IN (SELECT id FROM r)
    UNION ALL SELECT l.id, 'country', 'differs' FROM l JOIN r ON l.id = r.id
      WHERE l.country IS DISTINCT FROM r.country
    UNION ALL SELECT l.id, 'text', 'differs' FROM l JOIN r ON l.id = r.id
      WHERE l.text IS DISTINCT FROM r.text"""


@query("compare_tables", _COMPARE_SQL)
def _(spark, sf):
    documents = fx.corpus(spark, sf)
    return joins.compare_tables(documents, _edited(documents), "id", ["keyword", "country", "text"])


@query("compare_by_tree", _COMPARE_SQL)
def _(spark, sf):
    documents = fx.corpus(spark, sf)
    return compare_by_tree(documents, _edited(documents), "id", ["keyword", "country", "text"])


@query(
    "check_row_count",
    f"""SELECT 'row_count' AS "check", (SELECT count(*) FROM lab) AS expected,
      (SELECT count(*) FROM {_repeated_sql("lab", "labels")}) AS actual,
      (SELECT count(*) FROM lab) = (SELECT count(*) FROM {_repeated_sql("lab", "labels")}) AS ok""",
)
def _(spark, sf):
    rows = fx.labels(spark, sf)
    return quality.check_row_count(rows, _repeated(rows, "labels"))


_CONTENT_SQL = f"""SELECT e.id, 'country' AS column_name, 'differs' AS problem
      FROM ex e WHERE {u("'null'", "id")} < 0.05 AND {u("'drop'", "id")} >= 0.05
        AND country IS NOT NULL
    UNION ALL SELECT e.id, 'text', 'differs' FROM ex e
      WHERE {u("'edit'", "id")} < 0.1 AND {u("'drop'", "id")} >= 0.05 AND text <> upper(text)
    UNION ALL SELECT e.id, NULL, 'right_only' FROM ex e WHERE {u("'drop'", "id")} < 0.05"""


def _content(spark, sf):
    documents, labels = fx.corpus(spark, sf), fx.labels(spark, sf)
    processed = _edited(joins.attach_text(labels, documents))
    return quality.check_content(
        processed, labels.select("id"), documents, "id", ["keyword", "country", "text"]
    )


@query("check_content", _CONTENT_SQL)
def _(spark, sf):
    return _content(spark, sf)


@query(
    "check_tables_equal",
    """SELECT 'tables_equal' AS "check", 0::BIGINT AS expected, 0::BIGINT AS actual, true AS ok""",
)
def _(spark, sf):
    documents = fx.corpus(spark, sf)
    again = documents.select("text", "country", "keyword", "id")
    return quality.check_tables_equal(documents, again, "id", ["keyword", "country", "text"])


@query(
    "check_missing",
    f"""SELECT 'missing_text' AS "check", 0::BIGINT AS expected, count(*) AS actual,
      count(*) = 0 AS ok
    FROM ({_SHIFTED}) l LEFT JOIN documents d ON d.doc_id = l.id WHERE d.text IS NULL""",
)
def _(spark, sf):
    return quality.check_missing(shifted_labels(spark, sf), fx.corpus(spark, sf))


@query(
    "duplicate_keys",
    f"SELECT id, count(*) AS n FROM {_repeated_sql(_DOCS, 'texts')} GROUP BY id HAVING count(*) > 1",
)
def _(spark, sf):
    return quality.duplicate_keys(_repeated(fx.corpus(spark, sf), "texts"), "id")


@query(
    "check_unique_key",
    """SELECT 'unique_key' AS "check", 0::BIGINT AS expected,
      (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS actual,
      (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS ok""",
)
def _(spark, sf):
    return quality.check_unique_key(fx.corpus(spark, sf), "id")


_BAD_LABELS = f"(SELECT count(*) FROM lab WHERE {u(repr('format'), 'id')} < 0.4)"


@query(
    "check_label_format",
    f"""SELECT 'label_format' AS "check", 0::BIGINT AS expected, {_BAD_LABELS} AS actual,
      {_BAD_LABELS} = 0 AS ok""",
)
def _(spark, sf):
    return quality.check_label_format(label_strings(spark, sf), fx.WIDTH)


@query(
    "quality_report",
    f"""SELECT 'row_count' AS "check", (SELECT count(*) FROM lab) AS expected,
      (SELECT count(*) FROM ex) AS actual, true AS ok
    UNION ALL SELECT 'columns', 4, 4, true
    UNION ALL SELECT 'missing_text', 0, 0, true
    UNION ALL SELECT 'unique_key', 0, 0, true
    UNION ALL SELECT 'label_format', 0, {_BAD_LABELS}, {_BAD_LABELS} = 0
    UNION ALL SELECT 'content', 0, (SELECT count(*) FROM ({_CONTENT_SQL})),
      (SELECT count(*) FROM ({_CONTENT_SQL})) = 0""",
)
def _(spark, sf):
    labels, documents = fx.labels(spark, sf), fx.corpus(spark, sf)
    processed = joins.attach_text(labels, documents)
    return quality.quality_report(
        quality.check_row_count(labels, processed),
        quality.check_columns(documents, ["id", "keyword", "country", "text"]),
        quality.check_missing(labels, documents),
        quality.check_unique_key(documents, "id"),
        quality.check_label_format(label_strings(spark, sf), fx.WIDTH),
        quality.content_check(_content(spark, sf)),
    )


@query(
    "check_columns",
    """SELECT 'columns' AS "check", 3::BIGINT AS expected, 4::BIGINT AS actual, false AS ok""",
)
def _(spark, sf):
    return quality.check_columns(fx.corpus(spark, sf), ["id", "keyword", "text"])


@query(
    "check_expected_rows",
    """SELECT 'expected_rows' AS "check", 1000::BIGINT AS expected, count(*) AS actual,
      count(*) = 1000 AS ok FROM documents""",
)
def _(spark, sf):
    return quality.check_expected_rows(fx.corpus(spark, sf), 1000)


@query(
    "column_report",
    """SELECT * FROM (
      SELECT 'doc_id' AS "column", 0::BIGINT AS expected_at, 0::BIGINT AS found_at, count(doc_id) AS n_values FROM documents
      UNION ALL SELECT 'title', 1, NULL, NULL
      UNION ALL SELECT 'text', 2, 1, count(text) FROM documents
      UNION ALL SELECT column_name, NULL, (row_number() OVER (ORDER BY place)) + 1, n
        FROM (SELECT 'lang' AS column_name, 1 AS place, count(lang) AS n FROM documents
          UNION ALL SELECT 'source', 2, count(source) FROM documents
          UNION ALL SELECT 'n_chars', 3, count(n_chars) FROM documents))""",
)
def _(spark, sf):
    stored = spark.read.parquet(f"{sf}/documents.parquet")
    return quality.column_report(stored, ["doc_id", "title", "text"])


_CHANGED = """SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END AS text,
  CASE WHEN doc_id % 11 = 5 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 13 <> 4"""


@query(
    "check_tables_differ",
    f"""SELECT 'tables_equal' AS "check", 0::BIGINT AS expected, count(*) AS actual, count(*) = 0 AS ok
    FROM (SELECT d.doc_id FROM documents d LEFT JOIN ({_CHANGED}) e USING (doc_id) WHERE e.doc_id IS NULL
      UNION ALL SELECT d.doc_id FROM documents d JOIN ({_CHANGED}) e USING (doc_id) WHERE d.text IS DISTINCT FROM e.text
      UNION ALL SELECT d.doc_id FROM documents d JOIN ({_CHANGED}) e USING (doc_id) WHERE d.lang IS DISTINCT FROM e.lang)""",
)
def _(spark, sf):
    documents = fx.corpus(spark, sf)
    edited = documents.where("id % 13 <> 4").select(
        "id",
        F.when(F.col("id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("id") % 11 == 5, F.lit(None)).otherwise(F.col("country")).alias("country"),
    )
    return quality.check_tables_equal(documents, edited, "id", ["country", "text"])


@query(
    "check_rows_against_table",
    """SELECT 'expected_rows' AS "check", (SELECT max(doc_id) + 1 FROM documents) AS expected,
      count(*) AS actual, count(*) = (SELECT max(doc_id) + 1 FROM documents) AS ok FROM labels""",
)
def _(spark, sf):
    last = fx.corpus(spark, sf).agg((F.max("id") + 1).alias("n"))
    return quality.check_expected_rows(fx.labels(spark, sf), last)
