"""Column expressions, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.functions import (
    bce_with_logits,
    decide,
    inject_keyword,
    is_missing,
    label_is_bad,
    labels_per_row,
    n_ws_tokens,
    ngrams,
    parse_label,
    percent_of,
    preview,
    quadrant,
    safe_ratio,
    seeded_uniform,
    sigmoid,
    unlabelled_targets,
)
from textlens.operators.joins import attach_text, cast_key_as_string, select_columns
from textlens.operators.losses import combined_loss, reduce_focal_loss
from textlens.operators.profile import split_by_class
from textlens.plans import fixtures as fx
from textlens.plans.registry import PIECES, query, u


@query("select_columns", "SELECT id, keyword, country, text FROM ex")
def _(spark, sf):
    return select_columns(fx.examples(spark, sf))


def label_strings(spark, sf):
    """Label strings, some of them broken in the ways that label files are."""
    kind = seeded_uniform("format", F.col("doc_id"))
    good = F.concat(F.lit("["), F.lit(1) - F.col("quality"), F.lit(", "), F.col("toxic"), F.lit("]"))
    text = (
        F.when(kind < 0.1, "[1, 0")
        .when(kind < 0.2, "(1,0)")
        .when(kind < 0.3, "[1,0] x")
        .when(kind < 0.4, "nan")
        .when(kind < 0.5, "[1.0, 0]")
        .otherwise(good)
    )
    return fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), text.alias("label"))


@query(
    "parse_label",
    f""", k AS (SELECT *, {u("'format'", "id")} AS kind FROM lab)
    SELECT id,
      CASE WHEN kind < 0.4 THEN 0.0 WHEN kind < 0.5 THEN 1.0 ELSE l0 END::DOUBLE AS v0,
      CASE WHEN kind < 0.5 THEN 0.0 ELSE l1 END::DOUBLE AS v1,
      kind < 0.4 AS label_bad
    FROM k""",
)
def _(spark, sf):
    vector = parse_label("label", fx.WIDTH)
    return label_strings(spark, sf).select(
        "id",
        vector[0].alias("v0"),
        vector[1].alias("v1"),
        label_is_bad("label", fx.WIDTH).alias("label_bad"),
    )


@query("binarise", "SELECT id, y::INTEGER AS y FROM lab")
def _(spark, sf):
    return fx.labels(spark, sf).select("id", "y")


@query("labels_per_row", "SELECT id, (l0 + l1)::DOUBLE AS n_labels FROM lab")
def _(spark, sf):
    return fx.labels(spark, sf).select("id", labels_per_row("label_vec").alias("n_labels"))


@query("word_tokens", "SELECT id, array_to_string(toks, ' ') AS tokens FROM tok")
def _(spark, sf):
    return fx.tokens(spark, sf).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "n_tokens",
    r"""SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INTEGER AS n_tokens
    FROM documents""",
)
def _(spark, sf):
    return fx.with_tokens(fx.all_documents(spark, sf)).select("id", "n_tokens")


@query("n_ws_tokens", f"SELECT doc_id AS id, len({PIECES})::INTEGER AS n_ws_tokens FROM documents")
def _(spark, sf):
    return fx.all_documents(spark, sf).select("id", n_ws_tokens("text").alias("n_ws_tokens"))


@query(
    "inject_keyword",
    "SELECT id, '[' || coalesce(keyword, '') || '] ' || coalesce(text, '') AS model_input FROM ex",
)
def _(spark, sf):
    return fx.examples(spark, sf).select("id", inject_keyword("keyword", "text").alias("model_input"))


@query(
    "unlabelled_targets",
    """SELECT doc_id AS id, -1.0::DOUBLE AS t0, -1.0::DOUBLE AS t1, -1 AS y
    FROM documents WHERE doc_id NOT IN (SELECT id FROM lab)""",
)
def _(spark, sf):
    vector, y = unlabelled_targets(fx.WIDTH)
    rest = fx.unlabelled(spark, sf).select("id", vector.alias("v"), y.alias("y"))
    return rest.select("id", F.col("v")[0].alias("t0"), F.col("v")[1].alias("t1"), "y")


def shifted_labels(spark, sf):
    """Label rows with keys of which many are not in the corpus."""
    return fx.labels(spark, sf).withColumn("id", F.col("id") * 3)


@query(
    "is_missing",
    """SELECT lab.id * 3 AS id, d.text IS NULL AS no_text, coalesce(d.lang, 'unknown') AS country
    FROM lab LEFT JOIN documents d ON d.doc_id = lab.id * 3""",
)
def _(spark, sf):
    rows = attach_text(shifted_labels(spark, sf), fx.corpus(spark, sf))
    return rows.select(
        "id", is_missing("text").alias("no_text"), F.coalesce("country", F.lit("unknown")).alias("country")
    )


@query("split_by_class", "SELECT id, text FROM ex WHERE y = 1")
def _(spark, sf):
    return split_by_class(fx.examples(spark, sf), 1).select("id", "text")


@query(
    "quadrant",
    """SELECT id, CASE WHEN y = 1 THEN CASE WHEN pred = 1 THEN 'TP' ELSE 'FN' END
                       ELSE CASE WHEN pred = 1 THEN 'FP' ELSE 'TN' END END AS quadrant FROM sc""",
)
def _(spark, sf):
    return fx.scored_labels(spark, sf).select("id", quadrant("y", "pred").alias("quadrant"))


@query("sigmoid", "SELECT id, round(1 / (1 + exp(-logit)), 6) AS p FROM lg")
def _(spark, sf):
    return fx.logits(fx.scored_labels(spark, sf)).select("id", sigmoid("logit").alias("p"))


@query("decide", "SELECT id, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS pred FROM sc")
def _(spark, sf):
    return fx.scored_labels(spark, sf).select("id", decide("score", 0.35).alias("pred"))


@query(
    "bce_with_logits",
    "SELECT id, round(-(y * ln(s) + (1 - y) * ln(1 - s)), 6) AS bce FROM lg",
)
def _(spark, sf):
    return fx.logits(fx.scored_labels(spark, sf)).select("id", bce_with_logits("logit", "y").alias("bce"))


_FOCAL = """pow(1 - CASE WHEN y = 1 THEN s ELSE 1 - s END, 2)
    * -ln(CASE WHEN y = 1 THEN s ELSE 1 - s END)"""


@query("focal_loss", f"SELECT id, round({_FOCAL}, 6) AS focal_loss FROM lg")
def _(spark, sf):
    rows = fx.logits(fx.scored_labels(spark, sf))
    return reduce_focal_loss(rows, reduction="none").select("id", "focal_loss")


@query(
    "focal_loss_reduced",
    f"""SELECT 'mean' AS reduction, round(avg({_FOCAL}), 6) AS focal_loss FROM lg
    UNION ALL SELECT 'sum', round(sum({_FOCAL}), 6) FROM lg""",
)
def _(spark, sf):
    rows = fx.logits(fx.scored_labels(spark, sf))
    mean, total = (
        reduce_focal_loss(rows, reduction=r).withColumn("reduction", F.lit(r)) for r in ("mean", "sum")
    )
    return mean.unionByName(total).select("reduction", "focal_loss")


@query(
    "combined_loss",
    f""", cells AS (
      SELECT logit * 0.5 AS x, l0 AS t FROM lg UNION ALL SELECT logit * 0.25, l1 FROM lg),
    f AS (SELECT avg({_FOCAL}) AS focal_loss FROM lg),
    b AS (SELECT avg(ln(1 + exp(x)) - x * t) AS label_loss FROM cells)
    SELECT round(focal_loss, 6) AS focal_loss, round(label_loss, 6) AS label_loss,
           round(focal_loss + 0.3 * label_loss, 6) AS combined_loss FROM f, b""",
)
def _(spark, sf):
    rows = fx.logits(fx.scored_labels(spark, sf))
    return combined_loss(
        rows.withColumn("label_logits", F.array(F.col("logit") * 0.5, F.col("logit") * 0.25))
    )


@query(
    "safe_ratio",
    """SELECT keyword, round(CASE WHEN sum(pred) = 0 THEN 0
         ELSE sum(y * pred)::DOUBLE / sum(pred) END, 6)::DOUBLE AS precision
    FROM sc GROUP BY keyword""",
)
def _(spark, sf):
    groups = fx.scored(fx.examples(spark, sf)).groupBy("keyword")
    return groups.agg(safe_ratio(F.sum(F.col("y") * F.col("pred")), F.sum("pred")).alias("precision"))


@query("preview", "SELECT doc_id AS id, substr(text, 1, 120) AS preview FROM documents")
def _(spark, sf):
    return fx.corpus(spark, sf).select("id", preview("text").alias("preview"))


@query(
    "cast_key_as_string",
    "SELECT doc_id::VARCHAR AS id, n_chars::VARCHAR AS n_chars, lang FROM documents",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return cast_key_as_string(rows, "id", "n_chars")


@query(
    "ngrams",
    """SELECT id, array_to_string(
         list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]), '|') AS bigrams
    FROM tok""",
)
def _(spark, sf):
    return fx.tokens(spark, sf).select("id", F.array_join(ngrams("tokens", 2), "|").alias("bigrams"))


@query(
    "percent_of",
    """SELECT source AS keyword, count(*) AS n,
         round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct
    FROM documents GROUP BY source""",
)
def _(spark, sf):
    documents = fx.corpus(spark, sf)
    total = documents.agg(F.count("*").alias("n")).scalar()
    groups = documents.groupBy("keyword").agg(F.count("*").alias("n"))
    return groups.withColumn("pct", percent_of("n", total))


@query("seeded_uniform", f"SELECT id, round({u('7', 'id')}, 6) AS u FROM lab")
def _(spark, sf):
    return fx.labels(spark, sf).select("id", seeded_uniform(7, F.col("id")).alias("u"))
