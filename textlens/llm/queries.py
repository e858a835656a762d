"""The registered queries of the numbered operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.archives import archive_round_trip
from textlens.llm.common import store
from textlens.llm.histogram_packing import pack_best_fit
from textlens.llm.jaccard_join import jaccard_components
from textlens.llm.middle_filling import fill_in_middle, original
from textlens.llm.mixing import mix_sources, with_size
from textlens.llm.packing import pack_documents
from textlens.llm.periodic_runs import longest_run, periodic_runs, runs_text, with_repeats
from textlens.llm.pii_spans import KINDS, find_personal_data, spans_text
from textlens.llm.quality_mil import quality_scores
from textlens.llm.topk_search import top_k_products
from textlens.llm.toxicity_ssk import toxicity_scores
from textlens.llm.vector_neardup import near_duplicate_vectors
from textlens.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


@query("op1_url_rules")
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_size(table(spark, sf_dir, "documents"))
    sized = store(sized.select("doc_id", "mix_size", "mix_source", "mix_key"), "mix-sizes")
    return mix_sources(sized).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("mix_size") * F.size("draws")).alias("taken"),
    )


@query("op3_quality_mil")
def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_jaccard_join",
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a
    """,
)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_toxicity_ssk")
def op6_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op7_vector_neardup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (
      SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
      coalesce(least(e.vec_id, coalesce(c.m, e.vec_id)) = e.vec_id, false) AS kept
    FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
    """,
)
def op7_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op8_archives",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
      FROM pages),
    m AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT p.page_id, p.payload_bytes, p.payload_digest,
      CASE WHEN m.keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN m.keep <> p.page_id THEN m.keep END AS refers_to
    FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
    """,
)
def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op9_pii_spans")
def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


@query(
    "op10_topk_search",
    """
    WITH v AS (
      SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
    r AS (
      SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_best_fit")
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query(
    "op12_fill_in_middle",
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
      FROM documents),
    r AS (
      SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
        ('0x' || h[17:24])::BIGINT % 100 AS chance, ('0x' || h[25:32])::BIGINT % 100 AS part FROM d),
    f AS (
      SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR chance >= 50
        THEN 'plain' WHEN part < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(list_slice(u, 1, least(c1, c2)), '') AS p,
        array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS m,
        array_to_string(list_slice(u, greatest(c1, c2) + 1, len(u)), '') AS s FROM r)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM f
    """,
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, form = F.col("output"), F.col("form")
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(original(output, form), 256).alias("restored_sha256"),
    )


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    best = longest_run(F.col("runs"))
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
