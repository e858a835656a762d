"""URL filters: a fixed list of hosts and paths, and association rules mined from labels.

Urls become sets of tokens. FP-growth mines token combinations that occur with a label;
combinations are pruned by support and confidence and against simpler ones, and matched
through an inverted index that holds each rule under its rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import ascii_lower, store

#: Items that carry the label of a url; no token of a url contains a blank.
_LABEL = "label is "


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, in ASCII lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does.

    A rule `example.net/en/` fits the host, its subdomains, and paths that start with `/en/`.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def url_tokens(url: Column) -> Column:
    """A sorted set of tokens that together cover the whole url.

    Each url has one token per part (scheme, top-level name, domain, subdomain, first
    folder, folders between, last name, extension, query keys, fragment, depth), numbers
    written as `#`, so a set is small and mining has a bounded number of combinations.
    """
    host, path = url_host(url), url_path(url)
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), "[0-9]+", "#")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.array_sort(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))
    middle = F.concat_ws("/", F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))

    def token(kind: str, value: Column) -> Column:
        clean = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "%20")
        return F.when(clean != "", F.concat(F.lit(f"{kind}:"), clean))

    slots = F.array(
        token("scheme", ascii_lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1))),
        token("top", F.try_element_at(names, F.lit(-1))),
        token("domain", F.when(F.size(names) > 1, F.array_join(F.slice(names, -2, 2), "."))),
        token("sub", F.when(F.size(names) > 2, F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 2, F.lit(0))), "."))),
        token("folder", F.when(F.size(parts) > 1, parts[0])),
        token("between", F.when(F.size(parts) > 2, F.regexp_replace(middle, "[0-9]+", "#"))),
        token("last", last),
        token("extension", F.regexp_extract(last, r"\.([^.]+)\z", 1)),
        token("keys", F.when(query != "", F.array_join(keys, "&"))),
        token("fragment", F.regexp_replace(F.regexp_extract(url, r"(?s)#(.*)", 1), "[0-9]+", "#")),
        token("depth", F.when(F.size(parts) > 0, F.size(parts).cast("string"))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(slots)))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9
) -> DataFrame:
    """`antecedent, verdict, confidence, support, anchor` from rows of `tokens, label`.

    A rule stays when its support and confidence are high enough and no rule with one token
    less is as sure of the same label. `anchor` is its rarest token, ties by name. All
    labelled rows are counted. No labelled row gives no rule.
    """
    items = labelled.select(
        F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("label"))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = store(
        model.associationRules.where(F.col("consequent")[0].startswith(_LABEL))
        .where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .select(
            F.array_sort("antecedent").alias("antecedent"),
            F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1 << 30).alias("verdict"),
            "confidence",
            "support",
        ),
        "url-rules",
    )
    simpler = rules.select(
        F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("as_sure")
    )
    idle = (
        rules.withColumn("without", F.explode("antecedent"))
        .withColumn("shorter", F.array_remove("antecedent", F.col("without")))
        .join(simpler, ["shorter", "verdict"])
        .where("as_sure >= confidence")
        .select("antecedent", "verdict")
        .distinct()
    )
    counts = model.freqItemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), "freq"
    )
    kept = rules.join(idle, ["antecedent", "verdict"], "left_anti")
    return store(
        kept.withColumn("token", F.explode("antecedent"))
        .join(counts, "token")
        .groupBy("antecedent", "verdict", "confidence", "support")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("anchor")),
        "url-rules",
    )


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """`tokens, found` for each distinct token set that some rule fits.

    The surest rule wins, then the one with more support, more tokens, then the later
    verdict by name.
    """
    order = F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict")
    return (
        token_sets.select("tokens", F.explode("tokens").alias("anchor"))
        .join(rules, "anchor")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max(order).alias("found"))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = 0.005,
    min_confidence: float = 0.9,
    otherwise: str = "allow",
) -> DataFrame:
    """Every row with `page_id, host, path, rule, verdict, confidence`.

    `rules` is the fixed list of (host/path, verdict); its verdicts are the labels from
    which combinations are mined, and they stand. Other urls get the verdict of the mined
    rule that fits best, or `otherwise` where none does; `confidence` is null unless a mined
    rule decided.

    A null url or one without `://` has an empty host and path. Null ids, repeated rows and
    ties are kept as they are; other columns are not read; an empty table gives an empty
    result.

    Token sets are made distinct before they are matched, so a url pattern that a third of
    the rows share is matched once; joining the verdicts back splits such a pattern.
    """
    url = F.col(url_col)
    host, path = url_host(url), url_path(url)
    rule, verdict = list_rule(F.col("host"), F.col("path"), rules)
    rows = store(
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(url).alias("tokens"))
        .withColumns({"rule": rule, "label": verdict}),
        "url-tokens",
    )
    labelled, open_rows = rows.where("label IS NOT NULL"), rows.where("label IS NULL")
    decided = labelled.select(
        "page_id", "host", "path", "rule", F.col("label").alias("verdict"),
        F.lit(None).cast(T.DoubleType()).alias("confidence"),
    )
    if labelled.isEmpty():
        return decided.union(
            open_rows.select("page_id", "host", "path", "rule", F.lit(otherwise), F.lit(None))
        )
    learned = match_rules(
        open_rows.select("tokens").distinct(), mine_rules(labelled, min_support, min_confidence)
    )
    judged = open_rows.join(learned, "tokens", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"),
        F.col("found.confidence").alias("confidence"),
    )
    return decided.union(judged)
