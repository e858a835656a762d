"""Personal data by weak supervision, with DataFrame functions only.

Fixed patterns give the base spans. Looser patterns give further candidates. Labelers (the
pattern's own form, a check of the digits, a gazetteer, the words before, the characters
around, the variety of digits) vote on every candidate; expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is, without any labelled span;
a logistic regression learns the resulting probabilities and decides on the spans that are
not base ones. Counts cover all documents; the driver sees one row for each vote pattern,
of which there can be at most 4 * 3 ** 6.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import store
from textlens.llm.span_arrays import chunks, clear_of, let, match_starts, piece, running

KINDS = ("email", "ip", "card", "phone")
# Possessive runs and the guards before a run find the same matches as the plain patterns,
# in time that grows with the text and not with the square of a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./_])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: Parts of texts without which a loose pattern cannot match; cheap to look for.
_HINTS = {"email": r"(?i)[(\[{]at[)\]}]", "ip": ":[0-9a-fA-F]{1,4}:", "card": "[0-9][./_][0-9]", "phone": "[0-9][.-][0-9]{4}"}
#: Words that announce each kind.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|from",
    "card": "card|visa|master|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|handy|whatsapp|sms",
}
#: Endings, leading digits and country codes that are in use, as patterns of a whole value.
GAZETTEER = {
    "email": r"(?i).*(?:\.|dot[)\]}] ?)(?:com|org|net|edu|gov|io|de|fr|es|it|nl|uk|eu|info|biz|example)",
    "ip": r"(?!0|127|255).*",
    "card": r"(?:4|5[1-5]|2[2-7]|34|37|6|35|36).*",
    "phone": r"(?:\+(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[2-9]).*",
}
LABELERS = ("form", "check", "gazetteer", "context", "around", "variety")
_SPAN = "struct<kind:int,start:int,end:int,m:string,base:boolean>"


def _positions(found: Column) -> Column:
    """Spans of the matches `m` of one pattern, in code points."""
    spans = F.zip_with(
        match_starts(found["gaps"], found["m"]),
        found["m"],
        lambda at, m: F.struct(
            found["kind"].alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), m.alias("m"), found["base"].alias("base")
        ),
    )
    return F.when(F.size(found["m"]) > 0, spans).otherwise(F.array()).cast(f"array<{_SPAN}>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn's check of a string of digits."""
    n = F.length(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(value, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    """The check that a match of a base pattern must pass."""
    if KINDS[kind] == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if KINDS[kind] == "card":
        d = digits(value)
        return F.when(F.length(value) > 2 * 19, F.lit(False)).when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if KINDS[kind] == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _by_kind(span: Column, of) -> Column:
    out = None
    for k in range(len(KINDS)):
        out = F.when(span["kind"] == k, of(k)) if out is None else out.when(span["kind"] == k, of(k))
    return out


def _votes(cut: Column, span: Column) -> Column:
    """A struct with a vote of each labeler: 1 for personal data, 2 against, 0 for no opinion.
    `cut` is the text in chunks."""
    yes_no = lambda c: F.when(c, 1).otherwise(2)
    letters = r"[\p{L}\p{N}]"
    around = F.struct(
        F.lower(piece(cut, F.greatest(span["start"] - 30, F.lit(0)), span["start"])).alias("before"),
        piece(cut, span["end"], span["end"] + 1).alias("right"),
        digits(span["m"]).alias("d"),
    )

    def votes(x: Column) -> Column:
        m, d = span["m"], x["d"]
        known = _by_kind(span, lambda k: m.rlike(rf"\A(?:{GAZETTEER[KINDS[k]]})\z"))
        announced = _by_kind(span, lambda k: x["before"].rlike(rf"(?<![\p{{L}}])(?:{CONTEXT[KINDS[k]]})"))
        touched = F.substring(x["before"], -1, 1).rlike(letters) | x["right"].rlike(letters)
        loose = F.when(span["kind"] == KINDS.index("card"), yes_no(F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))).otherwise(0)
        found = [
            F.when(span["base"], 1).otherwise(0),
            F.when(span["base"], yes_no(_by_kind(span, lambda k: valid(k, m)))).otherwise(loose),
            yes_no(known),
            F.when(announced, 1).otherwise(0),
            F.when(touched, 2).otherwise(1),
            F.when(F.length(d) < 7, 0).otherwise(yes_no(F.size(F.array_distinct(F.split(d, ""))) > 3)),
        ]
        where = [span[n].alias(n) for n in ("kind", "start", "end")]
        return F.struct(*where, *[v.cast("int").alias(n) for n, v in zip(LABELERS, found)])

    return let(around, votes)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `pii_base`, the base spans, and `pii_more`, other candidates, with their votes.

    Names that begin with `pii_` are its own: other columns so named are dropped. A null or
    empty text has no candidates; repeated rows are searched each for itself.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("pii_") and c != text_col])
    df = docs.withColumn("pii_text", F.coalesce(F.col(text_col), F.lit("")))
    matches, found = {}, []
    for k, kind in enumerate(KINDS):
        for base, pattern in ((True, BASE[kind]), (False, LOOSE[kind])):
            name = f"pii_{'base' if base else 'loose'}_{kind}"
            values = F.regexp_extract_all("pii_text", F.lit(pattern), F.lit(0))
            if kind == "email" and base:
                values = F.when(F.contains("pii_text", F.lit("@")), values).otherwise(F.array().cast("array<string>"))
            if not base:
                values = F.when(F.col("pii_text").rlike(_HINTS[kind]), values).otherwise(F.array().cast("array<string>"))
            matches[name] = values
            gaps = F.when(F.size(name) > 0, F.split("pii_text", pattern, -1))
            found.append(F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), F.col(name).alias("m"), gaps.alias("gaps")))
    # What follows is written once for the spans of all kinds: planning takes the driver's memory for every expression.
    df = df.withColumns(matches).withColumn("pii_spans", F.flatten(F.transform(F.array(*found), _positions)))

    def passes(s: Column) -> Column:
        return _by_kind(s, lambda k: valid(k, s["m"]))

    # What failed its check is a candidate still, if long enough; so are the loose matches.
    df = df.withColumns({
        "pii_passed": F.filter("pii_spans", lambda s: s["base"] & passes(s)),
        "pii_others": F.filter("pii_spans", lambda s: ~s["base"] | (~passes(s) & F.length(s["m"]).between(13, 40))),
    })

    def voted(cut: Column) -> Column:
        return F.transform(F.array("pii_passed", "pii_others"), lambda spans: F.transform(spans, lambda s: _votes(cut, s)))

    cut = F.when(F.size("pii_passed") + F.size("pii_others") > 0, chunks(F.col("pii_text")))
    df = df.withColumn("pii_voted", let(cut, voted))
    df = df.withColumns({"pii_base": F.col("pii_voted")[0], "pii_more": F.col("pii_voted")[1]})
    return df.drop("pii_text", *matches, "pii_spans", "pii_passed", "pii_others", "pii_voted")


def estimate_reliabilities(patterns: Sequence[dict], rounds: int = 50) -> dict:
    """Expectation-maximisation over `{kind, form, ..., n}` rows of vote patterns.

    Labelers are independent given the truth; each has a chance of every vote for true and
    for false candidates, each kind a share of true ones. Starts from the majority of votes.
    """
    total = sum(r["n"] for r in patterns)
    belief = [1 / (1 + math.exp(sum((r[n] == 2) - (r[n] == 1) for n in LABELERS))) for r in patterns]
    share, chance = {}, {}
    for _ in range(rounds if total else 0):
        for k in range(len(KINDS)):
            of_kind = [(b, r["n"]) for b, r in zip(belief, patterns) if r["kind"] == k]
            share[k] = (sum(b * n for b, n in of_kind) + 1) / (sum(n for _, n in of_kind) + 2)
        for name in LABELERS:
            for truth in (0, 1):
                weight = [(b if truth else 1 - b) * r["n"] for b, r in zip(belief, patterns)]
                for vote in (0, 1, 2):
                    hit = sum(w for w, r in zip(weight, patterns) if r[name] == vote)
                    chance[name, truth, vote] = (hit + 0.1) / (sum(weight) + 0.3)
        for i, r in enumerate(patterns):
            odds = math.log(share[r["kind"]] / (1 - share[r["kind"]]))
            odds += sum(math.log(chance[n, 1, r[n]] / chance[n, 0, r[n]]) for n in LABELERS)
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return {"share": share, "chance": chance}


def _features(span) -> list[tuple[str, Column]]:
    votes = [(f"{n}_{v}", (span(n) == v).cast("double")) for n in LABELERS for v in (1, 2)]
    return votes + [(f"kind_{k}", (span("kind") == k).cast("double")) for k in range(1, len(KINDS))]


def train_span_classifier(candidates: DataFrame) -> list[float]:
    """Coefficients of `_features` and the intercept, from the candidates of all documents."""
    spans = candidates.select(F.explode(F.concat("pii_base", "pii_more")).alias("s")).select("s.kind", *[f"s.{n}" for n in LABELERS])
    patterns = store(spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    rows = [r.asDict() for r in patterns.collect()]
    if not rows:
        return [0.0] * len(_features(F.col)) + [-1.0]
    model = estimate_reliabilities(rows)
    share, chance = model["share"], model["chance"]
    odds = F.lit(0.0)
    for k in share:
        odds = F.when(F.col("kind") == k, math.log(share[k] / (1 - share[k]))).otherwise(odds)
    for n in LABELERS:
        for v in (0, 1, 2):
            odds = odds + F.when(F.col(n) == v, math.log(chance[n, 1, v] / chance[n, 0, v])).otherwise(0.0)
    belief = 1 / (1 + F.exp(-odds))
    weighted = patterns.withColumn("belief", belief).select(
        "*", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("belief").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("belief")).alias("w")))).alias("t")
    )
    columns = _features(F.col)
    data = weighted.select(F.col("t.y").alias("y"), (F.col("t.w") * F.col("n")).alias("w"), *[c.alias(n) for n, c in columns]).where("w > 0")
    data = VectorAssembler(inputCols=[n for n, _ in columns], outputCol="features").transform(data)
    fitted = LogisticRegression(labelCol="y", weightCol="w", regParam=1e-4, maxIter=50).fit(data)
    return [float(c) for c in fitted.coefficients] + [float(fitted.intercept)]


def with_spans(candidates: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds `base_spans` and `spans`, sorted arrays of (kind, start, end); drops the candidates.

    A candidate is added when the classifier's odds are even or better and it overlaps no
    base span.
    """

    def odds(s: Column) -> Column:
        total = F.lit(weights[-1])
        for (_, value), w in zip(_features(lambda n: s[n]), weights):
            total = total + value * F.lit(w)
        return total

    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.transform("pii_base", plain))
    more = clear_of(F.filter("pii_more", lambda s: odds(s) >= 0), F.col("pii_base"))
    return candidates.withColumns({"base_spans": base, "spans": F.array_sort(F.concat(base, more))}).drop("pii_base", "pii_more")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, base_spans, spans` of every row: arrays of (kind, start, end) in code points.

    `kind` is a place in `KINDS`, `end` is exclusive. A null or empty text has no spans. Null
    ids and repeated rows are kept; equal spans of two kinds are both listed; other columns
    are not read; an empty table gives an empty result. Time grows with the length of a text and
    the number of its spans (a little more than that beyond some 100,000 in one text). Whole texts are searched once; what
    was found is stored in the shared folder and decided on from there.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = store(with_candidates(rows).drop("text"), "pii-candidates")
    return with_spans(found, train_span_classifier(found))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans
    become the mark of the first. A null text stays null."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def marked(sorted_spans: Column) -> Column:
        reached = running(F.transform(sorted_spans, lambda s: s["end"]), F.greatest, 0)
        both = F.zip_with(sorted_spans, reached, lambda s, r: F.struct(s.alias("s"), r.alias("r")))
        fresh = F.filter(both, lambda x: x["s"]["start"] >= x["r"])
        rest = F.array_max(F.transform(sorted_spans, lambda s: s["end"]))

        def joined(cut: Column) -> Column:
            parts = F.transform(fresh, lambda x: F.concat(piece(cut, x["r"], x["s"]["start"]), marks[x["s"]["kind"]]))
            return F.array_join(F.concat(parts, F.array(piece(cut, rest, F.length(text)))), "")

        return let(chunks(text), joined)

    return F.when(F.size(spans) > 0, let(by_start, marked)).otherwise(text)
