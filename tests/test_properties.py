"""Operators against brute force, and under other partitionings."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from textlens.operators import joins, lexical, metrics, profile, ranking, rebalance


def _scored(spark, n, seed, levels=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        score = min(1.0, max(0.0, rng.gauss(0.3 + 0.3 * y, 0.2)))
        if levels:
            score = round(score * levels) / levels
        rows.append((i, y, score))
    return rows, spark.createDataFrame(rows, "id bigint, y int, score double")


def _curve(rows):
    """(threshold, precision, recall, tp) at every distinct score, highest first."""
    positives = sum(y for _, y, _ in rows)
    for t in sorted({s for _, _, s in rows}, reverse=True):
        accepted = [y for _, y, s in rows if s >= t]
        yield t, sum(accepted) / len(accepted), sum(accepted) / positives, sum(accepted)


@pytest.mark.parametrize("levels", [None, 7])
@pytest.mark.parametrize("partitions", [1, 16])
def test_curve_and_average_precision(spark, levels, partitions):
    rows, df = _scored(spark, 400, 3, levels)
    df = df.repartition(partitions)
    expected = {t: (p, r) for t, p, r, _ in _curve(rows)}
    curve = metrics.pr_curve(df).collect()
    got = {r.threshold: (r.precision, r.recall) for r in curve if r.threshold is not None}
    assert got.keys() == expected.keys()
    for t, point in got.items():
        assert point == pytest.approx(expected[t])
    assert [(r.precision, r.recall) for r in curve if r.threshold is None] == [(1.0, 0.0)]

    total, before = 0.0, 0.0
    for _, precision, recall, _ in _curve(rows):
        total += precision * (recall - before)
        before = recall
    assert metrics.average_precision(df).first()[0] == pytest.approx(total)
    best = max((r for _, p, r, _ in _curve(rows) if p >= 0.5), default=0.0)
    assert metrics.precision_floor(df, 0.5).first()[0] == pytest.approx(best)


def _f1(rows, t):
    tp = sum(y == 1 and s >= t for _, y, s in rows)
    fp = sum(y == 0 and s >= t for _, y, s in rows)
    fn = sum(y == 1 and s < t for _, y, s in rows)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@pytest.mark.parametrize("levels", [None, 100, 20])
def test_sweep(spark, levels):
    rows, df = _scored(spark, 500, 5, levels)
    grid = [i / 100 for i in range(5, 96)]
    best = max(grid, key=lambda t: (_f1(rows, t), -t))
    got = metrics.threshold_sweep(df).first()
    assert (got.threshold, got.f1) == pytest.approx((best, _f1(rows, best)))
    table = {round(r.threshold, 2): r.f1 for r in metrics.threshold_grid(df).collect()}
    assert table == pytest.approx({t: _f1(rows, t) for t in grid})
    points = metrics.operating_points(df, [0.35, 0.5]).collect()
    assert [r.f1 for r in points] == pytest.approx([_f1(rows, t) for t in (0.35, 0.5)])


@pytest.mark.parametrize("buckets", [1, 3, 50])
@pytest.mark.parametrize("descending", [True, False])
def test_prefix_sums(spark, buckets, descending):
    rng = random.Random(1)
    rows = [(c, k, rng.randint(0, 9)) for c in (0, 1) for k in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "y int, k bigint, v bigint").repartition(5)
    got = {
        (r.y, r.k): (r.cum_v, r.total_v)
        for r in ranking.prefix_sums(df, "k", ["v"], ["y"], descending, buckets).collect()
    }
    for c in (0, 1):
        ordered = sorted((r for r in rows if r[0] == c), key=lambda r: r[1], reverse=descending)
        running = 0
        for _, k, v in ordered:
            running += v
            assert got[c, k][0] == running
        assert {got[c, r[1]][1] for r in ordered} == {running}


def test_median_and_ordinals(spark):
    rng = random.Random(2)
    rows = [(i % 2, float(rng.choice([0.0, 1.5, rng.random() * 10]))) for i in range(301)]
    df = spark.createDataFrame(rows, "y int, v double")
    got = {r.y: r.median_v for r in ranking.exact_median(df, "v", ["y"]).collect()}
    assert got == pytest.approx(
        {y: statistics.median(v for c, v in rows if c == y) for y in (0, 1)}
    )
    ids = spark.createDataFrame([(i * 7, i % 3 == 0) for i in range(100)], "id bigint, y boolean")
    ordinals = {r.id: r.ordinal for r in ranking.dense_ordinals(ids, "id", ["y"]).collect()}
    for flag in (True, False):
        mine = sorted(i * 7 for i in range(100) if (i % 3 == 0) == flag)
        assert [ordinals[i] for i in mine] == list(range(len(mine)))


def test_top_k_beyond_the_pushed_limit(spark):
    rows = [(i % 2, i, i % 50) for i in range(4000)]
    df = spark.createDataFrame(rows, "y int, term bigint, n int")
    order = [F.col("n").desc(), F.col("term").asc()]
    for k in (10, 1500):
        got = ranking.top_k(df, k, ["y"], order).collect()
        for y in (0, 1):
            mine = sorted((-n, t) for c, t, n in rows if c == y)[:k]
            ranked = sorted((r.rank, r.term) for r in got if r.y == y)
            assert ranked == [(i, t) for i, (_, t) in enumerate(mine, start=1)]


def test_group_counts_add_up(spark):
    rows, df = _scored(spark, 300, 7)
    df = df.withColumns(
        {"pred": (F.col("score") >= 0.5).cast("int"), "keyword": (F.col("id") % 9).cast("string")}
    )
    total = metrics.confusion_matrix(df).first()
    groups = metrics.errors_by_group(df).agg(*[F.sum(c) for c in ("tn", "fp", "fn", "tp")]).first()
    assert tuple(groups) == tuple(total)
    assert sum(total) == len(rows)
    flags = metrics.score_histogram(df).agg(F.sum("n")).first()[0]
    assert flags == len(rows)


def test_left_join_keeps_every_label_row(spark):
    labels = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "id bigint, label string"
    )
    corpus = spark.createDataFrame(
        [(1, "x", "old"), (2, "y", "old"), (2, "z", "old"), (9, "w", "old")],
        "id bigint, text string, label string",
    )
    got = sorted(map(str, joins.attach_text(labels, corpus).select("id", "label", "text").collect()))
    plain = labels.join(corpus.drop("label"), "id", "left").select("id", "label", "text").collect()
    assert got == sorted(map(str, plain))
    missing = joins.missing_text(labels, corpus).collect()
    assert sorted(r.label for r in missing) == ["d", "e"]


def test_augmentation(spark):
    rows = [(i, int(i < 20), f"w{i} " * 8 + "end") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, y int, text string")
    same = rebalance.augment_word_deletion(df, 2, drop_prob=-1.0)
    assert {r.text for r in same.collect()} == {" ".join(t.split()) for _, y, t in rows if y}
    assert same.count() == 40
    whole = rebalance.augment_word_deletion(df, 1, drop_prob=1.0)
    assert {r.text for r in whole.collect()} == {t for _, y, t in rows if y}
    assert rebalance.augment_word_deletion(df, 0).count() == 0
    one = rebalance.augment_word_deletion(df.repartition(1), 3).orderBy("id", "copy").collect()
    many = rebalance.augment_word_deletion(df.repartition(16), 3).orderBy("id", "copy").collect()
    assert one == many
    assert rebalance.append_augmented(df, rebalance.augment_word_deletion(df, 3)).count() == 110


def test_draws(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(200)], "id bigint, y int")
    drawn = rebalance.draw_balanced(df, n=3000, seed=1)
    rows = drawn.collect()
    assert sum(r.n_draws for r in rows) == 3000
    share = sum(r.n_draws for r in rows if r.y == 1) / 3000
    assert abs(share - 0.33) < 0.03
    assert {r.id for r in rows if r.y == 1} == set(range(5))
    expanded = rebalance.expand_draws(drawn, chunk=7).groupBy("id").agg(F.count("*").alias("n"))
    assert {r.id: r.n for r in expanded.collect()} == {r.id: r.n_draws for r in rows}
    again = rebalance.draw_balanced(df.repartition(11), n=3000, seed=1)
    assert sorted(again.collect()) == sorted(rows)
    weights = rebalance.class_weights(df).groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert {r.y: r.w for r in weights} == pytest.approx({1: 0.33, 0: 0.67})


def test_shuffle_and_sample(spark):
    df = spark.range(100).toDF("id")
    order = [r.id for r in rebalance.shuffle_rows(df).collect()]
    assert sorted(order) == list(range(100)) and order != list(range(100))
    assert order == [r.id for r in rebalance.shuffle_rows(df.repartition(9)).collect()]
    sample = {r.id for r in rebalance.sample_rows(df, 7).collect()}
    assert len(sample) == 7
    assert sample == {r.id for r in rebalance.sample_rows(df.repartition(3), 7).collect()}


def test_term_counts_under_other_partitionings(spark):
    rng = random.Random(4)
    words = ["the", "poor", "need", "help", "of"]
    rows = [(i, i % 2, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(90)]
    schema = "id bigint, y int, tokens array<string>"
    for n in (1, 2, 3):
        expected: dict[tuple[str, int], int] = {}
        for _, y, tokens in rows:
            for i in range(len(tokens) - n + 1):
                gram = " ".join(tokens[i : i + n])
                expected[gram, y] = expected.get((gram, y), 0) + 1
        for partitions in (1, 16):
            df = spark.createDataFrame(rows, schema).repartition(partitions)
            got = {}
            for r in lexical.class_term_counts(df, n).collect():
                got.update({(r.term, y): c for y, c in ((1, r.n_pos), (0, r.n_neg)) if c})
            assert got == expected
    df = spark.createDataFrame(rows, schema)
    assert profile.vocabulary_size(df).first()[0] == 5
    assert abs(profile.vocabulary_size(df, approximate=True).first()[0] - 5) <= 1


def test_stop_word_density(spark):
    docs = [(1, ["a", "b"]), (1, ["b", "b", "b"]), (0, []), (0, ["a"]), (0, ["a", "c", "d", "e"])]
    df = spark.createDataFrame(docs, "y int, tokens array<string>")
    rows = {r.y: r for r in lexical.stop_word_density(df, ["a"]).collect()}
    shares = {1: [50.0, 0.0], 0: [100.0, 25.0]}
    for y, values in shares.items():
        assert rows[y].n_docs == len(values)
        assert rows[y].mean_density == pytest.approx(statistics.mean(values))
        assert rows[y].median_density == pytest.approx(statistics.median(values))
        assert rows[y].std_density == pytest.approx(statistics.pstdev(values))
        assert rows[y].difference_pos_neg == pytest.approx(25.0 - 62.5)


def test_length_histogram_matches_numpy(spark):
    import numpy as np

    rng = random.Random(8)
    lengths = [int(rng.lognormvariate(3.6, 0.6)) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens int")
    rows = profile.length_histogram(df, bins=50).orderBy("bin").collect()
    counts, edges = np.histogram(lengths, bins=50)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_low for r in rows] == pytest.approx(edges[:-1].tolist())
    stats = profile.token_length_stats(df).first()
    assert stats.std_tokens == pytest.approx(statistics.stdev(lengths))
    assert stats.median_tokens == statistics.median(lengths)
    rough = profile.token_length_stats(df, approximate=True).first()
    assert rough.median_tokens in (statistics.median_low(lengths), statistics.median_high(lengths))
