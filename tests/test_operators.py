"""Operators against brute force, by hand, and on awkward tables."""

import csv
import datetime
import io
import json
import inspect
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rinseworks.functions import constants as K
from rinseworks.functions.expr import strip, title
from rinseworks.operators import (
    audit, boxes, consistency, delimited, duplicates, forest, html, impute, missing, outliers,
    profile, quality, quantiles, repair, sections, similarity, spelling,
)
from rinseworks.plans import auto, engine, strategies
from rinseworks.sources import inventory, readers, splits, writers
from rinseworks.types import Issue


def one(df, column):
    return [r[column] for r in df.collect()]


# --- scalar expressions ------------------------------------------------------


def test_title_and_strip(spark):
    texts = ["o'neil smith-jones", "3rd élan", "\t x ", None, "ABC def"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert one(df.select(title(F.col("t")).alias("r")), "r") == [
        None if t is None else t.title() for t in texts
    ]
    assert one(df.select(strip(F.col("t")).alias("r")), "r") == [
        None if t is None else t.strip() for t in texts
    ]


def test_redaction(spark):
    text = "password=abc 123-45-6789 token: xyz, a.b@c.org 4111 1111 1111 1111"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    first, second = one(audit.redact_sensitive(df, "t"), "t")
    assert "abc" not in first and "6789" not in first and "c.org" not in first
    assert first.count(K.REDACTED) == 5 and second is None
    again = one(audit.redact_sensitive(audit.redact_sensitive(df, "t"), "t"), "t")[0]
    assert again == first


# --- quantiles and profile ---------------------------------------------------


@pytest.mark.parametrize("limit", [50, 10**6])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(1)
    skewed = np.where(rng.random(4000) < 0.4, 7.0, rng.lognormal(size=4000))
    pdf = pd.DataFrame({"a": rng.normal(size=4000), "b": skewed, "c": np.arange(4000.0)})
    pdf.loc[::9, "a"] = np.nan
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), list("abc"), probs, direct_limit=limit)
    for c in "abc":
        assert np.allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)


@pytest.mark.parametrize("accuracy", [20, 2000])
def test_quantiles_narrow_by_sketches(spark, accuracy):
    rng = np.random.default_rng(2)
    n = 10_000
    half = np.where(np.arange(n) < n // 2, 0.0, np.arange(n) + 0.5)  # a rank at the edge of a frequent value
    pdf = pd.DataFrame({
        "half": half, "same": np.full(n, 3.0), "two": np.where(rng.random(n) < 0.3, -1.0, 1e300),
        "wide": 10.0 ** rng.uniform(-300, 300, n), "edge": np.r_[np.zeros(n - 2), 1.0, 2.0],
        "ends": np.r_[np.full(n // 3, -np.inf), np.arange(n - 2 * (n // 3)), np.full(n // 3, np.inf)],
    })
    probs = [0.0, 0.5, 0.50005, 1.0]
    got = quantiles.exact_quantiles(
        spark.createDataFrame(pdf), list(pdf), probs, direct_limit=200, accuracy=accuracy
    )
    for c in pdf:
        want = pdf[c].quantile(probs)
        if c == "ends":  # the reference takes the difference of two infinities
            want[0.0], want[1.0] = -np.inf, np.inf
        assert np.allclose(got[c], want, rtol=1e-9), c


def jobs_of(spark, work):
    """The result of ``work`` and how many jobs it ran."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_long_columns_take_four_scans(spark):
    """300,000 values a column: counts, sketches, cut points, values left; for any number of columns."""
    df = spark.range(300_000).select(*[(F.col("id") * (2 * i + 7) % 299_993).cast("double").alias(f"c{i}") for i in range(8)])
    df = df.repartition(4).cache()
    df.count()
    probs = [0.25, 0.5, 0.75]
    got, jobs = jobs_of(spark, lambda: quantiles.exact_quantiles(df, df.columns, probs))
    pdf = df.toPandas()
    df.unpersist()
    for c in pdf:
        assert np.allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)
    assert jobs <= 8  # two jobs for a scan and its merge under adaptive execution


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "a double, b string, c bigint")
    assert quality.quality_score(empty).first().quality_score == 100.0
    assert profile.dataset_stats(empty).first().total_rows == 0
    assert engine.detect_issues(empty).count() == 0
    hollow = spark.createDataFrame([(None, None, 1), (float("nan"), None, 1)], "a double, b string, c bigint")
    found = {(r.issue_type, r.column) for r in missing.detect_empty_columns(hollow).collect()}
    assert found == {("empty_column", "a"), ("empty_column", "b")}
    assert impute.impute_median(hollow, "a").count() == 2
    assert impute.impute_mode(hollow, "b").count() == 2
    assert impute.impute_context_mode(hollow, "b").count() == 2
    single = spark.createDataFrame([(5.0, "x", 1)], "a double, b string, c bigint")
    assert outliers.zscore_flags(single, "a").count() == 0
    assert outliers.iqr_flags(single, "a").count() == 0
    assert profile.profile_summary(single).first().total_outliers == 0
    odd = spark.createDataFrame([(1, " q"), (2, None)], "`a.b` bigint, `some text` string")
    assert one(repair.strip_whitespace(odd, "some text"), "some text") == ["q", None]
    assert quality.analyze_quality(odd).count() == 2


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "a double")
    assert missing.detect_missing(df).first().affected_rows == 2
    assert one(impute.impute_mean(df, "a").orderBy("a"), "a") == [1.0, 2.0, 2.0, 3.0]


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("x", None), ("y", "z")], "a string, b string")
    assert duplicates.count_duplicate_rows(df) == 1
    assert duplicates.drop_duplicates(df).count() == 3
    assert duplicates.drop_duplicates(df, keep=False).count() == 2


def test_row_digest_is_equality_of_rows(spark):
    rows = [
        (0.0, "ab", "c", [1, None], None), (-0.0, "ab", "c", [1, None], None), (0.0, "a", "bc", [1, None], None),
        (0.0, "ab", "c", [1], None), (float("nan"), None, "", None, b"x"), (float("nan"), None, "", None, b"x"),
        (None, "", None, None, b"x"), (None, None, "", None, b"x"), (None, None, "-", None, b"x"), (1.0, "2:ab", "c", [], b""),
    ]
    df = spark.createDataFrame(rows, "a double, b string, c string, d array<int>, e binary")
    df = df.withColumn("t", F.timestamp_micros(F.lit(1)))
    assert duplicates.count_duplicate_rows(df) == len(rows) - df.distinct().count() == 2
    plan = duplicates.duplicate_row_count(df.cache())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Join" not in plan
    assert duplicates.duplicate_row_count(spark.createDataFrame([], "a int")).first() == (0, 0)
    hour = spark.range(1729987200, 1730001600, 3600).select(F.timestamp_seconds("id").alias("t"))  # clocks set back between
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert duplicates.count_duplicate_rows(hour) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_column_samples_are_the_smallest(spark):
    rows = [(i % 700, f"v{i % 13:02}" if i % 5 else None, float("nan") if i % 2 else i / 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(7)
    got = {}
    for r in profile.column_samples(df, 4).orderBy("column", "rank").collect():
        got.setdefault(r.column, []).append((r["rank"], r.value))
    want = {
        c: sorted({str(r[i]) for r in rows if r[i] is not None and r[i] == r[i]})[:4] for i, c in enumerate("abc")
    }
    assert got == {c: list(enumerate(v, 1)) for c, v in want.items()}
    assert profile.column_samples(df.limit(0)).count() == 0


def test_consistency(spark):
    df = spark.createDataFrame(
        [("2024-01-15", "1,5", "$5", "Foo"), ("01/15/2024", "1.5", "5", "foo")],
        "d string, n string, m string, c string",
    )
    found = {(r.issue_type, r.column): r.affected_rows for r in consistency.detect_inconsistencies(df).collect()}
    assert found == {
        ("inconsistent_date_format", "d"): 2,
        ("inconsistent_decimal_separator", "n"): 2,
        ("currency_in_numeric", "m"): 1,
        ("inconsistent_case", "c"): 2,
    }


def test_email_and_phone(spark):
    df = spark.createDataFrame(
        [("a@b.co", "555-123-4567"), ("a@b", "(555) 123-4567"), ("x", "n/a")], "Email string, phone_no string"
    )
    assert quality.auto_invalid_email(df).first().affected_rows == 2
    assert quality.auto_invalid_phone(df).first().affected_rows == 1


# --- repairs -----------------------------------------------------------------


def test_fixed_bounds_are_idempotent(spark):
    df = spark.createDataFrame([(float(i), None if i % 4 else "  A b ") for i in range(100)], "a double, t string")
    once = repair.clip(df, "a", 10, 90)
    assert once.exceptAll(repair.clip(once, "a", 10, 90)).count() == 0
    text = repair.normalize_text_columns(df)
    assert text.exceptAll(repair.normalize_text_columns(text)).count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, k = 60, 3
    data = rng.normal(size=(n, 3)).round(2)
    data[rng.random((n, 3)) < 0.25] = np.nan
    rows = [(str(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    df = df.withColumn("id", F.lpad("id", 3, "0"))
    want = data.copy()
    for i in range(n):
        for c in range(3):
            if not np.isnan(data[i, c]):
                continue
            near = []
            for j in range(n):
                both = ~np.isnan(data[i]) & ~np.isnan(data[j])
                if not np.isnan(data[j, c]) and both.any():
                    near.append((math.sqrt(((data[i] - data[j])[both] ** 2).sum() * (3 / both.sum())), j))
            want[i, c] = np.mean([data[j, c] for _, j in sorted(near)[:k]]) if near else np.nanmean(data[:, c])
    old = impute.DONOR_BLOCK, impute.RECEIVER_BLOCK
    impute.DONOR_BLOCK, impute.RECEIVER_BLOCK = 7, 5
    try:
        out = impute.impute_knn(df, "id", k).orderBy("id").toPandas()
    finally:
        impute.DONOR_BLOCK, impute.RECEIVER_BLOCK = old
    assert np.allclose(out[["a", "b", "c"]].to_numpy(), want)


def test_knn_looks_at_few_cells(spark):
    """Pairs compared are far fewer than donors times receivers, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    n, k = 6_000, 5
    x = np.column_stack([rng.normal(size=(n, 2)) @ np.diag([5.0, 1.0]), rng.integers(0, 50, n)]).round(3)
    x[rng.random(n) < 0.02, 2] = np.nan
    x[rng.random(n) < 0.1, 0] = np.nan
    x[17] = [np.nan, np.nan, 4.0]
    x[18] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "id bigint, x array<double>").repartition(4)
    got = {}
    for r in impute.nearest_donors(points, 2, 3, k).collect():
        got.setdefault(r.receiver, []).append((r.distance, r.donor))
    receivers, donors = np.flatnonzero(np.isnan(x[:, 2])), np.flatnonzero(~np.isnan(x[:, 2]))
    for i in receivers:
        both = ~np.isnan(x[i]) & ~np.isnan(x[donors])
        shared = both.sum(axis=1)
        at = np.flatnonzero(shared)
        far = np.sqrt(np.where(both, (x[donors] - x[i]) ** 2, 0).sum(axis=1)[at] * (3 / shared[at]))
        want = sorted(zip(far, donors[at]))[:k]
        assert [d for _, d in sorted(got.get(i, []))] == [d for _, d in want], i
    index = impute.DonorIndex.build(points, 2, 3, impute.SAMPLE, impute.LEAF, impute.DONOR_BLOCK)
    asking = points.where("x[2] is null")
    reach = {i: max(d for d, _ in v) if len(v) == k else np.inf for i, v in got.items()}
    reach = spark.createDataFrame([(int(i), float(reach.get(i, np.inf))) for i in receivers], "id bigint, reach double")
    size = dict(zip(index.boxes.number.tolist(), index.boxes.size.tolist()))
    seen = [index.visits(asking, k, True), index.visits(asking.join(reach, "id").select("id", "x", "reach"), k, False)]
    pairs = sum(size[r.cell] for v in seen for r in v.select("cell").collect())
    assert pairs < 0.2 * len(receivers) * len(donors)


def test_iterative_recovers_a_plane(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=300), rng.normal(size=300)
    z = 2 * x - 3 * y + 1
    rows = [
        (float(a), None if i % 11 == 0 else float(b), None if i % 7 == 1 and i % 11 else float(c))
        for i, (a, b, c) in enumerate(zip(x, y, z))
    ]
    out = impute.impute_iterative(spark.createDataFrame(rows, "x double, y double, z double"), 10)
    got = out.toPandas().sort_values("x").to_numpy()
    want = np.column_stack([x, y, z])[np.argsort(x)]
    assert not np.isnan(got).any()
    assert np.abs(got - want).max() < 0.1


def test_adaptive_outliers_bands(spark):
    rows = [(float(i % 20), float(i % 10)) for i in range(100)]
    rows[0] = (1000.0, 5.0)
    for i in range(12):
        rows[10 + i] = (float(i), 500.0 + i)
    out, actions = repair.adaptive_outliers(spark.createDataFrame(rows, "a double, b double"))
    assert ("a", "removed", 1) in actions and ("b", "capped", 12) in actions
    assert out.count() == 99 and out.agg(F.max("b")).first()[0] < 500


def test_isolation_forest_finds_planted(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 2))
    points[:8] += 12
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    found = set(one(forest.isolation_forest_flags(df, ["a", "b"]), "id"))
    assert set(range(8)) <= found and 20 <= len(found) <= 60
    assert forest.isolation_forest_flags(df.limit(5), ["a", "b"]).count() == 0


# --- similarity --------------------------------------------------------------


def vectors(n=120, copies=15):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    out = [centres[i % 12] + 0.35 * rng.normal(size=8) for i in range(n)]
    out += [out[3]] * copies + [np.zeros(8)]
    return [[float(np.float32(x)) for x in v] for v in out]


def test_similar_pairs_match_brute_force(spark):
    data = vectors()
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, e array<float>")
    units = [np.array(v) / (np.linalg.norm(v) or 1) for v in data]
    want = {(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if units[i] @ units[j] > 0.8}
    same = {}
    for i, v in enumerate(data):
        same.setdefault(tuple(v), []).append(i)
    for block, pivots in ((1000, 1), (9, 6), (24, None)):
        got = set()
        total = 0
        groups = {g[0]: g for g in same.values()}
        for r in similarity.similar_pairs(df, "id", "e", 0.8, block, pivots).collect():
            a, b = groups[r.id_a], groups[r.id_b]
            pairs = {(min(i, j), max(i, j)) for i in a for j in b if i != j}
            assert len(pairs) == r.pairs and not pairs & got
            got |= pairs
            total += r.pairs
        assert got == want and total == len(want)


def test_vectors_visit_few_cells(spark):
    """20,000 vectors that spread evenly: without pruning each still meets the others in few copies."""
    units = np.random.default_rng(8).normal(size=(20_000, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"id": range(20_000), "copies": 1, "unit": list(units)})).repartition(4)
    block = inspect.signature(similarity.similar_pairs).parameters["block"].default
    members, visitors = similarity._cells(df, math.acos(0.5), block, None)
    assert members.count() == 20_000 and visitors.count() <= 40_000
    likeness = units @ units.T
    found = similarity._distinct_pairs(df, 0.8, block, None)
    assert found.count() == int((np.triu(likeness, 1) > 0.8).sum()) > 0
    rows = pd.DataFrame({"unit": list(units[:5_000])})
    i, j, _ = similarity._likely(rows, rows, 0.8, math.acos(0.8))
    assert set(zip(i, j)) == set(zip(*np.nonzero(np.triu(likeness[:5_000, :5_000], 1) > 0.8)))


def test_pivot_cells_stay_small(spark):
    """10,000 vectors and at most four pivots a level: no cell is larger than a block."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 10_000)] + 0.5 * rng.normal(size=(10_000, 6))
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"id": range(10_000), "copies": 1, "unit": list(units)})).repartition(5)
    members, visitors = similarity._cells(df, math.acos(0.995), similarity.BLOCK, 4)
    sizes = {r.cell: r["count"] for r in members.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 10_000 and 8 <= len(sizes) <= 16 and max(sizes.values()) <= similarity.BLOCK
    found = similarity._distinct_pairs(df, 0.995, similarity.BLOCK, 4).count()
    assert found == int((np.triu(units @ units.T, 1) > 0.995).sum())
    members, visitors = similarity._cells(df, math.acos(0.995), 256, None)  # as many pivots as the vectors need
    sizes = {r.cell: r["count"] for r in members.groupBy("cell").count().collect()}
    visits = {r.cell: r["count"] for r in visitors.groupBy("cell").count().collect()}
    assert len(sizes) > 100 and max(sizes.values()) <= 2 * 256  # a larger one would be cut into blocks
    pairs = sum(n * (n - 1) / 2 + n * visits.get(c, 0) for c, n in sizes.items())
    assert pairs < 0.3 * 10_000 * 9_999 / 2


def test_leaders_of_a_chain_in_few_rounds(spark):
    chain = spark.range(1_000).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    taken, rounds = similarity._taken(chain)
    assert sorted(one(taken, "id_b")) == list(range(1, 1_001, 2)) and rounds <= 12
    rng = random.Random(6)
    for n, m in ((12, 14), (60, 90), (200, 230), (60, 600)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        leads, want = set(), set()
        for b in range(n):
            (want if any((a, b) in edges for a in leads) else leads).add(b)
        got, _ = similarity._taken(spark.createDataFrame(sorted(edges), "id_a bigint, id_b bigint"))
        assert sorted(one(got, "id_b")) == sorted(want), (n, m)


def test_clusters_match_greedy(spark):
    data = vectors()
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, e array<float>")
    units = [np.array(v) / (np.linalg.norm(v) or 1) for v in data]
    used, want = set(), set()
    for i in range(len(data)):
        if i in used:
            continue
        used.add(i)
        group = [i] + [j for j in range(i + 1, len(data)) if j not in used and units[i] @ units[j] > 0.75]
        used |= set(group)
        want |= {(i, j) for j in group} if len(group) > 1 else set()
    got = similarity.cluster_similar(df, "id", "e", 0.75, 16, 4).collect()
    assert {(r.leader, r.member) for r in got} == want and len(got) == len(want)


# --- text --------------------------------------------------------------------


def test_python_holds_few_pages_and_texts_at_a_time():
    """Batches of 600 rows; all their elements or fixes as Python objects take more."""
    pages = ["<p>" + "</p><p>".join(f"text {i} of {k}" for i in range(50)) + "</p>" for k in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(pages)], ["key", "html"])
    tracemalloc.start()
    assert sum(b.num_rows for b in html._elements(iter([batch]))) == 30_000
    most = tracemalloc.get_traced_memory()[1]
    fixes = pa.array([[(f"w{i}{k}", f"v{i}{k}") for i in range(200)] for k in range(600)], pa.map_(pa.string(), pa.string()))
    texts = pa.array([f"a w1{k} b" for k in range(600)])
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert spelling._replace_words.func(texts, fixes).to_pylist() == [f"a v1{k} b" for k in range(600)]
    more = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert most < 4e6 and more < 4e6
    assert spelling._replace_words.func(pa.array([], pa.string()), pa.array([], fixes.type)).to_pylist() == []


def test_sections(spark):
    lines = ["Log", "====", ""] + [f"2024-01-15 09:23:{i:02d} - A: hello" for i in range(14)]
    many = "\n".join(f"l{i}" for i in range(23))
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, many), (3, "  \n ")], "id int, t string")
    out = sections.section_stats(df, "t").orderBy("id", "section").collect()
    assert [(r.id, r.section, r.word_count) for r in out if r.id == 1] == [(1, 1, 2), (1, 2, 70)]
    assert [r.word_count for r in out if r.id == 2] == [5, 5, 5, 5, 3]
    assert [(r.t, r.section) for r in out if r.id == 3] == [("", None)]
    pages = spark.createDataFrame([(1, "a\fb\f \fc"), (2, "x\n\n\ny"), (3, "w " * 250)], "id int, t string")
    got = sections.split_pages(pages, "t").orderBy("id", "page").collect()
    assert [len(r.t.split()) for r in got] == [1, 1, 1, 1, 1, 100, 100, 50]


def test_long_url_and_empty_text(spark):
    df = spark.createDataFrame([(1, "see https://e.com/" + "x/" * 40000 + " $1,250.00"), (2, "")], "id int, t string")
    first, second = sections.extract_patterns(df, "t").orderBy("id").collect()
    assert first.urls_found == 1 and first.first_currency == "$1,250.00"
    assert second.urls_found is None and second.emails_found is None


def test_spelling(spark):
    words = spark.createDataFrame([("the", 9), ("then", 2), ("word", 5), ("ward", 1)], "term string, freq bigint")
    df = spark.createDataFrame([(1, "Teh wrd, thé then xx thezz"), (2, "the word")], "id int, t string")
    out = spelling.correct_spelling(df, "id", "t", words).orderBy("id")
    assert one(out, "t") == ["the word, thé then xx thezz", "the word"]
    row = spelling.spelling_stats(df, "t", words).first()
    assert (row.total_words, row.spelling_errors) == (7, 3)
    assert spelling.detect_spelling_errors(df, "t").first().severity == "medium"


def test_html(spark):
    page = (
        "<html><title>T</title><script>var a='</p>';</script><h2> Head </h2><p>One<p>Two &amp; b</p>"
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>x</td></tr></table>"
        "<a href='/u'>link</a><a>none</a></html>"
    )
    df = spark.createDataFrame([(1, page), (2, "just  text"), (3, None)], "id int, h string")
    rows = html.html_elements(df, "id", "h").collect()
    first = [(r.type, r.level, r.text, r.url) for r in rows if r.id == 1]
    assert first[0] == ("heading", "h2", "Head", None)
    assert [t for k, _, t, _ in first if k == "paragraph"][1] == "Two & b"
    assert ("link", None, "link", "/u") in first
    table = [r.data for r in rows if r.type == "table_row"]
    assert table == [{"a": "1", "b": "2"}, {"col_0": "x"}]
    assert [(r.type, r.text) for r in rows if r.id == 2] == [("text", "just text")]
    stats = html.html_link_stats(df.withColumn("u", F.lit("http://h.org/x")), "id", "u", "h").orderBy("id").first()
    assert (stats.host, stats.headings, stats.links) == ("h.org", 1, 1)


def test_delimited(spark):
    df = spark.createDataFrame(
        [(1, 'a,b\n"x, y",2\n\n1,2,3\n,\n5\n'), (2, "plain text"), (3, "k;v\n1;2")], "id int, t string"
    )
    found = delimited.sniff_delimited(df, "id", "t")
    assert {(r.id, r.delimiter, r.columns, r.rows) for r in found.collect()} == {(1, ",", 2, 2), (3, ";", 2, 1)}
    rows = delimited.delimited_rows(found, "id").orderBy("id", "row_id").collect()
    assert [r.data for r in rows] == [{"a": "x, y", "b": "2"}, {"a": "5", "b": None}, {"k": "1", "v": "2"}]


def test_word_box_table(spark):
    head = [("Order", 0, 40), ("ID", 50, 20), ("Item", 150, 40), ("Pricee", 300, 50)]
    rows = [(1, 1, 1, 0, float(x), 10.0, float(w), 10.0, 90, t) for t, x, w in head]
    for i in range(1, 3):
        rows += [
            (1, 1, 1, i, 5.0, 10.0 + 20 * i, 40.0, 10.0, 90, f"ORD-{i}"),
            (1, 1, 1, i, 140.0, 10.0 + 20 * i, 30.0, 10.0, 90, "Fish"),
            (1, 1, 1, i, 180.0, 10.0 + 20 * i, 30.0, 10.0, 90, "soup"),
            (1, 1, 1, i, 320.0, 10.0 + 20 * i, 30.0, 10.0, 20 if i == 2 else 90, "9.5"),
        ]
    df = spark.createDataFrame(
        rows, "doc int, block_num int, par_num int, line_num int, left double, top double, width double, "
        "height double, conf int, text string",
    )
    cells = boxes.word_boxes_to_table(df, "doc").orderBy("line_num", "column").collect()
    assert [(r.line_num, r["column"], r.value) for r in cells] == [
        (1, "Item", "Fish soup"), (1, "Order ID", "ORD-1"), (1, "Price", "9.5"),
        (2, "Item", "Fish soup"), (2, "Order ID", "ORD-2"),
    ]
    few = df.where("line_num = 0")
    assert boxes.word_boxes_to_table(few, "doc").count() == 0


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_word_box_tables_shuffle_lines_once_by_page(spark):
    """Pages with gaps in their keys, and one of many lines, against a loop; two shuffles in all, four for order tables."""
    rng = random.Random(11)
    rows = []
    for d, block, lines in ((1, 1, 12), (2, None, 12), (None, 1, 12), (3, 1, 700), (4, 1, 2)):
        for i in range(lines):
            for j, name in enumerate(("Itm", "Price", "Price")):
                text = name if i == 0 else rng.choice([f"w{i}", "x", " "])
                rows.append((d, block, 1, i, 100.0 * j, 20.0 * i, 30.0, None if rng.random() < 0.1 and i else 90, text))
    rows += [(4, 1, 1, 0, 300.0, 1.0, 30.0, 90, "Zz")] + [(2, 5, 1, 9, 0.0, 500.0, 30.0, 90, "late")]
    df = spark.createDataFrame(
        rows, "doc int, block_num int, par_num int, line_num int, left double, top double, width double, conf int, text string"
    ).repartition(3)
    want = Counter()
    for d, block, _, i, left, _, _, conf, text in rows:
        if d in (1, 3) and i and (conf or 0) > 35 and text.strip():  # 4 has too few words, 2 no block, None no page
            want[d, block, 1, i, ("Item", "Price", "Price_1")[int(left // 100)], text] += 1
    assert Counter(tuple(r) for r in boxes.word_boxes_to_table(df, "doc").collect()) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(boxes.word_boxes_to_table(df, "doc")) <= 2
        assert _shuffles(boxes.page_order_tables(df, "doc")) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_word_box_blocks_of_one_line_over_many_tasks(spark):
    """A document of one line of 5,000 words, beside small ones, against a loop."""
    rng = random.Random(5)
    rows = [(1, 0, i, rng.choice(["", "w", " x "]) if rng.random() < 0.3 else f"w{i}", rng.choice([10, 31, 90, 90, None])) for i in range(5_000)]
    rows += [(d, i // 3, i % 3, f"w{i}", 90 if i % 4 else 5) for d in (0, 2, None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc int, line int, word int, text string, conf int").repartition(3)
    want = []
    for d in (0, 1, 2, None):
        block, run = 0, []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: r[1:3]) + [(d, 0, 0, "", 0)]:
            if r[3].strip() and (r[4] or 0) > 30:
                run.append(r)
                continue
            if run:
                want.append((d, block, " ".join(x[3].strip() for x in run), sum(x[4] for x in run) / len(run), len(run)))
            block, run = block + 1, []
    got = [tuple(r) for r in boxes.word_boxes_to_blocks(df, "doc", "line", "word").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[:3] + r[4:] for r in sorted(got, key=key)] == [r[:3] + r[4:] for r in sorted(want, key=key)]
    assert np.allclose([r[3] for r in sorted(got, key=key)], [r[3] for r in sorted(want, key=key)])


def test_order_tables_of_pages_choose_roles_page_by_page(spark):
    """Each page alone through the frame-wide operators gives the rows of all pages in one plan."""
    heads = {
        1: ["Order ID", "Itm", "Price"], 2: ["Ref", "Who", "Sum", "Day"], 3: ["aa", "bb", "cc"], 4: ["Payment", "Quantity", "zz"],
    }
    values = {
        1: [["ORD-1", "Soup", "9.5"], ["ORD-2", "Fish", "fry"], ["", "Cake", "1,200"]],
        2: [["ORD_7", "CUST-1", "12", "15-Jan-2024"], ["ORD8", "CUST2", "300", "2024-02-01T10:30:00Z"], ["x", "CUST-3", "", "5/1/2024"]],
        3: [["credit", "3", "main dish"], ["cash", "4", "dessert"], ["visa card", "", "side"]],
        4: [["wallet", "2", "Tea"], ["cash", "a", ""], ["", "7", "Cup"]],
    }
    rows = []
    for d, head in heads.items():
        for i, line in enumerate([head, *values[d]]):
            for j, cell in enumerate(line):
                rows += [
                    (d, 1, 1, i, 200.0 * j + 30 * k, 20.0 * i, 25.0, 90, w) for k, w in enumerate(cell.split())
                ]
    df = spark.createDataFrame(
        rows, "doc int, block_num int, par_num int, line_num int, left double, top double, width double, conf int, text string"
    ).repartition(3)
    got = {}
    for r in boxes.page_order_tables(df, "doc").collect():
        got.setdefault(r.doc, {})[r.line_num] = tuple(r)[4:]
    cells = boxes._table_cells(df, "doc").toPandas()
    for d in heads:
        page = cells[cells.doc == d]
        names = page.sort_values("position").column.unique()
        wide = spark.createDataFrame(page.pivot(index="line_num", columns="column", values="value")[names].reset_index())
        roles = boxes.infer_column_roles(wide.drop("line_num"))
        want = boxes.normalize_order_table(wide, roles, keep=("line_num",)).collect()
        assert got.get(d, {}) == {r.line_num: tuple(r)[1:] for r in want}, d
    assert got[2][1][0] == "ORD_7" and got[2][2][7] == datetime.datetime(2024, 2, 1, 10, 30) and got[2][1][7].day == 15
    assert got[1][2][3] == "Fish fry" and got[1][2][4] is None


def test_dates_of_many_orders(spark):
    day = datetime.datetime(2024, 1, 15)
    want = {
        "2024-01-15": day, "2024/1/15": day, "2024.01.15": day, "01/15/2024": day, "15/01/2024": day, "15.1.2024": day,
        "2/1/2024": datetime.datetime(2024, 2, 1), "15 Jan 2024": day, "15-Jan-2024": day, "15th January 2024": day,
        "Jan 15, 2024": day, "January 15 2024": day, "Monday, January 15, 2024": day, "Mon 15 Jan 2024": day,
        "2024-01-15T10:30:05Z": datetime.datetime(2024, 1, 15, 10, 30, 5), "2024-01-15T10:30:05.25+02:00": datetime.datetime(2024, 1, 15, 8, 30, 5, 250000),
        "2024-01-15 23:30-0130": datetime.datetime(2024, 1, 16, 1, 0), "1/15/2024 1:05 PM": datetime.datetime(2024, 1, 15, 13, 5),
        "Jan 15, 2024, 12:00 am": day, "2024-01-15 07:08:09": datetime.datetime(2024, 1, 15, 7, 8, 9),
        "2024-02-30": None, "13/13/2024": None, "2024-1/15": None, "31 Foo 2024": None, "15 Jan": None, "12": None, "": None,
        "2024-01-15T25:00": None, "1/15/2024 13:05 pm": None, "ORD-2024-01-15": None, "nan": None,
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "v string")
    got = {r.v: r.d for r in df.select("v", boxes.parsed_date(F.col("v")).alias("d")).collect()}
    assert got == {**want, None: None}


def test_word_box_blocks_across_lines(spark):
    rows = [(1, i, 0, "" if i % 300 == 299 else f"w{i}", 10 if i == 500 else 90) for i in range(700)]
    df = spark.createDataFrame(rows, "doc int, line int, word int, text string, conf int")
    got = boxes.word_boxes_to_blocks(df, "doc", "line", "word").orderBy("block").collect()
    assert [r.word_count for r in got] == [299, 200, 98, 100]
    assert got[1].text.split()[0] == "w300" and got[1].text.split()[-1] == "w499"


def test_spelling_of_several_columns_shuffles_few_words(spark):
    """A misspelling in every row is spread by salt; words without a correction stay where they are."""
    terms = spark.createDataFrame([("there", 5), ("house", 2), ("horse", 9)], "term string, freq bigint")
    rows = [(i, f"Teh thare x{i} Hause " + "good words only " * 3, "thare" if i % 2 else None, "thare") for i in range(2_000)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, `left alone` string").repartition(4)
    out = {r.id: r for r in spelling.correct_spelling(df, "id", ["a", "b"], terms).collect()}
    assert len(out) == 2_000 and out[3].a.startswith("Teh there x3 house good") and out[3].b == "there" and out[4].b is None
    assert all(r["left alone"] == "thare" for r in out.values())
    fixes = spelling.spelling_corrections(df, "a", terms)
    asked = spelling._words_to_fix(df, "id", ["a", "b"], fixes)
    share = asked.groupBy("word", "salt").count().agg(F.max("count"), F.sum("count")).first()
    assert share[1] <= 1.01 * (2 * 2_000 + 1_000) and share[0] < 0.1 * share[1]
    assert spelling.correct_spelling(df, "id", "a", terms).where("a like '%there x5 house%'").count() == 1


def test_text_anomalies_of_all_columns(spark):
    rows = [(i, "good zzzz qqqq", "plain good text", "caf\u00c3\u00a9 good" if i == 1 else "good") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    terms = spark.createDataFrame([(w, 1) for w in ("good", "plain", "text", "caf")], "term string, freq bigint")
    got = {(r.issue_type, r.column): (r.affected_rows, round(r.percentage, 2), r.severity) for r in spelling.detect_text_anomalies(df, None, terms).collect()}
    assert got == {("spelling_errors", "a"): (20, 66.67, "medium"), ("encoding_issues", "c"): (1, 10.0, "low")}
    assert {r.column for r in spelling.detect_text_anomalies(df, ["a", "id", "none"], terms).collect()} == {"a"}
    issue = Issue("spelling_errors", "a", 20, 66.0, "medium", "")
    (strategy,) = strategies.candidates("spelling_errors")
    with pytest.raises(ValueError):
        strategies.apply_strategy(df, issue, strategy)
    assert strategies.apply_strategy(df, issue, strategy, key="id").count() == 10


def test_order_table(spark):
    df = spark.createDataFrame(
        [("ORD-1", "CUST-7", "fry", "Rs 12.5", "2024-01-15", "wallet", "Soup"),
         ("", "CUST-8", "2", "7", "01/02/2024", "visa card", "")],
        "a string, b string, Quantity string, Price string, d string, e string, Item string",
    )
    roles = boxes.infer_column_roles(df)
    assert roles["Order ID"] == "a" and roles["Customer ID"] == "b" and roles["Order Date"] == "d"
    (row,) = boxes.normalize_order_table(df, roles).collect()
    assert row["Item"] == "Soup fry" and row["Quantity"] is None and row["Price"] == 12.5
    assert row["Payment Method"] == "Digital Wallet" and row["Order Date"].year == 2024
    assert list(row.asDict()) == K.ORDER_COLUMNS


# --- plans, files ------------------------------------------------------------


def test_registries(spark):
    def even(df):
        return df.where("a % 2 = 0").agg(F.count("*").alias("affected_rows")).selectExpr(
            "'even_numbers' issue_type", "'a' column", "affected_rows", "0.0D percentage",
            "'low' severity", "'even' description",
        )

    strategies.register_detector("even", even)
    strategies.register_strategy("even_numbers", "drop_even", lambda df, issue, p: df.where(f"a % {p['by']} <> 0"), by=2)
    try:
        df = spark.createDataFrame([(i,) for i in range(10)], "a bigint")
        out, report = engine.engine_clean(df)
        assert [a.strategy.name for a in report.actions] == ["drop_even"] and out.count() == 5
    finally:
        strategies.unregister("even")
        strategies.unregister("drop_even")
    assert "even" not in strategies.registered_detectors()


def test_policy():
    many = Issue("missing_values", "a", 80, 80.0, "high", "")
    few = Issue("missing_values", "a", 10, 10.0, "low", "")
    found = strategies.candidates("missing_values")
    assert strategies.choose(many, found, 100, True).name == "drop_rows"
    assert strategies.choose(few, found, 100, True).name == "median_imputation"
    assert strategies.choose(few, found, 100, False).name == "categorical_context_imputation"
    assert strategies.choose(few, [], 100, False).name == "no_action"
    assert [s.name for s in strategies.candidates("numeric_outliers", "classification")] == [
        "cap_outliers", "transform_outliers", "keep_outliers",
    ]


def test_parent_mode_order(spark):
    rows = [("a", "x"), ("a", "x"), ("b", None), (None, None), ("b", "y"), ("b", "y"), ("b", "z")]
    df = spark.createDataFrame(rows, "p string, t string")
    out, steps = auto.auto_impute(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert ("b", "y") in got and not any(v is None for r in got for v in r)
    assert len(steps) == 2


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,x,2.5\n2,y\n3,z,4,5\nNA,n/a,1e3\n")
    df = readers.read_csv_permissive(spark, str(path))
    assert sorted(map(tuple, df.collect()), key=str) == [(1.0, "x", 2.5), (2.0, "y", None), (None, None, 1000.0)]
    latin = tmp_path / "l.csv"
    latin.write_bytes("a,b\ncafé,1\n".encode("latin-1"))
    assert one(readers.read_csv_permissive(spark, str(latin)), "a") == ["café"]
    typed = readers.read_csv_permissive(spark, str(path), "a bigint, b string, c double")
    assert typed.schema["a"].dataType.simpleString() == "bigint" and typed.count() == 3


def test_json_and_text_readers(spark, tmp_path):
    (tmp_path / "many.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('"text"')
    (tmp_path / "t.txt").write_text("  one \n\ntwo\t\n")
    assert readers.read_json(spark, str(tmp_path / "many.json")).count() == 2
    assert readers.read_json(spark, str(tmp_path / "one.json")).count() == 1
    with pytest.raises(ValueError):
        readers.read_json(spark, str(tmp_path / "bad.json"))
    assert one(readers.read_text_lines(spark, str(tmp_path / "t.txt")), "text") == ["one", "", "two"]
    assert readers.read_documents(spark, str(tmp_path / "t.txt")).count() == 1
    with pytest.raises(ValueError):
        readers.load(spark, "x", "pdf")


def test_readers_take_back_what_writers_write(spark, tmp_path):
    rows = [(1, 'say ""hi", you'), (2, '{"k": 1, "j": 2}'), (3, "a,b"), (4, '"'), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(1)
    for kind in ("csv", "json"):
        writers.write_cleaned(df, str(tmp_path / kind), kind)
        assert sorted(map(tuple, readers.load(spark, str(tmp_path / kind), kind).select("id", "t").collect())) == rows
    broken = spark.createDataFrame([(1, "one\ntwo"), (2, "x")], "id bigint, t string")
    writers.write_cleaned(broken, str(tmp_path / "lines"), "csv")
    back = readers.read_csv_permissive(spark, str(tmp_path / "lines"))
    assert sorted(map(tuple, back.collect())) == [(1, "one\ntwo"), (2, "x")]
    (tmp_path / "bad.json").write_text('[{"a":1},{"a":2')
    for schema in (None, "a bigint"):
        with pytest.raises(ValueError):
            readers.read_json(spark, str(tmp_path / "bad.json"), schema)
    (tmp_path / "wide.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert readers.read_json(spark, str(tmp_path / "wide.json")).count() == 1


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_over_many_splits(spark, tmp_path, small_splits, end):
    """Against Python's reader: quoted line ends, doubled and stray quotes, whatever the splits cut."""
    rng = random.Random(len(end))
    fields = ["x", "two words", 'say ""so""', f"line{end}line", f"{end}", ",", '""', "é" * 9, "long " * 90 + end + "tail", ""]
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for name in ("a", "b"):
        lines = ["id,t,u"]
        for i in range(60):
            quoted = f'"{rng.choice(fields)}"'
            lines.append(f"{i},{quoted}," + rng.choice(['12"" vinyl', 'a "b" c', "plain", f'"{rng.choice(fields)}"']))
            if rng.random() < 0.1:
                lines.append("")
        text = end.join(lines) + end * rng.randint(0, 1)
        (folder / f"{name}.csv").write_bytes(text.encode())
        found = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
        want += [(int(i), t, u) for i, t, u in found]
    got = [tuple(r) for r in readers.read_csv_permissive(spark, str(folder), "id bigint, t string, u string").collect()]
    empty = lambda rows: sorted(tuple("" if v is None else v for v in r) for r in rows)
    assert empty(got) == empty(want)
    pieces = splits.read_pieces(spark, str(folder), "\n")
    starts = splits.split_starts(splits.split_effects(pieces, splits.quote_step(","), '"'))
    assert starts.count() > 8 and starts.where("inside").count() > 0 and pieces.rdd.getNumPartitions() > 8


def test_stray_quotes_in_unquoted_fields(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text('name,n\n12" vinyl,3\n7" single,4\n')
    assert sorted(map(tuple, readers.read_csv_permissive(spark, str(path)).collect())) == [('12" vinyl', 3), ('7" single', 4)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_over_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(4)
    odd = ['}{"', "[]", '\\"', "\\", "line\nline", "é}", "]", ", {", "x" * 700, ""]
    objects = [{"id": i, "t": rng.choice(odd), "in": {"k": rng.choice(odd), "v": [1, {"w": rng.choice(odd)}]}} for i in range(80)]
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(objects[:50], indent=indent, ensure_ascii=False))
    (folder / "b.json").write_text("\ufeff" + json.dumps(objects[50:79], indent=indent) + "\n")
    (folder / "c.json").write_text(json.dumps(objects[79], indent=indent))
    (folder / "d.json").write_text("[]\n")
    spans = splits.read_pieces(spark, str(folder), "}").rdd.getNumPartitions()
    assert spans > 8  # an array file is read by many tasks
    for schema in (None, "id bigint, t string, `in` struct<k:string,v:array<string>>"):
        got = {r.id: r for r in readers.read_json(spark, str(folder), schema).collect()}
        assert sorted(got) == list(range(80))
        assert all(got[o["id"]].t == o["t"] and got[o["id"]]["in"].k == o["in"]["k"] for o in objects)
    for broken in ('[{"a":1} {"b":', '{"a":1', '[{"a":1}]]', '[{"a":1}, 7, {"a":2}]', '{"a":{"b":1}', '[{"a":"x}]', ' 7 '):
        (tmp_path / "broken.json").write_text(broken)
        with pytest.raises(ValueError):
            readers.read_json(spark, str(tmp_path / "broken.json")).collect()


def test_writers_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, " a"), (2, None)], "id bigint, t string")
    for kind in ("csv", "json", "parquet"):
        writers.write_cleaned(df, str(tmp_path / kind), kind)
        back = readers.load(spark, str(tmp_path / kind), kind) if kind != "json" else spark.read.json(str(tmp_path / kind))
        assert sorted(one(back, "t"), key=str) == [" a", None]
    writers.write_profile(df, str(tmp_path / "profile"))
    assert spark.read.json(str(tmp_path / "profile" / "columns")).count() == 2
    _, report = engine.engine_clean(df)
    writers.write_report(spark, report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "actions")).count() == len(report.actions)
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.CSV").write_text("x")
    (files / "b.csv").write_text("x")
    (files / "c.exe").write_text("y")
    found = inventory.file_inventory(spark, str(files))
    assert {r["name"]: (r.kind, r.accepted) for r in found.collect()} == {
        "a.CSV": ("csv", True), "b.csv": ("csv", True), "c.exe": (None, False),
    }
    assert {r.kind: r.files for r in inventory.inventory_by_kind(found).collect()} == {"csv": 2, None: 1}
    assert max(one(inventory.file_fingerprints(spark, str(files)), "copies")) == 2


def test_skewed_groups_stay_whole(spark):
    """A third of the rows share one value: nothing is lost and modes are right."""
    rows = [(i, "hot" if i % 3 == 0 else f"v{i}", float(i % 3 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, v string, x double")
    (row,) = duplicates.detect_column_duplicates(df.select("v")).collect()
    assert row.affected_rows == 999
    assert one(impute.impute_mode(df.union(df.limit(1).selectExpr("id", "null", "x")), "v").where("v is null"), "v") == []


def test_gaps_count_as_numbers_in_role_shares(spark):
    df = spark.createDataFrame([(None,), (None,), ("12",), ("x y",)], "thing string")
    share = {r["role"]: r["share"] for r in boxes.role_shares(df).collect()}
    assert (share["Price"], share["Order Total"], share["Quantity"], share["Item"]) == (0.75, 0.75, 0.25, 0.25)


def test_doubled_quotes_of_a_delimited_text_are_one(spark):
    df = spark.createDataFrame([(1, 'a,b\n"x ""q"" y","1,2"\n"",3')], "id int, t string")
    got = delimited.sniff_delimited(df, "id", "t").first()["records"]
    assert [[None if v in (None, "") else v for v in r] for r in got] == [['x "q" y', "1,2"], [None, "3"]]


def test_neighbour_imputation_without_row_id_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x double, y double")
    wanted = strategies.Strategy("knn_imputation", "", {"n_neighbors": 1})
    with pytest.raises(ValueError):
        strategies.apply_strategy(df, Issue("missing_values", "y", 1, 50.0, "", ""), wanted)
