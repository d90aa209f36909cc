"""Golden values, edge cases and invariants of the operators that SQL does not cover."""

import hashlib
import itertools
import json
import math
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from adjudica.functions import distributions as ds
from adjudica.functions import text as tx
from adjudica.functions.binomial import upper_bound
from adjudica.operators import answers, calibrate, compare, dedup, metrics, monitor, ranks, report, selective
from adjudica.operators.components import connected_components
from adjudica.operators.skew import hub_join
from adjudica.plans import catalog, pipelines, tables  # noqa: F401 (pipelines adds its queries to the catalog)
from adjudica.sources import files
from adjudica.streaming import shadow

SF = "/root/testdata/sf0.001"


def test_binomial_bound_golden():
    assert upper_bound(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59)) and upper_bound(0, 59) <= 0.05
    assert upper_bound(0, 1) == pytest.approx(0.95)
    assert upper_bound(0, 0) == upper_bound(5, 5) == 1
    assert upper_bound(1, 120) == pytest.approx(0.0389, abs=1e-3)
    assert 0 < upper_bound(1500, 3000) < 1  # no overflow


def test_softmax_ties_margin_and_ensemble(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.4, 0.4, 0.2], [-1.0, 0.5, 2.0], [-2.0, 1.0, 4.0])], "ids array<string>, p array<double>, z array<double>, v array<double>")
    r = df.select(
        ds.argmax_first(F.col("ids"), F.col("p")), ds.argmax_greatest_id(F.col("ids"), F.col("p")), ds.margin(F.col("p")),
        ds.softmax(F.col("z")), ds.softmax(F.col("z"), 1.0, F.array(F.lit(3.0), F.lit(0.0), F.lit(0.0))), ds.rotate(F.col("ids"), 4),
        ds.without_prior(F.col("z"), F.array(F.lit(1.0), F.lit(None), F.lit(1.0)), 0.5), ds.expected(ds.softmax(F.col("z")), F.col("v")),
    ).first()
    assert (r[0], r[1], r[2]) == ("a", "b", 0)
    e = [math.exp(x) for x in (-1, 0.5, 2)]
    assert r[3] == pytest.approx([x / sum(e) for x in e])
    assert sum(r[4]) == pytest.approx(1) and r[4][0] > r[3][0]
    assert r[5] == ["b", "c", "a"] and r[6] == [-1.5, 0.5, 1.5]
    assert r[7] == pytest.approx(sum(x / sum(e) * v for x, v in zip(e, (-2, 1, 4))))


def test_acceptance_order(spark):
    rows = [("margin", 0.5, "threshold", None, [0.8, 0.2], 0.0, "accept"), ("margin", 0.5, "threshold", None, [0.6, 0.4], 0.0, "review"),
            ("max_probability", 0.5, "threshold", 0.15, [0.9, 0.1], 0.25, "review"), ("max_probability", 0.5, "review_only", None, [0.9, 0.1], None, "review"),
            ("max_probability", 0.5, "threshold", None, [], None, "review")]
    df = spark.createDataFrame([((m, t, k, x), p, d, w) for m, t, k, x, p, d, w in rows], "policy struct<metric:string,threshold:double,type:string,max_order_discrepancy:double>, p array<double>, d double, want string")
    for r in df.withColumn("got", ds.acceptance(F.col("p"), F.col("policy"), F.col("d"))).collect():
        assert r.got == r.want


def test_canonical_state_and_duplicate_key(spark):
    rows = ['{"b": 1, "a": "é"}', "é", "{broken", None, "", "Straße ﬁn"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string")
    got = {r.i: (r.c, r.k) for r in df.select("i", tx.canonical_state("s").alias("c"), tx.duplicate_key(F.col("s")).alias("k")).collect()}
    assert got[0][0] == '{"a":"é","b":1}' and got[1][0] == "é" and got[2][0] == "{broken"
    assert got[3] == (None, None) and got[4] == ("", "") and got[5][1] == "strasse fin"


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "pairs", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    name = "n{:04d}".format
    links = {
        "chain": [(name(i), name(i + 1)) for i in range(150)],
        "star": [(name(0 if i % 2 else 999), name(i)) for i in range(1, 300)],
        "random": [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(200)],
        "pairs": [("b", "a"), ("a", "b"), ("c", "c"), (None, "x"), ("y", None)],
        "none": [],
    }[shape]
    df = spark.createDataFrame(links, "a string, b string").withColumn("component", F.lit(1))
    got = {(r.node, r.component) for r in connected_components(df).collect()}
    assert got == brute_components([x for x in links if None not in x])


def test_hub_join_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)], "u string, x int")
    facts = rows.groupBy("u").agg(F.max("x").alias("m"), F.count(F.lit(1)).alias("n"))
    got = hub_join(rows, facts, "u", 350, hub_share=10, least=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hub_join(rows, facts, "u", 350).collect()))
    assert got.count() == 350


@pytest.mark.parametrize("descending", [False, True])
def test_ranked_is_the_same_on_either_path(spark, descending):
    rng = random.Random(5)
    rows = [(None if g == "n" else g, i, rng.randrange(5)) for g, k in (("a", 400), ("b", 3), ("n", 60)) for i in range(k)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x int, k int")
    one = ranks.ranked(df, ["g"], ["x"], ("k",), descending)
    two = ranks.ranked(df, ["g"], ["x"], ("k",), descending, most=0)
    assert one.columns == two.columns
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, one.collect()), key=key) == sorted(map(tuple, two.collect()), key=key)


def decisions(spark, rows):
    """rows of (confidence, hit)."""
    out = [(f"e{i}", "q", "w", "boolean", "true" if h else "false", "true", ({"true": c, "false": 1 - c},)) for i, (c, h) in enumerate(rows)]
    return spark.createDataFrame(out, "example_id string, question_id string, workload_id string, primitive string, reference string, prediction string, answer struct<probabilities:map<string,double>>")


def test_selective_golden(spark):
    s = metrics.scored(decisions(spark, [(0.95, 1), (0.92, 1), (0.88, 1), (0.70, 0)]))
    r = selective.at_threshold(s, 0.85).first()
    assert (r.accepted, r.coverage, r.errors) == (3, 0.75, 0)
    assert metrics.proper_scores(s).first().n == 4


def test_equal_count_bins(spark):
    s = metrics.scored(decisions(spark, [(0.5 + i / 50, 1) for i in range(23)]))
    assert [r.n for r in metrics.reliability_bins(s).orderBy("bin").collect()] == [3] * 7 + [2]


def test_perfect_and_prevalence_brier(spark):
    s = metrics.scored(decisions(spark, [(1.0, 1), (1.0, 1)]))
    assert metrics.proper_scores(s).first().brier == pytest.approx(0)
    s = metrics.scored(decisions(spark, [(0.6, 1), (0.6, 0)]))
    assert metrics.proper_scores(s).first().prevalence_brier == pytest.approx(0.5)


def test_drift_golden(spark):
    def run(n, accepted, errors):
        rows = [(f"e{i}", "q", "w", "boolean", "false" if i < errors else "true", "true", ("accept" if i < accepted else "review",)) for i in range(n)]
        d = spark.createDataFrame(rows, "example_id string, question_id string, workload_id string, primitive string, reference string, prediction string, answer struct<disposition:string>")
        t = spark.createDataFrame([("w", "boolean", accepted / n, 0.045)], "workload_id string, primitive string, target_coverage double, target_bound double")
        return selective.drift(d, t).first()

    r = run(120, 120, 0)
    assert r.error_alert is None and r.coverage_alert is None and not r.recalibrate
    assert run(120, 120, 1).error_alert == "ERROR_BOUND_WARNING" and not run(120, 120, 1).recalibrate
    assert run(100, 100, 8).error_alert == "ERROR_BOUND_BREACH" and run(100, 100, 8).recalibrate
    assert run(100, 30, 0).coverage_alert == "COVERAGE_BELOW_MINIMUM"


def test_temperature_is_a_minimum(spark):
    s = metrics.scored(tables.decisions(spark, SF))
    fit = calibrate.fit_temperature(s)
    t = fit.toPandas()
    assert len(t) and t.temperature.between(0.1, 10).all()
    for shift in (-0.02, 0.02):
        near = spark.createDataFrame(t.assign(temperature=(t.temperature + shift).clip(0.06))[["workload_id", "primitive", "temperature"]])
        both = t.merge(calibrate.mean_nll(s, near, ["workload_id", "primitive"]).toPandas(), on=["workload_id", "primitive"], suffixes=("", "_near"))
        inside = both[(both.temperature > 0.11) & (both.temperature < 9.9)]
        assert len(inside) and (inside.nll <= inside.nll_near + 1e-6).all()
    v = calibrate.fit_vector(s).toPandas()
    assert (v.bias.map(sum).abs() < 1e-4).all() and v.temperature.between(0.05, 10).all()
    # no parameters near the fitted ones are better
    keys = ["workload_id", "primitive", "options"]
    sized = s.withColumn("options", F.size("z"))
    best = calibrate.mean_nll(sized, spark.createDataFrame(v[[*keys, "temperature", "bias"]]), keys).toPandas()
    rng = random.Random(3)
    for _ in range(1):
        moved = v.assign(temperature=v.temperature * rng.uniform(0.97, 1.03), bias=v.bias.map(lambda b: [x + rng.uniform(-0.02, 0.02) for x in b]))
        both = best.merge(calibrate.mean_nll(sized, spark.createDataFrame(moved[[*keys, "temperature", "bias"]]), keys).toPandas(), on=keys, suffixes=("", "_moved"))
        both = both[(both.temperature > 0.051) & (both.temperature < 9.9)]
        assert (both.nll <= both.nll_moved + 1e-7).all()


def test_temperature_golden(spark):
    rows = [(["a", "b"], [5.0, -5.0], 1 if i % 2 else 2) for i in range(20)]
    df = spark.createDataFrame([("w", "boolean", z, t) for _, z, t in rows], "workload_id string, primitive string, z array<double>, target int")
    assert calibrate.fit_temperature(df).first().temperature > 1.5
    df = spark.createDataFrame([("w", "boolean", [0.5, -0.5], 1)] * 20, "workload_id string, primitive string, z array<double>, target int")
    assert calibrate.fit_temperature(df).first().temperature < 1


def test_vector_scaling_where_the_temperature_fails(spark):
    # weak: the logits point the wrong way from a skewed label, which no temperature mends; even: a temperature does
    rows = [("weak", ["a", "b"], [1.0, 0.0] if i % 2 else [2.0, 0.0], "a" if i < 8 else "b") for i in range(40)]
    rows += [("even", ["a", "b"], [2.0, 0.0], "b" if i < 8 else "a") for i in range(20)] + [("even", ["a", "b"], [0.0, 2.0], "a" if i < 8 else "b") for i in range(20)]
    df = spark.createDataFrame([(f"e{i}", "q", w, "choice", ids, z, r) for i, (w, ids, z, r) in enumerate(rows)],
                               "example_id string, question_id string, workload_id string, primitive string, ids array<string>, z array<double>, reference string")
    s = df.withColumn("target", F.array_position("ids", F.col("reference")).cast("int"))
    after, fits = calibrate.calibrated(s)
    fit = {r.workload_id: r for r in fits.collect()}
    assert fit["even"].method == "temperature_scaling" and fit["even"].vectors is None and fit["even"].temperature > 0
    weak = fit["weak"]
    assert weak.method == "vector_scaling" and weak.temperature is None and len(weak.vectors) == 1 and weak.vectors[0].ids == ["a", "b"]
    assert weak.vectors[0].bias[1] > weak.vectors[0].bias[0]
    assert after.count() == len(rows) and after.select("example_id").distinct().count() == len(rows)
    scores = {r.workload_id: r for r in metrics.proper_scores(after).collect()}
    assert scores["weak"].brier < 0.35  # one temperature cannot prefer b: 0.5 or more
    assert after.where("workload_id = 'weak'").agg(F.avg("hit")).first()[0] == 0.8


def test_calibration_pipeline_tells_the_method(spark):
    rows = catalog.queries()["f03_calibration_pipeline"](spark, "/root/testdata/sf0.01").collect()
    assert {"vector_scaling", "temperature_scaling"} == {r.method for r in rows}
    assert all((r.vectors is None) == (r.method == "temperature_scaling") for r in rows)


def test_near_duplicates(spark):
    w = [f"word{i}" for i in range(100)]
    rows = [(1, w), (2, [*w, "extra"]), (3, w[::-1]), (4, w), (5, None), (6, ["a"])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    assert [(r.a, r.b) for r in dedup.similar_pairs(df, "id", F.col("w")).collect()] == [(1, 2)]


def brute_keys(rows):
    return {i: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", x).casefold())) for i, x in rows if x is not None}


def brute_near(rows, least=0.9, k=5):
    """(links of every id, pairs of classes) by comparing all with all."""
    keys = brute_keys(rows)
    grams = {i: {tuple(x.split()[j : j + k]) for j in range(len(x.split()) - k + 1)} for i, x in keys.items()}
    links, pairs, first = {i: 0 for i, _ in rows}, set(), {}
    for i in sorted(keys):
        first.setdefault(keys[i], i)
    for i, j in itertools.combinations(sorted(x for x in keys if keys[x]), 2):
        same, a, b = keys[i] == keys[j], grams[i], grams[j]
        if same or (a and b and len(a & b) >= least * len(a | b)):
            links[i], links[j] = links[i] + 1, links[j] + 1
            pairs |= set() if same else {tuple(sorted((first[keys[i]], first[keys[j]])))}
    return {i: (first[keys[i]] if keys.get(i) else None, n) for i, n in links.items()}, pairs


def test_every_near_duplicate_has_a_row(spark):
    w = " ".join(f"w\u00f6rd{i}" for i in range(60))
    rows = [(1, w), (2, w + " extra"), (3, w.upper().replace(" ", ", ")), (4, unicodedata.normalize("NFD", w)), (5, None), (6, "..."), (7, "a\u200db"), (8, "a b"),
            (9, w + " extra!"), (10, " ".join(reversed(w.split()))), (11, "\uff57" + w[1:]), (12, "q\u0301 r"), (13, "q r"), (14, "")]
    members, pairs = dedup.near_duplicates(spark.createDataFrame(rows, "id int, t string"), "id", tx.duplicate_key("t"))
    want, want_pairs = brute_near(rows)
    assert {r.id: (r.class_id, r.links) for r in members.collect()} == want and members.count() == len(rows)
    assert want[4] == (1, 5) and want[8] == (7, 1) and want[13] == (12, 1)
    assert {(r.a, r.b) for r in pairs.collect()} == want_pairs == {(1, 2)}


def test_exact_dups_by_key_against_brute_force(spark, tmp_path):
    rows = [(1, "Caf\u00e9, au lait"), (2, "cafe\u0301 au  lait!"), (3, "\uff23AF\u00c9 au lait"), (4, "cafe au lait"), (5, None), (6, "..."), (7, "")]
    made = tmp_path / "made"
    made.mkdir()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{made}/documents.parquet")
    for sf in (str(made), SF):
        keys = brute_keys([(r.doc_id, r.text) for r in tables.table(spark, sf, "documents").select("doc_id", "text").collect()])
        same = {}
        for i, x in keys.items():
            same.setdefault(x, []).append(i)
        want = {(hashlib.sha256(x.encode()).hexdigest(), min(v), len(v)) for x, v in same.items() if x and len(v) > 1}
        assert {(r.digest, r.first_id, r.copies) for r in catalog.queries()["c01_exact_dup_keys"](spark, sf).collect()} == want
        assert sf == SF or {x[1:] for x in want} == {(1, 3)}


def test_near_dup_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in tables.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want, want_pairs = brute_near(rows)
    queries = catalog.queries()
    assert {r.doc_id: (r.class_id, r.links) for r in queries["c03_near_dup_documents"](spark, SF).collect()} == want
    assert {(r.a, r.b) for r in queries["c03_near_dup_class_pairs"](spark, SF).collect()} == want_pairs


def test_suite_build_joins_and_quarantines_by_text(spark):
    w = " ".join(f"word{i}" for i in range(60))
    rows = [("a", "s1", "x1", w, "train", "train"), ("b", "s2", None, w.upper() + " Extra", "dev", "development"), ("c", "s3", "unclustered", "other text", None, None),
            ("d", "s4", "x4", json.dumps({"Essay": "other, TEXT", "assignment": "z"}), None, None), ("e", "s5", "x5", None, None, None), ("f", "s6", "x6", "...", None, None),
            ("g", "s7", "x7", '{"question": "other", "candidate_sentence": "text"}', None, None), ("h", "s8", "x1", "not alike", None, None),
            ("i", "s9", "x9", '{"b": {"c": 1}, "A": "v"}', None, None), ("j", "s10", "x10", '{"a":"V","B":{"C":1}}', None, None)]
    df = spark.createDataFrame([(i, s, c, x, (u,), e, False, "w") for i, s, c, x, u, e in rows],
        "example_id string, source_group_id string, near_duplicate_cluster_id string, state string, public_source struct<upstream_split:string>, evaluation_split string, task_template_holdout boolean, workload_id string")
    got = {r.example_id: r.cluster_id for r in dedup.text_clusters(df).collect()}
    groups = {frozenset(i for i in got if got[i] == c) for c in got.values()}
    assert groups == {frozenset(x) for x in ("ab", "cdg", "e", "f", "h", "ij")}
    assert got["c"] == "dup-" + hashlib.sha256(b"c").hexdigest()[:24]
    clustered = df.drop("near_duplicate_cluster_id").join(dedup.text_clusters(df).withColumnRenamed("cluster_id", "near_duplicate_cluster_id"), "example_id")
    stored = {r.example_id: r.quarantined for r in dedup.boundary_conflicts(df, dedup.source_components(df)).collect()}
    assert stored["a"] and stored["h"] and not stored["b"]  # the stored id joins a and h, and misses b
    assert pipelines.suite_build(clustered).agg(F.sum("examples")).first()[0] == 8  # a and b, of one text, are quarantined; h is not


def test_text_clusters_against_brute_force(spark):
    suite = tables.table(spark, SF, "suite").select("example_id", "state").distinct().collect()
    links, pairs = brute_near([(r.example_id, tx._decision_text(r.state) if r.state is not None else None) for r in suite])
    want = dict(brute_components([(c or i, i) for i, (c, _) in links.items()] + list(pairs)))
    got = {r.example_id: r.cluster_id for r in catalog.queries()["c04_text_clusters"](spark, SF).collect()}
    assert got == {i: "dup-" + hashlib.sha256(want[i].encode()).hexdigest()[:24] for i in links}


def test_quarantine_and_split_conflicts(spark):
    rows = [("a", "s1", "c1", "train", "train", False), ("b", "s1", "c2", "dev", "development", False), ("c", "s2", "c2", "dev", "development", False),
            ("d", "s3", "c3", "train", "train", False), ("e", None, None, None, None, True), ("f", "s4", "unclustered", None, None, None)]
    df = spark.createDataFrame([(i, s, c, (u,), e, h) for i, s, c, u, e, h in rows], "example_id string, source_group_id string, near_duplicate_cluster_id string, public_source struct<upstream_split:string>, evaluation_split string, task_template_holdout boolean")
    comp = dedup.source_components(df)
    q = {r.example_id: r.quarantined for r in dedup.boundary_conflicts(df, comp).collect()}
    assert q == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": False}
    got = {r.example_id: (r.split, r.conflict) for r in dedup.assign_splits(df, comp, "seed").collect()}
    assert got["a"] == (None, True) and got["d"] == ("train", False) and got["e"] == ("task_holdout", False)
    assert got["f"][0] in {"train", "development", "calibration", "locked_test"}


def test_equivalence_never_exempts_ties(spark):
    rows = [("e1", "q", "w", ["a", "b"], [1.0, 0.9], [0.9, 1.0]), ("e2", "q", "w", ["a", "b"], [3.0, 0.0], [3.0, 0.0])]
    cols = "example_id string, question_id string, workload_id string, ids array<string>, z array<double>"
    a = spark.createDataFrame([(e, q, w, i, x) for e, q, w, i, x, _ in rows], cols)
    b = spark.createDataFrame([(e, q, w, i, y) for e, q, w, i, _, y in rows], cols)
    out = compare.equivalence_summary(compare.equivalence_rows(compare.paired(a, b)), "workload_id_a").where("workload_id_a is null").first()
    assert out.compared == 2 and out.agreements == 1 and not out.gate_passed and out.tie_band == 1


def test_control_arm_and_sample_do_not_depend_on_partitioning(spark):
    d = tables.decisions(spark, SF, "workload_id", "reference", "prediction")
    one = set(map(tuple, monitor.control_arm(d).collect()))
    assert one == set(map(tuple, monitor.control_arm(d.repartition(7)).collect()))
    s = d.withColumn("_n", F.lit(3))
    assert set(monitor.hash_sample(s, "_n", ["workload_id"], ["example_id", "question_id"], "x").collect()) == set(
        monitor.hash_sample(s.repartition(5), "_n", ["workload_id"], ["example_id", "question_id"], "x").collect()
    )


def test_report(spark, tmp_path):
    doc = {"gate_a_passed": True, "nested": [{"gate_b_passed": False, "x": 1.5}], "gate_ratio": 3}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text(json.dumps(doc))
    rows = report.leaves(spark, files.read_documents(spark, str(tmp_path)))
    assert {r.leaf for r in rows.collect()} == {"gate_a_passed", "gate_ratio", "nested[0].gate_b_passed", "nested[0].x"}
    g = report.gates(rows).first()
    assert (g.gates, g.passed) == (2, 1)
    assert report.markdown(rows) == report.markdown(rows) and "| 1.5 |" in report.markdown(rows)


def test_sources(spark, tmp_path):
    good = {"example_id": "a", "question_id": "q", "reference": "x", "prediction": "x"}
    p = tmp_path / "p.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in (good, good | {"example_id": "b", "odd": 1})))
    rows = files.read_jsonl(spark, str(p), "prediction", ["example_id", "question_id"])
    assert rows.count() == 2
    assert [tuple(r) for r in files.unknown_fields(spark, str(p), "prediction").collect()] == [("odd", 1)]
    p.write_text("\n".join(json.dumps(good) for _ in range(2)))
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(p), "prediction", ["example_id", "question_id"])
    for i, body in enumerate(([good], {"rows": [good]}, {"decisions": [good]})):
        f = tmp_path / f"l{i}.json"
        f.write_text(json.dumps(body))
        assert files.read_predictions(spark, str(f)).first().prediction == "x"
    c = tmp_path / "t.csv"
    c.write_text('﻿text,category\n"a, ""b""",x\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_table(spark, str(c), ["text", "category"]).collect()] == [('a, "b"', "x")]
    z = tmp_path / "t.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/t.tsv", "Question\tLabel\nwhy?\t1\n")
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' + "".join(f"<w:p><w:r><w:t>Score of {i}: level {i}</w:t></w:r></w:p>" for i in range(1, 7)) + "</w:document>")
    assert [tuple(r) for r in files.read_zipped_table(spark, str(z), "d/t.tsv", ["Question", "Label"]).collect()] == [("why?", "1")]
    assert files.read_rubric_docx(str(z))[5] == "level 6"
    sums = files.checksums(spark, str(c))
    bad = spark.createDataFrame([("t.csv", "0"), ("none", "0")], "name string, sha256 string")
    assert {tuple(r) for r in files.manifest_problems(bad, sums).collect()} == {("t.csv", "mismatch"), ("none", "missing")}
    assert files.write_report({"a": 1, "created_at": "x"}, str(tmp_path / "r.json")) == files.write_report({"a": 1, "created_at": "y"}, str(tmp_path / "r.json"))
    out = str(tmp_path / "out")
    one = spark.createDataFrame([("a", "q", 1)], "example_id string, question_id string, x int")
    files.append_predictions(one, out)
    files.append_predictions(one, out, spark.read.json(out))
    assert spark.read.json(out).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/shadow_log.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = shadow.windowed_coverage(shadow.read_events(spark, str(tmp_path / "log"), log.schema, 1), "1 day", "400 days")
    q = stream.writeStream.format("memory").queryName("cov").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.window.start.date()), r.profile_id): (r.decisions, r.accepted) for r in spark.table("cov").collect()}
    rows = monitor.shadow_decisions(log).groupBy(F.to_date("at").alias("d"), "profile_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision.disposition") == "accept").alias("k"))
    assert got == {(str(r.d), r.profile_id): (r.n, r.k) for r in rows.collect()}


def test_incremental_is_idempotent(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/shadow_log.parquet")
    log.write.parquet(str(tmp_path / "log"))
    seen = []
    for k in range(2):
        s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
        shadow.incremental(s, str(tmp_path / "t"), ["request_id"], str(tmp_path / f"c{k}"), lambda df: seen.append(df.count())).awaitTermination()
    assert set(seen) == {log.select("request_id").distinct().count()}
    assert unicodedata.normalize("NFC", "é") == "é"


def arms(spark):
    cols = "example_id string, question_id string, workload_id string, ids array<string>, z array<double>"
    a = [(e, "q", "w", ["a", "b"], [2.0, 0.0]) for e in ("e1", "e2", "e3")]
    b = [("e1", "q", "w", ["a", "b"], [2.0, 0.0]), ("e2", "q", "w", ["a", "c"], [2.0, 0.0]), ("e4", "q", "w", ["a", "b"], [2.0, 0.0])]
    return spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)


def test_equivalence_counts_what_it_cannot_compare(spark):
    pairs = compare.paired(*arms(spark))
    out = compare.equivalence_summary(compare.equivalence_rows(pairs), "workload_id_a").where("workload_id_a is null").first()
    assert (out.compared, out.agreements, out.only_a, out.only_b, out.labels_differ, out.gate_passed) == (1, 1, 1, 1, 1, False)
    with pytest.raises(Exception, match="arms cannot be compared"):
        compare.equivalence_rows(pairs, strict=True).collect()
    with pytest.raises(Exception, match="arms cannot be compared"):
        compare.cyclic_ensemble(*arms(spark), strict=True).collect()
    assert {r.example_id: r.status for r in compare.cyclic_ensemble(*arms(spark)).collect()} == {"e1": "compared", "e2": "labels_differ", "e3": "only_a", "e4": "only_b"}
    none = compare.equivalence_summary(compare.equivalence_rows(pairs.limit(0)), "workload_id_a")
    assert not any(r.gate_passed for r in none.collect())


def test_speed_gate(spark):
    rows = lambda x: spark.createDataFrame(x, "g string, median double, p95 double")
    a, b = rows([("zero", 0.0, 1.0), ("slow", 10.0, 2001.0), ("good", 10.0, 2000.0), ("alone", 1.0, 1.0)]), rows([("zero", 5.0, 9.0), ("slow", 30.0, 9.0), ("good", 20.0, 9.0)])
    got = {r.g: (r.speedup, r.gate_passed) for r in compare.speed_gate(a, b, ["g"]).collect()}
    assert got == {"zero": (float("inf"), True), "slow": (3.0, False), "good": (2.0, True), "alone": (None, False)}


def test_bound_of_many_errors():
    assert upper_bound(10**7, 2 * 10**8) == pytest.approx(0.05 + 1.645 * (0.05 * 0.95 / (2 * 10**8)) ** 0.5, rel=1e-6)
    assert upper_bound(1, 10**9) == pytest.approx(4.7438645e-9, rel=1e-6)


def test_review_audit(spark):
    d = [(f"e{i:03d}", "q", "yes", "no" if i < 10 else "yes") for i in range(60)]
    arms_ = monitor.control_arm(spark.createDataFrame(d, "example_id string, question_id string, reference string, prediction string"))
    control = sorted(r.example_id for r in arms_.where("arm = 'control'").collect())
    assert len(control) == 10
    for disputes, passed in ((1, True), (2, False)):
        said = [("e001", "q", True), ("e002", "q", False), ("e003", "q", None)] + [(c, "q", True) for c in control[:disputes]]
        bad, summary = monitor.review_audit(arms_, spark.createDataFrame(said, "example_id string, question_id string, disputed boolean"))
        s = summary.first()
        assert (s.control, s.control_disputes, s.dispute_rate, s.control_passed, s.disagreements, s.quarantined) == (10, disputes, disputes / 10, passed, 10, int(passed))
        assert [r.example_id for r in bad.collect()] == (["e001"] if passed else [])


FULL = {
    "gate_ece_passed": True, "gate_brier_passed": True, "gate_selective_passed": True, "samples_sufficient_for_gate": True, "ece": 0.02, "brier_score": 0.1, "prevalence_brier_score": 0.2,
    "coverage": 0.6, "accepted_error_95_upper_bound": 0.04, "errors_in_accepted": 1, "accepted_count": 120, "sample_count": 200,
}
METRICS = ", ".join(f"{k}: {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in FULL.items())


def test_evidence_needs_every_conjunct(spark):
    bad = [{k: None} for k in FULL] + [{k: False} for k, v in FULL.items() if v is True] + [
        {"ece": 0.051}, {"ece": -0.1}, {"brier_score": 0.21}, {"prevalence_brier_score": float("inf"), "brier_score": float("inf")}, {"coverage": 0.49}, {"coverage": 1.1},
        {"accepted_error_95_upper_bound": 0.051}, {"errors_in_accepted": 121}, {"errors_in_accepted": 5}, {"accepted_count": 58}, {"sample_count": 241}, {"sample_count": 119},
    ]
    rows = [FULL] + [FULL | x for x in bad]
    df = spark.createDataFrame([(i, tuple(r.values())) for i, r in enumerate(rows)] + [(99, None)], f"i int, metrics struct<{METRICS}>")
    got = {r.i for r in df.where(answers.has_evidence(df.schema["metrics"].dataType)).collect()}
    assert got == {0}
    few = df.select("i", F.struct("metrics.ece", "metrics.errors_in_accepted", "metrics.accepted_count").alias("metrics"))
    assert few.where(answers.has_evidence(few.schema["metrics"].dataType)).count() == 0


def test_answers_by_profile(spark):
    key = dict.fromkeys(answers.RUNTIME, "x")
    policy = ("threshold", 0.8, "confidence", 0.1)
    kinds = "profile_id string, primitive string, card_min int, card_max int, " + ", ".join(f"{k} string" for k in answers.RUNTIME)
    kinds += f", temperature double, bias array<double>, policy struct<type: string, threshold: double, metric: string, max_order_discrepancy: double>, metrics struct<{METRICS}>"
    good = tuple(FULL.values())
    profiles = spark.createDataFrame([
        ("b", "boolean", 2, 2, *key.values(), 0.5, None, policy, good), ("bad", "boolean", 2, 2, *key.values(), 0.5, None, policy, tuple((FULL | {"ece": 0.2}).values())),
        ("c", "choice", 2, 3, *key.values(), 1.0, [0.0, 3.0], policy, good), ("s", "score", 2, 3, *key.values(), 1.0, None, policy, good),
    ], kinds)
    none, other = (None,) * 6, ("x", "x", "y", None, None, None)
    z = [0.0, 1.0]
    data = [
        ("1", "b", "boolean", ["false", "true"], z, none, None, None), ("2", "b", "boolean", ["false", "true"], z, other, None, None), ("3", "bad", "boolean", ["false", "true"], z, none, None, None),
        ("4", None, "boolean", ["false", "true"], z, none, None, None), ("5", "c", "choice", ["a", "b"], [1.0, 0.0], none, None, None), ("6", "c", "choice", ["a", "b"], [1.0, 0.0], none, 0.2, None),
        ("7", "c", "choice", ["a", "b", "c", "d"], [1.0, 0.0, 0.0, 0.0], none, None, None), ("8", "s", "score", ["l1", "l2"], [0.0, 0.0], none, None, [1.0, 2.0]), ("9", "b", "choice", ["a", "b"], z, none, None, None),
        ("10", "zz", "choice", ["b", "a"], [0.0, 0.0], none, None, None),
    ]
    runtime = ", ".join(f"{k}: string" for k in answers.RUNTIME)
    d = spark.createDataFrame(data, f"i string, profile_id string, primitive string, ids array<string>, z array<double>, runtime struct<{runtime}>, discrepancy double, values array<double>")
    got = {r.i: r for r in answers.calibrated_answers(d, profiles).collect()}
    assert {i: r.status for i, r in got.items()} == {
        "1": "validated", "2": "incompatible", "3": "no_evidence", "4": "no_profile", "5": "validated", "6": "validated", "7": "incompatible", "8": "validated", "9": "incompatible", "10": "no_profile"}
    assert all((r.calibration_status == "validated") == (r.status == "validated") and (r.status == "validated" or r.disposition == "review") for r in got.values())
    assert (got["1"].value, got["1"].disposition) == ("true", "accept") and got["1"].p_true == pytest.approx(1 / (1 + math.exp(-2)))
    assert got["2"].p_true == pytest.approx(1 / (1 + math.exp(-1))) and got["5"].value == "b" and got["5"].disposition == "accept" and got["6"].disposition == "review"
    assert got["8"].expected_value == pytest.approx(1.5) and got["8"].level_id == "l1" and got["8"].disposition == "review" and got["10"].value == "b"


def test_label_mass_gate(spark):
    df = spark.createDataFrame([("g", ["a", "b", "c"], [0.0, 0.0, 0.0]), ("g", ["a"], None), ("h", ["a", "b"], [5.0, 5.0])], "g string, v array<string>, z array<double>")
    df = df.withColumn("m", answers.label_mass(F.col("v"), F.col("z"), F.array(F.lit("a"), F.lit("b"), F.lit("zz"))))
    got = {r.g: r for r in answers.label_mass_gate(df, "m", ["g"]).collect()}
    assert (got["g"].n, got["g"].missing, got["g"].below, got["g"].gate_passed) == (2, 1, 1, False) and got["h"].gate_passed
    with pytest.raises(Exception, match="label mass"):
        answers.label_mass_gate(df, "m", ["g"], strict=True).collect()


def test_sources_refuse_skip_and_count(spark, tmp_path):
    for name, x in {
        "a.json": {"profile_id": "p", "workload_id": "w", "primitive": "boolean", "temperature": 1.5}, "b.json": {"profile_id": "p", "workload_id": "w2", "primitive": "boolean", "temperature": 2},
        "c.json": {"profile_id": "q", "workload_id": "w", "primitive": "choice", "temperature": -1.0}, "e.json": {"profile_id": "r", "primitive": "choice"},
    }.items():
        (tmp_path / "profiles").mkdir(exist_ok=True)
        (tmp_path / "profiles" / name).write_text(json.dumps(x))
    (tmp_path / "profiles" / "d.json").write_text('{"profile_id": "cut')
    got = files.read_profiles(spark, str(tmp_path / "profiles")).collect()
    assert [(r.profile_id, r.workload_id, r.temperature) for r in got] == [("p", "w2", 2.0)]
    (tmp_path / "requests").mkdir()
    (tmp_path / "requests" / "one.json").write_text(json.dumps({"state": "s", "questions": {"a": {"type": "boolean"}}}))
    with pytest.raises(ValueError, match="one.json"):
        files.read_requests(spark, str(tmp_path / "requests"))
    cache = tmp_path / "cache.jsonl"
    cache.write_text(json.dumps({"example_id": "e", "question_id": "q"}) + '\n{"example_id": "cut\n')
    assert [r.example_id for r in files.read_cache(spark, str(cache)).collect()] == ["e"]
    rows = spark.createDataFrame([("t1", "a", "k1"), ("t2", "zz", "k1"), ("t3", "b", "k2"), ("", "a", "k3"), ("t5", "c", "k1"), (None, None, None)], "text string, label string, key string")
    kept, counts = files.import_heldout(rows, "text", "label", F.col("text") == "t5", ["a", "c"], ["b"], least=2)
    assert {(r.text, r.label) for r in kept.collect()} == {("t1", "a"), ("t3", "other")} and dict(map(tuple, counts.collect())) == {"label": 1, "no_text": 2, "overlap": 1}
    with pytest.raises(ValueError, match="needed"):
        files.import_heldout(rows, "text", "label", F.lit(False), ["a"], [])
    kept, counts = files.with_context(rows, spark.createDataFrame([("k1", "ctx")], "key string, context string"), "key", "context")
    assert {r.text for r in kept.collect()} == {"t1", "t2", "t5"} and dict(map(tuple, counts.collect())) == {"missing_context": 3}


def test_exemplars_fill_up(spark):
    pool = spark.createDataFrame([(i, "t", w) for i, w in enumerate(["x y", "", "z", "x", "q", "r"])] + [(9, "small", "b"), (10, "small", "a")], "pool_id int, task string, text string")
    q = spark.createDataFrame([("a", "t", "x y"), ("b", "t", ""), ("c", "small", "a"), ("d", "none", "a")], "query_id string, task string, text string")
    got = {}
    for r in monitor.top_k_similar(q, pool, "task", 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.pool_id)
    assert got == {"a": [0, 3, 1], "b": [0, 1, 2], "c": [9, 10]}
