"""Whole pipelines and the remaining operators as queries: suite build, calibration, paired gates, prompts, logit sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as ds
from ..functions import text as tx
from ..operators import calibrate, compare, dedup, logits, metrics, report, selective
from ..sources import files
from ..storage import Scratch
from .catalog import _ARMS, _COMPONENTS, _LABELS, G, KEY, query, rounded
from .tables import D, O, decisions, profiles, second_arm, table

# ---- requests and prompts -------------------------------------------------------------------------------------------

_QUESTIONS = """q as (select distinct example_id, workload_id, unnest(map_entries(request.questions)) as e, reference_answers as r from suite),
  c as (select example_id, workload_id, e.key as question_id, e.value.type as primitive, r[e.key] as reference,
        coalesce(e.value.instructions, '') as instructions,
        case e.value.type when 'choice' then list_transform(e.value.options, lambda x: {'id': x.id, 'd': x.description})
             when 'score' then list_transform(e.value.levels, lambda x: {'id': x.id, 'd': x.description})
             else [{'id': 'false', 'd': 'not supported'}, {'id': 'true', 'd': 'supported'}] end as o from q)"""


def questions(spark, sf_dir) -> DataFrame:
    """One row per question with its ordered options ``o`` (id, d)."""
    rows = table(spark, sf_dir, "suite").select("example_id", "workload_id", "reference_answers", F.explode("request.questions").alias("question_id", "q"))
    pick = lambda c: F.transform(c, lambda x: F.struct(x["id"].alias("id"), x["description"].alias("d")))
    fixed = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(d).alias("d")) for i, d in (("false", "not supported"), ("true", "supported"))))
    o = F.when(F.col("q.type") == "choice", pick("q.options")).when(F.col("q.type") == "score", pick("q.levels")).otherwise(fixed)
    rows = rows.select("example_id", "workload_id", "question_id", F.col("q.type").alias("primitive"), F.col("reference_answers")[F.col("question_id")].alias("reference"),
                       F.coalesce("q.instructions", F.lit("")).alias("instructions"), o.alias("o"))
    return rows.dropDuplicates(["example_id", "question_id"])


def prompt(o, instructions, turn: int = 0):
    """Lettered candidates after the instructions (B18); choices may be turned."""
    o = ds.rotate(o, turn) if turn else o
    lines = F.transform(o, lambda x, i: F.concat(F.lit("["), F.char(i + 65), F.lit("] "), x["id"], F.lit(": "), F.coalesce(x["d"], F.lit(""))))
    return F.concat_ws("\n", instructions, F.array_join(lines, "\n"))


_PROMPT = "array_to_string([instructions] || list_transform(range(1, len(o) + 1), lambda i: '[' || chr((64 + i)::integer) || '] ' || o[i].id || ': ' || coalesce(o[i].d, '')), chr(10))"


@query(f"""with {_QUESTIONS} select example_id, question_id, sha256({_PROMPT}) as prompt_sha256 from c""")
def b18_prompt_compile(spark, sf_dir):
    rows = questions(spark, sf_dir)
    return rows.select("example_id", "question_id", F.sha2(prompt(F.col("o"), F.col("instructions")), 256).alias("prompt_sha256"))


@query(f"""with {_QUESTIONS}, t as (select * replace (o[2:] || o[:1] as o) from c where primitive = 'choice')
           select example_id, question_id, sha256({_PROMPT}) as prompt_sha256 from t""")
def b19_rotated_prompt(spark, sf_dir):
    rows = questions(spark, sf_dir).where("primitive = 'choice'")
    return rows.select("example_id", "question_id", F.sha2(prompt(F.col("o"), F.col("instructions"), 1), 256).alias("prompt_sha256"))


@query(f"""with {_QUESTIONS} select example_id, question_id, cast(list_position(list_transform(o, lambda x: x.id), reference) - 1 as bigint) as target from c
           where list_contains(list_transform(o, lambda x: x.id), reference)""")
def b29_target_index(spark, sf_dir):
    rows = questions(spark, sf_dir).withColumn("ids", F.transform("o", lambda x: x["id"])).where("reference is not null")
    return rows.withColumn("target", F.array_position("ids", F.col("reference")) - 1).where("target >= 0").select("example_id", "question_id", "target")


@query("""with r as (select distinct example_id, map_values(request.questions) as v from suite)
          select cast(len(v) as integer) as questions, count(*) as examples, count(*) filter (len(list_filter(v, lambda x: x.type <> 'boolean')) = 0) as all_boolean from r group by 1""")
def b32_benchmark_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id", F.map_values("request.questions").alias("v")).dropDuplicates(["example_id"])
    return rows.groupBy(F.size("v").alias("questions")).agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.forall("v", lambda x: x["type"] == "boolean")).alias("all_boolean"))


@query("""with p as (select profile_id as path, policy as p from calibration_profile)
          select path, 'policy.type' as leaf, 'string' as kind from p where p.type is not null union all select path, 'policy.metric', 'string' from p where p.metric is not null
          union all select path, 'policy.threshold', 'number' from p where p.threshold is not null union all select path, 'policy.max_order_discrepancy', 'number' from p where p.max_order_discrepancy is not null""")
def b34_json_leaves(spark, sf_dir):
    docs = profiles(spark, sf_dir).select(F.col("profile_id").alias("path"), F.to_json(F.struct("policy")).alias("value"))
    return report.leaves(spark, docs).select("path", "leaf", "kind")


@query("""select profile_id, case when abs(x) < 1e-4 and x <> 0 then printf('%.3e', x) else regexp_replace(printf('%.6f', x), '\\.?0+$', '') end as shown
          from (select profile_id, temperature as x from calibration_profile)""")
def b35_number_format(spark, sf_dir):
    return profiles(spark, sf_dir).select("profile_id", tx.number_text(F.col("temperature")).alias("shown"))


@query(f"""with {_QUESTIONS}, p as (select workload_id, {_PROMPT} as p from c) select workload_id, count(*) as asked, count(distinct p) as scored from p group by 1""")
def d14_prompt_memo(spark, sf_dir):
    """What deduplicating prompts before an expensive scorer saves."""
    rows = questions(spark, sf_dir).select("workload_id", F.sha2(prompt(F.col("o"), F.col("instructions")), 256).alias("p"))
    return rows.groupBy("workload_id").agg(F.count(F.lit(1)).alias("asked"), F.count_distinct("p").alias("scored"))


# ---- suite build ----------------------------------------------------------------------------------------------------


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null)
          select doc_id, cast(len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) as integer) as shingles from w where len(w) >= 5""")
def c02_shingles(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", words.alias("w")).where("size(w) >= 5")
    return rows.select("doc_id", F.size(dedup.shingles(F.col("w"))).alias("shingles"))


@query(f"""with {_COMPONENTS}, p as (select distinct example_id, public_source.upstream_split as u, evaluation_split as e, task_template_holdout as h, workload_id from suite),
           bad as (select component, count(distinct coalesce(u, '~') || '|' || coalesce(e, '~')) > 1 as q, max(e) as x, min(h) as h0, max(h) as h1 from p join m using (example_id) group by 1),
           f as (select component, x, h1, h0, cast(cast('0x' || substring(sha256('seed' || chr(0) || component), 1, 16) as ubigint) % 100 as integer) as b from bad where not q)
           select workload_id, case when h0 <> h1 or (x is not null and h1 and x <> 'task_holdout') then null when x is not null then x when h1 then 'task_holdout'
               when b < 60 then 'train' when b < 75 then 'development' when b < 85 then 'calibration' else 'locked_test' end as split, count(*) as examples
           from (select distinct example_id, workload_id from p) join m using (example_id) join f using (component) group by all""")
def c10_suite_build(spark, sf_dir):
    """Components, quarantine of those across boundaries, splits of the rest, counted."""
    return suite_build(table(spark, sf_dir, "suite"))


@query()
def c04_text_clusters(spark, sf_dir):
    return dedup.text_clusters(table(spark, sf_dir, "suite"))


@query()
def c10_suite_build_from_texts(spark, sf_dir):
    """The whole build (C1-C7): as ``c10_suite_build``, with clusters of the texts in place of the stored ids."""
    rows = table(spark, sf_dir, "suite")
    clusters = Scratch(spark, "suite").save(dedup.text_clusters(rows), "clusters")
    rows = rows.drop("near_duplicate_cluster_id").join(clusters.withColumnRenamed("cluster_id", "near_duplicate_cluster_id"), "example_id")
    return suite_build(rows)


def suite_build(rows: DataFrame) -> DataFrame:
    comp = dedup.source_components(rows)
    kept = dedup.boundary_conflicts(rows, comp).where("not quarantined").select("example_id", "component")
    splits = dedup.assign_splits(rows, kept, "seed")
    out = rows.select("example_id", "workload_id").distinct().join(splits, "example_id")
    return out.groupBy("workload_id", "split").agg(F.count(F.lit(1)).alias("examples"))


@query("""select source, split, count(*) as n from (select 'suite' as source, evaluation_split as split from suite union all select 'heldout', split from heldout_items) group by all""")
def h03_source_union(spark, sf_dir):
    a = table(spark, sf_dir, "suite").select(F.lit("suite").alias("source"), F.col("evaluation_split").alias("split"))
    b = table(spark, sf_dir, "heldout_items").select("split", F.lit("heldout").alias("source"))
    return a.unionByName(b).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {D}, g as (select workload_id, count(*) as n from d group by 1) select n >= 100 as large, min(workload_id) as first_group, count(*) as groups from g group by 1""")
def g08_first_group(spark, sf_dir):
    g = decisions(spark, sf_dir, "workload_id").groupBy("workload_id").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy((F.col("n") >= 100).alias("large")).agg(F.min("workload_id").alias("first_group"), F.count(F.lit(1)).alias("groups"))


@query("""with x as (select distinct example_id, workload_id from suite) select coalesce(p.profile_id, 'no profile') as profile, count(*) as examples
          from x left join calibration_profile p using (workload_id) group by 1""")
def d11_lookup_misses(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id", "workload_id").distinct()
    out = rows.join(profiles(spark, sf_dir).select("workload_id", "profile_id"), "workload_id", "left")
    return out.groupBy(F.coalesce("profile_id", F.lit("no profile")).alias("profile")).agg(F.count(F.lit(1)).alias("examples"))


@query(f"""with {D} select workload_id, count(*) as n, count(reference) as referenced from d group by 1""")
def a03_predictions_from_files(spark, sf_dir):
    """Predictions written as JSON lines to the shared folder, read back through the scan with its key check."""
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction")
    path = f"{Scratch(spark, 'files').root}/predictions.jsonl"
    files.append_predictions(d, path)
    rows = files.read_jsonl(spark, path, "prediction", KEY)
    return rows.groupBy("workload_id").agg(F.count(F.lit(1)).alias("n"), F.count("reference").alias("referenced"))


@query("""with r as (select case when split is null then 'no_split' when text is null or trim(text) = '' then 'no_text' when workload_id not in (select workload_id from calibration_profile) then 'workload' end as reason from heldout_items)
          select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1""")
def a05_exclusions_from_csv(spark, sf_dir):
    """Held-out items written as CSV, read back, and filtered with the reasons counted."""
    path = f"{Scratch(spark, 'files').root}/items"
    table(spark, sf_dir, "heldout_items").select(*(F.col(c).cast("string") for c in ("item_id", "workload_id", "split", "lang", "text"))).write.option("header", True).option(
        "escape", '"').option("emptyValue", "").option("nullValue", "\\N").csv(path)
    rows = files.read_table(spark, path, ["item_id", "workload_id", "split", "text"])
    rows = rows.select(*(F.when(F.col(c) != "\\N", F.col(c)).alias(c) for c in rows.columns))
    known = [r[0] for r in profiles(spark, sf_dir).select("workload_id").distinct().collect()]  # a fixed registry
    kept, counts = files.with_exclusions(rows, {"no_split": F.col("split").isNull(), "no_text": F.coalesce(F.trim("text"), F.lit("")) == "", "workload": ~F.col("workload_id").isin(known)})
    return counts.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("reason"), "n"))


@query("""select profile_id, workload_id, primitive, round(temperature, 6) as temperature, policy.threshold as threshold, metrics.sample_count as sample_count from calibration_profile""")
def a12_profiles_from_files(spark, sf_dir):
    """Profiles written as one JSON file each and read back."""
    path = f"{Scratch(spark, 'files').root}/profiles"
    profiles(spark, sf_dir).repartition(48, "profile_id").write.option("maxRecordsPerFile", 1).json(path)
    return rounded(files.read_profiles(spark, path).select("profile_id", "workload_id", "primitive", "temperature", "policy.threshold", "metrics.sample_count"), "temperature")


# ---- metrics and comparison -----------------------------------------------------------------------------------------


@query(f"""with {_LABELS}, k as (select distinct {G}, unnest(map_keys(answer.probabilities)) as label from d),
           j as (select k.*, coalesce(f1, 0) as f1 from k left join f using ({G}, label))
           select {G}, count(*) as labels, round(avg(f1), 6) as macro_f1 from j group by all""")
def e03_declared_macro_f1(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer")
    declared = d.select("workload_id", "primitive", F.explode(F.map_keys("answer.probabilities")).alias("label")).distinct()
    f1 = metrics.per_label(d).select("workload_id", "primitive", "label", "f1")
    out = declared.join(f1, ["workload_id", "primitive", "label"], "left").groupBy("workload_id", "primitive")
    return rounded(out.agg(F.count(F.lit(1)).alias("labels"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1")), "macro_f1")


def _f1_of(prediction: str, name: str) -> str:
    return f"""v{name} as (select {G}, reference as label, cast(reference = {prediction} as int) as tp, 0 as p, 1 as s from d where reference is not null and {prediction} is not null
        union all select {G}, {prediction}, 0, 1, 0 from d where reference is not null and {prediction} is not null),
      f{name} as (select {G}, avg(f) as f1_{name} from (select {G}, label, coalesce(2.0::double * sum(tp) / nullif(sum(p) + sum(s), 0), 0) as f from v{name} group by all) group by all)"""


@query(f"""with {D.replace("select *", "select *, case when answer.p_true >= 0.3 then 'true' else prediction end as other")}, {_f1_of("prediction", "a")}, {_f1_of("other", "b")}
           select {G}, round(f1_a, 6) as f1_a, round(f1_b, 6) as f1_b, round(f1_a - f1_b, 6) + 0 as difference, f1_a >= 0.85 and f1_a - f1_b >= -0.02 as gate_passed from fa join fb using ({G}) where primitive <> 'score'""")
def e23_paired_gates(spark, sf_dir):
    """Macro-F1 of two arms; the second says yes from 0.3 on."""
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer").where("primitive <> 'score'")
    other = d.withColumn("prediction", F.when(F.col("answer.p_true") >= 0.3, "true").otherwise(F.col("prediction")))
    a = metrics.classification(d).select("workload_id", "primitive", F.col("macro_f1").alias("f1_a"))
    b = metrics.classification(other).select("workload_id", "primitive", F.col("macro_f1").alias("f1_b"))
    out = a.join(b, ["workload_id", "primitive"]).withColumn("difference", F.col("f1_a") - F.col("f1_b"))
    out = out.withColumn("gate_passed", (F.col("f1_a") >= 0.85) & (F.col("difference") >= -0.02))
    return rounded(out, "f1_a", "f1_b", "difference")


@query(f"""with {_ARMS} select example_id, question_id, 'compared' as status, list_position(p1, list_max(p1)) = list_position(p2, list_max(p2)) as argmax_agrees,
             round(list_max(list_transform(range(1, len(p1) + 1), lambda i: abs(p1[i] - p2[i]))), 6) as deviation, (list_max(p1) >= 0.9) <> (list_max(p2) >= 0.9) as policy_flip from q""")
def d03_response_pairs(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "answer")).select(*KEY, "workload_id", "ids", "z")
    rows = compare.equivalence_rows(compare.paired(d, second_arm(d)))
    return rounded(rows.select(*KEY, "status", "argmax_agrees", "deviation", "policy_flip"), "deviation")


@query("""with l as (select * from shadow_log qualify row_number() over (partition by request_id order by received_at) = 1),
          r as (select artifact_id as workload_id, timing_ms.total as x from l where timing_ms.total >= 0 and not isnan(timing_ms.total)),
          i as (select *, row_number() over (partition by workload_id order by x) - 1 as i, count(*) over (partition by workload_id) as n from r)
          select workload_id as artifact_id, n, round(avg(x) filter (i = floor((n - 1) / 2.0) or i = floor(n / 2.0)), 6) as median, round(max(x) filter (i = floor(0.95::double * (n - 1))), 6) as p95 from i group by all""")
def e34_benchmark_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "shadow_log").select("request_id", "artifact_id", F.col("timing_ms.total").alias("total_ms")).dropDuplicates(["request_id"])
    return rounded(metrics.latency(rows, "total_ms", ["artifact_id"]), "median", "p95")


@query()
def f03_calibration_pipeline(spark, sf_dir):
    """Calibration split to profile rows: temperature, or temperatures and biases of each set of options where those are kept;
    Brier, ECE before and after, certified threshold, gates."""
    calibration = table(spark, sf_dir, "suite").where("evaluation_split = 'calibration'").select("example_id")
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer").join(calibration, "example_id", "left_semi")
    s = metrics.scored(d)
    by = ["workload_id", "primitive"]
    after, fit = calibrate.calibrated(s)
    scores = metrics.proper_scores(after).select(*by, "n", "brier", "prevalence_brier", "nll")
    raw = metrics.calibration_error(s).select(*by, F.col("ece").alias("ece_before"))
    ece = metrics.calibration_error(after).select(*by, "ece")
    policy = selective.certified_threshold(after)
    out = fit.join(scores, by).join(raw, by).join(ece, by).join(policy, by)
    out = out.withColumn("gate_passed", (F.col("ece") <= 0.05) & (F.col("brier") <= F.col("prevalence_brier")) & (F.col("policy") == "threshold"))
    return rounded(out, "brier", "prevalence_brier", "nll", "ece", "ece_before", "threshold", "coverage", "bound")


# ---- a logit source end to end --------------------------------------------------------------------------------------


@query("""with h as (select *, cast(cast('0x' || substring(sha256('seed' || chr(0) || cast(vec_id as varchar)), 1, 16) as ubigint) % 100 as integer) as b from embeddings where label is not null),
          v as (select *, case when b < 60 then 'train' when b < 75 then 'development' when b < 85 then 'calibration' else 'locked_test' end as split from h),
          e as (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as k from v where split = 'train'),
          m as (select label, k, avg(x) as m from e group by all),
          f as (select vec_id, split, label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as k from v where split <> 'train'),
          z as (select vec_id, split, f.label, m.label as class, sum(x * m) as z from f join m using (k) group by all),
          s as (select vec_id, split, label, max(z) as top, max(z) filter (class = label) as mine, ln(sum(exp(z))) as norm, arg_max(cast(class as varchar), z) as best from z group by all)
          select split, count(*) as n, round(avg((best = cast(label as varchar))::int), 6) as accuracy, round(avg(norm - mine), 6) as nll from s group by 1""")
def m00_vector_classes(spark, sf_dir):
    """Embeddings scored by class centroids of the training bucket, measured on the other buckets."""
    v = table(spark, sf_dir, "embeddings").where("label is not null").withColumn("split", tx.split_of(tx.bucket("seed", F.col("vec_id").cast("string"))))
    source = logits.centroid_source(v.where("split = 'train'"))
    s = source(v.where("split <> 'train'")).withColumn("p", ds.softmax(F.col("z")))
    mine = F.element_at("p", F.array_position("ids", F.col("label").cast("string")).cast("int"))
    hit = (ds.argmax_first(F.col("ids"), F.col("p")) == F.col("label").cast("string")).cast("int")
    out = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(-F.ln(F.greatest(mine, F.lit(ds.LEAST)))).alias("nll"))
    return rounded(out, "accuracy", "nll")
