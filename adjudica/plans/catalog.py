"""Every query of the evaluation layer by name, each with the SQL that must give the same rows. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distributions as ds
from ..functions import text as tx
from ..functions.binomial import error_bound
from ..operators import answers, calibrate, compare, dedup, metrics, monitor, report, selective
from .tables import D, O, S, decisions, examples, profiles, second_arm, table

FLAGSHIP = "e02_classification"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six places, and no negative zero."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer"))


KEY = ["example_id", "question_id"]
G = "workload_id, primitive"

def _bound(source: str, key: str) -> str:
    """CTE ``bound(key, bound)`` of ``source(key, accepted, errors)``: the Clopper-Pearson limit, bisected over the CDF."""
    cdf = (
        "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
        " + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))))"
    )
    return f"""bis as (select {key}, accepted as n, errors as k, 0 as step, errors / accepted::double as lo, 1.0::double as hi from {source} where errors > 0 and errors < accepted
        union all select {key}, n, k, step + 1, case when above then mid else lo end, case when above then hi else mid end
        from (select *, (lo + hi) / 2 as mid, {cdf} > 0.05 as above from bis where step < 45)),
      bound as (select {key}, case when accepted <= 0 or errors >= accepted then 1 when errors = 0 then 1 - pow(0.05::double, 1 / accepted::double) else (lo + hi) / 2 end as bound
        from {source} left join (select * from bis where step = 45) using ({key}))"""


# ---- sources and predicates -----------------------------------------------------------------------------------------


@query("""select example_id, q.key as question_id, q.value.type as primitive, cast(coalesce(len(q.value.options), len(q.value.levels), 2) as integer) as options
          from (select distinct example_id, unnest(map_entries(request.questions)) as q from suite)""")
def b01_explode_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id", F.explode("request.questions").alias("question_id", "q"))
    n = F.coalesce(F.size("q.options"), F.size("q.levels"), F.lit(2)).cast("int")
    return rows.select("example_id", "question_id", F.col("q.type").alias("primitive"), n.alias("options")).distinct()


@query("""select workload_id, count(distinct example_id) as examples from suite
          where evaluation_split = 'development' and annotation_status <> 'excluded' group by 1""")
def b02_split_filter(spark, sf_dir):
    rows = examples(spark, sf_dir, "workload_id", "evaluation_split", "annotation_status")
    rows = rows.where("evaluation_split = 'development' and annotation_status <> 'excluded'")
    return rows.groupBy("workload_id").agg(F.count_distinct("example_id").alias("examples"))


@query(f"""with {D}, bad as (select distinct split_part(example_id || ':' || question_id, ':', 1) as example_id from d
             where reference is not null and reference <> prediction and answer.disposition = 'accept')
           select workload_id, count(*) as kept from d where example_id not in (select example_id from bad) group by 1""")
def b03_quarantine_exclusion(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "reference", "prediction", "answer")
    bad = d.where("reference <> prediction and answer.disposition = 'accept'").select(F.concat_ws(":", *KEY).alias("suspect"))
    bad = bad.select(F.split("suspect", ":")[0].alias("example_id")).distinct()
    return d.join(bad, "example_id", "left_anti").groupBy("workload_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""with {O.replace("z as", "zz as")}, t as (select example_id, question_id, list_transform(z, lambda x: exp((x - list_max(z)) / 2)) as e from zz)
           select example_id, question_id, round(list_max(e) / list_sum(e), 6) as top, round(list_min(e) / list_sum(e), 6) as least from t""")
def b04_softmax(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "answer")).withColumn("q", ds.softmax(F.col("z"), 2.0))
    return rounded(d.select(*KEY, F.array_max("q").alias("top"), F.array_min("q").alias("least")), "top", "least")


@query(f"""with {O} select example_id, question_id,
             round(list_sum(list_transform(range(1, len(ids) + 1), lambda i: p[i] * cast(regexp_extract(ids[i], '([0-9]+)$', 1) as double))), 6) as expected
           from o where primitive = 'score'""")
def b06_expected_value(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "primitive", "answer").where("primitive = 'score'"))
    v = F.transform("ids", lambda i: F.regexp_extract(i, r"(\d+)$", 1).cast("double"))
    return rounded(d.select(*KEY, ds.expected(F.col("p"), v).alias("expected")), "expected")


@query(f"""with {O.replace("z as", "zz as")}, r as (select *, list_transform(p, lambda x: round(x, 1)) as c from o)
           select example_id, question_id, ids[list_position(c, list_max(c))] as first_id,
             list_max(list_filter(ids, lambda i: c[list_position(ids, i)] = list_max(c))) as greatest_id from r""")
def b07_argmax(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "answer"))
    c = F.transform("p", lambda x: F.round(x, 1))  # coarse on purpose: ties occur
    return d.select(*KEY, ds.argmax_first(F.col("ids"), c).alias("first_id"), ds.argmax_greatest_id(F.col("ids"), c).alias("greatest_id"))


@query(f"""with {D} select workload_id, count(*) as n, count(*) filter (answer.p_true >= 0.5) as yes from d where primitive = 'boolean' group by 1""")
def b08_boolean(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "answer").where("primitive = 'boolean'")
    return d.groupBy("workload_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer.p_true") >= 0.5).alias("yes"))


_ARMS = f"""{O}, arms as (select *, list_transform(z, lambda x: round(x * 8) / 8) as z2 from z),
  e as (select *, list_transform(z, lambda x: exp(x - list_max(z))) as e1, list_transform(z2, lambda x: exp(x - list_max(z2))) as e2,
               list_transform(range(1, len(z) + 1), lambda i: (z[i] + z2[i]) / 2) as zm from arms),
  q as (select *, list_transform(e1, lambda x: x / list_sum(e1)) as p1, list_transform(e2, lambda x: x / list_sum(e2)) as p2,
               list_transform(zm, lambda x: exp(x - list_max(zm))) as em from e)"""


@query(f"""with {_ARMS} select example_id, question_id, 'compared' as status, ids[list_position(em, list_max(em))] as selected, round(list_max(em) / list_sum(em), 6) as confidence,
             round(list_max(list_transform(range(1, len(p1) + 1), lambda i: abs(p1[i] - p2[i]))), 6) as discrepancy
           from q where primitive = 'choice'""")
def b09_cyclic_ensemble(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "primitive", "answer").where("primitive = 'choice'")).select(*KEY, "ids", "z")
    return rounded(compare.cyclic_ensemble(d, second_arm(d)), "confidence", "discrepancy")


@query(f"""with {O}, prior as (select workload_id, primitive, i, avg(v) as m from (
               select workload_id, primitive, unnest(ids) as i, unnest(z) as v from z) group by all),
           x as (select workload_id, primitive, example_id, question_id, unnest(ids) as i, unnest(z) as v from z),
           y as (select example_id, question_id, v - 0.5 * m as s from x join prior using ({G}, i))
           select example_id, question_id, round(exp(max(s) - ln(sum(exp(s)))), 6) as top from y group by all""")
def b10_null_prior(spark, sf_dir):
    """The prior of a group: mean logits of each option over the group."""
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "answer")).select(*KEY, "workload_id", "primitive", "ids", "z")
    flat = d.select("workload_id", "primitive", F.explode(F.arrays_zip("ids", "z")).alias("o"))
    prior = flat.groupBy("workload_id", "primitive", F.col("o.ids").alias("i")).agg(F.avg("o.z").alias("m"))
    prior = prior.groupBy("workload_id", "primitive").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("prior"))
    d = d.join(prior, ["workload_id", "primitive"]).withColumn("pz", F.transform("ids", lambda i: F.col("prior")[i]))
    return rounded(d.select(*KEY, F.array_max(ds.softmax(ds.without_prior(F.col("z"), F.col("pz"), 0.5))).alias("top")), "top")


def with_mass(spark, sf_dir) -> DataFrame:
    """Choices with the mass of the labels other than the catch-all ``rest``; not measured (null) where there is none."""
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "answer").where("primitive = 'choice'"))
    mass = answers.label_mass(F.col("ids"), F.col("z"), F.array_except("ids", F.array(F.lit("rest"))))
    return d.select(*KEY, "workload_id", F.when(F.array_contains("ids", "rest"), mass).alias("mass"))


_MASS = f"""{O}, v as (select example_id, question_id, workload_id, unnest(ids) as i, unnest(z) as z from z where primitive = 'choice'),
  m as (select example_id, question_id, any_value(workload_id) as workload_id,
          case when count(*) filter (i = 'rest') > 0 then coalesce(sum(exp(z)) filter (i <> 'rest'), 0) / sum(exp(z)) end as mass from v group by 1, 2)"""


@query(f"""with {_MASS} select example_id, question_id, round(mass, 6) as mass from m""")
def b11_label_mass(spark, sf_dir):
    return rounded(with_mass(spark, sf_dir).select(*KEY, "mass"), "mass")


@query(f"""with {_MASS} select workload_id, count(*) as n, count(*) filter (mass is null) as missing, count(*) filter (mass < 0.9) as below, round(min(mass), 6) as least_mass,
             round(avg(mass), 4) as mean_mass, count(*) filter (mass is null or mass < 0.9) = 0 as gate_passed from m group by 1""")
def b12_label_mass(spark, sf_dir):
    return rounded(answers.label_mass_gate(with_mass(spark, sf_dir), "mass", ["workload_id"]), "least_mass").withColumn("mean_mass", F.round("mean_mass", 4))


_JOINED = f"""{O}, j as (select o.*, f.profile_id, f.policy, list_reverse_sort(p) as r from o left join calibration_profile f
   on o.workload_id = f.workload_id and o.primitive = f.primitive and len(o.ids) between f.card_min and f.card_max)"""


def joined(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "answer"))
    f = profiles(spark, sf_dir).select("workload_id", "primitive", "profile_id", "policy", "card_min", "card_max")
    on = (d.workload_id == f.workload_id) & (d.primitive == f.primitive) & F.size("ids").between(f.card_min, f.card_max)
    return d.join(f, on, "left").select(d["*"], "profile_id", "policy")


@query(f"""with {_JOINED}, a as (select workload_id, primitive, case when policy is null or policy.type = 'review_only' or coalesce(answer.order_discrepancy > policy.max_order_discrepancy, false) then 'review'
             when (case when policy.metric = 'margin' then r[1] - r[2] else r[1] end) >= policy.threshold then 'accept' else 'review' end as disposition from j)
           select {G}, disposition, count(*) as n from a group by all""")
def b13_acceptance(spark, sf_dir):
    d = joined(spark, sf_dir)
    out = d.withColumn("disposition", ds.acceptance(F.col("p"), F.col("policy"), F.col("answer.order_discrepancy")))
    return out.groupBy("workload_id", "primitive", "disposition").agg(F.count(F.lit(1)).alias("n"))


_EVIDENCE = f"""r as (select profile_id, metrics.errors_in_accepted as errors, metrics.accepted_count as accepted from calibration_profile), {_bound("r", "profile_id")},
  evidence as (select profile_id, coalesce(metrics.gate_ece_passed and metrics.ece between 0 and 0.05 and metrics.coverage between 0.5 and 1
             and metrics.errors_in_accepted between 0 and metrics.accepted_count and metrics.accepted_count between 59 and metrics.sample_count
             and metrics.accepted_count / metrics.sample_count >= 0.5 and bound <= 0.05, false) as plausible from calibration_profile join bound using (profile_id))"""


@query(f"""with recursive {_EVIDENCE} select profile_id, plausible from evidence""")
def b15_profile_evidence(spark, sf_dir):
    """The conjuncts whose fields the shortened metrics hold, with the bound computed anew from the counts."""
    f = profiles(spark, sf_dir)
    return f.select("profile_id", answers.has_evidence(f.schema["metrics"].dataType, whole=False).alias("plausible"))


#: Runtimes by name: artifact, model, revision, precision, prompt version, label version; null: not said.
_RUNTIMES = [
    ("any", None, None, None, None, None, None), ("model", None, "scorer-0", None, None, None, None), ("artifact", "art-1", None, None, "bfloat16", None, None),
    ("strict", "art-1", "scorer-1", "r2", "bfloat16", "p2", "l0"), ("unknown", None, None, "none", None, None, None),
]
_RUNTIME_SQL = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in _RUNTIMES)
_FITS = " and ".join(f"(r.{k} is null or r.{k} = f.{k})" for k in answers.RUNTIME)


def runtimes(spark) -> DataFrame:
    rows = spark.createDataFrame(_RUNTIMES, "name string, " + ", ".join(f"{k} string" for k in answers.RUNTIME))
    return rows.select("name", F.struct(*answers.RUNTIME).alias("runtime"))


@query(f"""with r(name, {", ".join(answers.RUNTIME)}) as (values {_RUNTIME_SQL}), {O}, q as (select distinct primitive, len(ids) as options from o)
           select r.name, f.profile_id, q.primitive, cast(q.options as integer) as options from r, q, calibration_profile f
           where f.primitive = q.primitive and q.options between f.card_min and f.card_max and {_FITS}""")
def b14_compatible_profiles(spark, sf_dir):
    """Which profiles fit which runtime, primitive and number of options: two small dimensions against the profiles."""
    q = ds.with_options(decisions(spark, sf_dir, "primitive", "answer")).select("primitive", F.size("ids").alias("options")).distinct()
    f = profiles(spark, sf_dir).select("profile_id", F.struct("primitive", "card_min", "card_max", *answers.RUNTIME).alias("profile"))
    rows = q.join(f, F.col("primitive") == F.col("profile.primitive")).join(runtimes(spark))
    return rows.where(answers.compatible()).select("name", "profile_id", "primitive", "options")


def asked(spark, sf_dir) -> DataFrame:
    """Decisions with the profile their workload asks for, if it is not an unknown one, under the runtime ``model`` for choices and
    one that says nothing for the rest."""
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "answer"))
    values = F.when(F.col("primitive") == "score", F.transform("ids", lambda i: F.regexp_extract(i, r"(\d+)$", 1).cast("double")))
    none, model = (F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(answers.RUNTIME, r[1:]))) for r in _RUNTIMES[:2])
    return d.select(*KEY, "workload_id", "primitive", "ids", "z", F.when(F.col("primitive") == "choice", model).otherwise(none).alias("runtime"),
                    F.col("workload_id").alias("profile_id"), F.col("answer.order_discrepancy").alias("discrepancy"), values.alias("values"))


_ASKED = f"""{O}, {_EVIDENCE}, s1 as (select z.*, f.profile_id, f.temperature as t, f.bias as b, f.policy as policy, case when f.profile_id is null then 'no_profile' when not plausible then 'no_evidence'
    when f.primitive <> z.primitive or len(ids) not between card_min and card_max or (z.primitive = 'choice' and model_id <> 'scorer-0') then 'incompatible' else 'validated' end as status
    from z left join calibration_profile f on f.profile_id = z.workload_id left join evidence e on e.profile_id = f.profile_id)"""


@query(f"""with recursive {_ASKED} select workload_id, primitive, status, count(*) as n from s1 group by all""")
def d02_profile_status(spark, sf_dir):
    out = answers.with_profile(asked(spark, sf_dir), profiles(spark, sf_dir), whole=False)
    return out.groupBy("workload_id", "primitive", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_ASKED}, s2 as (select *, status = 'validated' and (t <> 1 or b is not null) as rescale from s1),
           s3 as (select *, list_transform(range(1, len(z) + 1), lambda i: case when rescale then z[i] / t + case when len(b) = len(z) then b[i] else 0 end else z[i] end) as y from s2),
           s4 as (select *, list_transform(y, lambda x: exp(x - list_max(y))) as e from s3), s5 as (select *, list_transform(e, lambda x: x / list_sum(e)) as q from s4),
           s6 as (select *, list_reverse_sort(q) as r, q[list_position(ids, 'true')] as yes,
                    case when rescale then list_max(list_filter(ids, lambda i: q[list_position(ids, i)] = list_max(q))) else ids[list_position(q, list_max(q))] end as chosen from s5)
           select example_id, question_id, status, case when status = 'validated' then 'validated' else 'uncalibrated' end as calibration_status,
             case when status <> 'validated' or policy is null or policy.type = 'review_only' or coalesce(answer.order_discrepancy > policy.max_order_discrepancy, false) then 'review'
               when (case when policy.metric = 'margin' then r[1] - r[2] else r[1] end) >= policy.threshold then 'accept' else 'review' end as disposition,
             case primitive when 'boolean' then (yes >= 0.5)::varchar when 'choice' then chosen end as value, case when primitive = 'boolean' then round(yes, 6) end as p_true,
             case when primitive = 'score' then chosen end as level_id,
             case when primitive = 'score' then round(list_sum(list_transform(range(1, len(ids) + 1), lambda i: q[i] * cast(regexp_extract(ids[i], '([0-9]+)$', 1) as double))), 6) end as expected_value
           from s6""")
def b16_calibrated_answer(spark, sf_dir):
    out = answers.calibrated_answers(asked(spark, sf_dir), profiles(spark, sf_dir), whole=False)
    return rounded(out.select(*KEY, "status", "calibration_status", "disposition", "value", "p_true", "level_id", "expected_value"), "p_true", "expected_value")


@query()
def b17_canonical_state(spark, sf_dir):
    """NFC and sorted JSON have no SQL; tests compare with the standard library."""
    rows = table(spark, sf_dir, "suite").select("example_id", tx.canonical_state("state").alias("state"))
    return rows.select("example_id", F.sha2("state", 256).alias("sha256")).distinct()


@query("""select distinct example_id, substring(sha256(workload_id || ':' || example_id), 1, 24) as stable_id from suite""")
def b24_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "suite").select("example_id", tx.stable_id(F.concat_ws(":", "workload_id", "example_id")).alias("stable_id")).distinct()


@query("""with h as (select distinct example_id, substring(sha256('seed' || chr(0) || example_id), 1, 16) as x from suite),
          b as (select example_id, cast(cast('0x' || x as ubigint) % 100 as integer) as bucket from h)
          select example_id, bucket, case when bucket < 60 then 'train' when bucket < 75 then 'development' when bucket < 85 then 'calibration' else 'locked_test' end as split from b""")
def b26_split_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id").distinct().withColumn("bucket", tx.bucket("seed", F.col("example_id")))
    return rows.withColumn("split", tx.split_of(F.col("bucket")))


@query(f"""with {D} select case when reference in ('membership', 'invoicing', 'repayment', 'shipping') then reference else 'other' end as label, count(*) as n
           from d where primitive = 'choice' and reference is not null group by 1""")
def b27_label_remap(spark, sf_dir):
    d = decisions(spark, sf_dir, "primitive", "reference").where("primitive = 'choice' and reference is not null")
    label = F.when(F.col("reference").isin("membership", "invoicing", "repayment", "shipping"), F.col("reference")).otherwise("other")
    return d.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {O} select count(*) as n, count(*) filter (abs(list_sum(p) - 1) > 1e-5) as bad_sum,
             count(*) filter (answer.probabilities[prediction] is null) as unknown_prediction,
             count(*) filter (answer.probabilities[prediction] < list_max(p) - 1e-8) as not_greatest,
             count(*) filter (reference is not null and not list_contains(ids, reference)) as unknown_reference from o""")
def b30_invariants(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "reference", "prediction", "answer"))
    chosen = F.col("answer.probabilities")[F.col("prediction")]
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(ds.total(F.col("p")) - 1) > 1e-5).alias("bad_sum"), F.count_if(chosen.isNull()).alias("unknown_prediction"),
        F.count_if(chosen < F.array_max("p") - 1e-8).alias("not_greatest"), F.count_if(F.col("reference").isNotNull() & ~F.array_contains("ids", F.col("reference"))).alias("unknown_reference"),
    )


@query("""with r as (select distinct example_id, workload_id, template_id from suite)
          select workload_id, count(*) as rows, count(distinct template_id) as templates, count(*) >= 50 as enough from r group by 1""")
def b31_workload_conformance(spark, sf_dir):
    rows = examples(spark, sf_dir, "workload_id", "template_id").distinct()
    out = rows.groupBy("workload_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("template_id").alias("templates"))
    return out.withColumn("enough", F.col("rows") >= 50)


# ---- duplicates, components, splits ---------------------------------------------------------------------------------

_PLAIN = "trim(regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


@query(f"""select sha256(k) as digest, min(doc_id) as first_id, count(*) as copies from (select doc_id, {_PLAIN} as k from documents where text is not null) group by k having count(*) > 1""")
def c01_exact_dups(spark, sf_dir):
    rows = dedup.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", tx.plain(F.col("text")))
    return rows.select(F.sha2("key", 256).alias("digest"), "first_id", "copies")


@query()
def c01_exact_dup_keys(spark, sf_dir):
    """Exact duplicates by the key of B22; texts without words are none."""
    key = F.sha2(F.nullif(tx.duplicate_key("text"), F.lit("")), 256)
    rows = dedup.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", key)
    return rows.withColumnRenamed("key", "digest")


def _words(c: str):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


@query("""with w as (select min(doc_id) as id, w from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null) group by w),
          g as (select distinct id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from w where len(w) >= 5),
          n as (select id, count(*) as n from g group by 1),
          rare as (select s from g group by s having count(*) between 2 and 1000000),
          o as (select x.id as a, y.id as b, count(*) as o from g x join rare using (s) join g y using (s) where x.id < y.id group by all),
          j as (select a, b, o::double / (m.n + k.n - o) as similarity from o join n m on m.id = a join n k on k.id = b)
          select a, b, round(similarity, 6) as similarity from j where similarity >= 0.9""")
def c03_near_dup_pairs(spark, sf_dir):
    """Words are runs of ASCII letters and digits here, so that both engines split alike."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rounded(dedup.similar_pairs(rows, "doc_id", _words("text")), "similarity")


@query()
def c03_near_dup_documents(spark, sf_dir):
    """Every document with the class of its text and the number of its copies and near duplicates; words by B22."""
    members, _ = dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", tx.duplicate_key("text"))
    return members


@query()
def c03_near_dup_class_pairs(spark, sf_dir):
    """The pairs of classes to ``c03_near_dup_documents``."""
    _, pairs = dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", tx.duplicate_key("text"))
    return rounded(pairs, "similarity")


_COMPONENTS = """recursive n as (select distinct example_id, 'source:' || source_group_id as s,
               'cluster:' || nullif(nullif(near_duplicate_cluster_id, ''), 'unclustered') as c from suite),
  e as (select distinct s as a, c as b from n where s is not null and c is not null union select distinct c, s from n where s is not null and c is not null),
  reach(node, root) as (select coalesce(s, c), coalesce(s, c) from n where coalesce(s, c) is not null union select c, c from n where c is not null
      union select e.b, r.root from reach r join e on e.a = r.node where r.root < e.b),
  comp as (select node, min(root) as component from reach group by 1),
  m as (select example_id, min(coalesce(component, 'example:' || example_id)) as component from n left join comp on node = coalesce(s, c) group by 1)"""


@query(f"""with {_COMPONENTS} select example_id, component from m""")
def c05_components(spark, sf_dir):
    return dedup.source_components(table(spark, sf_dir, "suite"))


@query(f"""with {_COMPONENTS}, p as (select distinct example_id, public_source.upstream_split as u, evaluation_split as e from suite),
           bad as (select component, count(distinct coalesce(u, '~') || '|' || coalesce(e, '~')) > 1 as quarantined from p join m using (example_id) group by 1)
           select quarantined, count(*) as examples, count(distinct component) as components from m join bad using (component) group by 1""")
def c06_quarantine(spark, sf_dir):
    rows = table(spark, sf_dir, "suite")
    out = dedup.boundary_conflicts(rows, dedup.source_components(rows))
    return out.groupBy("quarantined").agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("component").alias("components"))


@query(f"""with {_COMPONENTS}, r as (select distinct example_id, evaluation_split as e, task_template_holdout as h, case when public_source is not null then coalesce(public_source.upstream_split, '') end as u from suite),
           g as (select component, count(distinct coalesce(e, '')) as k, count(distinct u) as us, max(e) as x, min(h) as h0, max(h) as h1 from r join m using (example_id) group by 1),
           f as (select component, coalesce(k > 1 or us > 1 or h0 <> h1 or (x is not null and h1 and x <> 'task_holdout'), false) as conflict, x, h1,
                 cast(cast('0x' || substring(sha256('seed' || chr(0) || component), 1, 16) as ubigint) % 100 as integer) as b from g)
           select example_id, component, conflict, case when conflict then null when x is not null then x when h1 then 'task_holdout'
             when b < 60 then 'train' when b < 75 then 'development' when b < 85 then 'calibration' else 'locked_test' end as split from m join f using (component)""")
def c07_split_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "suite")
    return dedup.assign_splits(rows, dedup.source_components(rows), "seed")


@query("""select source_group_id, near_duplicate_cluster_id, count(distinct evaluation_split) as splits from suite
          where source_group_id is not null and near_duplicate_cluster_id is not null and evaluation_split is not null group by 1, 2 having count(distinct evaluation_split) > 1""")
def c08_leakage(spark, sf_dir):
    return dedup.leaking_pairs(table(spark, sf_dir, "suite"))


@query("""with r as (select example_id, min(evaluation_split) as split, max(cardinality(request.questions)) as q from suite group by 1)
          select split, count(*) as examples, cast(sum(q) as bigint) as decisions from r group by 1""")
def c09_split_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").groupBy("example_id").agg(F.min("evaluation_split").alias("split"), F.max(F.size("request.questions")).alias("q"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.sum("q").alias("decisions"))


@query(f"""with {D}, r as (select *, row_number() over (partition by workload_id order by example_id, question_id) as i, count(*) over (partition by workload_id) as n from d)
           select workload_id, string_agg(example_id || ':' || question_id, ',' order by i) as head from r where n >= 5 and i <= 5 group by 1""")
def c11_fixture_heads(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id")
    enough = d.groupBy("workload_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("workload_id")
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("workload_id").orderBy(*KEY))).where("i <= 5")  # five rows a task
    item = F.struct("i", F.concat_ws(":", *KEY).alias("k"))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["k"]), ",").alias("head")
    return d.join(enough, "workload_id", "left_semi").groupBy("workload_id").agg(head)


# ---- joins ----------------------------------------------------------------------------------------------------------

_TWO = f"""{D}, a as (select example_id, question_id, prediction from d where prediction <> 'rest'),
  b as (select example_id, question_id, case when answer.p_true >= 0.3 then 'true' else prediction end as prediction from d where inference_ms >= 0),
  f as (select a.prediction as pa, b.prediction as pb, a.example_id as xa, b.example_id as xb from a full outer join b on a.example_id = b.example_id and a.question_id = b.question_id)"""


def two_arms(spark, sf_dir):
    d = decisions(spark, sf_dir, "prediction", "answer", "inference_ms")
    a = d.where("prediction <> 'rest'").select(*KEY, "prediction")
    b = d.where("inference_ms >= 0").select(*KEY, F.when(F.col("answer.p_true") >= 0.3, "true").otherwise(F.col("prediction")).alias("prediction"))
    return compare.paired(a, b)


@query(f"""with {_TWO} select case when xa is null then 'b' when xb is null then 'a' else 'both' end as side, count(*) as n, count(*) filter (pa <> pb) as disagree from f group by 1""")
def d01_paired_join(spark, sf_dir):
    rows = two_arms(spark, sf_dir)
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction_a") != F.col("prediction_b")).alias("disagree"))


@query(f"""with {_JOINED} select profile_id, count(*) as decisions from j group by 1""")
def d02_profile_join(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("profile_id").agg(F.count(F.lit(1)).alias("decisions"))


@query("""with k as (select distinct example_id, evaluation_split as split, trim(regexp_replace(lower(state), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) as k from suite where state is not null and evaluation_split is not null)
          select split, count(*) as examples, count(*) filter (k in (select k from k where split = 'train')) as excluded from k where split <> 'train' group by 1""")
def d04_overlap_antijoin(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").where("state is not null and evaluation_split is not null")
    rows = rows.select("example_id", F.col("evaluation_split").alias("split"), F.sha2(tx.plain(F.col("state")), 256).alias("k")).distinct()
    held, train = rows.where("split <> 'train'"), rows.where("split = 'train'").select("k").distinct()
    kept = held.join(train, "k", "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("kept"))
    out = held.groupBy("split").agg(F.count(F.lit(1)).alias("examples")).join(kept, "split", "left")
    return out.select("split", "examples", (F.col("examples") - F.coalesce("kept", F.lit(0))).alias("excluded"))


@query("""with q as (select distinct example_id, workload_id, unnest(map_keys(request.questions)) as question_id from suite),
          r as (select * from q anti join direct_development using (example_id, question_id)) select workload_id, count(*) as missing from r group by 1""")
def d05_resume_missing(spark, sf_dir):
    todo = table(spark, sf_dir, "suite").select("example_id", "workload_id", F.explode(F.map_keys("request.questions")).alias("question_id")).distinct()
    left = monitor.resume(todo, table(spark, sf_dir, "direct_development").select(*KEY), KEY)
    return left.groupBy("workload_id").agg(F.count(F.lit(1)).alias("missing"))


@query(f"""with {D}, x as (select distinct example_id from suite) select workload_id, count(*) as known from d semi join x using (example_id) group by 1""")
def d07_known_examples(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id").join(table(spark, sf_dir, "suite").select("example_id"), "example_id", "left_semi")
    return d.groupBy("workload_id").agg(F.count(F.lit(1)).alias("known"))


_SHADOW = """l as (select * from shadow_log qualify row_number() over (partition by request_id order by received_at) = 1),
  x as (select request_id, artifact_id, profile_id, unnest(map_entries(decisions)) as e from l),
  t as (select request_id, question_id, max(label) as label from shadow_labels where label is not null group by all),
  r as (select x.*, e.key as question_id, t.label, lower(e.value.value) = lower(t.label) as agrees from x left join t on t.request_id = x.request_id and t.question_id = e.key)"""


def shadow(spark, sf_dir):
    return monitor.shadow_truth(monitor.shadow_decisions(table(spark, sf_dir, "shadow_log")), table(spark, sf_dir, "shadow_labels"))


@query(f"""with {_SHADOW} select request_id, question_id, label, case when agrees then 'yes' when not agrees then 'no' else 'unlabelled' end as agrees from r""")
def d08_shadow_truth(spark, sf_dir):
    agrees = F.when(F.col("agrees"), "yes").when(~F.col("agrees"), "no").otherwise("unlabelled")
    return shadow(spark, sf_dir).select("request_id", "question_id", "label", agrees.alias("agrees"))


# ---- aggregates -----------------------------------------------------------------------------------------------------

_LABELS = f"""{D}, v as (select {G}, reference as label, cast(reference = prediction as int) as tp, 0 as predicted, 1 as support from d where reference is not null
    union all select {G}, prediction, 0, 1, 0 from d where reference is not null),
  c as (select {G}, label, cast(sum(tp) as bigint) as tp, cast(sum(predicted) as bigint) as predicted, cast(sum(support) as bigint) as support from v group by all),
  f as (select *, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2.0::double * tp / nullif(predicted + support, 0), 0) as f1 from c)"""


@query(f"""with {_LABELS} select {G}, cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(avg(recall), 6) as balanced_accuracy from f group by all""")
def e02_classification(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction")
    return rounded(metrics.classification(d), "accuracy", "macro_f1", "balanced_accuracy")


@query(f"""with {_LABELS} select {G}, label, tp, predicted, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f""")
def e04_per_label(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction")
    return rounded(metrics.per_label(d), "precision", "recall", "f1")


@query(f"""with {_LABELS} select {G}, round(max(support) / sum(support), 6) as majority, round(sum(tp) / sum(support), 6) as accuracy,
             round(sum(tp) / sum(support) - max(support) / sum(support), 6) + 0 as margin from f group by all""")
def e05_majority(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction")
    return rounded(metrics.majority(d), "majority", "accuracy", "margin")


_V = "list_transform(ids, lambda i: cast(regexp_extract(i, '([0-9]+)$', 1) as double))"
_REF = "cast(regexp_extract(reference, '([0-9]+)$', 1) as double)"


@query(f"""with {O}, v as (select *, {_V} as v from o where primitive = 'score' and reference is not null),
           y as (select {G}, abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * v[i])) - {_REF}) / (list_max(v) - list_min(v)) as e from v where list_max(v) > list_min(v))
           select {G}, count(*) as n, round(avg(e), 6) as nmae from y group by all""")
def e06_nmae(spark, sf_dir):
    return rounded(metrics.normalised_error(decisions(spark, sf_dir, "workload_id", "primitive", "reference", "answer")), "nmae")


@query(f"""with {D}, v as (select workload_id, primitive, {_REF} as i, cast(regexp_extract(prediction, '([0-9]+)$', 1) as double) as j from d where primitive = 'score' and reference is not null),
           a as (select {G}, i, count(*) as n from v group by all), b as (select {G}, j, count(*) as n from v group by all),
           o as (select {G}, count(*) as n, avg((i - j) * (i - j)) as observed from v group by all),
           x as (select a.workload_id, a.primitive, sum(a.n::double * b.n * (i - j) * (i - j)) as e from a join b using ({G}) group by all)
           select {G}, n, round(case when e < 1e-12 then case when observed < 1e-12 then 1.0 else 0.0 end else 1 - observed / (e / (n::double * n)) end, 6) + 0 as kappa from o join x using ({G})""")
def e07_qwk(spark, sf_dir):
    return rounded(metrics.weighted_kappa(decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction")), "kappa")


@query(f"""with {S}, k as (select {G}, reference, count(*) as k from s group by all),
           v as (select {G}, 1 - sum(k::double * k) / (sum(k) * sum(k)) as prevalence_brier from k group by all),
           m as (select {G}, count(*) as n, avg(-ln(greatest(p[target], 1e-15::double))) as nll, avg(list_sum(list_transform(p, lambda x: x * x)) - 2 * p[target] + 1) as brier from s group by all)
           select {G}, n, round(nll, 6) as nll, round(brier, 6) as brier, round(prevalence_brier, 6) as prevalence_brier from m join v using ({G})""")
def e09_nll_brier(spark, sf_dir):
    return rounded(metrics.proper_scores(scored(spark, sf_dir)), "nll", "brier", "prevalence_brier")


_COUNT_BINS = f"""{S}, b as (select {G}, confidence, hit, cast(floor((row_number() over (partition by {G} order by confidence, example_id, question_id) - 1) / ceil(count(*) over (partition by {G}) / 10.0::double)) as bigint) as bin from s),
  c as (select {G}, bin, count(*) as n, avg(confidence) as mc, avg(hit) as acc, min(confidence) as lo, max(confidence) as hi from b group by all)"""


@query(f"""with {_COUNT_BINS} select {G}, count(*) as bins, round(sum(n * abs(mc - acc)) / sum(n), 6) as ece from c group by all""")
def e11_ece_equal_count(spark, sf_dir):
    return rounded(metrics.calibration_error(scored(spark, sf_dir)), "ece")


@query(f"""with {S}, b as (select {G}, confidence, hit, least(floor(confidence * 10), 9) as bin from s),
           c as (select {G}, bin, count(*) as n, avg(confidence) as mc, avg(hit) as acc from b group by all)
           select {G}, count(*) as bins, round(sum(n * abs(mc - acc)) / sum(n), 6) as ece from c group by all""")
def e12_ece_equal_width(spark, sf_dir):
    return rounded(metrics.calibration_error(scored(spark, sf_dir), equal_count=False), "ece")


@query(f"""with {_COUNT_BINS} select {G}, bin, n, round(mc, 6) as mean_confidence, round(acc, 6) as accuracy, round(lo, 6) as least, round(hi, 6) as greatest, round(abs(mc - acc), 6) as difference from c""")
def e13_reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability_bins(scored(spark, sf_dir)), "mean_confidence", "accuracy", "least", "greatest", "difference")


@query(f"""with recursive r as (select profile_id, metrics.errors_in_accepted as errors, metrics.accepted_count as accepted from calibration_profile),
           {_bound("r", "profile_id")} select profile_id, errors, accepted, round(bound, 6) as bound from r join bound using (profile_id)""")
def e14_binomial_bound(spark, sf_dir):
    rows = profiles(spark, sf_dir).select("profile_id", F.col("metrics.errors_in_accepted").alias("errors"), F.col("metrics.accepted_count").alias("accepted"))
    return rounded(rows.withColumn("bound", error_bound("errors", "accepted")), "bound")


@query(f"""with {S}, a as (select {G}, count(*) as n, count(*) filter (confidence >= 0.85) as accepted, count(*) filter (confidence >= 0.85 and hit = 0) as errors from s group by all)
           select {G}, n, accepted, errors, round(coalesce(accepted / n, 0), 6) as coverage, round(coalesce(errors / nullif(accepted, 0), 0), 6) as error_rate from a""")
def e15_selective(spark, sf_dir):
    return rounded(selective.at_threshold(scored(spark, sf_dir), 0.85).drop("bound"), "coverage", "error_rate")


_DISPOSED = f"""{D}, a as (select {G}, count(*) as n, count(*) filter (answer.disposition = 'accept') as accepted,
  count(*) filter (answer.disposition = 'accept' and lower(reference) <> lower(prediction)) as errors from d where reference is not null group by all)"""


@query(f"""with {_DISPOSED} select {G}, n, accepted, errors, round(accepted / n, 6) as coverage, round(coalesce(errors / nullif(accepted, 0), 0), 6) as error_rate, accepted >= 59 as enough from a""")
def e16_disposition_selective(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer")
    return rounded(selective.by_disposition(d).drop("bound", "gate_passed"), "coverage", "error_rate")


_SWEEP = f"""{S}, c as (select distinct {G}, floor(confidence * 10000 + 0.5) / 10000 as t from s union select distinct {G}, unnest([0.5::double, 0.7, 0.8, 0.85, 0.9, 0.95]) from s),
  w as (select c.workload_id, c.primitive, t, count(*) as n, count(*) filter (confidence >= t) as accepted, count(*) filter (confidence >= t and hit = 0) as errors from c join s using ({G}) group by all)"""


@query(f"""with {_SWEEP} select {G}, round(t, 6) as threshold, n, accepted, errors from w""")
def e17_threshold_sweep(spark, sf_dir):
    return rounded(selective.sweep(scored(spark, sf_dir)), "threshold")


@query(f"""with {_SWEEP}, r as (select *, errors / nullif(accepted, 0) as er, accepted / n as cov from w)
           select {G}, round(coalesce(min(t) filter (coalesce(er, 0) <= 0.05 and cov >= 0.5), arg_max(t, struct_pack(c := cov, m := -t)) filter (er <= 0.05), 0.9), 6) as threshold from r group by all""")
def e17_fitted_threshold(spark, sf_dir):
    return rounded(selective.fitted_threshold(scored(spark, sf_dir)), "threshold")


@query(f"""with recursive {_SWEEP}, k as (select * from w where accepted >= 59 and accepted / n >= 0.5 and errors / accepted <= 0.05),
           {_bound("k", G + ", t")}, b as (select {G}, min(t) as t from bound where bound <= 0.05 group by all),
           g as (select distinct {G} from s)
           select {G}, case when t is null then 'review_only' else 'threshold' end as policy, round(t, 6) as threshold, coalesce(accepted, 0) as accepted,
             round(coalesce(accepted / n, 0), 6) as coverage, round(coalesce(bound, 1), 6) as bound
           from g left join b using ({G}) left join w using ({G}, t) left join bound using ({G}, t)""")
def e18_certified_threshold(spark, sf_dir):
    return rounded(selective.certified_threshold(scored(spark, sf_dir)), "threshold", "coverage", "bound")


@query("""with r as (select distinct example_id, annotation_status, unnest(map_values(request.questions)).type as primitive, unnest(map_keys(request.questions)) as q from suite)
          select annotation_status, primitive, count(*) as decisions from r group by all""")
def e19_readiness(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id", "annotation_status", F.explode("request.questions").alias("q", "x"))
    rows = rows.select("example_id", "annotation_status", "q", F.col("x.type").alias("primitive")).distinct()
    return rows.groupBy("annotation_status", "primitive").agg(F.count(F.lit(1)).alias("decisions"))


@query("""with r as (select distinct example_id, workload_id, evaluation_split as split, source_group_id, unnest(map_entries(reference_answers)) as a from suite)
          select workload_id, split, a.value as label, count(*) as n, count(distinct source_group_id) as sources from r group by all""")
def e20_split_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "suite").select("example_id", "workload_id", F.col("evaluation_split").alias("split"), "source_group_id", F.explode("reference_answers").alias("q", "label")).distinct()
    return rows.groupBy("workload_id", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_group_id").alias("sources"))


@query(f"""with {D}, x as (select {G}, request_total_ms as x from d where request_total_ms >= 0 and not isnan(request_total_ms) and request_total_ms < 'infinity'::double),
           r as (select *, row_number() over (partition by {G} order by x) - 1 as i, count(*) over (partition by {G}) as n from x)
           select {G}, n, round(avg(x) filter (i = floor((n - 1) / 2.0) or i = floor(n / 2.0)), 6) as median, round(max(x) filter (i = floor(0.95::double * (n - 1))), 6) as p95 from r group by all""")
def e21_latency(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "request_total_ms")
    return rounded(metrics.latency(d, "request_total_ms"), "median", "p95")


@query(f"""with {D}, x as (select {G}, inference_ms as a, request_total_ms as b from d where inference_ms >= 0 and request_total_ms >= 0 and not isnan(inference_ms) and not isnan(request_total_ms) and request_total_ms < 'infinity'::double and inference_ms < 'infinity'::double)
           select {G}, round(case when median(a) = 0 then 'infinity'::double else median(b) / median(a) end, 6) as speedup,
             coalesce(median(b) / nullif(median(a), 0), 'infinity'::double) >= 2 and list_sort(list(a))[1 + cast(floor(0.95::double * (count(*) - 1)) as bigint)] <= 2000 as gate_passed from x group by all""")
def e22_speedup(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "inference_ms", "request_total_ms")
    d = d.where("inference_ms >= 0 and inference_ms < double('infinity') and request_total_ms >= 0 and request_total_ms < double('infinity')")
    a, b = metrics.latency(d, "inference_ms"), metrics.latency(d, "request_total_ms")
    return rounded(compare.speed_gate(a, b, ["workload_id", "primitive"]), "speedup")


_EQ = f"""{_ARMS}, eq as (select workload_id, list_position(p1, list_max(p1)) = list_position(p2, list_max(p2)) as agrees,
    list_max(list_transform(range(1, len(p1) + 1), lambda i: abs(p1[i] - p2[i]))) as dev, (list_max(p1) >= 0.9) <> (list_max(p2) >= 0.9) as flip,
    list_reverse_sort(z)[1] - list_reverse_sort(z)[2] <= 2.8 as tie from q)"""


@query(f"""with {_EQ} select workload_id, count(*) as compared, count(*) filter (agrees) as agreements, round(max(dev), 6) as deviation, count(*) filter (flip) as flips,
             count(*) filter (tie) as tie_band, 0 as only_a, 0 as only_b, 0 as labels_differ, count(*) = count(*) filter (agrees) and max(dev) <= 0.01 and count(*) filter (flip) = 0 as gate_passed from eq group by rollup (workload_id)""")
def e25_equivalence_rollup(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "answer")).select(*KEY, "workload_id", "ids", "z")
    rows = compare.equivalence_rows(compare.paired(d, second_arm(d))).withColumnRenamed("workload_id_a", "workload_id")
    return rounded(compare.equivalence_summary(rows, "workload_id"), "deviation")


def diverging(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two arms that do not hold the same: of the second, decisions predicted ``false`` are missing, those predicted ``true``
    have another first option, and every decision of a score stands under a new question too."""
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "prediction", "answer"))
    b = second_arm(d).where("coalesce(prediction, '') <> 'false'")
    renamed = F.concat(F.array(F.concat(F.lit("new-"), F.col("ids")[0])), F.slice("ids", 2, 1000))
    b = b.withColumn("ids", F.when(F.col("prediction") == "true", renamed).otherwise(F.col("ids")))
    more = b.where("primitive = 'score'").withColumn("question_id", F.concat("question_id", F.lit("-new")))
    cols = [*KEY, "workload_id", "ids", "z"]
    return d.select(*cols), b.select(*cols).unionByName(more.select(*cols))


@query(f"""with {_ARMS}, r as (
             select example_id, question_id, workload_id, case when prediction = 'false' then 'only_a' when prediction = 'true' then 'labels_differ' else 'compared' end as status,
               list_position(p1, list_max(p1)) = list_position(p2, list_max(p2)) as agrees, list_max(list_transform(range(1, len(p1) + 1), lambda i: abs(p1[i] - p2[i]))) as dev,
               (list_max(p1) >= 0.9) <> (list_max(p2) >= 0.9) as flip, list_reverse_sort(z)[1] - list_reverse_sort(z)[2] <= 2.8 as tie from q
             union all select example_id, question_id || '-new', workload_id, 'only_b', null, null, null, null from q where primitive = 'score' and coalesce(prediction, '') <> 'false')
           select workload_id, count(*) filter (status = 'compared') as compared, count(*) filter (status = 'compared' and agrees) as agreements,
             round(max(dev) filter (status = 'compared'), 6) as deviation, count(*) filter (status = 'compared' and flip) as flips, count(*) filter (status = 'compared' and tie) as tie_band,
             count(*) filter (status = 'only_a') as only_a, count(*) filter (status = 'only_b') as only_b, count(*) filter (status = 'labels_differ') as labels_differ,
             count(*) filter (status <> 'compared') = 0 and bool_and(agrees) and max(dev) <= 0.01 and not bool_or(flip) as gate_passed from r group by rollup (workload_id)""")
def e25_equivalence_divergent(spark, sf_dir):
    """Arms of which one lacks decisions, has others, and has other options: counted, and the gate fails."""
    rows = compare.equivalence_rows(compare.paired(*diverging(spark, sf_dir))).withColumnRenamed("workload_id_a", "workload_id")
    return rounded(compare.equivalence_summary(rows, "workload_id"), "deviation")


@query(f"""with {O}, x as (select workload_id, prediction, unnest(ids) as i, unnest(p) as v, unnest(range(0, len(ids))) as position from o where primitive = 'choice')
           select workload_id, cast(position as integer) as position, count(*) as shown, round(avg(v), 6) as mean_p, round(avg((i = prediction)::int), 6) as share from x group by all""")
def e26_order_bias(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "prediction", "answer").where("primitive = 'choice'"))
    return rounded(compare.order_bias(d, ["workload_id"]), "mean_p", "share")


@query(f"""with {O}, x as (select workload_id, prediction, unnest(ids) as i, unnest(range(0, len(ids))) as position from o where primitive = 'choice'),
           g as (select workload_id, position, avg((i = prediction)::int) as share from x group by all),
           s as (select *, max(position) over (partition by workload_id) as last from g)
           select workload_id, round(max(share) filter (position = last), 6) as last_share, round(max(share) filter (position < last), 6) as other_share,
             coalesce(max(share) filter (position = last) - max(share) filter (position < last) >= 0.1 - 1e-12, false) as position_bias from s group by 1""")
def e27_bias_finding(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "prediction", "answer").where("primitive = 'choice'"))
    return rounded(compare.bias_finding(compare.order_bias(d, ["workload_id"]), ["workload_id"]), "last_share", "other_share")


@query(f"""with {D}, r as (select answer.calibration_status as mode, primitive, (reference = prediction)::int as hit from d where reference is not null)
           select mode, primitive, count(*) as n, round(avg(hit), 6) as accuracy from r group by grouping sets ((mode), (mode, primitive))""")
def e28_grouping_sets(spark, sf_dir):
    d = decisions(spark, sf_dir, "primitive", "reference", "prediction", "answer").where("reference is not null")
    d = d.select(F.col("answer.calibration_status").alias("mode"), "primitive", (F.col("reference") == F.col("prediction")).cast("int").alias("hit"))
    out = d.groupingSets([("mode",), ("mode", "primitive")], "mode", "primitive").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
    return rounded(out.select("mode", "primitive", "n", "accuracy"), "accuracy")


@query(f"""with recursive {_DISPOSED}, {_bound("a", G)},
           t as (select a.*, bound, accepted / n as coverage, coalesce(errors / nullif(accepted, 0), 0) as error_rate, f.metrics.coverage as target from a join bound using ({G})
                 left join calibration_profile f using ({G})),
           x as (select *, case when accepted > 0 and bound > 0.05 then 'ERROR_BOUND_BREACH' when accepted > 0 and bound >= 0.05::double * 0.8 then 'ERROR_BOUND_WARNING' end as error_alert,
                 case when coverage < 0.5 then 'COVERAGE_BELOW_MINIMUM' when coverage - coalesce(target, 0.5) < -0.05 then 'COVERAGE_DROP' end as coverage_alert from t)
           select {G}, n, accepted, errors, round(coverage, 6) as coverage, round(error_rate, 6) as error_rate, round(bound, 6) as bound, error_alert, coverage_alert,
             coalesce(error_alert = 'ERROR_BOUND_BREACH', false) or coalesce(coverage_alert = 'COVERAGE_BELOW_MINIMUM', false) or (error_alert is not null and coverage_alert is not null) as recalibrate from x""")
def e29_drift(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "primitive", "reference", "prediction", "answer")
    f = profiles(spark, sf_dir).select("workload_id", "primitive", F.col("metrics.coverage").alias("target_coverage"), F.lit(None).cast("double").alias("target_bound"))
    return rounded(selective.drift(d, f), "coverage", "error_rate", "bound")


@query(f"""with {_SHADOW} select artifact_id, count(distinct request_id) as requests, count(*) as decisions, round(count(*) filter (e.value.disposition = 'accept') / count(*), 4) as coverage,
             round(count(*) filter (e.value.disposition = 'review') / count(*), 4) as review_rate, count(*) filter (e.value.calibration_status = 'validated') as validated,
             count(agrees) as labelled, round(avg(agrees::int), 4) as agreement from r group by 1""")
def e30_shadow(spark, sf_dir):
    return monitor.shadow_summary(shadow(spark, sf_dir), ["artifact_id"])


@query(f"""with {D}, a as (select *, reference = prediction as ok from d where reference is not null),
           k as (select least(count(*) filter (ok), greatest(10, count(*) filter (not ok) // 2)) as k from a),
           c as (select example_id, question_id, row_number() over (order by sha256('control' || chr(0) || example_id || chr(0) || question_id), example_id, question_id) as i from a where ok)
           select example_id, question_id, 'control' as arm from c, k where i <= k union all select example_id, question_id, 'disagree' from a where not ok""")
def e31_control_arm(spark, sf_dir):
    return monitor.control_arm(decisions(spark, sf_dir, "reference", "prediction"))


@query(f"""with {D}, b as (select *, row_number() over (partition by workload_id order by example_id, question_id) as r from d where reference <> prediction)
           select workload_id, count(*) as errors, string_agg(example_id || ':' || question_id, ',' order by example_id || ':' || question_id) filter (r <= 10) as first_ids from b group by 1""")
def e32_failure_slices(spark, sf_dir):
    return monitor.failure_slices(decisions(spark, sf_dir, "workload_id", "reference", "prediction"))


@query(f"""with {S}, x as (select {G}, reference, unnest(ids) as option, unnest(p) as v from s), n as (select {G}, count(*) as n from s group by all),
           g as (select {G}, option, ln(greatest(count(*) filter (reference = option), 1) / max(n)) - ln(greatest(avg(v), 1e-6)) as r from x join n using ({G}) group by all)
           select {G}, option, round(r - avg(r) over (partition by {G}), 6) + 0 as shift from g""")
def e33_prior_correction(spark, sf_dir):
    return rounded(calibrate.prior_correction(scored(spark, sf_dir)), "shift")


@query(f"""with {D}, r as (select coalesce(answer.disposition, 'none') as reason from d) select reason, count(*) as n from r group by 1""")
def e35_reason_counts(spark, sf_dir):
    d = decisions(spark, sf_dir, "answer").select(F.coalesce("answer.disposition", F.lit("none")).alias("reason"))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""select profile_id as path, 1 as gates, (metrics.gate_ece_passed)::int as passed from calibration_profile where metrics.gate_ece_passed is not null""")
def e36_evidence_gates(spark, sf_dir):
    """Gates found by walking the profiles as JSON documents."""
    docs = profiles(spark, sf_dir).select(F.col("profile_id").alias("path"), F.to_json(F.struct("metrics", "policy")).alias("value"))
    return report.gates(report.leaves(spark, docs))


@query("""with l as (select * from shadow_log qualify row_number() over (partition by request_id order by received_at) = 1)
          select artifact_id, count(*) as requests, cast(sum(cardinality(decisions)) as bigint) as decisions, round(sum(timing_ms.total), 3) as total_ms from l group by 1""")
def e37_usage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "shadow_log").select("request_id", "artifact_id", "decisions", "timing_ms").dropDuplicates(["request_id"])
    return rows.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.size("decisions")).cast("bigint").alias("decisions"), F.round(F.sum("timing_ms.total"), 3).alias("total_ms"))


# ---- fits, windows, sets, streams -----------------------------------------------------------------------------------


@query()
def f01_temperature(spark, sf_dir):
    """Iterative; tests check that the NLL is no lower a little to either side."""
    return rounded(calibrate.fit_temperature(scored(spark, sf_dir)), "nll")


@query()
def f02_vector_scaling(spark, sf_dir):
    return rounded(calibrate.fit_vector(scored(spark, sf_dir)), "temperature", "nll")


@query(f"""with {S}, x as (select {G}, -ln(greatest(p[target], 1e-15::double)) + 0.5 * list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * pow((i - target) / (len(p) - 1), 2))) as l from s where primitive = 'score' and len(p) > 1)
           select {G}, count(*) as n, round(avg(l), 6) as loss from x group by all""")
def f04_ordinal_loss(spark, sf_dir):
    return rounded(calibrate.ordinal_loss(scored(spark, sf_dir)), "loss")


@query(f"""with {D} select workload_id, example_id, question_id from d
           qualify row_number() over (partition by workload_id order by sha256('s' || chr(0) || example_id || chr(0) || question_id), example_id, question_id) <= ceil(count(*) over (partition by workload_id) / 20.0::double)""")
def g03_hash_sample(spark, sf_dir):
    """A sampling operator: a twentieth of each workload, by seeded hash."""
    d = decisions(spark, sf_dir, "workload_id")
    return monitor.hash_sample(d, "ceil(size / 20.0D)", ["workload_id"], KEY, "s")


@query("""with w as (select item_id, workload_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) as w from heldout_items where text is not null),
          o as (select q.item_id as query_id, p.item_id as pool_id, len(list_intersect(q.w, p.w)) as o, len(q.w) + len(p.w) as u, count(*) over (partition by q.item_id) as n from w q join w p using (workload_id)),
          s as (select *, case when o = 0 then 0 else o / (u - o) end as s from o),
          r as (select *, row_number() over (partition by query_id order by case when n <= 4 then 0 else -s end, pool_id) as k from s qualify k <= 4)
          select query_id, pool_id, cast(row_number() over (partition by query_id order by k) as integer) as rank, round(s, 6) as similarity from r where query_id <> pool_id qualify rank <= 3""")
def g04_exemplar_topk(spark, sf_dir):
    items = table(spark, sf_dir, "heldout_items").where("text is not null")
    q, p = items.select(F.col("item_id").alias("query_id"), "workload_id", "text"), items.select(F.col("item_id").alias("pool_id"), "workload_id", "text")
    out = monitor.top_k_similar(q, p, "workload_id", 4).where("query_id <> pool_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return rounded(out.withColumn("rank", rank).where("rank <= 3"), "similarity")


@query(f"""with {O} select {G}, count(*) as n, round(min(m), 6) as least, round(avg(m), 6) as mean, count(*) filter (m <= 2.8) as tie_band from (
             select {G}, list_reverse_sort(z)[1] - list_reverse_sort(z)[2] as m from z) group by all""")
def g05_margin(spark, sf_dir):
    d = ds.with_options(decisions(spark, sf_dir, "workload_id", "primitive", "answer")).withColumn("m", ds.margin(F.col("z")))
    out = d.groupBy("workload_id", "primitive").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least"), F.avg("m").alias("mean"), F.count_if(F.col("m") <= 2.8).alias("tie_band"))
    return rounded(out, "least", "mean")


@query(f"""with {D}, u as (select workload_id, reference as label from d where reference is not null union select workload_id, prediction from d) select workload_id, count(*) as labels from u group by 1""")
def h01_label_union(spark, sf_dir):
    d = decisions(spark, sf_dir, "workload_id", "reference", "prediction")
    u = d.where("reference is not null").select("workload_id", F.col("reference").alias("label")).unionByName(d.select("workload_id", F.col("prediction").alias("label"))).distinct()
    return u.groupBy("workload_id").agg(F.count(F.lit(1)).alias("labels"))


@query(f"""with {_TWO} select count(*) filter (xb is null) as only_a, count(*) filter (xa is null) as only_b from f""")
def h02_key_set_difference(spark, sf_dir):
    rows = two_arms(spark, sf_dir)
    return rows.agg(F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"))


@query("""with l as (select * from shadow_log qualify row_number() over (partition by request_id order by received_at) = 1),
          x as (select profile_id, strftime(cast(cast(logged_at as timestamptz) at time zone 'UTC' as date), '%Y-%m-%d') as day, unnest(map_values(decisions)) as v from l)
          select profile_id, day, count(*) as decisions, count(*) filter (v.disposition = 'accept') as accepted from x group by all""")
def j01_daily_shadow(spark, sf_dir):
    """The batch form of the streaming window count; the stream itself is tested against it."""
    rows = monitor.shadow_decisions(table(spark, sf_dir, "shadow_log"))
    rows = rows.groupBy("profile_id", F.date_format("at", "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("decision.disposition") == "accept").alias("accepted"))
