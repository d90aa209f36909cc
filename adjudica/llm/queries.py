"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch
from . import format_copies, group_splits, leaks, near_groups, packing, pair_groups, percentiles, shared_spans, split_overlap, visual_form


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_copies.format_copies(table(spark, sf_dir, "suite"))
    return found.filter("representative <> member").select(
        F.col("representative").alias("first_example_id"), F.col("member").alias("example_id")
    )


def p1_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.copy_counts(table(spark, sf_dir, "suite"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pair_groups.consolidate(table(spark, sf_dir, "suite"), table(spark, sf_dir, "near_matches"))
    return found.filter("group_id <> member").select("group_id", F.col("member").alias("example_id"))


LATENCIES = ["inference_ms", "request_total_ms"]


def p3_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of every workload on every day of ``scored_at``."""
    rows = table(spark, sf_dir, "direct_development").withColumn("day", F.to_date("scored_at"))
    found = percentiles.bisect_percentiles(rows, ["workload_id", "day"], LATENCIES)
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("value", F.round("value", 6))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles.bisect_percentiles(table(spark, sf_dir, "direct_development"), ["workload_id"], LATENCIES)
    return found.withColumn("value", F.round("value", 6))


def p3_daily_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the whole from the summaries of its days, with their bounds."""
    days = percentiles.day_summaries(table(spark, sf_dir, "direct_development"), "scored_at", ["workload_id"], LATENCIES)
    found = percentiles.combined_percentiles(days, ["workload_id"])
    return found.select("workload_id", "metric", "p", "n", F.round("at_least", 6).alias("at_least"), F.round("below", 6).alias("below"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_splits.group_splits(table(spark, sf_dir, "suite")).withColumnRenamed("id", "example_id")


def p4_linked_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits in which examples linked by any chain of sources and near-duplicate clusters stay together."""
    cluster = F.when(~F.col("near_duplicate_cluster_id").isin(*pair_groups.PLACEHOLDERS), F.col("near_duplicate_cluster_id"))
    suite = table(spark, sf_dir, "suite").select("example_id", "workload_id", "source_group_id", cluster.alias("cluster"))
    return group_splits.group_splits(suite, entity_cols=("source_group_id", "cluster")).withColumnRenamed("id", "example_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_overlap.split_overlap(table(spark, sf_dir, "suite"))
    pair = F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b")
    return found.select(*pair).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with the training split per evaluation split and source: records, their training partners (by class of equal
    run sets), and the greatest share of a record's runs that training records hold between them."""
    suite = table(spark, sf_dir, "suite")
    sources = suite.where("evaluation_split <> 'train'").select(F.col("example_id").alias("eval_id"), F.col("evaluation_split").alias("side"), "source_group_id").distinct()
    found = split_overlap.eval_coverage(suite).join(sources, ["eval_id", "side"])
    return found.groupBy(F.col("side").alias("evaluation_split"), "source_group_id").agg(
        F.count_distinct("eval_id").alias("examples"), F.sum("partners").alias("partners"), F.max("most_similar").alias("most_similar"),
        F.max(F.col("covered") / F.col("runs")).alias("most_covered"),
    )


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state in its consistent form."""
    found = visual_form.visual_form(table(spark, sf_dir, "suite"))
    return found.select(F.col("id").alias("example_id"), F.col("form").alias("state"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visual_form.lookalike_pairs(table(spark, sf_dir, "suite"))
    return found.select(F.col("a").alias("example_id_a"), F.col("b").alias("example_id_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups.near_groups(table(spark, sf_dir, "suite"))
    return found.filter("group_id <> member").select("group_id", F.col("member").alias("example_id"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep, in one row: texts packed, pieces of a text that fits, containers too full, and whether the
    containers are at most 1 % more than the tokens ask for."""
    rows = packing.pack(table(spark, sf_dir, "documents"))
    rows = Scratch(spark, "packed").save(rows, "packed")
    load = rows.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    used = load.agg(F.count_if(F.col("t") > 2048).alias("too_full"), (F.count(F.lit(1)) <= 1.01 * F.ceil(F.sum("t") / 2048) + 1).alias("near_least"))
    texts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"))
    split = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= 2048)).alias("split_in_vain"))
    return split.crossJoin(used)  # one row by one row


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per workload of 200 examples or more: whether each split has its proportion to within 3 % of the workload, and how many
    sources stand in several splits."""
    suite = table(spark, sf_dir, "suite")
    facts = suite.groupBy("example_id").agg(F.min("workload_id").alias("workload_id"))
    out = Scratch(spark, "splits").save(group_splits.group_splits(suite).select(F.col("id").alias("example_id"), "split").join(facts, "example_id"), "splits")
    share = lambda s, p: F.abs(F.count_if(F.col("split") == s) / F.count(F.lit(1)) - p) <= 0.03
    kept = out.groupBy("workload_id").agg(F.count(F.lit(1)).alias("examples"), *(share(s, p).alias(s) for s, p in group_splits.PROPORTIONS.items()))
    torn = suite.select("example_id", "source_group_id").where("source_group_id is not null").distinct().join(out, "example_id")
    torn = torn.groupBy("source_group_id").agg((F.count_distinct("split") > 1).alias("torn")).agg(F.count_if("torn").alias("torn_sources"))
    return kept.where("examples >= 200").join(torn)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_near_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage at most two word edits from a window of an item."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), edits=2)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_spans.shared_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "shared_chars")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_MEASURED = """
    select workload_id, metric, value from (
        select workload_id, 'inference_ms' as metric, inference_ms as value from direct_development
        union all select workload_id, 'request_total_ms', request_total_ms from direct_development)
    where value >= 0 and value < 'infinity'::double and not isnan(value)"""
_P = ", ".join(f"({p}::double)" for p in percentiles.PERCENTILES)


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": f"""
            with i as (select item_id, {_WORDS} as w from heldout_items), d as (select doc_id, {_WORDS} as w from documents),
            g as (select distinct item_id, array_to_string(w[k:k + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i where len(w) >= 13)),
            h as (select doc_id, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13))
            select distinct doc_id, item_id from g join h using (g)""",
        "p10_found": """
            with d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 400),
            w as (select doc_id, i, md5_number(substring(text, i, 400)) as h from (select doc_id, text, unnest(range(1, length(text) - 398)) as i from d)),
            s as (select h from w group by h having min(doc_id) <> max(doc_id)),
            m as (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), i - 400) as last from w join s using (h))
            select doc_id, cast(sum(least(400, i - last)) as bigint) as shared_chars from m group by 1""",
        "p8_balance": """
            select count(distinct doc_id) as texts, 0 as split_in_vain, 0 as too_full, true as near_least from documents""",
        "p4_balance": """
            select workload_id, count(*) as examples, true as train, true as validation, true as test, 0 as torn_sources
            from (select example_id, min(workload_id) as workload_id from suite where example_id is not null group by 1) group by 1 having count(*) >= 200""",
        "p3_daily_percentiles": f"""
            with m as ({_MEASURED.replace("workload_id, ", "workload_id, scored_at, ")}),
            d as (select workload_id, metric, value, strftime(cast(scored_at as date), '%Y-%m-%d') as day from m),
            r as (select *, row_number() over (partition by workload_id, day, metric order by value) as i,
                         count(*) over (partition by workload_id, day, metric) as n from d)
            select workload_id, day, metric, p, n, round(value, 6) as value
            from r join (values {_P}) as t(p) on i = greatest(1, ceil(p * n))""",
        "p3_percentiles": f"""
            with m as ({_MEASURED}),
            r as (select *, row_number() over (partition by workload_id, metric order by value) as i,
                         count(*) over (partition by workload_id, metric) as n from m)
            select workload_id, metric, p, n, round(value, 6) as value
            from r join (values {_P}) as t(p) on i = greatest(1, ceil(p * n))""",
        "p3_daily_combined": f"""
            with m as ({_MEASURED}),
            c as (select workload_id, metric, case when value > 0 then floor(log2(value) * 64) end as cell, count(*) as k
                  from m group by all),
            u as (select *, sum(k) over (partition by workload_id, metric order by cell nulls first) as upto,
                         sum(k) over (partition by workload_id, metric) as n from c)
            select workload_id, metric, p, cast(n as bigint) as n, round(coalesce(pow(2.0::double, cell / 64), 0), 6) as at_least,
                   round(coalesce(pow(2.0::double, (cell + 1) / 64), 0), 6) as below
            from u join (values {_P}) as t(p) on greatest(1, ceil(p * n)) between upto - k + 1 and upto""",
        "p2_found": """
            with recursive links as (
                select example_id_a as a, example_id_b as b from near_matches where example_id_a <> example_id_b
                union select x.example_id, m.m from suite x join (
                    select near_duplicate_cluster_id as c, min(example_id) as m from suite
                    where near_duplicate_cluster_id not in ('', 'unclustered') group by 1) m on m.c = x.near_duplicate_cluster_id),
            edges as (select a, b from links union select b, a from links),
            reach(node, root) as (
                select a, a from edges union select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b)
            select min(root) as group_id, node as example_id from reach group by node having min(root) <> node""",
    }
