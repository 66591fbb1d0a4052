"""Queries on tables that the small ones are too few to hold: chance phrases, shares at a limit."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from attestry.functions.text import injection_match, normalise
from attestry.operators.narrative import check_narratives
from attestry.queries import ORACLES, QUERIES, metrics_layer
from attestry.plans.screen import profiles_of
from attestry.queries.registry import Tables
from attestry.sources.corpus import spread
from oracle_check import compare


def against_sql(spark, home, name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{home}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{home}/{table}.parquet/*.parquet'")
    return compare(QUERIES[name](spark, str(home)), con, ORACLES[name])


PROSE = [(1, "toingheth enlyou are an it eaor"), (2, "you are\n a erinon"), (9, "so you are now here"), (4, ""), (5, "  ")]


def test_prose_that_holds_a_phrase_by_chance(spark, tmp_path):
    docs = spark.createDataFrame(PROSE, "doc_id bigint, text string")
    assert against_sql(spark, tmp_path, "injection_lexicon", documents=docs) == ("", 5)
    # the operator itself finds it
    found = docs.select("doc_id", injection_match(normalise("text")).alias("m")).where("m IS NOT NULL")
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 9}


def test_whole_scan_of_prose_that_holds_a_phrase_by_chance(spark, tmp_path):
    docs = spark.createDataFrame(PROSE, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    assert against_sql(spark, tmp_path, "scan_integrity", documents=docs, benchmark=items) == ("", 5)


def test_whole_scan_of_documents_without_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, None) for i in range(1, 13)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    assert against_sql(spark, tmp_path, "scan_integrity", documents=docs, benchmark=items) == ("", 12)


def test_share_that_only_rounding_brings_to_the_limit(spark, tmp_path):
    # 179 of 597 is 0.29983, 0.3 when rounded
    commits = spark.range(597).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(7).cast("long").alias("l_suppkey"),
        F.when(F.col("id") < 179, "R").otherwise("N").alias("l_returnflag"),
        F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"),
    )
    suppliers = spark.range(7, 8).select(F.col("id").alias("s_suppkey"))
    assert against_sql(spark, tmp_path, "repo_profile", supplier=suppliers, lineitem=commits) == ("", 1)


def test_tables_by_candidate_are_never_broadcast(spark, tmp_path):
    # a broadcast is unpacked in the driver; the files of many alike rows look small
    parts = spark.range(50).select(
        F.col("id").alias("p_partkey"), F.lit("a large box").alias("p_name"), F.lit("SMALL").alias("p_type"),
        F.lit(3).alias("p_size"),
    )
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("repo_covers_skill", "judge_project", "judge_skill"):
        df = QUERIES[name](spark, str(tmp_path))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name
        assert "SortMergeJoin" in plan, name


def test_stream_over_a_table_of_several_files(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + words), (2, "nothing of it"), (3, words + " after")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, words)], "item_id bigint, text string")
    problem, rows = against_sql(spark, tmp_path, "stream_screen", documents=docs, benchmark=items)
    assert (problem, rows) == ("", 2)


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    spark.range(40000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        raw = spark.read.parquet(f"{tmp_path}/part.parquet")
        assert raw.rdd.getNumPartitions() > cores  # all but one are empty
        parts = Tables(spark, str(tmp_path)).spread("part").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sizes = [p["count"] for p in parts]
    assert sum(sizes) == 40000 and max(sizes) < 2 * 40000 / cores


def test_short_rows_get_more_tasks_as_they_grow_in_number(spark):
    rows = spark.range(0, 10000, 1, spark.sparkContext.defaultParallelism)
    assert spread(rows) is rows
    assert spread(rows, 100).rdd.getNumPartitions() == 100


def test_applications_of_one_part_are_read_by_all_cores(spark):
    texts = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.lit("Skills\nKafka, Go\n").alias("visible_text"))
    applications = spark.range(0, 400, 1, 1).select(
        F.col("id").cast("string").alias("candidate_id"), F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("jd_id")
    )
    read = profiles_of(applications, texts).select("candidate_id", "skills", F.spark_partition_id().alias("part"))
    rows = read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert len(rows) == 400 and len({r["part"] for r in rows}) == spark.sparkContext.defaultParallelism


def test_roles_of_one_row_group_are_compared_on_all_cores(spark, tmp_path):
    orders = spark.range(0, 64, 1, 1).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit("2019-05-05").cast("timestamp").alias("o_orderdate"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES["judge_role"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan


def test_figures_and_terms_are_searched_once(spark, tmp_path):
    # a filter on an exploded column's size goes below the projection and searches the text again
    lines = spark.range(60).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 5).alias("l_partkey"),
        F.col("id").cast("double").alias("l_quantity"),
    )
    parts = spark.range(5).select(F.col("id").alias("p_partkey"), (F.col("id") * 7).cast("int").alias("p_size"))
    assert against_sql(spark, tmp_path, "judge_metric", lineitem=lines, part=parts) == ("", 60)
    assert against_sql(spark, tmp_path, "check_narratives", lineitem=lines)[0] == ""
    for name in ("judge_metric", "check_narratives"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        filters = [x for x in plan.splitlines() if " Filter " in x or x.strip(" :+-").startswith("Filter")]
        assert not [x for x in filters if "regexp_extract_all" in x], name


def test_end_of_a_text_without_terms_is_searched_once(spark):
    # searched again from each character, 60,000 characters would take minutes
    prose = spark.createDataFrame(
        [(1, "word " * 12000, "", ["Solid Docker work " + "word " * 12000], [])],
        "doc_id bigint, summary string, rationale string, strengths array<string>, risks array<string>",
    )
    facts = spark.createDataFrame(
        [(1, ["Python"], ["docker"], [], 10.0, 2)],
        "doc_id bigint, matched array<string>, missing array<string>, partial array<string>, base_score double, total_requirements int",
    )
    start = time.monotonic()
    assert [r["type"] for r in check_narratives(prose, facts).collect()] == ["strength_contradicts_facts"]
    assert time.monotonic() - start < 60


def test_invariance_is_audited_by_all_four_edits(spark, tmp_path):
    customers = spark.range(96).select(
        F.col("id").alias("c_custkey"), (F.col("id") * 7 % 25).cast("int").alias("c_nationkey")
    )
    nations = spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"))
    assert against_sql(spark, tmp_path, "invariance_audit", customer=customers, nation=nations) == ("", 4)
    # and each edit changes each text
    edited = metrics_layer._edited(Tables(spark, str(tmp_path)))[1]
    texts = edited.groupBy("doc_id").agg(F.collect_set("variant").alias("v"), F.count_distinct("text").alias("n"))
    assert {(tuple(sorted(r.v)), r.n) for r in texts.collect()} == {(("p1", "p2", "p3", "p4", "primary"), 5)}
