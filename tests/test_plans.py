"""Registered queries: results against SQL at the smallest size, and the shape of their plans."""

import re

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from findmill.operators import dedup
from findmill.operators.context import context_join, snippet_fallback, with_source
from findmill.operators.findings import findings_query
from findmill.plans import q_ingest as qi, views as v
from findmill.plans.registry import registered
from findmill.sources import reports
from findmill.sources.corpus import open_sources, store_sources

SF = "/root/testdata/sf0.001"
NAMES = sorted(registered())
GLOBAL_WINDOW = re.compile(r"Window \[.*\n.*Sort .*\n.*Exchange SinglePartition")


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


def plan_of(df, mode="formatted"):
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString(mode))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    """Same rows as the SQL; no nested loop, no window over everything."""
    df = entry.queries()[name](spark, SF)
    ok, note = compare(df, con, name)
    assert ok, note
    plan = plan_of(df, "simple")
    assert "CartesianProduct" not in plan and not GLOBAL_WINDOW.search(plan)
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_every_query_has_a_check():
    assert all(sql for _, sql in registered().values())
    assert set(registered()) <= set(entry.oracle_sql())


def test_texts_of_stored_sources_are_not_shuffled(spark, tmp_path):
    """Neither context nor snippets deal texts out again once sources are stored by bucket, however large the findings are."""
    stored = store_sources(v.files(spark, SF).select("project", "path", "content"), str(tmp_path / "src"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for files in (stored, open_sources(spark, str(tmp_path / "src"), 4)):
            found = v.doc_findings(spark, SF)
            for out in (with_source(found, files), context_join(found, files), snippet_fallback(found, files)):
                plan = plan_of(out)
                exchanged = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part)]
                assert exchanged and not any("content#" in part.split("Arguments")[0] for part in exchanged)
                assert plan.count("Bucketed: true") == 1 and "SortMergeJoin" in plan
            want = sorted(map(str, context_join(found, v.files(spark, SF)).select("finding_id", "context").collect()))
            both = with_source(found, files)
            assert sorted(map(str, both.select("finding_id", "context").collect())) == want
            assert sorted(both.select("finding_id", "snippet").collect()) == sorted(snippet_fallback(found, v.files(spark, SF)).select("finding_id", "snippet").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_are_read_and_parsed_once(spark, tmp_path):
    qi.mixed_reports(spark, SF).write.parquet(str(tmp_path / "r"))
    plan = plan_of(reports.ingest_all(spark.read.parquet(str(tmp_path / "r"))), "simple")
    assert plan.count("FileScan") == 1 and plan.count("parseJson") == 1 and "from_json" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    v.findings(spark, SF).limit(50).write.parquet(str(tmp_path / "f"))
    df = findings_query(spark.read.parquet(str(tmp_path / "f")), severity="high", pr_changed=False).select("finding_id")
    plan = plan_of(df)
    assert "EqualTo(severity,high)" in plan and "TakeOrderedAndProject" in plan
    assert "description" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_dedup_reduces_before_the_shuffle(spark):
    """A fingerprint that holds most rows leaves one row per input partition."""
    df = spark.range(20000).selectExpr("1L AS scan_id", "id", "CASE WHEN id % 100 = 0 THEN cast(id AS string) ELSE 'hot' END AS fingerprint")
    out = dedup.dedup_first(df, ["scan_id"], ["id"])
    plan = plan_of(out, "simple")
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert out.count() == 201 and out.where("fingerprint = 'hot'").first()["id"] == 1


def test_large_tables_are_dealt_by_rows(spark, monkeypatch):
    """A task of the join and the ranking behind it gets a bounded number of lines, however large the table is."""
    counts = registered()["severity_counts"][0]
    want = sorted(counts(spark, SF).collect())
    assert "REPARTITION_BY_NUM" not in plan_of(counts(spark, SF))
    monkeypatch.setattr(v, "TASK_ROWS", 100)
    got = counts(spark, SF)
    assert re.findall(r"hashpartitioning\([lo]_orderkey#\w+, (\d+)\), REPARTITION_BY_NUM", plan_of(got)) == [str(v.load(spark, SF, "lineitem").count() // 100)] * 2
    assert sorted(got.collect()) == want
