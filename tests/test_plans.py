"""Physical-plan properties: pruning reaches the scan, no cartesian products."""

import re

from corefkit.functions.text import BLANK, WS_CHARS, strip, words
from corefkit.plans import fixtures as fx
from corefkit.registry import entries
from tests.conftest import SF_SMALL

ENTRIES = entries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^>]*>)", plan)


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_documents_scan_is_pruned(spark):
    df = ENTRIES["word_tokens"].fn(spark, SF_SMALL)
    schemas = _read_schemas(_formatted(df))
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas), schemas


def test_pair_join_reads_only_needed_columns_and_is_not_cartesian(spark):
    df = ENTRIES["confusion_matrix"].fn(spark, SF_SMALL)
    text = _formatted(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for s in _read_schemas(text):
        assert "n_chars" not in s and "lang" not in s, s


def test_no_query_uses_nested_loop_or_cartesian_joins(spark):
    for name in ("unique_sample", "assign_batches", "multiclass_metrics", "merge_responses", "sample_fraction"):
        plan = _plan(ENTRIES[name].fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_raw_lines_are_not_shuffled(spark):
    plan = _plan(ENTRIES["read_raw_pairs"].fn(spark, SF_SMALL))
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert plan.count("_line") > 0  # the lines are there, in place


def test_expensive_columns_are_evaluated_once(spark):
    from corefkit.operators.prompts import encoder_text
    from corefkit.plans import fixtures as fx

    plan = _plan(encoder_text(fx.splits(spark, SF_SMALL)).select("pair_id", "text_a"))
    assert "Generate inline" in plan
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("transform(" in line for line in filters), filters


def test_staged_folders_can_be_cleared(spark, monkeypatch):
    from corefkit import session

    monkeypatch.setattr(session, "_STAGED", [])
    df = session.staged(spark.range(5), "clear_me")
    assert df.count() == 5
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert session.clear_staged(spark) == 1 and session.clear_staged(spark) == 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def test_strip_runs_no_pattern_and_takes_every_blank(spark):
    df = spark.createDataFrame([(f"{c}\t a{c}b \n{c}", f"a{c}b") for c in WS_CHARS], "s string, want string")
    got = df.select(strip("s").alias("got"), "want")
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(WS_CHARS) == 29 and got.where("got <> want").count() == 0


def test_whole_texts_meet_no_pattern_where_the_table_is_read(spark):
    assert "regexp_replace(text" not in fx.pairs_wide(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_the_class_of_blanks_is_few_tests_a_character_and_holds_the_29(spark):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k <= 0xDFFF]
    df = spark.createDataFrame([("".join(points[k:k + 4096]),) for k in range(0, len(points), 4096)], "s string")
    found = df.selectExpr("explode(regexp_extract_all(s, r'" + BLANK + "', 0)) AS c").collect()
    assert sorted(r.c for r in found) == sorted(WS_CHARS) == sorted(c for c in points if c.isspace())
    assert BLANK in df.select(words("s"))._jdf.queryExecution().analyzed().toString()
