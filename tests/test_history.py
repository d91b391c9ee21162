"""History: upsert, retention, the stored log, and the plans of its questions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from lintlake.operators import convergence, history
from lintlake.schemas import HISTORY, HISTORY_KEY
from lintlake.sources import history_store
from workloads.fixtures import history_rows
from workloads.registry import AS_OF

T0 = datetime(2024, 1, 1)


def row(day=0, path="/w/a.py", line=1, kind="k", message="m", fix="f", project="p"):
    return (project, T0 + timedelta(days=day), path, path.split("/")[-1], line, kind, message, fix, "error", None, "python")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), HISTORY)


def content(df):
    return sorted(map(repr, map(tuple, df.select(HISTORY.fieldNames()).collect())))


def test_later_row_wins(spark):
    merged = history.upsert(table(spark, row(0, fix="old"), row(0, line=2)), table(spark, row(1, fix="new"))).collect()
    assert sorted((r.line_num, r.fix_suggestion) for r in merged) == [(1, "new"), (2, "f")]


def test_batch_wins_at_equal_time(spark):
    merged = history.upsert(table(spark, row(0, fix="old")), table(spark, row(0, fix="new"))).collect()
    assert [r.fix_suggestion for r in merged] == ["new"]


def test_upsert_twice_is_once(spark, sf_dir):
    rows = history.latest_per_key(history_rows(spark, sf_dir), "seq").drop("seq")
    once = history.upsert(table(spark), rows)
    assert content(once) == content(history.upsert(once, rows))
    assert once.select(*HISTORY_KEY).distinct().count() == once.count()


def test_batch_order_does_not_matter(spark):
    a, b = table(spark, row(0, fix="1"), row(3, line=2, fix="3")), table(spark, row(1, fix="2"), row(2, line=2, fix="4"))
    empty = table(spark)
    forward = history.upsert(history.upsert(empty, a), b)
    backward = history.upsert(history.upsert(empty, b), a)
    assert content(forward) == content(backward)


def test_bounds_are_strict(spark):
    rows = table(spark, row(0), row(7, line=2), row(8, line=3))
    as_of = T0 + timedelta(days=14)
    assert [r.line_num for r in history.look_back(rows, as_of, 7).collect()] == [3]
    assert sorted(r.line_num for r in history.expire(rows, as_of, 7).collect()) == [2, 3]


def test_store_replay_and_look_back(spark, tmp_path):
    place = str(tmp_path / "log")
    first, second = table(spark, row(0, fix="old"), row(0, line=2)), table(spark, row(5, fix="new"))
    for batch_id, batch in [(0, first), (1, second), (1, second), (0, first)]:
        history_store.append_history(batch, place, batch_id, "w")
    rows = history_store.read_history(spark, place)
    assert sorted((r.line_num, r.fix_suggestion) for r in rows.collect()) == [(1, "new"), (2, "f")]
    recent = history_store.read_history(spark, place, T0 + timedelta(days=1))
    assert [r.fix_suggestion for r in recent.collect()] == ["new"]


def test_store_look_back_prunes_partitions(spark, tmp_path, plan):
    place = str(tmp_path / "log")
    history_store.append_history(table(spark, row(0), row(5, line=2)), place, 0, "w")
    text = plan(history_store.read_history(spark, place, T0 + timedelta(days=1)))
    assert "PartitionFilters: [isnotnull(event_date" in text


def test_compact(spark, tmp_path):
    place, target = str(tmp_path / "log"), str(tmp_path / "merged")
    history_store.append_history(table(spark, row(0, fix="old"), row(0, line=2)), place, 0, "w")
    history_store.append_history(table(spark, row(100, fix="new")), place, 1, "w")
    history_store.compact(spark, place, target, T0 + timedelta(days=101), 90)
    assert [r.fix_suggestion for r in history_store.read_history(spark, target).collect()] == ["new"]


def test_hot_key_is_combined_before_the_shuffle(spark, plan):
    text = plan(history.latest_per_key(table(spark, row())))
    assert text.index("partial_max_by") > 0


def test_top_lists_cut_before_the_shuffle(spark, sf_dir, plan):
    for question in (history.top_violations, history.repeat_offenders):
        assert "WindowGroupLimit" in plan(question(history_rows(spark, sf_dir), AS_OF))
    assert "GreaterThan(ts,2024-01-24T00:00)" in plan(history.top_violations(history_rows(spark, sf_dir), AS_OF))


def test_summary_of_project_without_rows(spark):
    assert history.learning_summary(table(spark), AS_OF).count() == 0


def rounds(spark, *errors, path="a"):
    return spark.createDataFrame([(path, i + 1, e) for i, e in enumerate(errors)], "path string, round int, n_errors long")


def test_convergence(spark):
    cases = {
        (0,): (1, 0, "clean"), (3, 0): (2, 0, "clean"), (3, 3): (2, 3, "stalled"), (3, 5): (2, 5, "stalled"),
        (5, 4, 3): (3, 3, "exhausted"), (5, 4, 3, 0): (3, 3, "exhausted"), (5, 4): (2, 4, "open"),
    }
    for errors, want in cases.items():
        got = convergence.fix_convergence(rounds(spark, *errors)).collect()
        assert [(r.stop_round, r.errors_left, r.outcome) for r in got] == [want], errors


def test_final_round_keeps_every_row(spark):
    found = spark.range(9000).select(F.lit("/hot.py").alias("path"), "id", (F.col("id") % 3).cast("int").alias("round"))
    assert convergence.final_round(found).count() == 3000


def test_two_writers_keep_their_rows(spark, tmp_path):
    place = str(tmp_path / "log")
    history_store.append_history(table(spark, row(0)), place, 0, "one")
    history_store.append_history(table(spark, row(0, line=2)), place, 0, "two")
    assert sorted(r.line_num for r in history_store.read_history(spark, place).collect()) == [1, 2]


def test_compact_refuses_its_own_location(spark, tmp_path):
    place = str(tmp_path / "log")
    with pytest.raises(ValueError, match="another folder"):
        history_store.compact(spark, place, place + "/")
