"""What is kept up: the manifest of the history, daily counts, changed files, the line index, report folders."""

import json
import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintlake.operators import corpus, daily, history, text_index
from lintlake.schemas import HISTORY, HISTORY_COLUMNS
from lintlake.sources import changes, history_manifest, history_store, report_folder

AS_OF = datetime(2024, 1, 31, 12)


def history_table(spark, rows):
    """Rows of (project, day, line, type, advice, order)."""
    full = [
        (p, datetime(2024, 1, 1) + timedelta(days=d), f"/f{n}.py", f"f{n}.py", n, kind, "m", fix, "error", None, "python", order) for p, d, n, kind, fix, order in rows
    ]
    return spark.createDataFrame(full, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields) + ", seq long")


def random_rows(rng, n, order):
    return [(rng.choice("ppq"), rng.randrange(0, 60) / 2, rng.randrange(4), rng.choice("ab"), rng.choice(["x", "y", None]), order + i) for i in range(n)]


def same(a, b):
    key = lambda df: sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    assert key(a) == key(b)


# The manifest


def test_manifest_versions_are_whole(spark, tmp_path):
    place, rng = str(tmp_path), random.Random(1)
    assert history_manifest.read(spark, place).count() == 0
    parts = [history_table(spark, random_rows(rng, 30, 100 * i)) for i in range(3)]
    seen = [history_manifest.append(part, place, i, "w", ("seq",)) for i, part in enumerate(parts)]
    assert seen == [1, 2, 3]
    expected = history.latest_per_key(
        parts[0].withColumn("b", F.lit(0)).unionByName(parts[1].withColumn("b", F.lit(1))).unionByName(parts[2].withColumn("b", F.lit(2))), "b", "seq"
    ).select(HISTORY_COLUMNS)
    same(history_manifest.read(spark, place), expected)
    assert history_manifest.append(parts[2], place, 2, "w", ("seq",)) == 4  # the same batch again
    same(history_manifest.read(spark, place), expected)
    files = history_manifest.n_files(spark, place)
    reader = history_manifest.read(spark, place, version=4)
    history_manifest.compact(spark, place)
    assert history_manifest.n_files(spark, place) <= min(files, 60)
    same(reader, expected)  # still sees its version
    same(history_manifest.read(spark, place), expected)
    assert history_manifest.vacuum(spark, place, keep_versions=1) == 4  # one of them was replaced by the replay
    same(history_manifest.read(spark, place), expected)


def test_late_batch_of_the_same_time_wins_after_compaction(spark, tmp_path):
    place = str(tmp_path)
    for batch_id, fix in enumerate(["first", "second"]):
        history_manifest.append(history_table(spark, [("p", 1, 1, "a", fix, 0)]), place, batch_id, "w")
        history_manifest.compact(spark, place)
    assert history_manifest.read(spark, place).first().fix_suggestion == "second"


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    place = str(tmp_path)
    batches = {w: history_table(spark, [(w, 1, i, "a", "x", 0) for i in range(3)]) for w in ("u", "v", "w")}
    threads = [threading.Thread(target=history_manifest.append, args=(batch, place, 0, writer)) for writer, batch in batches.items()]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert history_manifest.versions(spark, place) == [1, 2, 3]
    assert history_manifest.read(spark, place).count() == 9


def test_a_version_is_published_once(spark, tmp_path):
    entry = [{"part": "x", "event_date": "2024-01-01", "writer": "w", "batch_id": 0}]
    assert history_manifest._publish(spark, str(tmp_path), 1, entry)
    assert not history_manifest._publish(spark, str(tmp_path), 1, [])
    assert history_manifest.entries(spark, str(tmp_path)) == (1, entry)


def test_compaction_keeps_what_slips_in(spark, tmp_path, monkeypatch):
    place = str(tmp_path)
    history_manifest.append(history_table(spark, [("p", 1, 1, "a", "x", 0)]), place, 0, "w")
    write = history_manifest._write_part

    def slow(rows, location, writer, batch_id):
        done = write(rows, location, writer, batch_id)
        if writer == "compaction":
            monkeypatch.setattr(history_manifest, "_write_part", write)
            history_manifest.append(history_table(spark, [("p", 2, 2, "a", "x", 0)]), place, 1, "w")
        return done

    monkeypatch.setattr(history_manifest, "_write_part", slow)
    history_manifest.compact(spark, place)
    assert sorted(r.line_num for r in history_manifest.read(spark, place).collect()) == [1, 2]


def test_expiry_drops_dates_and_compaction_the_rest(spark, tmp_path, plan):
    place = str(tmp_path)
    history_manifest.append(history_table(spark, [("p", d / 2, d, "a", "x", 0) for d in range(60)]), place, 0, "w")
    as_of = datetime(2024, 1, 31, 18)
    history_manifest.expire_dates(spark, place, as_of, 5)
    days = {e["event_date"] for e in history_manifest.entries(spark, place)[1]}
    assert days == {"2024-01-26", "2024-01-27", "2024-01-28", "2024-01-29", "2024-01-30"}
    history_manifest.compact(spark, place, as_of, 5)
    assert history_manifest.read(spark, place).agg(F.min("timestamp")).first()[0] >= as_of - timedelta(days=5)
    recent = history_manifest.read(spark, place, as_of - timedelta(days=2))
    shown = plan(recent)
    assert "event_date=2024-01-29" in shown and "event_date=2024-01-28" not in shown
    assert recent.count() == 2


# Daily counts


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_follow_upserts(spark, tmp_path, seed):
    """Rows move from day to day and lose their advice; after every batch the counts are those of a full scan."""
    rng = random.Random(seed)
    stored, counts = f"{tmp_path}/history", f"{tmp_path}/counts"
    for batch_id in (0, 1, 2, 2):
        batch = history_table(spark, random_rows(random.Random(seed * 10 + batch_id), 60, 0))
        daily.record_batch(batch, stored, counts, batch_id, "w", ("seq",))
        current = history_store.read_history(spark, stored)
        same(daily.read_counts(spark, counts), daily.daily_counts(current))
    start = AS_OF - timedelta(days=7)
    recent = daily.look_back_counts(daily.read_counts(spark, counts, start), history_store.read_history(spark, stored, start), AS_OF)
    same(daily.top_violations_of(recent), history.top_violations(current, AS_OF))
    same(daily.repeat_offenders_of(recent), history.repeat_offenders(current, AS_OF))
    assert rng is not None


def test_a_replay_after_half_a_batch_changes_nothing(spark, tmp_path):
    stored, counts = f"{tmp_path}/history", f"{tmp_path}/counts"
    first, second = (history_table(spark, [("p", d, 1, "a", "x", 0), ("p", d, 2 + d, "b", "y", 0)]) for d in (1, 2))
    daily.record_batch(first, stored, counts, 0, "w")
    history_store.append_history(second, stored, 1, "w")  # the history was written, the counts were not
    daily.record_batch(second, stored, counts, 1, "w")
    same(daily.read_counts(spark, counts), daily.daily_counts(history_store.read_history(spark, stored)))


# Changed files


def test_only_changed_files_are_parsed(spark, files):
    old = files(("/same.py", "print(1)\n"), ("/edit.py", "x = 1\n"), ("/gone.py", "print(1)\n"), ("/null.py", None))
    new = files(("/same.py", "print(1)\n"), ("/edit.py", "print(2)\n"), ("/new.py", "print(3)\n"), ("/null.py", None))
    found, status = changes.scan_changed(new, changes.file_manifest(old))
    assert {r.path: r.status for r in status.collect()} == {"/same.py": "same", "/edit.py": "changed", "/gone.py": "vanished", "/new.py": "new", "/null.py": "same"}
    assert {(r.path, r.status) for r in found.filter("violation_type = 'debug_pattern'").collect()} == {("/edit.py", "changed"), ("/new.py", "new")}
    assert {r.path for r in found.collect()} == {"/edit.py", "/new.py"}


def test_changed_tree_opens_no_old_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.py").write_text(name)
    listing = spark.createDataFrame(changes.scan_tree(spark, str(tmp_path)).drop("content").collect(), "path string, length long, modification_time timestamp")
    assert changes.changed_tree(spark, str(tmp_path), listing).count() == 0
    time.sleep(1.1)
    (tmp_path / "b.py").write_text("other")
    (tmp_path / "c.py").write_text("c")
    found = {r.path.rsplit("/", 1)[1]: (r.status, bytes(r.content)) for r in changes.changed_tree(spark, str(tmp_path), listing).collect()}
    assert found == {"b.py": ("changed", b"other"), "c.py": ("new", b"c")}


# The line index


@pytest.mark.parametrize(
    "regex, texts",
    [
        ("hello", ["hello"]), (r"\bfoo\b.*bar", ["foo", "bar"]), ("a|b", []), ("(abc)+d", ["abc", "d"]), ("(?:ab|cd)efg", ["efg"]), ("ab*cd", ["a", "cd"]),
        ("(?i)hello", []), ("[hj]ello", ["ello"]), ("x{3}yz", ["x", "yz"]), ("(ab(cd))ef", ["abcdef"]), ("^import (\\w+)$", ["import "]), ("(?=abc)de", ["de"]),
        ("(a)\\1b", ["a", "b"]), ("(?i:abc)def", ["def"]), ("a?bcd", ["bcd"]), ("(?>abc)de", ["abc", "de"]),
    ],
)
def test_required_texts(regex, texts):
    assert text_index.required_texts(regex) == texts


def test_index_finds_what_grep_finds(spark, files, tmp_path):
    rng = random.Random(3)
    words = ["import", "imp", "os.path", "ünïcode", "a", "", "def run(x):", "  return", "\tx", "日本語の", "aaaa"]
    table = files(*[(f"/f{i}.py", "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(rng.randrange(6)))) for i in range(40)])
    index = text_index.write_line_index(table, f"{tmp_path}/index", blocks=4)
    for regex in ["import", r"def run\(x\)", "ünïc.*本語", "imp (a|import)", "x", "nowhere", "(?i)IMPORT", "^  ret", "aaa+", "日本語"]:
        same(text_index.grep_indexed(index, regex), corpus.grep(table, regex))
    report = text_index.grep_report(index, "os.path")
    row = report.first()
    assert row.n_found <= row.n_read < row.n_lines
    again = text_index.open_line_index(spark, f"{tmp_path}/index")
    same(text_index.grep_indexed(again, "return"), corpus.grep(table, "return"))


def test_postings_are_kept_in_lists_and_stretches_lose_none(spark, files, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = ["import", "os.path", "ünïcode", "", "日本語の", "ab", "x" * 50]
    table = files(*[(f"/f{i}.py", "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(30))) for i in range(40)])
    whole = text_index.write_line_index(table, f"{tmp_path}/whole", blocks=4)
    assert whole.postings.count() <= whole.lengths.count() * max(1, whole.lines.rdd.getNumPartitions())
    monkeypatch.setattr(text_index, "STRETCH", 100)
    cut = text_index.write_line_index(table, f"{tmp_path}/cut", blocks=4)
    same(cut.lengths, whole.lengths)
    for regex in ["import os", "ünïc.*本語", "x{40}", "nowhere"]:
        same(text_index.grep_indexed(cut, regex), corpus.grep(table, regex))


# Report folders


def test_report_folder_sets_aside_what_it_cannot_read(spark, tmp_path):
    good = json.dumps([{"code": "F1", "message": "m", "location": {"row": 3}}])
    rows = [
        ("ruff", "/a.py", good), ("ruff", "/b.py", good[:-3]), ("ruff", None, good), ("ruff", "/c.py", None), ("ruff", "/d.py", "{}"), ("ruff", "/e.py", "[]"),
        ("nobody", "/f.py", good), ("tsc", "/g.ts", "g.ts(1,2): error TS1: x\nnoise"), ("clippy", "/h.rs", "not json"), ("golangci", "/i.go", '{"Issues": null}'), ("golangci", "/j.go", "[]"),
    ]
    folder = f"{tmp_path}/in"
    report_folder.write_reports(spark.createDataFrame(rows, "tool string, path string, report string"), folder)
    documents = report_folder.read_reports(spark, folder)
    assert documents.count() == len(rows)
    aside = {(r.tool, r.reason) for r in report_folder.quarantine(documents).collect()}
    assert aside == {("ruff", "report cut short"), ("ruff", "no path"), ("ruff", "no report"), ("nobody", "unknown tool"), ("golangci", "report cut short")}
    assert report_folder.quarantine(documents).count() == 6
    found = report_folder.import_reports(documents).collect()
    assert sorted((r.path, r.violation_type) for r in found) == [("/a.py", "F1"), ("/g.ts", "typescript_TS1")]


def test_report_stream_reads_a_file_once(spark, tmp_path):
    good = json.dumps([{"code": "F1", "message": "m", "location": {"row": 3}}])
    folder = f"{tmp_path}/in"
    for i in range(2):
        report_folder.write_reports(spark.createDataFrame([("ruff", f"/{i}.py", good)], "tool string, path string, report string").coalesce(1), folder)
        found = report_folder.import_reports(report_folder.stream_reports(spark, folder)).select("path", "violation_type")
        writer = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("path string, violation_type string").parquet(f"{tmp_path}/out")
    assert sorted(r.path for r in out.collect()) == ["/0.py", "/1.py"]
