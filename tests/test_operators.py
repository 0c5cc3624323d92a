"""Hand-made cases and properties of the log operators."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loglattice.functions import patterns as P
from loglattice.functions import predicates as is_
from loglattice.functions import text as T
from loglattice.operators import batch, blocks, decide, prune, rangealg, ranges, search, segment, windows
from loglattice.plans.config import configured
from loglattice.sources import cases, sinks


def lines_of(spark, texts, gaps=None):
    us, rows = 0, []
    for i, text in enumerate(texts):
        us += gaps[i - 1] if gaps and i else 0
        rows.append((1, i + 1, us if gaps else None, text))
    return spark.createDataFrame(rows, "file int, line_no long, us long, text string")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_text(spark):
    assert value(spark, T.line_array, "a\r\nb\rc\x0cd\x85e\u2028f\n") == ["a", "b", "c", "d", "e", "f"]
    assert value(spark, T.line_array, "﻿a\n\n") == ["﻿a", ""]
    assert value(spark, T.preprocessed, "2024-01-02T03:04:05.1Z \x1b[31mred\x1b[0m  ") == "red"
    assert value(spark, T.pruning_text, "a\x1b[2Kb\x07\tc") == "ab\tc"
    assert value(spark, T.overwritten, "10%\rdone\r ") == "done"
    assert [value(spark, T.overwritten, x) for x in (" \r ", "\u00a0\ra", "\r", "a", " ")] == [" \r ", "a", "\r", "a", " "]
    assert value(spark, T.stamp_micros, "﻿2024-01-02T03:04:05.1234567Z x") == 1704164645123456
    assert value(spark, T.stamp_micros, "2024-13-02T03:04:05.1Z") is None
    assert value(spark, lambda t: T.truncated(t, 5, 3), "abcdef") == "abc"


def test_keywords(spark):
    match = lambda t: is_.has_keyword(t, ["error"])
    assert [value(spark, match, x) for x in ("an Error's end", "errors", "_error", "ERROR!")] == [True, False, False, True]
    assert value(spark, lambda t: is_.has_keyword(t, []), "error") is False


@pytest.mark.parametrize(("gaps", "splits"), [([100_000] * 60, 0), ([100_000] * 9 + [900_000], 0), ([100_000] * 10 + [900_000], 1), ([100] * 30 + [9_000], 0)])
def test_split_needs_history(spark, gaps, splits):
    assert segment.split_points(lines_of(spark, ["x"] * (len(gaps) + 1), gaps)).count() == splits


def test_split_like_exact_statistics(spark):
    rng = random.Random(3)
    gaps = [rng.choice([100_000, 100_000, 120_000, 5_000_000 if rng.random() < 0.2 else 90_000]) for _ in range(300)]
    expected = []
    for i in range(len(gaps)):
        frame = gaps[max(0, i - 49) : i + 1]
        if len(frame) > 1:
            mean, sd = statistics.mean(frame), statistics.stdev(frame)
            if gaps[i] > mean + 3 * sd and gaps[i] >= 10_000:
                expected.append((i + 2,))
    lines = lines_of(spark, ["x"] * 301, gaps)
    found = segment.split_points(lines)
    assert got(found, "line_no") == expected
    tiles = got(segment.segments(lines, found), "start", "end")
    assert tiles == got(segment.segments(lines), "start", "end")
    assert tiles[0][0] == 1 and tiles[-1][1] == 301 and all(b[0] == a[1] + 1 for a, b in zip(tiles, tiles[1:]))


def test_indented_lines_do_not_split(spark):
    gaps = [100_000] * 10 + [900_000] + [100_000] * 3
    assert segment.split_points(lines_of(spark, ["\tx"] * 15, gaps)).count() == 0


def test_blocks_without_stamps(spark):
    lines = lines_of(spark, ["a", "b"])
    assert got(segment.segments(lines), "start", "end", "timestamp_success") == [(1, 2, False)]


def test_warning_fallback(spark):
    one = lines_of(spark, ["error", "warning", "x"])
    two = lines_of(spark, ["error", "warning", "failed"])
    assert got(blocks.hits(one).filter("hit"), "line_no") == [(1,), (2,)]
    assert got(blocks.hits(two).filter("hit"), "line_no") == [(1,), (3,)]


def test_log_ranges(spark):
    texts = ["x", "##[error]early", "##[group]Run a", "##[endgroup]", "##[error]bad", "more", "Post job cleanup.", "##[group]Run b", "##[error]Process completed with exit code 1.", "tail"]
    found = got(ranges.log_ranges(lines_of(spark, texts)), "start", "end", "workflow_end")
    assert found == [(1, 2, None), (3, 6, 4), (8, 9, None)]
    assert got(ranges.log_ranges(lines_of(spark, ["a", "b"])), "start", "end") == [(1, 2)]
    assert got(ranges.log_ranges(lines_of(spark, ["a", "##[endgroup]", "b"])).withColumn("none", F.col("workflow_end").isNull()), "start", "end", "none", "seq") == [(1, 3, True, 1)]
    late = ["##[group]Run a", "##[error]x", "##[group]Run b", "##[error]y", "##[error]z", "##[endgroup]"]
    both = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(late)] + [(2, i + 1, t) for i, t in enumerate(late)], "file int, line_no long, text string")
    keyed = spark.createDataFrame([(1, "RUN a"), (2, "nothing"), (2, "")], "file int, name string")
    assert got(ranges.step_starts(both, keyed), "file", "error_line", "step_start") == [(1, 2, 1), (1, 4, 1), (1, 5, 1), (2, 2, None), (2, 4, None), (2, 5, None)]
    assert got(ranges.log_ranges(both, keyed), "file", "start", "end", "seq") == [(1, 1, 6, 1), (2, 1, 2, 1), (2, 3, 6, 2)]
    steps = spark.createDataFrame([("Run b",)], "name string")
    assert got(ranges.log_ranges(lines_of(spark, ["a", "##[group]Run b", "c", "Post job cleanup.", "d"]), steps), "start", "end") == [(2, 4)]


@pytest.mark.parametrize(("length", "n"), [(300, 1), (301, 2), (4290, 20), (4291, 21)])
def test_window_count(spark, length, n):
    block = spark.createDataFrame([(1, 1, length)], "file int, start long, end long")
    made = got(windows.windows(block), "w_start", "w_end")
    assert len(made) == n and made[0][0] == 1 and made[-1][1] == length
    assert got(windows.over_budget(block), "keep_whole") == [(n > 20,)]


def test_file_windows_reach_the_end(spark):
    files = spark.createDataFrame([(1, 27_031), (2, 100_000), (3, 5)], "file int, n_lines long")
    made = got(windows.file_windows(files), "file", "w_start", "w_end")
    for file, n in ((1, 27_031), (2, 100_000), (3, 5)):
        own = sorted((a, b) for f, a, b in made if f == file)
        assert own[0][0] == 1 and own[-1][1] == n and all(b[0] <= a[1] + 1 for a, b in zip(own, own[1:], strict=False))
    longest = spark.createDataFrame([(1, 3_000_000)], "file int, n_lines long")
    assert windows.file_windows(longest).count() == 10_000


def test_vote_needs_all_windows(spark):
    rows = spark.range(1, 61).selectExpr("1 as file", "id as line_no", "1L as start", "60L as end")
    members = windows.memberships(rows, 40, 28)
    gone = members.filter("w = 0 or line_no > 45")
    assert [x for (x,) in got(windows.votes(members, gone), "line_no")] == [*range(1, 29), *range(46, 61)]


def test_range_algebra(spark):
    make = lambda rows: spark.createDataFrame([(1, a, b) for a, b in rows], "file int, start long, end long")
    assert got(rangealg.merged(make([(1, 3), (4, 6), (9, 9)])), "start", "end") == [(1, 6), (9, 9)]
    assert got(rangealg.merged(rangealg.merged(make([(1, 3), (2, 8), (9, 9)]))), "start", "end") == [(1, 9)]
    assert got(rangealg.subtracted(make([(1, 10), (20, 30)]), make([(3, 4), (25, 99)])), "start", "end") == [(1, 2), (5, 10), (20, 24)]
    assert got(rangealg.not_contained(make([(2, 3), (2, 9)]), make([(1, 5)])), "start", "end") == [(2, 9)]
    cut = lambda new, old: spark.createDataFrame([(new, old)], "n struct<s:long,e:long>, o array<struct<s:long,e:long>>").select(rangealg.trimmed_against(F.col("n"), F.col("o"))).first()[0]
    assert tuple(cut((5, 20), [(1, 8), (15, 30)])) == (9, 14)
    assert tuple(cut((1, 30), [(5, 8)])) == (1, 30)
    assert cut((5, 8), [(1, 9)]) is None


def test_duplicate_runs(spark):
    texts = ["a", "a", "b", "b", "b", "c", "c", "c", "c", "c", "", "", ""]
    assert [x for (x,) in got(rangealg.duplicate_runs(lines_of(spark, texts)), "line_no")] == [4, 7, 8, 9]
    hard = lines_of(spark, ["c"] * 7).withColumn("hard", F.col("line_no") == 4)
    assert [x for (x,) in got(rangealg.duplicate_runs(hard, "hard"), "line_no")] == [2, 6]


def brute_protection(texts):
    import re

    one = lambda listed: re.compile("|".join(f"(?:{x})" for x in listed))
    stack, new, exc = one(P.STACK), one(P.NEW_ERROR), one(P.EXCEPTION_SIGNS)
    first = lambda t: next((k for p, k in P.P0 if re.search(p, t, re.I)), None)
    out = set()
    for i, t in enumerate(texts):
        kind = first(t)
        if one(P.LOCATION).search(t) and re.search("|".join(P.ERROR_WORDS), t, re.I):
            out.add(i)
        if not kind:
            continue
        out.add(i)
        for j in range(i + 1, min(len(texts), i + 100)):
            x = texts[j]
            if stack.search(x):
                out.add(j)
            elif not x.strip():
                continue
            elif new.search(x):
                break
            elif x.startswith("    ") or x.startswith("\t"):
                out.add(j)
            else:
                break
        if kind == "traceback":
            for j in range(i + 1, min(len(texts), i + 50)):
                x = texts[j]
                if stack.search(x) or exc.search(x):
                    out.add(j)
                elif not x.strip():
                    continue
                elif x.startswith(" ") and not x.startswith("  "):
                    break
                elif re.search(r"\w+(Error|Exception):", x):
                    out.add(j)
    return [(i + 1,) for i in sorted(out)]


def test_protection_like_a_scan(spark):
    rng = random.Random(1)
    pool = ["Traceback (most recent call last):", "    deep", " one space", "", "plain", "##[error]x", "ValueError: y", "\tat z()", "   at q in r:line 3", "a/b.c:3:4: error: e", "Caused by: w", "MyException: v"]
    for _ in range(3):
        texts = [rng.choice(pool) for _ in range(150)]
        assert got(prune.hard_protected(lines_of(spark, texts)).filter("hard"), "line_no") == brute_protection(texts)


def test_pruning_keeps_what_is_hard(spark):
    texts = ["##[error]bad", *["same"] * 30, "Welcome to x", "", "10%", *[f"l{i}" for i in range(30)], "Downloading... 3%", ""]
    out = prune.simple_pruned(lines_of(spark, texts))
    assert out.filter("gone and hard").count() == 0
    kept, gone = got(prune.relevant_ranges(out), "start", "end"), got(prune.irrelevant_ranges(out), "start", "end")
    covered = sorted(x for a, b in kept + gone for x in range(a, b + 1))
    assert covered == list(range(1, len(texts) + 1)) and gone
    assert prune.simple_pruned(lines_of(spark, ["", "10%"])).filter("gone").count() == 0


def test_judgment(spark):
    rows = spark.createDataFrame([(1, i, e) for i, e in enumerate([False, False, True, False, False, True])], "file int, start long, error boolean")
    out = blocks.judged(rows)
    assert got(out, "start", "seq", "errors", "clean_run") == [(0, 6, 2, 2), (1, 5, 2, 1), (2, 4, 2, 0), (3, 3, 1, 2), (4, 2, 1, 1), (5, 1, 1, 0)]
    assert got(blocks.stops(out, 2), "stop_seq") == [(3,)]
    assert got(blocks.expansion_limits(rows), "start", "max_down") == [(0, 1), (1, 0), (2, 2), (3, 1), (4, 0), (5, 1)]


def test_answers(spark):
    one = lambda c, t: value(spark, c, t)
    assert one(decide.parsed_deletions, 'x {"delete": [{"line_no": 4}, 7]} y') == [4, 7]
    assert one(decide.parsed_deletions, "none") is None and one(decide.parsed_deletions, '{"delete": 3}') is None
    assert one(decide.parsed_deletions, '{"delete": [1, "5", "x", true, 2.9, null, [7], 1, {"line_no": "8"}, {"other": 3}]}') == [1, 2, 8]
    assert one(decide.parsed_deletions, '{"delete": [4, {"line_no": "x"}, 5]}') == [4] and one(decide.parsed_deletions, '{"delete": []}') == []
    assert one(decide.parsed_deletions, '{"delete": [1]} and ```json\n{"delete": [2, 3]}\n```') == [2, 3]
    assert [one(decide.parsed_stop, x) for x in ("SHOULD_TERMINATE (NOT_TERMINATE was weighed)", "CONTINUE_PROCESSING, do not terminate", "should_terminate", "", None)] == [True, False, True, False, False]
    assert [one(decide.parsed_method, x) for x in ("METHOD_2", "METHOD 1 or so. METHOD: 2", "2\n\n\n\n\n\n\n", "2\na\nb\nc\nd\ne", "Method\u00a0: 2")] == [1, 2, 2, 1, 1]
    assert tuple(one(decide.parsed_more, "x NEED_MORE_LINES|TAIL|40 y")) == ("TAIL", 40) and one(decide.parsed_more, "need_more_lines|tail|4") is None
    assert one(decide.parsed_restores, '{"restore": [1, 2]}') == [1, 2]
    assert one(decide.parsed_judgment, "CONTAINS_ERROR, not NO_ERROR") is True
    assert [one(decide.parsed_method, x) for x in ("METHOD 2", "so\n2", "?")] == [2, 2, 1]
    ranged = lambda t: decide.parsed_ranges(t, F.lit(1), F.lit(9))
    assert [tuple(x) for x in one(ranged, "#2-3# #4-11# #8-5#")] == [(2, 3)]
    assert one(ranged, "#none#") == [] and [tuple(x) for x in one(ranged, "#ALL#")] == [(1, 9)]


def test_search(spark):
    out = search.search(lines_of(spark, ["a", "b Error", "c", "error"]), "error", context=1, first=1)
    assert got(out, "line_no", "total", "context") == [(2, 2, "    a\n>>> b Error\n    c")]


def test_scores(spark):
    make = lambda rows: spark.createDataFrame(rows, "file int, start int, end int")
    row = batch.line_scores(make([(1, 1, 4), (1, 3, 5)]), make([(1, 4, 8)])).first()
    assert (row.tp, row.fp, row.fn) == (2, 3, 3) and row.f1 == pytest.approx(0.4)


def test_cases(spark, tmp_path):
    at = tmp_path / "cases/basic/c++/a_b c/7/123"
    at.mkdir(parents=True)
    (at / "123~job~whole_log.txt").write_text("one\r\ntwo\n")
    (at / "123.json").write_text(json.dumps({"total_count": 1, "jobs": [{"id": 1, "steps": [{"name": "Run x", "conclusion": "failure"}, {"name": "y", "conclusion": "success"}]}]}))
    review = tmp_path / "human_review/basic/c++/a_b c/7/123"
    review.mkdir(parents=True)
    (review / "human_review.txt").write_text("[[1, 1], [2, 2]]")
    root = str(tmp_path / "cases")
    assert got(cases.discover(spark, root, language="c++"), "repository", "run_id", "file_name") == [("a_b c", "123", "123~job~whole_log.txt")]
    assert cases.discover(spark, root, limit=0).count() == 0
    assert got(cases.log_lines(spark, root), "line_no", "raw") == [(1, "one"), (2, "two")]
    meta = cases.metadata(spark, root)
    assert got(cases.failed_steps(meta), "name") == [("Run x",)] and cases.failed_steps(meta, nested=False).count() == 0
    found = cases.labels(spark, str(tmp_path / "human_review"))
    assert got(found, "start", "end") == [(1, 1), (2, 2)]
    assert value(spark, sinks.output_name, "123~job~whole_log.txt") == "123~job"
    sinks.write_summaries(sinks.summaries(found), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().error_ranges == [[1, 1], [2, 2]]
    assert sinks.previous_items(spark, str(tmp_path / "none")).count() == 0
    assert cases.keywords(spark, str(tmp_path / "none.json")) == ([], [])


def test_config():
    found = configured({"segmentation": {"k": 2}, "critical": ["${WORD}"], "server": {"a": 1}}, env={"WORD": "boom"})
    assert found.segmentation.k == 2 and found.critical == ("boom",) and found.extra == {"server": {"a": 1}} and found.windows.size == 300
    with pytest.raises(KeyError):
        configured({"segmentation": {"nope": 1}})


def test_sessions(spark, tmp_path):
    from loglattice.streaming.tail import sessions

    spark.sql("select 1 as file, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * if(id > 2, 100, 1)) as ts, 'error: x' as text from range(5)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file int, ts timestamp, text string").parquet(str(tmp_path / "in"))
    run = sessions(stream).writeStream.outputMode("append").format("memory").queryName("tailed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sessions(spark.read.parquet(str(tmp_path / "in"))).count() == 3
