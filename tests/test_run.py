"""From a folder of cases to summaries and scores; the model side; a line for each pattern."""

import json

import pytest
from pyspark.sql import functions as F

from loglattice.__main__ import arguments
from loglattice.functions import text as T
from loglattice.operators import agent, batch, blocks, prune, search
from loglattice.plans import run, samples
from loglattice.plans.config import env_file, loaded
from loglattice.plans.methods import error_ranges


def stamped(texts):
    return "\n".join(f"2024-01-01T00:00:{i:02d}.1234567Z {t}" for i, t in enumerate(texts)) + "\n"


@pytest.fixture
def bench(tmp_path):
    logs = {"1": ["##[group]Run x", "ok", "ValueError: bad", "    deep", "##[error]Process completed with exit code 1.", "Post job cleanup."], "2": ["a", "b", "c"]}
    for run_id, texts in logs.items():
        at = tmp_path / f"cases/basic/python/o_r/7/{run_id}"
        at.mkdir(parents=True)
        (at / f"{run_id}~job~whole_log.txt").write_text(stamped(texts))
    review = tmp_path / "human_review/basic/python/o_r/7/1"
    review.mkdir(parents=True)
    (review / "human_review.txt").write_text("[[3, 5]]")
    return tmp_path


def test_parse_and_evaluate(spark, bench):
    out = str(bench / "out")
    figures = run.parse_bench(spark, str(bench / "cases"), out)
    assert (figures["total"], figures["processed"], figures["final_status"]) == (2, 2, "success")
    found = {r.run_id: r for r in spark.read.json(f"{out}/summaries").collect()}
    assert found["1"].method_used == 1 and found["1"].statistics.total_log_lines == 6 and found["1"].statistics.total_error_blocks == 1
    assert found["2"].method_used == 2 and not found["2"].extracted_errors and found["2"].status == "success"
    covered = {n for x in found["1"].extracted_errors for a, b in x.error_ranges for n in range(a, b + 1)}
    assert {3, 4, 5} <= covered
    again = run.parse_bench(spark, str(bench / "cases"), out, resume=True)
    assert (again["processed"], again["skipped"]) == (0, 2) and spark.read.json(f"{out}/summaries").count() == 2
    scores, averages = run.evaluated(spark, out, str(bench / "human_review"))
    row = scores.first()
    assert row.tp == 3 and row.fn == 0 and {r.kind: r.recall for r in averages.collect()} == {"micro": 1.0, "macro": 1.0}
    assert run.parse_bench(spark, str(bench / "cases"), str(bench / "one"), method=2, limit=1)["total"] == 1
    assert spark.read.json(f"{bench}/one/summaries").first().extracted_errors[0].block == [3, 5]
    with pytest.raises(ValueError):
        run.parsed(spark.range(1))
    with pytest.raises(ValueError):
        run.evaluated(spark, str(bench / "nothing"), str(bench / "human_review"))


def test_one_scan_and_one_exchange(spark, tmp_path):
    spark.createDataFrame([(i % 3, i, i * 100_000, "ValueError: x" if i % 9 == 0 else "error") for i in range(60)], "file long, line_no long, us long, text string").write.parquet(str(tmp_path / "lines"))
    plan = error_ranges(spark.read.parquet(str(tmp_path / "lines")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_arguments():
    args = arguments(["parse", "in", "out", "--language", "c#", "--post-id", "7", "--resume"])
    assert (args.language, args.post_id, args.resume, args.limit) == ("c#", "7", True, None)


def test_settings_from_files(tmp_path):
    (tmp_path / ".env").write_text("# no\nWORD='boom'\nexport OTHER=2\n")
    (tmp_path / "a.json").write_text('{"critical": ["${WORD}"], "judgment": {"cutoff": 3}}')
    assert env_file(str(tmp_path / ".env")) == {"WORD": "boom", "OTHER": "2"} and env_file(str(tmp_path / "none")) == {}
    found = loaded(str(tmp_path / "a.json"), env={})
    assert found.critical == ("boom",) and found.judgment.cutoff == 3
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("windows:\n  size: 40\n")
    assert loaded(str(tmp_path / "a.yaml")).windows.size == 40


def test_every_pattern_has_a_line(spark):
    import re

    from loglattice.functions import patterns as P

    rows = prune.anchored(spark.createDataFrame(samples.lines(), "line_no long, text string")).orderBy("line_no").collect()
    hard = [r.p0 for r in rows[: len(samples.HARD)]]
    soft = [r.p1 for r in rows[len(samples.HARD) : len(samples.HARD) + len(samples.SOFT)]]
    assert hard == [i for i, _ in samples.HARD] and soft == [i for i, _ in samples.SOFT]
    # What no line has first is what an earlier pattern always has.
    assert set(range(1, len(P.P0) + 1)) - set(hard) == {35, 40, 52, 57, 60, 61, 63, 64, 72}
    for name, texts in samples.OTHER.items():
        either = re.I if name in ("ERROR_WORDS", "CRITIC_WORDS") else 0
        listed = [f"\x1b\\[{x}m" for x in P.RED] if name == "RED" else getattr(P, name, [])
        for pattern, text in zip(listed, texts, strict=name != "none"):
            assert re.search(pattern, text.strip() if name == "SEPARATOR" else text, either), (name, pattern)


def test_tools_and_retries():
    tools = agent.Tools()

    @tools.add
    def search_lines(keyword: str, count: int = 3) -> list:
        """Search."""
        return [keyword] * count

    assert tools.schemas()[0]["parameters"]["required"] == ["keyword"]
    assert json.loads(tools.call("search_lines", '{"keyword": "a", "count": 2}')) == ["a", "a"]
    for wrong in ('{"keyword": 3}', "{}", "no", '{"keyword": "a", "other": 1}', '{"keyword": "a", "count": true}'):
        assert "error" in json.loads(tools.call("search_lines", wrong))
    assert "error" in json.loads(tools.call("nothing", {}))
    answers = iter(["", "2"])
    assert agent.retried(lambda: next(answers), lambda x: int(x) if x else None) == (True, 2, "2")
    assert agent.retried(lambda: "", lambda x: None) == (False, None, "")
    with pytest.raises(PermissionError):
        agent.retried(lambda: (_ for _ in ()).throw(PermissionError()), lambda x: x)
    seen = []

    def model(messages, schemas):
        seen.append(len(schemas))
        return {"calls": [{"name": "search_lines", "arguments": {"keyword": "k"}}]} if schemas and len(seen) < 3 else {"text": messages[-1]["content"]}

    assert agent.converse(model, tools, "?") == '["k", "k", "k"]' and seen == [1, 1, 1]
    assert agent.converse(lambda m, s: {"calls": [{"name": "x"}]} if s else {"text": "end"}, tools, "?", limit=2) == "end"


def test_prompts_and_numbering(spark):
    row = spark.range(1).select(agent.filled("{a} and {b} {c}", a=F.lit("x"), b=3).alias("p"), T.pruning_lines(F.lit("a\x1b[0m\r\nb\rc\x07\n"), 5).alias("l")).first()
    assert row.p == "x and 3 {c}" and [tuple(x) for x in row.l] == [(5, "a"), (6, "b"), (7, "c"), (8, "")]


def test_models_second_thoughts(spark):
    lines = spark.createDataFrame([(1, i, t, i != 2) for i, t in enumerate(["exit code 2", "kept exit code 2", "run make", "x"], 1)], "file int, line_no int, text string, deleted boolean")
    schema = "file int, message string, exit_code int, command string, exception string, left_message string, left_exit_code int, left_command string, left_exception string"
    lost = spark.createDataFrame([(1, "", 2, "make", None, None, 3, "", "")], schema)
    same = spark.createDataFrame([(1, "", 2, "", None, "new", 2, "more", "new")], schema)
    back = lambda causes: [r.line_no for r in prune.restored_by_cause(lines, causes).filter("by_cause").orderBy("line_no").collect()]
    assert back(lost) == [1, 3] and back(same) == []
    found = spark.createDataFrame([(1, 1, 4, 9), (1, 2, 5, 6)], "file int, id int, start int, end int")
    said = spark.createDataFrame([(1, 1, 1, "[[1, 2]]"), (1, 1, 2, "[[3, 1]]"), (1, 2, 1, "[]"), (1, 1, 3, "[[2, 2], [4, 8]]"), (1, 1, 4, "oops")], "file int, id int, version int, answer string")
    out = {r.id: (r.ranges, r.version) for r in search.corrected(found, said).collect()}
    assert out == {1: ([[2, 2], [4, 8]], 3), 2: ([[5, 6]], 0)}


def test_expansion_stops_at_verified_blocks(spark):
    rows = spark.createDataFrame([(1, 10 * i, 10 * i + 9, i == 2, 9, 9) for i in range(6)], "file int, start int, end int, v boolean, up int, down int")
    got = {r.start: (r.exp_start, r.exp_end) for r in blocks.expanded(rows, verified="v").collect()}
    assert got == {0: (0, 19), 10: (0, 19), 20: (0, 59), 30: (30, 59), 40: (30, 59), 50: (30, 59)}


def test_statistics(spark):
    calls = spark.createDataFrame([(1, "expand", 1, True), (1, "expand", 1, True), (1, "modify", 2, False)], "run int, tool string, window int, found boolean")
    assert tuple(batch.react_stats(calls, ["run"]).first()) == (1, 2, 1, 1)
