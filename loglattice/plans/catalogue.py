"""Queries over the driver's tables, one for each operator, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as is_
from ..functions import text as T
from ..operators import batch, blocks, decide, prune, rangealg, ranges, search, segment, windows
from ..sources.synthetic import event_log
from . import oracle as O
from . import samples as S
from .methods import chosen_lines, error_ranges, judged_blocks, method_two

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE, STEP = 40, 28  # of windows over the short synthetic blocks


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.line_array(F.col("text"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def blocked(lines: DataFrame) -> DataFrame:
    return segment.in_blocks(lines)


# --- sources and text -------------------------------------------------------------


@query(f"WITH {O.DOC_LINES} SELECT doc_id, line_no, text FROM doc_lines")
def lines_explode(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query(f"WITH {O.DOC_LINES} SELECT doc_id, count(*) AS n_lines FROM doc_lines GROUP BY doc_id")
def lines_count_per_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.line_array(F.col("text"))).cast("long").alias("n_lines")).filter("n_lines > 0").groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"))


@query(f"WITH {O.LOG} SELECT file, line_no, regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g') AS clean FROM log")
def ansi_strip(spark, sf_dir):
    return log(spark, sf_dir).select("file", "line_no", T.without_colours(F.col("text")).alias("clean"))


@query(f"WITH {O.LOG} SELECT file, line_no, text AS clean FROM log")
def ts_strip(spark, sf_dir):
    return log(spark, sf_dir).select("file", "line_no", T.without_stamp(F.col("raw")).alias("clean"))


@query(f"WITH {O.LOG} SELECT file, line_no, rtrim(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g')) AS clean FROM log")
def preprocess_line(spark, sf_dir):
    return log(spark, sf_dir).select("file", "line_no", T.preprocessed(F.col("raw")).alias("clean"))


@query(f"WITH {O.LOG} SELECT file, line_no, replace(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g'), chr(7), '') AS clean, text || '|' || chr(13) AS shown FROM log WHERE text <> ''")
def escape_and_control_strip(spark, sf_dir):
    lines = log(spark, sf_dir).filter("text <> ''")
    noisy = F.concat(F.lit("\u0007"), F.col("text"), F.lit("\u001bM\u0001"))
    crlf = F.regexp_replace(T.unix_newlines(F.concat(F.col("text"), F.lit("|\r\n"))), "\n", "\r")
    return lines.select("file", "line_no", T.pruning_text(noisy).alias("clean"), crlf.alias("shown"))


@query(f"WITH {O.LOG} SELECT file, line_no, CASE WHEN text = '' THEN 'done' ELSE text END AS shown FROM log")
def carriage_return_overwrite(spark, sf_dir):
    over = F.concat(F.lit("10%\rdone\r"), F.col("text"))
    return log(spark, sf_dir).select("file", "line_no", T.overwritten(over).alias("shown"))


@query(f"WITH {O.DOC_LINES} SELECT doc_id, line_no, CASE WHEN length(text) > 200 THEN text[1:29] ELSE text END AS short, CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS shown FROM doc_lines")
def truncate_long_line(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", "line_no", T.truncated(F.col("text"), 200, 29).alias("short"), T.shortened(F.col("text"), 300).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 900 THEN text[1:300] || chr(10) || '... [' || (length(text) - 900) || ' characters omitted] ...' || chr(10) || right(text, 600) ELSE text END AS excerpt FROM documents")
def head_tail_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 900).alias("excerpt"))


@query(f"WITH {O.LOG} SELECT file, line_no, us FROM log")
def ts_parse_micros(spark, sf_dir):
    return log(spark, sf_dir).select("file", "line_no", T.stamp_micros(F.col("raw")).alias("us"))


# --- segmentation -----------------------------------------------------------------


@query(f"WITH {O.LOG}, {O.GAPS} SELECT file, line_no, gap_us FROM gaps")
def gap_intervals(spark, sf_dir):
    return segment.intervals(log(spark, sf_dir)).select("file", "line_no", "gap_us")


@query(f"WITH {O.LOG}, {O.GAPS}, {O.ROLL} SELECT file, line_no, n, CAST(s AS BIGINT) AS sum_us, CAST(q AS VARCHAR) AS sum_sq FROM roll")
def rolling_stats(spark, sf_dir):
    return segment.rolling(log(spark, sf_dir)).select("file", "line_no", "n", "sum_us", F.col("sum_sq").cast("string").alias("sum_sq"))


@query(f"WITH {O.LOG}, {O.SPLITS} SELECT file, line_no, gap_us FROM splits")
def split_points(spark, sf_dir):
    return segment.split_points(log(spark, sf_dir)).select("file", "line_no", "gap_us")


@query(f"WITH {O.LOG}, {O.BLOCKS} SELECT file, block_id, min(line_no) AS start, max(line_no) AS \"end\" FROM blocked GROUP BY file, block_id")
def segments(spark, sf_dir):
    return segment.segments(log(spark, sf_dir)).drop("timestamp_success")


@query(f"WITH {O.LOG}, {O.SPLITS}, c AS (SELECT file, count(*) AS k FROM splits GROUP BY file) SELECT g.file, count(*) AS n_gaps, CAST(sum(gap_us) AS BIGINT) AS sum_us, max(gap_us) AS max_us, min(gap_us) AS min_us, coalesce(any_value(k), 0) AS n_splits, coalesce(any_value(k), 0) + 1 AS n_blocks FROM gaps g LEFT JOIN c USING (file) GROUP BY g.file")
def segment_stats(spark, sf_dir):
    return segment.segment_stats(log(spark, sf_dir))


@query(f"WITH {O.LOG}, {O.GUARD} SELECT file, line_no, guarded FROM guard")
def indent_guard(spark, sf_dir):
    lines = log(spark, sf_dir)
    deep = lines.withColumn("text", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("\t"), F.col("text"))).otherwise(F.col("text")))
    return segment.guarded(deep).select("file", "line_no", "guarded")


@query("WITH " + O.LOG + " SELECT file, CAST(1 AS BIGINT) AS start, max(line_no) AS \"end\", false AS timestamp_success FROM log GROUP BY file")
def no_timestamp_fallback(spark, sf_dir):
    lines = log(spark, sf_dir).withColumn("us", F.lit(None).cast("long"))
    return segment.segments(lines).select("file", "start", "end", "timestamp_success")


# --- hits and blocks --------------------------------------------------------------


@query(f"WITH {O.LOG} SELECT file, line_no, {O.KEYWORD} AS critical, {O.WARNED} AS warned FROM log WHERE {O.KEYWORD} OR {O.WARNED}")
def keyword_hits(spark, sf_dir):
    text = F.col("text")
    marked = log(spark, sf_dir).select("file", "line_no", is_.has_keyword(text, P.CRITICAL_KEYWORDS).alias("critical"), is_.has_keyword(text, P.WARNING_KEYWORDS).alias("warned"))
    return marked.filter("critical or warned")


@query(f"WITH {O.LOG} SELECT file, line_no FROM log WHERE {O.IS_RED}")
def red_ansi_hits(spark, sf_dir):
    return log(spark, sf_dir).filter(is_.is_red(F.col("text"))).select("file", "line_no")


@query(f"WITH {O.LOG}, d AS (SELECT file * 1000 + line_no // 6 AS file, line_no, text FROM log), h AS (SELECT *, ({O.KEYWORD} OR {O.IS_RED}) AS f, {O.WARNED} AS w FROM d), c AS (SELECT *, count(*) FILTER (f) OVER (PARTITION BY file) AS n FROM h) SELECT file, line_no FROM c WHERE f OR (n < 2 AND w)")
def keyword_fallback(spark, sf_dir):
    short = log(spark, sf_dir).withColumn("file", (F.col("file") * 1000 + F.floor(F.col("line_no") / 6)).cast("long"))
    return blocks.hits(short).filter("hit").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.HITS}, g AS (SELECT file, line_no, line_no - row_number() OVER (PARTITION BY file ORDER BY line_no) AS k FROM hits WHERE hit) SELECT file, min(line_no) AS start, max(line_no) AS \"end\" FROM g GROUP BY file, k")
def hit_groups(spark, sf_dir):
    return rangealg.lines_to_ranges(blocks.hits(log(spark, sf_dir)).filter("hit"))


@query(f"WITH {O.LOG}, {O.BLOCKS}, {O.HITS} SELECT b.file, b.block_id, min(b.line_no) AS start, max(b.line_no) AS \"end\", count(*) FILTER (h.hit) AS n_hits FROM blocked b JOIN hits h USING (file, line_no) GROUP BY b.file, b.block_id HAVING count(*) FILTER (h.hit) > 0")
def block_filter(spark, sf_dir):
    return blocks.blocks_with_hits(blocks.hits(blocked(log(spark, sf_dir))))


# --- ranges -----------------------------------------------------------------------


@query(f"WITH {O.LOG}, {O.MARKS} SELECT e.file, e.line_no AS error_line, coalesce((SELECT max(g.line_no) FROM marks g WHERE g.file = e.file AND g.kind = 'group' AND g.line_no < e.line_no), 1) AS start FROM marks e WHERE e.kind = 'error'")
def error_to_group_asof(spark, sf_dir):
    return ranges.error_starts(log(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))


@query(f"WITH {O.LOG}, {O.MARKS}, t AS (SELECT file, max(line_no) AS n FROM log GROUP BY file) SELECT e.file, e.line_no AS error_line, CASE WHEN e.exits THEN e.line_no ELSE coalesce((SELECT min(g.line_no) - 1 FROM marks g WHERE g.file = e.file AND g.kind IN ('group', 'cleanup') AND g.line_no > e.line_no), t.n) END AS \"end\" FROM marks e JOIN t USING (file) WHERE e.kind = 'error'")
def range_end_forward(spark, sf_dir):
    lines = log(spark, sf_dir).withColumn("text", _varied())
    return ranges.error_ends(lines)


def _varied():
    """Every other exit-code marker becomes a plain error marker, so that range ends are looked up."""
    return F.when(F.col("text").startswith(P.EXIT_MARK) & (F.col("event_id") % 8 == 0), F.lit("##[error]stopped")).otherwise(F.col("text"))


@query(f"WITH {O.LOG}, {O.MARKS}, {O.RANGES} SELECT file, start, \"end\" FROM found")
def log_ranges(spark, sf_dir):
    return ranges.log_ranges(log(spark, sf_dir).withColumn("text", _varied())).select("file", "start", "end")


@query(f"WITH {O.LOG}, {O.MARKS}, {O.RANGES} SELECT file, start, \"end\", (SELECT min(m.line_no) FROM marks m WHERE m.file = f.file AND m.kind = 'endgroup' AND m.line_no BETWEEN f.start AND f.\"end\") AS workflow_end FROM found f")
def workflow_range(spark, sf_dir):
    return ranges.log_ranges(log(spark, sf_dir).withColumn("text", _varied())).select("file", "start", "end", "workflow_end")


@query(f"WITH {O.LOG}, {O.MARKS} SELECT e.file, e.line_no AS error_line, (SELECT max(g.line_no) FROM log g WHERE g.file = e.file AND g.line_no <= e.line_no AND (g.text LIKE '##[group]Run step 1%' OR g.text LIKE '##[group]Run step 7%')) AS step_start FROM marks e WHERE e.kind = 'error'")
def step_name_start(spark, sf_dir):
    steps = spark.createDataFrame([("Run step 1",), ("step 7",)], "name string")
    return ranges.step_starts(log(spark, sf_dir), steps)


@query(f"WITH {O.LOG}, {O.MARKS}, {O.RANGES}, u AS (SELECT DISTINCT file, start, \"end\" FROM found), w AS (SELECT file, start, \"end\", \"end\" - start + 1 AS n, unnest(range(0, CASE WHEN \"end\" - start + 1 <= 40 THEN 1 ELSE CAST(ceil((\"end\" - start + 1 - 40) / 36.0) AS BIGINT) + 1 END)) AS i FROM u) SELECT file, start, \"end\", start + i * 36 AS w_start, least(\"end\", start + i * 36 + 39) AS w_end FROM w")
def method_two_windows(spark, sf_dir):
    return method_two(log(spark, sf_dir).withColumn("text", _varied()), 40, 36)


# --- anchors, protection, pruning ---------------------------------------------------


@query(f"WITH {O.LOG}, {O.ANCHORS} SELECT file, line_no, p0, {O.P0_TYPE} AS anchor_type FROM anchors WHERE p0 IS NOT NULL")
def anchors_p0(spark, sf_dir):
    found = prune.anchored(log(spark, sf_dir)).filter("p0 is not null")
    return found.select("file", "line_no", "p0", is_.type_name(F.col("p0"), P.P0).alias("anchor_type"))


@query(f"WITH {O.LOG}, {O.ANCHORS} SELECT file, line_no, p1 FROM anchors WHERE p1 IS NOT NULL")
def anchors_p1(spark, sf_dir):
    return prune.anchored(log(spark, sf_dir)).filter("p1 is not null").select("file", "line_no", "p1")


@query(f"WITH {O.LOG}, {O.ANCHORS} SELECT {O.P0_TYPE} AS anchor_type, count(*) AS n, count(DISTINCT file) AS files FROM anchors WHERE p0 IS NOT NULL GROUP BY 1")
def anchor_type_counts(spark, sf_dir):
    found = prune.anchored(log(spark, sf_dir)).filter("p0 is not null")
    return found.groupBy(is_.type_name(F.col("p0"), P.P0).alias("anchor_type")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query(f"WITH {O.LOG} SELECT file, line_no, {O.STACK} AS stack, {O.COMMAND} AS command, {O.LOCATION} AS location, {O.ERROR_WORD} AS error_word, {O.EXCEPTION} AS exception, {O.NEW_ERROR} AS new_error, {O.CRITIC} AS critic, {O.SEPARATOR} AS separator, {O.PROGRESS} AS progress, {O.TELEMETRY} AS telemetry FROM log")
def line_predicates(spark, sf_dir):
    t = F.col("text")
    return log(spark, sf_dir).select("file", "line_no", is_.is_stack(t).alias("stack"), is_.is_command(t).alias("command"), is_.has_location(t).alias("location"), is_.is_error_related(t).alias("error_word"), is_.has_exception(t).alias("exception"), is_.is_new_error(t).alias("new_error"), is_.has_critic_word(t).alias("critic"), is_.is_separator(t).alias("separator"), is_.is_progress(t).alias("progress"), is_.is_telemetry(t).alias("telemetry"))


SMALL = prune.Settings(k_before=1, k_after=2, soft_window=4, far=2, near=1)


@query(f"WITH {O.LOG}, {O.PROTECT} SELECT file, line_no, hard FROM protect")
def hard_protect(spark, sf_dir):
    return prune.hard_protected(log(spark, sf_dir)).select("file", "line_no", "hard")


@query(f"WITH {O.LOG}, {O.PROTECT} SELECT file, line_no, located FROM protect_raw WHERE located")
def location_on_stamped_lines(spark, sf_dir):
    lines = log(spark, sf_dir).withColumn("text", F.col("raw"))
    return lines.select("file", "line_no", (is_.has_location(F.col("text")) & is_.is_error_related(F.col("text"))).alias("located")).filter("located")


@query(f"WITH {O.LOG}, {O.PROTECT} SELECT file, line_no FROM protect WHERE soft")
def soft_protect(spark, sf_dir):
    return prune.soft_protected(log(spark, sf_dir), SMALL).filter("soft").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.PROTECT} SELECT file, line_no FROM protect WHERE NOT hard")
def candidate_lines(spark, sf_dir):
    return prune.hard_protected(log(spark, sf_dir)).filter("not hard").select("file", "line_no")


def _safe(spark, sf_dir):
    return prune.safe_deletions(prune.soft_protected(log(spark, sf_dir), SMALL), SMALL)


@query(f"WITH {O.LOG}, {O.SAFE} SELECT file, line_no FROM safe WHERE blank_sep")
def safe_blank_sep(spark, sf_dir):
    return _safe(spark, sf_dir).filter("blank_sep").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.SAFE} SELECT file, line_no FROM safe WHERE progress")
def safe_progress(spark, sf_dir):
    return _safe(spark, sf_dir).filter("progress").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.SAFE} SELECT file, line_no FROM safe WHERE telemetry")
def safe_telemetry(spark, sf_dir):
    return _safe(spark, sf_dir).filter("telemetry").select("file", "line_no")


@query(f"WITH {O.DOC_LINES}, {O.runs('doc_lines', 'doc_id', 'false')} SELECT doc_id, line_no FROM runs_gone")
def safe_duplicates(spark, sf_dir):
    return rangealg.duplicate_runs(document_lines(spark, sf_dir), key="doc_id")


@query(f"WITH {O.LOG}, d AS (SELECT file, line_no, event_id % 16 = 3 AS hard, CASE WHEN event_id % 3 = 0 THEN 'same' ELSE ' same ' END AS text FROM log), {O.runs('d', 'file', 'hard')} SELECT file, line_no FROM runs_gone")
def safe_duplicates_hard(spark, sf_dir):
    lines = log(spark, sf_dir).withColumn("hard", F.col("event_id") % 16 == 3).withColumn("text", F.when(F.col("event_id") % 3 == 0, "same").otherwise(" same "))
    return rangealg.duplicate_runs(lines, "hard")


@query(f"WITH {O.LOG}, {O.SAFE} SELECT file, line_no, apart FROM safe")
def near_protected(spark, sf_dir):
    return _safe(spark, sf_dir).select("file", "line_no", "apart")


def _merged(spark, sf_dir):
    lines = _safe(spark, sf_dir)
    answers = log(spark, sf_dir).filter("line_no % 3 = 0").select("file", "line_no")
    asked = prune.proposals(lines, answers).withColumn("deleted", (F.col("safe") | F.col("proposed")) & ~F.col("hard"))
    return prune.merged_deletions(prune.critic_rules(asked))


@query(f"WITH {O.LOG}, {O.SAFE}, k AS (SELECT *, line_no % 2 = 0 OR ({O.CRITIC}) AS deleted FROM safe), l AS (SELECT *, bool_or(({O.CRITIC}) AND NOT deleted) OVER (PARTITION BY file * 1000 + line_no // 9) AS error_left FROM k) SELECT file, line_no FROM l WHERE deleted AND (hard OR (NOT error_left AND soft))")
def critic_rules(spark, sf_dir):
    lines = _safe(spark, sf_dir).withColumn("part", F.col("file") * 1000 + F.floor(F.col("line_no") / 9))
    lines = lines.withColumn("deleted", (F.col("line_no") % 2 == 0) | is_.has_critic_word(F.col("text")))
    return prune.critic_rules(lines, key="part").filter("restored").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE} SELECT file, line_no FROM gone WHERE gone")
def merge_delete(spark, sf_dir):
    return _merged(spark, sf_dir).filter("gone").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE}, i AS (SELECT file, line_no, line_no - row_number() OVER (PARTITION BY file ORDER BY line_no) AS k FROM gone WHERE gone) SELECT file, min(line_no) AS start, max(line_no) AS \"end\" FROM i GROUP BY file, k")
def irrelevant_ranges(spark, sf_dir):
    return prune.irrelevant_ranges(_merged(spark, sf_dir))


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE}, i AS (SELECT file, line_no, line_no - row_number() OVER (PARTITION BY file ORDER BY line_no) AS k FROM gone WHERE NOT gone) SELECT file, min(line_no) AS start, max(line_no) AS \"end\" FROM i GROUP BY file, k")
def kept_ranges(spark, sf_dir):
    lines = _merged(spark, sf_dir)
    whole = lines.groupBy("file").agg(F.lit(1).cast("long").alias("start"), F.max("line_no").alias("end"))
    return rangealg.kept_ranges(whole, lines.filter("gone").select("file", "line_no"))


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE} SELECT file, count(*) AS n_lines, count(*) FILTER (safe) AS n_safe, count(*) FILTER (hard) AS n_hard, count(*) FILTER (soft) AS n_soft, count(*) FILTER (gone) AS n_gone, count(p0) AS n_p0, count(p1) AS n_p1 FROM gone GROUP BY file")
def prune_stats(spark, sf_dir):
    return prune.prune_stats(_merged(spark, sf_dir))


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE} SELECT file, string_agg('[' || line_no || '] ' || text, chr(10) ORDER BY line_no) AS content FROM gone WHERE NOT gone GROUP BY file")
def pruned_content(spark, sf_dir):
    return prune.written_out(_merged(spark, sf_dir))


# --- windows ----------------------------------------------------------------------

_SEG = f"{O.BLOCKS}, seg AS (SELECT file, block_id, min(line_no) AS start, max(line_no) AS \"end\" FROM blocked GROUP BY file, block_id)"
_NWIN = f"CASE WHEN \"end\" - start + 1 <= {SIZE} THEN 1 ELSE CAST(ceil((\"end\" - start + 1 - {SIZE}) / {STEP}.0) AS BIGINT) + 1 END"


def _segments(spark, sf_dir):
    return segment.segments(log(spark, sf_dir)).drop("timestamp_success")


@query(f"WITH {O.LOG}, {_SEG}, w AS (SELECT file, start, \"end\", unnest(range(0, {_NWIN})) AS w FROM seg) SELECT file, start, w, start + w * {STEP} AS w_start, least(\"end\", start + w * {STEP} + {SIZE - 1}) AS w_end FROM w")
def block_windows(spark, sf_dir):
    return windows.windows(_segments(spark, sf_dir), SIZE, STEP).select("file", "start", "w", "w_start", "w_end")


@query(f"WITH {O.LOG}, {_SEG} SELECT file, start, \"end\" - start + 1 AS n_lines, {_NWIN} AS n_windows, ({_NWIN}) > 3 OR \"end\" - start + 1 > 120 AS keep_whole FROM seg")
def window_budget(spark, sf_dir):
    return windows.over_budget(_segments(spark, sf_dir), SIZE, STEP, 3, 120).select("file", "start", "n_lines", "n_windows", "keep_whole")


@query(f"WITH {O.LOG}, {_SEG}, w AS (SELECT file, start, \"end\", unnest(range(0, {_NWIN})) AS w FROM seg), c AS (SELECT l.file, l.line_no, w.w, (l.line_no * 7 + w.w) % 5 <> 0 AND (w.start + w.w) % 11 <> 0 AS gone FROM log l JOIN w ON w.file = l.file AND l.line_no BETWEEN w.start + w.w * {STEP} AND least(w.\"end\", w.start + w.w * {STEP} + {SIZE - 1})) SELECT file, line_no FROM c GROUP BY file, line_no HAVING bool_and(gone)")
def window_vote(spark, sf_dir):
    found = blocked(log(spark, sf_dir))
    from pyspark.sql import Window

    block = Window.partitionBy("file", "block_id")
    rows = found.select("file", "line_no", F.min("line_no").over(block).alias("start"), F.max("line_no").over(block).alias("end"))
    members = windows.memberships(rows, SIZE, STEP)
    gone = members.filter((F.col("line_no") * 7 + F.col("w")) % 5 != 0)
    failed = members.select("file", "start", "w").filter((F.col("start") + F.col("w")) % 11 == 0).distinct()
    return windows.votes(members, gone, failed)


@query(
    f"WITH RECURSIVE {O.LOG}, {_SEG}, b AS (SELECT file, list({{'s': start, 'e': \"end\"}} ORDER BY start) AS bs FROM seg WHERE block_id % 4 = 1 GROUP BY file),"
    " f AS (SELECT l.file, max(l.line_no) AS n, coalesce(any_value(b.bs), []) AS bs FROM log l LEFT JOIN b USING (file) GROUP BY l.file),"
    f" t AS (SELECT file, n, bs, CAST(1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS w_start, CAST(NULL AS BIGINT) AS w_end FROM f UNION ALL"
    f" SELECT file, n, bs, CASE WHEN met IS NOT NULL THEN met.e + 1 WHEN least(n, pos + {SIZE - 1}) = n THEN n + 1 ELSE pos + {STEP} END, CASE WHEN met IS NULL THEN pos END, CASE WHEN met IS NULL THEN least(n, pos + {SIZE - 1}) END"
    f" FROM (SELECT *, list_filter(bs, lambda x: x.s <= least(n, pos + {SIZE - 1}) AND x.e >= pos)[1] AS met FROM t) WHERE pos <= n)"
    " SELECT file, w_start, w_end FROM t WHERE w_start IS NOT NULL"
)
def file_windows_skip(spark, sf_dir):
    lines = log(spark, sf_dir)
    files = lines.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    return windows.file_windows(files, _segments(spark, sf_dir).filter("block_id % 4 = 1"), SIZE, STEP, 1_000_000)


@query(f"WITH {O.LOG}, n AS (SELECT file, max(line_no) AS n FROM log GROUP BY file), w AS (SELECT file, n, unnest(range(0, least(10000, CASE WHEN n <= 300 THEN 1 ELSE CAST(ceil((n - 300) / 270.0) AS BIGINT) + 1 END))) AS w FROM n) SELECT file, w * 270 + 1 AS w_start, least(n, w * 270 + 300) AS w_end FROM w")
def file_windows(spark, sf_dir):
    return windows.file_windows(log(spark, sf_dir).groupBy("file").agg(F.max("line_no").alias("n_lines")))


@query(f"WITH {O.LOG}, n AS (SELECT file, max(line_no) AS n FROM log GROUP BY file), w AS (SELECT file, n, unnest(range(0, least(10000, CASE WHEN n <= 300 THEN 1 ELSE CAST(ceil((n - 300) / 270.0) AS BIGINT) + 1 END))) AS w FROM n) SELECT file, w * 270 + 1 AS w_start, least(n, least(n, w * 270 + 300) + 300) AS f_end, greatest(1, w * 270 + 1 - 300) AS b_start FROM w")
def window_extensions(spark, sf_dir):
    files = log(spark, sf_dir).groupBy("file").agg(F.max("line_no").alias("n_lines"))
    return windows.stretched(windows.file_windows(files).join(files, "file")).select("file", "w_start", "f_end", "b_start")


# --- range algebra ----------------------------------------------------------------


def _ranges(spark, sf_dir, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(where)
    start = (F.col("l_orderkey") % 1000).cast("long")
    return rows.select(F.col("l_suppkey").cast("long").alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


_RANGES = "r AS (SELECT CAST(l_suppkey AS BIGINT) AS file, CAST(l_orderkey % 1000 AS BIGINT) AS start, CAST(l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS BIGINT) AS \"end\", l_linenumber FROM lineitem)"
_UNITED = "o AS (SELECT *, max(\"end\") OVER (PARTITION BY file ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), i AS (SELECT *, sum(CASE WHEN start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM o), united AS (SELECT file, min(start) AS start, max(\"end\") AS \"end\" FROM i GROUP BY file, k)"


@query(f"WITH {_RANGES}, p AS (SELECT * FROM r), {_UNITED} SELECT file, start, \"end\" FROM united")
def merge_ranges(spark, sf_dir):
    return rangealg.merged(_ranges(spark, sf_dir))


@query(f"WITH {_RANGES}, x AS (SELECT DISTINCT file, unnest(range(start, \"end\" + 1)) AS n FROM r), b AS (SELECT DISTINCT file, unnest([1, 600]) AS s FROM r), l AS (SELECT file, s AS b_start, unnest(range(s, s + 500)) AS n FROM b), k AS (SELECT l.*, n - row_number() OVER (PARTITION BY file, b_start ORDER BY n) AS g FROM l ANTI JOIN x USING (file, n)) SELECT file, CAST(b_start AS BIGINT) AS b_start, CAST(min(n) AS BIGINT) AS start, CAST(max(n) AS BIGINT) AS \"end\" FROM k GROUP BY file, b_start, g")
def subtract_ranges(spark, sf_dir):
    every = _ranges(spark, sf_dir)
    b = every.select("file").distinct().select("file", F.explode(F.array(F.lit(1).cast("long"), F.lit(600).cast("long"))).alias("start")).withColumn("end", F.col("start") + 499)
    return rangealg.subtracted(b, every).select("file", "b_start", "start", "end")


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, {'s': CAST(l_partkey % 100 AS BIGINT), 'e': CAST(l_partkey % 100 + CAST(l_quantity AS BIGINT) AS BIGINT), 'gone': false} AS x FROM lineitem),"
    " n AS (SELECT l_orderkey, x FROM r WHERE l_linenumber = 1), p AS (SELECT l_orderkey, list(x ORDER BY l_linenumber, x) AS ps FROM r WHERE l_linenumber > 1 GROUP BY l_orderkey),"
    " t AS (SELECT n.l_orderkey, CASE WHEN ps IS NULL THEN x ELSE list_reduce(list_prepend(x, ps), lambda a, b: CASE WHEN a.gone THEN a WHEN b.s <= a.s AND a.e <= b.e THEN {'s': a.s, 'e': a.e, 'gone': true}"
    " WHEN b.s <= a.s AND a.s <= b.e AND b.e < a.e THEN {'s': b.e + 1, 'e': a.e, 'gone': false} WHEN a.s < b.s AND b.s <= a.e AND a.e <= b.e THEN {'s': a.s, 'e': b.s - 1, 'gone': false} ELSE a END) END AS y FROM n LEFT JOIN p USING (l_orderkey))"
    " SELECT l_orderkey, y.s AS start, y.e AS \"end\" FROM t WHERE NOT y.gone AND y.s <= y.e"
)
def trim_vs_history(spark, sf_dir):
    s = (F.col("l_partkey") % 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e")).alias("x"))
    old = rows.filter("l_linenumber > 1").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "x"))).alias("old"))
    new = rows.filter("l_linenumber = 1").join(old, "l_orderkey", "left")
    earlier = F.coalesce(F.transform("old", lambda o: o["x"]), F.array().cast("array<struct<s:bigint,e:bigint>>"))
    out = new.select("l_orderkey", rangealg.trimmed_against(F.col("x"), earlier).alias("y"))
    return out.filter("y is not null").select("l_orderkey", F.col("y.s").alias("start"), F.col("y.e").alias("end"))


@query(f"WITH {_RANGES} SELECT file, start, \"end\" FROM r WHERE l_linenumber % 2 = 1 AND NOT EXISTS (SELECT 1 FROM r e WHERE e.l_linenumber % 2 = 0 AND e.file = r.file AND e.start <= r.start AND r.\"end\" <= e.\"end\")")
def drop_contained(spark, sf_dir):
    return rangealg.not_contained(_ranges(spark, sf_dir, "l_linenumber % 2 = 1"), _ranges(spark, sf_dir, "l_linenumber % 2 = 0"))


@query(f"WITH {_RANGES} SELECT DISTINCT file, unnest(range(start, \"end\" + 1)) AS line_no FROM r")
def ranges_to_lines(spark, sf_dir):
    return rangealg.ranges_to_lines(_ranges(spark, sf_dir))


# --- judgment ---------------------------------------------------------------------


@query(f"WITH {O.LOG}, {O.JUDGED} SELECT file, start, error, seq, CAST(errors AS BIGINT) AS errors, CAST(clean_run AS BIGINT) AS clean_run FROM judged")
def judgment_counter(spark, sf_dir):
    out = blocks.judged(judged_blocks(log(spark, sf_dir)))
    return out.select("file", "start", "error", F.col("seq").cast("long").alias("seq"), "errors", "clean_run")


@query(f"WITH {O.LOG}, {O.JUDGED} SELECT file, min(seq) FILTER (clean_run >= 2 AND errors > 0) AS stop_seq, count(*) AS n_blocks FROM judged GROUP BY file")
def hard_cutoff(spark, sf_dir):
    out = blocks.stops(blocks.judged(judged_blocks(log(spark, sf_dir))), 2)
    return out.select("file", F.col("stop_seq").cast("long").alias("stop_seq"), "n_blocks")


@query(f"WITH {O.LOG}, {O.JUDGED}, s AS (SELECT file, min(seq) FILTER (clean_run >= 2 AND errors > 0) AS stop_seq FROM judged GROUP BY file) SELECT file, count(*) AS n_visited, count(*) FILTER (error) AS with_error, count(*) FILTER (NOT error) AS without_error FROM judged JOIN s USING (file) WHERE stop_seq IS NULL OR seq <= stop_seq GROUP BY file")
def judgment_stats(spark, sf_dir):
    out = blocks.visited(blocks.judged(judged_blocks(log(spark, sf_dir))), 2)
    return out.groupBy("file").agg(F.count("*").alias("n_visited"), F.count_if("error").alias("with_error"), F.count_if(~F.col("error")).alias("without_error"))


@query(f"WITH {O.LOG}, {O.JUDGED} SELECT file, start, CAST(clean_run AS BIGINT) AS clean_run FROM judged WHERE NOT error AND clean_run > 1 AND clean_run % 2 = 0")
def soft_check_points(spark, sf_dir):
    return blocks.soft_checks(blocks.judged(judged_blocks(log(spark, sf_dir))), 1).select("file", "start", "clean_run")


@query(f"WITH {O.LOG}, {O.JUDGED}, {O.LIMITS} SELECT file, start, CAST(down AS BIGINT) AS max_down, CAST(10 - down AS BIGINT) AS max_up FROM limits")
def expansion_limits(spark, sf_dir):
    out = blocks.expansion_limits(judged_blocks(log(spark, sf_dir)))
    return out.select("file", "start", F.col("max_down").cast("long").alias("max_down"), F.col("max_up").cast("long").alias("max_up"))


@query(f"WITH {O.LOG}, {O.JUDGED}, {O.LIMITS}, x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start) AS i FROM limits) SELECT a.file, a.start, min(b.start) AS exp_start, max(b.\"end\") AS exp_end FROM x a JOIN x b ON a.file = b.file AND b.i BETWEEN a.i - (10 - a.down) AND a.i + a.down GROUP BY a.file, a.start")
def expanded_range(spark, sf_dir):
    out = blocks.expansion_limits(judged_blocks(log(spark, sf_dir)))
    return blocks.expanded(out, "max_up", "max_down").select("file", "start", "exp_start", "exp_end")


@query(f"WITH {O.LOG}, {O.JUDGED}, t AS (SELECT b.file, b.block_id, min(line_no) AS start, string_agg(b.text, chr(10) ORDER BY line_no) AS text FROM blocked b GROUP BY b.file, b.block_id) SELECT file, start, lag(text) OVER w AS \"before\", lead(text) OVER w AS \"after\" FROM t WINDOW w AS (PARTITION BY file ORDER BY start)")
def block_context(spark, sf_dir):
    return blocks.neighbours(search.block_texts(blocked(log(spark, sf_dir)))).select("file", "start", "before", "after")


# --- search and samples -------------------------------------------------------------


@query(f"WITH {O.LOG}, h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS nth, count(*) OVER (PARTITION BY file) AS total FROM log WHERE contains(lower(text), 'error')) SELECT h.file, h.line_no, any_value(h.total) AS total, string_agg((CASE WHEN l.line_no = h.line_no THEN '>>> ' ELSE '    ' END) || l.text, chr(10) ORDER BY l.line_no) AS context FROM h JOIN log l ON l.file = h.file AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 WHERE h.nth <= 10 GROUP BY h.file, h.line_no")
def search_context(spark, sf_dir):
    return search.search(log(spark, sf_dir), "Error")


@query(f"WITH {O.DOC_LINES}, n AS (SELECT doc_id, max(line_no) AS n FROM doc_lines GROUP BY doc_id) SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS snippet FROM doc_lines JOIN n USING (doc_id) WHERE line_no <= 2 OR line_no > n - 2 GROUP BY doc_id")
def head_tail_snippet(spark, sf_dir):
    return search.head_tail(document_lines(spark, sf_dir), 2, 2, "doc_id")


@query(f"WITH {O.LOG}, c AS (SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) AS i, count(*) OVER (PARTITION BY file) AS n FROM log WHERE text <> '') SELECT file, line_no FROM c WHERE n <= 31 OR i <= 15 OR i > n - 16")
def candidate_sample(spark, sf_dir):
    return search.sampled_ends(log(spark, sf_dir).filter("text <> ''"), 31).select("file", "line_no")


@query("SELECT conv_id, turn, role, nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 3")
def latest_history(spark, sf_dir):
    out = search.latest(table(spark, sf_dir, "conversations"), "turn", 3, "conv_id")
    return out.select("conv_id", "turn", "role", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {O.LOG}, n AS (SELECT file, max(line_no) AS n FROM log GROUP BY file) SELECT file, line_no, text FROM log JOIN n USING (file) WHERE line_no > n - 25 AND line_no <= n - 5")
def tail_cursor(spark, sf_dir):
    return search.next_lines(log(spark, sf_dir), 5, 20, tail=True).select("file", "line_no", "text")


@query(f"WITH {O.LOG}, {O.MARKS}, {O.RANGES}, u AS (SELECT DISTINCT file, start, \"end\" FROM found) SELECT u.file, u.start, u.\"end\", string_agg(l.text, chr(10) ORDER BY l.line_no) AS content FROM u JOIN log l ON l.file = u.file AND l.line_no BETWEEN u.start AND u.\"end\" GROUP BY u.file, u.start, u.\"end\"")
def range_content(spark, sf_dir):
    lines = log(spark, sf_dir)
    found = ranges.log_ranges(lines.withColumn("text", _varied()))
    return search.extracted(lines, found)


# --- answers ----------------------------------------------------------------------

_ANSWER = "CASE WHEN l_orderkey % 17 = 0 THEN 'see #all#' WHEN l_orderkey % 13 = 0 THEN '#NONE#' ELSE '#' || l_linenumber || '-' || CAST(l_quantity AS BIGINT) || '# and #' || (l_partkey % 50) || '-' || (l_partkey % 50 - 3 + l_linenumber) || '#' END"


@query(
    f"WITH a AS (SELECT row_number() OVER () AS i, l_orderkey, l_linenumber, {_ANSWER} AS t FROM lineitem), r AS (SELECT i, upper(t) AS u, unnest(regexp_extract_all(t, '#(\\d+)-(\\d+)#', 1)) AS s, unnest(regexp_extract_all(t, '#(\\d+)-(\\d+)#', 2)) AS e FROM a),"
    " x AS (SELECT i, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM r UNION ALL SELECT i, 2, 40 FROM a WHERE contains(upper(t), '#ALL#'))"
    " SELECT l_orderkey, l_linenumber, count(*) FILTER (s <= e AND s >= 2 AND e <= 40) AS n, coalesce(CAST(sum(s) FILTER (s <= e AND s >= 2 AND e <= 40) AS BIGINT), 0) AS sum_s, coalesce(CAST(sum(e) FILTER (s <= e AND s >= 2 AND e <= 40) AS BIGINT), 0) AS sum_e, count(*) FILTER (s <= e) AS n_free FROM a LEFT JOIN x USING (i) GROUP BY i, l_orderkey, l_linenumber"
)
def parse_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.expr(_ANSWER))
    tight, free = decide.parsed_ranges(F.col("t"), F.lit(2), F.lit(40)), decide.parsed_ranges(F.col("t"), F.lit(2), F.lit(40), bounded=False)
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[f])
    return rows.select("l_orderkey", "l_linenumber", F.size(tight).cast("long").alias("n"), total(tight, "s").alias("sum_s"), total(tight, "e").alias("sum_e"), F.size(free).cast("long").alias("n_free"))


_DELETE = "CASE o_orderkey % 5 WHEN 0 THEN 'ok ```json\n{\"delete\": [' || o_orderkey || ', 2]}\n``` done' WHEN 1 THEN '{\"delete\": [' || o_orderkey || ',3]}' WHEN 2 THEN 'x {\"delete\": [{\"line_no\": ' || o_orderkey || '}, 5]} y' WHEN 3 THEN 'nothing' ELSE '{\"note\": \"a\", \"delete\": [9]}' END"


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN 1 ELSE 2 END AS BIGINT) AS n, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderkey + 2 WHEN 1 THEN o_orderkey + 3 WHEN 2 THEN o_orderkey + 5 WHEN 4 THEN 9 END AS BIGINT) AS total FROM orders")
def parse_delete_json(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", decide.parsed_deletions(F.expr(_DELETE)))
    return rows.select("o_orderkey", F.when(F.col("d").isNotNull(), F.size("d")).cast("long").alias("n"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_METHOD = "CASE o_orderkey % 4 WHEN 0 THEN 'I say METHOD 2.' WHEN 1 THEN 'reasons\n 2 \nthat is all' WHEN 2 THEN 'no idea' ELSE 'method_1, not 2' END"


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 <= 1 THEN 2 ELSE 1 END AS BIGINT) AS method FROM orders")
def parse_method(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.parsed_method(F.expr(_METHOD)).alias("method"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS error FROM orders")
def parse_judgment(spark, sf_dir):
    answer = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'contains_error' WHEN 1 THEN 'It has NO_ERROR' WHEN 2 THEN 'NO_ERROR? CONTAINS_ERROR!' ELSE 'hm' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.parsed_judgment(answer).alias("error"))


@query(f"WITH {O.LOG}, {O.HITS}, {O.ANCHORS} SELECT file, CAST(CASE WHEN count(*) FILTER (hit) > 0 OR count(p0) > 0 THEN 1 ELSE 2 END AS BIGINT) AS method FROM hits JOIN anchors USING (file, line_no) GROUP BY file")
def classification_rule(spark, sf_dir):
    lines = prune.anchored(blocks.hits(log(spark, sf_dir)))
    return lines.groupBy("file").agg(decide.rule_method(F.count_if("hit"), F.count("p0")).cast("long").alias("method"))


# --- batches ----------------------------------------------------------------------

_STATUS = "CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'pending' ELSE 'success' END"


@query(f"SELECT o_orderpriority, count(*) AS total, count(*) FILTER (s = 'success') AS processed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'pending') AS pending, CAST(sum(o_orderkey % 1000) AS BIGINT) AS tokens, round(sum((o_orderkey % 500) / 8.0), 3) AS seconds, CASE WHEN count(*) FILTER (s = 'failed') > 0 THEN 'partial_failure' ELSE 'success' END AS final_status FROM (SELECT *, {_STATUS} AS s FROM orders) GROUP BY o_orderpriority")
def batch_summary(spark, sf_dir):
    items = table(spark, sf_dir, "orders").withColumns({"status": F.expr(_STATUS), "tokens": F.expr("o_orderkey % 1000"), "seconds": F.expr("CAST(o_orderkey % 500 AS DOUBLE) / 8.0")})
    return batch.batch_summary(items, ["o_orderpriority"])


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderkey % 3 <> 0")
def resume_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.select("o_orderkey").orderBy("o_orderkey").limit(500)
    return batch.pending(first, orders.filter("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'success' ELSE 'skipped' END AS status, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 WHEN o_orderkey % 5 = 0 THEN 7 END AS BIGINT) AS tokens FROM orders WHERE o_orderkey % 3 = 0")
def resume_coalesce(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    done = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'success' ELSE 'failed' END").alias("status"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END").alias("tokens"))
    old = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit(7).cast("long").alias("tokens"))
    out = batch.resumed(orders.select("o_orderkey"), done, old, ["o_orderkey"], ["tokens"])
    return out.withColumn("tokens", F.col("tokens").cast("long"))


@query("SELECT o_custkey, count(*) AS llm_call_count, round(sum((o_orderkey % 64) / 16.0), 3) AS llm_elapsed_seconds, CAST(sum(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1234 ELSE o_orderkey % 90 END) AS BIGINT) AS total_tokens, bool_or(o_orderkey % 4 <> 0) AS token_count_available FROM orders GROUP BY o_custkey")
def token_sum(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").withColumns({"elapsed_seconds": F.expr("CAST(o_orderkey % 64 AS DOUBLE) / 16.0"), "total_tokens": F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1,234' ELSE CAST(o_orderkey % 90 AS STRING) END")})
    return batch.call_stats(calls, ["o_custkey"])


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(user_id % 10 AS BIGINT))")
def composition_cube(spark, sf_dir):
    return batch.composition(table(spark, sf_dir, "events").withColumn("part", (F.col("user_id") % 10).cast("long")), "event_type", "part")


_PRF = f"{O.LOG}, {O.HITS}, {O.PROTECT}, b AS (SELECT h.file, count(*) FILTER (hit AND hard) AS tp, count(*) FILTER (hit AND NOT hard) AS fp, count(*) FILTER (hard AND NOT hit) AS fn FROM hits h JOIN protect USING (file, line_no) GROUP BY h.file)"


@query(f"WITH {_PRF} SELECT file, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS \"precision\", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM b")
def eval_line_prf(spark, sf_dir):
    lines = log(spark, sf_dir)
    found = rangealg.lines_to_ranges(blocks.hits(lines).filter("hit"))
    labelled = rangealg.lines_to_ranges(prune.hard_protected(lines).filter("hard"))
    return batch.line_scores(found, labelled)


# --- one line for each pattern -------------------------------------------------------


def _samples(spark) -> DataFrame:
    return spark.createDataFrame(S.lines(), "line_no long, text string")


@query(f"WITH {S.sql()}, a AS (SELECT *, {O.first(P.P0)} AS p0 FROM samples) SELECT line_no, p0, {O.P0_TYPE} AS anchor_type, CASE WHEN p0 IS NULL THEN {O.first(P.P1)} END AS p1 FROM a")
def pattern_samples(spark, sf_dir):
    return prune.anchored(_samples(spark)).select("line_no", "p0", is_.type_name(F.col("p0"), P.P0).alias("anchor_type"), "p1")


@query(f"WITH {S.sql()} SELECT line_no, {O.STACK} AS stack, {O.COMMAND} AS command, {O.LOCATION} AS location, {O.ERROR_WORD} AS error_word, {O.EXCEPTION} AS exception, {O.NEW_ERROR} AS new_error, {O.CRITIC} AS critic, {O.SEPARATOR} AS separator, {O.PROGRESS} AS progress, {O.TELEMETRY} AS telemetry, {O.IS_RED} AS red FROM samples")
def predicate_samples(spark, sf_dir):
    t = F.col("text")
    return _samples(spark).select("line_no", is_.is_stack(t).alias("stack"), is_.is_command(t).alias("command"), is_.has_location(t).alias("location"), is_.is_error_related(t).alias("error_word"), is_.has_exception(t).alias("exception"), is_.is_new_error(t).alias("new_error"), is_.has_critic_word(t).alias("critic"), is_.is_separator(t).alias("separator"), is_.is_progress(t).alias("progress"), is_.is_telemetry(t).alias("telemetry"), is_.is_red(t).alias("red"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || chr(13) || ' ' WHEN 1 THEN 'b' WHEN 2 THEN chr(13) ELSE 'c' END AS shown FROM orders")
def carriage_return_blank(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' \r ' WHEN 1 THEN 'a\rb\r' WHEN 2 THEN '\r' ELSE 'c' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.overwritten(text).alias("shown"))


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS stop FROM orders")
def parse_stop(spark, sf_dir):
    answer = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'should_terminate' WHEN 1 THEN 'CONTINUE_PROCESSING, do not terminate' WHEN 2 THEN 'SHOULD_TERMINATE (NOT_TERMINATE was weighed)' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.parsed_stop(answer).alias("stop"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'TAIL' END AS position, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 90 END AS lines FROM orders")
def parse_more(spark, sf_dir):
    answer = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'x NEED_MORE_LINES|HEAD|' || (o_orderkey % 90) WHEN 1 THEN 'NEED_MORE_LINES|TAIL|' || (o_orderkey % 90) || ' or NEED_MORE_LINES|HEAD|1' ELSE 'need_more_lines|HEAD|3' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.parsed_more(answer).alias("m")).select("o_orderkey", "m.position", "m.lines")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS BIGINT) AS method FROM orders")
def parse_method_forms(spark, sf_dir):
    answer = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'METHOD 1 or so. method: 2' WHEN 1 THEN 'MeThOd\t\n1' WHEN 2 THEN '2\n\n\n\n\n\n' WHEN 3 THEN 'METHOD_2\n1\nno' ELSE '2\na\nb\nc\nd\ne' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.parsed_method(answer, None).alias("method"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,2,8' WHEN 1 THEN '4' WHEN 2 THEN '' END AS lines FROM orders")
def parse_delete_entries(spark, sf_dir):
    answer = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN '{"delete": [1, "5", "x", true, 2.9, null, {"line_no": "8"}, {"b": 1}]}' WHEN 1 THEN '{"delete": [4, {"line_no": "x"}, 5]}' WHEN 2 THEN '{"delete": []}' ELSE '{"delete": 3}' END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(decide.parsed_deletions(answer), ",").alias("lines"))


_STEP_OF = "starts_with({t}, '##[group]Run step ' || (file + 1)) AND file <= 4"


def _steps(spark) -> DataFrame:
    return spark.createDataFrame([(f, f"Run step {f + 1}") for f in range(5)], "file long, name string")


@query(f"WITH {O.LOG}, {O.MARKS}, totals AS (SELECT file, max(line_no) AS n FROM log GROUP BY file), named AS (SELECT file, line_no FROM varied WHERE {_STEP_OF.format(t='t')}), begun AS (SELECT e.file, e.line_no, e.exits, coalesce((SELECT max(s.line_no) FROM named s WHERE s.file = e.file AND s.line_no <= e.line_no), (SELECT max(g.line_no) FROM marks g WHERE g.file = e.file AND g.kind = 'group' AND g.line_no < e.line_no), 1) AS start FROM marks e WHERE e.kind = 'error'), lasts AS (SELECT file, start, min(line_no) AS first, max(line_no) AS line_no, arg_max(exits, line_no) AS exits FROM begun GROUP BY file, start), found AS (SELECT l.file, l.start, l.first, CASE WHEN exits THEN l.line_no ELSE coalesce((SELECT min(g.line_no) - 1 FROM marks g WHERE g.file = l.file AND g.kind IN ('group', 'cleanup') AND g.line_no > l.line_no), t.n) END AS \"end\" FROM lasts l JOIN totals t USING (file)) SELECT file, start, \"end\", (SELECT min(m.line_no) FROM marks m WHERE m.file = f.file AND m.kind = 'endgroup' AND m.line_no BETWEEN f.start AND f.\"end\") AS workflow_end, row_number() OVER (PARTITION BY file ORDER BY first) AS seq FROM found f")
def step_ranges(spark, sf_dir):
    return ranges.log_ranges(log(spark, sf_dir).withColumn("text", _varied()), _steps(spark))


@query(f"WITH {O.LOG}, u AS (SELECT file, line_no, CASE WHEN starts_with(text, '##[error]') THEN 'plain' ELSE text END AS t FROM log), p AS (SELECT file, max(line_no) AS n, max(line_no) FILTER ({_STEP_OF.format(t='t')}) AS named_at FROM u GROUP BY file), r AS (SELECT file, coalesce(named_at, 1) AS start, named_at, coalesce((SELECT min(c.line_no) FROM u c WHERE c.file = p.file AND c.line_no >= p.named_at AND contains(c.t, 'Post job cleanup.')), n) AS \"end\" FROM p) SELECT file, start, \"end\", (SELECT min(m.line_no) FROM u m WHERE m.file = r.file AND starts_with(m.t, '##[endgroup]') AND m.line_no BETWEEN r.named_at AND r.\"end\") AS workflow_end, CAST(1 AS BIGINT) AS seq FROM r")
def unmarked_ranges(spark, sf_dir):
    plain = F.when(F.col("text").startswith(P.ERROR_MARK), F.lit("plain")).otherwise(F.col("text"))
    return ranges.log_ranges(log(spark, sf_dir).withColumn("text", plain), _steps(spark))


# --- statistics, corrections, causes ---------------------------------------------------


@query(f"WITH {O.LOG}, {O.JUDGED}, {O.HITS}, t AS (SELECT file, count(DISTINCT block_id) AS total_blocks FROM blocked GROUP BY file), p AS (SELECT b.file, count(DISTINCT b.block_id) AS planned_blocks FROM blocked b JOIN hits h USING (file, line_no) WHERE h.hit GROUP BY b.file), s AS (SELECT file, min(seq) FILTER (clean_run >= 2 AND errors > 0) AS stop_seq FROM judged GROUP BY file), v AS (SELECT file, count(*) AS visited_blocks, string_agg(start || '-' || \"end\", ',' ORDER BY start DESC) AS visited FROM judged JOIN s USING (file) WHERE stop_seq IS NULL OR seq <= stop_seq GROUP BY file) SELECT file, total_blocks, coalesce(planned_blocks, 0) AS planned_blocks, visited_blocks, visited FROM t LEFT JOIN p USING (file) JOIN v USING (file)")
def block_statistics(spark, sf_dir):
    lines = blocked(log(spark, sf_dir))
    seen = blocks.visited(blocks.judged(judged_blocks(log(spark, sf_dir))), 2)
    out = blocks.judgment_stats(lines, seen, blocks.blocks_with_hits(blocks.hits(lines)))
    return out.select("file", "total_blocks", "planned_blocks", "visited_blocks", F.array_join(F.transform("visited_detail", lambda r: F.concat(r[0], F.lit("-"), r[1])), ",").alias("visited"))


@query(O.FLAGSHIP.split("SELECT file, min(line_no) AS start, max(line_no)")[0] + ", t AS (SELECT file, count(*) AS total_log_lines FROM log GROUP BY file), c AS (SELECT file, count(DISTINCT part) AS n FROM chosen GROUP BY file), i AS (SELECT file, count(DISTINCT part) AS n FROM islands GROUP BY file) SELECT t.file, total_log_lines, coalesce(c.n, 0) AS total_error_blocks, coalesce(i.n, 0) AS pruned_blocks FROM t LEFT JOIN c ON c.file = t.file LEFT JOIN i ON i.file = t.file")
def extraction_stats(spark, sf_dir):
    lines = log(spark, sf_dir)
    return batch.extraction_stats(lines, chosen_lines(lines), error_ranges(lines), ["file"])


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS expansions, count(*) FILTER (o_orderkey % 3 = 1) AS modifications, count(DISTINCT o_orderkey % 7) FILTER (o_orderkey % 2 = 0) AS windows_with_errors FROM orders GROUP BY o_custkey")
def react_stats(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select("o_custkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'expand' WHEN 1 THEN 'modify' ELSE 'search' END").alias("tool"), F.expr("o_orderkey % 7").alias("window"), F.expr("o_orderkey % 2 = 0").alias("found"))
    return batch.react_stats(calls, ["o_custkey"])


@query("WITH v AS (SELECT o_custkey, o_orderkey % 5 AS id, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1, 2), e AS (SELECT DISTINCT o_custkey, o_orderkey % 5 AS id FROM orders) SELECT o_custkey, e.id, CASE WHEN version IS NULL THEN '3-9' ELSE '1-2;' || (version + 1) || '-' || (version + 3) END AS ranges, coalesce(version, 0) AS version FROM e LEFT JOIN v USING (o_custkey, id)")
def corrected_extractions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("id", F.expr("o_orderkey % 5"))
    found = orders.select("o_custkey", "id").distinct().withColumns({"start": F.lit(3), "end": F.lit(9)})
    answer = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '[[1,2],[' || (o_orderkey + 1) || ',' || (o_orderkey + 3) || ']]' WHEN 1 THEN '[[5,3]]' WHEN 2 THEN 'no' ELSE '[[1,2,3]]' END")
    out = search.corrected(found, orders.select("o_custkey", "id", F.col("o_orderkey").alias("version"), answer.alias("answer")), "o_custkey")
    return out.select("o_custkey", "id", F.array_join(F.transform("ranges", lambda r: F.concat(r[0], F.lit("-"), r[1])), ";").alias("ranges"), "version")


_PART = "(file * 1000 + line_no // 40)"


@query(f"WITH {O.LOG}, {O.ANCHORS}, g AS (SELECT *, {_PART} AS part, p0 IS NULL AND p1 IS NULL AS free FROM anchors), n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY line_no) AS nth FROM g WHERE line_no % 5 = 0), f AS (SELECT *, count(p0) OVER (PARTITION BY part) < 3 AS few, count(*) FILTER (free) OVER (PARTITION BY part ORDER BY line_no) AS k FROM g) SELECT file, line_no, EXISTS (SELECT 1 FROM n WHERE n.file = f.file AND n.line_no = f.line_no AND n.nth <= 2) AS asked FROM f WHERE few AND free AND (k <= 9 OR EXISTS (SELECT 1 FROM n WHERE n.file = f.file AND n.line_no = f.line_no AND n.nth <= 2))")
def asked_anchors(spark, sf_dir):
    lines = prune.anchored(log(spark, sf_dir)).withColumn("part", F.col("file") * 1000 + F.floor(F.col("line_no") / 40))
    answers = search.ranked(lines.filter("line_no % 5 = 0"), "part").select("part", "line_no", "nth")
    return prune.asked_anchors(lines, answers, shown=9, most=2, key="part").filter("shown or asked").select("file", "line_no", "asked")


@query(f"WITH {O.LOG}, {O.PROTECT}, n AS (SELECT *, bool_or(is_anchor) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM protect) SELECT file, line_no FROM n WHERE NOT hard AND NOT near AND ({O.SEPARATOR} OR regexp_matches(text, '^\\s*\\d+%\\s*$'))")
def strict_candidates(spark, sf_dir):
    return prune.strict_candidates(prune.hard_protected(log(spark, sf_dir)), 3).filter("strict").select("file", "line_no")


@query(f"WITH {O.LOG} SELECT file, line_no FROM log WHERE line_no % 2 = 0 AND ((file % 3 = 0 AND (contains(text, 'bad 7') OR contains(text, 'ValueError'))) OR (file % 3 = 1 AND contains(lower(text), 'exit code 1')) OR (line_no % 10 = 0 AND file = 2))")
def restored_lines(spark, sf_dir):
    lines = log(spark, sf_dir).withColumn("deleted", F.col("line_no") % 2 == 0)
    causes = lines.select("file").distinct().selectExpr("file", "CASE file % 3 WHEN 0 THEN 'bad 7' WHEN 2 THEN '' END AS message", "CASE WHEN file % 3 = 1 THEN 1 END AS exit_code", "'' AS command", "CASE WHEN file % 3 = 0 THEN 'ValueError' END AS exception", "'else' AS left_message", "CAST(NULL AS INT) AS left_exit_code", "'x' AS left_command", "'y' AS left_exception")
    out = prune.restored_by_cause(prune.restored_by_evidence(lines, lines.filter("line_no % 5 = 0 and file = 2")), causes)
    return out.filter("by_cause or by_evidence").select("file", "line_no")


@query(f"WITH {O.LOG}, {O.SAFE}, {O.GONE} SELECT file, string_agg('[' || line_no || '] ' || text, chr(10) ORDER BY line_no) FILTER (NOT gone) AS content, string_agg('[' || line_no || '] ' || text, chr(10) ORDER BY line_no) FILTER (gone) AS deleted_content FROM gone GROUP BY file")
def deleted_content(spark, sf_dir):
    return prune.written_out(_merged(spark, sf_dir), deleted=True)


@query(f"WITH {O.LOG}, {O.JUDGED}, x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start) AS i, row_number() OVER (PARTITION BY file ORDER BY start) % 4 = 0 AS wall FROM errs), y AS (SELECT *, max(CASE WHEN wall THEN i END) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, min(CASE WHEN wall THEN i END) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM x) SELECT a.file, a.start, min(b.start) AS exp_start, max(b.\"end\") AS exp_end FROM y a JOIN x b ON b.file = a.file AND b.i BETWEEN greatest(a.i - 2, coalesce(a.lo + 1, 1)) AND least(a.i + 3, coalesce(a.hi - 1, 1000000)) GROUP BY a.file, a.start")
def expanded_to_verified(spark, sf_dir):
    found = search.ranked(judged_blocks(log(spark, sf_dir)), "file", "start")
    out = blocks.expanded(found.withColumns({"wall": F.col("nth") % 4 == 0, "up": F.lit(2), "down": F.lit(3)}), verified="wall")
    return out.select("file", "start", "exp_start", "exp_end")


@query(f"WITH {O.LOG}, {O.BLOCKS}, t AS (SELECT file, block_id, min(line_no) AS start, string_agg(text, chr(10) ORDER BY line_no) AS text FROM blocked GROUP BY file, block_id), l AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start DESC) AS nth FROM t), s AS (SELECT *, CAST(greatest(90, 600 // count(*) OVER (PARTITION BY file)) AS BIGINT) AS m FROM l WHERE nth <= 3), c AS (SELECT *, CASE WHEN length(text) > m THEN left(text, m // 3) || chr(10) || '... [' || (length(text) - m) || ' characters omitted] ...' || chr(10) || right(text, m - m // 3) ELSE text END AS cut FROM s) SELECT file, string_agg(cut, chr(10) || chr(10) ORDER BY start) AS excerpt FROM c GROUP BY file")
def recent_excerpt(spark, sf_dir):
    return blocks.recent_excerpt(search.block_texts(blocked(log(spark, sf_dir))), 3, 600, 90)


# --- whole method -----------------------------------------------------------------


@query(O.FLAGSHIP)
def extracted_error_ranges(spark, sf_dir):
    return error_ranges(log(spark, sf_dir)).drop("block_id")
