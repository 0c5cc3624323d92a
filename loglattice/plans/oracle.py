"""Common table expressions of the DuckDB counterparts."""

from __future__ import annotations

from ..functions import patterns as P


def _any(listed: list[str], column: str = "text", options: str = "") -> str:
    joined = "|".join(f"(?:{x})" for x in listed).replace("'", "''")
    return f"regexp_matches({column}, '{joined}'" + (f", '{options}')" if options else ")")


LOG = r"""
ev AS (SELECT *, event_id % 101 AS nn, event_id % 4 AS m FROM events),
log AS (SELECT CAST(user_id % 10 AS BIGINT) AS file, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS line_no, epoch_us(ts) AS us, event_id,
  coalesce(CASE event_type
    WHEN 'click' THEN CASE m WHEN 0 THEN 'Downloading... ' || nn || '%' WHEN 1 THEN '[INFO] step ok' WHEN 2 THEN '[INFO] step ok' ELSE '(' || nn || '/100)' END
    WHEN 'view' THEN CASE m WHEN 0 THEN '##[group]Run step ' || nn WHEN 1 THEN '' WHEN 2 THEN '----------' ELSE 'Welcome to runner' END
    WHEN 'signup' THEN CASE m WHEN 0 THEN '##[endgroup]' WHEN 1 THEN 'npm notice update' WHEN 2 THEN '    at frame (app.js:1:2)' ELSE 'Post job cleanup.' END
    WHEN 'purchase' THEN CASE m WHEN 0 THEN '##[warning]slow' WHEN 1 THEN 'Warning: old api' WHEN 2 THEN 'value ' || nn ELSE chr(27) || '[31mred text ' || chr(27) || '[0m' END
    WHEN 'error' THEN CASE m WHEN 0 THEN '##[error]Process completed with exit code 1.' WHEN 1 THEN 'Traceback (most recent call last):' WHEN 2 THEN 'ValueError: bad ' || nn ELSE 'src/a.c:1:2: error: ' || nn END
  END, '') AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || text AS raw FROM ev)
"""

DOC_LINES = """
cut AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
doc_lines AS (SELECT doc_id, CAST(unnest(range(1, len(x) + 1)) AS BIGINT) AS line_no, unnest(x) AS text FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS x FROM cut))
"""

GAPS = "gaps AS (SELECT * FROM (SELECT file, line_no, us - lag(us) OVER (PARTITION BY file ORDER BY line_no) AS gap_us FROM log) WHERE gap_us IS NOT NULL)"
ROLL = "roll AS (SELECT *, count(*) OVER w AS n, sum(gap_us) OVER w AS s, sum(CAST(gap_us AS HUGEINT) * gap_us) OVER w AS q FROM gaps WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"
_ABOVE = "(n * {x} - s > 0 AND CAST(n * {x} - s AS HUGEINT) * CAST(n * {x} - s AS HUGEINT) * (n - 1) > 9 * n * (n * q - CAST(s AS HUGEINT) * CAST(s AS HUGEINT)))"
_INDENT = "coalesce(min(CASE WHEN {t} THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) = 1"
SPLITS = f"""{GAPS}, {ROLL}, plain_guard AS (SELECT file, line_no, {_INDENT.format(t="left(text, 1) IN (' ', chr(9))")} AS guarded FROM log),
splits AS (SELECT r.* FROM roll r JOIN plain_guard USING (file, line_no) WHERE n >= 2 AND gap_us >= 10000 AND {_ABOVE.format(x="gap_us")} AND NOT {_ABOVE.format(x="10000")} AND NOT guarded)"""
GUARD = f"guard AS (SELECT file, line_no, {_INDENT.format(t="event_id % 5 <> 0 OR left(text, 1) = ' '")} AS guarded FROM log)"
BLOCKS = f"{SPLITS}, blocked AS (SELECT l.*, CAST(sum(CASE WHEN s.line_no IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.file ORDER BY l.line_no) AS BIGINT) AS block_id FROM log l LEFT JOIN splits s ON s.file = l.file AND s.line_no = l.line_no)"


def _words(listed: list[str]) -> str:
    return "regexp_matches(lower(text), '(^|[^a-z0-9_])(" + "|".join(listed) + ")(''s)?($|[^a-z0-9_])')"


KEYWORD, WARNED = _words(P.CRITICAL_KEYWORDS), _words(P.WARNING_KEYWORDS)
IS_RED = "regexp_matches(text, '\\x1b\\[(" + "|".join(P.RED) + ")m')"
HITS = f"h0 AS (SELECT file, line_no, ({KEYWORD} OR {IS_RED}) AS f, {WARNED} AS w FROM log), hits AS (SELECT file, line_no, f OR (w AND count(*) FILTER (f) OVER (PARTITION BY file) < 2) AS hit FROM h0)"

MARKS = """
varied AS (SELECT file, line_no, event_id, CASE WHEN starts_with(text, '##[error]Process completed with exit code') AND event_id % 8 = 0 THEN '##[error]stopped' ELSE text END AS t FROM log),
marks AS (SELECT file, line_no, 'error' AS kind, starts_with(t, '##[error]Process completed with exit code') AS exits FROM varied WHERE starts_with(t, '##[error]')
  UNION ALL SELECT file, line_no, 'group', false FROM varied WHERE starts_with(t, '##[group]Run ')
  UNION ALL SELECT file, line_no, 'endgroup', false FROM varied WHERE starts_with(t, '##[endgroup]')
  UNION ALL SELECT file, line_no, 'cleanup', false FROM varied WHERE contains(t, 'Post job cleanup.'))
"""
RANGES = """
totals AS (SELECT file, max(line_no) AS n FROM log GROUP BY file),
begun AS (SELECT e.file, e.line_no, coalesce((SELECT max(g.line_no) FROM marks g WHERE g.file = e.file AND g.kind = 'group' AND g.line_no < e.line_no), 1) AS start FROM marks e WHERE e.kind = 'error'),
lasts AS (SELECT file, start, max(line_no) AS line_no FROM begun GROUP BY file, start),
found AS (SELECT l.file, l.start, CASE WHEN e.exits THEN l.line_no ELSE coalesce((SELECT min(g.line_no) - 1 FROM marks g WHERE g.file = l.file AND g.kind IN ('group', 'cleanup') AND g.line_no > l.line_no), t.n) END AS "end"
  FROM lasts l JOIN marks e ON e.kind = 'error' AND e.file = l.file AND e.line_no = l.line_no JOIN totals t ON t.file = l.file
  UNION ALL SELECT file, 1, n FROM totals WHERE file NOT IN (SELECT file FROM marks WHERE kind = 'error'))
"""


def first(listed: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join("WHEN " + _any([p], options="i") + f" THEN {i}" for i, (p, _) in enumerate(listed, 1)) + " END"


ANCHORS = f"anchors AS (SELECT *, CASE WHEN p0 IS NULL THEN {first(P.P1)} END AS p1 FROM (SELECT *, {first(P.P0)} AS p0 FROM log))"
P0_TYPE = "[" + ", ".join(f"'{t}'" for _, t in P.P0) + "][p0]"
STACK, COMMAND, LOCATION = _any(P.STACK), _any(P.COMMAND), _any(P.LOCATION)
ERROR_WORD, EXCEPTION, NEW_ERROR = _any(P.ERROR_WORDS, options="i"), _any(P.EXCEPTION_SIGNS), _any(P.NEW_ERROR)
CRITIC = _any(P.CRITIC_WORDS, options="i")
SEPARATOR = "(trim(text) = '' OR " + _any(P.SEPARATOR, "trim(text)") + ")"
PROGRESS, TELEMETRY = _any(P.PROGRESS), _any(P.TELEMETRY)

_BLANK = "trim(text) = ''"
_DEEP = "(starts_with(text, '    ') OR starts_with(text, chr(9)))"


def protect(source: str = "anchors", part: str = "file") -> str:
    """Hard and soft lines; the nearest anchor and stopper before a line are maxima of line numbers."""
    before = f"OVER (PARTITION BY {part} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
flags AS (SELECT *, p0 IS NOT NULL AS is_anchor, coalesce({P0_TYPE} = 'traceback', false) AS is_trace,
  NOT ({STACK}) AND NOT ({_BLANK}) AND (({NEW_ERROR}) OR NOT {_DEEP}) AS stops,
  ({STACK}) OR (NOT ({_BLANK}) AND NOT ({NEW_ERROR}) AND {_DEEP}) AS goes_on,
  NOT ({STACK}) AND NOT ({EXCEPTION}) AND NOT ({_BLANK}) AND starts_with(text, ' ') AND NOT starts_with(text, '  ') AS trace_stops,
  ({STACK}) OR ({EXCEPTION}) OR (NOT ({_BLANK}) AND NOT (starts_with(text, ' ') AND NOT starts_with(text, '  ')) AND regexp_matches(text, '\\w+(Error|Exception):')) AS in_trace,
  ({LOCATION}) AND ({ERROR_WORD}) AS located FROM {source}),
seen AS (SELECT *, coalesce(max(CASE WHEN is_anchor THEN line_no END) {before}, 0) AS a, coalesce(max(CASE WHEN stops THEN line_no END) {before}, 0) AS st,
  coalesce(max(CASE WHEN is_trace THEN line_no END) {before}, 0) AS tr, coalesce(max(CASE WHEN trace_stops THEN line_no END) {before}, 0) AS ts_ FROM flags),
hards AS (SELECT *, is_anchor OR (goes_on AND a > 0 AND a >= st AND line_no - a <= 99) OR (in_trace AND tr > 0 AND tr >= ts_ AND line_no - tr <= 49) OR located AS hard FROM seen)"""


def soft(part: str, before: int, after: int, half: int) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY line_no ROWS BETWEEN"
    return f"""
protect AS (SELECT *, NOT hard AND (bool_or(is_anchor) {w} {after} PRECEDING AND {before} FOLLOWING) OR bool_or(p1 IS NOT NULL) {w} {half} PRECEDING AND {half} FOLLOWING) OR ({COMMAND})) AS soft FROM hards)"""


PROTECT = f"{ANCHORS}, {protect()}, {soft('file', 1, 2, 2)}, protect_raw AS (SELECT file, line_no, {_any(P.LOCATION, 'raw')} AND {_any(P.ERROR_WORDS, 'raw', 'i')} AS located FROM log)"


def runs(source: str, part: str, hard: str) -> str:
    return f"""
runs_0 AS (SELECT {part}, line_no, trim(text) AS b, ({hard}) OR trim(text) = '' AS stop FROM {source}),
runs_1 AS (SELECT *, CASE WHEN stop OR coalesce(lag(stop) OVER w, true) OR b <> lag(b) OVER w THEN 1 ELSE 0 END AS fresh FROM runs_0 WINDOW w AS (PARTITION BY {part} ORDER BY line_no)),
runs_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {part} ORDER BY line_no) AS run FROM runs_1),
runs_gone AS (SELECT {part}, line_no FROM (SELECT *, min(line_no) OVER (PARTITION BY {part}, run) AS lo, max(line_no) OVER (PARTITION BY {part}, run) AS hi, count(*) OVER (PARTITION BY {part}, run) AS k FROM runs_2) WHERE NOT stop AND k >= 3 AND line_no > lo AND line_no < hi)"""


def safe(part: str, near: int, far: int) -> str:
    return f"""
spaced AS (SELECT *, CASE WHEN hard THEN 0 ELSE least(line_no - max(CASE WHEN hard THEN line_no END) OVER (PARTITION BY {part} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  min(CASE WHEN hard THEN line_no END) OVER (PARTITION BY {part} ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - line_no) END AS apart FROM protect),
{runs("spaced", part, "hard")},
tested AS (SELECT s.*, NOT hard AND {SEPARATOR} AND coalesce(apart > {near}, true) AS blank_sep, NOT hard AND {PROGRESS} AND coalesce(apart > {far}, true) AS progress, NOT hard AND {TELEMETRY} AND coalesce(apart > {far}, true) AS telemetry, r.line_no IS NOT NULL AS repeated
  FROM spaced s LEFT JOIN runs_gone r ON r.{part} = s.{part} AND r.line_no = s.line_no),
safe AS (SELECT *, NOT hard AND (blank_sep OR progress OR telemetry OR repeated) AS safe FROM tested)"""


SAFE = f"{PROTECT}, {safe('file', 1, 2)}"
GONE = f"""
asked AS (SELECT *, line_no % 3 = 0 AND NOT hard AS proposed FROM safe),
weighed AS (SELECT *, (safe OR proposed) AND NOT hard AS deleted FROM asked),
judged_lines AS (SELECT *, bool_or({CRITIC} AND NOT deleted) OVER (PARTITION BY file) AS error_left FROM weighed),
gone AS (SELECT *, (safe OR proposed) AND NOT (deleted AND (hard OR (NOT error_left AND soft))) AND NOT hard AS gone FROM judged_lines)"""

JUDGED = f"""{BLOCKS}, {ANCHORS},
errs AS (SELECT b.file, b.block_id, min(b.line_no) AS start, max(b.line_no) AS "end", bool_or(p0 IS NOT NULL) AS error FROM blocked b JOIN anchors USING (file, line_no) GROUP BY b.file, b.block_id),
backward AS (SELECT *, row_number() OVER w AS seq, sum(CASE WHEN error THEN 1 ELSE 0 END) OVER w AS errors FROM errs WINDOW w AS (PARTITION BY file ORDER BY start DESC)),
judged AS (SELECT *, sum(CASE WHEN error THEN 0 ELSE 1 END) OVER (PARTITION BY file, errors ORDER BY start DESC) AS clean_run FROM backward)"""
LIMITS = """
ahead AS (SELECT *, lead(error, 1) OVER w AS e1, lead(error, 2) OVER w AS e2, lead(error, 3) OVER w AS e3 FROM errs WINDOW w AS (PARTITION BY file ORDER BY start)),
limits AS (SELECT *, CASE WHEN e1 IS NULL THEN 1 WHEN e1 THEN 0 WHEN e2 IS NULL THEN 2 WHEN e2 THEN 1 WHEN e3 IS NULL THEN 3 WHEN e3 THEN 2 ELSE 3 END AS down FROM ahead)"""

FLAGSHIP = f"""WITH {LOG}, {BLOCKS}, {HITS}, {ANCHORS},
parts AS (SELECT a.*, b.file * 10000000 + b.block_id AS part, h.hit FROM anchors a JOIN blocked b USING (file, line_no) JOIN hits h USING (file, line_no)),
sums AS (SELECT file, part, min(line_no) AS start, bool_or(p0 IS NOT NULL) AS error, bool_or(hit) AS hit FROM parts GROUP BY file, part),
back AS (SELECT *, row_number() OVER w AS seq, sum(CASE WHEN error THEN 1 ELSE 0 END) OVER w AS errors FROM sums WHERE hit WINDOW w AS (PARTITION BY file ORDER BY start DESC)),
clean AS (SELECT *, sum(CASE WHEN error THEN 0 ELSE 1 END) OVER (PARTITION BY file, errors ORDER BY start DESC) AS clean_run FROM back),
stopped AS (SELECT file, min(seq) FILTER (clean_run >= 10 AND errors > 0) AS stop_seq FROM clean GROUP BY file),
chosen AS (SELECT p.* FROM parts p JOIN clean c USING (part) JOIN stopped s ON s.file = p.file WHERE c.error AND (stop_seq IS NULL OR seq <= stop_seq)),
{protect("chosen", "part")}, {soft("part", 20, 50, 10)}, {safe("part", 2, 20)},
islands AS (SELECT file, part, line_no, line_no - row_number() OVER (PARTITION BY part ORDER BY line_no) AS k FROM safe WHERE NOT safe)
SELECT file, min(line_no) AS start, max(line_no) AS "end" FROM islands GROUP BY file, part, k"""
