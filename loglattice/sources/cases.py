"""Cases on disk: {difficulty}/{language}/{repository}/{post_id}/{run_id}/ under three roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_array
from ..operators.batch import CASE

STEP = "struct<name:string,number:int,status:string,conclusion:string,started_at:string,completed_at:string>"
JOB = (
    "struct<id:bigint,run_id:bigint,run_attempt:int,node_id:string,name:string,workflow_name:string,head_branch:string,head_sha:string,"
    "status:string,conclusion:string,created_at:string,started_at:string,completed_at:string,run_url:string,url:string,html_url:string,check_run_url:string,"
    f"labels:array<string>,runner_id:bigint,runner_name:string,runner_group_id:bigint,runner_group_name:string,steps:array<{STEP}>>"
)
COMMIT = "struct<sha:string,zipball_api_url:string,tarball_api_url:string>"
METADATA = (
    f"total_count bigint, steps array<{STEP}>, jobs array<{JOB}>, code_download_links struct<repository:string,run_id:string,current_commit:{COMMIT},next_commit:{COMMIT},"
    "matching_source:struct<post_key:string,matching_posts_path:string,pull_request_html_url:string,pull_request_diff_url:string,workflow_run_api_url:string,workflow_run_html_url:string,workflow_name:string,workflow_conclusion:string>>"
)
LOG_SUFFIX = "~whole_log.txt"


def case_columns(path: Column) -> list[Column]:
    """The five parts of the case and the file name, from a decoded path; all are text."""
    parts = F.split(path, "/")
    return [F.element_at(parts, i - 6).alias(name) for i, name in enumerate([*CASE, "file_name"])]


def _glob(root: str, filters: dict[str, str | None], name: str) -> str:
    """A pattern that reads only the folders that exact filters leave; odd names are matched later by value."""
    plain = lambda x: x if x and not set(x) & set("*?[]{}\\,") else "*"
    return "/".join([root.rstrip("/"), *[plain(filters.get(c)) for c in CASE], name])


def texts(spark: SparkSession, root: str, name: str, **filters: str | None) -> DataFrame:
    """Case columns, file_name, path and content of files by pattern; a root without any gives no rows."""
    unknown = set(filters) - set(CASE)
    if unknown:
        raise ValueError(f"no part of a case: {sorted(unknown)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(_glob(root, filters, name))
    rows = files.select(*case_columns(F.col("path")), "path", F.col("content").cast("string").alias("content"))
    for column, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def discover(spark: SparkSession, root: str, limit: int | None = None, **filters: str | None) -> DataFrame:
    """Logs in the order of their paths, at most ``limit``; none for a limit of 0 or less."""
    logs = texts(spark, root, f"*{LOG_SUFFIX}", **filters).drop("content")
    if limit is not None and limit <= 0:
        return logs.limit(0)
    logs = logs.orderBy("path")
    return logs if limit is None else logs.limit(limit)


def log_lines(spark: SparkSession, root: str, **filters: str | None) -> DataFrame:
    """Case columns, file_name, line_no, raw: every line of every log, numbered from 1."""
    rows = texts(spark, root, f"*{LOG_SUFFIX}", **filters)
    return rows.select(*CASE, "file_name", F.posexplode(line_array(F.col("content"))).alias("i", "raw")).select(*CASE, "file_name", (F.col("i") + 1).alias("line_no"), "raw")


def metadata(spark: SparkSession, root: str, **filters: str | None) -> DataFrame:
    """One row for each {run_id}.json whose run_id is all digits; parsed with a fixed schema, null where it is no JSON."""
    rows = texts(spark, root, "*.json", **filters).filter(F.col("run_id").rlike("^[0-9]+$") & (F.col("file_name") == F.concat("run_id", F.lit(".json"))))
    return rows.select(*CASE, F.from_json("content", METADATA).alias("meta")).select(*CASE, "meta.*")


def failed_steps(meta: DataFrame, nested: bool = True) -> DataFrame:
    """Named steps that failed, a row each; ``nested`` reads them from jobs, otherwise from the top level."""
    steps = meta.select(*CASE, F.explode("jobs").alias("job")).select(*CASE, F.explode("job.steps").alias("step")) if nested else meta.select(*CASE, F.explode("steps").alias("step"))
    return steps.filter("step.conclusion = 'failure' and step.name <> ''").select(*CASE, F.col("step.name").alias("name"))


def labels(spark: SparkSession, root: str, **filters: str | None) -> DataFrame:
    """start and end of every labelled range."""
    rows = texts(spark, root, "human_review.txt", **filters)
    pairs = rows.select(*CASE, F.explode(F.from_json("content", "array<array<int>>")).alias("r"))
    return pairs.filter(F.size("r") == 2).select(*CASE, F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


def patches(spark: SparkSession, root: str, **filters: str | None) -> DataFrame:
    return texts(spark, root, "current_to_next.diff", **filters).select(*CASE, F.col("content").alias("patch"))


def keywords(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Critical and warning keywords of a JSON file; empty lists where it cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("critical_keywords array<string>, warning_keywords array<string>").json(path, multiLine=True).first()
    except AnalysisException:
        row = None
    return (list(row[0] or []), list(row[1] or [])) if row else ([], [])
