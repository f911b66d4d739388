"""Golden questions and run files as JSON sources, and tables as Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanworks.operators.judging import in_order as in_priority
from gleanworks.session import staged

GOLDEN = (
    "id string, question string, expected_answer string, expected_pages array<bigint>, category string, difficulty string, type string,"
    " evidence array<struct<page:bigint,quote:string>>, alt_pages map<string,array<bigint>>, needs_review boolean"
)
CALL = (
    "struct<kind:string,name:string,model:string,input_tokens:bigint,output_tokens:bigint,units:bigint,latency_ms:double,cost_usd:double,error:string,fallback:boolean>"
)
#: Fields that every golden question has.
REQUIRED = ("id", "question", "expected_pages", "category", "difficulty", "type")
METRICS = ("page_hit", "page_recall", "reciprocal_rank", "cited_page_hit", "abstention_correct", "context_recall", "context_precision", "faithfulness", "answer_relevance")
RUN = (
    "run_id string, created_at string, git struct<commit:string,dirty:boolean>,"
    " config struct<name:string,mode:string,chunk_set:string,top_k:int,candidates:int,rrf_k:int,embedding_model:string,llm_model:string,reranker:string,"
    "rerank_candidates:int,tools:boolean,only:array<string>>,"
    " corpus struct<edition:int,sha256:string>, golden_set struct<sha256:string,count:int>,"
    " questions array<struct<id:string,question:string,type:string,category:string,difficulty:string,answerable:boolean,expected_pages:array<int>,"
    "retrieved:array<struct<chunk_id:bigint,page_start:int,page_end:int,rank:int,score:double,lexical_rank:int,vector_rank:int,fused_rank:int,rerank_score:double>>,"
    f"metrics:struct<{','.join(f'{m}:double' for m in METRICS)}>,review:struct<verdict:string,note:string>,error:string,"
    f"trace:struct<trace_id:string,latency_ms:double,cost_usd:double,calls:array<{CALL}>>>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, within the file, blank ones counted), value: the lines of text files, which are split.

    A split's lines are told apart by where it starts; the lines of the splits before it are counted, not read into one task.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    lines = staged(read, "lines")
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counted = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(counted, ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions of JSON-lines files, with file, line (from 1), and ``problem``: what a line lacks or has too much.

    Object keys of ``alt_pages`` are texts in JSON and numbers here. Large files are split, and lines keep their numbers.
    """
    schema = T._parse_datatype_string(GOLDEN).add("_corrupt", T.StringType())
    known = [f.name for f in schema.fields[:-1]]
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("item", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).withColumn("keys", F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    item = parsed.select("file", "line", "keys", "item.*")
    listed = lambda text, names: F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(F.array_sort(names), ", ")))
    broken = F.when(F.col("_corrupt").isNotNull(), F.concat(F.lit("not a golden question: "), F.substring("_corrupt", 1, 80)))
    unknown = listed("unknown fields: ", F.array_except("keys", F.array(*map(F.lit, known))))
    missing = listed("missing fields: ", F.array_except(F.array(*map(F.lit, REQUIRED)), "keys"))
    alternates = F.transform_keys("alt_pages", lambda k, _: k.cast("bigint"))
    problem = F.coalesce(broken, F.nullif(F.concat_ws("; ", unknown, missing), F.lit("")))
    return item.withColumn("alt_pages", alternates).withColumn("problem", problem).drop("_corrupt", "keys")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files of a folder; parts that older files lack are null."""
    return spark.read.schema(RUN).option("multiLine", True).option("recursiveFileLookup", False).json(path)


def in_order(runs: DataFrame) -> DataFrame:
    """Runs by the time they were made, then by id."""
    return runs.orderBy("created_at", "run_id")


def write_run(run: DataFrame, path: str) -> bool:
    """One run as one JSON file; false where the file that is there says the same, which is then left alone.

    The file is written beside ``path`` and takes its name when it is whole, so a failed write leaves
    the old one. A run is a row, its questions nested in it, so one task writes no more than that;
    more rows than one, or none, are refused.
    """
    if run.limit(2).count() != 1:
        raise ValueError("a file holds one run")
    spark = run.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folder, target = hadoop.Path(beside), hadoop.Path(path)
    files = folder.getFileSystem(conf)
    try:
        run.coalesce(1).write.json(beside)
        made = [f.getPath() for f in files.globStatus(hadoop.Path(f"{beside}/part-*"))]
        text = lambda p: spark.read.text(p, wholetext=True).first()  # noqa: E731 - one run
        if files.exists(target) and files.getFileStatus(target).isFile() and text(path) == text(made[0].toString()):
            return False
        how = getattr(hadoop, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(how, 1)
        over[0] = how.OVERWRITE
        context = hadoop.FileContext.getFileContext(files.getUri(), conf)
        context.rename(files.makeQualified(made[0]), files.makeQualified(target), over)
        return True
    finally:
        files.delete(folder, True)


def question_rows(runs: DataFrame) -> DataFrame:
    """A row per question of every run."""
    return runs.select("run_id", "created_at", F.col("config.name").alias("config"), F.col("config.only").alias("only"), F.explode("questions").alias("q")).select("run_id", "created_at", "config", "only", "q.*")


def run_aggregates(questions: DataFrame) -> DataFrame:
    """Means of all metrics and the manual pass rate of every run; nulls take no part."""
    verdict = F.col("review.verdict")
    return questions.groupBy("config", "run_id").agg(
        F.count("*").alias("n"),
        *[F.avg(f"metrics.{m}").alias(m) for m in METRICS],
        F.try_divide(F.count_if(verdict == "pass"), F.count(verdict)).alias("manual_pass"),
        F.count(verdict).alias("reviewed"),
        F.count("error").alias("errors"),
    )


def call_rows(questions: DataFrame) -> DataFrame:
    """A row per traced call."""
    return questions.where("trace is not null").select("run_id", "config", F.col("id").alias("question"), "trace.trace_id", F.explode("trace.calls").alias("c")).select("run_id", "config", "question", "trace_id", "c.*")


def markdown(table: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown text; ``most`` rows at the most, by a guard that fails beyond."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to print")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join("—" if v is None else str(v) for v in row) + " |" for row in rows])


def scoreboard(report: DataFrame, first: tuple[str, ...] = (), details: dict[str, DataFrame] | None = None) -> str:
    """A run report as Markdown: a headline table in a fixed order, then a table for each detail that has rows."""
    order = in_priority(F.col("config"), first)
    parts = ["# Scoreboard", markdown(report.orderBy(*order))]
    for name, rows in (details or {}).items():
        if not rows.isEmpty():
            parts += [f"## {name}", markdown(rows)]
    return "\n\n".join(parts) + "\n"


def block_differs(text: str, name: str, block: str) -> bool:
    """Whether a file's marked block is not what it would be written as: a check that writes nothing."""
    return replace_block(text, name, block) != text


def replace_block(text: str, name: str, block: str) -> str:
    """The text with what stands between the marks ``<!-- name -->`` and ``<!-- /name -->`` replaced."""
    start, end = f"<!-- {name} -->", f"<!-- /{name} -->"
    if start not in text or end not in text:
        raise ValueError(f"no marks for {name}")
    head, _, rest = text.partition(start)
    return f"{head}{start}\n{block}\n{end}{rest.partition(end)[2]}"
