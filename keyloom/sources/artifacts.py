"""Job artifacts: per-url results, manifest, combined rows and failures, written and read back by job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import dims
from keyloom.functions.tables import dealt
from keyloom.operators.jobs import DONE, job_status
from keyloom.sources import scan

ROW = "struct<" + ",".join(f"{c}:{'boolean' if c == 'quality_warning' else 'string'}" for c in dims.EXPORT_COLUMNS) + ">"
RESULT = f"job_id string, url_task_id string, raw_url string, page_class string, status string, failure_code string, rows array<{ROW}>"


def write_job(results: DataFrame, folder: str) -> None:
    """Results (RESULT columns) by job, then what is made of them: combined successes, flat CSV, failures and a manifest."""
    results.write.mode("overwrite").partitionBy("job_id").json(f"{folder}/results")
    done = results.where(F.col("status").isin(*DONE))
    done.write.mode("overwrite").partitionBy("job_id").json(f"{folder}/combined")
    done.select("job_id", F.explode("rows").alias("r")).select("job_id", "r.*").write.mode("overwrite").partitionBy("job_id").option("header", True).option("emptyValue", "").csv(f"{folder}/csv")
    results.where(~F.col("status").isin(*DONE)).select("job_id", "url_task_id", "raw_url", "failure_code").write.mode("overwrite").partitionBy("job_id").json(f"{folder}/failures")
    manifest(results).write.mode("overwrite").json(f"{folder}/manifest")


def manifest(results: DataFrame) -> DataFrame:
    """Counts and status of each job's results (job_id, status)."""
    ok = F.count_if(F.col("status").isin(*DONE))
    counts = results.groupBy("job_id").agg(F.count("*").alias("submitted"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"))
    return counts.withColumn("status", job_status(F.col("succeeded"), F.col("failed")))


def read_job(spark: SparkSession, folder: str) -> DataFrame:
    """Combined successes, or if those are missing the successes among the per-url results."""
    try:
        return spark.read.schema(RESULT).json(f"{folder}/combined")
    except AnalysisException:
        return spark.read.schema(RESULT).json(f"{folder}/results").where(F.col("status").isin(*DONE))


def evaluation_rows(results: DataFrame) -> DataFrame:
    """Rows of successes in order, for evaluation: the eight exported columns with url_task_id and ord."""
    return results.select("job_id", "url_task_id", "page_class", F.posexplode("rows").alias("ord", "r")).select("job_id", "url_task_id", "page_class", "ord", "r.*")


# -- results by manifest

#: One item of a manifest: where the result of a task lies.
ITEM = "job_id string, url_task_id string, status string, artifact string"
#: Folders that a manifest's files may lie in; they are read together.
MOST_FOLDERS = 1000


def write_items(results: DataFrame, folder: str) -> None:
    """The result of every task (RESULT) in a place of its own, and a manifest (ITEM) of where that is, relative to ``folder``."""
    place = F.concat(F.lit("per_url/job_id="), "job_id", F.lit("/url_task_id="), "url_task_id")
    # as many files as tasks: written by all cores, and moved to their places by the tasks that wrote them, not one by one by the driver
    copy = dealt(results, "job_id", "url_task_id").withColumns({"job": F.col("job_id"), "task": F.col("url_task_id")})
    copy.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("job_id", "url_task_id").json(f"{folder}/per_url")
    results.select("job_id", "url_task_id", "status", place.alias("artifact")).write.mode("overwrite").json(f"{folder}/manifest_items")


def write_combined(results: DataFrame, folder: str) -> None:
    """Successes of each job together."""
    results.where(F.col("status").isin(*DONE)).write.mode("overwrite").partitionBy("job_id").json(f"{folder}/combined")


def _bare(path: Column) -> Column:
    """A path without its scheme, however many slashes follow that."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/+$", "")


def read_items(spark: SparkSession, items: DataFrame, base: str) -> DataFrame:
    """What the items (ITEM) of a manifest name: their columns, ``payload`` (the JSON text, null if there is none) and ``error``.

    An artifact is a web address, an address in a store, or a path relative to ``base``; it is a file, or a folder with one. Files
    are read together from the folders they lie in and meet the items by their path; addresses are fetched by host.
    """
    blank = F.nullif(F.trim("artifact"), F.lit(""))
    remote = F.coalesce(blank.rlike("(?i)^https?://"), F.lit(False))
    stored = F.when(blank.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), blank).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(blank, "^/+", "")))
    named = items.withColumn("at_", F.when(remote, blank).otherwise(stored))
    files = named.where(~remote & blank.isNotNull())
    # the folder above the one an artifact lies in: as many as there are jobs at most, and mostly one for each kind
    roots = [r.root for r in files.select(F.regexp_replace("at_", "(/[^/]*){2}$", "").alias("root")).distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(roots) > MOST_FOLDERS:
        raise ValueError(f"a manifest names files in more than {MOST_FOLDERS} folders; read its jobs in parts")
    there = [r for r in roots if _exists(spark, r)]
    if there:
        texts = spark.read.option("recursiveFileLookup", True).text(there, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
        path = _bare(F.coalesce(F.try_url_decode("p"), "p"))
        found = texts.select(F.explode(F.array(path, F.regexp_replace(path, "/[^/]*$", ""))).alias("key_"), "value").where("value <> ''")
        found = found.groupBy("key_").agg(F.min("value").alias("payload"))
    else:
        found = spark.createDataFrame([], "key_ string, payload string")
    own = files.withColumn("key_", _bare(F.col("at_"))).join(found, "key_", "left").drop("key_")
    error = F.when(F.col("payload").isNull(), F.concat(F.lit("no artifact at "), "at_"))
    out = own.withColumn("error", error)
    web = named.where(remote)
    if not web.isEmpty():
        got = scan.pages_of(scan.scan_pages(web, "at_")).select(F.col("raw_url").alias("at_"), F.when(F.col("http_status") < 400, F.col("html")).alias("payload"), F.coalesce("error", F.when(F.col("http_status") >= 400, F.concat(F.lit("status "), "http_status"))).alias("error"))
        out = out.unionByName(web.join(got, "at_", "left"))
    lost = named.where(blank.isNull()).withColumns({"payload": F.lit(None).cast("string"), "error": F.lit("no artifact named")})
    return out.unionByName(lost).drop("at_")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Results of jobs (RESULT, ``source``, ``error``): of a job that has a combined file its successes there, of every other what its manifest's items name.

    The manifest's status counts, where it has one. An artifact that is missing or broken is a row with an error.
    """
    items = spark.read.schema(ITEM).json(f"{folder}/manifest_items")
    combined = spark.read.schema(RESULT).json(f"{folder}/combined") if _exists(spark, f"{folder}/combined") else spark.createDataFrame([], RESULT)
    rest = items.join(combined.select("job_id").distinct(), "job_id", "left_anti")
    read = read_items(spark, rest, folder).withColumn("r_", F.from_json("payload", RESULT))
    error = F.coalesce("error", F.when(F.col("r_.raw_url").isNull(), "not a result"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.col("r_.status"))
    made = read.select("job_id", "url_task_id", "r_.raw_url", "r_.page_class", status.alias("status"), "r_.failure_code", "r_.rows", F.lit("manifest").alias("source"), error.alias("error"))
    return combined.withColumns({"source": F.lit("combined"), "error": F.lit(None).cast("string")}).select(*made.columns).unionByName(made)
