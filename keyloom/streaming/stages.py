"""The service's three queues as streams from files to files: collection, aggregation, notification.

All lies under one root folder:

| folder | rows |
|-|-|
| ``jobs``, ``tasks`` | what was submitted (JOB, TASK) |
| ``queue/collection``, ``queue/aggregation``, ``queue/notification`` | messages, as JSON files |
| ``results`` | one row per task that was worked on (RESULT), in buckets of jobs |
| ``cache`` | rows of a page for one platform (COMPONENT) |
| ``finished``, ``artifacts``, ``outbox`` | summaries of ended jobs, their files, and notices |

Messages come at least once. A micro-batch writes each of its outputs into a folder named after it, which
counts from the moment it is complete; a batch that is run again finds it and leaves it, and what it lacks is made
from what there is. A message that comes again in a later batch is dropped by keyed state. So a
restart at any point changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import web
from keyloom.operators import intents, jobs, resolve
from keyloom.operators.jobs import DONE
from keyloom.sources import artifacts
from keyloom.streaming.jobs import CACHED, EVENT, RECEIVED, SUMMARY, finished, first_of_key, read_events

JOB = "job_id string, mode string, submitted long, target string, ts timestamp"
TASK = "job_id string, task_id string, raw_url string, canonical_url string, mode string, generate string, ts timestamp"
MESSAGE = "job_id string, task_id string"
COMPONENT = f"canonical_url string, platform string, page_class string, rows array<{artifacts.ROW}>"
RESULT = f"job_id string, url_task_id string, raw_url string, canonical_url string, mode string, generate string, page_class string, status string, failure_code string, failure_detail string, hints array<string>, cache_hit boolean, rows array<{artifacts.ROW}>, bucket int"
NOTICE = "job_id string, status string, target string, payload string, sent_at timestamp"
SCHEMAS = {"jobs": JOB, "tasks": TASK, "cache": COMPONENT, "results": RESULT, "finished": SUMMARY, "outbox": NOTICE}
PLATFORMS = ("naver_sa", "google_sa")
#: Results lie in so many buckets of jobs; a batch reads those of its own jobs.
BUCKETS = 64

Fetch = Callable[[DataFrame], DataFrame]
#: From packs, a mode and a number of rows to rows and one report per url.
Generate = Callable[[DataFrame, str, int], tuple[DataFrame, DataFrame]]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _path(spark, path)
    return system.exists(at)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the root folder; without rows if nothing was written yet."""
    schema, path = SCHEMAS[name], f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


class Sink:
    """The outputs of one micro-batch: each is a folder of its own, written once."""

    def __init__(self, spark: SparkSession, root: str, token: str):
        self.spark, self.root, self.token = spark, root, token

    def put(self, name: str, made: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """Write ``made()`` unless that was done before, and read it back."""
        path, schema = f"{self.root}/{name}/batch={self.token}", SCHEMAS.get(name)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            writer = made().write.mode("overwrite")
            writer = writer.partitionBy(by) if by else writer
            (writer.parquet if schema else writer.json)(path)
        return self.spark.read.schema(schema).parquet(path) if schema else self.spark.read.json(path)

    def once(self, name: str, write: Callable[[str], None]) -> None:
        """Let ``write`` fill a folder, unless that was done before."""
        path = f"{self.root}/{name}/batch={self.token}"
        if not exists(self.spark, f"{path}/_done"):
            write(path)
            system, at = _path(self.spark, f"{path}/_done")
            system.create(at, True).close()


def _token(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint: the batches of another checkpoint are other batches."""
    system, at = _path(spark, f"{checkpoint}/_sink")
    if not system.exists(at):
        out = system.create(at, True)
        out.write(bytearray(uuid.uuid4().hex[:12], "ascii"))
        out.close()
    back = system.open(at)
    try:
        return bytes(back.readAllBytes()).decode("ascii")
    finally:
        back.close()


def _stage(stream: DataFrame, root: str, name: str, work: Callable[[DataFrame, Sink], None]) -> None:
    """Work off all messages there are."""
    spark, checkpoint = stream.sparkSession, f"{root}/checkpoints/{name}"
    token = _token(spark, checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        # all of the batch is taken from the keyed state, once, whatever of its outputs are there already
        own, inbox = rows.sparkSession, f"{checkpoint}/inbox"
        rows.write.mode("overwrite").parquet(inbox)
        held = own.read.schema(rows.schema).parquet(inbox)
        if not held.isEmpty():
            work(held, Sink(own, root, f"{token}-{number:09d}"))

    stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _bucket(job: Column) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def _of_jobs(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results of the jobs in ``wanted``, from their buckets alone; of a task that was done twice the first in order of status counts."""
    buckets = [r.b for r in wanted.select(_bucket(F.col("job_id")).alias("b")).distinct().collect()]  # at most BUCKETS
    own = results.where(F.col("bucket").isin(buckets)).join(wanted.select("job_id").distinct(), "job_id", "left_semi")
    return own.dropDuplicates(["job_id", "url_task_id"])


# -- submission


def submit(requests: DataFrame, root: str, name: str) -> None:
    """Register the jobs of checked requests (job_id, urls, mode, target, ts) and send their first messages.

    ``name`` names the submission: one that is repeated changes nothing. Pages whose wanted rows are all cached
    are done at once; if one of two platforms is cached, the other is generated.
    """
    spark = requests.sparkSession
    sink = Sink(spark, root, f"submitted-{name}")
    sink.put("jobs", lambda: requests.select("job_id", "mode", F.size("urls").cast("long").alias("submitted"), "target", "ts"))

    def routed() -> DataFrame:
        each = requests.select("job_id", "mode", "ts", F.posexplode("urls").alias("i", "raw_url"))
        named = each.withColumn("task_id", F.concat(F.lit("ut_"), "job_id", F.lit("_"), F.lpad((F.col("i") + 1).cast("string"), 2, "0"))).withColumn("canonical_url", web.canonical_url(F.col("raw_url")))
        held = table(spark, root, "cache").groupBy("canonical_url").agg(F.collect_set("platform").alias("held"))
        wanted = F.when(F.col("mode") == "both", F.array(*map(F.lit, PLATFORMS))).otherwise(F.array("mode"))
        lacking = F.array_except(wanted, F.coalesce("held", F.array().cast("array<string>")))
        need = F.when(F.size(lacking) == 0, "").when(F.size(lacking) == 2, "both").otherwise(F.get(lacking, F.lit(0)))
        return named.join(held, "canonical_url", "left").select("job_id", "task_id", "raw_url", "canonical_url", "mode", need.alias("generate"), "ts")

    tasks = sink.put("tasks", routed)
    hits, misses = tasks.where("generate = ''"), tasks.where("generate <> ''")
    done = sink.put("results", lambda: _with_cached(hits, table(spark, root, "cache"), cached=True), by="bucket")
    sizes = table(spark, root, "jobs").select("job_id", "submitted")
    begun = tasks.join(sizes, "job_id").select("job_id", "task_id", F.lit(RECEIVED).alias("status"), "submitted", "ts")
    hit = done.join(tasks.select("job_id", F.col("task_id").alias("url_task_id"), "ts"), ["job_id", "url_task_id"]).select("job_id", F.col("url_task_id").alias("task_id"), "status", F.lit(None).cast("long").alias("submitted"), "ts")
    sink.put("queue/aggregation", lambda: begun.unionByName(hit))
    sink.put("queue/collection", lambda: misses.select("job_id", "task_id"))


def _with_cached(tasks: DataFrame, cache: DataFrame, cached: bool, made: DataFrame | None = None) -> DataFrame:
    """Results (RESULT) of tasks: their cached rows, and those in ``made`` (raw_url, generate, page_class, status, ..., rows) after or before them."""
    side = lambda p: cache.where(F.col("platform") == p).groupBy("canonical_url").agg(F.max(F.struct("page_class", "rows")).alias(p))
    out = tasks.join(side(PLATFORMS[0]), "canonical_url", "left").join(side(PLATFORMS[1]), "canonical_url", "left")
    null = lambda kind: F.lit(None).cast(kind)
    if made is None:
        fields = {"page_class": null("string"), "status": F.lit(CACHED), "failure_code": null("string"), "failure_detail": null("string"), "hints": F.array().cast("array<string>"), "new": null(f"array<{artifacts.ROW}>")}
        out = out.withColumns(fields)
    else:
        out = out.join(made.withColumnRenamed("rows", "new"), ["raw_url", "generate"])
    own = lambda p: F.when(F.col("generate").isin(p, "both"), F.col("new") if p == PLATFORMS[0] else F.when(F.col("generate") != "both", F.col("new"))).when((F.col("generate") != "both") & F.col("mode").isin(p, "both"), F.col(p)["rows"])
    none = F.array().cast(f"array<{artifacts.ROW}>")
    failed = F.col("status").startswith("FAILED")
    rows = F.when(failed, F.coalesce("new", none)).otherwise(F.concat(*[F.coalesce(own(p), none) for p in PLATFORMS]))
    known = F.coalesce("page_class", *[F.when(F.col("mode").isin(p, "both"), F.col(p)["page_class"]) for p in PLATFORMS])
    return out.select("job_id", F.col("task_id").alias("url_task_id"), "raw_url", "canonical_url", "mode", "generate", known.alias("page_class"), "status", "failure_code", "failure_detail", "hints", F.lit(cached).alias("cache_hit"), rows.cast(f"array<{artifacts.ROW}>").alias("rows"), _bucket(F.col("job_id")).alias("bucket"))


# -- the transform of a message


def from_pages(pages: DataFrame) -> Fetch:
    """A fetcher that finds pages in a table (url, html); the others are not found."""
    held = pages.groupBy(F.col("url").alias("raw_url")).agg(F.max("html").alias("html"))
    return lambda urls: urls.join(held, "raw_url", "left").withColumn("error", F.when(F.col("html").isNull(), "page not found"))


def handle(tasks: DataFrame, fetch: Fetch, cache: DataFrame, most: int = 100, generate: Generate = intents.generate) -> DataFrame:
    """Results (RESULT) of tasks (TASK): fetch, resolve, generate what is lacking, put it together with what is cached.

    A page is fetched and resolved once, and generated once for each set of platforms that is lacking, however many tasks ask for it.
    """
    asked = tasks.select("raw_url", "generate").distinct()
    pages = fetch(asked.select("raw_url").distinct()).select(F.col("raw_url").alias("page_id"), F.col("raw_url").alias("url"), "html", "error")
    packs, failures = resolve.resolve(pages)
    made = failures.select(F.col("page_id").alias("raw_url"), "page_class", F.lit("FAILED_COLLECTION").alias("status"), "failure_code", "failure_detail", "hints", F.array().cast(f"array<{artifacts.ROW}>").alias("rows")).join(asked, "raw_url")
    for mode in sorted(r.generate for r in asked.select("generate").distinct().collect()):  # three at most
        wanted = asked.where(F.col("generate") == mode).select(F.col("raw_url").alias("url"))
        own = packs.join(wanted, "url", "left_semi")
        chosen, report = generate(own, mode, most)
        # each row's field by name, in the order of selection; negative rows come last
        fields = [F.col(f.split(":")[0]).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in artifacts.ROW[len("struct<") : -1].split(",")]
        rows = chosen.select("url", F.struct(F.coalesce("place", F.lit(1 << 30)).alias("p"), "ord", F.struct(*fields).alias("row")).alias("x"))
        listed = rows.groupBy("url").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("rows"))
        full = own.select("url", "page_class").join(report, "url", "left").join(listed, "url", "left")
        status = F.coalesce("status", F.lit("FAILED_GENERATION"))
        code = F.when(status != "COMPLETED", F.coalesce("failure_code", F.lit("generation_failed")))
        detail = F.when(status != "COMPLETED", F.coalesce("failure_detail", F.lit("generation failed")))
        none = F.array().cast("array<string>")
        made = made.unionByName(full.select(F.col("url").alias("raw_url"), F.lit(mode).alias("generate"), "page_class", status.alias("status"), code.alias("failure_code"), detail.alias("failure_detail"), none.alias("hints"), F.coalesce("rows", F.array().cast(f"array<{artifacts.ROW}>")).alias("rows")))
    return _with_cached(tasks, cache, cached=False, made=made)


def components(results: DataFrame) -> DataFrame:
    """What successes leave in the cache (COMPONENT): the rows of a platform, under the platforms that were asked for."""
    done = results.where(F.col("status").isin(*DONE))
    label = {PLATFORMS[0]: "naver_match", PLATFORMS[1]: "google_match"}
    kept = lambda p: F.when(F.col("mode") == p, F.col("rows")).otherwise(F.filter("rows", lambda r: r[label[p]] != ""))
    each = F.array(*[F.struct(F.lit(p).alias("platform"), kept(p).alias("rows")) for p in PLATFORMS])
    out = done.select("canonical_url", "page_class", "mode", F.explode(each).alias("c")).where((F.col("mode") == F.col("c.platform")) | (F.col("mode") == "both"))
    return out.groupBy("canonical_url", "c.platform").agg(F.max(F.struct("page_class", "c.rows")).alias("x")).select("canonical_url", "platform", "x.page_class", "x.rows")


# -- the stages


def collection(spark: SparkSession, root: str, fetch: Fetch, most: int = 100, generate: Generate = intents.generate, per_trigger: int = 10) -> None:
    """Work off the collection queue. Messages of unknown tasks are ignored."""

    def work(messages: DataFrame, sink: Sink) -> None:
        own = sink.spark
        tasks = table(own, root, "tasks").dropDuplicates(["job_id", "task_id"]).join(messages.distinct(), ["job_id", "task_id"], "left_semi")
        if tasks.isEmpty():
            return
        done = sink.put("results", lambda: handle(tasks, fetch, table(own, root, "cache"), most, generate), by="bucket")
        sink.put("cache", lambda: components(done))
        sink.put("queue/aggregation", lambda: done.select("job_id", F.col("url_task_id").alias("task_id"), "status", F.lit(None).cast("long").alias("submitted"), F.current_timestamp().alias("ts")))

    queue = _queue(spark, root, "collection")
    _stage(first_of_key(read_events(spark, queue, MESSAGE, per_trigger), ["job_id", "task_id"]), root, "collection", work)


def aggregation(spark: SparkSession, root: str, per_trigger: int = 10) -> None:
    """Work off the aggregation queue: jobs whose tasks have all ended get a summary, files, and a notice if one is wanted."""

    def work(ended: DataFrame, sink: Sink) -> None:
        own = sink.spark
        done = sink.put("finished", lambda: ended)
        results = _of_jobs(table(own, root, "results"), done)
        sink.once("artifacts", lambda path: artifacts.write_job(results.drop("bucket"), path))
        wants = table(own, root, "jobs").where("target is not null").select("job_id")
        sink.put("queue/notification", lambda: done.select("job_id").join(wants, "job_id", "left_semi"))

    queue = _queue(spark, root, "aggregation")
    _stage(finished(read_events(spark, queue, EVENT, per_trigger)), root, "aggregation", work)


def notification(spark: SparkSession, root: str, per_trigger: int = 10) -> None:
    """Work off the notification queue: one notice per job in the outbox."""

    def work(messages: DataFrame, sink: Sink) -> None:
        own = sink.spark
        jobs_ = table(own, root, "jobs").dropDuplicates(["job_id"]).select("job_id", "target", "mode")
        done = table(own, root, "finished").dropDuplicates(["job_id"]).join(messages, "job_id", "left_semi")
        counts = jobs.notifications(done)
        payload = F.to_json(F.struct("job_id", "status", F.col("mode").alias("requested_platform_mode"), "counts"))
        sink.put("outbox", lambda: counts.join(jobs_, "job_id").select("job_id", "status", "target", payload.alias("payload"), F.current_timestamp().alias("sent_at")))

    queue = _queue(spark, root, "notification")
    _stage(first_of_key(read_events(spark, queue, "job_id string", per_trigger), ["job_id"]), root, "notification", work)


def _queue(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a queue, which a stream wants to exist."""
    path = f"{root}/queue/{name}"
    system, at = _path(spark, path)
    system.mkdirs(at)
    return path


def drain(spark: SparkSession, root: str, fetch: Fetch, most: int = 100, generate: Generate = intents.generate) -> None:
    """Work off all three queues; none sends back to an earlier one, so one turn each is enough."""
    collection(spark, root, fetch, most, generate)
    aggregation(spark, root)
    notification(spark, root)
