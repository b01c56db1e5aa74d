"""Sources of texts to scan and of the operations around them; the derived tables come from the given ones by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.operators import policy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def directory(spark: SparkSession, path: str, glob: str = "*", hidden: bool = False, depth: int | None = None, ignore_file: str | None = ".gitignore") -> DataFrame:
    """(file_path, size_bytes, content, skip_reason) of a folder's files; what isn't UTF-8 has a reason and no content.

    Hidden files and those below `depth` steps are left out, and so are files that the lines of the folder's own
    `ignore_file` say, in order, the last that matches a step deciding; it is read on the driver, as settings are. Spark's
    readers pass over files and folders whose names begin with a dot or an underscore, so that `hidden` has an effect on
    other tables of paths (policy.walk) alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = files.option("pathGlobFilter", glob).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    start = system.makeQualified(root).toString().rstrip("/") + "/"
    paths = rows.select("path", F.lit(0).alias("repo"), F.expr(f"substr(path, {len(start) + 1})").alias("file_path"))
    lines = None
    own = spark._jvm.org.apache.hadoop.fs.Path(path, ignore_file) if ignore_file else None
    if own is not None and system.exists(own):
        stream = system.open(own)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        lines = policy.lines_of(spark.createDataFrame([(0, text)], "repo int, content string"))
    found = policy.walk(paths, lines, hidden, depth).where("left_out is null").select("path")
    rows = rows.join(found, "path", "left_semi") if lines is not None else rows.where(_walked(start, hidden, depth))
    text, good = F.col("content").cast("string"), F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select(
        F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), F.when(good, text).alias("content"),
        F.when(~good, F.lit("Failed to read file: not UTF-8")).alias("skip_reason"),
    )


def _walked(start: str, hidden: bool, depth: int | None) -> Column:
    """Without ignore lines the path alone says whether a walk comes to a file."""
    steps = F.expr(f"substr(path, {len(start) + 1})")
    out = F.lit(True) if hidden else ~steps.rlike(r"(^|/)\.[^/]")
    return out if depth is None else out & (F.size(F.split(steps, "/")) <= depth)


def changed(files: DataFrame, changes: DataFrame, statuses: tuple[str, ...] = ("added", "modified")) -> DataFrame:
    """files (file_path, more) that a change set (file_path, status) names with one of the statuses."""
    return files.join(changes.where(F.col("status").isin(*statuses)).select("file_path").distinct(), "file_path", "left_semi")


#: The corpus that the queries scan: each document with a path and a planted line; the same text runs in Spark and in SQL oracles.
CORPUS = """
select doc_id, x,
 case doc_id % 8 when 0 then concat('src/svc', x, '.rs') when 1 then concat('config/app', x, '.env') when 2 then '.env'
  when 3 then concat('docs/n', x, '.md') when 4 then concat('tests/t', x, '.lock') when 5 then concat('node_modules/m', x, '.js')
  when 6 then concat('img/p', x, '.png') else concat('lib/z', x) end as file_path,
 concat(text, chr(10), case doc_id % 16
  when 0 then concat('AWS_ACCESS_KEY_ID=AKIA', upper(substr(md5(x),1,16)))
  when 1 then concat('aws_secret_access_key = ', substr(concat(md5(x),md5(concat('b',x))),1,40))
  when 2 then concat('GITHUB_TOKEN=ghp_', substr(concat(md5(x),md5(concat('b',x))),1,36))
  when 3 then '-----BEGIN RSA PRIVATE KEY-----'
  when 4 then concat('DATABASE_URL=postgresql://user:', substr(md5(x),1,12), '@db.internal/app')
  when 5 then concat('stripe: sk_live_', substr(md5(x),1,24))
  when 6 then concat('Authorization: Bearer ', md5(x))
  when 7 then concat('password = "', substr(md5(x),1,6), 'Q#z!w"')
  when 8 then concat('api_key: ', md5(x))
  when 9 then concat('secret=', substr(md5(x),1,20))
  when 10 then concat('eyJ', substr(md5(x),1,16), '.eyJ', substr(md5(concat('b',x)),1,20), '.', md5(concat('c',x)))
  when 11 then concat('xoxb-', lpad(x,12,'0'), '-', lpad(x,12,'7'), '-', substr(md5(x),1,24))
  when 12 then concat('SK', md5(x))
  when 13 then concat('redis://cache.internal/', x)
  else '' end) as content
from (select doc_id, text, cast(doc_id as {V}) as x from documents where text is not null) q
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CORPUS.format(V="string").replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.drop("x")


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations from the table events: ts, op_type, service, size_bytes, duration_ms, success, event_id."""
    return operations(table(spark, sf_dir, "events"))


def operations(events: DataFrame) -> DataFrame:
    ops = F.create_map(*[F.lit(v) for kv in {"view": "Read", "click": "Write", "purchase": "Encrypt", "signup": "Decrypt"}.items() for v in kv])
    return events.select(
        "event_id", "ts", F.coalesce(ops[F.col("event_type")], F.lit("Encrypt")).alias("op_type"), F.col("user_id").alias("service"),
        (F.col("value") * 1024).cast("bigint").alias("size_bytes"), (F.col("value") * 100).alias("duration_ms"), (F.col("event_type") != "error").alias("success"),
    )
