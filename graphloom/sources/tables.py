"""Readers and writers: tables, JSON lines, vectors, resumable output."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "text", "source", "url")])
QUESTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("qid", "question", "qtype")] + [T.StructField("gold_doc_ids", T.ArrayType(T.StringType()))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Spark 4.1 may take a union of co-partitioned inputs as partitioned by a key although rows of a key lie in
    # several of its partitions; windows and aggregates above it are then wrong (a test shows it)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is written there goes when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass  # the session has ended already


def cut(df: DataFrame, step: str = "") -> DataFrame:
    """``df`` computed once and written to the shared folder; ``step`` names it for recorders that stand in for this function."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder as Parquet: smaller than a checkpoint, and read by column and row group."""
    path = fresh_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_corpus(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON as corpus rows with ``state``: blank, corrupt (not an object of the schema), no_id, or kept; ``line`` holds corrupt lines."""
    kept = T.StructType([*CORPUS, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.col(value).alias("line"), F.from_json(value, kept, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    blank = F.btrim(F.coalesce("line", F.lit("")), F.lit(" \t\r\n\ufeff")) == ""
    state = F.when(blank, "blank").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "corrupt").when(F.col("r.doc_id").isNull(), "no_id").otherwise("kept")
    return parsed.withColumn("state", state).select("state", F.when(F.col("state") == "corrupt", F.col("line")).alias("line"), *(F.col(f"r.{c}").alias(c) for c in CORPUS.names))


def read_corpus(spark: SparkSession, path: str, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Corpus documents from JSON lines with a fixed schema; blank lines are skipped and nulls are empty. A limit takes the first ids. Corrupt lines and lines without an id are left out (``corpus_report`` counts them); ``strict`` raises if there are any."""
    rows = parse_corpus(spark.read.text(path))
    if strict and (bad := rows.where("state IN ('corrupt', 'no_id')").groupBy("state").count().collect()):
        raise ValueError("corpus lines: " + ", ".join(f"{r['count']} {r['state']}" for r in sorted(bad)))
    rows = rows.where("state = 'kept'").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in CORPUS.names[1:]))
    return rows if limit is None else rows.orderBy("doc_id").limit(limit)


def corpus_report(rows: DataFrame) -> DataFrame:
    """How many parsed lines are of each state."""
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def read_questions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Benchmark questions; raises if a required field is missing or the count is not the expected one."""
    rows = spark.read.schema(QUESTIONS).json(path)
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.col("qid").isNull() | F.col("question").isNull() | F.col("qtype").isNull() | F.col("gold_doc_ids").isNull())).first()
    if bad or (expected is not None and n != expected):
        raise ValueError(f"{bad} of {n} questions lack a field; {expected} are expected")
    return rows


def read_vectors(chunks: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors, matched by id; raises if a side has ids that the other lacks."""
    loose = chunks.select(id_col).join(vectors.select(id_col), id_col, "left_anti").limit(1).unionByName(vectors.select(id_col).join(chunks.select(id_col), id_col, "left_anti").limit(1))
    if loose.take(1):
        raise ValueError("chunk and vector ids differ")
    return chunks.join(vectors, id_col)


def write_vertices(vertices: DataFrame, path: str) -> None:
    """Last write of a (v_type, v_id) wins, by ``seq`` if there is one; one folder a type."""
    if "seq" in vertices.columns:
        rest = [c for c in vertices.columns if c not in ("v_type", "v_id", "seq")]
        best = vertices.groupBy("v_type", "v_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
        vertices = best.select("v_type", "v_id", "r.*")
    vertices.write.mode("overwrite").partitionBy("v_type").parquet(path)


def upsert_vertices(spark: SparkSession, path: str, new: DataFrame, target: str) -> None:
    """Merge new vertices over stored ones into ``target``: stored rows with a new key are replaced."""
    old = spark.read.parquet(path)
    kept = old.join(new.select("v_type", "v_id"), ["v_type", "v_id"], "left_anti")
    kept.unionByName(new.select(*old.columns)).write.mode("overwrite").partitionBy("v_type").parquet(target)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.distinct().write.mode("overwrite").partitionBy("edge_type").parquet(path)


def pending(todo: DataFrame, done: DataFrame | None, id_col: str) -> DataFrame:
    """Rows whose id a resumable output does not hold yet."""
    return todo if done is None else todo.join(done.select(id_col).distinct(), id_col, "left_anti")


def resume(spark: SparkSession, todo: DataFrame, path: str, id_col: str, work) -> int:
    """Append ``work(pending rows)`` to the output at ``path``; returns how many rows were left to do. Each append commits as a whole."""
    try:
        done = spark.read.parquet(path)
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    left = pending(todo, done, id_col)
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def count_by_type(vertices: DataFrame, type_col: str = "v_type") -> DataFrame:
    return vertices.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"))


def missing_types(found: DataFrame, required: list[str], type_col: str) -> DataFrame:
    """Required vertex or edge types that a table lacks."""
    spark = found.sparkSession
    return spark.createDataFrame([(t,) for t in required], f"{type_col} string").join(found.select(type_col).distinct(), type_col, "left_anti")
