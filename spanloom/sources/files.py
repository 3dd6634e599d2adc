"""Reading and writing what an annotated corpus comes in: JSON, CSV with lists, text folders, run folders and logs.

Readers take a schema where the format has none, so nothing is read twice to guess it.  A path that
has no file gives Spark's own error; an empty file gives an empty table.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

CORPUS = "version string, data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; other letters than ASCII stay as they are."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_json_document(rows: DataFrame, path: str) -> None:
    """Each row as one JSON text, nulls kept."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


@arrow_udf(ArrayType(StringType()))
def _literal_list(values: pa.Array) -> pa.Array:
    def read(v: str | None) -> list[str] | None:
        if not v or v == "None":
            return None
        try:
            found = ast.literal_eval(v)
        except (ValueError, SyntaxError):
            return None
        return [str(x) for x in found] if isinstance(found, (list, tuple)) else None

    return pa.array([read(v) for v in values.to_pylist()], pa.list_(pa.string()))


def literal_list(column: Column) -> Column:
    """A list written as Python writes it; null for anything else."""
    return _literal_list(column)


def csv(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; columns in ``lists`` hold lists as text."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumns({c: literal_list(F.col(c)) for c in lists}) if lists else rows


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; lists and structs as JSON."""
    nested = {f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")}
    rows.withColumns(nested).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Each row (name, content) as a UTF-8 file below ``folder``, written where the row is; a task that runs again writes the same file again.

    Null content gives an empty file.  Returns the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                where.create_dir(path.rpartition("/")[0], recursive=True)
                with where.open_output_stream(path) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(title, doc_text, qas) of a nested question corpus, one row per document; answers with exclusive ends."""
    docs = json_document(spark, path, CORPUS).select(F.inline("data")).select("title", F.explode("paragraphs").alias("p"))
    span = lambda a: F.struct(a["text"].alias("text"), a["answer_start"].alias("start_pos"), (a["answer_start"] + F.length(a["text"])).alias("end_pos"))
    qas = F.transform("p.qas", lambda q: F.struct(q["id"].alias("qa_id"), q["question"].alias("question"), q["is_impossible"].alias("is_impossible"), F.transform(q["answers"], span).alias("answers")))
    return docs.select("title", F.col("p.context").alias("doc_text"), qas.alias("qas"))


def files(spark: SparkSession, folder: str, pattern: str = "*", depth: bool = True) -> DataFrame:
    """(path, name, length) of a folder's files, without their contents; files without a byte are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", depth).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, name, content) of text files, whole."""
    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.input_file_name()
    return found.select(path.alias("path"), F.regexp_extract(path, "([^/]+)\\.[^./]+$", 1).alias("name"), F.col("value").alias("content"))


def field_folders(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """A folder per field with a file per document, as one row per document; lines of all fields side by side via ``lines``."""
    rows = texts(spark, folder).withColumn("field", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    return rows.groupBy(F.col("name").alias("doc")).pivot("field", fields).agg(F.first("content"))


def lines(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Documents with aligned lines in several fields as rows of lines, cut to the shortest field."""
    split = rows.select(key, *[F.split(F.coalesce(f, F.lit("")), "\n").alias(f) for f in fields])
    least = F.least(*[F.size(f) for f in fields]) if len(fields) > 1 else F.size(fields[0])
    zipped = F.arrays_zip(*[F.slice(f, F.lit(1), least).alias(f) for f in fields])
    return split.select(key, F.posexplode(zipped).alias("line_no", "z")).select(key, "line_no", *[F.col(f"z.{f}") for f in fields])


def path_ids(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, doc_id, filer_id): the last two folders as ids, the first ten signs of the id as filer."""
    parts = F.split(path, "/")
    doc = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]+$", "")
    return paths.select(path, F.element_at(parts, -2).alias("folder"), doc.alias("doc_id"), F.substring(doc, 1, 10).alias("filer_id"))


def run_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(model, split, run, checkpoint, name, length) of the files below ``model/split/run/checkpoint-N``."""
    pattern = "([^/]+)/([^/]+)/([^/]+)/checkpoint-([0-9]+)/([^/]+)$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files(spark, folder).filter(F.col("path").rlike(pattern)).select(part(1).alias("model"), part(2).alias("split"), part(3).alias("run"), part(4).cast("int").alias("checkpoint"), "name", "length")


def registry(tree: DataFrame) -> DataFrame:
    """What each checkpoint of a run has: predictions and metrics, of all samples and of the drawn ones."""
    has = lambda name: F.bool_or(F.col("name") == name)
    return tree.groupBy("model", "split", "run", "checkpoint").agg(
        has("predictions_all.jsonl").alias("pred_all"), has("predictions_sampled.jsonl").alias("pred_sampled"), has("metrics_all.json").alias("metric_all"), has("metrics_sampled.json").alias("metric_sampled")
    )


def to_score(registered: DataFrame) -> DataFrame:
    """Checkpoints with predictions whose metrics are still missing."""
    return registered.filter((F.col("pred_all") & ~F.col("metric_all")) | (F.col("pred_sampled") & ~F.col("metric_sampled")))


_CHECKPOINT = "([^/]+)/([^/]+)/([^/]+)/checkpoint-([0-9]+)/([^/]+)$"


def _placed(rows: DataFrame, path: Column) -> DataFrame:
    """Rows with the model, split, run and checkpoint of the file they come from, and its name."""
    part = lambda i: F.regexp_extract(path, _CHECKPOINT, i)
    return rows.withColumns({"model": part(1), "split": part(2), "run": part(3), "checkpoint": part(4).cast("int"), "name": part(5)})


def metrics_tree(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """(model, split, run, checkpoint, kind, fields) of every metrics_<kind>.json below ``model/split/run/checkpoint-N``; a field that is missing is null."""
    schema = ", ".join(f"`{f}` double" for f in fields)
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metrics_*.json").schema(schema).option("multiLine", True).json(folder)
    kind = F.regexp_extract("name", "metrics_(.+)\\.json", 1)
    return _placed(found, F.input_file_name()).select("model", "split", "run", "checkpoint", kind.alias("kind"), *fields)


def paired_metrics(metrics: DataFrame, fields: list[str], kinds: tuple[str, str]) -> DataFrame:
    """One row a checkpoint, with each field of both kinds side by side; null where a kind is missing."""
    of = lambda k, f: F.max(F.when(F.col("kind") == k, F.col(f))).alias(f"{f}_{k}")
    return metrics.groupBy("model", "split", "run", "checkpoint").agg(*[of(k, f) for k in kinds for f in fields])


def run_predictions(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Rows of every predictions_<kind>.jsonl of the tree, with the checkpoint they belong to."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"predictions_{kind}.jsonl").schema(schema).json(folder)
    return _placed(found, F.input_file_name()).drop("name")


def loss_log(spark: SparkSession, path: str, schema: str = "step int, loss double") -> DataFrame:
    """Log lines that are JSON, or dictionaries as Python writes them; other lines are left out.  ``line`` keeps their order in a file."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = raw.select("line", F.from_json("value", schema, {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"}).alias("j"))
    return parsed.select("line", "j.*").filter("step is not null")


def cached(make, spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there; the path must name all that it depends on."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if where.get_file_info(f"{inner}/_SUCCESS").type == fs.FileType.NotFound:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def template(spark: SparkSession, path: str) -> str:
    """The text of a prompt template (one small file)."""
    return spark.read.text(path, wholetext=True).first()[0]


def table_lines(rows: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Rows as lines of a LaTeX table."""
    shown = [F.format_string(f"%.{digits}f", c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return rows.select(F.concat(F.concat_ws(" & ", *shown), F.lit(" \\\\")).alias("line"))
