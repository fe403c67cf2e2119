"""Reading the given tables and model files, writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; removed when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    path = f"{root.rstrip('/')}/specloom/step-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


SMALL = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration by a table in the shared folder. A table below ``SMALL`` bytes (networks, their states and paths mostly are)
    is read as one partition, so that joins and sums of such tables need no shuffle."""
    spark = df.sparkSession
    path = work_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return out.coalesce(1) if size <= SMALL else out


MODEL_FILE = "V array<string>, E array<array<string>>, Vdata map<string, struct<vals: array<string>, parents: array<string>, children: array<string>, type: string, cprob: string>>"


def read_model_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per model file: JSON objects with V, E and Vdata. Broken files raise an error when they are read."""
    return spark.read.schema(MODEL_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("model_id", _model_of(F.input_file_name()))


#: A string literal, what is between literals, or a quote that nothing closes.
_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'
#: What is written loosely, outside literals, and how JSON writes it.
_LOOSE = [
    (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"),
    (r"(?<![\w.])([+-]?)\.(?=\d)", "$10."), (r"(?<![\w.])([+-]?\d+)\.(?!\d)", "$1.0"), (r"(?<![\w.])\+(?=\d)", ""),
    (r",(?=\s*[\]}])", ""),
]


def repaired_json(text):
    """Text in a loose dialect as JSON: None, True, False, numbers with a bare point or a plus, a comma before a closing bracket. Literals stay as they are."""
    def fixed(piece):
        out = piece
        for pattern, to in _LOOSE:
            out = F.regexp_replace(out, pattern, to)
        return F.when(piece.startswith('"'), piece).otherwise(out)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), fixed), "")


def parsed_models(texts: DataFrame) -> DataFrame:
    """``texts`` (model_id, text) with V, E, Vdata and ``state``: ``whole`` for JSON, ``repaired`` for what ``repaired_json`` makes readable, ``broken`` for the rest, whose V, E
    and Vdata are null: null texts, other types than a model's, objects without V. Only texts that aren't whole are repaired."""
    read = lambda text: F.from_json(text, f"{MODEL_FILE}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    good = lambda m: F.col(f"{m}.V").isNotNull() & F.col(f"{m}._broken").isNull()
    strict = texts.select("model_id", "text", read(F.col("text")).alias("_s"))
    second = strict.withColumn("_r", F.when(~good("_s"), read(repaired_json(F.col("text")))))
    state = F.when(good("_s"), "whole").when(good("_r"), "repaired").otherwise("broken")
    either = lambda c: F.when(F.col("state") == "whole", F.col(f"_s.{c}")).when(F.col("state") == "repaired", F.col(f"_r.{c}")).alias(c)
    return second.withColumn("state", state).select("model_id", "text", "state", either("V"), either("E"), either("Vdata"))


def read_loose_model_files(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """The rows of ``read_model_files`` for all files that can be read, loose ones repaired; the others go to a table (model_id, text) at ``quarantine``, which is added to.
    Files of no bytes have no row in either: Spark's readers pass over them."""
    texts = spark.read.text(path, wholetext=True).select(_model_of(F.col("_metadata.file_path")).alias("model_id"), F.col("value").alias("text"))
    found = checkpointed(parsed_models(texts))
    found.where("state = 'broken'").select("model_id", "text").write.mode("append").parquet(quarantine)
    return found.where("state <> 'broken'").select("V", "E", "Vdata", "model_id")


def _model_of(file):
    """The model's name: of the folder model_id=name, or else of the file."""
    folder = F.regexp_extract(file, "/model_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.element_at(F.split(file, "/"), -1))


def write_model_files(vertices: DataFrame, path: str) -> None:
    """A file for each model of vertices (model_id, vertex, parents, vals) in a folder of its own: a JSON object with V, E and Vdata."""
    edges = vertices.select("model_id", "vertex", F.explode("parents").alias("src"))
    children = edges.groupBy("model_id", F.col("src").alias("vertex")).agg(F.array_sort(F.collect_list("vertex")).alias("children"))
    v = vertices.join(children, ["model_id", "vertex"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    data = F.map_from_entries(F.collect_list(F.struct("vertex", F.struct("vals", "parents", "children", F.lit("discrete").alias("type")))))
    ends = F.array_sort(F.flatten(F.collect_list(F.transform("parents", lambda p: F.array(p, F.col("vertex"))))))
    m = v.groupBy("model_id").agg(F.array_sort(F.collect_list("vertex")).alias("V"), ends.alias("E"), data.alias("Vdata"))
    m.repartition("model_id").select("model_id", F.to_json(F.struct("V", "E", "Vdata")).alias("value")).write.partitionBy("model_id").text(path)


def skeleton(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (model_id, vertex) and edges (model_id, ord, src, dst) of model files."""
    vertices = models.select("model_id", F.explode("V").alias("vertex"))
    edges = models.select("model_id", F.posexplode("E").alias("ord", "e")).select("model_id", "ord", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return vertices, edges


def node_data(models: DataFrame) -> DataFrame:
    """Rows (model_id, vertex, vals, parents, children, type, cprob) of model files."""
    return models.select("model_id", F.explode("Vdata").alias("vertex", "d")).select("model_id", "vertex", "d.*")


def ordered_skeleton(models: DataFrame, levels: int) -> DataFrame:
    """Vertices of model files with their place in topological order: by the longest way from a root, then by name."""
    from ..operators.network import ordered

    vertices, edges = skeleton(models)
    return ordered(edges.select("model_id", "src", "dst"), vertices, levels)


def write_specs(specs: DataFrame, path: str) -> None:
    """Writes rows (probability, ltl) as lines of text."""
    specs.select(F.format_string("%.4f, %s", "probability", "ltl").alias("value")).write.text(path)
