"""Reading tables and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexmill.functions.hashing import hash_bucket

SPLITS = ("train", "validation", "test", "unsupervised")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a Parquet path or a catalog table; the optimizer prunes."""
    return spark.read.parquet(path) if "/" in path else spark.table(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder.rstrip('/')}/{name}.parquet")


def load_corpus(spark: SparkSession, folder: str, eval_pct: int = 20) -> DataFrame:
    """Documents with their label and a named split. Unlabelled documents form the
    ``unsupervised`` split and have a null label."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    split = (
        F.when(F.col("label").isNull(), "unsupervised")
        .when(hash_bucket("doc_id") < eval_pct, "test")
        .otherwise("train")
    )
    return docs.join(labels, "doc_id", "left").withColumn("split", split)


def read_named_csv(spark: SparkSession, path: str, schema: T.StructType | str, na: str = "?", sep: str = ",") -> DataFrame:
    """CSV without header under given names and types; ``na`` reads as null."""
    return (
        spark.read.schema(schema)
        .option("nullValue", na)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def clean_csv_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Repair raw lines: trim, drop the space after commas, drop lines that are
    empty or hold no comma, drop one trailing full stop. Other columns stay."""
    line = F.replace(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), F.lit(", "), F.lit(","))
    return (
        lines.withColumn(col, line)
        .where((F.col(col) != "") & F.col(col).contains(","))
        .withColumn(col, F.regexp_replace(F.col(col), r"\.$", ""))
    )


def parse_csv_lines(lines: DataFrame, schema: str, na: str = "?", col: str = "value") -> DataFrame:
    parsed = F.from_csv(F.col(col), schema, {"nullValue": na, "mode": "PERMISSIVE"}).alias("_r")
    keep = [c for c in lines.columns if c != col]
    return lines.select(*keep, parsed).select(*keep, "_r.*")


def create_table_as(df: DataFrame, name: str, path: str | None = None) -> None:
    """Store a query as a new table; fail when the name is taken."""
    writer = df.write.mode("errorifexists").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def to_json_records(df: DataFrame, col: str = "record") -> DataFrame:
    """One JSON object per row with every column; nulls are written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(col))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``word f1 f2 ...``; no quoting."""
    parts = F.split(F.col("value"), " ")
    return (
        spark.read.text(path)
        .where(F.length("value") > 0)
        .select(
            F.get(parts, F.lit(0)).alias("word"),
            F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vector"),
        )
    )
