"""Structured Streaming jobs: job-status messages and scoring of arriving texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as tx
from lexmill.operators.naive_bayes import TrainedText

# The shape of a log entry and the text of a message.
SUCCESS_WORD = "successfully"
MARKS = {"Failed": ":x:", "Succeed": ":white_check_mark:"}
MESSAGE = "%s Job: %s\nStatus:  %s \nType: %s\nTimestamp: %s\nDetails %s"
LOG_SCHEMA = "resource STRUCT<type: STRING, labels: STRUCT<job_id: STRING>>, textPayload STRING, timestamp STRING"


def job_status(logs: DataFrame, data: str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., job_id, status, job_type, timestamp, message) from base64 JSON log
    entries. The same call works on a static and on a streaming frame."""
    entry = F.from_json(F.decode(F.unbase64(data), "UTF-8"), LOG_SCHEMA)
    parsed = logs.select(*keep, entry.alias("e")).select(
        *keep,
        F.col("e.resource.labels.job_id").alias("job_id"),
        F.when(F.contains("e.textPayload", F.lit(SUCCESS_WORD)), "Succeed").otherwise("Failed").alias("status"),
        F.col("e.resource.type").alias("job_type"),
        F.col("e.timestamp").alias("timestamp"),
        F.col("e.textPayload").alias("details"),
    )
    mark = F.when(F.col("status") == "Failed", MARKS["Failed"]).otherwise(MARKS["Succeed"])
    text = F.format_string(MESSAGE, mark, "job_id", "status", "job_type", "timestamp", "details")
    return parsed.withColumn("message", text).drop("details")


def job_status_stream(stream: DataFrame, path: str, checkpoint: str, keep: Sequence[str] = ()) -> StreamingQuery:
    """Append status messages to Parquet; a restart goes on at the checkpoint."""
    return (
        job_status(stream, keep=keep)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    stream: DataFrame, trained: TrainedText, path: str, checkpoint: str, keep: Sequence[str] = (), max_terms: int = 500_000
) -> StreamingQuery:
    """Score arriving (doc_id, text, ...) with a fitted model, as one streaming plan.

    Every text is read once: its words are counted and looked up in the model, which is
    broadcast and may have at most ``max_terms`` terms. The file sink's own log makes a
    restart go on where the last commit ended. Columns: doc_id, keep, prediction, prob.
    """
    spark, model = stream.sparkSession, trained.model
    found = trained.weights.select("term", "idf").join(model.table, "term").limit(max_terms + 1).collect()
    if len(found) > max_terms:
        raise ValueError(f"the model has more than {max_terms} terms; raise max_terms if executors can hold them")
    place = {r["term"]: i for i, r in enumerate(found)}
    idf = np.array([r["idf"] for r in found])
    likelihood = np.array([r["ll"] for r in found]).reshape(len(found), -1)[:, : len(model.classes)]
    known = spark.sparkContext.broadcast((place, idf, likelihood, np.array(model.prior[: len(model.classes)]), list(model.classes), trained.norm))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, likelihood, prior, classes, norm = known.value
        for batch in batches:
            best, probs = [], []
            for words in batch.column(batch.num_columns - 1).to_pylist():
                tf = Counter(place[w] for w in words or () if w in place)
                at, n = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
                weight = n * idf[at]
                if len(at) and norm not in (None, "None"):
                    weight /= np.sqrt((weight * weight).sum()) if norm == "l2" else np.abs(weight).sum()
                joint = prior + weight @ likelihood[at] if len(at) else prior
                odds = np.exp(joint - joint.max())
                best.append(classes[int(joint.argmax())])
                probs.append((odds / odds.sum()).tolist())
            columns = [*batch.columns[:-1], pa.array(best, kinds[-2]), pa.array(probs, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([stream.schema["doc_id"], *(stream.schema[c] for c in keep)])
    kind = spark.range(0).select(F.array(*map(F.lit, model.classes)).alias("c")).schema["c"].dataType.elementType
    schema = schema.add("prediction", kind).add("prob", T.ArrayType(T.DoubleType()))
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    return (
        stream.select("doc_id", *keep, tx.words("text").alias("_words"))
        .mapInArrow(score, schema)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
