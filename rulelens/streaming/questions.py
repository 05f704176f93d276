"""Questions as a stream: every micro-batch is a table of questions for the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ask import Corpus, ask


def question_stream(spark: SparkSession, folder: str, schema: str = "qid string, question string", per_batch: int = 64) -> DataFrame:
    """JSON files of questions as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def answer_stream(questions: DataFrame, corpus: Corpus, target: str, checkpoint: str, **kw) -> StreamingQuery:
    """Append answers to ``target``, a folder for each batch; a batch that runs again after a loss overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        ask(df, corpus, **kw).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
