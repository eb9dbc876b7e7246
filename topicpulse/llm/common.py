"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
         "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
         "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}

#: Rows of a result that are put together at a time.
OUT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def blocks(texts: list, chars: int) -> Iterator[list]:
    """The texts in order, in runs of about so many characters (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under its own names; whatever else the input has stays out."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list], Iterable[tuple]]],
              columns: list[tuple[str, str]], with_ids: bool = False) -> DataFrame:
    """One output row per row of ``docs(doc_id, text)``, in Arrow batches, without a shuffle.

    ``start()`` runs once per task and returns a function from a batch's texts to
    one tuple per text. The id column is passed through untouched (nulls and 64-bit
    ids stay exact); the function gets (id, text) pairs ``with_ids``. ``columns`` are (name, Spark type) of the tuples.
    """
    types = [ARROW[t] for _, t in columns]
    names = ["doc_id"] + [n for n, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            given = batch.column(1).to_pylist()
            rows = iter(work(list(zip(batch.column(0).to_pylist(), given)) if with_ids else given))
            at = 0
            while some := list(islice(rows, OUT_ROWS)):     # results leave in small batches
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some))]
                    + [pa.array(c, type=t) for c, t in zip(zip(*some), types)], names=names)
                at += len(some)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    ddl = ", ".join(f"`{n}` {t}" for n, t in columns)
    schema = T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def filter_rows(df: DataFrame, text_col: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows, all columns, whose text the function that ``start()`` returns finds True; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield batch.filter(pa.array(work(batch.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files below the folder that all executors share (``spark.checkpoint.dir``)."""
    from topicpulse.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet files in the shared folder: computed once, and safe if executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
