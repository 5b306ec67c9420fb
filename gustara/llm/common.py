"""What the operators of this package share: table access and Arrow text stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.session import materialize, tune

# Rows and bytes of one Arrow batch between the JVM and a Python worker.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

ARROW_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}

TextStage = Callable[[list], Sequence[Sequence]]


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings of the library, with small Arrow batches for whole texts."""
    tune(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside_texts(rows: DataFrame, side: DataFrame, on: str | Sequence[str], how: str) -> DataFrame:
    """Join whole texts to a written side of one row per key, by the same sort-merge plan at every size.

    The side grows with the texts, so it is no broadcast at scale; both inputs are exchanged, and a
    key with many rows can be split.
    """
    return rows.join(materialize(side, "side").hint("merge"), on, how)


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of ``df`` other than ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    """A column name as one identifier, also where it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> list[Column]:
    """All columns under numbers, so that no name an operator adds can meet a given one; see ``named``."""
    return [F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(df.columns)]


def named(df: DataFrame) -> list[Column]:
    """The columns of ``numbered(df)`` under the names they have in ``df``."""
    return [F.col(f"__c{i}").alias(c) for i, c in enumerate(df.columns)]


KEY = ["no_id", "doc", "version"]


def document_key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Order of documents: by id, NULL last, then by text. Rows equal in both are one document."""
    given, kind = F.col(quoted(doc_id)), docs.schema[doc_id].dataType
    known = F.coalesce(given, F.lit("0").cast(kind))  # never NULL, so that plain joins find it
    return [given.isNull().alias("no_id"), known.alias("doc"), F.xxhash64(F.col(quoted(text))).alias("version")]


def text_stage(
    df: DataFrame, text: str, make: Callable[[], TextStage], added: dict[str, str], keep: Sequence[str] | None = None
) -> DataFrame:
    """Columns computed from one column by a Python function over Arrow batches.

    ``make`` builds the function once per task; it gets the column's values of a batch and gives one
    sequence per added column. ``added`` maps names to Spark types. ``keep`` names the input columns
    to carry along (default: all); an input column named like an added one is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c in set(without(df, list(added)))]
    given = df.select(*[F.col(quoted(c)) for c in kept])
    fed = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], F.col(quoted(text)).alias("fed"))
    fields = [T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()]
    schema = T.StructType([*given.schema.fields, *fields])
    names, types = schema.names, [ARROW_TYPES[t] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = make()
        for batch in batches:
            columns = batch.columns
            out = [pa.array(v, t) for v, t in zip(stage(columns[-1].to_pylist()), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], *out], names=names)

    return fed.mapInArrow(run, schema)
