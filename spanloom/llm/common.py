"""What the corpus operators share: settings, input columns, Arrow helpers, text rules.

Rules that hold for every operator of this package:

* an id column is read as bigint, a text column as string, a null text as empty;
* a null id is an id of its own, after all others in every order;
* rows repeated with the same id count as rows of their own unless the operator says so;
* other columns of the input never meet the names used inside: operators select what they
  need first, and carry whole rows as one struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import RUNTIME_SETTINGS, work_folder

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split(), bytes.strip() and bytes.lower() of Python know exactly these and A-Z.
SPACE = b" \t\n\x0b\x0c\r"

#: Python workers get rows in small batches: a row may hold a very long text.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the settings of this package."""
    for key, value in {**RUNTIME_SETTINGS, **SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, computed once."""
    folder = work_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``text`` only; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(doc_id: Column | None = None, text: Column | None = None) -> Column:
    """A hash of a row's id and text; with the id it tells rows that share the id apart."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id.cast("long")
    text = F.col("text") if text is None else F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), text)


def raw(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def by_rows(fields: dict[str, pa.DataType], work: Callable[[pa.RecordBatch], list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow mapper from a function that gives the columns of one batch."""
    schema = pa.schema(list(fields.items()))

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(work(batch), fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return mapper


def held_out_crc(doc_id: Column) -> Column:
    """CRC-32 of the id as decimal text; a null id reads as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def out_rows(fields: dict[str, pa.DataType], rows: Iterable[tuple], weight: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples."""
    held, size, schema = [], 0, pa.schema(list(fields.items()))
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 8 << 20 or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), fields.values())], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), fields.values())], schema=schema)


def one_of_each(docs: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by ``wanted``, whole; of rows with equal keys, one.

    ``wanted`` has a column for each key, different for each row, and last the number of
    rows of ``docs`` that share them. Keys match null-safely.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(F.struct("*").alias("row"), *(k.alias(n) for k, n in zip(keys, names)))
    wanted = wanted.toDF(*(f"wanted_{n}" for n in names), "ties")
    match = [F.col(n).eqNullSafe(F.col(f"wanted_{n}")) for n in names]
    alone = rows.join(wanted.where("ties = 1"), match, "left_semi").select("row.*")
    tied = wanted.where("ties > 1")
    if tied.isEmpty():
        return alone
    return alone.unionByName(rows.join(tied, match, "left_semi").dropDuplicates(names).select("row.*"))
