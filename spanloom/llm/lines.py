"""Line deduplication over range-partitioned hashes; the result is a bitmap per document.

Every line becomes a row of two 64-bit hash halves, document and position. The rows are dealt
out by range of (hash, document, position) and sorted in each partition, so a line that a third
of all documents hold spreads over many partitions. A task streams its partition and sees each
line's first document first. Only the run at the head of a partition may have begun earlier;
its rows wait, and one row per partition (its first and last hash, and where the last run
began) settles them: these summaries are as many as partitions, whatever the input.

Dropped positions come back as a compressed bitmap of kept lines per document; no text moves
until the caller applies it.

Defined cases: null and empty texts are one empty line; a null id is a document of its own
that comes after all others, and rows with a null id are one document; rows repeated with an
id are one document (their lines are not copies of each other) and get equal bitmaps; lines
whose key is shorter than ``min_chars`` stay; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_rows, raw, row_key, stored, tuned, ids_and_texts

LAST = (1 << 63) - 1  # a null id, after all others
LINE = {"h1": pa.int64(), "h2": pa.int64(), "doc": pa.int64(), "at": pa.int64(), "key": pa.int64()}
LINE_DDL = "h1 bigint, h2 bigint, doc bigint, at bigint, key bigint"
# kind 0: a dropped line; 1: a line of the head run; 2: the partition's summary (doc: where its last run began)
SEEN_DDL = "kind int, part int, doc bigint, key bigint, at bigint, h1 bigint, h2 bigint, g1 bigint, g2 bigint"
SEEN = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((n, pa.int64()) for n in ("doc", "key", "at", "h1", "h2", "g1", "g2"))])


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(least: int):
    def work(batch: pa.RecordBatch) -> list:
        digests, docs, positions, keys = [], [], [], []
        digest = xxhash.xxh3_128_digest
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2))):
            doc = LAST if doc is None else doc
            for at, line in enumerate(text.split(b"\n")):
                if len(line) >= least and long_enough(line := line_key(line), least):
                    digests.append(digest(line))
                    docs.append(doc)
                    positions.append(at)
                    keys.append(key)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), docs, positions, keys]

    return by_rows(LINE, work)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences of one sorted partition: dropped lines, head-run lines, a summary."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    head = run = began = None  # the first hash, the current hash, the document its run began with
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, at, key = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = run != (h1[0], h2[0])
        if head is None:
            head = (h1[0], h2[0])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        owner = np.where(first >= 0, doc[np.maximum(first, 0)], doc[0] if began is None else began)
        run, began = (h1[-1], h2[-1]), owner[-1]
        in_head = (h1 == head[0]) & (h2 == head[1])
        out = in_head | (doc != owner)
        if out.any():
            n = int(out.sum())
            zero = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(in_head[out].astype(np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(doc[out]), pa.array(key[out]), pa.array(at[out]), *[pa.array(zero)] * 4],
                schema=SEEN,
            )
    if head is not None:
        row = [2, part, began, 0, 0, *head, *run]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEEN)], schema=SEEN)


def carried(summaries: list) -> list[tuple[int, int]]:
    """(partition, document) for partitions whose head run began in an earlier one."""
    out, before = [], None
    for s in sorted(summaries, key=lambda s: s.part):
        head, last = (s.h1, s.h2), (s.g1, s.g2)
        goes_on = before is not None and before[0] == head
        if goes_on:
            out.append((s.part, before[1]))
        before = (last, before[1] if goes_on and head == last else s.doc)
    return out


def to_bitmap(n_lines: int, dropped) -> bytes:
    """Kept lines as bits, most significant first, compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def from_bitmap(data: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n_lines).astype(bool)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, key, at: lines that go; ``key`` tells rows with the same id apart by their content."""
    spark = tuned(docs.sparkSession)
    texts = ids_and_texts(docs, id_col, text_col)
    lines = texts.select("doc_id", row_key().alias("key"), "text").mapInArrow(line_hashes(min_chars), LINE_DDL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "at"]
    seen = stored(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(stream, SEEN_DDL), "line-runs")
    later = carried(seen.where("kind = 2").select("part", "doc", "h1", "h2", "g1", "g2").collect())  # one row per partition
    owner = spark.createDataFrame(later, "part int, owner bigint")
    # A head run that did not begin earlier began with the partition's smallest document.
    heads = seen.where("kind = 1")
    own = heads.groupBy("part").agg(F.min("doc").alias("own"))
    waiting = heads.join(F.broadcast(own), "part").join(F.broadcast(owner), "part", "left")
    late = waiting.where(F.col("doc") != F.coalesce("owner", "own")).select("doc", "key", "at")
    lost = seen.where("kind = 0").select("doc", "key", "at").unionByName(late)
    return lost.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "key", "at")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, key, n_lines, n_dropped, keep: a compressed bitmap per document; no text moves.

    ``key`` is a hash of the row's content; repeated rows share it and appear once.
    """
    counted = ids_and_texts(docs, id_col, text_col).select(
        "doc_id", row_key().alias("key"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    )
    lost = dropped_lines(docs, id_col, text_col, min_chars).withColumn("n_lines", F.lit(0).cast("long"))
    rows = counted.withColumn("at", F.lit(None).cast("long")).unionByName(lost)
    # One text's lines at most meet here; rows of the same content meet once each.
    per_row = rows.groupBy("doc_id", "key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("dropped"))

    def work(batch: pa.RecordBatch) -> list:
        doc, key, lines = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        gone = batch.column(3).to_pylist()
        return [doc, key, lines, [len(d) for d in gone], [to_bitmap(n, d) for n, d in zip(lines, gone)]]

    fields = {"doc_id": pa.int64(), "key": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "keep": pa.binary()}
    return per_row.select("doc_id", "key", "n_lines", "dropped").mapInArrow(by_rows(fields, work), "doc_id bigint, key bigint, n_lines bigint, n_dropped bigint, keep binary")


def apply(docs: DataFrame, keeps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept text, by the ``keep_bitmaps`` of the documents.

    The one step that moves texts, once.
    """
    keeps = keeps.where("n_dropped > 0").select(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key"), "keep")
    texts = ids_and_texts(docs, id_col, text_col).withColumn("key", row_key())

    def work(batch: pa.RecordBatch) -> list:
        n_lines, n_dropped, kept = [], [], []
        for text, keep in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if keep is None:
                n_dropped.append(0)
                kept.append(text)
            else:
                mask = from_bitmap(keep, len(lines))
                kept.append(b"\n".join(line for line, stays in zip(lines, mask) if stays))
                n_dropped.append(int(len(lines) - mask.sum()))
        return [batch.column(0), n_lines, n_dropped, pa.array(kept, pa.binary()).cast(pa.string())]

    fields = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "kept": pa.string()}
    match = (F.col("key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    joined = texts.join(keeps, match, "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(by_rows(fields, work), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
