"""Substring deduplication by difference-cover anchors.

Every run of ``window`` words that also starts in a document of smaller id goes. Hashing all
windows would move a row for every word. Instead a short window (``anchor`` words) is hashed
only where its position, modulo a period v, lies in a difference cover D: a set in which every
difference modulo v occurs. Two equal runs at positions i and j then share an offset d < v with
(i+d) mod v and (j+d) mod v both in D, and as anchor + v - 1 = window, the anchor there lies
inside both runs. So a run of 13 words needs 7-word anchors at 3 of 7 positions (0, 1, 3).

1. Anchors (hash, document) are dealt out by range and sorted, so equal ones lie side by side;
   a batch of them tells which occur in two documents. A hash that a third of all documents
   hold spreads over many tasks.
2. Shared anchors return to their texts and are extended: each window around one is a
   candidate, hashed to 96 bits over all its words.
3. Candidates are dealt out and sorted by (hash, document, position); the first document of a
   hash owns it, candidates of later ones are dropped. No pairs are formed anywhere.
4. The dropped windows of a document return to its text, whose covered words go.

Each step writes its small result to the shared folder and lets Spark delete its shuffle files.

Defined cases: null and empty texts have no words; texts shorter than a window stay whole; a
null id comes after all others and rows with a null id are one document, as are rows repeated
with an id (their windows are not copies of each other); an empty table gives an empty result;
other columns are not read. A text is one row of a task: its word hashes take about 70 bytes a
word while it is worked on; words are hashed in blocks, a word longer than a block by itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, by_rows, ids_and_texts, raw, row_key, stored, tuned
from .lines import LAST, carried

WINDOW = 13
BLOCK = 1 << 18  # bytes hashed at once
SLICE = 100_000  # rows a task sends at once
IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
NEXT_SPACE = re.compile(rb"[ \t-\r]")

_random = np.random.default_rng(12).integers(0, 1 << 63, 1024, np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1)
BYTE, BASE, FACTORS, FACTORS_2 = _random[:256], _random[256], _random[257:640], _random[641:]


def difference_cover(period: int) -> list[int]:
    """Residues whose differences reach every residue: the smallest set for short periods."""

    def covers(found) -> bool:
        return len({(a - b) % period for a in found for b in found}) == period

    if period <= 16:
        return next([0, *rest] for size in range(period) for rest in combinations(range(1, period), size) if covers((0, *rest)))
    step = math.isqrt(period - 1) + 1  # every residue is a multiple of the step less a remainder
    return sorted({*range(step), *(k * step % period for k in range(period // step + 2))})


def plan(window: int) -> tuple[int, int, list[int]]:
    """Period, words of an anchor and cover for runs of ``window`` words."""
    period = (window + 1) // 2
    return period, window - period + 1, difference_cover(period)


def powers(base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, base, np.uint64)]), dtype=np.uint64)


POWERS = powers(BASE)
INVERSES = powers(np.uint64(pow(int(BASE), -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where every word starts, and a 64-bit hash of it, by running sums over blocks (modulo 2^64)."""
    at, begins, out = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while at < len(text):
        block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        blank = IS_SPACE[block]
        if len(block) == BLOCK:
            spaces = np.flatnonzero(blank)
            if not len(spaces):  # a word as long as the block, or longer
                found = NEXT_SPACE.search(text, at + BLOCK)
                end = found.start() if found else len(text)
                begins.append(np.array([at]))
                out.append(np.array([xxhash.xxh3_64_intdigest(memoryview(text)[at:end])], np.uint64))
                at = end
                continue
            block, blank = block[: spaces[-1] + 1], blank[: spaces[-1] + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(BYTE[block] * POWERS[: len(block)], out=sums[1:])
        begins.append(starts + at)
        out.append(mixed((sums[ends] - sums[starts]) * INVERSES[starts]))
        at += len(block)
    return np.concatenate(begins), np.concatenate(out)


class Words:
    """The words of a batch of texts: hash, text, position in it and words of the text."""

    def __init__(self, texts: list[bytes]):
        begins, self.hashes = word_hashes(b"\n".join(texts))
        after = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(begins, after), prepend=0)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.at = np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def sums(self, starts: np.ndarray, n: int, factors: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """A hash, order included, of the windows of n words that start here."""
        words = self.hashes if words is None else words
        out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for i in range(n):
            if i and i % len(factors) == 0:
                out = mixed(out)
            out += words[i : i + len(out)] * factors[i % len(factors)]
        return out[starts]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Words at which an anchor starts, and the anchors' hashes."""
        period, anchor, cover = plan(window)
        count = self.counts[self.text]
        here = np.flatnonzero(np.isin(np.arange(period), cover)[self.at % period] & (self.at <= count - anchor) & (count >= window))
        return here, self.sums(here, anchor, FACTORS).view(np.int64)

    def extended(self, here: np.ndarray, window: int) -> np.ndarray:
        """Words at which a window starts that holds one of these anchors."""
        reach = np.minimum(self.at[here], window - plan(window)[1])
        edges = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edges, here - reach, 1)
        np.subtract.at(edges, here + 1, 1)
        return np.flatnonzero((np.cumsum(edges[:-1]) > 0) & (self.at <= self.counts[self.text] - window))


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words inside windows with these starts."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + window, 1)
    return np.cumsum(edges[:-1]) > 0


def sliced(columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + SLICE], f.type) for c, f in zip(columns, schema)], schema=schema)


def anchors(window: int):
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("key", pa.int64())])

    def mapper(batches):
        for batch in batches:
            words = Words(raw(batch.column(2)))
            here, hashes = words.anchors(window)
            yield from sliced([hashes, *(batch.column(i).to_numpy()[words.text[here]] for i in (0, 1))], schema)

    return mapper


# kind 0: an anchor that two documents share; 1: one alone in its batch, at an edge of it;
# 2: a run at an edge of its batch, from its first document (doc) to its last (key)
SHARED_DDL = "kind int, h bigint, doc bigint, key bigint"
SHARED = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("doc", pa.int64()), ("key", pa.int64())])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared anchors of sorted batches. Only a run at an edge of a batch may go on elsewhere."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, key = (batch.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        last = np.append(first[1:], len(h)) - 1
        shared = doc[first] != doc[last]
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        which = np.repeat(np.arange(len(first)), last - first + 1)
        yes, open_ = shared[which], (edge & ~shared)[which]
        columns = [
            np.concatenate([np.zeros(yes.sum(), np.int32), np.ones(open_.sum(), np.int32), np.full(edge.sum(), 2, np.int32)]),
            np.concatenate([h[yes], h[open_], h[first[edge]]]),
            np.concatenate([doc[yes], doc[open_], doc[first[edge]]]),
            np.concatenate([key[yes], key[open_], doc[last[edge]]]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=SHARED)


# kind 0: a dropped window; 1: one of the first document of its partition, in a run that may have begun
# earlier; 2: the partition's summary: first and last hash, and the document its last run began with
OWNED_NAMES = ("kind", "part", "doc", "key", "at", "h1", "h2", "g1", "g2")
OWNED_DDL = ", ".join(f"{n} bigint" for n in OWNED_NAMES)
OWNED = pa.schema([(n, pa.int64()) for n in OWNED_NAMES])


def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one sorted partition that an earlier document holds.

    A run's first document in the partition is its smallest there, so all others are dropped
    whether or not the run began in an earlier partition; only that document's rows wait.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    head = head_doc = run = began = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, at, key = (batch.column(i).to_numpy() for i in range(5))
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        new[0] = run != (h1[0], h2[0])
        if head is None:
            head, head_doc = (h1[0], h2[0]), doc[0]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        owner = np.where(first >= 0, doc[np.maximum(first, 0)], doc[0] if began is None else began)
        run, began = (h1[-1], h2[-1]), owner[-1]
        waits = (h1 == head[0]) & (h2 == head[1]) & (doc == head_doc)
        out = waits | (doc != owner)
        none = np.zeros(int(out.sum()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (waits[out].astype(np.int64), none + part, doc[out], key[out], at[out], none, none, none, none)], schema=OWNED)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (2, part, began, 0, 0, *head, *run)], schema=OWNED)


def candidates(window: int):
    schema = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc", "at", "key")])
    apart = np.int64(0x5851F42D4C957F2D)

    def mapper(batches):
        for batch in batches:
            words = Words(raw(batch.column(2)))
            here, hashes = words.anchors(window)
            # An anchor and its text as one number: two that meet by chance only add a candidate.
            lists = batch.column(3)
            owners = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            shared = lists.flatten().to_numpy() + owners * apart
            starts = words.extended(here[np.isin(hashes + words.text[here] * apart, shared)], window)
            full = words.sums(starts, window, FACTORS).view(np.int64)
            rest = (words.sums(starts, window, FACTORS_2, mixed(words.hashes)) >> np.uint64(32)).astype(np.int64)
            doc, key = (batch.column(i).to_numpy()[words.text[starts]] for i in (0, 1))
            yield from sliced([full, rest, doc, words.at[starts], key], schema)

    return mapper


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files go as soon as the job that made them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (a null id last), key, text; doc and key tell rows apart.

    Rows that share an id are few, those without one may be many: their keys are longer.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    key = F.pmod(row_key(), F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(1 << 31)))
    return texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), key.alias("key"), "text")


def gathered(rows: DataFrame, value: Column) -> DataFrame:
    """doc_, key_, found: the values of one row's text at most."""
    return rows.groupBy(F.col("doc").alias("doc_"), F.col("key").alias("key_")).agg(F.collect_set(value).alias("found"))


def shared_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, key, h: anchors that start in at least two documents, as a stored table."""
    spark = tuned(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = identified(docs, id_col, text_col).mapInArrow(anchors(window), "h bigint, doc bigint, key bigint")
    with freed(spark):
        found = stored(rows.repartitionByRange(parts, "h", "doc").sortWithinPartitions("h", "doc").mapInArrow(runs, SHARED_DDL), "anchors")
    spans = found.where("kind = 2").groupBy("h").agg(F.min("doc").alias("low"), F.max("key").alias("high")).where("low < high")
    edges = found.where("kind = 1").join(spans, "h", "left_semi")
    return found.where("kind = 0").unionByName(edges.select(*found.columns)).select("doc", "key", "h")


def dropped_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, key, at: starts of the windows that also start in a document of smaller id."""
    spark = tuned(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = gathered(shared_anchors(docs, id_col, text_col, window), F.col("h"))
    texts = identified(docs, id_col, text_col).join(wanted, F.expr("doc = doc_ AND key = key_"))
    fields = "h1 bigint, h2 bigint, doc bigint, at bigint, key bigint"
    with freed(spark):
        near = stored(texts.select("doc", "key", "text", "found").mapInArrow(candidates(window), fields), "windows")
        order = ["h1", "h2", "doc", "at"]
        seen = stored(near.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(owned, OWNED_DDL), "owners")
    later = carried(seen.where("kind = 2").select("part", "doc", "h1", "h2", "g1", "g2").collect())  # one row per partition
    before = spark.createDataFrame(later, "part bigint, owner bigint")
    late = seen.where("kind = 1").join(F.broadcast(before), "part").where("doc <> owner")
    return seen.where("kind = 0").select("doc", "key", "at").unionByName(late.select("doc", "key", "at"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept text: the words that stay, joined by one space."""

    def work(batch: pa.RecordBatch) -> list:
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(raw(batch.column(1))):
            words = text.split()
            n_words.append(len(words))
            gone = batch.column(2)[i]
            if gone.is_valid:
                mask = covered(len(words), gone.values.to_numpy(zero_copy_only=False), window)
                words = [w for w, out in zip(words, mask.tolist()) if not out]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        ids = [None if d == LAST else d for d in batch.column(0).to_pylist()]
        return [ids, n_words, n_removed, pa.array(kept, pa.binary()).cast(pa.string())]

    gone = gathered(dropped_windows(docs, id_col, text_col, window), F.col("at"))
    texts = identified(docs, id_col, text_col).join(gone, F.expr("doc = doc_ AND key = key_"), "left")
    fields = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    return texts.select("doc", "text", "found").mapInArrow(by_rows(fields, work), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
