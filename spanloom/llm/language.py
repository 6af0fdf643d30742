"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a variable-order context tree: counts of the byte that follows the last
``order``, ..., 1, 0 bytes. A byte is coded in the longest context that has seen it; each
longer context that was seen but not with this byte costs an escape (method C: distinct
followers / (count + distinct followers)); bytes never seen at all are coded evenly over 256.
The code length of a text under each language's frozen counts is exact, and the shortest wins.

Counts come from a bounded sample of labelled text, about ``sample_bytes`` bytes a language and,
with many languages, an even share of ``all_sample_bytes`` each: blocks of 4 KB of all its rows, chosen by a hash of id, text and place, so that few long
texts are sampled like many short ones. The trees have a bounded size and are broadcast. All
rows are predicted, over whole texts, a megabyte at a time, so a very long text costs time in
proportion and little memory beside its own. Texts are lower-cased (A-Z); each different context
and byte of a batch is looked up once.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled
rows all are ``und``; ties go to the first language by name; repeated rows are predicted alike;
an empty table gives an empty result. ``score`` is the winner's share of the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_crc, out_rows, row_key, stored, tuned

ORDER = 4
SAMPLE_BYTES = 1_500_000
ALL_SAMPLE_BYTES = 24_000_000  # of all languages together; each has one block of BLOCK bytes at least
BLOCK = 4096  # bytes of a text that are sampled together
LIKE_LETTERS = re.compile(r"[^\W\d_]+")  # also numeric signs such as fractions, which are no letters
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character of any category L is in the text."""
    return any(c.isalpha() for found in LIKE_LETTERS.finditer(text) for c in found.group())


def grams(data: bytes, order: int) -> np.ndarray:
    """For each byte, itself and the ``order`` bytes before it, as one number; spaces lead in."""
    return windows(b" " * order + data, order)


def windows(data: bytes, order: int) -> np.ndarray:
    """The same for the bytes from ``order`` on."""
    padded = np.frombuffer(data.lower(), np.uint8).astype(np.uint64)
    n = len(padded) - order
    out = np.zeros(n, np.uint64)
    for i in range(order + 1):
        out |= padded[i : i + n] << np.uint64(8 * (order - i))
    return out


@dataclass
class Tree:
    """Counts of one language at each order, as sorted arrays."""

    order: int
    keys: list[np.ndarray]  # context and byte, by order
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]  # different followers

    @classmethod
    def from_grams(cls, order: int, keys: np.ndarray, counts: np.ndarray) -> "Tree":
        """From counts of the longest grams: shorter contexts are sums of longer ones."""
        tree = cls(order, [], [], [], [], [])
        for o in range(order + 1):
            mask = np.uint64((1 << 8 * (o + 1)) - 1)
            k, where = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(where, counts, len(k))
            context, back = np.unique(k >> np.uint64(8), return_inverse=True)
            tree.keys.append(k)
            tree.counts.append(n)
            tree.contexts.append(context)
            tree.totals.append(np.bincount(back, n, len(context)))
            tree.kinds.append(np.bincount(back, minlength=len(context)).astype(float))
        return tree

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        cost, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for o in range(self.order, -1, -1):
            key = grams[open_] & np.uint64((1 << 8 * (o + 1)) - 1)
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[o], context), len(self.contexts[o]) - 1)
            seen = self.contexts[o][at] == context
            where = np.minimum(np.searchsorted(self.keys[o], key), len(self.keys[o]) - 1)
            hit = self.keys[o][where] == key
            room = self.totals[o][at] + self.kinds[o][at]
            cost[open_[hit]] -= np.log2(self.counts[o][where[hit]] / room[hit])
            escape = seen & ~hit
            cost[open_[escape]] -= np.log2(self.kinds[o][at[escape]] / room[escape])
            open_ = open_[~hit]
        cost[open_] += 8.0
        return cost


def sample(labelled: DataFrame, sample_bytes: int, order: int = ORDER, all_sample_bytes: int = ALL_SAMPLE_BYTES) -> DataFrame:
    """lang, block: blocks of all rows by their hash, each language at about ``sample_bytes`` bytes in expectation,
    or at its even share of ``all_sample_bytes`` where that is less.

    A block begins with the ``order`` bytes before it. A language without a chosen block gets the one of smallest
    hash; blocks of equal rows have equal hashes and count once.
    """
    # Written first, so that Spark sees how small it is and leaves the texts where they are.
    sizes = stored(labelled.groupBy(F.col("lang").alias("its_lang")).agg(F.sum(F.octet_length("text")).alias("all_bytes")), "language-sizes")
    each = min(sample_bytes, all_sample_bytes / max(sizes.count(), 1))
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.greatest(F.col("all_bytes"), F.lit(1)))
    data = F.concat(F.lit(b" " * order), F.col("text").cast("binary"))
    last = F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / BLOCK).cast("int")
    place = lambda number: F.pmod(F.xxhash64("key", number), F.lit(1 << 62))
    places = F.transform(F.sequence(F.lit(0), last), lambda n: F.struct(place(n).alias("place"), n.alias("number")))
    block = F.substring(F.col("data"), F.col("at.number") * BLOCK + 1, F.lit(BLOCK + order)).alias("block")
    rows = labelled.where(F.length("text") > 0).select("lang", row_key().alias("key"), data.alias("data"), places.alias("places"))

    sized = rows.join(sizes, F.col("lang") == F.col("its_lang")).withColumn("bound", share * float(1 << 62))
    chosen = sized.select("lang", "data", F.explode(F.filter("places", lambda p: p["place"] < F.col("bound"))).alias("at"))
    # A place stands for a row's id and text and a block's number, so either of two equal ones will do.
    blocks = stored(chosen.select("lang", "at.place", block).groupBy("lang", "place").agg(F.first("block").alias("block")).select("lang", "block"), "language-sample")
    left_out = sizes.join(blocks, F.col("its_lang") == F.col("lang"), "left_anti").select("its_lang")
    if left_out.isEmpty():
        return blocks
    least = rows.join(left_out, F.col("lang") == F.col("its_lang"), "left_semi").select("lang", "data", F.array_min("places").alias("at"))
    return blocks.unionByName(least.select("lang", block, "at.place").groupBy("lang").agg(F.min_by("block", "place").alias("block")))


def learn(labelled: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> dict[str, Tree]:
    """Trees by language. The counts brought to the driver are bounded by the sample's bytes."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(windows(block, order))
        for lang, found in held.items():
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield from out_rows({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}, ((lang, k, n) for k, n in zip(keys.tolist(), counts.tolist())))

    parts = sample(labelled, sample_bytes, order).mapInArrow(mapper, "lang string, gram bigint, n bigint")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    frame = counts.to_pandas()
    return {lang: Tree.from_grams(order, g["gram"].to_numpy().astype(np.uint64), g["n"].to_numpy().astype(float)) for lang, g in sorted(frame.groupby("lang"))}


PREDICTED = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}
CHUNK = 1_000_000  # bytes looked up at a time


def predict_batch(texts: list[str | None], trees: dict[str, Tree], order: int) -> tuple[list[str], list[float]]:
    names = list(trees)
    chosen, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
    bits = np.zeros((len(rows), len(names)))

    def add(some: list[tuple[int, np.ndarray]]) -> None:
        codes, different = pd.factorize(np.concatenate([g for _, g in some]))
        starts = np.concatenate([[0], np.cumsum([len(g) for _, g in some])[:-1]])
        found = np.stack([np.add.reduceat(trees[name].bits(different)[codes], starts) for name in names], axis=1)
        np.add.at(bits, [row for row, _ in some], found)

    some, size = [], 0
    for row, i in enumerate(rows):
        data = b" " * order + texts[i].encode("utf-8", "surrogatepass")
        for at in range(0, len(data) - order, CHUNK):
            some.append((row, windows(data[at : at + CHUNK + order], order)))
            size += len(some[-1][1])
            if size >= CHUNK:
                add(some)
                some, size = [], 0
    if some:
        add(some)
    if rows:
        share = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
        share /= share.sum(axis=1, keepdims=True)
        for i, best, s in zip(rows, bits.argmin(axis=1), share):
            chosen[i], scores[i] = names[best], float(s[best])
    return chosen, scores


def predict(docs: DataFrame, trees: dict[str, Tree], order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(PREDICTED.items()))
        for batch in batches:
            if batch.num_rows:
                chosen, scores = predict_batch(batch.column(1).to_pylist(), shared.value, order)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(mapper, "doc_id bigint, lang_pred string, score double")


def train_and_predict(docs: DataFrame, held_out: Callable[[Column], Column], order: int = ORDER, sample_bytes: int = SAMPLE_BYTES,
                      id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; held-out rows are never learnt from."""
    tuned(docs.sparkSession)
    out = held_out(held_out_crc(F.col("doc_id")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    trees = learn(rows.where(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()), order, sample_bytes)
    return predict(rows, trees, order).select("doc_id", out.alias("held_out"), "lang_pred", "score")
