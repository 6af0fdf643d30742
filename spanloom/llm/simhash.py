"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in few bits lie near each other in Gray order more often than in
numeric order. The index is a hierarchy over that order:

1. different fingerprints are dealt out by range of their Gray rank and sorted: the leaves;
2. runs of ``FANOUT`` neighbours get an upper node with the bits all of them share (mask and
   value); runs of nodes get a node in turn, up to one top node per partition;
3. a search goes down from the top and adds up the differing bits that nodes fix: once they
   exceed the limit, the whole group below is pruned;
4. top nodes (one row per partition, whatever the input) tell which partitions a fingerprint
   must also be searched in; each pair of partitions is searched once.

Links are joined at once within each task: a search returns one link for each group of already
linked fingerprints, not one per pair, so large groups of near copies stay linear. Different
fingerprints have at most 2080 others within 2 bits, which bounds the work of a search.
Components come from repeated minimum labels over the links with pointer jumping, as tables in
the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle are one shingle; repeated shingles count each time; repeated rows share their
fingerprint; a null id is larger than all others; an empty table gives an empty result. A very
long text is one row of a task: its words, their ends and hashes take about 200 bytes a word
while its fingerprint is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, ids_and_texts, one_of_each, raw, row_key, stored, tuned

SHINGLE = 3
MAX_BITS = 2
FANOUT = 16
SEED = 42
#: Each bit of a byte as a byte of its own; up to 255 of these add up without carry.
LANES = np.array([int.from_bytes(bytes(b >> i & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    counts = np.zeros(64, np.int64)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(columns), 255):
        lanes = LANES[columns[at : at + 255]].sum(axis=0, dtype=np.uint64)
        counts += lanes.astype("<u8").view(np.uint8)
    return counts


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    over_half = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over_half, bitorder="little").tobytes(), "little")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the prefix XOR of its bits from the top."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Tree:
    """Levels of (mask, value) over fingerprints in Gray order; level 0 are the fingerprints."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None):
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(full if masks is None else masks, codes)]
        while len(self.levels[-1][0]) > FANOUT:
            mask, value = self.levels[-1]
            starts = np.arange(0, len(mask), FANOUT)
            # Bits fixed in all children and equal in all of them.
            ones = np.bitwise_and.reduceat(value & mask, starts)
            zeros = np.bitwise_and.reduceat(~value & mask, starts)
            self.levels.append((ones | zeros, ones))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) index pairs within ``limit`` differing bits; whole groups are pruned."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, value = self.levels[depth]
            stays = popcount((queries[query] ^ value[node]) & mask[node]) <= limit
            query, node = query[stays], node[stays]
            if depth:
                size = len(self.levels[depth - 1][0])
                first = node * FANOUT
                n = np.minimum(FANOUT, size - first)
                query = np.repeat(query, n)
                node = np.repeat(first, n) + (np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n))
        return query, node


class Groups:
    """Union-find over 0..n-1; the smallest index is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link all pairs: hook larger roots on smaller ones, jump pointers, until none is left."""
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = p[p]
                if np.array_equal(up, p):
                    break
                p = up
            self.parent = p


STEP = 512  # queries searched at a time
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Range:
    """The index of one range of Gray ranks, its own links joined to groups."""

    def __init__(self, codes: np.ndarray, limit: int):
        self.codes, self.limit = codes, limit
        self.tree, self.groups = Tree(codes), Groups(len(codes))
        for at in range(0, len(codes), STEP):
            q, leaf = self.tree.search(codes[at : at + STEP], limit)
            above = leaf < q + at
            self.groups.join(q[above] + at, leaf[above])

    def own_links(self) -> Iterator[pa.RecordBatch]:
        """Each member and the first of its group."""
        other = np.flatnonzero(self.groups.parent != np.arange(len(self.codes)))
        yield from link_rows(self.codes[other], self.codes[self.groups.parent[other]])

    def links_of(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each query and the first of every group it touches."""
        for at in range(0, len(queries), STEP):
            asked = queries[at : at + STEP]
            q, leaf = self.tree.search(asked, self.limit)
            if len(q):
                found = np.unique(np.stack([q, self.groups.parent[leaf]]), axis=1)
                yield from link_rows(asked[found[0]], self.codes[found[1]])


def link_rows(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINK)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, asks, codes) for runs of rows with equal part and role."""
    for batch in batches:
        if batch.num_rows:
            part, asks, code = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.r_[0, np.flatnonzero(np.diff(part * 2 + asks)) + 1, len(part)]
            for low, high in zip(cuts, cuts[1:]):
                yield part[low], asks[low], code[low:high].view(np.uint64)


def link(limit: int):
    """Links of whole ranges; of a range, members come first, then queries sent by others."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, index = None, [], None
        for part, asks, codes in runs(batches):
            if part != now:
                if members and index is None:
                    yield from Range(np.concatenate(members), limit).own_links()
                now, members, index = part, [], None
            if not asks:
                members.append(codes)
                continue
            if index is None:
                index = Range(np.concatenate(members), limit)
                yield from index.own_links()
            yield from index.links_of(codes)
        if members and index is None:
            yield from Range(np.concatenate(members), limit).own_links()

    return mapper


def route(tops: list[tuple[int, int, int]], limit: int):
    """Send each fingerprint to its own range and to those its top node cannot rule out.

    Of two ranges, which one asks the other goes by the parity of their sum, so all ask alike.
    """
    parts = np.array([p for p, _, _ in tops], np.int64)
    values = np.array([ones for _, ones, _ in tops], np.int64).view(np.uint64)
    masks = values | np.array([zeros for _, _, zeros in tops], np.int64).view(np.uint64)
    schema = pa.schema([("part", pa.int64()), ("asks", pa.int64()), ("code", pa.int64())])

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(values, masks) if len(parts) else None
        for batch in batches:
            own, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(code), STEP):
                o, c = own[at : at + STEP], code[at : at + STEP]
                yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(np.zeros(len(o), np.int64)), pa.array(c)], schema=schema)
                q, node = tree.search(c.view(np.uint64), limit)
                there = parts[node]
                sent = ((o[q] < there) == ((o[q] + there) % 2 == 0)) & (o[q] != there)
                q, there = q[sent], there[sent]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.ones(len(q), np.int64)), pa.array(c[q])], schema=schema)

    return mapper


def rank_column(code: str):
    """Gray rank of a signed 64-bit code, as a signed number in the order of unsigned ranks."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def links(codes: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(a, b) over a table of different fingerprints ``code``: enough links to join all that are
    connected by steps of at most ``limit`` differing bits."""
    spark = codes.sparkSession
    n_ranges = max(1, math.ceil(math.sqrt(codes.count()) / 16))
    ranges = codes.select("code", rank_column("code").alias("rank")).repartitionByRange(n_ranges, "rank").sortWithinPartitions("rank")
    ranges = stored(ranges.select(F.spark_partition_id().cast("long").alias("part"), "code"), "gray-ranges")
    tops = ranges.groupBy("part").agg(F.bit_and("code").alias("ones"), F.bit_and(F.bitwise_not("code")).alias("zeros"))
    tops = sorted(tuple(r) for r in tops.collect())  # one row per range
    routed = ranges.mapInArrow(route(tops, limit), "part bigint, asks bigint, code bigint")
    dealt = routed.repartition(max(1, len(tops)), "part").withColumn("rank", rank_column("code")).sortWithinPartitions("part", "asks", "rank")
    return dealt.select("part", "asks", "code").mapInArrow(link(limit), "a bigint, b bigint")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node that u is connected to, for all u but the smallest ones.

    Alternating large and small stars: neighbours above a node hang on its smallest neighbour,
    then the node and its neighbours below do. Minimums are partial aggregates and joins, so a
    node with many neighbours is never gathered.
    """
    order = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(order(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
        around = both_ways(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = around.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(order(large), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        down = large.join(least, F.col("u") == F.col("w"))
        edges = stored(order(down.select("u", F.col("m").alias("v")).unionByName(down.select(F.col("v").alias("u"), F.col("m").alias("v")))), "small-star")


LAST = (1 << 63) - 1
PRINTS_DDL = "doc_id bigint, key bigint, code bigint"


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the row's content), code: the signed 64-bit fingerprint."""

    def work(batch: pa.RecordBatch) -> list:
        codes = np.array([fingerprint(t, shingle) for t in raw(batch.column(2))], np.uint64)
        return [batch.column(0), batch.column(1), pa.array(codes.view(np.int64))]

    tuned(docs.sparkSession)
    rows = ids_and_texts(docs, id_col, text_col).select("doc_id", row_key().alias("key"), "text")
    return rows.mapInArrow(by_rows({"doc_id": pa.int64(), "key": pa.int64(), "code": pa.int64()}, work), PRINTS_DDL)


def components(prints: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """code, doc, key, ties: for each different fingerprint the smallest row of its component.

    ``ties`` counts the rows that repeat it; ``doc`` is LAST for a null id.
    """
    rows = prints.groupBy("code", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "key").agg(F.count("*").alias("ties"))
    codes = stored(rows.groupBy("code").agg(F.min(F.struct("doc", "key", "ties")).alias("first")), "fingerprints")
    linked = stars(links(codes, limit))
    rooted = codes.join(linked, F.col("code") == F.col("u"), "left").select("code", "first", F.coalesce("v", "code").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "its_root")
    return rooted.join(first, F.col("root") == F.col("its_root")).select("code", "least.*")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    found = components(prints, max_bits).select(F.col("code").alias("its"), F.when(F.col("doc") != LAST, F.col("doc")).alias("component_id"))
    rows = prints.join(found, F.col("code") == F.col("its"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole: the smallest id of each component."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    least = stored(components(prints, max_bits).select(F.when(F.col("doc") != LAST, F.col("doc")), "key", "ties").distinct(), "near-kept")
    return one_of_each(docs, [docs[id_col].cast("long"), row_key(docs[id_col], docs[text_col])], least)
