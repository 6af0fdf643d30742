"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the first turns of a base conversation followed by the own turns
after as many. No rebuilt text is made: the fingerprint of a sequence of turns is a value in a
monoid, (length, polynomial in a fixed base modulo 2^127 - 1), where

    (n, v) * (m, w) = (n + m, v * B^m + w),

so the prefixes of base and own turns, each found once, give every rebuilt prefix: with head H
of the base and own prefixes O, the turn after k own ones past the head has
O(h+k) + (H - O(h)) * B^k.

1. Turns are dealt out by range of (conversation, turn) and sorted; a task multiplies along
   each conversation, and one row per partition (its last conversation's product) carries the
   product into the next, so a giant conversation spreads over many tasks.
2. A conversation's first ``longest_head`` products meet its dependents (hot bases are split).
3. Rebuilt prefixes group by (depth, fingerprint) to nodes. Each prefix also keeps a reference
   to its last turn (128 bits of its SHA-256) and its parent's fingerprint; a group must agree
   on both, which by induction makes equal fingerprints equal sequences. If one ever does not,
   all is done again with another base.
4. Sums over subtrees take no walk of the tree. A subtree's conversations are its top's
   members. Summed over members, the bytes from the top's depth to the member's end count each
   node as often as it has members. And each node belongs to its smallest member, which owns
   the lower end of its own path; summed over members, owned bytes and owned leaves count each
   node once.

Ties of turn are ordered by role, then SHA-256 of the text; a null turn is first.

Defined cases: null roles and texts are empty; a null conversation id names no conversation and
its rows are left out; repeated rows are turns of their own; a conversation whose base has no
rows has an empty head; a conversation may be without turns and then ends at the root; an empty
table gives no nodes, not even a root; other columns are not read. Texts, however long, are
read once and reduced to a hash and a length before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import lookup_join
from .common import out_rows, stored, tuned

MODULUS = (1 << 127) - 1
LOW = (1 << 64) - 1


def base_of(attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(f"prefix trie {attempt}".encode()).digest()[:15]) | 1


def halves(value: int) -> tuple[int, int]:
    """A fingerprint as two signed 64-bit numbers."""
    low = value & LOW
    return value >> 64, low - (1 << 64) if low >> 63 else low


def whole(high: int, low: int) -> int:
    return high << 64 | low & LOW


def joined(left: tuple[int, int], right: tuple[int, int], base: int) -> tuple[int, int]:
    """The product of two sequences' (length, value)."""
    return left[0] + right[0], (left[1] * pow(base, right[0], MODULUS) + right[1]) % MODULUS


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, digest, size: what is known of a turn without its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )


# kind 0: a turn (at: its place in the conversation, bytes: of all turns so far); 1: a turn of the
# partition's first conversation; 2: the partition's first (m1) and last conversation and the last's product
PREFIX_NAMES = ("kind", "part", "conv", "at", "v1", "v2", "bytes", "m1", "m2", "size")
PREFIX = {n: pa.int64() for n in PREFIX_NAMES}
PREFIX_DDL = ", ".join(f"{n} bigint" for n in PREFIX_NAMES)


def multiplied(base: int):
    """Products along the conversations of one sorted partition."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            first = now = None
            at = value = total = 0
            for batch in batches:
                marks = np.frombuffer(b"".join(m[:16] for m in batch.column(1).to_pylist()), "<i8").reshape(-1, 2).tolist()
                for conv, (m1, m2), size in zip(batch.column(0).to_pylist(), marks, batch.column(2).to_pylist()):
                    if conv != now:
                        first = conv if first is None else first
                        now, at, value, total = conv, 0, 0, 0
                    at += 1
                    value = (value * base + whole(m1, m2)) % MODULUS
                    total += size
                    yield int(conv == first), part, conv, at, *halves(value), total, m1, m2, size
            if now is not None:
                yield 2, part, now, at, *halves(value), total, first, 0, 0

        return out_rows(PREFIX, rows())

    return mapper


def carries(summaries: list, base: int) -> dict[int, tuple[int, int, int]]:
    """Partition to (turns, product, bytes) of its first conversation in earlier partitions."""
    out, before, conv = {}, (0, 0, 0), None
    for s in sorted(summaries, key=lambda s: s.part):
        if s.m1 == conv:
            out[s.part] = before
        own = (s.at, whole(s.v1, s.v2))
        if s.m1 == s.conv == conv:  # the whole partition is one conversation's
            before = (*joined(before[:2], own, base), before[2] + s.bytes)
        else:
            before = (*own, s.bytes)
        conv = s.conv
    return out


def carried(found: dict[int, tuple[int, int, int]], base: int):
    """The turns of partitions' first conversations, as parts of the whole conversation."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for kind, part, conv, at, v1, v2, total, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    turns_before, value, bytes_before = found[part]
                    at, value = joined((turns_before, value), (at, whole(v1, v2)), base)
                    yield kind, part, conv, at, *halves(value), total + bytes_before, *rest

        return out_rows(PREFIX, rows())

    return mapper


def prefixes(rows: DataFrame, base: int) -> DataFrame:
    """conv, at, v1, v2, bytes, m1, m2, size: every conversation's own prefixes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    mark = F.unhex(F.sha2(F.concat("digest", F.col("role").cast("binary")), 256))
    in_order = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", mark.alias("mark"), "size")
    found = stored(in_order.mapInArrow(multiplied(base), PREFIX_DDL), "prefixes")
    later = carries(found.where("kind = 2").collect(), base)  # one row per partition
    all_turns = found.where("kind < 2")
    if later:
        moved = (F.col("kind") == 1) & F.col("part").isin(list(later))
        all_turns = all_turns.where(~moved).unionByName(all_turns.where(moved).mapInArrow(carried(later, base), PREFIX_DDL))
    return all_turns.drop("kind", "part")


PATH_NAMES = ("conv", "depth", "v1", "v2", "p1", "p2", "m1", "m2", "size", "tail", "ends")
PATH = {n: pa.int64() for n in PATH_NAMES}
PATH_DDL = ", ".join(f"{n} bigint" for n in PATH_NAMES)


def parent(value: int, mark: int, inverse: int) -> int:
    return (value - mark) * inverse % MODULUS


def head_paths(base: int):
    """The root and the head's prefixes of each conversation: rows of (conv, turns, bytes, head)."""
    inverse = pow(base, -1, MODULUS)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for conv, length, total, head in zip(*(c.to_pylist() for c in batch.columns)):
                    yield conv, 0, 0, 0, 0, 0, 0, 0, 0, total, int(length == 0)
                    for x in head or ():
                        up = halves(parent(whole(x["v1"], x["v2"]), whole(x["m1"], x["m2"]), inverse))
                        tail = total - x["bytes"] + x["size"]
                        yield conv, x["at"], x["v1"], x["v2"], *up, x["m1"], x["m2"], x["size"], tail, int(x["at"] == length)

        return out_rows(PATH, rows())

    return mapper


def own_paths(base: int):
    """Prefixes that end in an own turn: the head's product and the own turns' combined."""
    inverse = pow(base, -1, MODULUS)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for conv, at, v1, v2, done, m1, m2, size, skipped, shift, h1, h2, o1, o2, length, total_own, total in zip(*(c.to_pylist() for c in batch.columns)):
                    depth = at + shift
                    value = (whole(v1, v2) + (whole(h1, h2) - whole(o1, o2)) * pow(base, at - skipped, MODULUS)) % MODULUS
                    up = halves(parent(value, whole(m1, m2), inverse))
                    yield conv, depth, *halves(value), *up, m1, m2, size, total_own - done + size, int(depth == length)

        return out_rows(PATH, rows())

    return mapper


def paths(own: DataFrame, base: int, base_conv: Callable[[Column], Column], head_turns: Callable[[Column], Column], longest_head: int) -> DataFrame:
    """Every rebuilt prefix: conv, depth, fingerprint, parent's, last turn's reference and size,
    tail (bytes from this turn to the end) and whether the conversation ends here."""
    first = F.when(F.col("at") <= longest_head, F.struct("at", "v1", "v2", "bytes", "m1", "m2", "size"))
    convs = own.groupBy("conv").agg(F.max("at").alias("turns"), F.max("bytes").alias("bytes"), F.sort_array(F.collect_list(first)).alias("heads"))
    convs = stored(convs.select("*", base_conv(F.col("conv")).alias("base"), head_turns(F.col("conv")).cast("int").alias("skipped")), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    both = lookup_join(convs, bases, ["base"])
    head = F.slice("base_heads", F.lit(1), F.col("skipped"))
    last = lambda x: F.when(F.size(x) > 0, F.element_at(x, -1))
    none = F.lit(0).cast("long")
    known = both.select(
        "conv", "turns", "skipped", "bytes", F.when(F.col("base_heads").isNotNull(), head).otherwise(F.array().cast("array<struct<at:bigint,v1:bigint,v2:bigint,bytes:bigint,m1:bigint,m2:bigint,size:bigint>>")).alias("head"),
        last(F.slice("heads", F.lit(1), F.col("skipped"))).alias("replaced"),
    ).select("*", last(F.col("head")).alias("end"), F.size("head").cast("long").alias("n_head"), F.greatest(F.col("turns") - F.col("skipped"), none).alias("n_own"))
    value = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), none)
    # A conversation that is all head has no own turns left; its replaced turns count for nothing.
    own_bytes = F.when(F.col("n_own") > 0, F.col("bytes") - value("replaced", "bytes")).otherwise(none)
    known = stored(
        known.select(
            "conv", "skipped", "head", "bytes", (F.col("n_head") - F.col("skipped")).alias("shift"), (F.col("n_head") + F.col("n_own")).alias("length"),
            (value("end", "bytes") + own_bytes).alias("total"),
            *(value(s, f).alias(f"{s[0]}{f[1]}") for s in ("end", "replaced") for f in ("v1", "v2")),
        ),
        "heads",
    )
    heads = known.select("conv", "length", "total", "head").mapInArrow(head_paths(base), PATH_DDL)
    constants = known.select("conv", "skipped", "shift", F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("r1").alias("o1"), F.col("r2").alias("o2"), "length", F.col("bytes").alias("total_own"), "total")
    rest = lookup_join(own, constants, ["conv"], how="inner").where("at > skipped")
    return heads.unionByName(rest.mapInArrow(own_paths(base), PATH_DDL))


def end_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, sorted, as text: a row for each node and batch."""
    fields = {"depth": pa.int64(), "v1": pa.int64(), "v2": pa.int64(), "first": pa.int64(), "ids": pa.string()}

    def rows():
        for batch in batches:
            run, key = [], None
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != key:
                    if run:
                        yield *key, run[0], ",".join(map(str, run))
                    run, key = [], node
                run.append(conv)
            if run:
                yield *key, run[0], ",".join(map(str, run))

    return out_rows(fields, rows(), weight=lambda row: 64 + len(row[4]))


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = {"depth": pa.int64(), "v1": pa.int64(), "v2": pa.int64(), "ends_sha256": pa.string()}

    def rows():
        key = running = None
        for batch in batches:
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != key:
                    if running:
                        yield *key, running.hexdigest()
                    key, running = node, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
        if running:
            yield *key, running.hexdigest()

    return out_rows(fields, rows())


def ends(every: DataFrame) -> DataFrame:
    """depth, v1, v2, ends_sha256 of the nodes at which conversations end.

    Ids travel as text by the batch, so the task that hashes a node reads few rows of it.
    """
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["depth", "v1", "v2"]
    found = every.where("ends = 1").select(*node, "conv").repartitionByRange(parts, *node, "conv").sortWithinPartitions(*node, "conv")
    chunks = found.mapInArrow(end_chunks, "depth bigint, v1 bigint, v2 bigint, first bigint, ids string")
    in_order = chunks.repartition(parts, *node).sortWithinPartitions(*node, "first").select(*node, "ids")
    return in_order.mapInArrow(end_digests, "depth bigint, v1 bigint, v2 bigint, ends_sha256 string")


def trie(
    rows: DataFrame,
    base_conv: Callable[[Column], Column],
    head_turns: Callable[[Column], Column],
    longest_head: int,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    base_for: Callable[[int], int] = base_of,
) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``base_conv`` and ``head_turns`` give a conversation's base and how many of its turns (at
    most ``longest_head``) replace as many own ones.
    """
    tuned(rows.sparkSession)
    known = turns(rows, conv_col, turn_col, role_col, text_col)
    node = ["depth", "v1", "v2"]
    for attempt in count():
        base = base_for(attempt)
        every = stored(paths(prefixes(known, base), base, base_conv, head_turns, longest_head), "paths")
        same = [f(c).alias(f"{n}_{c}") for c in ("p1", "p2", "m1", "m2") for n, f in (("low", F.min), ("high", F.max))]
        nodes = stored(every.groupBy(*node).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), *same), "nodes")
        if nodes.where(" OR ".join(f"low_{c} <> high_{c}" for c in ("p1", "p2", "m1", "m2"))).isEmpty():
            break
    nodes = nodes.select(*node, "conv_id", "n_convs", "size", F.col("low_p1").alias("p1"), F.col("low_p2").alias("p2"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("v1"), F.col("p2").alias("v2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, node, "left").na.fill(0, ["n_children"]), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("start"), F.sum("size").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")
    )
    parts = lookup_join(every.select(*node, "conv", "tail"), owned, ["conv"])
    once = F.when(F.col("depth") >= F.col("start"), F.col("tail")).otherwise(F.coalesce("owned", F.lit(0)))
    sums = parts.groupBy(*node).agg(F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"), F.sum(F.col("tail") - once).alias("saved_tokens"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("v1").alias("p1"), F.col("v2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    with_parent = lookup_join(nodes, above, ["depth", "p1", "p2"])
    empty = hashlib.sha256().hexdigest()
    return (
        with_parent.join(sums, node).join(ends(every), node, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    )
