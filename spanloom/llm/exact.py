"""Exact deduplication: Patricia tries own the texts, terminal nodes hold the row that stays.

Texts are equal when their normalised bytes are (white space deleted). Three steps:

1. every reading task inserts its rows in a trie of its own and hands on one row per different
   text (a group of copies that holds a third of all rows shrinks to one row per task);
2. these rows are dealt out by length and content hash; each partition inserts the full byte
   strings in a compressed radix trie whose terminal nodes hold the best row and the count. A
   trie above its byte budget spills its largest subtree: the subtree's strings, and all later
   ones with that first byte, go to an unnamed task-local file that ends with the task, and
   become a trie of their own afterwards. Local spill needs no recovery: a lost task starts
   again from the shuffle, as with Spark's own spill files;
3. documents, by digest only, are joined to the owners; texts do not move again.

Defined cases: null is empty, all empty texts are one group; of equal texts the one with the
most code points stays, then the smallest id, a null id last; ``group_size`` counts rows,
repeated ones too; rows repeated with the id of the row that stays all carry ``kept`` = true
in ``owners``, and ``dedup`` returns just one of them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_rows, ids_and_texts, one_of_each, out_rows, raw, stored, tuned

TRIE_BYTES = 96 << 20
LAST = (1 << 63) - 1  # stands for a null id in comparisons


class Node:
    """A labelled edge and what hangs below it; ``own`` is set on terminal nodes."""

    __slots__ = ("label", "below", "own")

    def __init__(self, label: bytes, own: tuple | None = None):
        self.label, self.below, self.own = label, {}, own


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def merged(a: tuple | None, b: tuple) -> tuple:
    """(-code points, id, rows in the group, rows that tie for first place)."""
    if a is None:
        return b
    if a[:2] == b[:2]:
        return (*a[:2], a[2] + b[2], a[3] + b[3])
    best = min(a, b)
    return (best[0], best[1], a[2] + b[2], best[3])


class Trie:
    """Compressed radix trie over byte strings with spill by subtree of the root."""

    NODE_BYTES = 300

    def __init__(self, budget: int = TRIE_BYTES, prefix: bytes = b""):
        """``prefix`` is what all strings begin with."""
        self.budget, self.prefix, self.depth = budget, prefix, len(prefix)
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(b""), 0
        self.held: dict[int, int] = {}  # bytes below each first byte
        self.spilled: dict[int, object] = {}

    def insert(self, text: bytes, own: tuple) -> None:
        first = text[self.depth] if len(text) > self.depth else -1
        if first in self.spilled:
            pickle.dump((text, own), self.spilled[first])
            return
        before = self.size
        self._put(text, own)
        self.held[first] = self.held.get(first, 0) + self.size - before

    def _put(self, text: bytes, own: tuple) -> None:
        node, at = self.root, self.depth
        while True:
            if at == len(text):
                node.own = merged(node.own, own)
                return
            child = node.below.get(text[at])
            if child is None:
                node.below[text[at]] = Node(text[at:], own)
                self.size += len(text) - at + self.NODE_BYTES
                return
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = common_prefix(child.label, text[at : at + len(child.label)])
            upper = Node(child.label[:cut])
            upper.below[child.label[cut]] = child
            child.label = child.label[cut:]
            node.below[text[at]] = upper
            self.size += self.NODE_BYTES
            node, at = upper, at + cut

    def spill(self) -> None:
        """Move the largest subtree of the root to a file until the trie fits again."""
        while self.size > self.budget and self.held:
            first = max(self.held, key=self.held.get)
            self.size -= self.held.pop(first)
            if first < 0:
                continue  # the empty rest: a few bytes at the root, they stay
            file = self.spilled[first] = tempfile.TemporaryFile()
            for item in walk(self.root.below.pop(first), self.prefix):
                pickle.dump(item, file)

    def drain(self) -> Iterator[tuple[bytes, tuple]]:
        """All strings held, then those of each spilled subtree; empties the trie."""
        if self.root.own is not None:
            yield self.prefix, self.root.own
        for child in list(self.root.below.values()):
            yield from walk(child, self.prefix)
        spilled, self.root = self.spilled, Node(b"")
        for file in spilled.values():
            file.flush()
            file.seek(0)
            yield from self._again(file)
        self.clear()

    def _again(self, file) -> Iterator[tuple[bytes, tuple]]:
        size = os.fstat(file.fileno()).st_size
        shared = None  # all strings of a subtree share at least its first byte
        if size > self.budget:
            for text, _ in unpickled(file):
                shared = text if shared is None else shared[: common_prefix(shared, text)]
            file.seek(0)
        trie = Trie(self.budget, self.prefix if shared is None else shared)
        for text, own in unpickled(file):
            trie.insert(text, own)
            if trie.size > trie.budget and len(trie.held) > 1:
                trie.spill()
        file.close()
        yield from trie.drain()


def unpickled(file) -> Iterator[tuple[bytes, tuple]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
    """Strings and owners below a node, without recursion."""
    rest = [(node, prefix)]
    while rest:
        node, prefix = rest.pop()
        text = prefix + node.label
        if node.own is not None:
            yield text, node.own
        rest.extend((child, text) for child in node.below.values())


OWNED = {
    "length": pa.int64(), "hash": pa.int64(), "norm": pa.binary(), "rank": pa.int64(),
    "best": pa.int64(), "rows": pa.int64(), "ties": pa.int64(),
}
OWNED_DDL = "length bigint, hash bigint, norm binary, rank bigint, best bigint, rows bigint, ties bigint"
OWNERS = {"digest": pa.binary(), "rank": pa.int64(), "best": pa.int64(), "rows": pa.int64(), "ties": pa.int64()}
OWNERS_DDL = "digest binary, rank bigint, best bigint, rows bigint, ties bigint"


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def combine(budget: int):
    """Step 1: different texts of one reading task. A full trie is emptied and starts again."""

    def rows(batches):
        trie = Trie(budget)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
                trie.insert(normalised(text), (-points, LAST if doc_id is None else doc_id, 1, 1))
            if trie.size > budget:
                yield from trie.drain()
        yield from trie.drain()

    def mapper(batches):
        keyed = ((len(t), xxhash.xxh64_intdigest(t) - (1 << 63), t, *own) for t, own in rows(batches))
        yield from out_rows(OWNED, keyed, lambda row: 64 + row[0])

    return mapper


def own(budget: int):
    """Step 2: the owners of one partition of length and hash."""

    def rows(batches):
        trie = Trie(budget)
        for batch in batches:
            parts = [batch.column(i).to_pylist() for i in range(2, 7)]
            for text, *best in zip(*parts):
                trie.insert(text, tuple(best))
                if trie.size > budget:
                    trie.spill()
        yield from trie.drain()

    def mapper(batches):
        yield from out_rows(OWNERS, ((hashlib.sha256(t).digest(), *best) for t, best in rows(batches)), lambda row: 128)

    return mapper


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points and the digest of the normalised text; no text."""

    def work(batch: pa.RecordBatch) -> list:
        texts = raw(batch.column(1))
        return [
            batch.column(0), [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts],
            [hashlib.sha256(normalised(t)).digest() for t in texts],
        ]

    return docs.mapInArrow(by_rows({"doc_id": pa.int64(), "points": pa.int64(), "of": pa.binary()}, work), "doc_id bigint, points bigint, of binary")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different text: digest, code points, id of the row that stays, rows, ties."""
    tuned(docs.sparkSession)
    texts = ids_and_texts(docs, id_col, text_col).mapInArrow(combine(trie_bytes), OWNED_DDL)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, "length", "hash")
    return dealt.mapInArrow(own(trie_bytes), OWNERS_DDL)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, ties."""
    found = owners(docs, id_col, text_col, trie_bytes)
    rows = digests(ids_and_texts(docs, id_col, text_col)).join(found, F.col("of") == F.col("digest"))
    first = F.when(F.col("best") != LAST, F.col("best"))
    return rows.select(
        "doc_id", first.alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(first) & (F.col("points") == -F.col("rank"))).alias("kept"),
        F.lower(F.hex("of")).alias("text_sha256"), "ties",
    )


def digest_of(text: Column) -> Column:
    """The digest the tries' owners carry, as a built-in expression over the text."""
    return F.unhex(F.sha2(F.translate(text, SPACE.decode(), "").cast("binary"), 256))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, whole and unchanged: one of each group of equal texts."""
    found = stored(owners(docs, id_col, text_col, trie_bytes), "owners")
    wanted = found.select(F.when(F.col("best") != LAST, F.col("best")), "digest", (-F.col("rank")).cast("int"), "ties")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return one_of_each(docs, [docs[id_col].cast("long"), digest_of(text), F.length(text)], wanted)
