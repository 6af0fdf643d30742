"""Packing token sequences as vector bin packing with the dot-product heuristic.

A piece is a vector of tokens, segments (1) and loss-bearing tokens; a sequence has a limit in
each. Each partition packs its own rows: it holds a pool of pieces and fills one sequence at a
time, always taking the piece whose vector has the largest dot product with what is left of
the limits, among those that fit. With ``cut`` the last gap is filled by cutting a piece, and
a sequence that cannot be filled is cut at powers of two, which need no padding; without it
(whole examples only) the gap is padding. No shuffle; memory is the pool and one batch.

``sequence_id`` is partition number x 2^40 + a count, so a task that runs again gives the same
ids. Defined cases: a null or empty text is the end token alone; a null id stays null; repeated
rows are packed each; an example above a limit raises without ``cut``; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import out_rows, tuned

END = 0
#: Half the length of a white-space run that the rank file's library is not given: it panics above a million.
LONG_SPACE = 50_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


def has_long_space(text: str) -> bool:
    """True if white space runs over 2 x ``LONG_SPACE`` characters: such a run holds one of these blocks whole."""
    return any(text[at : at + LONG_SPACE].isspace() for at in range(0, len(text) - LONG_SPACE + 1, LONG_SPACE))


class Encoder:
    """Byte-level BPE of public vocabulary files; ids as little-endian unsigned 32-bit bytes.

    The rank file gives the ids of the full one several times faster. Texts that may spell a
    special token go through the library that knows it, and so do those with a white-space run of
    100,000 characters or more, on which the fast one's pattern may run out of stack.
    """

    def __init__(self, ranks: str, full: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.full_path, self.full = full, None
        self.lengths = np.zeros(max(table.values()) + 1, np.int32)
        self.lengths[list(table.values())] = [len(token) for token in table]

    def prompt(self, text: str, ids: np.ndarray) -> int:
        """How many leading tokens lie wholly in the first line, if another follows it."""
        head = text.find("\n") + 1
        if not head:
            return 0
        size = len(text[:head].encode("utf-8", "surrogatepass"))
        known = np.minimum(ids[: size + 1], len(self.lengths) - 1)  # a token has a byte at least
        return int(np.searchsorted(np.cumsum(self.lengths[known]), size, side="right"))

    def ids(self, text: str) -> bytes:
        if "<|" in text or has_long_space(text):
            return self.with_specials(text)
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def with_specials(self, text: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.full_path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(ranks: str, full: str) -> Encoder:
    return Encoder(ranks, full)


@dataclass
class Piece:
    """Ids ``start`` to ``stop`` of a document, of which those from ``loss_from`` on bear loss."""

    doc_id: int | None
    ids: np.ndarray
    loss_from: int
    start: int
    stop: int

    def __len__(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return self.stop - max(self.start, min(self.loss_from, self.stop))

    def longest(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix within these limits."""
        free = max(0, min(self.loss_from, self.stop) - self.start)
        return min(tokens, len(self), free + loss)

    def cut(self, length: int) -> tuple["Piece", "Piece"]:
        at = self.start + length
        return Piece(self.doc_id, self.ids, self.loss_from, self.start, at), Piece(self.doc_id, self.ids, self.loss_from, at, self.stop)


class Packer:
    """Fills sequences from a pool of pieces; yields rows of placed pieces."""

    def __init__(self, limits: Limits, cut: bool, base: int, pool: int = 256):
        self.limits, self.may_cut, self.next_id, self.pool_size = limits, cut, base, pool
        self.pool: list[Piece] = []
        self.vectors: list[tuple] = []  # of the pool's pieces
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, doc_id, ids: np.ndarray, loss_from: int = 0) -> Iterator[tuple]:
        piece = Piece(doc_id, ids, loss_from, 0, len(ids))
        if self.may_cut:
            while len(piece) >= self.limits.tokens and piece.longest(self.limits.tokens, self.limits.loss) == self.limits.tokens:
                full, piece = piece.cut(self.limits.tokens)
                yield from self.close([full])
        elif len(piece) > self.limits.tokens or piece.loss > self.limits.loss:
            raise ValueError(f"example {doc_id} has {len(piece)} tokens, {piece.loss} of them loss-bearing: above the limits")
        if len(piece):
            self.pool.append(piece)
            self.vectors.append((len(piece), 1, piece.loss))
        while len(self.pool) > self.pool_size:
            yield from self.fill()

    def finish(self) -> Iterator[tuple]:
        while self.pool:
            yield from self.fill()

    def fill(self) -> Iterator[tuple]:
        """One sequence from the pool."""
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        vectors = np.array(self.vectors, float)
        taken, free = [], np.ones(len(self.pool), bool)
        while left[0] and left[1]:
            fits = free & (vectors <= left).all(axis=1)
            if not fits.any():
                break
            score = (vectors * self.scale) @ (left * self.scale)
            best = int(np.argmax(np.where(fits, score, -1.0)))
            taken.append(self.pool[best])
            free[best] = False
            left -= vectors[best]
        rest = [p for p, f in zip(self.pool, free) if f]
        rest_vectors = [v for v, f in zip(self.vectors, free) if f]
        if self.may_cut and left[0] and left[1] and rest:
            lengths = [p.longest(int(left[0]), int(left[2])) for p in rest]
            best = int(np.argmax(lengths))
            if lengths[best]:
                head, tail = rest.pop(best).cut(lengths[best])
                rest_vectors.pop(best)
                taken.append(head)
                if len(tail):
                    rest.append(tail)
                    rest_vectors.append((len(tail), 1, tail.loss))
        self.pool, self.vectors = rest, rest_vectors
        yield from self.close(taken)

    def close(self, pieces: list[Piece]) -> Iterator[tuple]:
        """Rows of one sequence; if it is not full and may be cut, of its powers of two."""
        total = sum(map(len, pieces))
        sizes = [total]
        if self.may_cut and total < self.limits.tokens:
            sizes = [1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1]
        queue = list(reversed(pieces))
        for size in sizes:
            offset = 0
            while offset < size:
                piece = queue.pop()
                if len(piece) > size - offset:
                    piece, tail = piece.cut(size - offset)
                    queue.append(tail)
                ids = piece.ids[piece.start : piece.stop].astype("<u4")
                yield piece.doc_id, piece.start, len(piece), ids.tobytes(), len(piece.ids), self.next_id, offset
                offset += len(piece)
            self.next_id += 1


PIECES = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
}
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_ids(examples: Iterable[tuple], limits: Limits, cut: bool, base: int) -> Iterator[tuple]:
    """Rows for (id, ids, first loss-bearing index) of one partition."""
    packer = Packer(limits, cut, base)
    for doc_id, ids, loss_from in examples:
        yield from packer.add(doc_id, ids, loss_from)
    yield from packer.finish()


def pack(docs: DataFrame, ranks: str | None = None, full: str | None = None, limits: Limits = Limits(), cut: bool = True,
         id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, prompt_line: bool = False) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece.

    ``ranks`` and ``full`` are the vocabulary's files (by default those of the public 50k byte
    BPE). ``prompt_col`` holds how many leading tokens bear no loss; with ``prompt_line`` the
    first line of a text of several lines is its prompt; otherwise all tokens bear loss.
    """
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    full = full or public_tokenizers.path("byte_bpe_50k.json")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(str(ranks), str(full))
        end = np.array([END], "<u4").tobytes()

        def examples():
            for batch in batches:
                for doc_id, text, prompt in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    ids = np.frombuffer(coder.ids(text) + end, "<u4")
                    yield doc_id, ids, coder.prompt(text, ids) if prompt_line else prompt

        base = TaskContext.get().partitionId() << 40
        yield from out_rows(PIECES, pack_ids(examples(), limits, cut, base), lambda row: 64 + len(row[3]))

    tuned(docs.sparkSession)
    prompt = F.lit(0) if prompt_col is None else F.coalesce(F.col(prompt_col).cast("int"), F.lit(0))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(mapper, PIECES_DDL)
