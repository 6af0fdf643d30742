"""Quality rules by repetition coverage: how much of a text lies in repeated n-grams and lines.

The words of a text become integers; a rolling hash over them gives the hash of every window
of n words at once (numpy, modulo 2^64). Windows with equal hashes are compared word by word,
so a collision never counts. All characters in words of a repeated window are covered once,
however many windows cover them. Each length has a limit of its own for windows that occur at
least twice and one for those that occur often.

Defined cases: null and empty texts have no words and fail; words and lines compare exactly;
a line is repeated when it equals an earlier line and holds a word; repeated rows are judged
alike; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows, ids_and_texts, raw, tuned

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = re.compile(rb"[#*$%&|<>]")


@dataclass(frozen=True)
class Limits:
    """A text is rejected beyond any of these shares; coverage counts characters in words."""

    min_words: int = 10
    repeat_window: int = 5
    max_repeat_words: float = 0.20
    #: Window length to the largest share of characters inside repeated windows of it. A longer window's share
    #: is never above a shorter one's, so the limits fall.
    coverage: dict[int, float] = field(default_factory=lambda: {2: 0.85, 3: 0.75, 4: 0.65, 6: 0.25, 8: 0.245, 10: 0.24})
    #: The same for windows repeated often; labelled clean texts repeat a line or passage once at most.
    often: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16, 6: 0.14, 8: 0.12, 10: 0.10})
    max_line_chars: float = 0.30

    @staticmethod
    def often_times(n: int, n_words: int) -> int:
        """How many times make often: three; common short phrases also need one in each 100 words."""
        return max(3, n_words // 100) if n < 5 else 3


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n integers: h = ((a*M + b)*M + c)..., all windows at once."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * MULTIPLIER + ids[i : i + len(h)]
    return h


def repeats(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that occur at least twice, and how often each occurs."""
    none = np.zeros(0, np.int64)
    if len(ids) <= n:
        return none, none
    h = rolling(ids, n)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return none, none
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for i in range(n):
        equal &= ids[left + i] == ids[right + i]
    if equal.all():
        in_run = np.append(same, False) | np.append(False, same)
        starts, where = order[in_run], np.cumsum(np.append(True, ~same))[in_run]
        return starts, np.bincount(where)[where]
    # different windows share a hash: compare the windows of such runs themselves
    run = np.union1d(left, right)
    windows = np.stack([ids[run + i] for i in range(n)], axis=1)
    _, where, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    counts = counts[where.ravel()]
    return run[counts > 1], counts[counts > 1]


def inside(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Mask of the words inside the windows of n words with these starts."""
    edges = np.zeros(n_words + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + n, 1)
    return np.cumsum(edges[:-1]) > 0


def repeated_words(ids: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside windows of n words that occur at least twice."""
    return inside(repeats(ids, n)[0], n, len(ids))


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def measure(text: bytes, limits: Limits) -> dict:
    """Counts and shares of one text in UTF-8."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words)) + np.uint64(1)
    chars = np.array([code_points(w) for w in known], np.int64)[(ids - np.uint64(1)).astype(np.int64)] if words else np.zeros(0, np.int64)
    total = int(chars.sum())

    def share(starts: np.ndarray, n: int) -> float:
        return int(chars[inside(starts, n, len(words))].sum()) / max(total, 1)

    repeat, covered, often = 0, dict.fromkeys(sorted(limits.coverage), 0.0), dict.fromkeys(sorted(limits.often), 0.0)
    for n in sorted({limits.repeat_window, *covered, *often}):
        starts, counts = repeats(ids, n)
        if not len(starts):  # then no longer window is repeated either
            break
        if n == limits.repeat_window:
            repeat = int(inside(starts, n, len(words)).sum())
        if n in covered:
            covered[n] = share(starts, n)
        if n in often:
            often[n] = share(starts[counts >= limits.often_times(n, len(words))], n)
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(code_points, line.split()))
        elif line.strip():
            seen.add(line)

    failed = len(words) < limits.min_words or repeat > limits.max_repeat_words * len(words)
    line_share = dup_line_chars / max(total, 1)
    return {
        "n_words": len(words), "word_chars": total, "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed,
        "kept": not failed and line_share <= limits.max_line_chars
        and all(covered[n] <= limits.coverage[n] for n in covered) and all(often[n] <= limits.often[n] for n in often),
        "line_share": line_share, "covered": list(covered.values()), "often": list(often.values()),
    }


FIELDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "line_share": pa.float64(), "covered": pa.list_(pa.float64()), "often": pa.list_(pa.float64()),
}
DDL = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, line_share double, covered array<double>, often array<double>"
)


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, its shares and whether it is kept. No shuffle."""

    def work(batch: pa.RecordBatch) -> list:
        found = [measure(text, limits) for text in raw(batch.column(1))]
        return [batch.column(0), *([x[name] for x in found] for name in list(FIELDS)[1:])]

    tuned(docs.sparkSession)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(by_rows(FIELDS, work), DDL)


def keep(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows that pass, whole and unchanged. No shuffle."""
    tuned(docs.sparkSession)
    at = docs.columns.index(text_col)

    def mapper(batches):
        for batch in batches:
            if batch.num_rows:
                texts = (x or b"" for x in raw(batch.column(at)))
                yield batch.filter(pa.array([measure(t, limits)["kept"] for t in texts], pa.bool_()))

    return docs.mapInArrow(mapper, docs.schema)
