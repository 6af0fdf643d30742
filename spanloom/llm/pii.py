"""Personal data: patterns find clear cases, a skip-chain CRF finds more.

Patterns give the base spans. The conditional random field labels the tokens (white-space
words) that hold a digit or an at sign; every other token is outside by rule. Its factors:

* node: the token's shape (letters and digits by kind, runs by length), backed by the shapes
  similar to it: those of as many digits with the same marks between;
* chain: labels of tokens that stand next to each other;
* skip: labels of a token and an earlier token of the text, however far apart, that have the
  same characters, the same digits, or the same last ``SUFFIX`` digits. The digits of a whole
  base span stand at its last token, so another way to write a number, in one word, is tied to
  it: "206.555.0142" and "555-0142" to "+1 (206) 555-0142". Each repeat links to the one before
  it, so a text with n repeats has n links.

Tokens in base spans are clamped. Loopy belief propagation passes messages along chain and skip
links within ``ROUNDS`` links of a clamped token or of one whose own shape makes a label likely;
elsewhere every token is outside. A run of tokens with one label and marginals of ``LEAST`` or
more becomes a span, with or without a base span in the text, if what it holds can be of that
kind (``plausible``). Base spans always stay.

Factors are trained piecewise: each is the log odds of the labels it sees in the whole corpus,
labelled by the patterns. So the field learns which shapes personal data has here; a shape that
stands outside base spans as often as inside never decides alone. Shapes are hashed to ``SHAPES``
rows, so the model has a fixed size.

Defined cases: null and empty texts have no spans; repeated rows are searched each; offsets are
code points; an empty table gives an empty result. Searches never rescan a run of characters,
so long runs of digits or letters cost linear time. A very long text takes about 60 bytes a
token; messages are kept for the tokens they can decide and worked out in blocks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, out_rows, stored, tuned

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is outside
SHAPES = 1 << 16
ROUNDS = 8
LEAST = 0.9
SUFFIX = 7  # last digits that tell a number
LIKELY = 0.2  # a shape's share of some label from which on messages start at it
SIMILAR = 2.0  # weight of similar shapes, in tokens
AGREE, DIFFER = 10.0, 1e-4  # links of repeats taken for granted: of equal labels in all, of each two different ones
LINKS = 50_000  # links whose messages are worked out at once

AT_RUN = re.compile(r"[A-Za-z0-9._%+-]")
# Possessive repeats keep no way back, which on very long runs would take far more memory than the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can begin at the first digit of a run only: later starts meet the same rest.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HAS_MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<![^ \t\n\x0b\x0c\r])[^ \t\n\x0b\x0c\r0-9@]*+[0-9@][^ \t\n\x0b\x0c\r]*+")
EDGES = ".,;:!?()[]{}<>\"'"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: from each at sign back over the local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and AT_RUN.match(text[start - 1]):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(number: str) -> bool:
    """At most 255, leading zeros aside."""
    number = number.lstrip("0")
    return len(number) < 3 or len(number) == 3 and number <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, by start and kind."""
    if not HAS_MARK.search(text):
        return []
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


RUNS = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))


def shape(token: str) -> int:
    """Hash of the token's shape: runs of digits with their length up to 6, runs of letters as one."""
    text = RUNS[1][0].sub("a", token)
    text = RUNS[0][0].sub(lambda m: "9" * min(len(m[0]), 6), text)
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SHAPES


def similar(token: str) -> int:
    """Hash of what similar shapes share: how many digits, and which marks stand inside."""
    core = token.strip(EDGES)
    marks = "".join(sorted({c for c in core if c in "@.-()+/:"}))
    return zlib.crc32(f"{min(len(digits_of(core)), 20)} {marks} {core.isascii() and core.isalnum()}".encode()) % SHAPES


def signatures(token: str) -> list[str]:
    """What tokens share that stand for the same thing: their characters, their digits if many, the last of them."""
    core = token.strip(EDGES).lower()
    digits = digits_of(core)
    return [f"c{core}"] * (len(core) >= 4) + number_signatures(digits)


def number_signatures(digits: str) -> list[str]:
    return [f"d{digits}"] * (len(digits) >= 6) + [f"s{digits[-SUFFIX:]}"] * (len(digits) >= SUFFIX)


@dataclass
class Graph:
    """Candidate tokens of a text and their links."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    similar: np.ndarray
    labels: np.ndarray  # of base spans, 0 outside
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of a token and its previous repeat


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    starts, ends, shapes, alike = array("i"), array("i"), array("H"), array("H")
    marks, owners = array("q"), array("i")  # signatures by hash, and their tokens
    known: dict[str, tuple[int, int]] = {}
    for i, m in enumerate(TOKEN.finditer(text)):
        token = m[0]
        starts.append(m.start())
        ends.append(m.end())
        if (both := known.get(token)) is None:
            both = shape(token), similar(token)
            if len(token) <= 6:  # few of them are different
                known[token] = both
        shapes.append(both[0])
        alike.append(both[1])
        for key in signatures(token):
            marks.append(xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) >> 1)
            owners.append(i)
    whole = lambda a, kind: np.frombuffer(a, kind) if len(a) else np.zeros(0, kind)
    begin, end = whole(starts, np.int32), whole(ends, np.int32)
    labels = np.zeros(len(begin), np.int8)
    for start, stop, kind in spans:
        first = int(np.searchsorted(end, start, side="right"))
        at = first
        while at < len(begin) and begin[at] < stop:
            if not labels[at]:
                labels[at] = kind + 1
            at += 1
        if at > first + 1 and kind >= 2:  # a number of several words
            for key in number_signatures(digits_of(text[start:stop])):
                marks.append(xxhash.xxh3_64_intdigest(key.encode()) >> 1)
                owners.append(at - 1)
    # A token ends before white space and begins after it, so up to two characters between are nothing else.
    near = np.flatnonzero(begin[1:] - end[:-1] <= 2).astype(np.int32)
    mark, owner = whole(marks, np.int64), whole(owners, np.int32)
    order = np.lexsort((owner, mark))
    mark, owner = mark[order], owner[order]
    same = (mark[1:] == mark[:-1]) & (owner[1:] != owner[:-1])
    skip = np.unique(np.stack([owner[:-1][same], owner[1:][same]], axis=1), axis=0) if same.any() else np.zeros((0, 2), np.int32)
    return Graph(begin, end, whole(shapes, np.uint16), whole(alike, np.uint16), labels, np.stack([near, near + 1], axis=1), skip)


def count(docs: DataFrame) -> DataFrame:
    """what, a, b, n: how often labels meet shapes (what 0), neighbours (1), repeats (2) and similar shapes (3)."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not HAS_MARK.search(text):
                    continue
                g = graph(text, base_spans(text))
                for what, rows in ((0, g.shapes), (3, g.similar)):
                    counts.update((what, a, b) for a, b in zip(rows.tolist(), g.labels.tolist()))
                told = g.labels[g.skip] > 0
                # A repeat of a found token that no pattern can match is missing data, no counterexample.
                for what, pairs in ((1, g.chain), (2, g.skip[told[:, 0] == told[:, 1]])):
                    counts.update((what, a, b) for a, b in zip(g.labels[pairs[:, 0]].tolist(), g.labels[pairs[:, 1]].tolist()))
        yield from out_rows({"what": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64()}, ((*k, n) for k, n in counts.items()))

    rows = docs.select("text").mapInArrow(mapper, "what int, a int, b int, n bigint")
    return rows.groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Factors:
    node: np.ndarray  # SHAPES x LABELS, counts of labels by shape
    similar: np.ndarray  # SHAPES x LABELS, p(label | similar shapes)
    chain: np.ndarray  # LABELS x LABELS, log odds
    skip: np.ndarray

    def shares(self, g: Graph) -> np.ndarray:
        """p(label | shape) of every token; where a shape is rare, similar ones decide."""
        out = self.node[g.shapes]
        for at in range(0, len(out), LINKS):
            some = slice(at, at + LINKS)
            out[some] += np.float32(SIMILAR) * self.similar[g.similar[some]]
            out[some] /= out[some].sum(axis=1, keepdims=True)
        return out


def fit(counts: DataFrame) -> Factors:
    """Factors from counts: at most 2 x SHAPES x LABELS + 2 x LABELS^2 rows come to the driver."""
    tables = np.zeros((2, SHAPES, LABELS), np.float32)
    pairs = np.stack([np.full((LABELS, LABELS), 0.5), np.full((LABELS, LABELS), DIFFER)])
    for r in counts.collect():
        if r.what in (0, 3):
            tables[r.what // 3, r.a, r.b] = r.n
        else:
            pairs[r.what - 1, r.a, r.b] += r.n
            pairs[r.what - 1, r.b, r.a] += r.n
    overall = tables[0].sum(axis=0) + 1.0
    pairs[1][np.diag_indices(LABELS)] += AGREE * overall / overall.sum()
    tables[1] += overall / overall.sum()
    tables[1] /= tables[1].sum(axis=1, keepdims=True)
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    alone = joint.sum(axis=2)
    odds = np.log(joint / (alone[:, :, None] * alone[:, None, :])).astype(np.float32)
    return Factors(tables[0], tables[1], odds[0], odds[1])


def logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def reached(g: Graph, begin: np.ndarray, steps: int) -> np.ndarray:
    """Mask of the tokens within so many links of the tokens in ``begin``."""
    out = begin.copy()
    for _ in range(steps):
        before = out.sum()
        for pairs in (g.chain, g.skip):
            met = out[pairs[:, 0]] | out[pairs[:, 1]]
            out[pairs[met].ravel()] = True
        if out.sum() == before:
            break
    return out


def marginals(g: Graph, f: Factors, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of all tokens after loopy belief propagation with damping, all links at once.

    Messages pass among the tokens within ``rounds`` links of a clamped or likely one; the
    others keep what their shapes say.
    """
    shares = f.shares(g)
    clamped = g.labels > 0
    active = reached(g, clamped | (shares[:, 0] <= 1 - LIKELY), rounds)
    shares[clamped] = 0.0
    shares[clamped, g.labels[clamped]] = 1.0
    tokens = np.flatnonzero(active)
    place = np.full(len(active), -1, np.int64)
    place[tokens] = np.arange(len(tokens))
    chain, skip = (place[p[active[p].all(axis=1)]] for p in (g.chain, g.skip))
    links = np.concatenate([chain, chain[:, ::-1], skip, skip[:, ::-1]])
    if not len(links):
        return shares
    nodes = np.log(np.maximum(shares[tokens], 1e-22)).astype(np.float32)
    n, m = len(chain), len(skip)
    # Messages of a block share one table: links lie in four stretches.
    stretches = [(0, n, f.chain), (n, 2 * n, f.chain.T), (2 * n, 2 * n + m, f.skip), (2 * n + m, 2 * n + 2 * m, f.skip.T)]
    back = np.concatenate([np.arange(n) + n, np.arange(n), np.arange(m) + 2 * n + m, np.arange(m) + 2 * n])
    sent = np.zeros((len(links), LABELS), np.float32)

    def belief() -> np.ndarray:
        out = nodes.copy()
        for label in range(LABELS):
            out[:, label] += np.bincount(links[:, 1], sent[:, label], len(nodes)).astype(np.float32)
        return out

    for _ in range(rounds):
        now, fresh = belief(), np.empty_like(sent)
        for low, high, odds in stretches:
            for at in range(low, high, LINKS):
                to = min(at + LINKS, high)
                # What a link sends leaves out what came back along it.
                cavity = now[links[at:to, 0]] - sent[back[at:to]]
                new = logsum((cavity[:, :, None] + odds).transpose(0, 2, 1).reshape(-1, LABELS)).reshape(-1, LABELS)
                fresh[at:to] = new - logsum(new)
        sent += 0.5 * (fresh - sent)
    found = belief()
    shares[tokens] = np.exp(found - logsum(found))
    return shares


def plausible(text: str, kind: int) -> bool:
    """Whether a text can be of this kind at all."""
    digits = digits_of(text)
    if kind == 0:
        return "@" in text.strip("@")
    if kind == 1:
        return len(parts := re.findall("[0-9]+", text)) >= 4 and all(map(small, parts[:4]))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else SUFFIX <= len(digits) <= 15


def added_spans(text: str, g: Graph, f: Factors, spans: list[tuple[int, int, int]], least: float = LEAST) -> list[tuple[int, int, int]]:
    """Spans that the field adds to those of the patterns."""
    if not len(g.starts):
        return []
    belief = marginals(g, f)
    best = belief.argmax(axis=1)
    chosen = (g.labels == 0) & (best > 0) & (belief.max(axis=1) >= least)
    taken = np.array([(a, b) for a, b, _ in spans], np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    linked = np.zeros(len(best), bool)  # to the token before it
    linked[g.chain[:, 1]] = True
    out, run = [], None
    for i in np.flatnonzero(chosen).tolist():
        if run and linked[i] and i - 1 == run[1] and best[i] == run[2]:
            run[1] = i
        else:
            run = [i, i, int(best[i])]
            out.append(run)
    found = []
    for first, last, label in out:
        start, end = int(g.starts[first]), int(g.ends[last])
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        before = int(np.searchsorted(taken[:, 0], end)) - 1  # the last base span that begins before the end
        free = before < 0 or reach[before] <= start
        if end > start and free and plausible(text[start:end], label - 1):
            found.append((start, end, label - 1))
    return found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
FOUND_DDL = "doc_id bigint, spans array<struct<kind string, start bigint, stop bigint, base boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its spans by start and kind. Two scans, no shuffle of texts."""
    tuned(docs.sparkSession)
    rows = ids_and_texts(docs, id_col, text_col)
    factors = docs.sparkSession.sparkContext.broadcast(fit(stored(count(rows), "label-counts")))

    def spans_of(text: str) -> list[dict]:
        if not HAS_MARK.search(text):
            return []
        base = base_spans(text)
        g = graph(text, base)
        every = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, g, factors.value, base)]
        return [{"kind": KINDS[k], "start": a, "stop": b, "base": is_base} for a, b, k, is_base in sorted(every, key=lambda s: (s[0], s[2], s[1]))]

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("spans", SPANS)])
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans_of(t) for t in batch.column(1).to_pylist()], SPANS)], schema=schema)

    return rows.mapInArrow(mapper, FOUND_DDL)
