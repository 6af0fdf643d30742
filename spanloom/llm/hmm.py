"""Hidden Markov language model trained by Baum-Welch over the whole corpus.

A text is its words and one end token. A latent state chooses a word class, the class chooses
the word: p(word | state) = p(class | state) * p(word | class). The ``own_classes`` most
frequent words are classes of their own (p(word | class) = 1), all others share a class by
their last bytes, where p(word | class) comes from the counts of the whole vocabulary. So the
trained tables have a fixed size, while what a word costs rests on counts that grow with the
corpus. Unknown words have one unit of mass in every shared class: all probabilities sum to 1.

1. ``vocabulary``: counts of every different training word; each task counts first.
2. ``encode``: texts become class sequences. Counts of the ``held_words`` most frequent words
   are broadcast (that many rows at most); the other words are listed and looked up by a join.
3. ``train``: Baum-Welch. Tasks run the scaled forward and backward recursions over windows of
   ``window`` tokens, many at once, and send expected counts; sums of them give the next model.
   A window after a text's first begins with the token before it, so moves across borders count
   and only true beginnings count as starts; its first state comes from the moves' own balance.
4. ``score``: the scaled forward recursion over each whole text gives its exact likelihood.

A very long text is split into words a megabyte at a time; its classes take two bytes a token,
its scoring about 12.

Defined cases: a null or empty text is the end token alone; a null id counts as the text
``null`` where ids are hashed; repeated rows are scored each; without training rows N and V
are 0 and the model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_crc, ids_and_texts, out_rows, raw, stored, tuned

END = b"\n"  # no word holds white space
PIECE = 1 << 20  # bytes of a text that are split into words at once
SPACE = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own_classes: int = 8192
    shared_classes: int = 4096
    held_words: int = 131_072
    suffix: int = 3
    rounds: int = 5
    window: int = 128
    #: Weight of the corpus-wide class shares in each state's emissions, in tokens.
    prior: float = 200.0
    seed: int = 11

    @property
    def classes(self) -> int:
        return self.own_classes + self.shared_classes


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, some at a time."""
    at = 0
    while len(text) - at > PIECE:
        found = SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end
    yield [*text[at:].lower().split(), END]


def shared_class(word: bytes, s: Settings) -> int:
    """Class of a word without one of its own; the same as ``shared_class_column``."""
    return s.own_classes + zlib.crc32(word[-s.suffix :]) % s.shared_classes


def shared_class_column(s: Settings) -> Column:
    tail = F.expr(f"substring(word, greatest(1, octet_length(word) - {s.suffix - 1}), {s.suffix})")
    return (F.lit(s.own_classes) + F.pmod(F.crc32(tail), F.lit(s.shared_classes))).cast("int")


def vocabulary(training: DataFrame) -> DataFrame:
    """word (binary), c: counts of all training tokens, the end token included."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            counts: Counter = Counter()
            for batch in batches:
                for text in raw(batch.column(0)):
                    for some in pieces(text):
                        counts.update(some)
                        if len(counts) > 400_000:
                            yield from counts.items()
                            counts = Counter()
            yield from counts.items()

        yield from out_rows({"word": pa.binary(), "n": pa.int64()}, counted())

    parts = training.select("text").mapInArrow(mapper, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Words:
    """What every task knows of the vocabulary: fixed size, whatever the corpus."""

    settings: Settings
    total: int  # N
    different: int  # V
    own: dict[bytes, int]  # word to class
    held: dict[bytes, int]  # word to its place in the next three
    held_class: np.ndarray
    held_base: np.ndarray  # log10(c + 1)
    held_inner: np.ndarray  # log10 p(word | class)
    class_counts: np.ndarray  # training tokens by class
    class_masses: np.ndarray  # of shared classes: sum of (c + 1) of its words, and 1


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """About the ``most`` most frequent words.

    The least count comes from a histogram with a fixed number of bands (16 for each doubling), so
    tasks send only words that are wanted; a sorted limit would bring ``most`` from each task. Of
    the band that would pass ``most``, a hash picks the share of words that fits.
    """
    band = F.floor(F.log2(F.col("c")) * 16)
    sizes = vocab.groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()
    room = most
    for r in sorted(sizes, key=lambda r: -r["band"]):
        if r["words"] > room:
            picked = F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int(room / r["words"] * (1 << 32))
            return vocab.where((band > r["band"]) | ((band == r["band"]) & picked))
        room -= r["words"]
    return vocab


def summarize(vocab: DataFrame, s: Settings) -> Words:
    """The bounded summary; brings about ``held_words`` words and one row per class to the driver."""
    total, different, ends = vocab.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))
    ).first()
    words = ((bytes(r.word), r.c) for r in most_frequent(vocab, s.held_words).collect())
    # The end token is always held, in the first class, however rare it is.
    ranked = [(END, ends), *sorted((r for r in words if r[0] != END), key=lambda r: (-r[1], r[0]))]
    own = {word: i for i, (word, _) in enumerate(ranked[: s.own_classes])}
    counts, masses = np.zeros(s.classes), np.ones(s.classes)
    by_class = vocab.groupBy(shared_class_column(s).alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("words"))
    for r in by_class.collect():  # as if no word had a class of its own; these are taken out below
        counts[r["class"]], masses[r["class"]] = r.c, r.c + r.words + 1
    if total:
        for word, cls in own.items():
            c = ranked[cls][1]
            counts[cls] = c
            masses[shared_class(word, s)] -= c + 1
            counts[shared_class(word, s)] -= c
    classes = np.array([own[word] if word in own else shared_class(word, s) for word, _ in ranked], np.uint16)
    plus_one = np.array([c + 1 for _, c in ranked], float)
    inner = np.where(classes < s.own_classes, 0.0, np.log10(plus_one / masses[classes]))
    held = {word: i for i, (word, _) in enumerate(ranked)}
    return Words(s, total, different, own, held, classes, np.log10(plus_one), inner, counts, masses)


CODED = {
    "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_held": pa.int64(),
    "base": pa.float64(), "inner": pa.float64(), "classes": pa.binary(), "rest": pa.list_(pa.binary()), "times": pa.list_(pa.int64()),
}
CODED_DDL = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_held bigint, base double, inner double, classes binary, rest array<binary>, times array<bigint>"


def encode(texts: DataFrame, words: Words) -> DataFrame:
    """Texts as class sequences (unsigned 16-bit), sums over held words, and the other words with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    s = words.settings

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        row = TaskContext.get().partitionId() << 40

        def coded():
            nonlocal row
            for batch in batches:
                for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2))):
                    n_tokens = n_held = 0
                    base = inner = 0.0
                    classes, rest = [], Counter()
                    for some in pieces(text):
                        at = np.fromiter(map(known.held.get, some, repeat(-1)), np.int64, len(some))
                        found = at[at >= 0]
                        its = known.held_class[at]
                        if len(found) < len(some):
                            others = [some[i] for i in np.flatnonzero(at < 0).tolist()]
                            its[at < 0] = [shared_class(word, s) for word in others]
                            rest.update(others)
                        classes.append(its.astype("<u2").tobytes())
                        n_tokens, n_held = n_tokens + len(some), n_held + len(found)
                        base, inner = base + float(known.held_base[found].sum()), inner + float(known.held_inner[found].sum())
                    if not known.total:  # no training rows: even the end token is unknown
                        n_held -= 1
                    yield row, doc_id, out, n_tokens, n_held, base, inner, b"".join(classes), list(rest), list(rest.values())
                    row += 1

        yield from out_rows(CODED, coded(), lambda r: 96 + len(r[7]) + 48 * len(r[8]))

    return texts.select("doc_id", "held_out", "text").mapInArrow(mapper, CODED_DDL)


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K


def initial(words: Words) -> Model:
    """Class shares of the corpus, tilted at random for each state, and states that last."""
    s = words.settings
    rng = np.random.default_rng(s.seed)
    share = class_shares(words)
    emit = share[:, None] * np.exp(rng.normal(0, 1.0, (s.classes, s.states)))
    move = np.full((s.states, s.states), 0.1 / max(s.states - 1, 1))
    np.fill_diagonal(move, 0.9 if s.states > 1 else 1.0)
    return Model(np.full(s.states, 1 / s.states), move, emit / emit.sum(axis=0))


def class_shares(words: Words) -> np.ndarray:
    return (words.class_counts + 1) / (words.class_counts + 1).sum()


def windows(sequences: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut in windows: a matrix padded with 0, longest first, the lengths, and which begin a text.

    A window that does not has one token more, the one before it.
    """
    cut = [(x[max(at - 1, 0) : at + size], at == 0) for x in sequences for at in range(0, len(x), size)]
    cut.sort(key=lambda w: len(w[0]), reverse=True)
    lengths = np.array([len(x) for x, _ in cut])
    matrix = np.zeros((len(cut), int(lengths[0]) if len(cut) else 0), np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = np.concatenate([x for x, _ in cut]) if cut else 0
    return matrix, lengths, np.array([first for _, first in cut], bool)


def balance(move: np.ndarray) -> np.ndarray:
    """Shares of the states that the moves leave as they are."""
    share = np.full(len(move), 1 / len(move))
    for _ in range(200):
        share = share @ move
    return share / share.sum()


def expected(model: Model, matrix: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, move and emission counts of windows, and their log likelihood.

    The token that leads into a window counts for its move alone.
    """
    n, size, k = len(lengths), matrix.shape[1], len(model.start)
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(size)]  # windows longer than t
    alphas, scales, emits = [], [], []
    alpha = None
    first = np.where(begins[:, None], model.start, balance(model.move))
    for t in range(size):
        m = active[t]
        e = model.emit[matrix[:m, t]]
        alpha = (first if t == 0 else alpha[:m] @ model.move) * e
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        alphas.append(alpha)
        scales.append(scale)
        emits.append(e)
    move, log_likelihood = np.zeros((k, k)), float(np.log(scales[0][begins]).sum() + sum(np.log(s).sum() for s in scales[1:]))
    gammas, symbols = [], []
    beta = np.ones((n, k))
    for t in range(size - 1, -1, -1):
        m = active[t]
        if t + 1 < size and active[t + 1]:
            ahead = active[t + 1]
            weighted = emits[t + 1] * beta[:ahead] / scales[t + 1][:, None]
            move += (alphas[t][:ahead].T @ weighted) * model.move
            beta[:ahead] = weighted @ model.move.T
        gammas.append(alphas[t] * beta[:m])
        symbols.append(matrix[:m, t])
    gammas[-1] = gammas[-1] * begins[:, None]
    gamma, symbol = np.concatenate(gammas), np.concatenate(symbols)
    emit = np.stack([np.bincount(symbol, gamma[:, i], len(model.emit)) for i in range(k)], axis=1)
    return gammas[-1].sum(axis=0), move, emit, log_likelihood


CHUNK = 400_000  # tokens worked on at a time


def chunks(sequences: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    held, total = [], 0
    for x in sequences:
        held.append(x)
        total += len(x)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def train(coded: DataFrame, words: Words) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows that are not held out; also the log likelihood of each round.

    A round brings one row per class, state and the like to the driver: a fixed size.
    """
    spark, s, model, history = coded.sparkSession, words.settings, initial(words), []
    share = class_shares(words)
    rows = coded.where(~F.col("held_out")).select("classes")
    for _ in range(s.rounds):
        shared = spark.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            start, move, emit, ll = np.zeros(s.states), np.zeros((s.states, s.states)), np.zeros((s.classes, s.states)), 0.0
            sequences = (np.frombuffer(c, "<u2") for batch in batches for c in batch.column(0).to_pylist())
            for some in chunks(sequences, CHUNK):
                a, b, c, d = expected(now, *windows(some, s.window))
                start, move, emit, ll = start + a, move + b, emit + c, ll + d
            used = np.flatnonzero(emit.any(axis=1))
            # Rows: class >= 0 emissions; -1 - state moves; -1000 start; -1001 log likelihood.
            rows = [(int(c), emit[c].tolist()) for c in used] + [(-1 - i, move[i].tolist()) for i in range(s.states)]
            rows += [(-1000, start.tolist()), (-1001, [ll])]
            yield from out_rows({"what": pa.int32(), "n": pa.list_(pa.float64())}, rows)

        parts = rows.mapInArrow(counted, "what int, n array<double>").select("what", F.posexplode("n").alias("at", "n"))
        sums = {(r["what"], r["at"]): r["n"] for r in parts.groupBy("what", "at").agg(F.sum("n").alias("n")).collect()}
        history.append(sums.get((-1001, 0), 0.0))
        k = range(s.states)
        emit = np.zeros((s.classes, s.states))
        for (what, at), n in sums.items():
            if what >= 0:
                emit[what, at] = n
        move = np.array([[sums.get((-1 - i, j), 0.0) for j in k] for i in k]) + 1.0 / s.states
        start = np.array([sums.get((-1000, i), 0.0) for i in k]) + 1.0
        emit = emit + s.prior * share[:, None]
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        shared.unpersist()
    return model, history


SCORE_CHUNK = 3_000_000


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 p(class sequence) of each, by the scaled forward recursion over whole sequences."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    sorted_lengths = lengths[order]
    total = np.zeros(len(sequences))
    alpha, m = None, len(sequences)
    for t in range(int(sorted_lengths[0])):
        while sorted_lengths[m - 1] <= t:
            m = int(np.searchsorted(-sorted_lengths, -t, side="left"))
        e = model.emit[flat[starts[:m] + t]]
        alpha = (model.start if t == 0 else alpha[:m] @ model.move) * e
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


SCORED = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_held": pa.int64(), "base": pa.float64(), "part": pa.float64()}
SCORED_DDL = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_held bigint, base double, part double"


def score(coded: DataFrame, model: Model) -> DataFrame:
    """Log10 likelihood of class sequences plus the sums over held words."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, total = [], 0
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                    held.append(row)
                    total += row[3]
                    if total >= SCORE_CHUNK:
                        yield from scored(held)
                        held, total = [], 0
            if held:
                yield from scored(held)

        def scored(held):
            found = log10_likelihoods(shared.value, [np.frombuffer(r[7], "<u2") for r in held])
            for r, ll in zip(held, found.tolist()):
                yield *r[:6], ll + r[6]

        yield from out_rows(SCORED, rows())

    columns = ["row", "doc_id", "held_out", "n_tokens", "n_held", "base", "inner", "classes"]
    return coded.select(*columns).mapInArrow(mapper, SCORED_DDL)


def rest_sums(coded: DataFrame, vocab: DataFrame, words: Words) -> DataFrame:
    """row, n_known, base, inner: sums over the words that are not held, by a join with all counts."""
    s = words.settings
    masses = coded.sparkSession.createDataFrame(
        [(i, float(words.class_masses[i])) for i in range(s.own_classes, s.classes)], "its_class int, mass double"
    )
    rest = coded.select("row", F.inline(F.arrays_zip(F.col("rest").alias("word"), "times")))
    # A text's word is one row, and frequent words are not in here, so no word is hot.
    counted = vocab.select(F.col("word").alias("its_word"), "c")
    joined = rest.join(counted, F.col("word") == F.col("its_word"), "left").withColumn("its", shared_class_column(s))
    c = F.coalesce("c", F.lit(0))
    with_mass = joined.join(F.broadcast(masses), F.col("its") == F.col("its_class"))
    times = F.col("times")
    return with_mass.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("rest_known"), F.sum(times * F.log10(c + 1)).alias("rest_base"),
        F.sum(times * F.log10((c + 1) / F.col("mass"))).alias("rest_inner"),
    )


def train_and_score(docs: DataFrame, held_out: Callable[[Column], Column], settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` tells from the CRC-32 of an id (as text) which rows training must not see.
    """
    tuned(docs.sparkSession)
    texts = ids_and_texts(docs, id_col, text_col).withColumn("held_out", held_out(held_out_crc(F.col("doc_id"))))
    vocab = stored(vocabulary(texts.where(~F.col("held_out"))), "vocabulary")
    words = summarize(vocab, settings)
    coded = stored(encode(texts, words), "coded")
    model, _ = train(coded, words)
    rest = rest_sums(coded, vocab, words).withColumnRenamed("row", "its_row")
    rows = score(coded, model).join(rest, F.col("row") == F.col("its_row"), "left")
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_held") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base") - F.col("n_tokens") * F.lit(math.log10(words.total + words.different + 1))).alias("base_score"),
        (F.col("part") + zero("rest_inner")).alias("score"),
    )
