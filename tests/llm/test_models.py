"""Trained operators and mixing: rules of the contract, exact sums, very long texts, odd tables."""

import math
from collections import Counter
from decimal import Decimal, getcontext
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hmm, language, mixing, packing, pii

never = lambda crc: F.lit(False)
always = lambda crc: F.lit(True)


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- language model


def base_scores(texts, training):
    toks = lambda t: [*(t or "").lower().split(), "\n"]
    c = Counter(w for t in training for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for t in texts]


def test_the_end_token_is_held_however_rare_it_is(spark):
    """One training text of 140,000 different words, with the default settings."""
    text = " ".join(f"w{i}" for i in range(140_000))
    got = hmm.train_and_score(table(spark, [text]), never).first()
    n_tokens, n_known, n, base = base_scores([text], [text])[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (n_tokens, n_known, n) == (140_001,) * 3
    assert abs(got.base_score - base) < 1e-3 and math.isfinite(got.score)


def test_a_full_top_band_still_gives_words_of_their_own(spark):
    texts = [" ".join(f"w{i}" for i in range(k, k + 300)) for k in range(0, 3000, 300)]
    vocab = hmm.vocabulary(table(spark, texts)).cache()
    words = hmm.summarize(vocab, hmm.Settings(own_classes=50, shared_classes=20, held_words=400))
    assert 250 < len(words.held) < 550 and len(words.own) == 50 and words.own[hmm.END] == 0
    mass = Counter()
    for r in vocab.collect():
        if bytes(r.word) not in words.own:
            mass[hmm.shared_class(bytes(r.word), words.settings)] += r.c + 1
    assert all(abs(words.class_masses[k] - m - 1) < 1e-9 for k, m in mass.items())


def test_no_training_rows(spark):
    texts = ["a b", None, ""]
    got = hmm.train_and_score(table(spark, texts), always).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert all(r.held_out and r.base_score == 0 and r.score < 0 for r in got)


def test_a_very_long_text_and_repeated_rare_words(spark, monkeypatch):
    rare = " ".join(f"r{i % 3000}" for i in range(400_000))  # over a megabyte
    texts = [rare, "common words only common words", "z " * 7, rare[:5000]]
    settings = hmm.Settings(states=2, own_classes=30, shared_classes=16, held_words=40, rounds=1)
    got = hmm.train_and_score(table(spark, texts), never, settings).orderBy("doc_id").collect()
    for r, (n_tokens, n_known, n, base) in zip(got, base_scores(texts, texts)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and abs(r.base_score - base) < 1e-5 * abs(base)


def test_windows_count_starts_of_texts_only_and_moves_across_borders():
    rng = np.random.default_rng(3)
    share = lambda *shape: (x := rng.random(shape)) / x.sum(axis=0)
    model = hmm.Model(share(3), share(3, 3).T, share(5, 3))
    sequences = [rng.integers(0, 5, n) for n in (1, 7, 20, 33)]
    matrix, lengths, begins = hmm.windows(sequences, 8)
    assert begins.sum() == 4 and lengths.max() == 9
    start, move, emit, _ = hmm.expected(model, matrix, lengths, begins)
    tokens = sum(map(len, sequences))
    assert abs(start.sum() - 4) < 1e-9 and abs(emit.sum() - tokens) < 1e-9 and abs(move.sum() - (tokens - 4)) < 1e-9
    assert np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(sequences), minlength=5))
    balance = hmm.balance(model.move)
    assert np.allclose(balance @ model.move, balance)


# --- language


def test_numeric_signs_are_no_letters(spark):
    rows = [(1, "the cat sat", "en"), (2, "½ ² ①", None), (3, "Ⅷ", None), (4, "١٢ 12 _", None), (5, "½ é", None), (6, "漢", None), (7, "ʰ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.train_and_predict(docs, never).collect()}
    assert got == {1: ("en", 1.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("und", 0.0), 5: ("en", 1.0), 6: ("en", 1.0), 7: ("en", 1.0)}


def test_many_languages_share_one_sample(spark):
    """500 languages, each text of one letter pair: the sample stays within its budget and each is told."""
    rows = [(k, " ".join([chr(97 + k % 25) + chr(0x4E00 + k)] * 4000), f"l{k:03}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = language.sample(docs, 1_500_000, all_sample_bytes=2_000_000).agg(F.sum(F.octet_length("block"))).first()[0]
    assert 500 * language.BLOCK * 0.5 < size < 4_500_000
    short = spark.createDataFrame([(k, rows[k][1][:20], rows[k][2]) for k in range(0, 500, 25)], "doc_id long, text string, lang string")
    trees = language.learn(docs, sample_bytes=4000)
    assert len(trees) == 500
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language.predict(short, trees).collect())


def test_rows_but_no_labels_and_ties(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.train_and_predict(docs, never).collect()} == {"und"}
    same = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.train_and_predict(same, never).collect()} == {("aa", 0.5)}


def test_a_text_of_fifty_megabytes_is_predicted_in_pieces(monkeypatch):
    one = lambda text: language.Tree.from_grams(4, *(lambda k, n: (k, n.astype(float)))(*np.unique(language.grams(text, 4), return_counts=True)))
    trees = {"en": one(b"the cat sat on the mat " * 9), "fr": one(b"le chat est sur le tapis " * 9)}
    text = "le chat sur " * 4_400_000
    assert language.predict_batch([text], trees, 4)[0] == ["fr"]
    some = ["the mat", "le tapis sur le chat " * 50, None, "12"]
    whole = language.predict_batch(some, trees, 4)
    monkeypatch.setattr(language, "CHUNK", 7)
    cut = language.predict_batch(some, trees, 4)
    assert whole[0] == cut[0] == ["en", "fr", "und", "und"] and np.allclose(whole[1], cut[1])


# --- mixing


def quantile(rate: float, u: float) -> int:
    """The smallest count whose distribution function exceeds u, by ratios from the mode in 50 digits."""
    getcontext().prec = 50
    mode, wide = int(rate), int(40 * math.sqrt(rate)) + 60
    terms, lam = {mode: Decimal(1)}, Decimal(rate)
    for k in range(mode + 1, mode + wide):
        terms[k] = terms[k - 1] * lam / k
    for k in range(mode, max(mode - wide, 0), -1):
        terms[k - 1] = terms[k] * k / lam
    left = Decimal(u) * sum(terms.values())
    for k in sorted(terms):
        left -= terms[k]
        if left < 0:
            return k


@pytest.mark.parametrize("rate", [0.3, 12.0, 399.5, 400.0, 1000.0, 25_000.0, 1_000_000.0])
def test_thresholds_for_any_rate(spark, rate):
    found = mixing.thresholds(spark.createDataFrame([("s", rate), (None, 2.0), ("none", 0.0)], "src string, rate double")).collect()
    one = next(r for r in found if r.src == "s")
    assert len(one.at_most) < max(700, 22 * math.sqrt(rate) + 60)
    for u in (1e-9, 0.01, 0.25, 0.5, 0.77, 0.99, 1 - 1e-9):
        assert one.low + int(np.searchsorted(one.at_most, u, side="right")) == quantile(rate, u), u
    assert next(r for r in found if r.src == "none").at_most == [1.0] and len(next(r for r in found if r.src is None).at_most) > 10


def test_a_rate_of_thousands_makes_all_its_copies(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "s") for i in range(20)], "doc_id long, text string, source string")
    copies = mixing.replicate(docs, epochs=9000.0).groupBy("row.doc_id").agg(F.count("*").alias("n"), F.min("copy").alias("low"), F.max("copy").alias("high"), F.countDistinct("copy").alias("kinds"))
    rows = copies.collect()
    assert len(rows) == 20 and all(r.low == 1 and r.n == r.high == r.kinds and abs(r.n - 9000) < 6 * math.sqrt(9000) for r in rows)


# --- personal data

ONE = (
    "call +1 (206) 555-0142 or write.\nLater on: dial 206.555.0142 or 206-555-0142, even 555-0142 or 2065550142, "
    "room 12 in 2024. Not 206-555-0143, 1.5 or 3-4"
)


def added(spark, rows):
    found = {r.doc_id: r.spans for r in pii.find(table(spark, rows)).collect()}
    return {i: [rows[i][s.start : s.stop] for s in spans if not s.base] for i, spans in found.items() if any(not s.base for s in spans)}


def test_other_ways_to_write_a_number_are_found(spark):
    others = ["In 2024 we had 12 cats, 3.5 dogs and 10-20 mice; see 10.1.2 for 555-0199", "Nothing here.", "Code 1234567 and 12345678 x"] * 60
    assert added(spark, [*others, ONE]) == {180: ["206.555.0142", "206-555-0142", "555-0142", "2065550142"]}


def test_a_number_swallowed_by_another_pattern_is_found_by_its_shape(spark):
    """The phone's pattern runs on into a card; both fail as one match, and the field tells them apart."""
    card = "4111111111111111"
    rows = [f"reach me at +1 (206) 555-{1000 + i} thanks" for i in range(200)] + [f"paid with {card} today" for _ in range(100)]
    rows.append(f"both +1 (312) 555-7788 {card} here")
    assert added(spark, rows) == {300: ["+1 (312) 555-7788", card]}
    assert added(spark, [*rows[:-1], "but 4111111111111112 is no card"]) == {}


def test_clean_texts_gain_nothing(spark):
    rows = [f"call +1 (206) 555-{1000 + i} now" for i in range(200)]
    clean = ["built in 1998, 2004 and 2011", "version 3.11.4 or 2.0", "at 12:30 on 2024-05-06", "a 16 digit 1234567812345678", "user@ and @user", "4111 1111", "10.0.0", "room 555"] * 20
    assert added(spark, rows + clean) == {}


def test_marginals_equal_exact_sums_on_small_graphs():
    rng = np.random.default_rng(6)

    def check(chain, skip, labels, near):
        n = len(labels)
        node = rng.random((pii.SHAPES, pii.LABELS)).astype(np.float32)
        symmetric = lambda: (lambda x: x + x.T)(rng.normal(0, 0.7, (pii.LABELS, pii.LABELS)))
        f = pii.Factors(node, np.ones_like(node) / 5, rng.normal(0, 0.7, (5, 5)), symmetric())
        pairs = lambda x: np.array(x, np.int32).reshape(-1, 2)
        g = pii.Graph(np.arange(n), np.arange(n), np.arange(n), np.arange(n), np.array(labels, np.int8), pairs(chain), pairs(skip))
        got, shares, want = pii.marginals(g, f, rounds=60), f.shares(g), np.zeros((n, pii.LABELS))
        for path in product(range(pii.LABELS), repeat=n):
            if any(k and k != x for k, x in zip(labels, path)):
                continue
            p = np.prod([1.0 if labels[i] else shares[i, x] for i, x in enumerate(path)])
            p *= np.exp(sum(f.chain[path[a], path[b]] for a, b in chain) + sum(f.skip[path[a], path[b]] for a, b in skip))
            want[np.arange(n), path] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(got - want).max() < near

    check([], [], [0, 3], 1e-5)
    check([(0, 1), (1, 2)], [(2, 4)], [0, 4, 0, 0, 0], 1e-4)
    check([(0, 1)], [(0, 2), (1, 3), (3, 4)], [2, 0, 0, 0, 0], 1e-4)
    check([(0, 1), (1, 2)], [(0, 2)], [0, 0, 1], 0.05)  # a loop: close, not exact


def test_messages_in_blocks_are_the_same(monkeypatch):
    text = " ".join(f"+1 (206) 555-{1000 + i % 7} and 206.555.{1000 + i % 5}" for i in range(60))
    spans = pii.base_spans(text)
    g = pii.graph(text, spans)
    rng = np.random.default_rng(1)
    f = pii.Factors(rng.random((pii.SHAPES, 5)).astype(np.float32), np.full((pii.SHAPES, 5), 0.2, np.float32), rng.normal(0, 1, (5, 5)), rng.normal(0, 1, (5, 5)))
    whole = pii.marginals(g, f)
    monkeypatch.setattr(pii, "LINKS", 11)
    assert np.allclose(whole, pii.marginals(g, f), atol=1e-5)


def test_ten_megabytes_of_numbers():
    import resource

    node, alike = np.zeros((pii.SHAPES, 5), np.float32), np.full((pii.SHAPES, 5), 1e-3, np.float32)
    alike[:, 0] = 0.996
    odds = np.log(np.where(np.eye(5, dtype=bool), 30.0, 1e-3))
    text = "12 " * 3_400_000 + "+1 (206) 555-0142 x 206.555.0142"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans = pii.base_spans(text)
    found = pii.added_spans(text, pii.graph(text, spans), pii.Factors(node, alike, odds, odds), spans)
    assert [text[a:b] for a, b, _ in spans] == ["+1 (206) 555-0142"] and [text[a:b] for a, b, _ in found] == ["206.555.0142"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


# --- packing


def test_the_piece_with_the_largest_dot_product_is_taken():
    limits = packing.Limits(tokens=100, segments=6, loss=60)
    rng = np.random.default_rng(2)
    packer = packing.Packer(limits, cut=False, base=0, pool=40)
    for i in range(40):
        n = int(rng.integers(5, 60))
        list(packer.add(i, np.zeros(n, np.uint32), loss_from=int(rng.integers(0, n))))
    pool = list(packer.pool)
    rows = list(packer.fill())
    left, scale = np.array([100, 6, 60], float), np.array([1 / 100, 1 / 6, 1 / 60])
    vector = {p.doc_id: np.array([len(p), 1, p.loss], float) for p in pool}
    for doc_id, *_ in rows:
        fits = {i: (v * scale) @ (left * scale) for i, v in vector.items() if (v <= left).all()}
        assert fits[doc_id] == max(fits.values())
        left -= vector.pop(doc_id)
    assert not any((v <= left).all() for v in vector.values())


@pytest.mark.parametrize("which", ["tokens", "segments", "loss"])
def test_each_limit_binds(which):
    limits = packing.Limits(**{"tokens": 1000, "segments": 50, "loss": 1000} | {which: {"tokens": 64, "segments": 3, "loss": 40}[which]})
    examples = [(i, np.zeros(16, np.uint32), 4) for i in range(100)]
    sequences = Counter()
    for doc_id, _, length, *_, sequence, _ in packing.pack_ids(examples, limits, False, 0):
        sequences[sequence] += 1
    full = {"tokens": 4, "segments": 3, "loss": 3}[which]
    assert max(sequences.values()) == full and sum(sequences.values()) == 100




def test_the_first_line_is_the_prompt(spark):
    import public_tokenizers

    coder = packing.encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("Title é here\nbody text", "one line", "\n\nx", "", "a\n", "漢字 and\n" * 3, "x" * 500 + "\ny <|endoftext|>"):
        ids = np.frombuffer(coder.ids(text), "<u4")
        n = coder.prompt(text, ids)
        head = coder.full.decode(ids[:n].tolist()) if coder.full else coder.encoding.decode(ids[:n].tolist())
        line = text[: text.find("\n") + 1]
        assert len(head.encode()) <= len(line.encode()) and (not line or line.startswith(head) and (n == len(ids) or len(coder.encoding.decode(ids[: n + 1].tolist())) > len(line)))


# --- long texts and repeated ids in the archive and in line dedup


def test_archive_of_long_pages_and_repeated_owners(spark):
    from spanloom.llm import warc

    page = "é" * 60_000
    rows = [(5, "u", page), (5, "v", page), (4, "w", page), (3, "t", None), (None, "n", page), (2, "s", "short"), (1, "r", "short")]
    folder = warc.new_folder(spark)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = Counter((r.id, r.kind, r.refers, bytes(r.payload).decode()) for r in warc.read(spark, folder).select("id", warc.field("WARC-Type").alias("kind"), warc.field("WARC-Refers-To").alias("refers"), "payload").collect())
    owner = "<urn:capture:5>"
    assert got == Counter([(5, "response", "", page)] * 2 + [(4, "revisit", owner, page), (None, "revisit", owner, page), (3, "response", "", ""), (2, "response", "", "short"), (1, "response", "", "short")])


def test_line_dedup_of_a_text_of_many_lines(spark):
    from spanloom.llm import lines

    many = [f"line number {n % 9000} of a long text" for n in range(30_000)]
    texts = {1: "line number 7 of a long text\nshort", 2: "\n".join(many), 3: "\n".join(["  LINE number 8000 of a long text ", "its own line here", "short"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.apply(docs, lines.keep_bitmaps(docs)).collect()}
    rest = [x for x in many if x != "line number 7 of a long text"]
    assert got == {1: (2, 0, texts[1]), 2: (30_000, 30_000 - len(rest), "\n".join(rest)), 3: (3, 1, "its own line here\nshort")}
