"""Conversation repair, substring dedup and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash
from compare import compare, duck
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm import queries, repair, substring, trie

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()

# --- substring dedup

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    # Names that the operator uses inside must not matter.
    T.StructField("key", T.StringType()), T.StructField("doc", T.IntegerType()), T.StructField("found", T.StringType()), T.StructField("h1", T.StringType()),
])


def brute_substring(rows, window):
    """(id, words, removed, kept) of every row; a null id is last, rows of one id are one document."""
    last = lambda i: (1 << 63) - 1 if i is None else i
    owner = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            run = tuple(words[p : p + window])
            owner[run] = min(owner.get(run, last(i)), last(i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if owner[tuple(words[p : p + window])] < last(i):
                gone[p : p + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(out)


def run_substring(spark, rows, window, parts=3):
    docs = spark.createDataFrame([(i, t, "k", 1, "f", "h") for i, t in rows], DOCS).repartition(parts)
    return Counter(tuple(r) for r in substring.dedup(docs, window=window).collect())


@pytest.mark.parametrize("window", [1, 2, 3, 4, 6, 13, 20, 33])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(window)
    passage = [f"w{rng.randint(0, 9)}" for _ in range(3 * window)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:  # a stretch of the passage at any place, sometimes one word short or with a word changed
            at, n = rng.randint(0, 2 * window), rng.choice([window - 1, window, window + 1, 2 * window])
            stretch = passage[at : at + n]
            words[rng.randint(0, len(words)):0] = stretch
        rows.append((rng.choice([None, *range(40)]), rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(100, " ".join(passage)), (101, " ".join(passage)), (101, " ".join(passage)), (102, None), (103, ""), (104, " \n\t"), (99, " ".join(["a"] * 70)), (98, " ".join(["a"] * 50))]
    assert run_substring(spark, rows, window) == brute_substring(rows, window)


def test_substring_dedup_of_one_long_text_and_a_passage_that_all_share(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{rng.random()} " * rng.randint(0, 5) + passage + f" {rng.random()}") for i in range(3000)]
    rows.append((5000, " ".join(f"q{i % 7001}" for i in range(120_000)) + " " + passage))
    assert run_substring(spark, rows, 13, parts=8) == brute_substring(rows, 13)


def test_substring_dedup_of_nothing(spark):
    assert not run_substring(spark, [], 13)


def test_difference_covers():
    for period in (*range(1, 40), 100, 257):
        cover = substring.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and set(cover) <= set(range(period))
    assert substring.plan(13) == (7, 7, [0, 1, 3])


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdefg\xc3") for _ in range(rng.choice([1, 2, 3, 10, 63, 64, 65, 200]))) for _ in range(300)]
    text = b"  " + b" \n".join(words)
    monkeypatch.setattr(substring, "BLOCK", 64)
    begins, hashes = substring.word_hashes(text)
    assert [text[a : a + len(w)] for a, w in zip(begins.tolist(), words)] == words
    alone = {}
    for word, h in zip(words, hashes.tolist()):
        assert alone.setdefault(word, h) == h
        if len(word) >= 64:
            assert h == xxhash.xxh3_64_intdigest(word)
    assert len(set(alone.values())) == len(alone)
    assert len(substring.word_hashes(b"")[0]) == 0 and len(substring.word_hashes(b" \n ")[0]) == 0


def test_windows_of_many_words_keep_their_order():
    words = np.arange(1, 400, dtype=np.uint64)
    some = substring.Words([b"a b c d", b"", b"b a c d"])
    assert some.counts.tolist() == [4, 0, 4]
    first, second = some.sums(np.array([0, 4]), 4, substring.FACTORS)
    assert first != second and len(set(some.sums(np.array([0, 1]), 300, substring.FACTORS, words).tolist())) == 2


# --- conversations

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("conv", T.StringType()), T.StructField("nth", T.StringType()), T.StructField("audit", T.IntegerType()), T.StructField("size", T.StringType()),
])


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "n", 3, "s") for r in rows], TURNS).repartition(3)


def in_order(rows):
    """Turns by conversation: null turns first, then role, then SHA-256 of the text."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", SHA(text or ""), text or ""))
    return {conv: [(t if known else None, role, text) for known, t, role, _, text in sorted(turns)] for conv, turns in out.items()}


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_repair(turns):
    """Every column of the audit, and the repaired turns, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))

    @cache
    def best(i, made):
        """Cheapest (cost, audit, rest) from row i on, where ``made`` are the initials so far, shortened."""
        options = []
        if i == len(turns):
            if made in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, fault = turns[i][1], turns[i][2], faults[i]
            extra = 5 * (fault == "truncated")
            options.append(after(2, "D", best(i + 1, made)))
            if fault not in ("blank", "duplicate"):
                if legal(made, role[:1]):
                    options.append(after(extra, "K", best(i + 1, role[:1]), (role, text)))
                for new in ("user", "assistant"):
                    if legal(made, new[0]):
                        options.append(after(1 + extra, "R", best(i + 1, new[0]), (new, text)))
        for new in ("user", "assistant"):
            if legal(made, new[0]) and inserts[0] < 3:
                inserts[0] += 1
                options.append(after(5, "I", best.__wrapped__(i, new[0]), (new, "")))
                inserts[0] -= 1
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    inserts = [0]

    def after(cost, letter, rest, turn=None):
        return cost + rest[0], letter + rest[1], ((turn, *rest[2]) if turn else rest[2])

    def legal(made, new):
        return (made, new) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    cost, audit, fixed = best(0, "")
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), list(fixed)


def broken_turns(rng, convs, longest):
    rows = []
    for conv in convs:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(6)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            rows.append((conv, turn, role, rng.choice(["One.", "Two!", "three", " \t", None, "", "Four? ", "five\n", "Six.\x0b", "é."])))
    return rows


@pytest.mark.parametrize("spill", [2, 1000])
def test_repair_equals_brute_force(spark, spill):
    rng = random.Random(11)
    rows = broken_turns(rng, [None, *range(-3, 120)], 7)
    rows += [r for r in rows if rng.random() < 0.1] + [(500, 0, "user", "Hi."), (500, 1, "assistant", "x" * 60_000 + ".")]
    table = table_of(spark, rows)
    audits = repair.audit(table, spill=spill).cache()
    got = {r.conv_id: tuple(r[1:]) for r in audits.collect()}
    fixed, hashes = defaultdict(list), {r.conv_id: r.repaired_sha256 for r in repair.digests(table, audits).collect()}
    for r in repair.apply(table, audits).orderBy("conv_id", "position").collect():
        fixed[r.conv_id].append((r.role, r.text))
    want = {conv: brute_repair(turns) for conv, turns in in_order(rows).items()}
    assert got == {conv: w[0] for conv, w in want.items()}
    assert dict(fixed) == {conv: w[1] for conv, w in want.items() if w[1]}
    assert hashes == {conv: SHA("\n".join(f"{role}:{text}" for role, text in w[1])) for conv, w in want.items()}


def test_a_giant_conversation_spills_its_notes(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"turn {t}{rng.choice(['.', ''])}") for t in range(20_000)] + [(8, 0, "user", "Alone.")]
    table = table_of(spark, rows)
    few, many = ({r.conv_id: tuple(r) for r in repair.audit(table, spill=n).collect()} for n in (37, 1 << 20))
    assert few == many
    turns = in_order(rows)[7]
    audit, cost, state, at, initials = few[7][-1], 0, "", 0, []
    for edit in audit:  # the audit is a legal repair that costs what it says
        cost += {"D": 2, "I": 5, "K": 0, "R": 1}[edit] + 5 * (edit in "KR" and not turns[at][2].endswith("."))
        if edit != "D":
            state = turns[at][1][0] if edit == "K" else "a" if state == "u" else "u"
            initials.append(state)
        at += edit != "I"
    assert at == len(turns) and cost == few[7][-2] and re.fullmatch("(s?(ua)+)?", "".join(initials))


def test_no_conversations(spark):
    table = table_of(spark, [])
    audits = repair.audit(table)
    assert not audits.collect() and not repair.digests(table, audits).collect() and not repair.apply(table, audits).collect()
    assert not prefix_rows(spark, [])


# --- prefix trie


def head(conv):
    return zlib.crc32(str(conv).encode()) % 9


def brute_trie(rows):
    own = {conv: [(role, text) for _, role, text in turns] for conv, turns in in_order(rows).items() if conv is not None}
    rebuilt = {}
    for conv in own:
        h, base = head(conv), conv - int(np.fmod(conv, 5))
        rebuilt[conv] = own.get(base, [])[:h] + own[conv][h:]
    members = defaultdict(list)
    for conv in sorted(rebuilt):
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
    out = Counter()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(node))
        out[convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children(node)), sum(not children(n) for n in below), saved, SHA(ends)] += 1
    return out


def prefix_rows(spark, rows, **options):
    nodes = trie.trie(table_of(spark, rows), lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8, **options)
    return Counter(tuple(r) for r in nodes.collect())


def some_conversations(rng, n):
    rows = []
    for conv in range(-6, n):
        if rng.random() < 0.15:
            continue
        start = rng.choice([0, 0, 0, 1])
        for t in range(rng.randint(1, 14)):
            text = rng.choice([f"t{t}", f"t{t}", f"t{t}", f"é{t}", None, "", "other"])
            rows.append((conv, rng.choice([t, t, t, t, None, 3]), rng.choice(["user", "user", "user", "assistant", None]) if start else "user", text))
    return rows + [(None, 0, "user", "nobody's")] * 3


def test_trie_equals_brute_force(spark):
    rng = random.Random(13)
    rows = some_conversations(rng, 45)
    rows += [r for r in rows if rng.random() < 0.05]
    assert prefix_rows(spark, rows) == brute_trie(rows)


def test_trie_of_equal_conversations_and_a_giant_one(spark):
    rows = [(conv, t, "user", f"same {t}") for conv in range(0, 300) for t in range(3)]
    rows += [(1000, t, "user", f"step {t % 11}") for t in range(400)] + [(1005, t, "user", f"step {t % 11}") for t in range(390)]
    assert prefix_rows(spark, rows) == brute_trie(rows)


def test_colliding_fingerprints_are_found_and_done_again(spark):
    rows = some_conversations(random.Random(17), 20)
    # With base 1 a fingerprint is a sum: turns in another order collide.
    rows += [(50, 0, "user", "a"), (50, 1, "user", "b"), (55, 0, "user", "b"), (55, 1, "user", "a"), (65, 0, "user", "b"), (65, 1, "user", "a")]
    tried = []
    got = prefix_rows(spark, rows, base_for=lambda attempt: tried.append(attempt) or (1 if attempt == 0 else trie.base_of(attempt)))
    assert got == brute_trie(rows) and tried == [0, 1]


def test_products_compose():
    base, rng = trie.base_of(0), random.Random(4)
    marks = [rng.getrandbits(127) for _ in range(50)]
    one = lambda m: (1, m % trie.MODULUS)
    whole = (0, 0)
    for m in marks:
        whole = trie.joined(whole, one(m), base)
    for cut in (0, 1, 20, 50):
        parts = [(0, 0), (0, 0)]
        for i, m in enumerate(marks):
            parts[i >= cut] = trie.joined(parts[i >= cut], one(m), base)
        assert trie.joined(*parts, base) == whole
    for v in (0, 1, (1 << 64) - 1, 1 << 63, trie.MODULUS - 1):
        assert trie.whole(*trie.halves(v)) == v


# --- the queries and their SQL


def test_damaged_nulls_and_the_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = broken_turns(rng, [None, *range(60)], 9)
    folder = str(tmp_path)
    table_of(spark, rows).coalesce(1).write.parquet(f"{folder}/written")
    written = next(p for p in (tmp_path / "written").iterdir() if p.suffix == ".parquet")
    written.rename(tmp_path / "conversations.parquet")
    for name in ("op11_conversation_repair", "op13_prefix_trie"):
        same, why = compare(queries.QUERIES[name](spark, folder), duck(folder), queries.ORACLES[name])
        assert same, (name, why)
