"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hmm, language, lines, mixing, packing, pii, quality, repair, simhash, substring, trie, warc
from ..functions.spread import null_safe_join
from .common import stored, tuned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    refers = F.regexp_extract(warc.field("WARC-Refers-To"), "^<urn:capture:(-?[0-9]+)>$", 1)
    return warc.read(spark, folder).select(
        F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        warc.field("WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


OP1 = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id < top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    applied = lines.apply(docs, lines.keep_bitmaps(docs))
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owned AS (SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents")).drop("ties")


OP3 = f"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), {BLANK}, '') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.replicate(table(spark, sf_dir, "documents"))
    return copies.select("row.*", "copy", F.round("rate", 9).alias("rate"), "place")


OP4 = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
shares AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, {mixing.TEMPERATURE}) ELSE 0 END AS share FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM shares)::DOUBLE * share / (SELECT sum(share) FROM shares) / size ELSE 1 END AS rate FROM shares),
bounds AS (SELECT source, rate, CASE WHEN rate >= 400 THEN floor(rate - 9 * sqrt(rate) - 8) ELSE 0 END::BIGINT AS low, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT AS high FROM rates WHERE rate > 0),
steps AS (SELECT source, rate, low, unnest(range(low, high + 1)) AS k FROM bounds),
terms AS (SELECT *, exp(k * ln(rate) - rate - lgamma(k + 1)) AS term FROM steps),
dist AS (SELECT source, rate, low, k, sum(term) OVER (PARTITION BY source ORDER BY k) / CASE WHEN low > 0 THEN sum(term) OVER (PARTITION BY source) ELSE 1 END AS at_most FROM terms),
drawn AS (SELECT d.*, r.rate, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, (SELECT count(*) FROM dist t WHERE t.source IS NOT DISTINCT FROM drawn.source AND t.at_most <= drawn.u)
  + (SELECT coalesce(max(low), 0) FROM bounds b WHERE b.source IS NOT DISTINCT FROM drawn.source) AS n FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy, round(rate, 9) AS rate,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS place
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), prompt_line=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm.train_and_score(docs, held_out=lambda crc: F.pmod(crc, F.lit(7)) == 2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.train_and_predict(docs, held_out=lambda crc: F.pmod(crc, F.lit(4)) == 2)


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of op11's contract, by CRC-32 of ``conv_id:turn``."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    chosen = rows.select("*", (F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20).alias("damage"))
    damage, text = F.col("damage"), known("text")
    copies = F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1)
    return chosen.select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(known("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    broken = damaged(rows)
    audits = stored(repair.audit(broken), "audits")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    found = null_safe_join(rows.select("conv_id").distinct(), audits, ["conv_id"])
    found = null_safe_join(found, repair.digests(broken, audits), ["conv_id"])
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return found.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


def edit_sql(later: str, cost: str, letter: str, line: str) -> str:
    """An edit before those of ``later``: nine digits of cost, the letters, a mark, the repaired lines."""
    return (
        f"lpad((substr({later}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({later}, 10, strpos({later}, chr(1)) - 9)"
        f" || {line} || substr({later}, strpos({later}, chr(1)) + 1)"
    )


def plain_sql(state: int) -> str:
    """The cheapest of delete, keep and rerole in a state, as one comparable text."""
    reroled = repair.NEXT[state]
    keeps = " ".join(
        f"WHEN initial = '{initial}' THEN {edit_sql(f'e{repair.KEPT[state, kind]}', '5 * (fault = 3)::BIGINT', 'K', "chr(10) || role || ':' || text")}"
        for initial, kind in repair.KINDS.items() if (state, kind) in repair.KEPT
    )
    reroles = edit_sql(f"e{reroled}", "1 + 5 * (fault = 3)::BIGINT", "R", f"chr(10) || '{repair.ROLE[state].decode()}:' || text")
    return f"least({edit_sql(f'e{state}', '2', 'D', "''")}, CASE WHEN fault IN (1, 2) THEN NULL {keeps} END, CASE WHEN fault NOT IN (1, 2) THEN {reroles} END)"


def insert_sql(state: int, later: str) -> str:
    return edit_sql(later, "5", "I", f"chr(10) || '{repair.ROLE[state].decode()}:'")


def best_sql(state: int, e: str) -> str:
    """The same with up to two inserts before it."""
    after = repair.NEXT[state]
    return f"least({e}{state}, {insert_sql(state, f'{e}{after}')}, {insert_sql(state, insert_sql(after, f'{e}{repair.NEXT[after]}'))})"


OP11 = f"""
WITH RECURSIVE named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql('name')} % 20 AS damage FROM named),
broken AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
  CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, substr(role, 1, 1) AS initial, rtrim(text, {BLANK}) AS body FROM broken),
judged AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS later FROM turns),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (later IS NOT NULL AND initial || '>' || later NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM judged GROUP BY conv_id),
best AS (SELECT conv_id, n AS left_, '000000000' || chr(1) AS e0, '000000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS e1,
  '000000005I' || chr(1) || chr(10) || 'assistant:' AS e2, '000000000' || chr(1) AS e3 FROM counts
  UNION ALL SELECT conv_id, left_ - 1, {best_sql(0, 'p')}, {best_sql(1, 'p')}, {best_sql(2, 'p')}, {best_sql(3, 'p')}
  FROM (SELECT b.conv_id, left_, {', '.join(f'{plain_sql(s)} AS p{s}' for s in range(4))}
    FROM best b JOIN judged t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.left_ = t.i)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(substr(e0, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(e0, 10, strpos(e0, chr(1)) - 10), '') AS audit,
  sha256(coalesce(substr(e0, strpos(e0, chr(1)) + 2), '')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id AND b.left_ = 0
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12 = f"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
spots AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM texts),
wins AS (SELECT doc_id, pos, word, CASE WHEN lead(word, {substring.WINDOW - 1}) OVER w IS NOT NULL THEN concat_ws(' ', {', '.join(f'lead(word, {k}) OVER w' for k in range(substring.WINDOW))}) END AS win
  FROM spots WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
owned AS (SELECT doc_id, pos, word, win IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY win) AS dup FROM wins),
gone AS (SELECT doc_id, pos, word, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {substring.WINDOW - 1} PRECEDING AND CURRENT ROW) AS goes FROM owned),
kept AS (SELECT doc_id, count(*) FILTER (goes) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT goes) AS kept FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda conv: F.crc32(conv.cast("string").cast("binary")) % 9
    return trie.trie(table(spark, sf_dir, "conversations"), lambda conv: conv - conv % 5, head, longest_head=8)


OP13 = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS name, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (SELECT a.c, a.base, a.n, {crc32_sql('a.name')} % 9 AS h, coalesce(b.n, 0) AS n_base FROM ids a LEFT JOIN ids b ON b.c = a.base),
rebuilt AS (SELECT c, i AS d, role, text FROM convs JOIN turns ON conv_id = base AND i <= h
  UNION ALL SELECT c, least(h, n_base) + i - h, role, text FROM convs JOIN turns ON conv_id = c AND i > h),
paths AS (SELECT c, d, octet_length(encode(text)) AS size, string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, left(path, greatest(64 * (d - 1), 0)) AS above FROM paths GROUP BY d, path),
lasts AS (SELECT c, max_by(path, d) AS path FROM paths GROUP BY c),
finals AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM lasts GROUP BY path),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
counted AS (SELECT x.*, coalesce(n, 0) AS n_children FROM nodes x LEFT JOIN children k USING (path)),
subtrees AS (SELECT x.path, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.size)::BIGINT AS saved FROM counted x JOIN counted y ON starts_with(y.path, x.path) GROUP BY x.path)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM counted x JOIN subtrees USING (path) LEFT JOIN finals f ON f.path = x.path LEFT JOIN nodes p ON x.d > 0 AND p.path = x.above
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_line_dedup, op3_exact_dedup, op4_mixing, op5_packing, op6_lm_scoring, op7_pii, op8_simhash, op9_quality, op10_language_id, op11_conversation_repair,
              op12_substring_dedup, op13_prefix_trie)
}

#: Tokenizer files, trained models, XXH64 and rolling-hash coverage have no SQL twin: tests hold those queries to brute force.
ORACLES: dict[str, str] = {"op1_warc": OP1, "op2_line_dedup": OP2, "op3_exact_dedup": OP3, "op4_mixing": OP4, "op11_conversation_repair": OP11, "op12_substring_dedup": OP12, "op13_prefix_trie": OP13}
