"""The opN_ queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.llm import bpe, chat, exact_dedup, fim, hard_negatives, ngram_join, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_orc, toxicity
from hearthlog.llm.common import load, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"), digest_all=True)


SQL["op10_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql(rules: quality_rules.Rules) -> str:
    """The measures of quality_rules.score in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    stops, upper, lower = quality_rules.STOPS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    classes = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?\x22\x27()\-]", None, r"[^\x00-\x7F]"]
    count = [f"length(regexp_replace(t, '{c[0]}^{c[1:]}', '', 'g'))" if c and c[1] != "^" else f"length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))" if c else None for c in classes]
    count[5] = "length(t) - " + " - ".join(c for c in count if c)
    char_refs = ", ".join(f"({quoted(lang)}, {i}, {float(v)!r}::DOUBLE)" for lang, vs in rules.characters.items() for i, v in enumerate(vs))
    word_refs = ", ".join(f"({quoted(lang)}, {quoted(w)}, {float(v)!r}::DOUBLE)" for lang, ws in rules.words.items() for w, v in [*ws.items(), ("", 1 - sum(ws.values()))])
    char_rows = " UNION ALL ".join(f"SELECT row, {i} AS cls, ({c})::DOUBLE AS n FROM d" for i, c in enumerate(count))
    distance = lambda total: f"CASE WHEN {total} > 0 THEN sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) ELSE 1 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
tokens AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
windows AS (
  SELECT row, i, string_agg(word, ' ') OVER five AS five, count(*) OVER five AS k FROM tokens
  WINDOW five AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, five) > 1 AS again FROM windows WHERE k = 5),
repeats AS (
  SELECT t.row, count(DISTINCT t.i) AS n FROM tokens t JOIN twice a ON a.row = t.row AND a.again AND t.i BETWEEN a.i AND a.i + 4 GROUP BY t.row
),
lines AS (
  SELECT row, sum(c - 1)::BIGINT AS n FROM (
    SELECT row, line, count(*) AS c FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY row
),
char_refs(lang, cls, q) AS (VALUES {char_refs}),
char_rows AS (SELECT *, sum(n) OVER (PARTITION BY row) AS total FROM ({char_rows})),
char_jsd AS (
  SELECT row, lang, {distance("any_value(total)")} AS x
  FROM (SELECT row, lang, total, n / greatest(total, 1) AS p, q FROM char_rows JOIN char_refs USING (cls)) GROUP BY row, lang
),
word_refs(lang, word, q) AS (VALUES {word_refs}),
plain AS (
  SELECT row, CASE WHEN word IN (SELECT word FROM word_refs) THEN word ELSE '' END AS word, count(*)::DOUBLE AS n
  FROM (SELECT row, unnest(regexp_extract_all(translate(t, {quoted(upper + stops)}, {quoted(lower + " " * len(stops))}), '[^\\x20\\x09-\\x0D]+')) AS word FROM d)
  GROUP BY ALL
),
totals AS (SELECT row, sum(n) AS total FROM plain GROUP BY row),
grid AS (SELECT row, total, word FROM totals CROSS JOIN (SELECT DISTINCT word FROM word_refs)),
word_jsd AS (
  SELECT row, lang, {distance("any_value(total)")} AS x
  FROM (
    SELECT g.row, l.lang, g.total, coalesce(p.n, 0) / g.total AS p, coalesce(r.q, 0) AS q
    FROM grid g CROSS JOIN (SELECT DISTINCT lang FROM word_refs) l
    LEFT JOIN plain p ON p.row = g.row AND p.word = g.word LEFT JOIN word_refs r ON r.lang = l.lang AND r.word = g.word
  ) GROUP BY row, lang
),
m AS (
  SELECT w.row, doc_id, t, len(words)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         round((SELECT min(x) FROM char_jsd c WHERE c.row = w.row), 6) AS a, round(coalesce((SELECT min(x) FROM word_jsd c WHERE c.row = w.row), 1), 6) AS b
  FROM w LEFT JOIN lines USING (row) LEFT JOIN repeats USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR length(t) >= {rules.least_chars} AND a > {rules.most_char_distance} OR n_words >= {rules.least_words} AND b > {rules.most_word_distance}) AS kept
FROM m
"""


SQL["op2_quality_rules"] = _rules_sql(quality_rules.Rules())


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


SQL["op8_chat_formatting"] = """
WITH c AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
),
p AS (
  SELECT conv_id, alone, role, text, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY conv_id, alone) AS n FROM c
),
prefixes AS (
  SELECT conv_id, alone, place, n, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id, alone ORDER BY place) AS turns FROM p
),
wholes AS (SELECT place, turns, min(struct_pack(c := conv_id, a := alone)) AS key, count(*) AS copies FROM prefixes WHERE place = n GROUP BY place, turns),
maximal AS (SELECT * FROM wholes w WHERE NOT EXISTS (SELECT 1 FROM prefixes x WHERE x.place < x.n AND x.place = w.place AND x.turns = w.turns))
SELECT p.conv_id, max(p.n) AS n_turns, max(m.copies) AS copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM p JOIN maximal m ON p.conv_id IS NOT DISTINCT FROM m.key.c AND p.alone IS NOT DISTINCT FROM m.key.a
GROUP BY p.conv_id, p.alone
"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents")).drop("text")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(load(spark, sf_dir, "documents"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(load(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (fim.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b]
                        ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(load(spark, sf_dir, "embeddings").withColumn("label", moved))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL["op12_hard_negatives"] = """
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS row, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, id, row) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.uid, p.row ORDER BY n.score DESC, n.id, n.row)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.uid = p.uid AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""


@query
def op13_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
