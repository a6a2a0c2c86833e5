"""The registered queries of the operators: thin digests over the operators' outputs."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm import align, bitslice, bpe, chat, html_text, negatives, packing, quality, rules, secrets, simhash, suffix, warc
from fotolith.llm.common import Scratch, prepare, table

def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    return os.path.realpath(public_tokenizers.path(name))


#: A conversation of the contract whose texts hold the template's own control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )  # fmt: skip
    made = chat.format_conversations(rows.unionByName(planted))
    made = made.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask")))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )  # fmt: skip


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), Scratch(spark, "packing"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch = Scratch(spark, "warc")
    archives = scratch.write(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0), "archives", "uncompressed")
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    fps = simhash.fingerprints(table(spark, sf_dir, "documents"), size=3)
    out = simhash.classes(fps, Scratch(spark, "simhash"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op7_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitslice.top_k(rows, rows.where("vec_id % 50 = 0"), 5, Scratch(spark, "bitslice"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = suffix.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "suffix"))
    return made.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )  # fmt: skip


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.evaluate(docs).select(
        "doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words",
        "rules.base_failed", "rules.kept", "rules.n_lines_removed", "rules.words_kept",
        "rules.n_punctuation", "rules.n_navigation", "rules.n_boilerplate",
    )  # fmt: skip


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return align.aligned_links(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), Scratch(spark, "align"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch = Scratch(spark, "secrets")
    ledger = secrets.Ledger(spark, f"{scratch.root}/ledger")
    found = secrets.scan(table(spark, sf_dir, "documents"), ledger, scratch)
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    base = secrets.listed(secrets.of_kind(F.col("spans"), *secrets.kinds((secrets.BASE,))))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, Scratch(spark, "negatives")).drop("positive_rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_bitslice": op7_bitslice,
    "op8_suffix_array": op8_suffix_array,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_align": op11_align,
    "op12_secrets": op12_secrets,
    "op13_negatives": op13_negatives,
}

ORACLE: dict[str, str] = {
    "op8_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (SELECT doc_id, unnest(range(0, greatest(strlen(h) // 2 - 49, 0))) AS p,
  unnest(list_transform(range(0, greatest(strlen(h) // 2 - 49, 0)), lambda i: md5(substr(h, (2 * i + 1)::INT, 100)))) AS g FROM d),
marked AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM grams),
hits AS (SELECT doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after FROM marked WHERE least < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p, least(50, coalesce(after - p, 50)) AS n, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b, sum(n) AS n FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, run, a, b, n, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS from_byte FROM spans),
heads AS (SELECT doc_id, count(*) AS n_spans, sum(n) AS n_removed, max(b) AS last, list({'r': run, 'a': from_byte, 'b': a}) AS parts FROM cuts GROUP BY doc_id)
SELECT d.doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(list_sort(parts), lambda x: substr(h, (2 * x.a + 1)::INT, (2 * (x.b - x.a))::INT)), ''), '')
    || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256
FROM d LEFT JOIN heads USING (doc_id)""",
    "op1_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), flagged AS (
  SELECT *, bool_or(regexp_matches(role || text, '[<\[]\\*(/?s>|/?INST\])')) OVER (PARTITION BY conv_id) AS hit FROM rows
), sized AS (
  SELECT *, CASE WHEN hit THEN regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') ELSE role END AS r,
    CASE WHEN hit THEN regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') ELSE text END AS t FROM flagged
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 20)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op3_warc": """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT hex, min(page_id) AS head FROM hashed GROUP BY hex)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to
FROM hashed JOIN firsts USING (hex)""",
    "op7_bitslice": """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM parts q JOIN parts r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5""",
}


def _secrets_sql() -> str:
    """Places from what lies between the matches; a rule a branch."""
    branches = []
    for place, rule in enumerate(r for p in secrets.PACKS for r in p.rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        branches.append(f"""
  SELECT doc_id, t, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS g,
    string_split_regex(t, {pattern}) AS s FROM d WHERE regexp_matches(t, {pattern})""")
    base = ", ".join(f"'{k}'" for k in secrets.kinds((secrets.BASE,)))
    one = "kind || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL".join(branches)}
), numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found
), placed AS (
  SELECT doc_id, place, kind, list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[i]) AS n
  FROM numbered WHERE length(g[i]) >= least
), spans AS (SELECT doc_id, place, kind, a, a + n AS b FROM placed
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg({one}, ',' ORDER BY a, place) FILTER (WHERE kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY a, place) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


ORACLE["op12_secrets"] = _secrets_sql()

#: Word and line rules as regular expressions: words of the contract, and words between any white space of Unicode.
_WORD, _ANY_WORD = r"'[^\x20\x09-\x0D]+'", r"'[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
ORACLE["op9_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT r, doc_id, t, regexp_extract_all(t, {_WORD}) AS w, length(regexp_replace(t, '[ 	-]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), windows AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS name FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM base)
), twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, name) > 1
), covered AS (SELECT r, least(8, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 8)) AS n FROM twice
), repeats AS (SELECT r, sum(n) AS n_repeat_words FROM covered GROUP BY r
), lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
), worded AS (
  SELECT r, line, i, len(regexp_extract_all(line, {_WORD})) AS k, regexp_extract_all(line, {_ANY_WORD}) AS u, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup FROM lines WHERE regexp_matches(line, {_WORD})
), facts AS (
  SELECT *, length(line) - length(regexp_replace(line, '[|›»·•]', '', 'g')) AS bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    (length(line) - length(replace(line, '!!', ''))) // 2 AS bangs, regexp_matches(line, '[.!?"''”’»:;)\]…。！？][ 	-]*\z') AS ended,
    list_aggregate(u, 'mode') AS often FROM worded
), judged AS (
  SELECT r, k, dup, CASE
    WHEN dup THEN 3
    WHEN bars >= 3 AND bars >= 0.25::DOUBLE * k THEN 2
    WHEN symbols > 0.3::DOUBLE * k + 2 OR bangs > 0.5::DOUBLE * k THEN 1
    WHEN k < 3 AND NOT ended OR k >= 30 AND NOT regexp_matches(line, '[.!?…。！？]') THEN 1
    WHEN k >= 4 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}ªº]') THEN 1
    WHEN k < 40 AND regexp_matches(line, '[©®™]') THEN 3
    WHEN k >= 4 AND NOT ended AND len(list_filter(u, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 0.8::DOUBLE * len(u) THEN 2
    WHEN len(list_filter(u, lambda x: regexp_matches(x, '://|www\.|@'))) > 0.5::DOUBLE * len(u) THEN 3
    WHEN k >= 8 AND 2 * list_unique(u) <= len(u) AND len(list_filter(u, lambda x: x = often)) > 0.5::DOUBLE * len(u) THEN 3
    ELSE 0 END AS fault FROM facts
), summed AS (
  SELECT r, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(k) FILTER (WHERE fault > 0), 0) AS lost, count(*) FILTER (WHERE fault > 0) AS n_lines_removed,
    count(*) FILTER (WHERE fault = 1) AS n_punctuation, count(*) FILTER (WHERE fault = 2) AS n_navigation, count(*) FILTER (WHERE fault = 3) AS n_boilerplate FROM judged GROUP BY r
), whole AS (
  SELECT doc_id, len(w) AS n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost,
    coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate
  FROM base LEFT JOIN repeats USING (r) LEFT JOIN summed USING (r)
), failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - lost) >= 50 * n_words AS kept, n_lines_removed, (n_words - lost)::BIGINT AS words_kept,
  n_punctuation, n_navigation, n_boilerplate FROM failed"""
