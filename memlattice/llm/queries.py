"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import langid, lm_score, minhash, packing, piece_viterbi, quality, spotsigs, toxicity, url_filter, warc
from memlattice.llm._shared import table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def fold(n: int, held: int) -> Column:
    """Whether a row of documents is held out: crc32 of doc_id as text, modulo n. Rows without an id are."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == held, F.lit(True))


def op1_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log10_perplexity", "lower", "upper")


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op3_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_viterbi.encoded(docs, path, scores=piece_viterbi.fit(docs, path))
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("bigint").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary = lm_score.fit(docs, ~fold(5, 1), public_tokenizers.path("word_bpe_49k.json"))
    out = lm_score.scored(docs, model, vocabulary)
    return out.select("doc_id", fold(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~fold(5, 0))
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", fold(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = warc.derivatives(warc.responses(pages))
    text = F.when(F.col("record_type") == "conversion", F.col("block").cast("string")).alias("text")
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest", F.octet_length("block").cast("bigint").alias("content_length"), text)


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~fold(4, 2))
    out = toxicity.score(docs, model, keep=["doc_id"])
    score = F.col("toxic_score")
    predicted = (score >= toxicity.THRESHOLD).cast("int")
    return out.select("doc_id", fold(4, 2).alias("held_out"), score.alias("score"), predicted.alias("predicted"), "toxic_evidence", "toxic_window")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
_WHEN = " ".join(
    f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _near_sql(words: int, percent: int) -> str:
    """Every pair of documents with a common shingle is compared; components by the least id reachable."""
    glued = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(words))
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct([{glued} FOR i IN range(1, len(w) - {words} + 2)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
both_sides AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_sides WHERE 100 * shared >= {percent} * (na + nb - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON doc_id = a"""


def _spots_sql() -> str:
    """Words as rows; an anchor whose next word is no anchor starts a chain with the CHAIN content words after it."""
    anchors = ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS)))
    follow = " || chr(1) || ".join(f"coalesce(c{k}.w, '')" for k in range(1, spotsigs.CHAIN + 1))
    joins = " ".join(f"LEFT JOIN content c{k} ON c{k}.k = h.k AND c{k}.r = h.r + {k}" for k in range(1, spotsigs.CHAIN + 1))
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
after_it AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM base),
edits AS (SELECT doc_id, text, following, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM after_it),
texts AS (SELECT doc_id || 't' AS k, text AS t FROM edits UNION ALL SELECT doc_id || 'e', edited FROM edits UNION ALL SELECT doc_id || 'n', following FROM edits),
norms AS (SELECT k, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM texts),
words AS (SELECT k, unnest(split(norm, ' ')) AS w, generate_subscripts(split(norm, ' '), 1) AS i FROM norms WHERE norm <> ''),
marked AS (
  SELECT k, i, w, w IN ({anchors}) AS stop, lead(w) OVER (PARTITION BY k ORDER BY i) IN ({anchors}) AS next_stop,
         sum(CASE WHEN w IN ({anchors}) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM words),
content AS (SELECT k, r, w FROM marked WHERE NOT stop),
chains AS (SELECT DISTINCT h.k, substr(md5(h.w || chr(1) || {follow}), 1, 8) AS sig FROM marked h {joins} WHERE h.stop AND NOT coalesce(h.next_stop, false)),
found AS (SELECT k, list_sort(list(sig)) AS s FROM chains GROUP BY k),
sigs AS (SELECT n.k, CASE WHEN s IS NOT NULL THEN s WHEN norm = '' THEN [] ELSE [substr(md5(norm), 1, 8)] END AS s FROM norms n LEFT JOIN found f ON f.k = n.k),
three AS (
  SELECT d.doc_id, d.text, d.edited, t.s AS t, e.s AS e, n.s AS n, len(list_intersect(t.s, e.s)) AS te, len(list_intersect(t.s, n.s)) AS tn
  FROM edits d JOIN sigs t ON t.k = d.doc_id || 't' JOIN sigs e ON e.k = d.doc_id || 'e' JOIN sigs n ON n.k = d.doc_id || 'n')
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(t, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
       CASE WHEN len(t) + len(e) = 0 THEN 1.0 ELSE CAST(te AS DOUBLE) / (len(t) + len(e) - te) END AS near_edited,
       CASE WHEN len(t) + len(n) = 0 THEN 1.0 ELSE CAST(tn AS DOUBLE) / (len(t) + len(n) - tn) END AS near_next
FROM three"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_circulant_minhash": _near_sql(2, 80),
        "op10_spotsigs": _spots_sql(),
        "op8_url_cascade": f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_WHEN} END AS rule FROM named),
told AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ({", ".join(f"'{h}{p}'" for v, h, p in URL_RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS said FROM ruled),
bad AS (SELECT host FROM told WHERE host <> '' AND said IS NOT NULL GROUP BY host HAVING count(*) FILTER (said = 'block') > count(*) FILTER (said = 'allow'))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM told""",
    }
