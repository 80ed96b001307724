"""One query for each operator, over its whole table with production parameters; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, linecrf, linededup, minhash, packing, repair, simhash, suffixdedup, toxicity, urltree, wand
from .util import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted")
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    kind = {f.name: f.dataType for f in turns.schema}
    own = [F.struct(*(F.lit(v).cast(kind[c]).alias(c) for c, v in (("conv_id", -7), ("turn", t), ("role", r), ("text", says)))) for t, r in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.explode(F.array(*own)).alias("t")).select("t.*")
    return chat.digests(chat.format_prefix_target(turns.unionByName(extra)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return both.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, asked)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = linecrf.fit(docs, table(spark, sf_dir, "labels"))
    return linecrf.score(docs, field).select(
        "doc_id", linecrf.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash_dedup, op3_fingerprints, op4_url_filter, op5_suffix_dedup, op6_chat_format, op7_packing, op8_bpe, op9_line_dedup, op10_search, op11_quality, op12_ranked_search, op13_conversation_repair)}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_RULES = sorted(urltree.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = "(host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}')"

ORACLE_SQL = {
    "op4_url_filter": f"""
WITH own AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(*r)} THEN '{r[1]}{r[2]}'" for r in _RULES)} END AS rule,
    CASE {" ".join(f"WHEN {_FITS.format(*r)} THEN '{r[0]}'" for r in _RULES)} END AS said FROM own
), paths AS (
  SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM ruled
), shaped AS (
  SELECT *, list_transform(parts, lambda s: regexp_replace(CASE WHEN regexp_matches(s, '[0-9]') THEN regexp_replace(s, '[0-9a-fA-F]{{12,}}', '<hex>', 'g') ELSE s END, '[0-9]+', '<n>', 'g')) AS t FROM paths
), tree AS (
  SELECT host, t AS was, count(*) AS n, count(said) AS l, count(*) FILTER (said = 'block') AS b FROM shaped GROUP BY host, t
), steps AS (
  SELECT host, was, n, i AS d, was[i] AS seg, was[1:i - 1] AS above FROM tree, unnest(generate_series(1, len(was))) AS u(i)
), wide AS (
  SELECT host, d, above FROM steps GROUP BY host, d, above HAVING count(DISTINCT seg) >= 20 AND 2 * count(DISTINCT seg) >= sum(n)
), hit AS (
  SELECT host, was, list(d) AS ds FROM steps JOIN wide USING (host, d, above) GROUP BY host, was
), general AS (
  SELECT tree.*, list_transform(was, lambda s, i: CASE WHEN list_contains(coalesce(ds, []), i) THEN '*' ELSE s END) AS t FROM tree LEFT JOIN hit USING (host, was)
), branches AS (
  SELECT host, t, sum(l) AS l, sum(b) AS b FROM general GROUP BY host, t HAVING sum(l) >= 5
), siblings AS (
  SELECT host, t, l, b, i AS d, list_transform(t, lambda s, j: CASE WHEN j = i THEN '*' ELSE s END) AS rest FROM branches, unnest(generate_series(1, len(t))) AS u(i)
), pools AS (
  SELECT host, d, rest, (sum(b) + 0.5) / (sum(l) + 1) AS p FROM siblings GROUP BY host, d, rest HAVING count(*) > 1
), alike AS (
  SELECT host, t, list(d) AS ds FROM siblings JOIN pools USING (host, d, rest) WHERE abs(b - l * p) <= 1.96 * sqrt(l * p * (1 - p)) GROUP BY host, t
), merged AS (
  SELECT host, was, l, b, list_transform(general.t, lambda s, i: CASE WHEN list_contains(coalesce(ds, []), i) THEN '*' ELSE s END) AS t FROM general LEFT JOIN alike USING (host, t)
), judged AS (
  SELECT host, t, CASE WHEN (sum(b) + 0.4) / (sum(l) + 2) >= 0.5 THEN 'block' ELSE 'allow' END AS template_verdict FROM merged GROUP BY host, t
)
SELECT page_id, s.host, s.path, s.rule, coalesce(s.said, j.template_verdict) AS verdict
FROM shaped s JOIN merged m ON m.host = s.host AND m.was = s.t JOIN judged j ON j.host = m.host AND j.t = m.t
""",
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    length(coalesce(text, '')) + length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\', ''))
      + length(regexp_replace(coalesce(text, ''), '<\||</?s>|\[/?INST\]', '#\0', 'g')) - length(coalesce(text, '')) AS body,
    length('<|im_start|>' || coalesce(role, '') || chr(10)) + length('<|im_end|>' || chr(10)) AS frame
  FROM c
), s AS (
  SELECT *, sum(body + frame) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR back = 1))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM c),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM c) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t, docs),
s AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN c USING (r), g GROUP BY item_id, r
),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s JOIN c USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
""",
}
