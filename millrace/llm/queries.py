"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import alignment, collocations, decontam, imatch, jaccard, lines, packing, phrases, pieces, privacy, quality, sharding, vectors
from millrace.llm.common import load, tokenizer_path


def _sha(column: str):
    return F.sha2(F.encode(column, "UTF-8"), 256)


def op1_attention_quality(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = quality.score_documents(docs.select("doc_id", "text"), quality.fit(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_one_bit_neighbours(spark, sf_dir):
    return vectors.nearest(load(spark, sf_dir, "embeddings"), query_modulus=50, k=5)


def op3_sum_of_squares_packing(spark, sf_dir):
    out = packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0, outputs=("ids_crc32",))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_hypergeometric_shards(spark, sf_dir):
    out = sharding.shuffle_into_shards(load(spark, sf_dir, "documents"), 24)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_repeated_phrases(spark, sf_dir):
    out = phrases.remove_repeated(load(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op6_i_match(spark, sf_dir):
    return imatch.fingerprint_pairs(load(spark, sf_dir, "documents"))


def op7_two_filter_lines(spark, sf_dir):
    out = lines.drop_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def op8_disclosure_sanitising(spark, sf_dir):
    out = privacy.sanitise(load(spark, sf_dir, "documents").select("doc_id", "text"), scope="document")
    base = [F.col(f"entities.{k}") for k in privacy.KINDS]
    counts = [F.coalesce(F.size(b), F.lit(0)).cast("bigint").alias(f"n_{k}") for k, b in zip(privacy.KINDS, base)]
    return out.select(
        "doc_id", *[F.when(F.col("entities").isNull(), 0).otherwise(c).cast("bigint").alias(f"n_{k}") for k, c in zip(privacy.KINDS, counts)],
        F.sha2(privacy.span_list(*base), 256).alias("base_sha256"), privacy.span_list(*base, F.col("entities.terms")).alias("spans"))


def op9_chosen_path_join(spark, sf_dir):
    return jaccard.similarity_groups(load(spark, sf_dir, "documents"), words=5, threshold=0.8).select("doc_id", "class_id", "group_id", "links")


def op10_piece_codec(spark, sf_dir):
    return pieces.encode_documents(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_setm_collocations(spark, sf_dir):
    return collocations.collocations(load(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000)


def op12_token_alignment(spark, sf_dir):
    return alignment.align_documents(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_suffix_array_leaks(spark, sf_dir):
    found = decontam.screen(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"), window=10, matches=False)
    return found.withColumn("n_hit", decontam.hit_words(F.col("hit"))).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_attention_quality, op2_one_bit_neighbours, op3_sum_of_squares_packing, op4_hypergeometric_shards, op5_repeated_phrases, op6_i_match, op7_two_filter_lines, op8_disclosure_sanitising, op9_chosen_path_join, op10_piece_codec, op11_setm_collocations, op12_token_alignment, op13_suffix_array_leaks)}

_KEY = r"regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

ORACLE = {
    "op7_two_filter_lines": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
rows AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM split),
keyed AS (SELECT doc_id, line, i, {_KEY} AS key FROM rows),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, line, i, g.key IS NOT NULL AS lost FROM keyed k LEFT JOIN gone g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_setm_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS lengths(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
inner2 AS (SELECT lang, array_to_string(ws[s:s + 1], ' ') AS phrase, max(a) AS longer FROM cand, (VALUES (1), (2)) AS place(s) WHERE k = 3 GROUP BY ALL),
left_over AS (SELECT c.* FROM cand c LEFT JOIN inner2 i ON c.k = 2 AND i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT lang, phrase, a, k AS words, ws, unnest(range(1, k)) AS cut FROM left_over) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:c.words], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_suffix_array_leaks": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS w FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, s, array_to_string(ws[s:s + k - 1], ' ') AS w FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, lengths WHERE len(ws) >= k)),
met AS (SELECT r, s, k, item_id FROM dw JOIN iw USING (k, w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM met)) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)""",
}
