"""Thin queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, langid, lmscore, media, minhash, packing, pii, repeats, sharding, vecdedup, whitening
from .runtime import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE, BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SEQUENCE, END_ID = 4096, 2
#: A conversation whose texts hold control strings.
ODD_CONVERSATION, ODD_TEXT = -7, r"\### Assistant: </turn> ok"


def op1_packing(spark: SparkSession, sf_dir: str, vocabulary: str = WORD_BPE) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary, END_ID, SEQUENCE)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, SEQUENCE, ["doc_id", "start", "ids_crc32"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs), keep=["doc_id"])
    base = F.filter("pii", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(pii, x -> x.base and x.kind = '{k}')) as bigint) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), F.expr("cast(size(filter(pii, x -> not x.base)) as bigint)").alias("n_added"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = WORD_BPE) -> DataFrame:
    made = bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shard_rows(narrow, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has a media column, so every conversation is rendered as a recording of its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    said = talks.select("conv_id", F.array_join(F.transform("turns", lambda x: x["text"]), "\n").alias("text"))
    return media.align_recordings(media.sonify(said, "conv_id", "text"), "conv_id", "media")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents))),
pairs AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words),
c1 AS (SELECT w, count(*) AS c FROM words GROUP BY w),
o1 AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS c FROM pairs WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT doc_id, v, w, count(*) AS c FROM pairs WHERE v IS NOT NULL GROUP BY doc_id, v, w),
own AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n FROM words),
scored AS (
  SELECT p.doc_id,
    CASE WHEN total.n = own.n THEN 1.0
         WHEN p.v IS NOT NULL AND c2.c - o2.c > 0 THEN (c2.c - o2.c)::DOUBLE / (cv.c - ov.c)::DOUBLE
         WHEN p.v IS NOT NULL THEN (greatest((c1.c - o1.c)::DOUBLE, 0.5::DOUBLE) / (total.n - own.n)::DOUBLE) * 0.4::DOUBLE
         ELSE greatest((c1.c - o1.c)::DOUBLE, 0.5::DOUBLE) / (total.n - own.n)::DOUBLE END AS s
  FROM pairs p CROSS JOIN total
  JOIN own ON own.doc_id = p.doc_id
  JOIN c1 ON c1.w = p.w JOIN o1 ON o1.doc_id = p.doc_id AND o1.w = p.w
  LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN o1 ov ON ov.doc_id = p.doc_id AND ov.w = p.v
  LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.w = p.w)
SELECT d.doc_id, coalesce(own.n, 0)::BIGINT AS n_words, coalesce(x.m, 0)::BIGINT AS score_micro
FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, sum(round(log10(s) * 1000000)::BIGINT) AS m FROM scored GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_chat(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_BPE) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    made = chat.format_turns(turns.unionByName(odd), vocabulary, keep=["conv_id"], ranks=BYTE_RANKS, pattern=public_tokenizers.PATTERN)
    return chat.digest_turns(chat.read_turns(made, vocabulary)).withColumnRenamed("conv", "conv_id")


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
written AS (SELECT *, length(regexp_extract_all(text, '\\|<turn>|<says>|</turn>|<\|endoftext\|>')) AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(19 + length(role) + length(text) + marks)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings"), 32)
    return made.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    restored = fim.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored.cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
hashed AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


QUERIES = {"op1_packing": op1_packing, "op2_pii": op2_pii, "op3_embeddings": op3_embeddings, "op4_bpe": op4_bpe, "op5_langid": op5_langid, "op6_sharding": op6_sharding, "op7_media": op7_media, "op8_minhash": op8_minhash, "op9_lmscore": op9_lmscore, "op10_repeats": op10_repeats, "op11_chat": op11_chat, "op12_whitening": op12_whitening, "op13_fim": op13_fim}

ORACLE_SQL: dict[str, str] = {"op9_lmscore": OP9_SQL, "op11_chat": OP11_SQL, "op13_fim": OP13_SQL}
