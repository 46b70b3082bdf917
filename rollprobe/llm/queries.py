"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, html_extract, jaccard_join, media, mixing, packing, prefix_trie, quality, simhash, token_counts, token_output, toxicity
from .chunk_tokens import tokenizer_path
from .common import small_batches
from .quality import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(5, 0)))
    got = quality.score(docs, model)
    return got.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "top_weight")


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(3, 1)))
    got = toxicity.score(docs, model)
    return got.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.token_output(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.to_media(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, size=2048)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_block", "slot", "position")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel, scale=256, positives=5, negatives=10, low=30, high=90)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), span=5, most=9)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_join(table(spark, sf_dir, "documents"), k=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_approximate_nearest_neighbours, op4_toxicity, op5_token_output, op6_media_columns, op7_best_fit_packing, op8_html_extraction, op9_token_counts, op10_mixing, op11_hard_negatives, op12_prefix_trie, op13_simhash)}

NEGATIVES_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as (
  select a.vec_id as anchor_id, a.label, a.v, b.vec_id as positive_id, list_dot_product(a.v, b.v)::bigint as positive_score
  from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0
  qualify row_number() over (partition by a.vec_id order by list_dot_product(a.v, b.v) desc, b.vec_id) <= 5
),
s as (
  select a.vec_id as anchor_id, b.vec_id as negative_id, list_dot_product(a.v, b.v)::bigint as negative_score
  from e a join e b on a.label <> b.label
  where a.vec_id % 100 = 0
)
select anchor_id, positive_id, negative_id, positive_score, negative_score,
  (row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id))::int as rank
from p join s using (anchor_id)
where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 10
"""

TRIE_SQL = """
with o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  where conv_id is not null
),
h as (
  select distinct conv_id, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 as h
  from o
),
r as (
  select c.conv_id, o.pos, o.role, o.text from h c join o on o.conv_id = c.conv_id - c.conv_id % 5 and o.pos <= c.h
  union all
  select c.conv_id, o.pos, o.role, o.text from h c join o on o.conv_id = c.conv_id and o.pos > c.h
),
q as (select conv_id, list({'r': role, 't': text} order by pos) as turns from r group by conv_id),
c as (select conv_id, coalesce(turns, []) as turns from h left join q using (conv_id)),
m as (select conv_id, d, list_slice(turns, 1, d) as key, len(turns) = d as ends from c, unnest(range(len(turns) + 1)) u(d)),
n as (
  select key, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256,
    (count(*) - 1) * coalesce(strlen(key[d].t), 0) as saved
  from m group by key, d
),
k as (select list_slice(key, 1, d - 1) as key, count(*) as n_children from n where d > 0 group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (key)),
s as (select list_slice(f.key, 1, u.a) as key, sum(saved) as saved_tokens, sum((n_children = 0)::int) as n_leaves from f, unnest(range(f.d + 1)) u(a) group by 1)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, f.ends_sha256
from f join s using (key) left join n up on f.d > 0 and up.key = list_slice(f.key, 1, f.d - 1)
"""
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": NEGATIVES_SQL, "op12_prefix_trie": TRIE_SQL}
