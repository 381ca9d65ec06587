"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import balance, bpe, exact_dedup, fingerprint, infill, langid, mixing, negatives, ngram_join, packing, pii, secrets, spans, substring_dedup
from tallyforge.storage import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted once, and no text goes further
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    rows = Scratch(spark, "mix").table(mixing.numbered(docs), "sizes")
    # rows draw by id, text and their number among equal rows, so missing and repeated ids share no draw
    drawn = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex("digest")), F.col("copy").cast("string"))
    mixed = mixing.mix(rows, size="size", key=drawn)
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), n=3, num=90, den=100)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("n_chars")


def op5_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # a token stands for two bytes of text at the least in the long run, so a shard's share is bounded
    shards = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * packing.SHARD) + 1
    rows = packing.pack(bpe.encode(docs, *byte_bpe()), length=2048, shards=shards)
    return rows.select("shard", "row", "n_tokens", "n_segments", "doc_ids", "offsets", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs))
    return found.select("doc_id", *spans.digest_columns("spans", secrets.KINDS))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(documents(spark, sf_dir), *byte_bpe(), decode=True)
    return ids.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select("doc_id", *spans.digest_columns("spans", pii.KINDS))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir))
    digests = (F.sha2(F.col(x).cast("binary"), 256).alias(f"{x}_sha256") for x in ("output", "restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = balance.pack_balanced(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", turned.alias("label")), anchor=F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_fingerprints, op3_ngram_join, op4_exact_dedup, op5_packed_tokens, op6_secret_scan, op7_language_id, op8_substring_dedup,
        op9_byte_bpe, op10_pii, op11_fill_in_middle, op12_balanced_packing, op13_hard_negatives,
    )
}

SQL = {
    "op1_mix_sources": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':' || row_number() over (partition by doc_id, source, coalesce(text, '')) as drawn from documents),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as rank
  from sized group by source),
weighted as (select source, source_size, ((rank - 1) % 3 + 1)::double as w, source_size * 3.0::double as most from per),
ranked as (
  select *, row_number() over (order by source_size / w, source asc nulls last) as k,
    coalesce(sum(source_size) over (order by source_size / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by source_size / w, source asc nulls last rows between current row and unbounded following) as w_left,
    sum(source_size) over () as total
  from weighted),
levels as (select *, ((total - before * 3.0::double)::double / w_left) as level from ranked),
first_free as (select arg_min(level, k) as level from levels where most > level * w),
targets as (
  select source, source_size, case when most <= l.level * w then most else w * f.level end as target
  from levels l left join first_free f on true),
rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('7:' || drawn), 1, 13))::bigint::double / 4503599627370496.0 as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
""",
    "op4_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, ''))::bigint as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as plain from documents),
g as (
  select doc_id, n_chars, sha256(plain) as text_sha256,
    first_value(doc_id) over w as keep_id, first_value(n_chars) over w as keep_chars, count(*) over (partition by plain)::bigint as group_size
  from d window w as (partition by plain order by n_chars desc, doc_id asc nulls last rows between unbounded preceding and unbounded following))
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id and n_chars = keep_chars) as kept, text_sha256 from g
""",
    "op11_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
n as (
  select doc_id, t, u, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form from n),
p as (
  select *, coalesce(array_to_string(u[1:lo], ''), '') as pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') as mid,
    coalesce(array_to_string(u[hi + 1:n], ''), '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from p
""",
    "op13_hard_negatives": r"""
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
m as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from m where rank <= 3
""",
}
