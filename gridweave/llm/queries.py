"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import align, bpe, chunks, decontam, langid, mixing, negatives, ring, secrets, simhash, sketch, toxicity, warc
from gridweave.llm.common import cut, scratch, table, train_share

SHARDS = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
THRESHOLD = 0.3


def tokenizer(spark: SparkSession, name: str = VOCABULARY) -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    # The table has no capture times; a second for each id stands in.
    captured = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    warc.write_archives(pages, path, captured=captured)
    history = warc.merge_index(warc.read_archives(spark, path))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = train_share(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict(model, "text", spark).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketch.neighbours(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", sketch.as_text(own).alias("fingerprint"), sketch.as_text(edited).alias("edited_fingerprint"),
        sketch.resemblance(own, edited).alias("near_edited"), sketch.resemblance(own, following).alias("near_next"),
    )


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.digest(F.col("items")).alias("items_sha256"), "contaminated")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = train_share(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, "text", spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer(spark))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pair = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.alignment_digests(table(spark, sf_dir, "documents"), pair)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_simhash, op3_ring, op4_langid, op5_chunks, op6_sketch, op7_decontam, op8_toxicity, op9_bpe, op10_secrets, op11_negatives, op12_mixing, op13_align, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
               case when first <> page_id then first end as refers_to
        from p left join f using (payload_digest)""",
    "op7_decontam": r"""
        with word as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        item as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(10, len(w)) as size, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as key
                from (select item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from item where len(w) > 0)),
        sizes as (select distinct size from win),
        place as (select doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') as key
                  from (select doc_id, w, size, unnest(range(0, greatest(0, len(w) - size + 1))) as i from word, sizes)),
        hit as (select doc_id, item_id, i, size from place join win using (size, key)),
        covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + size)) as pos from hit) group by 1),
        items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit) group by 1)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from word left join covered using (doc_id) left join items using (doc_id)""",
    "op11_negatives": """
        with e as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          [floor(256 * x::double) for x in embedding] as v
                   from embeddings where vec_id is not null and label is not null and embedding is not null
                   and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        pair as (select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
                 from e a join e b on a.r <> b.r where a.vec_id % 100 = 0),
        pos as (select *, row_number() over (partition by r order by score desc, vec_id) as w from pair where same qualify w <= 5)
        select pos.anchor_id, pos.vec_id as positive_id,
               row_number() over (partition by pos.r, pos.w order by neg.score desc, neg.vec_id)::int as rank, neg.vec_id as negative_id,
               pos.score as positive_score, neg.score as negative_score
        from pos join pair neg on pos.r = neg.r and not neg.same and 80 * pos.score <= 100 * neg.score and neg.score <= pos.score
        qualify rank <= 5""",
}
