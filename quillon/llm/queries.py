"""The queries opN_ of __spark_entry__.py: thin, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, mixing, quality_rules, ranking, simhash, substring_dedup, suffix_dedup, warc
from .common import scratch_path, table


#: Words of a passage that op9 reports where it repeats.
PASSAGE = 50


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels).drop("text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return out.select(
        "doc_id",
        "n_pieces",
        F.size("found").cast("long").alias("n_found"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licenses"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = ranking.classify(docs, labels.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, passage=PASSAGE)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # passages may have fewer than 400 bytes: they are reported, not removed
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("passage_bytes"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path).where("gap_length is null")
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_mixing, op4_bpe, op5_nearest, op6_simhash, op7_license_scan, op8_quality_classifier, op9_suffix_dedup, op10_warc)}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        p as (select doc_id, i, array_to_string(ws[i : i + 49], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
        f as (select k, min(doc_id) as f from p group by k having count(distinct doc_id) > 1),
        gone as (select distinct doc_id, i + j as i from (select p.doc_id, p.i from p join f using (k) where f < doc_id), (select unnest(range(0, 50)) as j)),
        words as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as i from w),
        left_ as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from w left join left_ using (doc_id)
    """,
    "op3_mixing": mixing.ORACLE,
    "op5_nearest": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        p as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
    """,
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as payload_bytes from pages),
        q as (select *, sha256(h) as payload_digest, min(page_id) over (partition by h) as f from p)
        select page_id, payload_bytes, payload_digest,
          case when payload_bytes >= 100 and page_id > f then 'revisit' else 'response' end as record_type,
          case when payload_bytes >= 100 and page_id > f then f end as refers_to
        from q
    """,
}
