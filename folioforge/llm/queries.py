"""The registered queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, language_id, licenses, line_quality, packing, quality_model, secrets, sentence_pieces, simhash_dedup, surrogates, token_counts, vector_codes
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, verdict and a digest of the cleaned text."""
    judged = line_quality.line_quality(table(spark, sf_dir, "documents"))
    return judged.withColumn("cleaned_md5", F.md5(F.col("cleaned").cast("binary"))).drop("cleaned")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.find_and_replace(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, token_counts.revise)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text that they decode to."""
    told = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return told.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_language_id, op3_pii_surrogates, op4_license_scan, op5_quality_classifier, op6_packing,
        op7_secret_scan, op8_token_counts, op9_simhash_dedup, op10_decontamination, op11_centroid_clustering, op12_sentence_pieces,
        op13_vector_codes,
    )
}

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _clustering_sql(rounds: int = 3, k: int = 16) -> str:
    """Lloyd's rounds over all vectors, one by one, without grouping equal ones."""
    out = [f"kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings where len(embedding) = 64 and {_FINITE})"]
    out.append(f"c0 as materialized (select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), q) - 1 as c, q from kept qualify c < {k})")
    assigned = "select v.vec_id, v.q, arg_min(c.c, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q), c.c)) as c, min(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)) as d from kept v cross join c{} c group by v.vec_id, v.q"
    for r in range(rounds):
        out.append(f"a{r} as materialized ({assigned.format(r)})")
        out.append(f"m{r} as (select c, list(v order by i) as q from (select c, i, floor(sum(x) / count(*)) as v from (select c, unnest(q) as x, unnest(range(64)) as i from a{r}) group by c, i) group by c)")
        out.append(f"c{r + 1} as materialized (select c.c, coalesce(m.q, c.q) as q from c{r} c left join m{r} m on m.c = c.c)")
    out.append(f"z as materialized ({assigned.format(rounds)})")
    said = "sha256(array_to_string(list_transform(k.q, lambda x: cast(x as bigint)), ','))"
    return f"with {', '.join(out)} select vec_id, cast(z.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by z.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, {said} as centroid_sha256 from z join c{rounds} k on k.c = z.c"


def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """The nearest of all entries, without a tree."""
    out = [f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as q from embeddings where len(embedding) > 0 and {_FINITE})"]
    out.append("parts as materialized (select vec_id, label, p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] as q from kept, range(4) t(p))")
    out.append(f"c0 as materialized (select row_number() over (partition by p order by vec_id, q) - 1 as e, p, q from parts qualify e < {entries})")
    assigned = "select v.vec_id, v.label, v.p, v.q, arg_min(c.e, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q), c.e)) as e, min(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)) as d from parts v join c{} c on c.p = v.p group by v.vec_id, v.label, v.p, v.q"
    for r in range(rounds):
        out.append(f"a{r} as materialized ({assigned.format(r)})")
        out.append(f"m{r} as (select p, e, list(v order by i) as q from (select p, e, i, floor(sum(x) / count(*)) as v from (select p, e, unnest(q) as x, unnest(range(len(q))) as i from a{r}) group by p, e, i) group by p, e)")
        out.append(f"c{r + 1} as materialized (select c.p, c.e, coalesce(m.q, c.q) as q from c{r} c left join m{r} m on m.p = c.p and m.e = c.e)")
    out.append(f"z as materialized ({assigned.format(rounds)})")
    out.append("s as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from z group by vec_id, label)")
    said = f"(select sha256(string_agg(array_to_string(list_transform(q, lambda x: cast(x as bigint)), ','), ',' order by p, e)) from c{rounds})"
    return f"with {', '.join(out)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, {said} as codebooks_sha256 from s"


#: The other queries have none: SQL can't express them.
ORACLES: dict[str, str] = {"op11_centroid_clustering": _clustering_sql(), "op13_vector_codes": _codes_sql()}
