"""The queries of the operators, with production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontam, divergence, langid, lexical, licenses, ngram_join, pieces, quality_zstd, secrets, sharding, urlfilter
from .common import held_out

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_model(documents: DataFrame, labels: DataFrame) -> quality_zstd.ZstdQuality:
    """Learned from labelled rows that aren't held out."""
    return quality_zstd.fit(documents, labels.filter(~held_out()))


def op1_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_model(documents, table(spark, sf_dir, "labels"))
    scored = quality_zstd.score(documents.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(~held_out()), langid.pieces_of(PIECES))
    found = langid.predict(documents.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it; documents without leak have none."""
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance", "leak.start")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.report(damaged, "conv", copies=F.col("copies")).withColumnRenamed("conv", "conv_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), pieces.load_model(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_zstd, op2_secret_scan, op3_license_scan, op4_bpe, op5_divergence, op6_sharding, op7_langid, op8_url_filter, op9_decontamination, op10_ngram_join,
        op11_conversation_repair, op12_lexical_search, op13_sentencepiece,
    )
    return {f.__name__: f for f in found}


def sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secrets_sql(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    """Lists of what stands between the matches, and of the matches, give the places; one row for each match."""
    parts = []
    for n, r in enumerate(rules):
        p = sql_string(r.pattern)
        parts.append(
            f"""SELECT row_no, {n} AS kind_no, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
              list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS start,
              length(found[k]) AS size, length(held[k]) >= {r.least} AS ok
            FROM (SELECT row_no, gaps, found, held, unnest(range(1, len(found) + 1)) AS k FROM (
              SELECT row_no, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {r.group}) AS held FROM docs WHERE regexp_matches(t, {p})))"""
        )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    named AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS s FROM spans WHERE ok),
    found AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(s, ',' ORDER BY start, kind_no) FILTER (base) AS base, string_agg(s, ',' ORDER BY start, kind_no) AS spans FROM named GROUP BY row_no)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN found USING (row_no)"""


def licenses_sql(threshold: float = licenses.THRESHOLD) -> str:
    """All units against all templates, without the bounds."""
    rows = ", ".join(f"({sql_string(n)}, [{', '.join(map(sql_string, licenses.template_bigrams(t)))}])" for n, t in sorted(licenses.TEMPLATES.items()))
    return f"""
    WITH templates(license, tb) AS (VALUES {rows}),
    units AS (
      SELECT doc_id, unnest(string_split(text, chr(10)) || list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10)))) AS unit FROM documents),
    split AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units),
    bi AS (SELECT doc_id, CASE WHEN len(w) <= 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS b FROM split WHERE len(w) BETWEEN 1 AND 200),
    pairs AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS d FROM bi, templates)
    SELECT doc_id, license, round(max(d), 6) AS dice, count(*) AS n_units FROM pairs WHERE d >= {threshold} GROUP BY doc_id, license"""


def url_filter_sql() -> str:
    rows = ", ".join(f"({', '.join(map(sql_string, r))})" for r in urlfilter.RULES)
    return f"""
    WITH rules(rh, rp, rv) AS (VALUES {rows}),
    cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    parts AS (SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    best AS (SELECT n, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
      FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)"""


def lexical_sql(k: int = 10) -> str:
    """All documents with a term of an item, scored without an index."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT d, doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
    whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
    norms AS (SELECT d, doc_id, 100 - {lexical.SLOPE} + ({lexical.SLOPE} * n * nn) // ll AS m FROM sizes, whole),
    counts AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM docs) GROUP BY d, t),
    weights AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY t, nn),
    items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({terms}) AS ts FROM benchmark WHERE text IS NOT NULL),
    asked AS (SELECT i, item_id, unnest(ts) AS t FROM items),
    scored AS (SELECT i, item_id, d, doc_id, CAST(sum(w * (({lexical.SCALE} * tf) // (1000 * tf + {lexical.K} * m))) AS BIGINT) AS score
      FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN norms USING (d) GROUP BY i, item_id, d, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
    SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets_sql(), "op3_license_scan": licenses_sql(), "op8_url_filter": url_filter_sql(), "op12_lexical_search": lexical_sql()}
