"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.classifier import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.bpe import encode

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.substring import substring_dedup

    return substring_dedup(documents(spark, sf_dir), digest=True).drop("factors", "straddling")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.rules import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import find_pii

    return find_pii(documents(spark, sf_dir)).drop("candidates")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.language import identify

    return identify(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.near import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.secrets import find_secrets

    return find_secrets(documents(spark, sf_dir)).drop("candidates")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_substring_dedup, op4_exact_dedup, op5_quality_rules, op6_pii, op7_language_id, op8_ngram_jaccard, op9_mixing, op10_secrets)}

ORACLE_SQL = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, s, list_slice(ws, s, s + 12) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
        f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, s + o AS p FROM (SELECT g.doc_id, g.s, unnest(range(0, 13)) AS o FROM g JOIN f USING (k) WHERE first < g.doc_id)),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
        kept AS (SELECT w.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS rest FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN list_slice(ws, s, s + 4) ELSE ws END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.r = l.a),
        least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id), direct AS (SELECT a, count(*) AS c FROM l GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, 0)::BIGINT AS n_similar, component_id FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN direct ON d.doc_id = direct.a
    """,
    # large documents first, the rest at the rate that is left; places by the size's length and ten more bits, then by content
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '-') || ',' || sha256(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
        w AS (SELECT source, source_size, k, (k % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
        f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS water
            FROM w WINDOW up AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(water, (cap / weight, k)) FILTER (cap >= water * weight) AS level FROM f),
        g AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least(least(cap, level * weight) / source_size, 3.0) ELSE 0 END AS rate,
            ('0x' || substr(sha256('17,' || coalesce('=' || source, '-')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS o FROM w, l),
        p AS (SELECT doc_id, d.source, size, h, size > 0.03::DOUBLE * target AS large, length(bin(size)) - 1 AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        r AS (SELECT *, row_number() OVER (PARTITION BY source, large ORDER BY n DESC, ((size << 10) >> n) & 1023 DESC, h, size DESC, doc_id) - 1 AS k FROM p),
        a AS (SELECT r.*, source_size, target, o, CASE WHEN size = 0 THEN 0 ELSE least(floor(rate) + floor(o + (rate - floor(rate)) * (k + 1)) - floor(o + (rate - floor(rate)) * k), 3) END AS c, rate FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
        b AS (SELECT source, coalesce(sum(size * c) FILTER (large), 0) AS got, coalesce(sum(size) FILTER (NOT large), 0) AS rest FROM a GROUP BY source),
        e AS (SELECT a.*, CASE WHEN rest > 0 THEN least(greatest((target - got) / rest, 0.0), 3.0) ELSE 0 END AS other FROM a JOIN b ON a.source IS NOT DISTINCT FROM b.source),
        t AS (SELECT *, CASE WHEN large THEN c WHEN size = 0 THEN 0 ELSE least(floor(other) + floor(o + (other - floor(other)) * (k + 1)) - floor(o + (other - floor(other)) * k), 3) END AS n_copies FROM e)
        SELECT doc_id, size, source_size, target, n_copies::INT AS copies, (size * n_copies)::BIGINT AS taken FROM t
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
