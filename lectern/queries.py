"""Registered queries over the tables, and the same in DuckDB's SQL.

The SQL tokenises with windows where the plans use patterns inside the row, so that equal results mean something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import golden
from lectern.config import Config
from lectern.fixtures import PARSED, PARSED_FINDINGS, PARSED_STATISTICS, RATINGS, TEXTS
from lectern.functions import text as T
from lectern.functions.tables import ADDITIVE, CONNECTORS, TEMPORAL, lexicon, phrases
from lectern.operators import patterns as P
from lectern.operators import profile as profiles
from lectern.operators.markup import blank_markup
from lectern.operators.parsed import STATISTICS
from lectern.operators.parsed import TOKENS as PARSE
from lectern.operators.postpass import unsettled
from lectern.operators.registry import ENTRIES
from lectern.operators.registry import rules as catalogue
from lectern.operators.stats import document_stats, measure, with_vocabulary
from lectern.plans import lint
from lectern.sources.documents import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents, as the rules are English; the filter and two columns reach the scan."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


WORDS_RX, COVER_RX = q(T.WORDS), q(T.COVER)
TOKENS = f"""
docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
tok AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, {COVER_RX}) AS ts FROM docs)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM docs),
orient AS (SELECT doc_id, count(*) FILTER (regexp_matches(x, '[^ \\t\\r\\f\\x0b]')) AS n, count(*) FILTER (regexp_matches(x, {q('[.!?:;…]' + T.CLOSERS + '*[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0b]*$')})) AS ended FROM lines GROUP BY doc_id),
kind AS (SELECT tok.*, n >= 5 AND ended * 5 >= n * 4 AS by_line, regexp_full_match(t, '[ \\t\\n\\r\\f\\x0b]+') AS sp, regexp_full_match(t, {q(T.CLOSERS)}) AS closer, regexp_full_match(t, {WORDS_RX}) AS word, len(t) - len(replace(t, chr(10), '')) AS nl,
         sum(len(t)) OVER (PARTITION BY doc_id ORDER BY i) - len(t) AS start FROM tok JOIN orient USING (doc_id)),
near AS (SELECT *, lag(sp) OVER w AS psp, lag(nl) OVER w AS pnl, lag(i) OVER w IS NULL AS head, lag(t, 2) OVER w AS p2,
         last_value(CASE WHEN NOT closer THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS core FROM kind WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
opened AS (SELECT *, NOT sp AND (head OR coalesce(psp, FALSE) AND (p2 IS NULL OR pnl >= 2 OR pnl >= 1 AND (by_line OR t IN ('-', '*', '•', '+')) OR coalesce(core, '') IN ('.', '!', '?', '…'))) AS opens FROM near),
sents AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sent FROM opened),
per_sent AS (SELECT doc_id, sent, min(start) FILTER (NOT sp) AS start, count(*) FILTER (word) AS words, coalesce(sum(len(regexp_replace(t, '[^A-Za-z0-9_]', '', 'g'))) FILTER (word), 0) AS letters FROM sents WHERE sent > 0 GROUP BY doc_id, sent),
per_doc AS (SELECT doc_id, count(*) AS n_sentences, sum(words)::BIGINT AS n_words, sum(letters)::BIGINT AS n_letters, count(*) FILTER (words > 0) AS ln, coalesce(sum(words) FILTER (words > 0), 0)::DOUBLE AS ls, coalesce(sum(words * words) FILTER (words > 0), 0)::DOUBLE AS lq FROM per_sent GROUP BY doc_id)
"""


def grade_sql(letters: str, words: str, sentences: str) -> str:
    return f"CASE WHEN {words} > 0 AND {sentences} > 0 THEN greatest(floor(CAST({letters} AS DOUBLE) / {words} * CAST(4.71 AS DOUBLE) + CAST({words} AS DOUBLE) / {sentences} * CAST(0.5 AS DOUBLE) - CAST(21.43 AS DOUBLE) + CAST(0.5 AS DOUBLE)), 0)::INT ELSE 0 END"


def cv_sql(n: str, s: str, sq: str) -> str:
    return f"CASE WHEN {n} >= 2 AND {s} > 0 THEN sqrt({n}::DOUBLE * {sq} - {s} * {s}) / {s} ELSE 0.0 END"


@query(f"""WITH {TOKENS}, graded AS (SELECT docs.doc_id, coalesce(n_sentences, 0)::INT AS n_sentences, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_letters, 0)::BIGINT AS n_letters, {grade_sql('n_letters', 'n_words', 'n_sentences')} AS grade FROM docs LEFT JOIN per_doc USING (doc_id))
SELECT *, CASE WHEN n_words < 14 OR grade < 10 THEN 'normal' WHEN grade < 14 THEN 'hard' ELSE 'veryHard' END AS readability FROM graded""")
def doc_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(english(spark, sf_dir)).select("doc_id", "n_sentences", "n_words", "n_letters", "grade", "readability")


@query(f"""WITH {TOKENS}, g AS (SELECT *, {grade_sql('letters', 'words', '1')} AS grade FROM per_sent WHERE words >= 14)
SELECT doc_id, start::INT AS start, words::INT AS words, grade, CASE WHEN grade >= 14 THEN 'NB201' ELSE 'NB202' END AS code FROM g WHERE grade >= 10""")
def hard_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measure(english(spark, sf_dir)).select("doc_id", F.inline_outer("sentences"))
    grade = T.reading_grade(F.col("letters"), F.col("words"), F.lit(1))
    return rows.where("words >= 14").withColumn("grade", grade).where("grade >= 10").select("doc_id", "start", "words", "grade", F.when(F.col("grade") >= 14, "NB201").otherwise("NB202").alias("code"))


@query(f"""WITH {TOKENS}, cut AS (SELECT *, sum(CASE WHEN t IN (',', ';', ':', '—', '–', '--', '(', ')') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent ORDER BY i) AS seg FROM sents WHERE sent > 0),
runs AS (SELECT doc_id, sent, seg, count(*) FILTER (word) AS n FROM cut GROUP BY ALL), segs AS (SELECT doc_id, count(*) AS gn, sum(n)::DOUBLE AS gs, sum(n * n)::DOUBLE AS gq FROM runs WHERE n > 0 GROUP BY doc_id)
SELECT docs.doc_id, coalesce({cv_sql('ln', 'ls', 'lq')}, 0.0) AS burstiness, coalesce({cv_sql('gn', 'gs', 'gq')}, 0.0) AS seg_burstiness FROM docs LEFT JOIN per_doc USING (doc_id) LEFT JOIN segs USING (doc_id)""")
def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(english(spark, sf_dir)).select("doc_id", "burstiness", "seg_burstiness")


@query(f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), a AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, {q(T.WORD)}), lambda x: regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)) AS ts FROM docs),
tok AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS p, len(ts) AS n FROM a), win AS (SELECT *, count(DISTINCT w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS d FROM tok),
m AS (SELECT doc_id, CASE WHEN max(n) < 100 THEN count(DISTINCT w)::DOUBLE / max(n) ELSE (sum(d) FILTER (p >= 100))::DOUBLE / 100.0::DOUBLE / (max(n) - 99)::DOUBLE END AS mattr, count(*) FILTER (w IN {values(TEMPORAL)}) AS t, count(*) FILTER (w IN {values(ADDITIVE)}) AS b FROM win GROUP BY doc_id)
SELECT docs.doc_id, coalesce(mattr, 0.0) AS mattr, CASE WHEN t + b > 0 THEN t::DOUBLE / (t + b) ELSE 0.0 END AS temporal_ratio FROM docs LEFT JOIN m USING (doc_id)""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_vocabulary(english(spark, sf_dir)).select("doc_id", "mattr", "temporal_ratio")


@query(f"""WITH {TOKENS}, solid AS (SELECT doc_id, t, lower(t) AS w, start, regexp_full_match(t, '\\p{{L}}+') AS alpha, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM kind WHERE NOT sp),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (SELECT *, CASE WHEN alpha AND w = lag(w) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM solid))
SELECT doc_id, min(start)::INT AS start, max(start + len(t))::INT AS "end", min(w) AS word FROM runs WHERE alpha GROUP BY doc_id, run HAVING count(*) = 2 AND min(w) NOT IN ('had', 'that')""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english(spark, sf_dir).select("doc_id", F.inline_outer(unsettled(F.col("text"), ("NB306",)))).where("code is not null").select("doc_id", "start", "end", F.lower("suggestion").alias("word"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(P.CLASSIC_WORD)})) AS x FROM documents WHERE lang = 'en')
SELECT doc_id, lower(x) AS word, count(*) AS n FROM w WHERE lower(x) LIKE '%ly' AND len(x) > 3 AND lower(x) NOT IN {values(phrases("adverb_exception"))} GROUP BY ALL""")
def adverbs_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = english(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.CLASSIC_WORD), F.lit(0))).alias("x"))
    low = F.lower("x")
    return words.where(low.endswith("ly") & (F.length("x") > 3) & ~low.isin(*phrases("adverb_exception"))).groupBy("doc_id", low.alias("word")).agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)[ \\t\\n\\r\\f\\x0b](?:is|are|was|were|being|been|be)[ \\t\\n\\r\\f\\x0b]{{2}}[a-z]{{2,30}}(?:[^\\p{{L}}\\p{{N}}_]|$)')) AS x FROM documents WHERE lang = 'en'),
w AS (SELECT doc_id, lower(regexp_extract(x, '(?i)^[ \\t\\n\\r\\f\\x0b][a-z]+[ \\t\\n\\r\\f\\x0b]{{2}}([a-z]+)', 1)) AS word FROM m) SELECT doc_id, word, count(*) AS n FROM w WHERE word LIKE '%ed' OR word IN {values(phrases("participle"))} GROUP BY ALL""")
def passives_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = english(spark, sf_dir).select("doc_id", F.inline_outer(unsettled(F.col("text"), ("NB302",)))).where("code is not null")
    return rows.groupBy("doc_id", F.lower(F.regexp_extract("text", rf"(?i)\A[a-z]+{P.S}([a-z]+)", 1)).alias("word")).agg(F.count("*").alias("n"))


@query(f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), p AS (SELECT unnest([{", ".join(q(w) for w in phrases("complex"))}]) AS phrase),
w AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), {COVER_RX}) AS ts FROM docs)),
g AS (SELECT doc_id, unnest([t, t || t1 || t2, t || t1 || t2 || t3 || t4, t || t1 || t2 || t3 || t4 || t5 || t6]) AS x FROM (SELECT doc_id, t, lead(t, 1) OVER v AS t1, lead(t, 2) OVER v AS t2, lead(t, 3) OVER v AS t3, lead(t, 4) OVER v AS t4, lead(t, 5) OVER v AS t5, lead(t, 6) OVER v AS t6 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)))
SELECT doc_id, phrase, count(*) AS n FROM g JOIN p ON x = phrase GROUP BY ALL""")
def complex_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.lexicon import hits

    rows = english(spark, sf_dir).select("doc_id", F.explode(hits(F.col("text"), ("complex",))).alias("h"))
    return rows.groupBy("doc_id", F.col("h.phrase").alias("phrase")).agg(F.count("*").alias("n"))


@query(f"""WITH docs AS (SELECT doc_id, text FROM documents), p AS (SELECT doc_id, unnest(regexp_split_to_array(text, {q(T.PARAGRAPH_BREAK)})) AS x FROM docs)
SELECT doc_id, count(*)::INT AS n_paragraphs, sum(len(x))::BIGINT AS n_chars, max(len(x))::INT AS longest FROM p WHERE len(x) > 0 GROUP BY doc_id""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    size = F.transform("p", lambda p: p["end"] - p["start"])
    return df.where(F.size("p") > 0).select("doc_id", F.size("p").alias("n_paragraphs"), T.total(size).alias("n_chars"), F.array_max(size).alias("longest"))


@query("""WITH b AS (SELECT page_id, html, regexp_replace(html, '(?is)<script(?:[^\\p{L}\\p{N}_>][^>]*)?>.*?</script>|<style(?:[^\\p{L}\\p{N}_>][^>]*)?>.*?</style>|<!--.*?-->', ' ', 'g') AS x FROM pages), c AS (SELECT *, regexp_replace(x, '</?[a-zA-Z][^>]*>', ' ', 'g') AS y FROM b)
SELECT page_id, len(html)::INT AS n_chars, len(regexp_replace(y, '[ \\t\\n\\r\\f\\x0b]', '', 'g'))::INT AS n_shown, len(regexp_extract_all(x, '</?[a-zA-Z][^>]*>'))::INT AS n_tags, len(regexp_extract_all(html, '(?i)<img(?:[^\\p{L}\\p{N}_>][^>]*)?>'))::INT AS n_images FROM c""")
def html_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = blank_markup(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "html", "html")
    tag = F.size(F.filter("_marks", lambda m: (m["kind"] == "html") & F.substring("html", m["start"] + 1, m["end"] - m["start"]).rlike(r"\A</?[a-zA-Z][^>]*>\z")))
    shown = F.length(F.regexp_replace("_analysis", "[ \\t\\n\\r\\f\\x0b]", ""))
    return df.select("page_id", F.length("_analysis").alias("n_chars"), shown.alias("n_shown"), tag.alias("n_tags"), F.size(F.filter("_marks", lambda m: m["kind"] == "image")).alias("n_images"))


@query(f"""WITH {TOKENS}, first AS (SELECT doc_id, sent, t, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS k FROM sents WHERE sent > 0 AND word), o AS (SELECT doc_id, sent, lower(t) AS w FROM first WHERE k = 1),
runs AS (SELECT s.doc_id, s.sent, o.w, s.sent - row_number() OVER (PARTITION BY s.doc_id, o.w ORDER BY s.sent) AS run FROM per_sent s JOIN o ON s.doc_id = o.doc_id AND s.sent = o.sent)
SELECT doc_id, w AS word, count(*)::INT AS n, min(sent)::INT AS first_sentence FROM runs GROUP BY doc_id, w, run HAVING count(*) >= 3""")
def opener_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure(english(spark, sf_dir)).withColumn("found", unsettled(F.col("text"), ("NB512",)))
    before = lambda f: (F.size(F.filter("sentences", lambda s: s["start"] < f["start"])) + 1).cast("int")
    during = lambda f: F.size(F.filter("sentences", lambda s: (s["start"] >= f["start"]) & (s["start"] < f["end"])))
    word = lambda f: F.regexp_extract(f["message"], "'(.*)'", 1)
    found = F.transform("found", lambda f: F.struct(word(f).alias("word"), during(f).alias("n"), before(f).alias("first_sentence")))
    return df.select("doc_id", F.inline_outer(found)).where("word is not null")


# -- profiles: the corpus by source, as if each were an author


def by_source(spark: SparkSession, sf_dir: str, *reads: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "source", "text")
    return profiles.prepare(df, "text", F.col("source"), "doc_id", reads)


SOURCES = "srcs AS (SELECT doc_id, source FROM documents WHERE lang = 'en')"


@query(f"""WITH {TOKENS}, {SOURCES} SELECT source AS author, lower(t) AS word, count(*) AS n FROM kind JOIN srcs USING (doc_id) WHERE word AND lower(t) IN {values(profiles.FUNCTION_WORDS)} GROUP BY ALL""")
def profile_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.function_counts(by_source(spark, sf_dir, "places")).select("author", "word", "n")


@query(f"""WITH {TOKENS}, {SOURCES}, first AS (SELECT doc_id, sent, t, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS k FROM sents WHERE sent > 0 AND word) SELECT source AS author, lower(t) AS word, count(*) AS n FROM first JOIN srcs USING (doc_id) WHERE k = 1 GROUP BY ALL""")
def profile_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.opener_counts(by_source(spark, sf_dir, "openings")).select("author", "word", "n")


CASES = " ".join(f"WHEN one = {q(c)} OR two = {q(c)} THEN {q(c)}" for c in CONNECTORS)


@query(f"""WITH {TOKENS}, {SOURCES}, first AS (SELECT doc_id, sent, lower(t) AS one, lower(t || coalesce(' ' || lead(t) OVER (PARTITION BY doc_id, sent ORDER BY i), '')) AS two, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS k FROM sents WHERE sent > 0 AND word),
c AS (SELECT doc_id, CASE {CASES} END AS word FROM first WHERE k = 1) SELECT source AS author, word, count(*) AS n FROM c JOIN srcs USING (doc_id) WHERE word IS NOT NULL GROUP BY ALL""")
def profile_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.opener_counts(by_source(spark, sf_dir, "connectors"), connectors=True).select("author", "word", "n")


@query(f"""WITH {TOKENS}, {SOURCES}, w AS (SELECT source AS author, lower(t) AS word, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS k, count(*) OVER (PARTITION BY source) AS total FROM kind JOIN srcs USING (doc_id) WHERE word),
b AS (SELECT author, word, k // 1000 AS block, least(1000, total - (k // 1000) * 1000) AS size FROM w WHERE word IN {values(profiles.FUNCTION_WORDS)}) SELECT author, block::BIGINT AS block, word, count(*) * 1000.0::DOUBLE / size AS rate FROM b WHERE size >= 500 GROUP BY author, block, word, size""")
def profile_delta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.delta_blocks(by_source(spark, sf_dir, "n_tokens", "places"))


@query()
def profile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "source", "text")
    return profiles.build_profiles(df, author="source")


# -- whole runs


EVERYTHING = Config(extend_select=("NB5", "NB315"), backend="lexical")


def analyzed(spark: SparkSession, sf_dir: str, config: Config = EVERYTHING, all_stats: bool = False) -> DataFrame:
    return lint.analyze(english(spark, sf_dir), config, all_stats=all_stats)


@query()
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.findings(analyzed(spark, sf_dir))


@query()
def lint_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.statistics(analyzed(spark, sf_dir))


@query()
def lint_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.hotspots(analyzed(spark, sf_dir))


@query()
def lint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.score(analyzed(spark, sf_dir, all_stats=True))


@query()
def lint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.json_reports(analyzed(spark, sf_dir, all_stats=True))


@query()
def lint_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.report_lines(lint.findings(analyzed(spark, sf_dir)))


@query()
def lint_workflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.workflow_lines(lint.findings(analyzed(spark, sf_dir)))


@query()
def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = english(spark, sf_dir).withColumn("name", F.col("doc_id").cast("string"))
    return lint.documents_stats_lines(document_stats(df, target=EVERYTHING.target))


DOC_STATS = f"""SELECT g.doc_id, n_sentences, n_words, n_letters, grade, readability, burstiness, seg_burstiness, temporal_ratio, n_alpha, mattr, n_words / CAST(250.0 AS DOUBLE) * CAST(60.0 AS DOUBLE) AS reading_time_secs
FROM ({ORACLE_SQL["doc_grade"]}) g JOIN ({ORACLE_SQL["rhythm"]}) r USING (doc_id) JOIN ({ORACLE_SQL["vocabulary"]}) v USING (doc_id)
JOIN (SELECT doc_id, len(list_filter(regexp_extract_all(text, {q(T.WORD)}), lambda x: regexp_full_match(x, '\\p{{L}}+')))::INT AS n_alpha FROM documents WHERE lang = 'en') a USING (doc_id)"""


@query(DOC_STATS)
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_stats(english(spark, sf_dir))


@query()
def pages_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return lint.findings(lint.analyze(pages, Config(), text="html", kind="html", name="url", id="page_id"), id="page_id")


@query(f"""WITH docs AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, len(regexp_extract_all(text, {WORDS_RX}))::INT AS n_words, len(regexp_replace(array_to_string(regexp_extract_all(text, {WORDS_RX}), ' '), '[^A-Za-z0-9_]', '', 'g'))::INT AS n_letters FROM docs""")
def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return df.select("conv_id", "turn", F.regexp_count("text", F.lit(T.WORDS)).alias("n_words"), T.letters(F.col("text")).alias("n_letters"))


@query(f"""WITH r AS (SELECT unnest([{", ".join(f"{{'code': {q(e.code)}, 'name': {q(e.name)}, 'needs': {q(e.needs)}, 'default_on': {str(e.default).lower()}, 'mode': {q(e.mode)}}}" for e in ENTRIES.values())}]) AS s) SELECT s.code AS code, s.name AS name, s.needs AS needs, s.default_on AS default_on, s.mode AS mode FROM r""")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark)


@query()
def lexicon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark)


# -- the fixture texts


def fixture_findings(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(TEXTS, "doc_id bigint, kind string, text string").coalesce(1)
    out = None
    for kind in ("text", "markdown", "html"):
        found = lint.findings(lint.analyze(df.where(F.col("kind") == kind), EVERYTHING, kind=kind))
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", "code", "severity", "start", "end", "line", "col", "suggestion", "applicability")


def _golden() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in golden.FINDINGS)
    return f"""SELECT doc_id::BIGINT AS doc_id, code, severity, start::INT AS start, "end"::INT AS "end", line::INT AS line, col::INT AS col, suggestion, applicability FROM (VALUES {rows}) AS t(doc_id, code, severity, start, "end", line, col, suggestion, applicability)"""


@query(_golden() if golden.FINDINGS else None)
def fixture_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_findings(spark)


# -- fixtures: small texts of our own, and what they hold by the rules' definitions


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """Rows as SQL, with the columns named and typed as in a schema."""
    kinds = [c.strip().split(" ") for c in columns.split(",")]
    cell = lambda v, kind: f"CAST({'NULL' if v is None else q(v) if isinstance(v, str) else v} AS {kind})"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(v, k) for v, (_, k) in zip(r, kinds)) + ")" for r in rows) + f") AS t({', '.join(n for n, _ in kinds)})"


def fixture(name: str, columns: str, rows: list[tuple]):
    def add(f):
        f.__name__ = name
        return query(rows_sql(columns, rows))(f)

    return add


PARSE_CODES = ("NB203", "NB304", "NB305", "NB310", "NB314", "NB507", "NB518", "NB525", "NB526", "NB530", "NB601")


def parsed_fixtures(spark: SparkSession, kind: str) -> DataFrame:
    df = spark.createDataFrame(PARSED, f"doc_id bigint, kind string, text string, tokens {PARSE}").coalesce(1).where(F.col("kind") == kind)
    return lint.analyze(df, Config(select=PARSE_CODES, ratings=RATINGS), kind=kind, tokens="tokens")


@fixture("parsed_rules", "doc_id bigint, code varchar, severity varchar, start integer, end_ integer, suggestion varchar", PARSED_FINDINGS)
def parsed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [lint.findings(parsed_fixtures(spark, kind)) for kind in ("text", "markdown")]
    return both[0].unionByName(both[1]).select("doc_id", "code", "severity", "start", F.col("end").alias("end_"), "suggestion")


@fixture("parsed_statistics", "doc_id bigint, nominal_density double, pronoun_density double, paragraph_cohesion double, dependency_distance double, formality double, modifier_density double", PARSED_STATISTICS)
def parsed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.stats(parsed_fixtures(spark, "text")).where("doc_id IN (1, 2, 12)").select("doc_id", *STATISTICS)


FOUND = "doc_id bigint, code varchar, severity varchar, start integer, end_ integer"


def found(spark: SparkSession, texts: list[str], config: Config, kind: str = "text", name: str = "a") -> DataFrame:
    df = spark.createDataFrame([(i, t, name) for i, t in enumerate(texts, 1)], "doc_id bigint, text string, path string").coalesce(1)
    return lint.findings(lint.analyze(df, config, kind=kind, name="path", all_stats=True)).select("doc_id", "code", "severity", "start", F.col("end").alias("end_"))


@fixture("budget_regrade", FOUND, [(1, "NB401", "info", 3, 10), (1, "NB401", "info", 20, 27), *((2, "NB401", "warning", a, a + 7) for a in (3, 20, 36))])
def budget_regrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two findings of a code with a budget are within it in a short text, three are not."""
    return found(spark, ["We utilize it. They utilize it.", "We utilize it. They utilize it. You utilize it."], Config(select=("NB401",)))


@fixture("quoted_drop_fixture", FOUND, [(2, "NB401", "info", 0, 7), (3, "NB401", "info", 43, 50)])
def quoted_drop_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in a quotation of several words goes, and what is mentioned by itself; the rest stays."""
    return found(spark, ['He said "we utilize the tools" and left.', "Utilize it. He said no.", 'The word "utilize" is long, and so we must utilize it.'], Config(select=("NB401",)))


@fixture("suppressed_lines", FOUND, [(1, "NB401", "info", 40, 47), (2, "NB306", "warning", 0, 7), (3, "NB401", "info", 3, 10)])
def suppressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker suppresses the codes it names on its line, or all; other lines and codes stay."""
    return found(spark, ["We utilize it. lectern: ignore\nThere we utilize it.", "The the we utilize. lectern: ignore NB401", "We utilize it.\nlectern: ignore"], Config(select=("NB401", "NB306")))


@fixture("hidden_chars_fixture", FOUND, [(1, "NB317", "warning", 4, 5), (2, "NB317", "warning", 0, 3)])
def hidden_chars_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character of no width inside a word, and a look-alike between two letters of another alphabet."""
    return found(spark, ["zero\u200bwidth", "p\u0430ypal is plain"], Config(select=("NB317",)))


@fixture("image_alt_fixture", FOUND, [(1, "NB311", "info", 0, 12)])
def image_alt_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a description."""
    return found(spark, ["![](one.png) and ![a chart](two.png)"], Config(select=("NB311",)), "markdown")


@fixture("hotspots_topk", "doc_id bigint, rank integer, line integer, issues integer, weight double, density double", [(1, 1, 3, 3, 6.0, 24.0), (1, 2, 1, 1, 2.0, 8.0)])
def hotspots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of findings a hundred words of a paragraph, of which a short one counts as twenty-five."""
    text = "Again we utilize it here.\n\nWe utilize it. They utilize it. You utilize it.\n\nNothing is wrong with this one."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1)
    return lint.hotspots(lint.analyze(df, Config(select=("NB401",)))).select("doc_id", "rank", "line", "issues", "weight", "density")


@fixture("acronym_first_use", FOUND, [(1, "NB309", "info", 4, 7)])
def acronym_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first use of what nothing expands; an expansion in brackets does, and so does a name of the user's."""
    return found(spark, ["The QPX runs. The QPX stops. The Zed Red Unit (ZRU) waits. ZRU helps. XWV is known."], Config(select=("NB309",), norms=frozenset({"the"}), known_acronyms=("XWV",)))


@fixture("negation_contrast_fixture", FOUND, [(1, "NB501", "warning", 0, 20), (2, "NB501", "warning", 0, 17)])
def negation_contrast_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thing denied for another; a plain denial is none."""
    return found(spark, ["It's not a bug, it's a feature.", "Not only fast but cheap.", "This is not the end."], Config(select=("NB501",)))


@fixture("span_precedence", FOUND, [(1, "NB510", "info", 6, 12), (2, "NB301", "info", 3, 10)])
def span_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adverb that is a weak intensifier is told once, as that."""
    return found(spark, ["It is really good.", "He quickly ran."], Config(select=("NB301", "NB510")))


PARAGRAPH = "The long first sentence of this paragraph goes on for quite a few words. It ends here."
NARROW = "red blue green grey pink " * 26


@fixture("document_tells", FOUND, [(1, "NB527", "info", 0, 0), (1, "NB528", "warning", 0, 0), (1, "NB529", "info", 73, 86), (2, "NB528", "warning", 0, 0)])
def document_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of like length, paragraphs that end on a punchline, and few different words."""
    return found(spark, ["\n\n".join([PARAGRAPH] * 8), NARROW, "Few words are no sign."], Config(select=("NB527", "NB528", "NB529")))


@fixture("readme_and_grade", FOUND, [(1, "NB801", "warning", 0, 0), (1, "NB101", "error", 0, 0), (2, "NB101", "error", 0, 0)])
def readme_and_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A README without a line that says what it is for, and a limit on the grade."""
    texts = ["# Title\n\n## Installation\n\nUnderstand prerequisites.\n", "# Title\n\nA small library that establishes interoperability between considerations.\n"]
    return found(spark, texts, Config(select=("NB801",), max_grade=3), "markdown", "docs/README.md")


@fixture("report_fixture", "doc integer, value varchar", [(1, "a:1:1: NB306 repeated word 'The the' → The"), (2, "::warning file=a,line=1,col=1::NB306 repeated word 'The the'%0A→ The")])
def report_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding as a line of a report and as an annotation of a workflow."""
    df = spark.createDataFrame([(1, "The the cat.", "a")], "doc_id bigint, text string, path string").coalesce(1)
    rows = lint.findings(lint.analyze(df, Config(select=("NB306",)), name="path"))
    lines = lint.report_lines(rows).select(F.lit(1).alias("doc"), "value")
    return lines.unionByName(lint.workflow_lines(rows).select(F.lit(2).alias("doc"), "value"))


@fixture("listed_tells", FOUND, [(1, "NB316", "warning", 0, 25), (2, "NB517", "info", 2, 12), (2, "NB517", "info", 17, 26), (4, "NB505", "info", 0, 12), (5, "NB504", "warning", 0, 9)])
def listed_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of nobody's, generic praise in company and alone, a transition, and filler."""
    texts = ["Conventional wisdom holds that it is fine.", "A compelling and effective plan.", "One compelling plan.", "Additionally, it works.", "Full stop and then some."]
    return found(spark, texts, Config(select=("NB316", "NB517", "NB505", "NB504")))
