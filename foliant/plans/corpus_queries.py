"""Queries on the document model: tokens, dictionary, postings, statistics, sections, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corpus
from foliant.plans.registry import query
from foliant.session import table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
FOLDED = "replace(translate(lower({0}), '’‘ʼ', ''''''''), 'ß', 'ss')"


def terms_sql(text: str) -> str:
    """The terms of a text in DuckDB."""
    return f"list_filter(regexp_extract_all({FOLDED.format(text)}, '{T.TERM}'), lambda w: w NOT IN ({STOP_SQL}))"


ARTICLES = "articles AS (SELECT doc_id AS article_id, source AS library_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) AS title, coalesce(text, '') AS text FROM documents)"
EVIDENCE = """evidence AS (
  SELECT '22E-' || upper(sha256(concat_ws(chr(0), library_id, article_id, 'S00001', i)))[1:32] AS evidence_id, article_id, library_id, i AS ordinal, parts[i] AS text
  FROM (SELECT article_id, library_id, string_split(text, chr(10)) AS parts FROM articles), unnest(generate_series(1, len(parts))) AS s(i))"""
WITH = f"WITH {ARTICLES}, {EVIDENCE}"


@query("tokenize_terms", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)")
def tokenize_terms(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


TOKENS_SQL = "regexp_extract_all(" + FOLDED.format(r"regexp_replace(text, '\s+', ' ', 'g')") + r", '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]')"


@query("token_dictionary", f"SELECT token, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id FROM (SELECT unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY token")
def token_dictionary(spark, sf_dir):
    return corpus.dictionary(table(spark, sf_dir, "documents"))


@query("postings", f"{WITH} SELECT term, count(*) AS n_evidence, min(evidence_id) AS first_id, max(evidence_id) AS last_id FROM (SELECT evidence_id, unnest(list_distinct({terms_sql('text')})) AS term FROM evidence) GROUP BY term")
def postings(spark, sf_dir):
    return corpus.dictionary_of_postings(corpus.evidence(table(spark, sf_dir, "documents")))


@query("evidence_identity", f"{WITH} SELECT evidence_id, article_id, ordinal, sha256(text) AS text_sha256 FROM evidence")
def evidence_identity(spark, sf_dir):
    return corpus.evidence(table(spark, sf_dir, "documents")).select("evidence_id", "article_id", "ordinal", F.sha2("text", 256).alias("text_sha256"))


@query("corpus_stats_rollup", f"{WITH} SELECT library_id, count(DISTINCT article_id) AS articles, count(*) AS evidence, CAST(sum(length(text)) AS BIGINT) AS characters FROM evidence GROUP BY ROLLUP (library_id)")
def corpus_stats_rollup(spark, sf_dir):
    # Articles are counted by their first line, so no distinct aggregate is needed.
    rows = corpus.evidence(table(spark, sf_dir, "documents"))
    return rows.rollup("library_id").agg(F.count_if(F.col("ordinal") == 1).alias("articles"), F.count("*").alias("evidence"), F.sum(F.length("text")).alias("characters"))


@query("normalize_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


@query("chunk_fold")
def chunk_fold(spark, sf_dir):
    docs = corpus.articles(table(spark, sf_dir, "documents")).select("article_id", F.posexplode(corpus.chunk_lines(F.col("text"), 2200)).alias("n", "chunk"))
    return docs.select("article_id", "n", F.length("chunk").alias("characters"), F.md5("chunk").alias("digest"))


#: A wiki text made of a document's lines: every second line stands under a heading.
@query(
    "section_split",
    """SELECT doc_id, CAST(p AS INTEGER) AS place, CASE WHEN p = 0 THEN 'Introduzione' ELSE 'Parte ' || p END AS heading, md5(trim(lines[p + 1], ' ' || chr(10))) AS digest
FROM (SELECT doc_id, string_split(replace(text, '=', '-'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(generate_series(0, len(lines) - 1)) AS s(p)""",
)
def section_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.transform(F.split(F.replace("text", F.lit("="), F.lit("-")), "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("== Parte "), i.cast("string"), F.lit(" ==\n"), x)))
    found = docs.select("doc_id", F.explode(corpus.sections(F.array_join(lines, "\n"))).alias("s"))
    return found.select("doc_id", "s.place", "s.heading", F.md5("s.body").alias("digest"))


@query("markup_clean", "SELECT s_suppkey, n_name || ' is home to ' || s_name || ' of ' || n_name || '. book, p. 3' || chr(10) || 'a ; b' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def markup_clean(spark, sf_dir):
    """What a note says stays; a table's cells are told apart; links give their labels."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    wiki = F.concat(
        F.lit("<!-- x -->'''"), "n_name", F.lit("''' is home to [["), "s_name", F.lit("|"), "s_name", F.lit("]] of [["), "n_name",
        F.lit("]].<ref name=a>book, p. 3</ref><ref name=a />[[Categoria:Fornitori]]<br/>[https://example.org/x]\n{|\n|-\n| a || b\n|}\n"),
    )
    return s.select("s_suppkey", corpus.clean_markup(wiki).alias("text"))


@query("slug_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))
