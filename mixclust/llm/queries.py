"""The registered queries of the subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.substring_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.sentencepiece_bpe import tokenise

    return tokenise(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.pseudo_likelihood import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.period_runs import collapse_runs, summary, tail_loop

    return summary(collapse_runs(table(spark, sf_dir, "documents"), tail_loop))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mixclust.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_url_filter, op4_near_dedup, op5_quality, op6_sharding, op7_sentencepiece, op8_html_text, op9_lm_scoring, op10_top_k, op11_periodic_runs, op12_whitening, op13_jaccard_join)}

#: Words of every text, as lists: unchanged, and with A-Z in lower case.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _components_sql(size: int, percent: int) -> str:
    """The CTEs ``n`` (doc_id, n_shingles) and ``c`` (doc_id, component_id) of documents linked by their shingle sets."""
    return f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_LOWER} AS w FROM documents WHERE doc_id IS NOT NULL),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS x
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
             n AS MATERIALIZED (SELECT w.doc_id, count(s.x) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
             l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
                   JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                   GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (min(na.n_shingles) + min(nb.n_shingles) - count(*))),
             r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
             c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
             p AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
             f AS (SELECT x, min(doc_id) AS least FROM p GROUP BY x),
             h AS (SELECT DISTINCT p.doc_id, p.i FROM p JOIN f ON f.x = p.x AND f.least < p.doc_id),
             k AS (SELECT t.doc_id, t.j, t.word, max(h.i) OVER (PARTITION BY t.doc_id ORDER BY t.j) >= t.j - 49 AS gone
                   FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w) t
                   LEFT JOIN h ON h.doc_id = t.doc_id AND h.i = t.j),
             o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
                          string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone IS NOT TRUE) AS kept FROM k GROUP BY doc_id)
        SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
        FROM w LEFT JOIN o ON o.doc_id = w.doc_id""",
    "op4_near_dedup": f"""{_components_sql(5, 85)}
        SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id""",
    "op13_jaccard_join": f"""{_components_sql(4, 85)}
        SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, c.component_id FROM n JOIN c ON c.doc_id = n.doc_id""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
