"""Queries that rank, deduplicate, cluster and merge rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import merge as M
from ..operators.components import connected_components, star_edges
from ..operators.similarity import histogram, similar_titles
from .relations import CANDIDATES, REQUESTS, candidates, requests, s_arxiv, s_dedup, s_doi, s_paper_id, s_title

c = F.col


def _keyed(spark, d):
    return candidates(spark, d).withColumn("key", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))


def rank_candidates(spark, d):
    return M.top_candidates(_keyed(spark, d), 200).select("rank", "key", "id", F.round("score", 6).alias("score"))


def dedup_candidates(spark, d):
    return M.dedup(_keyed(spark, d)).select("key", "id", F.round("score", 6).alias("score"), "first_ord")


def topk_per_source(spark, d):
    return M.ranked(_keyed(spark, d).withColumn("key", F.concat_ws("|", "source", "key")), within=["source"], most=20).select("source", "rank", "id")


def best_row(spark, d):
    order = F.struct(R.has(c("doi")).cast("int"), R.has(c("arxiv_id")).cast("int"), c("score"), F.length("title"), -c("ord"))
    return _keyed(spark, d).groupBy("key").agg(F.max_by("id", order).alias("best_id"), F.count(F.lit(1)).alias("n"))


def merge_paper(spark, d):
    out = M.merge_rows(_keyed(spark, d), "key")
    return out.select("key", "paper_id", "doi", "arxiv_id", "year", "title", "venue", "url", F.md5("abstract").alias("abstract_md5"))


def merge_terms(spark, d):
    return M.merge_terms(_keyed(spark, d), "key", "keywords").select("key", F.array_join("keywords", "|").alias("keywords"))


def _rows(spark, d):
    q = requests(spark, d)
    key = R.fallback_key(c("source"), c("source_id"), c("title"), c("year"), c("doi"), c("arxiv_id"), c("url"))
    return q.select(c("qid").alias("ord"), "*", key.alias("row_key"), R.title_words(c("title")).alias("title_norm"))


def _identity_edges(rows):
    keys = rows.select("ord", F.explode(F.array_compact(F.array(
        F.when(R.bare_doi(c("doi")) != "", F.concat(F.lit("d:"), R.bare_doi(c("doi")))), F.when(R.bare_arxiv(c("arxiv_id")) != "", F.concat(F.lit("a:"), R.bare_arxiv(c("arxiv_id"))))))).alias("k"))
    return star_edges(keys, "k", "ord")


def _clusters(rows, edges):
    comp = connected_components(edges)
    return rows.join(comp.withColumnRenamed("node", "ord"), "ord", "left").withColumn("cluster", F.coalesce("component", "ord")).drop("component")


def equi_clusters(spark, d):
    rows = _rows(spark, d)
    return _clusters(rows, _identity_edges(rows)).select("ord", "cluster")


def cluster_canonical(spark, d):
    rows = _rows(spark, d)
    return M.canonical_clusters(_clusters(rows, _identity_edges(rows)), "cluster").select("cluster", "paper_id", "doi", "arxiv_id", "year", "venue", "url", "title", "source", "n_rows")


def raw_to_canonical(spark, d):
    """Row key to record: of several clusters with one key the last wins."""
    rows = _rows(spark, d)
    in_cluster = _clusters(rows, _identity_edges(rows))
    ids = M.canonical_clusters(in_cluster, "cluster").select("cluster", "paper_id")
    return in_cluster.select("row_key", "cluster").join(ids, "cluster").groupBy("row_key").agg(F.max_by("paper_id", "cluster").alias("paper_id"))


def title_blocks(spark, d):
    """What the fuzzy join knows of each different title before it compares: length and characters."""
    rows = _rows(spark, d).where("title_norm != '' and year != ''")
    t = rows.groupBy("year", "title_norm").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    h = histogram(c("title_norm"))
    return t.select("year", "title_norm", "first", "n", F.length("title_norm").cast("long").alias("len"), h[0].cast("long").alias("n_a"), h[4].cast("long").alias("n_e"), h[26].cast("long").alias("n_blank"))


def fuzzy_clusters(spark, d):
    """Discovery rows grouped by identifiers and similar titles of one year."""
    rows = _rows(spark, d)
    edges = _identity_edges(rows).unionByName(similar_titles(rows.select("ord", "title_norm", "year")))
    return M.canonical_clusters(_clusters(rows, edges), "cluster").select("cluster", "paper_id", "title", "year", "n_rows")


QUERIES = {
    "q_rank_candidates": rank_candidates, "q_dedup_candidates": dedup_candidates, "q_topk_per_source": topk_per_source, "q_best_row": best_row, "q_merge_paper": merge_paper,
    "q_merge_terms": merge_terms, "q_equi_clusters": equi_clusters, "q_cluster_canonical": cluster_canonical, "q_raw_to_canonical": raw_to_canonical,
    "q_title_blocks": title_blocks, "q_fuzzy_clusters": fuzzy_clusters,
}

_KEYED = f"SELECT *, {s_dedup()} AS key FROM ({CANDIDATES})"
_FIRST = f"SELECT *, min(ord) OVER (PARTITION BY key) AS first_ord, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rn FROM ({_KEYED})"
_ORDER = "score DESC, (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, length(title) DESC, first_ord"
_ROWS = f"""SELECT qid AS ord, *, {s_title('title')} AS title_norm, {s_doi('doi')} AS d, {s_arxiv('arxiv_id')} AS a,
  CASE WHEN trim(source_id, ' ') <> '' THEN concat(src, ':', trim(source_id, ' ')) ELSE concat(src, ':fallback:', substr(sha1(concat_ws('|', src, title, year, doi, arxiv_id, url)), 1, 16)) END AS row_key
FROM (SELECT *, lower(trim(CASE WHEN source <> '' THEN source ELSE 'unknown' END, ' ')) AS src FROM ({REQUESTS}))"""
_CLUSTERS = f"""WITH RECURSIVE r AS ({_ROWS}),
e AS (SELECT r.ord AS x, s.m AS y FROM r JOIN (SELECT d, min(ord) AS m FROM r WHERE d <> '' GROUP BY d) s ON r.d = s.d WHERE r.d <> ''
  UNION SELECT r.ord, s.m FROM r JOIN (SELECT a, min(ord) AS m FROM r WHERE a <> '' GROUP BY a) s ON r.a = s.a WHERE r.a <> ''),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT ord AS node, ord AS root FROM r UNION SELECT b.y, reach.root FROM reach JOIN b ON reach.node = b.x WHERE b.y > reach.root),
cl AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node),
rc AS (SELECT r.*, cl.cluster FROM r JOIN cl ON r.ord = cl.node)"""
_CANON = f"""g AS (SELECT cluster, coalesce(min(nullif(d, '')), '') AS doi, coalesce(min(nullif(a, '')), '') AS arxiv_id, coalesce(min(nullif(year, '')), '') AS year, coalesce(min(nullif(venue, '')), '') AS venue,
  coalesce(min(nullif(url, '')), '') AS url, count(*) AS n_rows FROM rc GROUP BY 1),
t AS (SELECT cluster, title FROM (SELECT cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY length(title) DESC, title) AS n FROM rc) WHERE n = 1),
s AS (SELECT cluster, source FROM (SELECT cluster, source, row_number() OVER (PARTITION BY cluster ORDER BY row_key, ord) AS n FROM rc) WHERE n = 1),
k AS (SELECT g.*, t.title, s.source, {s_paper_id('g.doi', 'g.arxiv_id', 't.title', 'g.year')} AS paper_id FROM g JOIN t USING (cluster) JOIN s USING (cluster))"""

SQL = {
    "q_rank_candidates": f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, key, id, round(score, 6) AS score FROM ({_FIRST}) WHERE rn = 1 QUALIFY rank <= 200",
    "q_dedup_candidates": f"SELECT key, id, round(score, 6) AS score, first_ord FROM ({_FIRST}) WHERE rn = 1",
    "q_topk_per_source": f"""SELECT source, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS rank FROM
  (SELECT *, min(ord) OVER (PARTITION BY source, key) AS first_ord, row_number() OVER (PARTITION BY source, key ORDER BY score DESC, ord) AS rn FROM ({_KEYED})) WHERE rn = 1) WHERE rank <= 20""",
    "q_best_row": f"""SELECT key, id AS best_id, n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, score DESC, length(title) DESC, ord) AS rn FROM ({_KEYED})) WHERE rn = 1""",
    "q_merge_paper": f"""WITH k AS ({_KEYED}), g AS (SELECT key, coalesce(min(nullif({s_doi('doi')}, '')), '') AS doi, coalesce(min(nullif({s_arxiv('arxiv_id')}, '')), '') AS arxiv_id, coalesce(min(nullif(trim(year, ' '), '')), '') AS year FROM k GROUP BY 1),
b AS (SELECT key, title, venue, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, score DESC, length(title) DESC, ord) AS rn FROM k) WHERE rn = 1),
x AS (SELECT key, trim(abstract, ' ') AS abstract FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(trim(abstract, ' ')) DESC, ord) AS rn FROM k WHERE trim(abstract, ' ') <> '') WHERE rn = 1)
SELECT g.key, {s_paper_id('g.doi', 'g.arxiv_id', 'b.title', 'g.year')} AS paper_id, g.doi, g.arxiv_id, g.year, b.title, b.venue, b.url, md5(coalesce(x.abstract, '')) AS abstract_md5 FROM g JOIN b USING (key) LEFT JOIN x USING (key)""",
    "q_merge_terms": f"""WITH k AS ({_KEYED}), e AS (SELECT key, ord, unnest(keywords) AS term, generate_subscripts(keywords, 1) AS pos FROM k),
f AS (SELECT key, trim(term, ' ') AS term, ord, pos, row_number() OVER (PARTITION BY key, lower(trim(term, ' ')) ORDER BY ord, pos) AS n FROM e WHERE trim(term, ' ') <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, pos) AS place FROM f WHERE n = 1)
SELECT key, string_agg(term, '|' ORDER BY place) AS keywords FROM p WHERE place <= 12 GROUP BY key""",
    "q_equi_clusters": f"{_CLUSTERS} SELECT ord, cluster FROM rc",
    "q_cluster_canonical": f"{_CLUSTERS}, {_CANON} SELECT cluster, paper_id, doi, arxiv_id, year, venue, url, title, source, n_rows FROM k",
    "q_raw_to_canonical": f"{_CLUSTERS}, {_CANON} SELECT rc.row_key, arg_max(k.paper_id, k.cluster) AS paper_id FROM rc JOIN k USING (cluster) GROUP BY 1",
    "q_title_blocks": f"""SELECT year, title_norm, min(ord) AS first, count(*) AS n, CAST(length(title_norm) AS BIGINT) AS len, CAST(length(title_norm) - length(replace(title_norm, 'a', '')) AS BIGINT) AS n_a,
  CAST(length(title_norm) - length(replace(title_norm, 'e', '')) AS BIGINT) AS n_e, CAST(length(title_norm) - length(replace(title_norm, ' ', '')) AS BIGINT) AS n_blank FROM ({_ROWS}) WHERE title_norm <> '' AND year <> '' GROUP BY 1, 2""",
}
