"""Queries over a tree of digests that is kept as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import digests as O
from memlake.operators.integrity import cut
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_COLUMNS = ["doc_id", "text", "lang", "n_chars"]
_ENCODED = "coalesce('I' || length(doc_id::VARCHAR) || ':' || doc_id, 'N') || coalesce('T' || length(text) || ':' || text, 'N') || coalesce('T' || length(lang) || ':' || lang, 'N') || coalesce('I' || length(n_chars::VARCHAR) || ':' || n_chars, 'N')"
_LEVELS = """l0 AS (SELECT 0 AS level, doc_id // 256 AS node, count(*) AS n, sha256(string_agg(sha256(e), '' ORDER BY doc_id)) AS digest FROM r GROUP BY 2),
l1 AS (SELECT 1 AS level, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l0 GROUP BY 2),
l2 AS (SELECT 2 AS level, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l1 GROUP BY 2),
l3 AS (SELECT 3 AS level, node // 16 AS node, sum(n) AS n, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l2 GROUP BY 2),
tree AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _changed(docs):
    """Every 41st text has grown since."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 41 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))


def _tree(rows):
    """The tree of the present rows, and one that was kept of the rows before and updated for what has changed since."""
    levels = max(3, O.levels_for(rows.agg(F.max("doc_id")).first()[0] or 0))
    return levels, cut(O.digest_tree(rows, "doc_id", _COLUMNS, levels))


@R.query(
    f"""WITH r AS (SELECT *, {_ENCODED} AS e FROM (SELECT doc_id, CASE WHEN doc_id % 41 = 7 THEN coalesce(text, '') || '!' ELSE text END AS text, lang, n_chars FROM documents)), {_LEVELS},
b AS (SELECT DISTINCT unnest([m // 3, m // 2, m + 1]) AS boundary FROM (SELECT max(doc_id) AS m FROM documents)),
w AS (SELECT boundary, node * 256 * 16 ** level AS start, n, digest FROM tree, b WHERE (node + 1) * 256 * 16 ** level <= boundary AND (level = 3 OR (node // 16 + 1) * 256 * 16 ** (level + 1) > boundary)),
c AS (SELECT boundary, boundary // 256 * 256 AS start, count(*) AS n, sha256(string_agg(sha256(e), '' ORDER BY doc_id)) AS digest FROM r, b WHERE doc_id >= boundary // 256 * 256 AND doc_id < boundary GROUP BY boundary)
SELECT boundary, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(CAST(start AS BIGINT) || ':' || digest, ',' ORDER BY start)) AS digest FROM (SELECT * FROM w UNION ALL SELECT * FROM c) GROUP BY boundary"""
)
def digests_from_tree(t):
    """Digests at a third, a half and the end of documents from a tree that was kept before every 41st changed and updated for these leaves only."""
    docs = t.documents.select(*_COLUMNS)
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    levels, before = _tree(docs)
    now = _changed(docs)
    tree = cut(O.updated_tree(before, now, "doc_id", _COLUMNS, docs.filter("doc_id % 41 = 7").select("doc_id"), levels))
    return O.prefix_digests(tree, now, "doc_id", _COLUMNS, sorted({last // 3, last // 2, last + 1}))


@R.query("SELECT min(doc_id) AS doc_id, 'changed' AS change FROM documents WHERE doc_id % 41 = 7 AND doc_id >= (SELECT max(doc_id) FROM documents) // 2")
def divergence_from_tree(t):
    """The first document that differs from a copy in which every 41st of the second half has changed, by descending both trees; one leaf of either table is read."""
    docs = t.documents.select(*_COLUMNS)
    half = (docs.agg(F.max("doc_id")).first()[0] or 0) // 2
    copy = _changed(docs).filter(F.col("doc_id") >= half).unionByName(docs.filter(F.col("doc_id") < half))
    levels, ours = _tree(docs)
    _, theirs = _tree(copy)
    block = O.first_difference(ours, theirs, levels)
    return O.first_differing_key(docs, copy, "doc_id", _COLUMNS, block or (0, 0))
