"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from barkeep.llm.embed_dedup import THRESHOLD
from barkeep.llm.jaccard_join import PERCENT, SHINGLE
from barkeep.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

# Rules and listed hosts of the URL query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED_HOSTS = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(links: str) -> str:
    """CTE reach(a, root): the smallest id that each end of links(a, b), given both ways, reaches."""
    return f"reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a)"


def _url_sql() -> str:
    rules = ", ".join(f"('{said}', '{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}')" for said, rule in RULES)
    listed = "|".join(LISTED_HOSTS)
    return f"""WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    named AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)+$', '') AS name FROM parts),
    listed AS (SELECT DISTINCT name FROM named WHERE regexp_matches(host, '(^|\\.)({listed})\\.')),
    rules(said, rule, rule_host, rule_path) AS (VALUES {rules}),
    fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM (SELECT DISTINCT page_id, host, path FROM named), rules
      WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host <> '' AND name IN (SELECT name FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM named LEFT JOIN fits USING (page_id)"""


def _embedding_sql() -> str:
    return f"""WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
    {_components('links')},
    roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
    FROM embeddings LEFT JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


def _jaccard_sql() -> str:
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM words),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    members AS (SELECT doc_id, unnest(s) AS g FROM sets),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM members x JOIN members y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= {PERCENT} * (p.n + q.n - m)),
    {_components('links')},
    roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id FROM sizes LEFT JOIN roots ON a = doc_id"""


_EXACT = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents),
    k AS (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k"""


def _codes_sql() -> str:
    """Vectors as (i, p, j, x) and codebooks as (p, e, j, y), one pair of tables for each round."""
    near = """SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT i, x.p, b.e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN b{0} b ON x.p = b.p AND x.j = b.j GROUP BY ALL) GROUP BY ALL"""
    rounds = "".join(
        f"""a{k} AS MATERIALIZED ({near.format(k)}),
    b{k + 1} AS MATERIALIZED (SELECT p, e, j, CAST(coalesce(m, y) AS BIGINT) AS y FROM b{k} LEFT JOIN (SELECT p, e, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM x JOIN a{k} USING (i, p) GROUP BY ALL) USING (p, e, j)),
    """
        for k in range(ROUNDS)
    )
    return f"""WITH kept AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    x AS MATERIALIZED (SELECT i, (n - 1) // (w // {PARTS}) AS p, (n - 1) % (w // {PARTS}) AS j, x FROM (SELECT i, len(v) AS w, unnest(range(1, len(v) + 1)) AS n, CAST(floor({SCALE} * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS x FROM kept)),
    b0 AS MATERIALIZED (SELECT p, i AS e, j, x AS y FROM x WHERE i < {ENTRIES}),
    {rounds}last AS MATERIALIZED ({near.format(ROUNDS)}),
    coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY i)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM kept JOIN coded USING (i)"""


ORACLES = {"op12_vector_codes": _codes_sql(), "op11_exact_dedup": _EXACT, "op2_embedding_dedup": _embedding_sql(), "op5_jaccard_join": _jaccard_sql(), "op6_url_filter": _url_sql()}
