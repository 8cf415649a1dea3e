"""The SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from quartzgrid.llm.secret_scan import WIDE_OWNERS, WIDE_REPOSITORIES

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))
WHERE rank <= 5"""

PASSAGES = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS k FROM starts),
least AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN least USING (k) WHERE first < doc_id),
lists AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n_words, len(coalesce(gone, [])) AS n_removed, list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS rest FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept"""

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", 0, _ASSIGN, 1, 6), ("access", 1, "AKIA[A-Z0-9]+", 0, 20), ("hex", 2, "[0-9a-f]{24,}", 0, 24), ("owned", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20))
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, owner, repository, '{kind}' AS kind, {order} AS o, {least} AS least, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS value, regexp_split_to_array(t, '{pattern}') AS gaps FROM d"
    for kind, order, pattern, group, least in _KINDS
)

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (SELECT doc_id, owner, repository, kind, o, least, whole, value, gaps, unnest(range(1, len(whole) + 1)) AS i FROM found WHERE len(whole) > 0),
spans AS (SELECT doc_id, owner, repository, kind, o, value[i] AS v, CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(whole[i]) AS n FROM each WHERE length(value[i]) >= least),
base AS (SELECT *, a + n AS e FROM spans WHERE kind <> 'owned'),
own AS (SELECT *, a + n AS e FROM spans s WHERE kind = 'owned' AND regexp_matches(v, '[A-Za-z]') AND 6 * (length(v) - length(regexp_replace(v, '[0-9]', '', 'g'))) >= length(v)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.a < s.a + s.n AND s.a < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM own),
owners AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(1) || repository) AS n_repositories FROM every GROUP BY v),
judged AS (SELECT * FROM every JOIN owners USING (v) WHERE kind <> 'owned' OR n_owners = 1),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind <> 'owned' AND n_owners < {WIDE_OWNERS} AND n_repositories < {WIDE_REPOSITORIES}) AS n_live,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) FILTER (kind <> 'owned') AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN listed USING (doc_id)"""

SHARDS = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
