"""DuckDB SQL for the rows of the queries that SQL can express."""

from .secrets import ASSIGN, BARE, LONG_HEX, MOST_OWNERS, MOST_REPOS


def _kind(number: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, repo, owner, {number} AS kind, start, start + length(w) AS stop, v FROM (
      SELECT rid, repo, owner, unnest(w) AS w, unnest(v) AS v,
        unnest(list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda g: length(g))), 0))) AS start
      FROM (SELECT rid, repo, owner, regexp_split_to_array(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS w, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d WHERE regexp_matches(t, '{quoted}')))
      WHERE length(v) >= {least}"""


SECRETS = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, row(source, lang) AS repo, source AS owner FROM documents),
base AS MATERIALIZED ({_kind(0, ASSIGN, 2, 6)} UNION ALL {_kind(1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_kind(2, LONG_HEX, 0, 24)}),
bare AS MATERIALIZED ({_kind(3, BARE, 0, 0)}),
free AS (SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.rid = b.rid AND s.start < b.stop AND b.start < s.stop)),
every AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM free),
known AS (SELECT v, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8
    AND count(DISTINCT coalesce('=' || owner, '')) <= {MOST_OWNERS} AND count(DISTINCT repo) <= {MOST_REPOS} AS live,
    count(DISTINCT coalesce('=' || owner, '')) AS owners, count(DISTINCT repo) AS repos FROM every GROUP BY v),
kept AS (SELECT e.*, live, owners, repos, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS said FROM every e JOIN known USING (v) WHERE kind < 3 OR live),
r AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
    string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(said, ',' ORDER BY start, kind) AS s,
    count(*) FILTER (live) AS l, count(*) FILTER (NOT live) AS c, max(owners) AS o, max(repos) AS p FROM kept GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(l, 0)::BIGINT AS n_live, coalesce(c, 0)::BIGINT AS n_copied,
  coalesce(o, 0)::BIGINT AS most_owners, coalesce(p, 0)::BIGINT AS most_repos
FROM d LEFT JOIN r USING (rid)"""


def shards(limit: int) -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS a FROM documents),
s AS (SELECT level, a >> (60 - level) AS k, sum(b)::BIGINT AS t FROM d, (SELECT unnest(range(0, 61)) AS level) GROUP BY ALL),
f AS (SELECT a, min(level) AS level FROM (SELECT DISTINCT a FROM d), s WHERE k = a >> (60 - level) AND t <= {limit} GROUP BY a)
SELECT doc_id, b AS n_bytes, CASE WHEN f.level = 0 THEN '' ELSE lpad(bin(d.a >> (60 - f.level)), f.level::INT, '0') END AS shard,
  f.level::INT AS shard_depth, 0::BIGINT AS shard_part, t AS shard_bytes
FROM d JOIN f USING (a) JOIN s ON s.level = f.level AND s.k = d.a >> (60 - f.level)"""


def _bisected(name: str, low: str, high: str, enough: str) -> str:
    """50 halvings of (lo, hi) in a recursive table; `enough` is of x and of the shares p."""
    holds = enough.replace("<x>", "((lo + hi) / 2)")
    return f"""{name}(i, lo, hi) AS (SELECT 0, ({low})::DOUBLE, ({high})::DOUBLE UNION ALL
  SELECT any_value(i) + 1, CASE WHEN {holds} THEN (any_value(lo) + any_value(hi)) / 2 ELSE any_value(lo) END, CASE WHEN {holds} THEN any_value(hi) ELSE (any_value(lo) + any_value(hi)) / 2 END
  FROM {name}, p, goal WHERE i < 50 GROUP BY lo, hi)"""


def mixture(entropy_share: float, max_repeats: float, budget: float) -> str:
    entropy = "ln(sum(pow(p, <x>))) - sum(pow(p, <x>) * ln(p) * <x>) / sum(pow(p, <x>)) >= any_value(h)"
    repeats = f"max(pow(p, -<x>)) / sum(pow(p, 1 - <x>)) * {budget} <= {max_repeats}"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce(source, '') AS g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
t AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS n FROM d GROUP BY g),
p AS MATERIALIZED (SELECT g, n, n / (SELECT sum(n) FROM t) AS p FROM t WHERE n > 0),
goal AS (SELECT {entropy_share} * ln(count(*)) - 1e-12 AS h FROM p),
{_bisected('flat', '0', '1', entropy)},
e AS MATERIALIZED (SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= (SELECT h FROM goal) THEN 1.0 ELSE (SELECT lo FROM flat WHERE i = 50) END AS x),
{_bisected('lift', '0', 'SELECT 1 - x FROM e', repeats)},
r AS MATERIALIZED (SELECT CASE WHEN max(pow(p, x - 1)) / sum(pow(p, x)) * {budget} <= {max_repeats} THEN any_value(x) ELSE 1 - (SELECT lo FROM lift WHERE i = 50) END AS x FROM p, e),
w AS (SELECT g, n, pow(p, x) / sum(pow(p, x)) OVER () AS w FROM p, r),
q AS MATERIALIZED (SELECT g, n, w, floor(w * ({budget} * sum(n) OVER ()) + 1e-6)::BIGINT AS quota FROM w),
k AS (SELECT d.*, coalesce(w, 0) AS w, coalesce(quota // q.n, 1) AS epochs, coalesce(quota % q.n, 0) AS rest FROM d LEFT JOIN q USING (g)),
placed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || epochs), 1, 15))::BIGINT AS a,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || (epochs - 1)), 1, 15))::BIGINT AS b FROM k),
taken AS (SELECT *, rest > 0 AND sum(n) OVER (PARTITION BY g ORDER BY a) <= rest AS more FROM placed)
SELECT doc_id, source, n AS n_tokens, round(w, 9) AS weight, (epochs + more::INT)::BIGINT AS copies, (CASE WHEN more THEN epochs ELSE epochs - 1 END)::BIGINT AS epoch,
  (CASE WHEN more THEN a ELSE b END >> 48)::BIGINT AS block FROM taken"""
