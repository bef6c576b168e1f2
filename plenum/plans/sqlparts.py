"""DuckDB text shared by the oracles of several queries."""

from __future__ import annotations


def num_text(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR)"


GRAN = """CASE
  WHEN regexp_extract(pointer, '[^/]*$') IN ('space_before','space_after','char_spacing') THEN 20.0
  WHEN regexp_extract(pointer, '[^/]*$') IN ('indent_left','indent_right','indent_first_line','indent_hanging',
    'top','right','bottom','left','header','footer','gutter','width','height') THEN 14.4
  ELSE 10.0 END"""

BKEY = f"""CASE tag
  WHEN 'len' THEN 'len:' || CAST(CAST(round_even(num / CAST({GRAN} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)
  WHEN 'sz' THEN 'sz:' || CAST(CAST(num AS BIGINT) AS VARCHAR)
  WHEN 'n' THEN 'n:' || {num_text('num')}
  ELSE tag || ':' || str END"""

STATUS = """CASE
  WHEN coverage >= 0.75 AND agreement >= 0.90 THEN 'normative'
  WHEN coverage >= 0.75 AND agreement >= 0.50 THEN 'contested'
  WHEN coverage >= 0.75 THEN 'undecided'
  WHEN coverage >= 0.40 AND agreement >= 0.90 THEN 'optional_consistent'
  WHEN coverage >= 0.40 THEN 'variable'
  ELSE 'informational' END"""

SEVERITY = """CASE status WHEN 'normative' THEN 'error' WHEN 'optional_consistent' THEN 'error-if-present'
  WHEN 'contested' THEN 'warn' WHEN 'variable' THEN 'info' ELSE 'off' END"""


def ballots(src: str, doc: str, specs: list[tuple[str, str, str]], corpus: str = "'all'") -> str:
    """SELECTs of ``(corpus, doc, pointer, tag, num, str)`` from ``(pointer, tag, expression)``."""
    out = []
    for pointer, tag, expr in specs:
        textual = tag in ("s", "b", "t", "r")
        num = "CAST(NULL AS DOUBLE)" if textual else f"CAST({expr} AS DOUBLE)"
        text = f"CAST({expr} AS VARCHAR)" if textual else "CAST(NULL AS VARCHAR)"
        out.append(
            f"SELECT {corpus} AS corpus, CAST({doc} AS VARCHAR) AS doc, '{pointer}' AS pointer, "
            f"'{tag}' AS tag, {num} AS num, {text} AS str FROM {src} WHERE {expr} IS NOT NULL")
    return "\nUNION ALL ".join(out)


def doc_votes(obs: str = "obs") -> str:
    """CTEs from a ballot CTE to ``dv`` (one row per corpus, doc, pointer)."""
    return f"""
bk AS (SELECT corpus, doc, pointer, num, str, {BKEY} AS bkey FROM {obs}),
cnt AS (SELECT corpus, doc, pointer, bkey, count(*) AS n, quantile_disc(num, 0.5) AS num, min(str) AS str
        FROM bk GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY corpus, doc, pointer ORDER BY n DESC, bkey) AS rn,
        sum(n) OVER (PARTITION BY corpus, doc, pointer) AS total FROM cnt),
dv AS (SELECT corpus, doc, pointer, bkey, num, str, CAST(total AS BIGINT) AS observations,
        n AS modal_observations, n / total AS internal_agreement FROM rk WHERE rn = 1)"""


def votes(docs: str, obs: str = "obs") -> str:
    """CTEs from a ballot CTE to ``votes``; ``docs`` selects ``(corpus, doc)``."""
    return doc_votes(obs) + f""",
sz AS (SELECT corpus, count(DISTINCT doc) AS n_docs FROM ({docs}) GROUP BY corpus),
sup AS (SELECT corpus, pointer, bkey, count(*) AS n, quantile_disc(num, 0.5) AS num, min(str) AS str
        FROM dv GROUP BY ALL),
srk AS (SELECT *, row_number() OVER (PARTITION BY corpus, pointer ORDER BY n DESC, bkey) AS rn,
        sum(n) OVER (PARTITION BY corpus, pointer) AS observed_in FROM sup),
v0 AS (SELECT corpus, pointer, bkey, num, str, CAST(observed_in AS BIGINT) AS observed_in, n AS modal_count,
        n_docs, observed_in / n_docs AS coverage, n / observed_in AS agreement
        FROM srk JOIN sz USING (corpus) WHERE rn = 1),
v1 AS (SELECT *, {STATUS} AS status FROM v0),
votes AS (SELECT *, {SEVERITY} AS severity, status <> 'informational' AS in_donor,
        status IN ('undecided','contested') AS needs_review, observed_in < 3 AS weak FROM v1)"""
