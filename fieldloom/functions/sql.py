"""The parsers and scalar functions by name in SQL text.

They are SQL functions, so Catalyst inlines their bodies into the query: nothing leaves the JVM. Table functions take
part in ``LATERAL`` joins and have a declared schema.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldloom.functions import text

_STRIPPED = r"regexp_replace({0}, '^\\s+|\\s+$', '')"


def _literal(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bare(path: str) -> str:
    """A file's name without folders, extension and UUID."""
    return f"regexp_replace(regexp_replace(element_at(split({path}, '/'), -1), {_literal('(?i)[.](jpg|jpeg)$')}, ''), {_literal(text.UUID_PREFIX)}, '')"


def _part(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(s, {_literal(pattern)}, {group}), '')"


_MARK = _literal(text.SECTION)
_HEALTHY, _BLIGHT = text.HEALTHY_NAME, text.BLIGHT_NAME

#: Name and arguments, what is returned, and the body.
FUNCTIONS = {
    "response_sections(response STRING)": (
        "TABLE (place INT, name STRING, body STRING)",
        f"""SELECT k + 1, upper(names[k]), {_STRIPPED.format('bodies[k + 1]')}
        FROM (SELECT regexp_extract_all(response, {_MARK}, 1) AS names, split(response, {_MARK}, -1) AS bodies) LATERAL VIEW posexplode(names) AS k, n""",
    ),
    "healthy_leaf(path STRING)": (
        "TABLE (parsed BOOLEAN, leaf_number INT, sub_index INT, group_key STRING)",
        f"""SELECT s RLIKE {_literal(_HEALTHY)}, CAST({_part(_HEALTHY, 1)} AS INT), CAST({_part(_HEALTHY, 3)} AS INT), 'th::Leaf' || CAST({_part(_HEALTHY, 1)} AS INT) FROM (SELECT {_bare('path')} AS s)""",
    ),
    "blight_leaf(path STRING)": (
        "TABLE (parsed BOOLEAN, session_prefix STRING, leaf_number INT, sub_index INT, day_number INT, group_key STRING)",
        f"""SELECT parsed, prefix, leaf, sub, day, 'tlb::' || prefix || '::Leaf' || leaf FROM (SELECT s RLIKE {_literal(_BLIGHT)} AS parsed, CASE WHEN upper({_part(_BLIGHT, 1)}) = 'GH_HL' THEN {_part(_BLIGHT, 1)} ELSE upper({_part(_BLIGHT, 1)}) END AS prefix,
        CAST({_part(_BLIGHT, 2)} AS INT) AS leaf, CAST({_part(_BLIGHT, 4)} AS INT) AS sub, CAST({_part(_BLIGHT, 6)} AS INT) AS day FROM (SELECT {_bare('path')} AS s))""",
    ),
    "leaf_key(name STRING)": ("STRING", _STRIPPED.format(f"lower(regexp_replace(name, {_literal(text.UUID_PREFIX)}, ''))")),
    "file_stem(name STRING)": ("STRING", _STRIPPED.format("lower(regexp_replace(name, '[.][^.]*$', ''))")),
    "severity_of(body STRING)": ("STRING", "coalesce(nullif(lower(regexp_extract(body, '(?i)(critical|high|medium|low|healthy)', 1)), ''), 'medium')"),
    "hamming_distance(a BIGINT, b BIGINT)": ("INT", "bit_count(a ^ b)"),
    "whole_percent(x DOUBLE)": ("STRING", "floor(x * 100 + 0.5) || '%'"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session, and return their names; a function of the same name is replaced."""
    for signature, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
