"""Functions for SQL, with SQL bodies that the optimiser inlines, and table functions over the session's views."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
_TOKENS = "filter(split(lower(coalesce({0}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '' AND octet_length(t) <= 40)"

SCALAR = {
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {_DOT.format('a', 'a')} = 0 OR {_DOT.format('b', 'b')} = 0 THEN 0 ELSE {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')}) END"),
    "l2_score": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1 / (1 + sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), CAST(0 AS DOUBLE), (s, x) -> s + x)))"),
    "max_sim": ("q ARRAY<ARRAY<DOUBLE>>, d ARRAY<ARRAY<DOUBLE>>", "DOUBLE", f"aggregate(transform(q, x -> greatest(CAST(0 AS DOUBLE), array_max(transform(d, y -> {_DOT.format('x', 'y')})))), CAST(0 AS DOUBLE), (s, x) -> s + x)"),
    "tokens": ("t STRING", "ARRAY<STRING>", _TOKENS.format("t")),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1 ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "est_tokens": ("t STRING", "BIGINT", "CAST(ceil(octet_length(coalesce(t, '')) / 4) AS BIGINT)"),
    "recency": ("created TIMESTAMP, now TIMESTAMP", "DOUBLE", "exp(-greatest(floor((unix_timestamp(now) - unix_timestamp(created)) / 86400), 0) / 30)"),
    "date_bin": ("width INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(t) - unix_micros(origin)) / (extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000)) AS BIGINT) * CAST(extract(SECOND FROM width) * 1000000 + extract(MINUTE FROM width) * 60000000 + extract(HOUR FROM width) * 3600000000 + extract(DAY FROM width) * 86400000000 AS BIGINT))"),
}
#: Over the views ``vectors(id, embedding)`` and ``postings(term, id, tf, len)`` with ``text_stats(docs, mean)`` of one field.
TABLE = {
    "knn": ("q ARRAY<DOUBLE>, k INT", "id STRING, score DOUBLE", "SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rn FROM (SELECT CAST(id AS STRING) AS id, l2_score(CAST(embedding AS ARRAY<DOUBLE>), q) AS score FROM vectors)) WHERE rn <= k"),
    "bm25": (
        "question STRING, k INT", "id STRING, score DOUBLE",
        """SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rn FROM (
 SELECT CAST(p.id AS STRING) AS id, sum(ln(1 + (s.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.mean))) AS score
 FROM postings p JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) d ON p.term = d.term CROSS JOIN text_stats s WHERE array_contains(tokens(question), p.term) GROUP BY p.id)) WHERE rn <= k""",
    ),
}


def register_functions(spark: SparkSession) -> SparkSession:
    """Make the scalar functions known to a session."""
    for name, (args, out, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    return spark


def register_table_functions(spark: SparkSession, names: tuple[str, ...] = tuple(TABLE)) -> SparkSession:
    """Make table functions known; the views they read have to exist."""
    register_functions(spark)
    for name in names:
        args, out, body = TABLE[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({out}) RETURN {body}")
    return spark
