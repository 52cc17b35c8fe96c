"""The SQL front: a read-only guard, full SQL over the object views, and the small index-routed dialect."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Plan nodes of which a query may consist, as the parser builds them. Whatever is not here is refused.
_NODES = {
    "Project", "Filter", "UnresolvedHaving", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Join", "LateralJoin", "Union", "Intersect", "Except", "SubqueryAlias", "View",
    "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedWith", "WithWindowDefinition", "Window", "Generate",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedHint", "Pivot", "UnresolvedPivot", "UnPivot", "Unpivot", "Sample", "UnresolvedOrderBy", "AsOfJoin", "UnionLoop", "UnresolvedOffset",
}
#: Functions that call into the JVM, read files or sleep.
_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "read_files", "python_worker_logs", "current_user", "session_user", "user"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


def strip_fence(sql: str) -> str:
    """Remove a Markdown fence and closing semicolons from generated SQL."""
    m = re.search(r"```(?:sql)?\s*(.*?)```", sql, re.S | re.I)
    return (m[1] if m else sql).strip().rstrip(";").strip()


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _parts(name) -> list[str]:
    return [str(x).lower() for x in _list(name)]


def refusal(spark: SparkSession, sql: str, tables: Sequence[str] | None = None) -> str | None:
    """Why a statement isn't taken, or None: the whole plan is walked, subqueries and common tables included.

    It has to be one query of known nodes; relations have names of one part, among ``tables`` (if given) and the query's
    own common tables; functions that reach outside the engine are refused. Literals can hold any word.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(strip_fence(sql))
    except Exception as e:  # the parser's errors come wrapped in several classes
        if "Parse" in type(e).__name__ or "parse" in str(e).lower():
            return "it is not one query"
        raise
    allowed = None if tables is None else {t.lower() for t in tables}
    common: set[str] = set()
    relations: set[str] = set()
    stack, seen = [(plan, True)], 0
    while stack:
        node, is_plan = stack.pop()
        kind = _kind(node)
        seen += 1
        if is_plan:
            if kind not in _NODES:
                return f"{kind} is not part of a query"
            if kind == "UnresolvedRelation":
                parts = _parts(node.multipartIdentifier())
                if len(parts) != 1:
                    return f"{'.'.join(parts)} is not a table of this engine"
                relations.add(parts[0])
            elif kind == "UnresolvedTableValuedFunction":
                name = _parts(node.name())
                if len(name) != 1 or name[0] not in _TABLE_FUNCTIONS:
                    return f"the table function {'.'.join(name)} is not allowed"
            elif kind == "UnresolvedWith":
                for cte in _list(node.cteRelations()):
                    common.add(str(cte.productElement(0)).lower())
                    stack.append((cte.productElement(1), True))
            elif kind == "WithWindowDefinition":
                pass
            stack += [(e, False) for e in _list(node.expressions())]
            stack += [(c, True) for c in _list(node.children())]
        else:
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                name = _parts(node.nameParts()) if kind == "UnresolvedFunction" else [str(node.name().funcName()).lower()]
                if name[-1] in _FUNCTIONS or len(name) > 1 and name[:-1] not in (["builtin"], ["system", "builtin"]):
                    return f"the function {'.'.join(name)} is not allowed"
            elif "UDF" in kind or kind in ("CallMethodViaReflection", "Invoke", "StaticInvoke"):
                return f"{kind} is not allowed"
            if hasattr(node, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "DynamicPruningSubquery"):
                stack.append((node.query().plan() if kind == "InSubquery" else node.plan(), True))
            stack += [(c, False) for c in _list(node.children())]
    if allowed is not None and not relations <= allowed | common:
        return f"{', '.join(sorted(relations - allowed - common))}: no table of this engine"
    return None


def is_read_only(spark: SparkSession, sql: str, tables: Sequence[str] | None = None) -> bool:
    return refusal(spark, sql, tables) is None


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings, whose views nobody else sees and in which files can't be named as tables."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    return own


def _run(own: SparkSession, sql: str, tables: Sequence[str]) -> DataFrame:
    why = refusal(own, sql, tables)
    if why:
        raise ValueError(f"only a single SELECT or WITH query is allowed: {why}")
    return own.sql(strip_fence(sql))


def select(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a read-only query over ``tables``, in a session of its own."""
    own = _own_session(spark)
    for name, df in (tables or {}).items():
        own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return _run(own, sql, list(tables or {}))


def select_files(spark: SparkSession, sql: str, sf_dir: str, names: Sequence[str]) -> DataFrame:
    """Run a query over Parquet tables of a folder; columns and filters are pushed into the scans."""
    own = _own_session(spark)
    for n in names:
        own.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return _run(own, sql, names)


def stringify(df: DataFrame) -> DataFrame:
    """Every column as a string, as the remote interface sends it."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if not t.startswith(("array", "map", "struct")) else F.to_json(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


@dataclass(frozen=True)
class Statement:
    columns: tuple[str, ...]
    clauses: tuple[tuple[str, str, str], ...]
    limit: int | None
    order: tuple[str, bool] | None = None


_CLAUSE = re.compile(
    r"\s*(metadata\.\w+|keyword|content|importance|created_at|id)\s*(>=|<=|=|>|<|LIKE)\s*(?:'((?:[^']|'')*)'|([-+\d.eE]+))\s*(AND\b|ORDER\b|LIMIT\b|$)", re.I
)


def parse(sql: str) -> Statement:
    """The small dialect: ``SELECT cols FROM knowledge [WHERE a AND b ...] [ORDER BY col [DESC]] [LIMIT n]``.

    Anything else raises ``ValueError``; nothing is dropped silently.
    """
    m = re.fullmatch(r"\s*SELECT\s+(.+?)\s+FROM\s+(knowledge|objects)\b(.*)", sql.strip().rstrip(";"), re.I | re.S)
    if not m:
        raise ValueError("expected SELECT ... FROM knowledge")
    rest, clauses, limit, order = m[3].strip(), [], None, None
    if rest[:5].upper() == "WHERE":
        rest = rest[5:]
        while True:
            c = _CLAUSE.match(rest)
            if not c:
                raise ValueError(f"unsupported condition: {rest.strip()[:60]}")
            clauses.append((c[1].lower() if not c[1].lower().startswith("metadata.") else "metadata." + c[1][9:], c[2].upper(), c[3].replace("''", "'") if c[3] is not None else c[4]))
            rest = rest[c.end(5) :] if c[5].upper() == "AND" else rest[c.start(5) :]
            if c[5].upper() != "AND":
                break
    o = re.match(r"\s*ORDER\s+BY\s+(\w+)(?:\s+(ASC|DESC))?", rest, re.I)
    if o:
        order, rest = (o[1], (o[2] or "").upper() == "DESC"), rest[o.end() :]
    n = re.match(r"\s*LIMIT\s+(\d+)", rest, re.I)
    if n:
        limit, rest = int(n[1]), rest[n.end() :]
    if rest.strip():
        raise ValueError(f"unsupported: {rest.strip()[:60]}")
    return Statement(tuple(x.strip() for x in m[1].split(",")), tuple(clauses), limit, order)


def condition(field: str, op: str, value: str) -> Column:
    """One clause of the small dialect as a predicate."""
    text = value.strip("%")
    if field.startswith("metadata."):
        held = F.col("metadata")[field[9:]]
        return held.contains(text) if op == "LIKE" else held == value
    if field == "keyword":
        return F.exists("keywords", lambda k: F.contains(k, F.lit(text))) if op == "LIKE" else F.array_contains("keywords", value)
    if field == "content":
        return F.col("content").contains(text) if op == "LIKE" else F.col("content") == value
    right = F.lit(float(value)) if field == "importance" else F.lit(value).cast("timestamp") if field == "created_at" else F.lit(value)
    left = F.col(field)
    return {"=": left == right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def run(objects: DataFrame, sql: str) -> DataFrame:
    """Execute the small dialect: all conditions in one pushed-down filter."""
    s = parse(sql)
    for c in s.clauses:
        objects = objects.where(condition(*c))
    if s.order:
        objects = objects.orderBy(F.desc(s.order[0]) if s.order[1] else F.asc(s.order[0]), "id")
    if s.limit is not None:
        objects = objects.limit(s.limit)
    return objects if s.columns == ("*",) else objects.select(*s.columns)
