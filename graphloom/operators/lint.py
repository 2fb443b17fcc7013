"""Constraints as violation queries: what they return breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import materialize
from .traverse import cyclic_core, unreachable


def _rows(df: DataFrame, severity: str, rule: str, subject) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.alias("subject"))


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lost = None
    for end in ("from_id", "to_id"):
        one = edges.select("id", end).filter(F.col(end).isNotNull()).join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        one = one.unionByName(edges.filter(F.col(end).isNull()).select("id", end)).select("id")
        lost = one if lost is None else lost.unionByName(one)
    return _rows(lost.distinct(), "error", "unknown endpoint", F.col("id"))


def _each(rows: DataFrame, subject, *rules) -> DataFrame:
    """One pass over the rows: (severity, rule, subject) for each of ``rules``
    (condition, severity, rule) that holds."""
    found = [
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for c, severity, rule in rules
    ]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("v"), subject.alias("subject")).select("v.*", "subject")


def grammar(nodes: DataFrame, edges: DataFrame, exam: str = "exam") -> DataFrame:
    kind = nodes.select("id", "type")
    typed = edges.join(kind.select(F.col("id").alias("from_id"), F.col("type").alias("f")), "from_id").join(
        kind.select(F.col("id").alias("to_id"), F.col("type").alias("t")), "to_id"
    )
    either = (F.col("f") == exam) | (F.col("t") == exam)
    both = (F.col("f") == exam) & (F.col("t") == exam)
    return _each(typed, F.col("id"), (either != (F.col("edge_type") == "exam_gate"), "error", "edge grammar"), (both, "error", "exam to exam"))


def titles(nodes: DataFrame) -> DataFrame:
    return _each(
        nodes, F.col("id"), (F.contains("title", F.lit("|")), "error", "pipe in title"),
        (F.col("title").rlike(r"\s{2,}"), "warning", "doubled white space"),
    )


def slug_collisions(nodes: DataFrame) -> DataFrame:
    slugs = nodes.groupBy("type", text.slugify("title").alias("slug")).count().filter("count > 1")
    return _rows(slugs, "error", "slug collision", F.concat("type", F.lit(":"), "slug"))


def bad_ids(nodes: DataFrame) -> DataFrame:
    """Ids whose prefix is not the type, or that repeat."""
    wrong = _rows(nodes.filter((text.id_type("id") != F.col("type")) | (text.id_slug("id") == "")), "error", "id does not fit", F.col("id"))
    twice = _rows(nodes.groupBy("id").count().filter("count > 1"), "error", "repeated id", F.col("id"))
    return wrong.unionByName(twice)


def orphans(nodes: DataFrame, edges: DataFrame, root: str, exempt: str = "exam", release: bool = False) -> DataFrame:
    lost = unreachable(nodes.filter(F.col("type") != exempt), edges, root)
    return _rows(lost, "error" if release else "warning", "not reachable", F.col("id"))


def progression_cycles(edges: DataFrame) -> DataFrame:
    return _rows(cyclic_core(edges.filter("edge_type = 'progression'")), "error", "progression cycle", F.col("id"))


def release_gates(nodes: DataFrame, root: str, frontier: DataFrame | None = None, failures: DataFrame | None = None, max_depth: int = 4) -> DataFrame:
    """What a release may not have: no root, nodes without facts, work left
    above ``max_depth`` in ``frontier`` (id, depth, expanded), unresolved rows
    in ``failures`` (node_id).  Nodes without a column ``facts`` are not asked
    for any."""
    here = nodes.filter(F.col("id") == root).agg(F.count("*").alias("n"))
    out = _rows(here.filter("n = 0"), "error", "root is missing", F.lit(root))
    if "facts" in nodes.columns:
        out = out.unionByName(_rows(nodes.filter("facts IS NULL"), "error", "missing facts", F.col("id")))
    if frontier is not None:
        pending = frontier.filter(~F.col("expanded") & (F.col("depth") < max_depth))
        out = out.unionByName(_rows(pending, "error", "frontier work left", F.col("id")))
    if failures is not None:
        out = out.unionByName(_rows(failures, "error", "unresolved failure", F.col("node_id")))
    return out


def fact_gates(facts: DataFrame) -> DataFrame:
    """Uncited parts and unsupported section keys of ``facts`` (node_id, type,
    facts)."""
    uncited = lambda x: F.coalesce(F.size(x["source_urls"]), F.lit(0)) == 0
    f = F.col("facts")
    return _each(
        facts, F.col("node_id"), (F.exists(f["quick_facts"], uncited), "error", "quick fact without sources"),
        (F.exists(f["sections"], uncited), "error", "section without sources"),
        (F.exists(f["sections"], lambda x: ~F.array_contains(text.allowed_keys("type"), x["key"])), "error", "unsupported section"),
    )


def constraints(rows: DataFrame, key: list[str], not_null: list[str] = (), checks: dict[str, str] | None = None) -> DataFrame:
    """Rows that break a table's constraints: a repeated or null key, a null in
    a column that may have none, a check (rule: SQL condition) that is false."""
    subject = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    twice = _rows(rows.groupBy(*key).count().filter("count > 1"), "error", "repeated key", subject)
    nulls = [(F.col(c).isNull(), "error", f"null in {c}") for c in dict.fromkeys([*key, *not_null])]
    wrong = [(~F.expr(sql), "error", rule) for rule, sql in (checks or {}).items()]
    return twice.unionByName(_each(rows, subject, *nulls, *wrong))


def not_empty(**tables: DataFrame) -> DataFrame:
    """Post-condition of a reset: tables that still hold rows."""
    out = None
    for name, df in tables.items():
        one = _rows(df.agg(F.count("*").alias("n")).filter("n > 0"), "error", "table is not empty", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def report(
    nodes: DataFrame, edges: DataFrame, root: str, exam: str = "exam", release: bool = False,
    frontier: DataFrame | None = None, failures: DataFrame | None = None,
) -> DataFrame:
    """All violations as (severity, rule, subject); a release has its gates
    besides."""
    # Read once: every rule below works on these few columns.
    facts = nodes.select("id", F.col("id").alias("node_id"), "type", "facts") if release and "facts" in nodes.columns else None
    nodes = materialize(nodes.select("id", "type", "title", *(["facts"] if facts is not None else [])), "lint-nodes")
    edges = materialize(edges.select("id", "from_id", "to_id", "edge_type"), "lint-edges")
    parts = [
        missing_endpoints(nodes, edges), grammar(nodes, edges, exam), titles(nodes), slug_collisions(nodes), bad_ids(nodes),
        orphans(nodes, edges, root, exam, release), progression_cycles(edges),
    ]
    if release:
        parts.append(release_gates(nodes, root, frontier, failures))
        if facts is not None:
            parts.append(fact_gates(facts))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(violations: DataFrame) -> DataFrame:
    """Number and first subject of each (severity, rule): no more than the
    rules there are, which are looked up first, so that a task keeps one row a
    rule and sorts none."""
    violations = materialize(violations, "violations")
    rules = violations.select("severity", "rule").distinct().collect()
    if not rules:
        return violations.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.min("subject").alias("first"))
    one = []
    for r in rules:
        here = F.col("severity").eqNullSafe(F.lit(r.severity)) & F.col("rule").eqNullSafe(F.lit(r.rule))
        one.append((F.lit(r.severity).alias("severity"), F.lit(r.rule).alias("rule"), F.count_if(here), F.min(F.when(here, F.col("subject")))))
    counted = violations.agg(*[c for i, (_, _, n, first) in enumerate(one) for c in (n.alias(f"n{i}"), first.alias(f"first{i}"))])
    rows = [F.struct(s, rule, F.col(f"n{i}").alias("n"), F.col(f"first{i}").alias("first")) for i, (s, rule, _, _) in enumerate(one)]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def exit_code(violations: DataFrame) -> int:
    return int(not violations.filter("severity = 'error'").isEmpty())
