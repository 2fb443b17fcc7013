"""The expansion of a graph from a work queue, joined up and resumable.

A run takes the next items of the queue, asks the service for their
successors, and works the answers into the registry: ids that the registry
lacks are recovered as titles, new titles go through the resolver, edges
through the grammar and the cycle rule, and nodes met for the first time join
the queue.  Registry and queue are committed together: their tables go to a
folder of their own, and a manifest that names it is moved into place last.
A run that dies between two commits leaves the last one; since asking is
repeatable and edges and nodes are added once, resuming gives the same result.

The items of one step see the registry as it was when the step began; a step
of one item is the strictly sequential order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import materialize
from ..sources.readers import exists
from ..sources.writers import overwrite, recovered
from . import graph, service
from .expand import fix_edge_types, settle_edges

NODE = "id string, type string, title string, aliases array<string>, description string, is_terminal boolean, pos long"
EDGE = "id string, from_id string, to_id string, edge_type string, is_common_route boolean"
QUEUE = "id string, depth int, pos long, expanded boolean"
ANSWER = "struct<is_terminal:boolean,successors:array<struct<existing_id:string,new_type:string,new_title:string,one_line_definition:string,edge_type:string,confidence:string>>>"


@dataclass
class State:
    nodes: DataFrame
    edges: DataFrame
    queue: DataFrame
    version: int = 0
    failures: int = 0


def load(spark: SparkSession, path: str) -> State:
    """The last commit."""
    manifest = json.loads(spark.read.text(recovered(spark, f"{path}/manifest")).first()[0])
    folder = f"{path}/v{manifest['version']}"
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return State(table("nodes", NODE), table("edges", EDGE), table("queue", QUEUE), manifest["version"], manifest["failures"])


def commit(state: State, path: str, keep: int = 2) -> State:
    """Write the next version and move its manifest into place; folders of
    versions before the last ``keep`` go."""
    spark, version = state.nodes.sparkSession, state.version + 1
    for name in ("nodes", "edges", "queue"):
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    row = json.dumps({"version": version, "failures": state.failures})
    overwrite(spark.createDataFrame([(row,)], "value string").coalesce(1), f"{path}/manifest", "text")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version - keep}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return load(spark, path)


def bootstrap(nodes: DataFrame, path: str, root: str, edges: DataFrame | None = None) -> bool:
    """Begin a registry with the seed ``nodes`` (id, type, title, aliases,
    description, in order of pos), their edges, and the root in the queue;
    False, and nothing written, where there is one already."""
    spark = nodes.sparkSession
    if exists(spark, recovered(spark, f"{path}/manifest")):
        return False
    seeds = graph.last_wins(nodes.select("id", "type", "title", "aliases", "description", F.lit(False).alias("is_terminal"), F.col("pos").cast("long").alias("pos")))
    queue = spark.range(1).select(F.lit(root).alias("id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("expanded"))
    first = spark.createDataFrame([], EDGE) if edges is None else edges.select(*[c.split()[0] for c in EDGE.split(", ")])
    commit(State(seeds, first, queue), path)
    return True


def _targets(answered: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, nth, existing, type, title, definition, edge_type, common) of
    every usable successor: ``existing`` where the registry has the id; an
    unknown id without a title gives its own words as one."""
    rows = answered.select("key", "item", F.posexplode("parsed.successors").alias("nth", "s")).select(
        F.col("key").alias("from_id"), "item", "nth", "s.*"
    )
    known = nodes.select(F.col("id").alias("existing_id"), F.lit(True).alias("known"))
    parent = nodes.select(F.col("id").alias("from_id"), F.col("type").alias("parent_type"), F.col("title").alias("parent_title"))
    rows = rows.join(known, "existing_id", "left").join(parent, "from_id")
    guessed = F.col("existing_id").isNotNull() & F.col("known").isNull() & F.col("new_title").isNull()
    guess = F.replace(F.regexp_replace("existing_id", "^[^:]*:", ""), F.lit("-"), F.lit(" "))
    rows = rows.select(
        "from_id", "item", "nth", "parent_type", "parent_title", F.when(F.col("known"), F.col("existing_id")).alias("existing"),
        F.when(guessed, F.coalesce("new_type", "parent_type")).otherwise(F.col("new_type")).alias("type"),
        F.when(guessed, guess).otherwise(F.col("new_title")).alias("title"),
        F.when(guessed, F.coalesce("one_line_definition", F.lit(""))).otherwise(F.col("one_line_definition")).alias("definition"),
        F.coalesce("edge_type", F.lit("progression")).alias("edge_type"), (F.coalesce("confidence", F.lit("common")) != "niche").alias("common"),
    )
    return rows.filter("existing IS NOT NULL OR (type IS NOT NULL AND title IS NOT NULL AND definition IS NOT NULL)")


def process(state: State, answered: DataFrame, resolver: Callable[[DataFrame, DataFrame], DataFrame], exam: str = "exam") -> State:
    """The registry and queue after the answers of one step: ``answered``
    (key, item, depth, answer) in order of ``item``, the answers JSON texts.

    ``resolver`` maps candidates (case_id, type, title, definition,
    parent_title) and the registry's nodes to (case_id, action, node_id,
    title), as ``resolve.resolve`` decides them."""
    parsed = materialize(answered.withColumn("parsed", F.from_json("answer", ANSWER)), "answered")
    order = Window.orderBy("item", "nth")  # successors of one step: a bounded number
    rows = _targets(parsed, state.nodes).withColumn("case_id", F.row_number().over(order).cast("long"))
    rows = materialize(rows, "successors")
    fresh = rows.filter("existing IS NULL").select("case_id", "type", "title", "definition", "parent_title")
    decided = materialize(resolver(fresh, state.nodes).select("case_id", "action", "node_id", F.col("title").alias("final_title")), "decided")
    top = F.coalesce(F.max("pos"), F.lit(0)).alias("top")
    minted = decided.filter("action = 'minted'").join(fresh.select("case_id", "type", "definition"), "case_id").groupBy(F.col("node_id").alias("id")).agg(
        F.min_by(F.struct("type", F.col("final_title").alias("title"), "definition", "case_id"), "case_id").alias("m")
    )
    new_nodes = minted.join(F.broadcast(state.nodes.agg(top))).select(
        "id", "m.type", "m.title", F.array().cast("array<string>").alias("aliases"), F.col("m.definition").alias("description"), F.lit(False).alias("is_terminal"),
        (F.col("top") + F.col("m.case_id")).alias("pos"),
    )
    ends = parsed.select(F.col("key").alias("id"), F.coalesce("parsed.is_terminal", F.lit(False)).alias("now"))
    nodes = state.nodes.join(ends, "id", "left").withColumn("is_terminal", F.coalesce("now", "is_terminal")).drop("now").unionByName(new_nodes)
    nodes = materialize(nodes, "nodes")

    linked = rows.join(decided.filter("action NOT IN ('rejected', 'rejected_aggregate')").select("case_id", "node_id"), "case_id", "left").withColumn(
        "to_id", F.coalesce("existing", "node_id")
    ).filter("to_id IS NOT NULL")
    kinds = nodes.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    typed = linked.join(kinds, "to_id").select(
        F.concat("from_id", F.lit("->"), "to_id").alias("id"), "from_id", "to_id", F.col("parent_type").alias("from_type"), "to_type", "edge_type",
        F.col("common").alias("is_common_route"), F.col("case_id").alias("pos"),
    )
    proposed = materialize(fix_edge_types(typed, exam=exam).drop("from_type", "to_type"), "proposed")
    # An edge that is there, or that an earlier successor proposes, is not inserted again.
    first = proposed.join(state.edges.select("id"), "id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("r = 1 AND from_id <> to_id").drop("r")
    settled = settle_edges(state.edges, materialize(first, "first"))
    edges = materialize(graph.insert_edges(state.edges, settled.select("from_id", "to_id", "edge_type", "is_common_route", "pos")), "edges")

    depths = parsed.select(F.col("key").alias("from_id"), "depth")
    met = typed.filter("NOT (from_type = '{0}' AND to_type = '{0}')".format(exam)).join(depths, "from_id").groupBy(F.col("to_id").alias("id")).agg(
        F.min_by(F.struct("depth", "pos"), "pos").alias("m")
    )
    last = F.coalesce(F.max("pos"), F.lit(0)).alias("last")
    queued = met.join(state.queue.select("id"), "id", "left_anti").join(F.broadcast(state.queue.agg(last))).select(
        "id", (F.col("m.depth") + 1).cast("int").alias("depth"), (F.col("last") + F.col("m.pos")).alias("pos"), F.lit(False).alias("expanded")
    )
    done = parsed.select(F.col("key").alias("id"), F.lit(True).alias("done"))
    queue = state.queue.join(done, "id", "left").withColumn("expanded", F.col("expanded") | F.coalesce("done", F.lit(False))).drop("done").unionByName(queued)
    return State(nodes, edges, materialize(queue, "queue"), state.version, state.failures)


def run(
    spark: SparkSession, path: str, ask: Callable[[str], str], resolver: Callable[[DataFrame, DataFrame], DataFrame],
    prompts: Callable[[DataFrame, State], DataFrame] | None = None, max_depth: int = 4, every: int = 20, limit: int | None = None,
    stop_after: int = service.STOP_AFTER, exam: str = "exam", **options,
) -> tuple[int, bool]:
    """Expand from the last commit until no item of the queue is shallower
    than ``max_depth``, or ``limit`` items were done; commits every ``every``
    items.  Returns how many were done and whether the service seemed down.

    ``ask`` answers a request (by default the id; ``prompts`` may map items
    (id, depth) and the state to (key, request)) with a JSON text.  An item
    that fails goes to the back of the queue; ``stop_after`` failures in a row,
    over steps, end the run after a commit."""
    state, done = load(spark, path), 0
    while limit is None or done < limit:
        take = every if limit is None else min(every, limit - done)
        known = state.nodes.select("id")
        step = state.queue.filter(~F.col("expanded") & (F.col("depth") < max_depth)).join(known, "id", "left_semi").orderBy("pos").limit(take)
        step = materialize(step.withColumn("item", F.row_number().over(Window.orderBy("pos"))), "step")
        requests = step.select(F.col("id").alias("key"), F.col("id").alias("request")) if prompts is None else prompts(step.select("id", "depth"), state)
        # The step's order and failures are looked at here; a task only answers.
        answers = service.answers(requests, ask, stop_after=1 << 30, **options)
        answered = materialize(step.select(F.col("id").alias("key"), "item", "depth", "pos").join(answers, "key"), "answers")
        outcome = [r.failed for r in answered.orderBy("item").select(F.col("error").isNotNull().alias("failed")).collect()]  # ``every`` at most
        if not outcome:
            return done, False
        down = False
        for at, failed in enumerate(outcome):
            state.failures = state.failures + 1 if failed else 0
            if state.failures >= stop_after:
                down, outcome = True, outcome[: at + 1]
                break
        answered = answered.filter(F.col("item") <= len(outcome))
        failed = answered.filter("error IS NOT NULL").select(F.col("key").alias("id"), "item")
        failures = state.failures
        state = process(state, answered.filter("error IS NULL").select("key", "item", "depth", "answer"), resolver, exam)
        last = state.queue.agg(F.max("pos").alias("last"))
        back = state.queue.join(failed, "id", "left").join(F.broadcast(last)).withColumn("pos", F.when(F.col("item").isNotNull(), F.col("last") + F.col("item")).otherwise(F.col("pos")))
        state.queue, state.failures = materialize(back.select("id", "depth", "pos", "expanded"), "queue"), 0 if down else failures
        state = commit(state, path)
        done += outcome.count(False)
        if down:
            return done, True
    return done, False


def context_tiers(nodes: DataFrame, trails: DataFrame, near: DataFrame) -> DataFrame:
    """(owner, tier, pos, id, line) for ``expand.context_slice``: a node
    itself, the trail that leads to it, its nearest by vector, and its type's
    cohort by id.  ``nodes`` (id, type, title), ``trails`` (id, trail), ``near``
    (q_id, id, rank); owners are the ids of ``trails``.

    The cohort is a join by type for the owners asked for (a step's items),
    and only its first ids, as many as a slice holds."""
    line = nodes.select("id", F.concat("id", F.lit(" | "), "title").alias("line"))
    owners = trails.select(F.col("id").alias("owner")).join(nodes.select(F.col("id").alias("owner"), "type"), "owner")
    own = owners.select("owner", F.lit(0).alias("tier"), F.lit(0).alias("pos"), F.col("owner").alias("id"))
    trail = trails.select(F.col("id").alias("owner"), F.posexplode("trail").alias("pos", "id")).select("owner", F.lit(1).alias("tier"), "pos", "id")
    nearest = near.select(F.col("q_id").alias("owner"), F.lit(2).alias("tier"), F.col("rank").alias("pos"), "id").join(owners.select("owner"), "owner", "left_semi")
    ranked = nodes.select("type", "id", F.row_number().over(Window.partitionBy("type").orderBy("id")).alias("pos")).filter("pos <= 300")
    cohort = owners.join(ranked, "type").select("owner", F.lit(3).alias("tier"), "pos", "id")
    return own.unionByName(trail).unionByName(nearest).unionByName(cohort).join(line, "id").select("owner", "tier", "pos", "id", "line")
