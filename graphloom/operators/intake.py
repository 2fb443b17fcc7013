"""Submissions: validation, decisions and the rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import STABLE_ID
from . import graph

WINDOW_MS = 60_000
PER_WINDOW = 5


def _between(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.char_length(strip(c)).between(low, high), F.lit(False))


def valid_suggestion(parent_id: Column, title: Column, description: Column, id_pattern: str = STABLE_ID) -> Column:
    return F.coalesce(parent_id.rlike(id_pattern), F.lit(False)) & _between(title, 5, 100) & _between(description, 10, 1000)


def valid_edit(target_id: Column, title: Column, description: Column, aliases: Column, id_pattern: str = STABLE_ID) -> Column:
    names = (F.size(aliases) <= 25) & F.forall(aliases, lambda a: F.char_length(strip(a)).between(1, 150))
    return (
        F.coalesce(target_id.rlike(id_pattern), F.lit(False)) & _between(title, 2, 150) & _between(description, 10, 4000)
        & F.coalesce(names, F.lit(False))
    )


def unknown_keys(raw: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON text beyond the allowed ones (null: no object)."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in allowed]))


#: Keys that a submission's body, and an edit's proposed data, may have.
SUGGESTION_KEYS = ["parentNodeId", "title", "description"]
EDIT_KEYS = ["targetNodeId", "proposedData"]
PROPOSED_KEYS = ["title", "description", "aliases"]


def _strict(rows: DataFrame, edit: bool = False) -> Column:
    """Whether the body (column ``raw``, where there is one) is an object
    without keys beyond the known ones."""
    if "raw" not in rows.columns:
        return F.lit(True)
    raw = F.col("raw")
    fine = F.size(unknown_keys(raw, EDIT_KEYS if edit else SUGGESTION_KEYS)) == 0
    if edit:
        fine = fine & (F.size(unknown_keys(F.get_json_object(raw, "$.proposedData"), PROPOSED_KEYS)) == 0)
    return F.coalesce(fine, F.lit(False))


def after_sink(decided: DataFrame, failed: DataFrame) -> DataFrame:
    """``decided`` (req_id, status, ...) once the accepted ones were written:
    those that the sink refused (``failed``: req_id) end as 500."""
    lost = failed.select("req_id").distinct().withColumn("lost", F.lit(True))
    status = F.when((F.col("status") == 200) & F.col("lost"), 500).otherwise(F.col("status"))
    return decided.join(lost, "req_id", "left").withColumn("status", status).drop("lost")


def decide_suggestions(rows: DataFrame, nodes: DataFrame, edges: DataFrame, id_pattern: str = STABLE_ID) -> DataFrame:
    """``rows`` (req_id, allowed, well_formed, parent_id, title, description,
    and raw, the body's text, if unknown keys are to be refused) with the
    status that each gets, first reason first."""
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    twin = graph.has_child_title(rows.select("req_id", "parent_id", "title"), nodes, edges).select("req_id", F.lit(True).alias("twin"))
    ok = valid_suggestion(F.col("parent_id"), F.col("title"), F.col("description"), id_pattern)
    status = (
        F.when(~F.col("allowed"), 429).when(~F.col("well_formed"), 400).when(~(ok & _strict(rows)), 400)
        .when(F.col("known").isNull(), 400).when(F.col("twin").isNotNull(), 409).otherwise(200)
    )
    return rows.join(known, "parent_id", "left").join(twin, "req_id", "left").select("req_id", status.alias("status"))


def accepted_suggestions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Moderation rows of the accepted ones."""
    return rows.join(decided.filter("status = 200").select("req_id"), "req_id", "left_semi").select(
        F.col("parent_id").alias("parent_node_id"), strip("title").alias("suggested_name"),
        strip("description").alias("suggested_description"), F.lit("pending_review").alias("status"),
    )


def decide_edits(rows: DataFrame, nodes: DataFrame, id_pattern: str = STABLE_ID) -> DataFrame:
    """``rows`` (req_id, allowed, well_formed, target_id, title, description,
    aliases, and raw as for suggestions) against ``nodes`` (id, title,
    description, aliases): the status, and for accepted ones the ``original``
    that goes into the moderation row beside the proposal."""
    old = nodes.select(F.col("id").alias("target_id"), F.struct("title", "description", "aliases").alias("original"))
    ok = valid_edit(F.col("target_id"), F.col("title"), F.col("description"), F.col("aliases"), id_pattern)
    proposed = F.struct(
        strip("title").alias("title"), strip("description").alias("description"),
        F.transform("aliases", strip).alias("aliases"),
    )
    status = (
        F.when(~F.col("allowed"), 429).when(~F.col("well_formed"), 400).when(~(ok & _strict(rows, edit=True)), 400)
        .when(F.col("original").isNull(), 400).when(F.col("original").eqNullSafe(proposed), 409).otherwise(200)
    )
    out = rows.join(old, "target_id", "left").select("req_id", status.alias("status"), "original")
    return out.withColumn("original", F.when(F.col("status") == 200, F.col("original")))


class Limiter:
    """The state of one key: when its window began and how many calls it saw."""

    def __init__(self, limit: int, window_ms: int, start: int | None = None, count: int = 0) -> None:
        self.limit, self.window_ms, self.start, self.count = limit, window_ms, start, count

    def allows(self, ms: int) -> bool:
        if self.start is None or ms - self.start >= self.window_ms:
            self.start, self.count = ms, 0
        self.count += 1
        return self.count <= self.limit


def rate_limit(requests: DataFrame, limit: int = PER_WINDOW, window_ms: int = WINDOW_MS) -> DataFrame:
    """(req_id, allowed) of ``requests`` (key, req_id, ms): a window begins at
    a key's first request and resets once its length has passed; rejected
    requests count too.

    An ordered fold: Spark deals and sorts the keys, and each task walks its
    rows in batches with the state of one key at a time, so a busy key costs
    time but no memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Limiter(limit, window_ms)
        for batch in batches:
            out = []
            for k, ms in zip(batch["key"], batch["ms"]):
                if k != key:
                    key, state = k, Limiter(limit, window_ms)
                out.append(state.allows(ms))
            yield pd.DataFrame({"req_id": batch["req_id"], "allowed": out})

    ordered = requests.select("key", "ms", "req_id").repartition("key").sortWithinPartitions("key", "ms", "req_id")
    return ordered.mapInPandas(fold, "req_id long, allowed boolean")
