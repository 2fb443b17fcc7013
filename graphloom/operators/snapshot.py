"""Snapshots: core and documents, digests, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import lint


class InvalidSnapshot(ValueError):
    pass


def core(nodes: DataFrame) -> DataFrame:
    """Nodes with their slug and without facts."""
    return nodes.withColumn("slug", text.id_slug("id")).drop("facts")


def document_name(node_type: str, node_id: str) -> Column:
    return F.concat(node_type, F.lit("--"), text.id_slug(node_id), F.lit(".json"))


def documents(nodes: DataFrame) -> DataFrame:
    """(name, facts) of the nodes that have facts."""
    return nodes.filter("facts IS NOT NULL").select(
        document_name("type", "id").alias("name"), "facts"
    )


def with_facts(core_nodes: DataFrame, facts: DataFrame) -> DataFrame:
    return core_nodes.join(facts.select("id", "facts"), "id", "left")


def facts_at(wanted: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """``wanted`` (node_id, ...) with the ``facts`` of the document that
    ``kept`` (name, facts) holds for it: null where the graph has no such node
    or the node no document.  Names come from the graph's node, never from the
    id that was asked for."""
    named = nodes.select(F.col("id").alias("node_id"), document_name("type", "id").alias("name"))
    return wanted.join(named.join(kept, "name").select("node_id", "facts"), "node_id", "left")


def checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same tables; raises at the first rule that does not hold."""
    for found in (lint.bad_ids(nodes), lint.missing_endpoints(nodes, edges)):
        first = found.first()
        if first is not None:
            raise InvalidSnapshot(f"{first.rule}: {first.subject}")
    return nodes, edges


def digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: counts and sums of two
    row hashes, so that no rows meet in one task."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string")
    return df.agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), wide(1), wide(2)), 256)).first()[0]


def difference(expected: DataFrame, stored: DataFrame, key: str = "name", value: str = "digest") -> DataFrame:
    """(name, state): missing, extra or changed documents."""
    e = expected.select(key, F.col(value).alias("e"))
    s = stored.select(key, F.col(value).alias("s"))
    state = F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("s"), "changed")
    return e.join(s, key, "full_outer").select(key, state.alias("state")).filter("state IS NOT NULL")
