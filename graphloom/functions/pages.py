"""Text that pages and prompts are made of, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text


def metadata(nodes: DataFrame, site: str) -> DataFrame:
    """(id, page_title, keywords, canonical) of ``nodes`` (id, type, title,
    aliases)."""
    words = F.array_append(F.concat(F.array("title"), "aliases"), text.humanize("type"))
    return nodes.select(
        "id",
        F.concat("title", F.lit(f" | {site}")).alias("page_title"),
        F.array_join(words, ", ").alias("keywords"),
        F.concat(F.lit(f"https://{site}"), text.node_href("id")).alias("canonical"),
    )


def article(headline, published, modified, built) -> Column:
    """A structured-data article as JSON that can stand inside a script
    element; missing dates fall back to the build's."""
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), headline.alias("headline"),
        F.coalesce(published, built).alias("datePublished"), F.coalesce(modified, published, built).alias("dateModified"),
    )
    return F.replace(F.to_json(doc), F.lit("<"), F.lit("\\u003c"))


def neighbour_titles(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(id, parents, children): JSON lists of up to ``limit`` titles on either
    side, in order; a hub's other neighbours are cut before they meet."""
    name = nodes.select("id", "title")

    def side(mine: str, other: str, label: str) -> DataFrame:
        pairs = edges.select(F.col(mine).alias("node"), F.col(other).alias("id")).join(name, "id")
        order = Window.partitionBy("node").orderBy("title", "id")
        first = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
        return first.groupBy(F.col("node").alias("id")).agg(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"])).alias(label)
        )

    none = lambda c: F.coalesce(c, F.lit("[]")).alias(c)
    return (
        nodes.select("id").join(side("to_id", "from_id", "parents"), "id", "left")
        .join(side("from_id", "to_id", "children"), "id", "left")
        .select("id", none("parents"), none("children"))
    )


def expansion_prompt(title, definition, trail: Column, known: Column, instruction: str) -> Column:
    """The prompt that asks for a node's successors: what it is, the way from
    the root (array of titles) and the lines of the graph around it (array)."""
    part = lambda label, body: F.concat(F.lit(f"{label}: "), body)
    return F.concat_ws(
        "\n\n", F.lit(instruction), part("NODE", title),
        F.when(F.coalesce(text.strip(definition), F.lit("")) != "", part("DEFINITION", text.strip(definition))),
        F.when(F.size(trail) > 0, part("WAY FROM THE START", F.array_join(trail, " → "))),
        F.concat(F.lit("ALREADY KNOWN:\n"), F.array_join(known, "\n")),
    )


def sitemap(nodes: DataFrame, site: str, static: list[str], guides: DataFrame | None = None, built: str | None = None) -> DataFrame:
    """(url, lastmod): the static paths, the nodes (id, changed) and the guides
    (slug, changed); an unreadable date falls back to the build's."""
    day = lambda c: F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(built).cast("string"))
    spark = nodes.sparkSession
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(f"https://{site}{x}") for x in static])).alias("url"), F.lit(built).cast("string").alias("lastmod"))
    out = fixed.unionByName(nodes.select(F.concat(F.lit(f"https://{site}"), text.node_href("id")).alias("url"), day(F.col("changed")).alias("lastmod")))
    if guides is not None:
        out = out.unionByName(guides.select(F.concat(F.lit(f"https://{site}/guides/"), "slug").alias("url"), day(F.col("changed")).alias("lastmod")))
    return out


def explorer_metadata(nodes: DataFrame, site: str) -> DataFrame:
    """(id, page_title, description, robots, canonical) of the explorer's page
    of each node, which points to the node's own page and is not indexed."""
    return nodes.select(
        "id", F.concat(F.lit("Explore paths around "), "title", F.lit(f" — {site}")).alias("page_title"),
        F.concat(F.lit("Explore routes into and career options after "), "title", F.lit(".")).alias("description"),
        F.lit("noindex, follow").alias("robots"), text.node_href("id").alias("canonical"),
    )


def markdown_section(body, heading: str) -> Column:
    """The text under a second-level heading, up to the next one."""
    found = F.regexp_extract(body, rf"(?ms)^## {heading}[^\n]*\n(.*?)(?=^## |\Z)", 1)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def pane_height(width, height) -> Column:
    """The height of a map's pane: scaled to its width, within limits."""
    scaled = height * F.least(F.lit(1.0), F.lit(660.0) / width)
    return F.round(F.least(F.greatest(scaled, F.lit(240.0)), F.lit(520.0))).cast("int")


def rubric(type_a, title_a, type_b, title_b) -> Column:
    """struct(decision, rule): the rubric's rules that need no judgement, in
    its order; what none decides is distinct by rule 12, for review."""
    slug_a, slug_b = text.slugify(title_a), text.slugify(title_b)
    bag = lambda s: F.array_sort(F.split(s, "-"))
    say = lambda decision, rule: F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule"))
    same = type_a == type_b
    return (
        F.when(same & (slug_a == slug_b), say("same_role", 1))
        .when(same & (bag(slug_a) == bag(slug_b)), say("same_role", 2))
        .when(text.is_bare_generic(title_a) | text.is_bare_generic(title_b), say("distinct", 6))
        .when(text.level_tokens(title_a) != text.level_tokens(title_b), say("distinct", 7))
        .when(text.looks_aggregate(title_a) | text.looks_aggregate(title_b), say("excluded", 10))
        .when(~same, say("distinct", 11))
        .otherwise(say("distinct", 12))
    )
