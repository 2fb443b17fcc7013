"""Strongly connected components and reachability labels.

All state is a row a node or a row an edge: nothing is kept a pair of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Hash orders whose minima over what a node reaches are kept.
ORDERS = 4


#: Rounds of trimming before runs are looked for, and the share of nodes (one
#: in so many) that must lie in runs for these to be contracted.
TRIMS, IN_RUNS = 3, 8


def trimmed(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``edges`` (a, b) without nodes that have no edge in or none out, again
    and again (``rounds`` times): what lies on or between cycles."""
    left, size = edges, edges.count()
    while size and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        sources = left.select(F.col("a").alias("b")).distinct()
        targets = left.select(F.col("b").alias("a")).distinct()
        left = materialize(left.join(targets, "a", "left_semi").join(sources, "b", "left_semi").select("a", "b"), "core")
        now = left.count()
        if now == size:
            break
        size = now
    return left


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mark) at the fixpoint: every node takes the least mark among its
    own and those of the nodes with an edge to it.  Only nodes whose mark fell
    in one round speak in the next."""
    marks, changed = start, start
    while True:
        told = changed.join(edges, changed["id"] == edges["a"]).groupBy(F.col("b").alias("id")).agg(F.min("mark").alias("told"))
        news = materialize(told.join(marks, "id").filter("told < mark").select("id", F.col("told").alias("mark")), "news")
        if news.isEmpty():
            return marks
        marks = materialize(marks.join(news.withColumnRenamed("mark", "new"), "id", "left").select("id", F.coalesce("new", "mark").alias("mark")), "marks")
        changed = news


def _back_to(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that reach one of ``roots`` (id) over ``edges`` (a, b)."""
    known = level = roots
    while True:
        step = level.join(edges, level["id"] == edges["b"]).select(F.col("a").alias("id")).distinct()
        level = materialize(step.join(known, "id", "left_anti"), "back")
        if level.isEmpty():
            return known
        known = materialize(known.unionByName(level), "back-known")


def _runs(left: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Where the only way out of nodes with one edge leads, found by doubling:
    tables (id, to) of 1, 2, 4, ... steps, no further than the first node with
    another number of edges (``ends``), and the last table.  It has ``least``
    besides: the smallest id passed, that of the ring for a node in one.

    Done when a round finds no more ends, as those of a longer run follow
    those of shorter ones, leads to as many nodes as the round before, which
    then are those of rings, and lowers no ``least``."""
    one = left.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).filter("n = 1")
    now = materialize(one.select(F.col("a").alias("id"), "to", F.col("a").alias("least"), F.lit(False).alias("ends")), "runs")
    jumps, before = [now], None
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("other"), F.col("ends").alias("there"))
        lower = F.coalesce(F.col("other") < F.col("least"), F.lit(False))
        now = materialize(
            now.join(ahead, "to", "left").select(
                "id", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("other", "least")).alias("least"),
                (F.col("next").isNull() | F.col("there")).alias("ends"), lower.alias("fell"),
            ),
            "runs",
        )
        on = ~F.col("ends")
        seen = now.agg(F.count_if("ends").alias("ends"), F.count_if(on & F.col("fell")).alias("fell"), F.count_distinct(F.when(on, F.col("to"))).alias("led_to")).first()
        if before is not None and not seen["fell"] and (seen["ends"], seen["led_to"]) == (before["ends"], before["led_to"]):
            return jumps, now
        jumps.append(now.select("id", "to"))
        before = seen


def _through_runs(left: DataFrame) -> DataFrame:
    """(id, component) with the trees of nodes of one edge out drawn into
    their roots.  A node of a tree is in its root's component if something in
    that component has an edge to it or to a node that leads to it; nodes whose
    only way is round a ring are the ring's component."""
    jumps, last = _runs(left)
    rings = last.filter("NOT ends").select(F.col("to").alias("id")).distinct().join(last.select("id", F.col("least").alias("component")), "id")
    from_roots = left.join(jumps[0].select(F.col("id").alias("a")), "a", "left_anti")
    trees = last.select(F.col("id").alias("b"), F.col("to").alias("root"), "ends")
    drawn = from_roots.join(trees, "b", "left").filter("coalesce(ends, true)").select("a", "b", F.coalesce("root", "b").alias("root"))
    drawn = materialize(drawn, "drawn")
    small = materialize(drawn.select("a", F.col("root").alias("b")).distinct(), "drawn")
    found = _strong(small.filter("a <> b"))
    loops = small.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = materialize(found.unionByName(loops.join(found, "id", "left_anti")), "components")
    of = lambda side, name: found.select(F.col("id").alias(side), F.col("component").alias(name))
    marks = drawn.filter("b <> root").join(of("a", "component"), "a").join(of("root", "other"), "root").filter("component = other")
    marks = materialize(marks.select(F.col("b").alias("id"), "component").distinct(), "marks")
    if not marks.isEmpty():
        for jump in jumps:
            further = marks.join(jump, "id").select(F.col("to").alias("id"), "component")
            marks = materialize(marks.unionByName(further).distinct(), "marks")
    return materialize(found.unionByName(marks).unionByName(rings).distinct(), "components")


def _strong(left: DataFrame) -> DataFrame:
    """(id, component) of the nodes on a cycle of ``left`` (a, b: distinct, no
    loops), the component named by one of its ids."""
    left = trimmed(left, TRIMS)
    for turned in (left, left.select(F.col("b").alias("a"), F.col("a").alias("b"))):
        ways = turned.groupBy("a").count().agg(F.count("*").alias("n"), F.count_if(F.col("count") == 1).alias("single")).first()
        if ways["single"] * IN_RUNS > ways["n"]:
            return _through_runs(turned)
    return _coloured(left)


def _coloured(left: DataFrame) -> DataFrame:
    """Forward-backward colouring: each node takes the smallest id that reaches
    it; a node of its own colour, and what leads back to it inside the colour,
    are one component.  Edges between colours are on no cycle and go, as do
    found components, and the rest is coloured again."""
    found = left.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    while True:
        left = trimmed(left)
        if left.isEmpty():
            break
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        colour = materialize(_spread(materialize(ids.withColumn("mark", F.col("id")), "marks"), left), "colour")
        of = lambda side: colour.select(F.col("id").alias(side), F.col("mark").alias(f"colour_{side}"))
        same = materialize(left.join(of("a"), "a").join(of("b"), "b").filter("colour_a = colour_b").select("a", "b"), "same")
        members = materialize(_back_to(colour.filter("id = mark").select("id"), same), "members")
        # A root without a way back is alone, and on no cycle.
        alive = same.join(members.withColumnRenamed("id", "a"), "a", "left_semi").join(members.withColumnRenamed("id", "b"), "b", "left_semi")
        on_cycle = alive.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = found.unionByName(on_cycle.join(colour, "id").select("id", F.col("mark").alias("component")))
        left = materialize(
            same.join(members.withColumnRenamed("id", "a"), "a", "left_anti").join(members.withColumnRenamed("id", "b"), "b", "left_anti"), "pairs"
        )
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on a cycle; the component is named by
    its smallest id.  Nodes on no cycle have no row.

    Nodes with one edge out, or one in, are drawn into where it leads, as long
    as many are left: a ring or a chain takes rounds by the logarithm of its
    length.  What remains is coloured.

    ``edges``: (from_id, to_id, ...); null ends and repeats change nothing, a
    loop is a component of one node."""
    pairs = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    # An edge to a node without a way out is on no cycle.
    starts = pairs.select(F.col("a").alias("b")).distinct()
    pairs = materialize(pairs.join(starts, "b", "left_semi").select("a", "b").distinct(), "pairs")
    found = _strong(pairs.filter("a <> b"))
    loops = pairs.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = materialize(found.unionByName(loops.join(found, "id", "left_anti")), "components")
    names = found.groupBy("component").agg(F.min("id").alias("name"))
    return materialize(found.join(names, "component").select("id", F.col("name").alias("component")), "components")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b): the acyclic graph of components; nodes on no cycle are
    components of their own.  Its edges come as often as they do in ``edges``."""
    of = lambda side, name: components.select(F.col("id").alias(side), F.col("component").alias(name))
    named = edges.select("from_id", "to_id").join(of("from_id", "ca"), "from_id", "left").join(of("to_id", "cb"), "to_id", "left")
    return named.select(F.coalesce("ca", "from_id").alias("a"), F.coalesce("cb", "to_id").alias("b")).filter("a <> b")


class Reach:
    """Answers to questions "does x reach y" over ``edges`` (from_id, to_id).

    Inside a strong component the answer is yes; of two nodes that an edge
    joins it is yes along the edge, and against it no unless one component
    holds both.  For what is left, the edges that may lie between an x and a y
    get labels that decide most questions.

    A label holds the node's component, its level (longest way from a source
    of the condensed graph), the minima of ``ORDERS`` hashes over all that it
    reaches, and its interval in a spanning forest.  x reaches y only if its
    level is lower and none of its minima is higher; it does if y's interval
    lies in x's.  What neither settles is searched for, backwards from y, only
    through nodes that those tests leave open."""

    def __init__(self, edges: DataFrame):
        self.edges = materialize(edges.select("from_id", "to_id").filter("from_id IS NOT NULL AND to_id IS NOT NULL"), "edges")
        self.components = strong_components(self.edges)

    def _between(self, open_: DataFrame) -> DataFrame:
        """Edges (a, b) of the condensed graph without those that lead to a
        node that has no way out and is no y, or come from one that has no way
        in and is no x, ``TRIMS`` times: what no way from an x to a y takes."""
        left, size = condensed(self.edges, self.components), None
        for _ in range(TRIMS):
            starts = left.select(F.col("a").alias("b")).unionByName(open_.select(F.col("yc").alias("b"))).distinct()
            left = materialize(left.join(starts, "b", "left_semi").select("a", "b"), "between")
            targets = left.select(F.col("b").alias("a")).unionByName(open_.select(F.col("xc").alias("a"))).distinct()
            left = materialize(left.join(targets, "a", "left_semi").select("a", "b").distinct(), "between")
            now = left.count()
            if now == size:
                break
            size = now
        return left

    def _levels(self) -> tuple[DataFrame, DataFrame, int]:
        """(a, b, level of a) of all edges and (id, level) of all nodes."""
        left, edges, depth = self.dag.select("a", "b"), None, 0
        while True:
            # What no edge that is left leads to is of this level; its edges go.
            led_to = left.select(F.col("b").alias("a"), F.lit(True).alias("stays")).distinct()
            split = materialize(left.join(led_to, "a", "left"), "dag-left")
            gone = split.filter("stays IS NULL").select("a", "b", F.lit(depth).alias("la"))
            edges = gone if edges is None else edges.unionByName(gone)
            left = split.filter("stays").select("a", "b")
            if left.isEmpty():
                break
            depth += 1
            if depth % 16 == 0:
                edges = materialize(edges, "dag-leveled")
        edges = materialize(edges, "dag-leveled")
        nodes = edges.select(F.col("a").alias("id"), F.col("la").alias("level")).unionByName(edges.select(F.col("b").alias("id"), (F.col("la") + 1).alias("level")))
        return edges, nodes.groupBy("id").agg(F.max("level").alias("level")), depth + 2

    def _labels(self) -> DataFrame:
        edges, levels, depth = self._levels()
        up = self.dag.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        own = [F.xxhash64(F.lit(i), "id").alias(f"h{i}") for i in range(ORDERS)]
        nodes = materialize(levels.join(up, "id", "left").select("id", "level", "parent", *own), "dag-labels")
        hashes = [f"h{i}" for i in range(ORDERS)]
        done = None  # (id, parent, hashes, size) of deeper levels
        for at in range(depth - 1, -1, -1):
            here = nodes.filter(F.col("level") == at).withColumn("size", F.lit(1).cast("long"))
            if done is not None:
                below = edges.filter(F.col("la") == at).join(done.select(F.col("id").alias("b"), *hashes), "b").groupBy(F.col("a").alias("id")).agg(
                    *[F.min(h).alias(f"m{h}") for h in hashes]
                )
                kids = done.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("kids"))
                here = here.join(below, "id", "left").join(kids, "id", "left").select(
                    "id", "level", "parent", *[F.least(h, F.coalesce(f"m{h}", h)).alias(h) for h in hashes], (F.col("size") + F.coalesce("kids", F.lit(0))).alias("size")
                )
            here = materialize(here, "dag-done")
            done = here if done is None else done.unionByName(here)
            if at % 16 == 0:
                done = materialize(done, "dag-done")
        # Intervals from the roots of the forest down: a node's own number, then its children's in order of id.
        before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        children = materialize(done.filter("parent IS NOT NULL").withColumn("before", before), "dag-kids")
        placed = materialize(done.filter("parent IS NULL").select("id", "level", *hashes, "size", F.col("id").alias("tree"), F.lit(0).cast("long").alias("low")), "dag-placed")
        out, round_ = placed, 0
        while not placed.isEmpty():
            over = placed.select(F.col("id").alias("parent"), "tree", F.col("low").alias("over"))
            placed = materialize(children.join(over, "parent").select("id", "level", *hashes, "size", "tree", (F.col("over") + 1 + F.col("before")).alias("low")), "dag-placed")
            out, round_ = out.unionByName(placed), round_ + 1
            if round_ % 16 == 0:
                out = materialize(out, "dag-labels")
        return materialize(out.withColumn("high", F.col("low") + F.col("size")).drop("size"), "dag-labels")

    def answers(self, pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """``pairs`` (x, y, ...) with ``reaches``: whether x leads to y over
        one edge or more, or is y; false where one of them is null."""
        of = lambda side, name: self.components.select(F.col("id").alias(side), F.col("component").alias(name))
        # Pairs are told apart after the shuffle, where a task has its share only.
        keys = [c for c in pairs.columns if c in (x, y)]
        edge = lambda a, b: self.edges.select(F.col(a).alias(x), F.col(b).alias(y)).repartition(*keys).distinct()
        along = edge("from_id", "to_id").withColumn("_along", F.lit(True))
        against = edge("to_id", "from_id").withColumn("_against", F.lit(True))
        xc, yc = F.coalesce("_xk", x), F.coalesce("_yk", y)
        none = F.col(x).isNull() | F.col(y).isNull()
        settled = F.when(none, False).when(xc == yc, True).when(F.col("_along"), True).when(F.col("_against"), False)
        known = pairs.join(along, keys, "left").join(against, keys, "left").join(of(x, "_xk"), x, "left").join(of(y, "_yk"), y, "left")
        known = materialize(known.select(*pairs.columns, "_xk", "_yk", settled.alias("reaches")), "asked")
        open_ = materialize(known.filter("reaches IS NULL").select(xc.alias("xc"), yc.alias("yc")).distinct(), "open")
        if open_.isEmpty():
            return known.drop("_xk", "_yk")
        hit = self._open_answers(open_).withColumnsRenamed({"xc": "_xc", "yc": "_yc"})
        answered = known.join(hit, (xc == F.col("_xc")) & (yc == F.col("_yc")), "left")
        return answered.select(*pairs.columns, F.coalesce("reaches", "hit", F.lit(False)).alias("reaches"))

    def _open_answers(self, open_: DataFrame) -> DataFrame:
        """(xc, yc, hit) of those pairs of components, none of them joined in
        a cycle, of which xc reaches yc."""
        self.dag = self._between(open_)
        self.labels = self._labels()
        hashes = [f"h{i}" for i in range(ORDERS)]
        label = lambda side: self.labels.select(
            F.col("id").alias(f"{side}c"), *[F.col(c).alias(f"{side}_{c}") for c in ("level", *hashes, "tree", "low", "high")]
        )
        no = F.col("x_level").isNull() | F.col("y_level").isNull() | (F.col("x_level") >= F.col("y_level"))
        for h in hashes:
            no = no | (F.col(f"x_{h}") > F.col(f"y_{h}"))
        inside = (F.col("x_tree") == F.col("y_tree")) & (F.col("x_low") <= F.col("y_low")) & (F.col("y_low") < F.col("x_high"))
        # An edge between the two is an equality join: no search meets all edges into a hub for it.
        direct = self.dag.select(F.col("a").alias("xc"), F.col("b").alias("yc"), F.lit(True).alias("direct"))
        settled = F.when(no, False).when(inside, True).when(F.col("direct"), True)
        asked = open_.join(label("x"), "xc", "left").join(label("y"), "yc", "left").join(direct, ["xc", "yc"], "left")
        known = materialize(asked.withColumn("reaches", settled), "labelled")
        rest = known.filter("reaches IS NULL").select("xc", "yc", "x_level", *[f"x_{h}" for h in hashes], "x_tree", "x_low", "x_high")
        yes = known.filter("reaches").select("xc", "yc", F.lit(True).alias("hit"))
        return materialize(yes.unionByName(self._search(rest, hashes)), "hits")

    def _search(self, open_: DataFrame, hashes: list[str]) -> DataFrame:
        """(xc, yc, hit) of the pairs that a search finds joined."""
        into = self.dag.join(self.labels.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("level", *hashes, "tree", "low")]), "a")
        level = materialize(open_.withColumn("at", F.col("yc")), "search")
        seen, hits = level.select("xc", "yc", "at"), None
        into = materialize(into, "search-edges")
        while not level.isEmpty():
            step = level.join(into, F.col("at") == F.col("b"))
            may = F.col("a_level") >= F.col("x_level")
            for h in hashes:
                may = may & (F.col(f"x_{h}") <= F.col(f"a_{h}"))
            under = (F.col("a") == F.col("xc")) | ((F.col("a_tree") == F.col("x_tree")) & (F.col("x_low") <= F.col("a_low")) & (F.col("a_low") < F.col("x_high")))
            step = materialize(step.filter(may).select(*open_.columns, F.col("a").alias("at"), under.alias("hit")).distinct(), "search-step")
            new = step.filter("hit").select("xc", "yc").distinct()
            hits = new if hits is None else hits.unionByName(new)
            level = materialize(
                step.filter("NOT hit").drop("hit").join(hits, ["xc", "yc"], "left_anti").join(seen, ["xc", "yc", "at"], "left_anti"), "search"
            )
            seen = materialize(seen.join(hits, ["xc", "yc"], "left_anti").unionByName(level.select("xc", "yc", "at")), "search-seen")
        if hits is None:
            hits = open_.select("xc", "yc")
        return hits.distinct().withColumn("hit", F.lit(True))
