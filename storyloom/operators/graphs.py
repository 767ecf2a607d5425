"""Graph operators on node and edge frames.

Components contract blocks of edges where they are read; what this leaves iterates to a fixpoint with each round written
through the session's checkpoint folder. Greedy acyclic
selection is sequential by definition: it runs for each strongly connected component, since no other edge can close a cycle. The
search for cycles runs for each project.
The first-in-first-out topological order runs for each project in one task, and level by level over all tasks for
projects too large for one.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut_lineage, written
from .ranking import place_in


#: Events and edges of a project up to which one task orders it, chooses among its edges, or walks them.
ONE_TASK = 1_000_000


#: Rows of groups that are handed to Python together: a call of it costs more than a small group's rows.
TOGETHER = 20_000


def together(group: Column, rows: int) -> Column:
    """A key that deals groups, by a hash of their own, to sets of about ``TOGETHER`` rows of all; a group is never parted."""
    return F.pmod(F.xxhash64(group), F.lit(-(-rows // TOGETHER) or 1)).alias("__set")


def undirected(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Every edge both ways, without self-loops and repeats."""
    a = edges.select(F.col(source).alias("node"), F.col(target).alias("other"))
    return a.unionByName(a.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct()


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``node, degree``: distinct neighbours, self-loops not counted."""
    return undirected(edges, source, target).groupBy("node").agg(F.count("*").alias("degree"))


def one_hop(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", bound: Column | None = None) -> DataFrame:
    """Edges that touch the given nodes (column ``node``), with whether they lie between two of them.

    The node set joins each end as a semi join, so an OR over both ends never becomes a nested loop.
    """
    kept = edges if bound is None else edges.where(bound)
    wanted = nodes.select("node").distinct().withColumn("hit", F.lit(1))
    s, t = wanted.select(F.col("node").alias(source), F.col("hit").alias("__s")), wanted.select(F.col("node").alias(target), F.col("hit").alias("__t"))
    marked = kept.join(s, source, "left").join(t, target, "left")
    return marked.where("__s IS NOT NULL OR __t IS NOT NULL").withColumn("is_between_matched", F.col("__s").isNotNull() & F.col("__t").isNotNull()).drop("__s", "__t")


#: Edges that one call contracts at a time.
BLOCK_EDGES = 1 << 20
#: Types of nodes whose order is the same in Spark and in Arrow.
CONTRACTED = (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType())


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The nodes of a block of edges, each with the least that it reaches along edges of the block."""
    ends = pa.Table.from_batches(batches)
    coded = pa.chunked_array([c for name in ("node", "other") for c in ends[name].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[coded.indices.to_numpy()]
    a, b, low = at[: len(ends)], at[len(ends) :], np.arange(len(order))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while ((up := low[low]) != low).any():
            low = up
    names = coded.dictionary.take(order)
    return pa.RecordBatch.from_arrays([names, names.take(pa.array(low))], names=["node", "root"])


def _contracted(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield _stars(held)
            held, n = [], 0
    if n:
        yield _stars(held)


def _by_blocks(pairs: DataFrame) -> DataFrame:
    """``node, component`` of edges (node, other): blocks of edges become stars where they are read, and only stars are shuffled.

    A node of several stars puts their centres together. These edges are contracted in turn, while they become fewer by
    far, and otherwise left to ``_by_rounds``.
    """
    most = BLOCK_EDGES
    kind = pairs.schema["node"].dataType.simpleString()
    stars = pairs.mapInArrow(lambda batches: _contracted(batches, most), f"node {kind}, root {kind}")
    own = Window.partitionBy("node").orderBy("root")
    held = written(stars.select("node", "root", F.first("root").over(own).alias("low"), (F.row_number().over(own) == 1).alias("first")))
    labels, between = held.where("first").select("node", F.col("root").alias("component")), held.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("other"))
    if not (n := between.count()):
        return labels
    if n <= most:
        centres = _by_blocks(between.repartition(1))  # one block
    else:
        centres = _by_blocks(between) if 4 * n <= held.count() else _by_rounds(between)
    up = centres.select(F.col("node").alias("component"), F.col("component").alias("up"))
    return labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """``node, component`` of edges (node, other). Each round takes the least label among neighbours and then the label's own label, which halves long paths."""
    links = cut_lineage(undirected(pairs, "node", "other"))
    labels = cut_lineage(links.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        near = links.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
        step = labels.join(near, "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        jump = step.join(labels.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left")
        new = cut_lineage(jump.select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        labels, moved = new.drop("was"), new.where("component <> was").isEmpty()
        if moved:
            return labels


def components(edges: DataFrame, source: str = "source", target: str = "target", nodes: DataFrame | None = None) -> DataFrame:
    """``node, component``: the least node of each component; ``nodes`` adds those without edges.

    Repeated edges and self-loops may stay in ``edges``. Strings and whole numbers are contracted by blocks, other nodes go by rounds.
    """
    pairs = edges.select(F.col(source).alias("node"), F.col(target).alias("other")).where("node <> other")
    kinds = [f.dataType for f in pairs.schema.fields]
    labels = _by_blocks(pairs) if kinds[0] == kinds[1] and kinds[0] in CONTRACTED else _by_rounds(pairs)
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


# Relations that order events (after is turned to before), and those that put them together.
ORDERING, SYMMETRIC = ("before", "contains", "causes", "reveals_past"), ("overlaps", "same_time")


def normalized_edges(edges: DataFrame, events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """``after`` becomes ``before`` with its ends swapped; unknown or missing ends and rejected evidence make an edge unusable, with the reason."""
    known = events.select(F.col(event_id).alias("__id")).distinct()
    after = F.col("relation_type") == "after"
    s, t = F.when(after, F.col("target_event_id")).otherwise(F.col("source_event_id")), F.when(after, F.col("source_event_id")).otherwise(F.col("target_event_id"))
    turned = edges.select(*[c for c in edges.columns if c not in ("source_event_id", "target_event_id", "relation_type")], s.alias("source_event_id"), t.alias("target_event_id"), F.when(after, F.lit("before")).otherwise(F.col("relation_type")).alias("relation_type"), F.when(after, F.lit("after")).alias("original_relation_type"))
    a, b = known.select(F.col("__id").alias("source_event_id"), F.lit(True).alias("__a")), known.select(F.col("__id").alias("target_event_id"), F.lit(True).alias("__b"))
    joined = turned.join(a, "source_event_id", "left").join(b, "target_event_id", "left")
    audited = F.coalesce(F.col("audit_ordering_usable"), F.lit(True)) if "audit_ordering_usable" in edges.columns else F.lit(True)
    reason = (
        F.when(F.col("source_event_id").isNull() | F.col("target_event_id").isNull(), F.lit("missing_endpoint"))
        .when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("unknown_endpoint"))
        .when(~audited, F.lit("evidence_rejected"))
        .when(~F.col("relation_type").isin(*ORDERING, *SYMMETRIC), F.lit("not_an_ordering_relation"))
    )
    return joined.withColumn("unusable_reason", reason).withColumn("usable_for_ordering", F.col("unusable_reason").isNull()).drop("__a", "__b")


def pair_conflicts(edges: DataFrame, hard: float = 0.75) -> DataFrame:
    """Self edges and pairs that point both ways among usable edges of enough confidence: ``type, ids, relation_ids``."""
    strong = edges.where(F.col("usable_for_ordering") & F.col("relation_type").isin(*ORDERING) & (F.col("confidence") >= hard)).select("relation_id", F.col("source_event_id").alias("s"), F.col("target_event_id").alias("t"))
    own = strong.where("s = t").groupBy("s").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids")).select(F.lit("self_ordering_edge").alias("type"), F.array("s").alias("ids"), "relation_ids")
    pairs = strong.where("s <> t").groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count_distinct(F.col("s") < F.col("t")).alias("ways"), F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    return own.unionByName(pairs.where("ways = 2").select(F.lit("two_node_cycle").alias("type"), F.array("a", "b").alias("ids"), "relation_ids"))


def cyclic_nodes(edges: DataFrame, source: str = "source", target: str = "target", by: str | None = None) -> DataFrame:
    """Nodes that lie on a cycle or between two cycles: what remains when sources and sinks are peeled off again and again.

    Each round is a job, as many as the longest chain that hangs on or off the cycles has edges.
    """
    own = [by] if by else []
    live = cut_lineage(edges.select(*own, F.col(source).alias("s"), F.col(target).alias("t")).distinct())
    size = live.count()
    while size:
        inner = live.join(live.select(*own, F.col("t").alias("s")).distinct(), [*own, "s"], "left_semi").join(live.select(*own, F.col("s").alias("t")).distinct(), [*own, "t"], "left_semi")
        live = cut_lineage(inner.select(*own, "s", "t"))
        left = live.count()
        if left == size:
            break
        size = left
    return live.select(*own, F.col("s").alias("node")).unionByName(live.select(*own, F.col("t").alias("node"))).distinct()


def _furthest(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label``: the greatest label of a node from which each is reached along ``links`` (s, t), its own at least.

    A round takes the greatest label of the nodes before, then that label's own label, which halves long paths.
    """
    labels = written(labels)
    while True:
        near = links.join(labels.select(F.col("node").alias("s"), "label"), "s").groupBy(F.col("t").alias("node")).agg(F.max("label").alias("__in"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("__was"), F.greatest("label", "__in").alias("label"))
        jump = labels.select(F.col("node").alias("__up"), F.col("label").alias("__far"))
        new = step.join(jump, F.col("label.node") == F.col("__up")).select("node", F.greatest("label", "__far").alias("label"), "__was")
        new = written(new)
        labels, settled = new.select("node", "label"), new.where("label <> __was").isEmpty()
        if settled:
            return labels


def strong_components(edges: DataFrame, source: str = "source", target: str = "target", by: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component``: the nodes on cycles of two or more nodes, with the least node of those that they reach and are reached from.

    With ``by``, of which a node has one value, groups of at most ``one_task`` edges are walked after one shuffle, many small
    ones at a time. Edges of larger groups, and all without ``by``, go in rounds: each gives every node the greatest label
    that reaches it and the greatest that it reaches among nodes of the same; where both are one label, its component is
    found, and of the rest only edges between nodes equal in both labels stay. Labels are hashes, so that chains fall apart
    at once. Self-loops, repeats and edges with a null end don't count.
    """
    links = edges.select(F.col(source).alias("s"), F.col(target).alias("t"), *([F.xxhash64(by).alias("__g")] if by else [])).where("s <> t")
    if not by:
        return _strong_by_rounds(links.distinct())
    links = written(links)
    large = cut_lineage(links.groupBy("__g").agg(F.count("*").alias("__n")).where(F.col("__n") > one_task).select("__g"))
    if large.isEmpty():
        return _strong_by_task(links)
    return _strong_by_task(links.join(large, "__g", "left_anti")).unionByName(_strong_by_rounds(links.join(large, "__g", "left_semi").select("s", "t").distinct()))


def _strong_by_task(links: DataFrame) -> DataFrame:
    """Strong components of the links (s, t) of groups ``__g``, which no link leaves, so that groups can be walked together."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, least) for group in strong_groups(zip(pdf["s"], pdf["t"])) if len(group) > 1 for least in [min(group)] for n in group]
        return pd.DataFrame(rows, columns=["node", "component"])

    kind = links.schema["s"].dataType.simpleString()
    return links.groupBy(together(F.col("__g"), links.count())).applyInPandas(walk, f"node {kind}, component {kind}")


def strong_groups(links: Iterable[tuple]) -> list[list]:
    """The strongly connected components of a graph, those of one node among them, by one depth-first walk."""
    after: dict = defaultdict(list)
    for s, t in links:
        after[s].append(t)
    number: dict = {}
    low: dict = {}
    held: list = []
    inside: set = set()
    out = []
    for root in list(after):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        inside.add(root)
        todo = [(root, iter(after[root]))]
        while todo:
            node, rest = todo[-1]
            t = next(rest, None)
            if t is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = [held.pop()]
                    while group[-1] != node:
                        group.append(held.pop())
                    inside.difference_update(group)
                    out.append(group)
            elif t not in number:
                number[t] = low[t] = len(number)
                held.append(t)
                inside.add(t)
                todo.append((t, iter(after.get(t, ()))))
            elif t in inside:
                low[node] = min(low[node], number[t])
    return out


def _strong_by_rounds(links: DataFrame) -> DataFrame:
    links, found = written(links), None
    while not links.isEmpty():
        nodes = links.select(F.explode(F.array("s", "t")).alias("node")).distinct()
        ahead = _furthest(links, nodes.select("node", F.struct(F.xxhash64("node").alias("hash"), "node").alias("label")))
        of = lambda labels, end: labels.select(F.col("node").alias(end), F.col("label").alias(f"__{end}"))
        inner = written(links.join(of(ahead, "s"), "s").join(of(ahead, "t"), "t").where("__s = __t").select("s", "t"))
        back = _furthest(inner.select(F.col("t").alias("s"), F.col("s").alias("t")), nodes.select("node", F.struct(F.xxhash64("node").alias("hash"), "node").alias("label")))
        both = written(ahead.join(back.withColumnRenamed("label", "back"), "node"))
        done = both.where("label = back").select("node", F.col("label.node").alias("root"))
        found = done if found is None else found.unionByName(done)
        left = both.where("label <> back").select("node", F.struct("label", "back").alias("label"))
        links = written(inner.join(of(left, "s"), "s").join(of(left, "t"), "t").where("__s = __t").select("s", "t"))
    if found is None:
        return links.select(F.col("s").alias("node"), F.col("s").alias("component"))
    groups = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("__n")).where("__n > 1")
    return found.join(groups, "root").select("node", "component")


def first_cycles(links: list[tuple[str, str]]) -> list[list[str]]:
    """The cycles that a depth-first walk closes, from node to node in sorted order: each as its nodes from the one it comes back to."""
    after: dict[str, list[str]] = defaultdict(list)
    for s, t in sorted(set(links)):
        after[s].append(t)
    done: set[str] = set()
    out = []
    for root in sorted(after):
        if root in done:
            continue
        path, place, todo = [root], {root: 0}, [iter(after[root])]
        done.add(root)
        while todo:
            t = next(todo[-1], None)
            if t is None:
                todo.pop()
                del place[path.pop()]
            elif t in place:
                out.append(path[place[t] :])
            elif t not in done:
                done.add(t)
                place[t] = len(path)
                path.append(t)
                todo.append(iter(after.get(t, ())))
    return out


def cycle_conflicts(edges: DataFrame, by: str, hard: float = 0.75) -> DataFrame:
    """Cycles of any length among usable edges of enough confidence, a walk for each project, of many small ones in one call: ``by, type, ids``.

    ``ids`` is the cycle's path from the node it closes at; of cycles with the same nodes the first stays. They name no
    relations, so they block none. Edges within a project only.
    """
    strong = edges.where(F.col("usable_for_ordering") & F.col("relation_type").isin(*ORDERING) & (F.col("confidence") >= hard)).select(by, F.col("source_event_id").cast("string").alias("s"), F.col("target_event_id").cast("string").alias("t")).distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        links, rows = defaultdict(list), []
        for group, s, t in zip(pdf["__g"], pdf["s"], pdf["t"]):
            links[group].append((s, t))
        for group, own in links.items():
            seen = set()
            for path in first_cycles(own):
                if (ids := tuple(sorted(path))) not in seen:
                    seen.add(ids)
                    rows.append((group, "cycle", path))
        return pd.DataFrame(rows, columns=["__g", "type", "ids"])

    strong = written(strong.withColumn("__g", F.col(by).cast("string")).drop(by))
    found = strong.groupBy(together(F.col("__g"), strong.count())).applyInPandas(walk, "__g string, type string, ids array<string>")
    return found.select(F.col("__g").cast(edges.schema[by].dataType).alias(by), "type", "ids")


SELECTED = "component string, relation_id string, selected boolean, skip_reason string"
PRIORITY = {"llm": 3, "scene_block_prior": 2, "discourse_prior": 1}


class GrowingOrder:
    """A topological order that is mended as edges come in: an edge costs the nodes between its ends in that order only."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.after: dict[str, set[str]] = defaultdict(set)
        self.before: dict[str, set[str]] = defaultdict(set)

    def _near(self, start: str, links: dict[str, set[str]], inside) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen and inside(self.place[n]):
                    seen.add(n)
                    todo.append(n)
        return seen

    def add(self, s: str, t: str) -> bool:
        """Add an edge; False, and nothing changed, if it would close a cycle."""
        for n in (s, t):
            self.place.setdefault(n, len(self.place))
        low, high = self.place[t], self.place[s]
        if low <= high:
            later = self._near(t, self.after, lambda p: p <= high)
            if s in later:
                return False
            earlier = self._near(s, self.before, lambda p: p >= low)
            moved = sorted(earlier, key=self.place.get) + sorted(later, key=self.place.get)
            for n, p in zip(moved, sorted(self.place[n] for n in moved)):
                self.place[n] = p
        self.after[s].add(t)
        self.before[t].add(s)
        return True


def select_acyclic(edges: DataFrame, blocked: DataFrame | None = None, by: str | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Greedy acyclic subset: ``component, relation_id, selected, skip_reason``, ``component`` being the connected component, or the value of ``by`` if edges lie within these.

    Edges go by falling confidence, then source (model before scene before discourse order), observed before inferred,
    then id; one that would close a cycle is skipped, so weak priors never cancel strong evidence. Edges between
    different strongly connected components can't close one: of groups of more than ``one_task`` edges only those
    within one meet in a task.
    """
    usable = edges.where(F.col("usable_for_ordering") & F.col("relation_type").isin(*ORDERING))
    usable = usable if by else written(usable)
    blocked = usable.select("relation_id").limit(0) if blocked is None else blocked.select("relation_id").distinct()
    if by:
        labelled = usable.withColumn("component", F.col(by).cast("string"))
    else:
        labelled = usable.join(components(usable, "source_event_id", "target_event_id").withColumnRenamed("node", "source_event_id"), "source_event_id")
    rows = written(labelled.join(blocked.withColumn("blocked", F.lit(True)), "relation_id", "left"))
    s, t = F.col("source_event_id"), F.col("target_event_id")
    reason = F.when(F.col("blocked"), "hard_conflict").when(s == t, "self_edge")
    own = rows.withColumn("skip_reason", reason)
    sizes = rows.groupBy("component").agg(F.count("*").alias("__n")).where(F.col("__n") > one_task).select("component")
    large = cut_lineage(sizes)
    if large.isEmpty():
        return _greedy(own.withColumn("__group", F.when(F.col("skip_reason").isNull(), F.col("component").cast("string"))), rows.count())
    small = own.join(large, "component", "left_anti").withColumn("__group", F.when(F.col("skip_reason").isNull(), F.col("component").cast("string")))
    own = own.join(large, "component", "left_semi")
    open_ = own.where("skip_reason IS NULL")
    strong = written(strong_components(open_, "source_event_id", "target_event_id"))
    end = lambda name: strong.select(F.col("node").alias(f"{name}_event_id"), F.col("component").alias(f"__{name}"))
    marked = own.join(end("source"), "source_event_id", "left").join(end("target"), "target_event_id", "left")
    within = F.when(F.col("skip_reason").isNull() & (F.col("__source") == F.col("__target")), F.col("__source").cast("string"))
    return _greedy(small, rows.count()).unionByName(_greedy(marked.withColumn("__group", within), rows.count()))


def _greedy(marked: DataFrame, size: int) -> DataFrame:
    """The choice in each ``__group`` of a component, of about ``size`` edges in all; edges without one are selected unless they have a reason."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(p=pdf["source"].map(PRIORITY).fillna(0), w=pdf["is_inferred"].fillna(False).astype(bool), c=pdf["confidence"].fillna(0.0))
        pdf = pdf.sort_values(["c", "p", "w", "relation_id"], ascending=[False, False, True, True])
        graphs = defaultdict(GrowingOrder)
        out = []
        for component, group, relation, s, t in zip(*(pdf[c] for c in ("component", "__group", "relation_id", "source_event_id", "target_event_id"))):
            kept = graphs[component, group].add(s, t)
            out.append((component, relation, kept, None if kept else "would_create_cycle"))
        return pd.DataFrame(out, columns=["component", "relation_id", "selected", "skip_reason"])

    fields = ["relation_id", "source_event_id", "target_event_id", "confidence", "source", "is_inferred"]
    plain = marked.where("__group IS NULL").select(F.col("component").cast("string"), "relation_id", F.col("skip_reason").isNull().alias("selected"), "skip_reason")
    inner = marked.where("__group IS NOT NULL").select(F.col("component").cast("string"), *fields, "__group")
    return plain.unionByName(inner.groupBy(together(F.struct("component", "__group"), size)).applyInPandas(pick, SELECTED))


def topological(events: DataFrame, edges: DataFrame, by: str, order: tuple[str, ...] = ("source_record_id", "discourse_index", "event_id"), one_task: int = ONE_TASK) -> DataFrame:
    """``by, event_id, timeline_rank``: Kahn's order with a first-in-first-out queue, one graph per ``by``.

    Nodes that become ready together follow ``order``; nodes on or behind cycles come last in that order. Projects of more
    than ``one_task`` events and edges are ordered level by level instead, with the same result.
    """
    nodes = events.select(by, *order)
    own = events.select(F.col(by).alias("__by"), "event_id")
    links = edges.select("source_event_id", "target_event_id").distinct().where("source_event_id <> target_event_id")
    links = links.join(own.select(F.col("__by").alias(by), F.col("event_id").alias("source_event_id")), "source_event_id").join(own.select(F.col("__by").alias(by), F.col("event_id").alias("target_event_id")), [by, "target_event_id"]).select(by, "source_event_id", "target_event_id")
    links = cut_lineage(links)
    sizes = cut_lineage(nodes.select(by).unionByName(links.select(by)).groupBy(by).agg(F.count("*").alias("__n")))
    large = sizes.where(F.col("__n") > one_task).select(by)
    size = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    if large.isEmpty():
        return _ordered_by_task(nodes, links, by, order, size)
    apart = lambda df, how: df.join(large, by, how)
    return _ordered_by_task(apart(nodes, "left_anti"), apart(links, "left_anti"), by, order, size).unionByName(_ordered_by_level(apart(nodes, "left_semi"), apart(links, "left_semi"), by, order))


def _ordered_by_task(nodes: DataFrame, links: DataFrame, by: str, order: tuple[str, ...], size: int) -> DataFrame:
    rows = nodes.withColumn("t", F.lit(None).cast("string"))
    ends = links.select(by, *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) if c != "event_id" else F.col("source_event_id").alias(c) for c in order), F.col("target_event_id").alias("t"))
    dealt = rows.unionByName(ends).withColumn("__g", F.col(by).cast("string")).drop(by)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        events, ends = defaultdict(list), defaultdict(list)
        own = pdf[pdf["t"].isna()].sort_values(list(order))
        for group, e in zip(own["__g"], own["event_id"]):
            events[group].append(e)
        linked = pdf[pdf["t"].notna()]
        for group, s, t in zip(linked["__g"], linked["event_id"], linked["t"]):
            ends[group].append((s, t))
        out = [(group, e, i) for group, ids in events.items() for i, e in enumerate(first_in_first_out(ids, ends[group]), 1)]
        return pd.DataFrame(out, columns=["__g", "event_id", "timeline_rank"])

    sorted_ = dealt.groupBy(together(F.col("__g"), size)).applyInPandas(sort, "__g string, event_id string, timeline_rank int")
    return sorted_.select(F.col("__g").cast(nodes.schema[by].dataType).alias(by), "event_id", "timeline_rank")


def first_in_first_out(ids: list, links: Iterable[tuple]) -> list:
    """Kahn's order of ``ids`` with a queue; those on or behind cycles come last, as they stood."""
    place = {e: i for i, e in enumerate(ids)}
    after: dict = defaultdict(list)
    waits = dict.fromkeys(ids, 0)
    for s, t in links:
        after[s].append(t)
        waits[t] += 1
    queue, out = deque(e for e in ids if not waits[e]), []
    while queue:
        e = queue.popleft()
        out.append(e)
        for t in sorted(after[e], key=place.get):
            waits[t] -= 1
            if not waits[t]:
                queue.append(t)
    done = set(out)
    return out + [e for e in ids if e not in done]


def _ordered_by_level(nodes: DataFrame, links: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """The same order over all tasks, a job for each level (the longest path has as many).

    The queue takes a level after the other, since a node is ready when the last of its predecessors is taken; within a
    level nodes stand by that predecessor's place, then in ``order``.
    """
    key = [by, "event_id"]
    nodes, waiting = cut_lineage(nodes), cut_lineage(links)
    ready = nodes.join(waiting.select(by, F.col("target_event_id").alias("event_id")).distinct(), key, "left_anti").withColumn("__last", F.lit(0))
    placed = None
    while True:
        level = place_in(ready, by, ["__last", *order], "__place")
        if placed is None:
            level = level.select(*key, F.col("__place").alias("timeline_rank"))
        else:
            taken = placed.groupBy(by).agg(F.max("timeline_rank").alias("__taken"))
            level = level.join(taken, by).select(*key, (F.col("__place") + F.col("__taken")).alias("timeline_rank"))
        level = cut_lineage(level)
        if level.isEmpty():
            break
        placed = level if placed is None else cut_lineage(placed.unionByName(level))
        front = level.select(by, F.col("event_id").alias("source_event_id"), "timeline_rank")
        freed = waiting.join(front, [by, "source_event_id"]).groupBy(by, F.col("target_event_id").alias("event_id")).agg(F.max("timeline_rank").alias("__last"))
        waiting = cut_lineage(waiting.join(front, [by, "source_event_id"], "left_anti"))
        ready = nodes.join(freed, key).join(waiting.select(by, F.col("target_event_id").alias("event_id")).distinct(), key, "left_anti")
    if placed is None:
        placed = nodes.select(*key, F.lit(0).alias("timeline_rank")).limit(0)
    rest = nodes.join(placed.select(*key), key, "left_anti")
    taken = placed.groupBy(by).agg(F.max("timeline_rank").alias("__taken"))
    last = place_in(rest, by, list(order), "__place").join(taken, by, "left").select(*key, (F.coalesce("__taken", F.lit(0)) + F.col("__place")).alias("timeline_rank"))
    return placed.unionByName(last)
