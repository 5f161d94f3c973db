"""Lineage graphs as DataFrames: nodes (id, tipo, capa, detalle), edges (origen, destino, fuentes: array of strings).

An edge goes from the table that is read to the one that reads it. A graph of up to SMALL edges is
walked on the driver, where a level costs nothing. Larger ones advance one
frontier a level by equi-joins and cut their lineage with checkpoint() in
the folder the cluster names; both ways give the same rows. Only order-dependent results (cycle
paths, layout) always work on collected edges, bounded by ``limit``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import shared_folder

NODE_TYPES = ("tabla", "vista", "modelo", "semilla", "fuente", "prueba", "externo", "desconocido")
UNKNOWN = ("desconocido", "externo")
COLLECT_LIMIT = 200_000
SMALL = 50_000
NODES = "id string, tipo string, capa string, detalle string"
EDGES = "origen string, destino string, fuentes array<string>"


class UnknownNode(LookupError):
    """The graph has no such node; suggestions has up to five like it."""

    def __init__(self, name: str, suggestions: list[str]) -> None:
        super().__init__(f"{name} is not in the graph" + (f"; did you mean {', '.join(suggestions)}?" if suggestions else ""))
        self.name, self.suggestions = name, suggestions


class AmbiguousNode(LookupError):
    def __init__(self, name: str, candidates: list[str]) -> None:
        super().__init__(f"{name} may be {', '.join(candidates)}")
        self.name, self.candidates = name, candidates


def durable(df: DataFrame) -> DataFrame:
    """df behind a checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def merged_nodes(*sources: DataFrame) -> DataFrame:
    """One node for each id. The first known type wins over unknown and external ones; empty layers and details are filled from the next."""
    ranked = None
    for i, nodes in enumerate(sources):
        part = nodes.select(F.lower("id").alias("id"), "tipo", F.nullif("capa", F.lit("")).alias("capa"), F.nullif("detalle", F.lit("")).alias("detalle"), F.lit(i).alias("__source"))
        ranked = part if ranked is None else ranked.unionByName(part)
    order = F.struct(F.col("tipo").isin(*UNKNOWN).alias("u"), F.col("__source").alias("s"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    return ranked.groupBy("id").agg(F.min_by("tipo", order).alias("tipo"), first("capa").alias("capa"), F.coalesce(first("detalle"), F.lit("")).alias("detalle"))


def merged_edges(*sources: DataFrame) -> DataFrame:
    """One edge for each pair with the union of its sources; no loops. Each source has origen, destino and motivo, names joined by ``+``."""
    rows = None
    for edges in sources:
        part = edges.select(F.lower("origen").alias("origen"), F.lower("destino").alias("destino"), F.explode(F.split("motivo", r"\+")).alias("fuente"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("origen <> destino").groupBy("origen", "destino").agg(F.array_sort(F.collect_set("fuente")).alias("fuentes"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("origen", "destino")).alias("id")).distinct()


@dataclass(frozen=True)
class Graph:
    """A pair of DataFrames with the graph's questions."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: list[DataFrame], edges: list[DataFrame]) -> Graph:
        """Merged sources; endpoints that no source has are external nodes."""
        links = merged_edges(*edges)
        outside = endpoints(links).select("id", F.lit("externo").alias("tipo"), F.lit(None).cast("string").alias("capa"), F.lit("").alias("detalle"))
        return Graph(merged_nodes(*nodes, outside), links)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def consumers(self, node: str) -> DataFrame:
        """J4"""
        return self.edges.where(F.col("origen") == node).select(F.col("destino").alias("id")).distinct().orderBy("id")

    def producers(self, node: str) -> DataFrame:
        return self.edges.where(F.col("destino") == node).select(F.col("origen").alias("id")).distinct().orderBy("id")

    def confirmed(self) -> DataFrame:
        """Edges that more than one source saw."""
        return self.edges.where(F.size("fuentes") > 1)

    def orphans(self, with_external: bool = False) -> DataFrame:
        """Nodes that nothing reads."""
        own = self.nodes if with_external else self.nodes.where("tipo <> 'externo'")
        return own.join(self.edges.select(F.col("origen").alias("id")).distinct(), "id", "left_anti").select("id").orderBy("id")

    def roots(self) -> DataFrame:
        """Nodes that read nothing; never external ones."""
        return self.nodes.where("tipo <> 'externo'").join(self.edges.select(F.col("destino").alias("id")).distinct(), "id", "left_anti").select("id").orderBy("id")

    def summary(self) -> DataFrame:
        """(medida, valor): nodes, nodes of each type, edges, confirmed edges."""
        total = self.nodes.agg(F.count("*").alias("valor")).select(F.lit("nodos").alias("medida"), "valor")
        types = self.nodes.groupBy("tipo").agg(F.count("*").alias("valor")).select(F.concat(F.lit("tipo:"), "tipo").alias("medida"), "valor")
        edges = self.edges.agg(F.count("*").alias("a"), F.count_if(F.size("fuentes") > 1).alias("c"))
        return total.unionByName(types).unionByName(edges.selectExpr("stack(2, 'aristas', a, 'confirmadas', c) AS (medida, valor)"))

    def listing(self) -> DataFrame:
        """nodes by layer (those without one last) and id, with the edges in and out."""
        into = self.edges.groupBy(F.col("destino").alias("id")).agg(F.count("*").alias("entradas"))
        out = self.edges.groupBy(F.col("origen").alias("id")).agg(F.count("*").alias("salidas"))
        return self.nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, ["entradas", "salidas"]).orderBy(F.coalesce("capa", F.lit("~")), "id")

    def resolve(self, name: str) -> str:
        """The id itself, or the only id that ends with ``.name``; an error names up to 50 candidates."""
        name = name.lower()
        if not self.nodes.where(F.col("id") == name).isEmpty():
            return name
        found = [r["id"] for r in self.nodes.where(F.col("id").endswith(f".{name}")).select("id").distinct().orderBy("id").limit(50).collect()]
        if len(found) > 1:
            raise AmbiguousNode(name, found)
        if not found:
            last = name.rpartition(".")[2]
            like = self.nodes.where(F.col("id").contains(last)).select("id").orderBy("id").limit(5).collect()
            raise UnknownNode(name, [r["id"] for r in like])
        return found[0]

    def impact(self, node: str, hops: int | None = None) -> DataFrame:
        """What is reached downstream: (id, salto, via)."""
        return self._reach(node, "origen", "destino", hops)

    def ancestry(self, node: str, hops: int | None = None) -> DataFrame:
        """What it comes from, upstream."""
        return self._reach(node, "destino", "origen", hops)

    def _reach(self, node: str, here: str, there: str, hops: int | None) -> DataFrame:
        node = node.lower()
        if self.nodes.where(F.col("id") == node).isEmpty():
            self.resolve(node + "\0")  # raises with suggestions
        return reach(self.edges.select(F.col(here).alias("a"), F.col(there).alias("b")), node, hops)

    def collected_edges(self, limit: int = COLLECT_LIMIT) -> list[tuple[str, str]]:
        rows = self.edges.select("origen", "destino").distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} edges; use cycle_members() or levels()")
        return sorted((r[0], r[1]) for r in rows)

    def cycles(self, limit: int = COLLECT_LIMIT) -> list[list[str]]:
        """A path for each back edge of a depth-first walk in order of id, first node repeated at the end."""
        return back_edge_paths([r["id"] for r in self.nodes.select("id").orderBy("id").limit(limit).collect()], self.collected_edges(limit))

    def cycle_members(self) -> DataFrame:
        """(id, componente) of every node on a cycle; components are named by their least id. Scales with the graph."""
        return strongly_connected(self.edges)

    def levels(self) -> DataFrame:
        """(id, nivel): the longest path from any root; cycles are cut."""
        return longest_levels(self.nodes.select("id"), self.edges)


def collected(pairs: DataFrame, small: int) -> list[tuple[str, str]] | None:
    """The distinct pairs, or None if there are more than small."""
    rows = pairs.distinct().limit(small + 1).collect() if small else None
    return None if rows is None or len(rows) > small else sorted((r[0], r[1]) for r in rows)


def reach(pairs: DataFrame, start: str, hops: int | None = None, small: int = SMALL) -> DataFrame:
    """(id, salto, via) reached from start over pairs (a, b); via is the node before it on the least of its shortest paths."""
    spark = pairs.sparkSession
    if (few := collected(pairs, small)) is not None:
        rows = [(n, len(p) - 1, p[-2]) for n, p in shortest_paths(few, start, hops).items() if n != start]
        return spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), "id string, salto int, via string")
    pairs = pairs.distinct()
    seen = frontier = durable(spark.createDataFrame([(start, 0, [start])], "id string, salto int, path array<string>"))
    pairs = durable(pairs)
    step = 0
    while hops is None or step < hops:
        step += 1
        found = frontier.join(pairs, frontier.id == pairs.a).groupBy("b").agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        frontier = found.join(seen.select("id"), found.b == seen.id, "left_anti").select(F.col("b").alias("id"), F.lit(step).alias("salto"), "path")
        frontier = durable(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # every level is written once
    return seen.where("salto > 0").select("id", "salto", F.get("path", F.size("path") - 2).alias("via")).orderBy("salto", "id")


def shortest_paths(pairs: list[tuple[str, str]], start: str, hops: int | None) -> dict[str, list[str]]:
    """The least of the shortest paths to each node reached, level by level."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
    paths = level = {start: [start]}
    while level and (hops is None or len(next(iter(level.values()))) <= hops):
        found: dict[str, list[str]] = {}
        for node, path in level.items():
            for b in after[node]:
                if b not in paths and (b not in found or [*path, b] < found[b]):
                    found[b] = [*path, b]
        level = found
        paths = paths | level
    return paths


def back_edge_paths(ids: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycle paths of an iterative three-colour walk."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    done: set[str] = set()
    found = []
    for root in sorted({*ids, *after}):
        if root in done:
            continue
        path, place, todo = [root], {root: 0}, [iter(sorted(after[root]))]
        while path:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
                gone = path.pop()
                del place[gone]
                done.add(gone)
            elif child in place:
                found.append([*path[place[child] :], child])
            elif child not in done:
                place[child] = len(path)
                path.append(child)
                todo.append(iter(sorted(after[child])))
    return found


def components(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, least node of its component) of nodes on a cycle of two or more, by an iterative low-link walk."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found = []
    for root in sorted({n for p in pairs for n in p}):
        todo = [] if root in order else [(root, iter(after[root]))]
        while todo:
            node, rest = todo[-1]
            if node not in order:
                order[node] = low[node] = len(order)
                held.append(node)
                inside.add(node)
            child = next((c for c in rest if c not in order or c in inside), None)
            if child is not None:
                if child not in order:
                    todo.append((child, iter(after[child])))
                else:
                    low[node] = min(low[node], order[child])
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
            if low[node] == order[node]:
                at = held.index(node)
                group, held[at:] = held[at:], []
                inside.difference_update(group)
                if len(group) > 1:
                    found += [(n, min(group)) for n in group]
    return sorted(found)


def strongly_connected(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, componente) of nodes that reach themselves through others. Trims what has no edge in or out, then colours forward by the least id and confirms backward."""
    left = edges.select(F.col("origen").alias("a"), F.col("destino").alias("b")).distinct()
    spark = left.sparkSession
    if (few := collected(left, small)) is not None:
        return spark.createDataFrame(components(few), "id string, componente string")
    left = durable(left)
    out = spark.createDataFrame([], "id string, componente string")
    while True:
        while True:  # trim
            kept = durable(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if kept.count() == left.count():
                break
            left = kept
        if left.isEmpty():
            return out
        colour = _least_reaching(left, left.selectExpr("explode(array(a, b)) AS id").distinct().select("id", F.col("id").alias("c")))
        inside = left.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        back = durable(inside.select("a", "b", F.col("ca").alias("c")))
        # members: those of a colour that reach the colour's own node
        member = durable(colour.where("id = c"))
        while True:
            more = back.join(member.select(F.col("id").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("id"), "c").distinct().join(member, ["id", "c"], "left_anti")
            more = durable(more)
            if more.isEmpty():
                break
            member = durable(member.unionByName(more.select("id", "c")))
        on_cycle = member.join(back.where("a <> b").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        sizes = member.groupBy("c").count()
        out = durable(out.unionByName(on_cycle.join(sizes, "c").where("count > 1").select("id", F.col("c").alias("componente"))))
        left = durable(left.join(member.select(F.col("id").alias("a")), "a", "left_anti").join(member.select(F.col("id").alias("b")), "b", "left_anti"))


def _least_reaching(pairs: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, c): the least id that reaches each node."""
    colour = durable(colour)
    while True:
        pushed = pairs.join(colour, pairs.a == colour.id).groupBy("b").agg(F.min("c").alias("n"))
        after = durable(colour.join(pushed, colour.id == pushed.b, "left").select("id", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("id", "c")
        colour = after.select("id", "c")


def longest_levels(ids: DataFrame, edges: DataFrame, limit: int = COLLECT_LIMIT, small: int = SMALL) -> DataFrame:
    """(id, nivel): each round peels the nodes that nothing left leads to. What stays when a round peels none has cycles, and is walked on collected edges."""
    spark = ids.sparkSession
    total = ids.count()
    few = collected(edges.select("origen", "destino"), small) if total <= small else None
    if few is not None:
        return spark.createDataFrame(sorted(cut_levels([r["id"] for r in ids.collect()], few).items()), "id string, nivel int")
    pairs = durable(edges.select("origen", "destino").distinct())
    left = durable(ids.select("id").union(pairs.select("origen")).distinct())
    waiting, found, step = pairs, None, 0
    while not left.isEmpty():
        ready = durable(left.join(waiting.select(F.col("destino").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            break
        level = ready.withColumn("nivel", F.lit(step))
        found = level if found is None else found.union(level)
        left = durable(left.join(ready, "id", "left_anti"))
        waiting = durable(waiting.join(ready, waiting.origen == ready.id, "left_anti"))
        step += 1
    else:
        return spark.createDataFrame([], "id string, nivel int") if found is None else found
    rows = pairs.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a cyclic graph of more than {limit} edges")
    found = cut_levels([r["id"] for r in ids.collect()], [(r[0], r[1]) for r in rows])
    return spark.createDataFrame(list(found.items()), "id string, nivel int")


def cut_levels(ids: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Longest path from any root, in order of id; a node that is still being worked out counts as level 0."""
    before: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        before[b].append(a)
    level: dict[str, int] = {}
    for root in sorted(ids):
        stack, open_ = [root], set()
        while stack:
            node = stack[-1]
            if node in level:
                stack.pop()
                continue
            open_.add(node)
            wait = [p for p in before[node] if p not in level and p not in open_]
            if wait:
                stack.append(wait[0])
                continue
            level[node] = max((level.get(p, 0) for p in before[node]), default=-1) + 1
            open_.discard(node)
            stack.pop()
    return level


# Margins and steps of the drawing.
MARGIN_X, MARGIN_Y, STEP_X, STEP_Y = 130.0, 60.0, 300.0, 62.0


def layout(ids: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, int, int, float, float]]:
    """(id, nivel, fila, x, y). Layers by level, rows by the mean row of a node's parents, ties by id, short layers centred."""
    level = cut_levels(ids, edges)
    parents: dict[str, list[str]] = defaultdict(list)
    for a, b in set(edges):
        parents[b].append(a)
    layers: dict[int, list[str]] = defaultdict(list)
    for node in sorted(level):
        layers[level[node]].append(node)
    row: dict[str, int] = {}
    for n in sorted(layers):
        def weight(node: str) -> tuple[float, str]:
            placed = [row[p] for p in parents[node] if p in row]
            return (sum(placed) / len(placed) if n and placed else 0.0 if not n else float("inf"), node)

        layers[n].sort(key=weight)
        row |= {node: i for i, node in enumerate(layers[n])}
    tallest = max(map(len, layers.values()), default=0)
    return [(node, n, i, MARGIN_X + STEP_X * n, MARGIN_Y + STEP_Y * (i + (tallest - len(nodes)) / 2)) for n, nodes in sorted(layers.items()) for i, node in enumerate(nodes)]


def externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints of edges that no node describes."""
    return endpoints(edges).join(nodes.select("id"), "id", "left_anti")


def shown(nodes: DataFrame, text: Column | str) -> DataFrame:
    """Nodes whose id or detail has the text."""
    text = F.lower(F.lit(text) if isinstance(text, str) else text)
    return nodes.where(F.lower("id").contains(text) | F.lower("detalle").contains(text))
