"""Parts of a graph to look at: neighbourhoods and selections by filters, templates, lineage, layouts and files.

nodes have id, kind, risk, created (date); edges have src, dst, kind. What is drawn has at most some hundred nodes; only
that comes to the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.components import cut
from veritrace.operators.graph import bfs, induced

#: The most nodes of a drawing, and of a walk from a node its most steps.
NODES, STEPS = 500, 5


@dataclass(frozen=True)
class Filter:
    """What nodes and edges may be there; None asks for nothing."""

    node_kinds: tuple[str, ...] | None = None
    edge_kinds: tuple[str, ...] | None = None
    least_risk: float | None = None
    most_risk: float | None = None
    since: str | None = None
    until: str | None = None
    ids: tuple[str, ...] | None = None
    without_patterns: tuple[str, ...] = ()


#: Views that investigators open: kind of the centre (None: none), steps, filter and the most nodes.
TEMPLATES = {
    "Company Network": ("Company", 2, Filter(("Company", "Tender", "Buyer", "Person"), ("WINS", "ISSUES", "REPRESENTS")), 500),
    "Fraud Pattern View": (None, 2, Filter(("Company", "FraudPattern", "Person"), ("FLAGGED_BY", "REPRESENTS")), 500),
    "Supply Chain": ("Company", 3, Filter(("Company", "Tender"), ("WINS", "RELATED_TO")), 500),
    "Risk Hotspot": (None, 2, Filter(("Company", "Person", "Buyer"), ("WINS", "ISSUES", "REPRESENTS", "OWNS", "FLAGGED_BY"), least_risk=0.7), 500),
    "Project Ecosystem": ("Project", 2, Filter(("Project", "Tender", "Company"), ("PART_OF", "WINS")), 500),
    "Full Overview": (None, 1, Filter(("Company", "Tender", "Project", "Person", "Buyer", "Asset"), ("WINS", "ISSUES", "PART_OF", "REPRESENTS", "OWNS", "RELATED_TO")), 100),
}


def allowed(f: Filter, unknown: bool) -> Column:
    """The filter on nodes; ``unknown`` says whether a node without a risk or a date passes theirs."""

    def holds(c: str, test: Column) -> Column:
        return F.col(c).isNull() | test if unknown else F.coalesce(test, F.lit(False))

    parts = [F.col("id").isNotNull()]
    if f.node_kinds is not None:
        parts.append(F.col("kind").isin(*f.node_kinds))
    if f.least_risk is not None:
        parts.append(holds("risk", F.col("risk") >= f.least_risk))
    if f.most_risk is not None:
        parts.append(holds("risk", F.col("risk") <= f.most_risk))
    if f.since is not None:
        parts.append(holds("created", F.col("created") >= F.to_date(F.lit(f.since))))
    if f.until is not None:
        parts.append(holds("created", F.col("created") <= F.to_date(F.lit(f.until))))
    if f.ids is not None:
        parts.append(F.col("id").isin(*f.ids))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _unflagged(nodes: DataFrame, flags: DataFrame | None, f: Filter) -> DataFrame:
    if flags is None or not f.without_patterns:
        return nodes
    return nodes.join(flags.where(F.col("pattern").isin(*f.without_patterns)).select("id"), "id", "left_anti")


def _of_kinds(edges: DataFrame, f: Filter) -> DataFrame:
    return edges if f.edge_kinds is None else edges.where(F.col("kind").isin(*f.edge_kinds))


def neighbourhood(nodes: DataFrame, edges: DataFrame, centre: str, depth: int = 2, f: Filter = Filter(), most: int = NODES, flags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(nodes with hops, edges between them) within some steps of a node, over edges of the filter's kinds, either way.

    Nodes that the filter refuses are passed through, not shown; unknown risks and dates pass. The centre is always
    there; of more than ``most`` nodes the nearest come, then the first by id. flags has (id, pattern).
    """
    start = nodes.sparkSession.createDataFrame([(centre,)], "start string")
    reached = bfs(_of_kinds(edges, f).select("src", "dst"), start, min(depth, STEPS)).select(F.col("node").alias("id"), "hops")
    rows = nodes.join(reached, "id")
    shown = _unflagged(rows.where((F.col("hops") > 0) & allowed(f, True)), flags, f).orderBy("hops", "id").limit(most - 1)
    shown = cut(shown.unionByName(rows.where("hops = 0")))
    return shown, induced(edges, shown.select(F.col("id").alias("node")))


def selection(nodes: DataFrame, edges: DataFrame, f: Filter, most: int = NODES, flags: DataFrame | None = None, order: str = "risk") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges between them) without a centre: the first by a column, the greatest first. Unknown risks and dates do not pass."""
    shown = cut(_unflagged(nodes.where(allowed(f, False)), flags, f).orderBy(F.col(order).desc_nulls_last(), "id").limit(most))
    return shown, induced(_of_kinds(edges, f), shown.select(F.col("id").alias("node")))


def template(nodes: DataFrame, edges: DataFrame, name: str, centre: str | None = None, flags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    kind, depth, f, most = TEMPLATES[name]
    if kind is None:
        return selection(nodes, edges, f, most, flags)
    if centre is None:
        raise ValueError(f"{name} needs a {kind}")
    return neighbourhood(nodes, edges, centre, depth, f, most, flags)


def community(nodes: DataFrame, edges: DataFrame, members: DataFrame, most: int = NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges between them) of members (id): the riskiest first."""
    shown = cut(nodes.join(members.select("id").distinct(), "id", "left_semi").orderBy(F.col("risk").desc_nulls_last(), "id").limit(most))
    return shown, induced(edges, shown.select(F.col("id").alias("node")))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """nodes one step away with the kind of the edge and its direction."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), F.col("kind").alias("edge"), F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), F.col("kind").alias("edge"), F.lit("in").alias("direction"))
    return out.union(into).distinct().join(nodes, "id")


def lineage(derived: DataFrame, sources: DataFrame, node: str, depth: int = 5) -> DataFrame:
    """(id, hops, via): what a node comes from over derived (src from dst), or where there is nothing, its sources (id, source)."""
    front = derived.sparkSession.createDataFrame([(node,)], "id string")
    seen, levels = front, []
    for n in range(1, depth + 1):
        nxt = derived.join(front, derived["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = cut(nxt)
        if front.isEmpty():
            break
        levels.append(front.select("id", F.lit(n).alias("hops"), F.lit("DERIVED_FROM").alias("via")))
        seen = seen.union(front)
    if not levels:
        return sources.where(F.col("id") == node).select(F.col("source").alias("id"), F.lit(0).alias("hops"), F.lit("source").alias("via")).distinct()
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


# -- drawings: on the driver, for at most NODES nodes


def _rows(nodes: DataFrame, edges: DataFrame) -> tuple[list, list]:
    some = nodes.orderBy("id").limit(NODES + 1).collect()
    if len(some) > NODES:
        raise ValueError(f"a drawing has at most {NODES} nodes")
    names = {r["id"] for r in some}
    links = edges.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind").limit(NODES * NODES).collect()
    return some, [e for e in links if e["src"] in names and e["dst"] in names]


def layout(nodes: DataFrame, edges: DataFrame, how: str = "circular", centre: str | None = None, size: float = 1000.0) -> dict[str, tuple[float, float]]:
    """A place for each node: circular, grid, radial (rings by steps from the centre), hierarchical (layers by direction) or force."""
    rows, links = _rows(nodes, edges)
    ids = [r["id"] for r in rows]
    n, mid = len(ids), size / 2
    if not n:
        return {}

    def ring(some: list[str], radius: float) -> dict[str, tuple[float, float]]:
        return {x: (mid + radius * math.cos(2 * math.pi * i / len(some)), mid + radius * math.sin(2 * math.pi * i / len(some))) for i, x in enumerate(some)}

    if how == "grid":
        wide = math.ceil(math.sqrt(n))
        return {x: ((i % wide + 0.5) * size / wide, (i // wide + 0.5) * size / wide) for i, x in enumerate(ids)}
    if how == "radial":
        around: dict[str, set[str]] = {x: set() for x in ids}
        for e in links:
            around[e["src"]].add(e["dst"])
            around[e["dst"]].add(e["src"])
        far, front = {centre or ids[0]: 0}, [centre or ids[0]]
        while front:
            front = [y for x in front for y in sorted(around[x]) if y not in far and far.setdefault(y, far[x] + 1)]
        last = max(far.values()) + 1
        levels: dict[int, list[str]] = {}
        for x in ids:
            levels.setdefault(far.get(x, last), []).append(x)
        top = max(levels) or 1
        return {k: v for d, some in levels.items() for k, v in ring(some, mid * d / top).items()}
    if how == "hierarchical":
        below = {x: {e["dst"] for e in links if e["src"] == x and e["dst"] != x} for x in ids}
        into = {x: sum(x in s for s in below.values()) for x in ids}
        layers, left = [], set(ids)
        while left:
            layer = sorted(x for x in left if into[x] == 0) or [min(left, key=lambda x: (into[x], x))]  # a circle is opened at its first node
            layers.append(layer)
            left -= set(layer)
            for x in layer:
                for y in below[x] & left:
                    into[y] -= 1
        return {x: ((i + 1) * size / (len(layer) + 1), (d + 0.5) * size / len(layers)) for d, layer in enumerate(layers) for i, x in enumerate(layer)}
    out = ring(ids, mid)
    if how == "force":  # springs from the circle on, always the same
        import numpy as np

        at = np.array([out[x] for x in ids])
        number = {x: i for i, x in enumerate(ids)}
        a, b = (np.array([number[e[k]] for e in links], int) for k in ("src", "dst"))
        rest = size / math.sqrt(n)
        for step in range(100):
            gap = at[:, None] - at[None, :]
            d2 = (gap**2).sum(-1) + 1e-6
            move = (gap * (rest**2 / d2)[..., None]).sum(1)
            pull = (at[a] - at[b]) * (np.sqrt(((at[a] - at[b]) ** 2).sum(-1, keepdims=True)) / rest)
            np.add.at(move, a, -pull)
            np.add.at(move, b, pull)
            length = np.sqrt((move**2).sum(-1, keepdims=True)) + 1e-9
            at = np.clip(at + move / length * np.minimum(length, size / 10 * (1 - step / 100)), 0, size)
        out = {x: (float(at[i, 0]), float(at[i, 1])) for x, i in number.items()}
    elif how != "circular":
        raise ValueError(f"no layout {how}")
    return out


def colour(risk: float | None) -> str:
    return "#9e9e9e" if risk is None else "#d32f2f" if risk >= 0.7 else "#f57c00" if risk >= 0.4 else "#388e3c"


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    rows, links = _rows(nodes, edges)
    return json.dumps({"nodes": [{k: v if isinstance(v, (int, float, str, type(None))) else str(v) for k, v in r.asDict().items()} | {"color": colour(r["risk"])} for r in rows], "links": [e.asDict() for e in links]}, sort_keys=True)


def to_graphml(nodes: DataFrame, edges: DataFrame) -> str:
    rows, links = _rows(nodes, edges)
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="kind" for="all" attr.name="kind" attr.type="string"/>', '<key id="risk" for="node" attr.name="risk" attr.type="double"/>', '<graph edgedefault="directed">']
    for r in rows:
        risk = "" if r["risk"] is None else f'<data key="risk">{r["risk"]}</data>'
        out.append(f'<node id={quoteattr(str(r["id"]))}><data key="kind">{escape(r["kind"] or "")}</data>{risk}</node>')
    out += [f'<edge source={quoteattr(str(e["src"]))} target={quoteattr(str(e["dst"]))}><data key="kind">{escape(e["kind"] or "")}</data></edge>' for e in links]
    return "\n".join([*out, "</graph>", "</graphml>"])


def to_svg(nodes: DataFrame, edges: DataFrame, how: str = "circular", size: float = 1000.0) -> str:
    rows, links = _rows(nodes, edges)
    at = layout(nodes, edges, how, size=size)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size:g} {size:g}">']
    out += [f'<line x1="{at[e["src"]][0]:.1f}" y1="{at[e["src"]][1]:.1f}" x2="{at[e["dst"]][0]:.1f}" y2="{at[e["dst"]][1]:.1f}" stroke="#bbb"/>' for e in links]
    out += [f'<circle cx="{at[r["id"]][0]:.1f}" cy="{at[r["id"]][1]:.1f}" r="8" fill="{colour(r["risk"])}"><title>{escape(str(r["id"]))}</title></circle>' for r in rows]
    return "\n".join([*out, "</svg>"])
