"""Drawings: a query's plan as DOT, and the lineage graph as one HTML file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tidewell.operators.lineage import Graph, layout


def plan_dot(df: DataFrame) -> str:
    """The analysed plan as a DOT digraph, data flowing from sources to the result."""
    lines, count = ["digraph plan {", "  rankdir=LR;", "  node [shape=box];"], 0

    def walk(node) -> int:
        nonlocal count
        me, count = count, count + 1
        lines.append(f"  n{me} [label={json.dumps(node.nodeName())}];")
        children = node.children()
        for i in range(children.size()):
            lines.append(f"  n{walk(children.apply(i))} -> n{me};")
        return me

    walk(df._jdf.queryExecution().analyzed())
    return "\n".join([*lines, "}"])


_PAGE = """<!DOCTYPE html>
<html lang="es"><head><meta charset="utf-8"><title>%(title)s</title>
<style>body{margin:0;font:13px sans-serif}#bar{padding:8px}svg{display:block}line{stroke:#99a}circle{fill:#47a;cursor:pointer}.off{opacity:.12}.hit circle{fill:#d62}</style></head>
<body><div id="bar"><input id="q" placeholder="buscar"> <label><input type="checkbox" id="x"> ocultar externas</label> <span id="info"></span></div><svg id="g"></svg>
<script id="data" type="application/json">%(data)s</script>
<script>
const d=JSON.parse(document.getElementById('data').textContent),S='http://www.w3.org/2000/svg',g=document.getElementById('g');
const at=new Map(d.nodes.map(n=>[n.id,n])),make=(t,a)=>{const e=document.createElementNS(S,t);for(const k in a)e.setAttribute(k,a[k]);return e};
g.setAttribute('width',d.width);g.setAttribute('height',d.height);
const lines=d.edges.map(e=>{const a=at.get(e[0]),b=at.get(e[1]),l=make('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y});g.append(l);return[e,l]});
const groups=d.nodes.map(n=>{const k=make('g',{}),c=make('circle',{cx:n.x,cy:n.y,r:7}),t=make('text',{x:n.x+11,y:n.y+4});t.textContent=n.name;k.append(c,t);g.append(k);k.onclick=()=>mark(n.id);return[n,k]});
function reach(id,i,j){const seen=new Set([id]);for(let todo=[id];todo.length;){const next=[];for(const[e]of lines)if(todo.includes(e[i])&&!seen.has(e[j])){seen.add(e[j]);next.push(e[j])}todo=next}return seen}
function mark(id){const up=reach(id,1,0),down=reach(id,0,1);for(const[n,k]of groups)k.classList.toggle('off',!up.has(n.id)&&!down.has(n.id));const n=at.get(id);document.getElementById('info').textContent=n.id+' · '+n.type+' · '+(n.detail||'')}
document.getElementById('q').oninput=e=>{const q=e.target.value.toLowerCase();for(const[n,k]of groups){k.classList.remove('off');k.classList.toggle('hit',q!==''&&n.id.includes(q))}};
document.getElementById('x').onchange=e=>{for(const[n,k]of groups)k.style.display=e.target.checked&&n.type==='externo'?'none':''};
</script></body></html>"""


def viewer(graph: Graph, title: str = "Linaje") -> str:
    """One self-contained page; what is embedded can't end its script."""
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    edges = graph.collected_edges()
    placed = layout(sorted(nodes), edges)
    data = {
        "nodes": [{"id": i, "name": i.rpartition(".")[2], "type": nodes[i]["tipo"], "detail": nodes[i]["detalle"], "x": x, "y": y} for i, _, _, x, y in placed],
        "edges": edges,
        "width": max((p[3] for p in placed), default=0) + 260,
        "height": max((p[4] for p in placed), default=0) + 60,
    }
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return _PAGE % {"title": safe, "data": json.dumps(data, ensure_ascii=False).replace("</", "<\\/")}
