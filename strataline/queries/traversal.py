"""Graph queries: impact, trace, neighbourhood, degree, components, cycles, reachability."""

from pyspark.sql import functions as F

from strataline import model
from strataline.model import sql
from strataline.operators import code_graph as G
from strataline.operators.graph import nearest, shortest_cycles, strong_components

NAME, START, FOCUS = "emitSignal", "clonePath", "QueueCell"


def _tables(spark, sf_dir):
    f, n = model.files(spark, sf_dir), model.nodes(spark, sf_dir)
    return f, n, G.resolve_calls(model.edges(spark, sf_dir), n, f)


def g4_impact(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.impact(e, n, f, NAME)


def g5_trace(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.trace(e, n, f, START, NAME)


def g6_neighbourhood(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.neighbourhood(n, f, G.links(e), FOCUS)


def t5_top_by_degree(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.top_by_degree(n, f, G.links(e))


def g6_induced_links(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    pairs = G.links(e)
    return G.induced_links(pairs, G.top_by_degree(n, f, pairs)).groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))


def a9_degree(spark, sf_dir):
    return G.degrees(G.links(_tables(spark, sf_dir)[2]))


def _files_graph(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.file_graph(e, n, f)


def j7_file_edges(spark, sf_dir):
    return _files_graph(spark, sf_dir)


def a10_adjacency(spark, sf_dir):
    g = _files_graph(spark, sf_dir)
    return g.groupBy("src_id").agg(F.array_join(F.array_sort(F.collect_set("dst_id")), ",").alias("targets"), F.count_distinct("dst_id").alias("n"))


def _scc_edges(spark, sf_dir):
    return _files_graph(spark, sf_dir).select(F.col("repo").alias("scope"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def g7_strong_components(spark, sf_dir):
    return strong_components(_scc_edges(spark, sf_dir), "scope")


def g8_shortest_cycles(spark, sf_dir):
    found = shortest_cycles(_scc_edges(spark, sf_dir), "scope")
    return found.select("scope", "scc", "size", F.size("cycle").alias("length"), F.array_join("cycle", ">").alias("cycle"))


def g9_reachable(spark, sf_dir):
    """From every file under src/api/ to the nearest file under lib/, over file edges."""
    g = _files_graph(spark, sf_dir).filter("src_id <> dst_id")
    files = model.files(spark, sf_dir)
    seeds = files.filter(F.col("path").rlike("^src/api/")).select("repo", F.col("id").alias("node"))
    hits = files.filter(F.col("path").rlike("^lib/")).select("repo", F.col("id").alias("node"))
    edges = g.select("repo", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return nearest(edges, seeds, hits, ["repo"])


QUERIES = {
    f.__name__: f
    for f in (g4_impact, g5_trace, g6_neighbourhood, t5_top_by_degree, g6_induced_links, a9_degree, j7_file_edges, a10_adjacency, g7_strong_components, g8_shortest_cycles, g9_reachable)
}

R = """r as materialized (
  select e.*, fs.repo, case when e.kind = 'call' then coalesce(alive.id, b.by_name) end as target
  from e left join f fs on fs.id = e.src_file_id left join n alive on alive.id = e.dst_node_id
  left join (select repo, name, min(n.id) as by_name from n join f on f.id = n.file_id where name is not null group by repo, name) b
    on b.repo = fs.repo and b.name = e.dst_name
)"""
NF = "nf as materialized (select n.*, f.path, f.repo from n join f on f.id = n.file_id)"
CALLS = """calls as materialized (
  select nf.repo, nf.name as caller, r.dst_name as callee, r.src_node_id from r join nf on nf.id = r.src_node_id
  where r.kind = 'call' and r.dst_name is not null and nf.name is not null
)"""
LINKS = "links as materialized (select src_node_id as s, target as t from r where kind = 'call' and target is not null and src_node_id is not null)"
DEG = "deg as materialized (select id, count(*) as deg from (select s as id from links where s <> t union all select t from links where s <> t) group by id)"
TOP = "top as materialized (select nf.id, name, kind, path as file, start_line as line, coalesce(deg, 0) as deg from nf left join deg on deg.id = nf.id order by coalesce(deg, 0) desc, nf.id limit 300)"
G_SQL = """g as materialized (
  select s.repo, s.id as src_id, s.path as src, d.id as dst_id, d.path as dst, min(r.line) as line
  from r join n on n.id = r.target join f s on s.id = r.src_file_id join f d on d.id = n.file_id where s.repo = d.repo group by all
)"""
_REACH = "ways as (select src_id as a, dst_id as b from g where src_id <> dst_id union select w.a, g.dst_id from ways w join g on g.src_id = w.b and g.src_id <> g.dst_id)"
_SCC = "parts as materialized (select w.a as node, min(least(w.a, w.b)) as scc from ways w join ways v on v.a = w.b and v.b = w.a group by w.a)"

SQL = {
    "g4_impact": sql(
        "select nf.id, nf.name, nf.kind, nf.repo, nf.path as file, nf.start_line as line, min(w.d) + 1 as depth from calls c join w on w.repo = c.repo and w.name = c.callee join nf on nf.id = c.src_node_id group by all",
        R, NF, CALLS,
        f"w(repo, name, d) as (select distinct repo, '{NAME}', 0 from calls union select c.repo, c.caller, d + 1 from w join calls c on c.repo = w.repo and c.callee = w.name where d < 3)",
        recursive=True,
    ),
    "g5_trace": sql(
        "select repos.repo, nullif(array_to_string(path, ' -> '), '') as path, coalesce(len(path) - 1, -1) as hops from (select distinct repo from calls) repos left join back on back.repo = repos.repo and back.d = 0",
        R, NF, CALLS,
        f"w(repo, name, d) as (select distinct repo, '{START}', 0 from calls union select c.repo, c.callee, d + 1 from w join calls c on c.repo = w.repo and c.caller = w.name where d < 8)",
        "dist as materialized (select repo, name, min(d) as d from w group by all)",
        "up as materialized (select x.repo, x.name, x.d, min(y.name) as parent from dist x join calls c on c.repo = x.repo and c.callee = x.name join dist y on y.repo = x.repo and y.name = c.caller and y.d = x.d - 1 group by all)",
        f"back(repo, name, d, path) as (select repo, name, d, [name] from dist where name = '{NAME}' union all select b.repo, up.parent, b.d - 1, list_prepend(up.parent, b.path) from back b join up on up.repo = b.repo and up.name = b.name)",
        recursive=True,
    ),
    "g6_neighbourhood": sql(
        "select nf.id, name, kind, path as file, start_line as line, coalesce(deg, 0) as deg, min(w.d) as depth from w join nf on nf.id = w.id left join deg on deg.id = nf.id group by all",
        R, NF, LINKS, DEG,
        "pair as (select s as x, t as y from links where s <> t union select t, s from links where s <> t)",
        f"w(id, d) as (select id, 0 from nf where name = '{FOCUS}' union select pair.y, d + 1 from w join pair on pair.x = w.id where d < 2)",
        recursive=True,
    ),
    "t5_top_by_degree": sql("select * from top", R, NF, LINKS, DEG, TOP),
    "g6_induced_links": sql("select s, t, count(*) as n from links where s in (select id from top) and t in (select id from top) group by all", R, NF, LINKS, DEG, TOP),
    "a9_degree": sql("select * from deg", R, LINKS, DEG),
    "j7_file_edges": sql("select * from g", R, G_SQL),
    "a10_adjacency": sql("select src_id, array_to_string(list_sort(list(distinct dst_id)), ',') as targets, count(distinct dst_id) as n from g group by src_id", R, G_SQL),
    "g7_strong_components": sql(
        "select g.repo as scope, p.node, p.scc, s.size::int as size from parts p join (select scc, count(*) as size from parts group by scc) s on s.scc = p.scc join (select distinct repo, src_id from g) g on g.src_id = p.node",
        R, G_SQL, _REACH, _SCC, recursive=True,
    ),
    "g9_reachable": sql(
        """select repo, origin, hit, depth from (
          select w.repo, w.origin, w.node as hit, w.d as depth, row_number() over (partition by w.repo, w.origin order by w.d, w.node) as k
          from w join f on f.id = w.node where w.d > 0 and regexp_matches(f.path, '^lib/')) where k = 1""",
        R, G_SQL,
        "w(repo, origin, node, d) as (select repo, id, id, 0 from f where regexp_matches(path, '^src/api/') union select w.repo, w.origin, g.dst_id, d + 1 from w join g on g.src_id = w.node and g.src_id <> g.dst_id where d < 12)",
        recursive=True,
    ),
}
