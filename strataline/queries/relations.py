"""Scans, filters, joins, aggregates and top-k over the index tables."""

from pyspark.sql import functions as F

from strataline import model
from strataline.model import sql
from strataline.operators import code_graph as G
from strataline.queries.traversal import LINKS, NF, R, _tables
from strataline.session import table

#: A part of names, a name, and one that no node has as a whole.
SEARCH, EXPLORE, SIMILAR = "span", "RuleAdapter", "uleAdapte"


def s3_languages(spark, sf_dir):
    from strataline.sources.trees import lang_for_path

    f = model.files(spark, sf_dir).withColumn("by_path", lang_for_path("path"))
    return f.groupBy("by_path").agg(F.count(F.lit(1)).alias("n"))


def s6_row_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t in ("files", "nodes", "edges", "node_embeddings")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def pr1_substring(spark, sf_dir):
    return model.nodes(spark, sf_dir, "name").filter(F.col("name").ilike(f"%{SEARCH}%")).select("id", "name")


def pr3_edge_kinds(spark, sf_dir):
    e = model.edges(spark, sf_dir, "kind", "dst_node_id")
    return e.groupBy("kind", F.col("dst_node_id").isNull().alias("unresolved")).agg(F.count(F.lit(1)).alias("n"))


def pr4_frontier(spark, sf_dir):
    """Calls of any name that some class has."""
    e = model.edges(spark, sf_dir, "dst_name", "kind").filter("kind = 'call'")
    names = model.nodes(spark, sf_dir, "name", "kind").filter("kind = 'class' and name is not null").select(F.col("name").alias("dst_name")).distinct()
    return e.join(names, "dst_name", "left_semi").groupBy("dst_name").agg(F.count(F.lit(1)).alias("n"))


def j1_nodes_with_files(spark, sf_dir):
    return G.with_file(model.nodes(spark, sf_dir, "name", "file_id"), model.files(spark, sf_dir)).select("id", "name", "path", "repo")


def j2_callees(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.callees(e, n, f, n.filter(F.col("name") == EXPLORE)).groupBy("owner_id", "name", "line", "target", "target_kind", "file").agg(F.count(F.lit(1)).alias("n"))


def j3_callers(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.callers(e, n, f, G.with_file(n.filter(F.col("name") == EXPLORE), f).select("id", "name", "repo"))


def j4_embedded_nodes(spark, sf_dir):
    v = table(spark, sf_dir, "node_embeddings", "node_id", "model").distinct()
    known = G.with_file(model.nodes(spark, sf_dir, "kind", "file_id"), model.files(spark, sf_dir)).select(F.col("id").alias("node_id"), "kind", "repo")
    return v.join(known, "node_id").groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("repos"))


def j8_unresolved(spark, sf_dir):
    f, _, e = _tables(spark, sf_dir)
    return G.unresolved_by_file(e, f)


def a2_unresolved_by_repo(spark, sf_dir):
    return j8_unresolved(spark, sf_dir).groupBy("repo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


def j9_resolve_names(spark, sf_dir):
    return _tables(spark, sf_dir)[2].filter("kind = 'call'").select("id", "target")


def j18_owners(spark, sf_dir):
    """Nodes with the name and kind of the node they are nested in."""
    n = model.nodes(spark, sf_dir, "name", "kind", "parent_id").filter("parent_id is not null")
    up = model.nodes(spark, sf_dir, "name", "kind").select(F.col("id").alias("parent_id"), F.col("name").alias("owner"), F.col("kind").alias("owner_kind"))
    return n.join(up, "parent_id").select("id", "parent_id", "owner", "owner_kind")


def a3_first_lines(spark, sf_dir):
    return model.nodes(spark, sf_dir, "file_id", "kind", "start_line").groupBy("file_id", "kind").agg(F.min("start_line").alias("line"))


def a4_distinct_callees(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    return G.name_calls(e, n, f).select("repo", "caller", "callee").distinct()


def a12_index_stats(spark, sf_dir):
    f, n, e = _tables(spark, sf_dir)
    a = f.agg(F.count(F.lit(1)).alias("files"))
    b = n.agg(F.count(F.lit(1)).alias("nodes"))
    c = e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("kind") == "import").alias("imports"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def a16_kinds(spark, sf_dir):
    return j1_nodes_kinds(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


def j1_nodes_kinds(spark, sf_dir):
    return G.with_file(model.nodes(spark, sf_dir, "kind", "file_id"), model.files(spark, sf_dir)).select("kind")


def g1_search(spark, sf_dir):
    return G.search(model.nodes(spark, sf_dir), model.files(spark, sf_dir), SEARCH)


def g2_explore(spark, sf_dir):
    """The ten best matches of a name, each with its callers and callees counted and its fall-back rank."""
    f, n, e = _tables(spark, sf_dir)
    best = G.best_match(n, f, EXPLORE).select("id", "name", "kind", "repo", F.col("path").alias("file"), "start_line", "end_line")
    ins = G.callers(e, n, f, best.select("id", "name", "repo")).groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    outs = G.callees(e, n, f, best).groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return best.join(ins, "id", "left").join(outs, "id", "left").select("id", "name", "kind", "repo", "file", "start_line", "end_line", zero("callers"), zero("callees"))


def g2_explore_calls(spark, sf_dir):
    """Callees and callers of each of the ten best matches, a row for each."""
    f, n, e = _tables(spark, sf_dir)
    told = lambda side: F.transform(side, lambda x: F.struct(F.lit(side).alias("side"), x["name"].alias("name"), x["line"].alias("line"), x["file"].alias("file")))
    seen = G.explore(n, f, e, EXPLORE).select("id", F.explode(F.concat(told("callees"), told("callers"))).alias("x"))
    return seen.select("id", "x.*")


def g2_explore_unknown(spark, sf_dir):
    """Similar names in place of a name that no node has."""
    f, n, e = _tables(spark, sf_dir)
    return G.explore(n, f, e, SIMILAR).select("id", "name", "kind", "repo", "file", "line", "signature", "exact")


def t1_search_rank(spark, sf_dir):
    hits = model.nodes(spark, sf_dir, "name", "kind").filter(F.col("name").ilike("%cell%"))
    return hits.orderBy(F.desc((F.col("name") == "QueueCell").cast("int")), F.length("name"), "name", "id").limit(25).select("id", "name", "kind")


def t3_ordered_callees(spark, sf_dir):
    """Each caller's callees in order of line, then name."""
    f, n, e = _tables(spark, sf_dir)
    calls = e.filter("kind = 'call' and src_node_id is not null and dst_name is not null and line is not null").select("src_node_id", F.struct("line", "dst_name").alias("c"))
    return calls.groupBy("src_node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("c")), lambda x: x["dst_name"]), ",").alias("callees"))


def j12_diff(spark, sf_dir):
    """Files of one state of the index against a later one: new, changed, unchanged, removed."""
    from strataline.plans.index_build import diff_files

    raw = table(spark, sf_dir, "files").filter("id is not null and repo is not null").withColumn("path", model.clean_path("path"))
    cut = F.lit("2024-07-01").cast("timestamp")
    last = raw.groupBy("repo", "path").agg(F.min_by("hash", F.struct("indexed_at", "id")).alias("old"), F.max_by("hash", F.struct("indexed_at", "id")).alias("new"), F.min("indexed_at").alias("first"), F.max("indexed_at").alias("last"))
    old = last.filter(F.col("first") < cut).select("repo", "path", F.col("old").alias("hash"))
    new = last.filter(F.col("last") >= F.lit("2024-01-01").cast("timestamp")).select("repo", "path", F.col("new").alias("hash"))
    return diff_files(old, new, ["repo", "path"]).groupBy("repo", "state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        s3_languages, s6_row_counts, pr1_substring, pr3_edge_kinds, pr4_frontier, j1_nodes_with_files, j2_callees, j3_callers, j4_embedded_nodes, j8_unresolved,
        a2_unresolved_by_repo, j9_resolve_names, j18_owners, a3_first_lines, a4_distinct_callees, a12_index_stats, a16_kinds, g1_search, g2_explore, g2_explore_calls, g2_explore_unknown, t1_search_rank,
        t3_ordered_callees, j12_diff,
    )
}

_CALLERS = """callers as materialized (
  select distinct o.id as owner_id, c.id as caller_id, c.name, c.kind, c.path as file, c.start_line as line
  from nf o join r on r.kind = 'call' and r.src_node_id is not null and (r.target = o.id or (r.repo = o.repo and r.dst_name = o.name))
  join nf c on c.id = r.src_node_id where o.name = '{}'
)""".format(EXPLORE)
_CALLEES = """callees as materialized (
  select r.src_node_id as owner_id, r.dst_name as name, r.line, r.target, g.kind as target_kind, f.path as file
  from r join n o on o.id = r.src_node_id left join n g on g.id = r.target left join f on f.id = g.file_id
  where r.kind = 'call' and o.name = '{}'
)""".format(EXPLORE)
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
SQL = {
    "s3_languages": sql(f"select case when {_EXT} in ('py', 'pyi') then 'python' when {_EXT} in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when {_EXT} in ('ts', 'tsx', 'mts', 'cts') then 'typescript' end as by_path, count(*) as n from f group by 1"),
    "s6_row_counts": " union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in ("files", "nodes", "edges", "node_embeddings")),
    "pr1_substring": sql(f"select id, name from n where name ilike '%{SEARCH}%'"),
    "pr3_edge_kinds": sql("select kind, dst_node_id is null as unresolved, count(*) as n from e group by all"),
    "pr4_frontier": sql("select dst_name, count(*) as n from e where kind = 'call' and dst_name in (select name from n where kind = 'class' and name is not null) group by all"),
    "j1_nodes_with_files": sql("select id, name, path, repo from nf", NF),
    "j2_callees": sql("select *, count(*) as n from callees group by all", R, _CALLEES),
    "j3_callers": sql("select * from callers", R, NF, _CALLERS),
    "j4_embedded_nodes": sql("select model, kind, count(*) as n, count(distinct repo) as repos from (select distinct node_id, model from node_embeddings) v join nf on nf.id = v.node_id group by all", NF),
    "j8_unresolved": sql("select f.repo, f.id as src_id, f.path as src, count(*) as n from r join f on f.id = r.src_file_id where target is null group by all", R),
    "a2_unresolved_by_repo": sql("select repo, sum(n)::bigint as n, count(*) as files from (select f.repo, f.id, count(*) as n from r join f on f.id = r.src_file_id where target is null group by all) group by repo", R),
    "j9_resolve_names": sql("select id, target from r where kind = 'call'", R),
    "j18_owners": sql("select n.id, n.parent_id, p.name as owner, p.kind as owner_kind from n join n p on p.id = n.parent_id"),
    "a3_first_lines": sql("select file_id, kind, min(start_line) as line from n group by all"),
    "a4_distinct_callees": sql("select distinct nf.repo, nf.name as caller, r.dst_name as callee from r join nf on nf.id = r.src_node_id where r.kind = 'call' and r.dst_name is not null and nf.name is not null", R, NF),
    "a12_index_stats": sql("select (select count(*) from f) as files, (select count(*) from n) as nodes, count(*) as edges, count(target) as resolved, count_if(kind = 'import')::bigint as imports from r", R),
    "a16_kinds": sql("select kind, count(*) as total from nf group by kind", NF),
    "g1_search": sql(f"select id, name, kind, repo, path as file, start_line as line, signature from nf where name ilike '%{SEARCH}%' order by name = '{SEARCH}' desc, length(name), name, id limit 25", NF),
    "g2_explore": sql(
        f"""select o.id, o.name, o.kind, o.repo, o.path as file, o.start_line, o.end_line,
        (select count(*) from callers where owner_id = o.id) as callers, (select count(*) from callees where owner_id = o.id) as callees
        from (select *, case kind when 'function' then 0 when 'class' then 1 else 2 end as k from nf where name = '{EXPLORE}' order by k, id limit 10) o""",
        R, NF, _CALLERS, _CALLEES),
    "g2_explore_calls": sql(
        f"""select id, side, x.name, x.line, x.file from (select id from nf where name = '{EXPLORE}' order by case kind when 'function' then 0 when 'class' then 1 else 2 end, id limit 10) o
        join (select distinct owner_id, 'callees' as side, name, line, file from callees union all select distinct owner_id, 'callers', name, line, file from callers) x on x.owner_id = o.id""",
        R, NF, _CALLERS, _CALLEES),
    "g2_explore_unknown": sql(f"select id, name, kind, repo, path as file, start_line as line, signature, false as exact from nf where name ilike '%{SIMILAR}%' and not exists (select 1 from n where name = '{SIMILAR}') order by length(name), name, id limit 10", NF),
    "t1_search_rank": sql("select id, name, kind from n where name ilike '%cell%' order by name = 'QueueCell' desc, length(name), name, id limit 25"),
    "t3_ordered_callees": sql("select src_node_id, string_agg(dst_name, ',' order by line, dst_name) as callees from (select distinct src_node_id, line, dst_name from e where kind = 'call' and src_node_id is not null and dst_name is not null and line is not null) group by all"),
    "j12_diff": f"""with x as (select repo, nullif({model._PATH}, '') as path, hash, indexed_at, id from files where id is not null and repo is not null),
      l as (select repo, path, arg_min(hash, (indexed_at, id)) as old, arg_max(hash, (indexed_at, id)) as new, min(indexed_at) as first, max(indexed_at) as last from (select * from x where hash is not null) group by repo, path
            union all select repo, path, null, null, min(indexed_at), max(indexed_at) from x group by repo, path having count(hash) = 0),
      k as (select l.repo, l.path, l.old, l.new, z.first, z.last from l join (select repo, path, min(indexed_at) as first, max(indexed_at) as last from x group by repo, path) z on z.repo = l.repo and z.path is not distinct from l.path),
      o as (select repo, path, old as hash from k where first < timestamp '2024-07-01'), w as (select repo, path, new as hash from k where last >= timestamp '2024-01-01')
      select coalesce(o.repo, w.repo) as repo, case when o.repo is null then 'new' when w.repo is null then 'removed' when o.hash is not distinct from w.hash then 'unchanged' else 'changed' end as state, count(*) as n
      from o full join w on o.repo = w.repo and o.path is not distinct from w.path group by all""",
}
