"""General problems: orphan references (4) and hierarchies (5)."""

from strataline.operators.edge_orphans import p4_by_month, p4_found
from strataline.operators.hierarchy import p5_ancestors, p5_descendants, p5_found, p5_hierarchy

QUERIES = {"p4_found": p4_found, "p4_by_month": p4_by_month, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants, "p5_ancestors": p5_ancestors}

_TRIM = "chr(32) || chr(9) || chr(13) || chr(10)"

_P4 = f"""
with e as (
  select id, min(dst_node_id) as dst_node_id, min(src_file_id) as src_file_id, min(indexed_at) as edge_at,
         min(case when kind = 'call' and dst_node_id is null then nullif(trim(dst_name, {_TRIM}), '') end) as dst_name
  from edges where id is not null group by id
),
target as (
  select 'dst_node_id' as field, 'nodes' as t, id as k, min(indexed_at) as target_at from nodes where id is not null group by id
  union all
  select 'src_file_id', 'files', id, min(indexed_at) from files where id is not null group by id
),
ref as (
  select id, 'dst_node_id' as field, 'nodes' as t, dst_node_id as k, edge_at from e where dst_node_id is not null
  union all
  select id, 'src_file_id', 'files', src_file_id, edge_at from e where src_file_id is not null
),
found as (
  select r.id as edge_id, r.field, r.edge_at,
         case when g.k is not null then 'late'
              when exists (select 1 from pruned_rows p where p.table_name = r.t and p.key_id = r.k) then 'deleted'
              else 'missing' end as state
  from ref r left join target g on g.field = r.field and g.k = r.k
  where g.k is null or g.target_at > r.edge_at
  union all
  select e.id, 'dst_name', e.edge_at, 'missing' from e
  where e.dst_name is not null
    and not exists (select 1 from nodes n where trim(n.name, {_TRIM}) = e.dst_name)
)
"""

_P5 = """
with recursive n as materialized (
  select id, min(parent_id) as p, min(file_id) as f from nodes where id is not null group by id
),
up(id, a) as (
  select id, p from n where p is not null
  union
  select up.id, n.p from up join n on n.id = up.a where n.p is not null
),
crossing as (select c.id from n c join n q on q.id = c.p where c.f is distinct from q.f),
cyclic as (select id from up where id = a),
s as (
  select n.id,
         case when n.id in (select id from cyclic) then 'on_cycle'
              when exists (select 1 from up where up.id = n.id and up.a in (select id from cyclic)) then 'under_cycle'
              when exists (select 1 from up where up.id = n.id and up.a not in (select id from n)) then 'broken'
              when n.id in (select id from crossing)
                or exists (select 1 from up where up.id = n.id and up.a in (select id from crossing)) then 'other_file'
              else 'ok' end as state
  from n
)
"""

_DOWN = """,
down(id, root, depth) as (
  select id, id, 0 from n where p is null or p not in (select id from n)
  union all
  select n.id, d.root, d.depth + 1 from down d join n on n.p = d.id
)
"""

SQL = {
    "p4_found": _P4 + "select edge_id, field, state from found",
    "p4_by_month": _P4 + "select field, state, strftime(edge_at, '%Y-%m') as month, count(*) as n from found group by all",
    "p5_found": _P5 + "select id as node_id, state from s where state <> 'ok'",
    "p5_hierarchy": _P5
    + """,
down(id, root, depth, path) as (
  select id, id, 0, [id] from n where p is null or p not in (select id from n)
  union all
  select n.id, d.root, d.depth + 1, list_append(d.path, n.id) from down d join n on n.p = d.id
),
ranked as (select *, row_number() over (partition by root order by path) - 1 as pre from down),
sizes as (select a as id, count(*) as size from up group by a)
select s.id as node_id, r.root, r.depth, r.pre,
       r.pre + coalesce(z.size, 0) as last_pre,
       case when r.id is not null then coalesce(z.size, 0) end as size,
       coalesce(array_to_string(r.path, '/'), '') as path, s.state
from s left join ranked r on r.id = s.id left join sizes z on z.id = s.id
""",
    "p5_descendants": _P5 + _DOWN + "select up.a as node_id, up.id as descendant_id, l.depth - h.depth as steps from up join down l on l.id = up.id join down h on h.id = up.a",
    "p5_ancestors": _P5
    + _DOWN
    + """select up.id as node_id, up.a as ancestor_id, l.depth - h.depth as steps from up join down l on l.id = up.id join down h on h.id = up.a
where not exists (select 1 from n where n.p = up.id)""",
}
