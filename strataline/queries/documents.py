"""Documents: validation, requirement names, tasks, dropped requirements, sync plan, near names."""

from pyspark.sql import functions as F

from strataline import model
from strataline.operators import documents as D


#: The folder that holds specifications and changes in the test documents.
ROOT = "lawbook"


def _specs(spark, sf_dir):
    return model.specs(spark, sf_dir).filter("kind = 'spec'")


def g20_validate(spark, sf_dir):
    return _specs(spark, sf_dir).select("doc_id", F.array_join(D.issues(F.col("text")), "; ").alias("issues"))


def f7_requirements(spark, sf_dir):
    return model.specs(spark, sf_dir).select("doc_id", F.explode(D.requirement_names(F.col("text"))).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def pr16_open_tasks(spark, sf_dir):
    return model.specs(spark, sf_dir).select("doc_id", D.open_tasks(F.col("text")).alias("n"))


def pr17_reports(spark, sf_dir):
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return model.specs(spark, sf_dir).filter(F.col("path").isNotNull() & D.is_report(name)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, sf_dir):
    """Texts by (capability, file) of changes and of canonical documents, the least document of each."""
    split = D.split_path(model.specs(spark, sf_dir), ROOT).groupBy("area", "capability", "file").agg(F.min_by("text", "doc_id").alias("text"))
    side = lambda a: split.filter(F.col("area") == a).select("capability", "file", "text")
    return side("changes"), side("specs")


def k10_sync_plan(spark, sf_dir):
    changes, canonical = _sides(spark, sf_dir)
    return D.sync_plan(changes, canonical, ["capability", "file"])


def j15_dropped(spark, sf_dir):
    """Requirement names that the largest document id of a capability lacks against the smallest."""
    split = D.split_path(model.specs(spark, sf_dir), ROOT).filter("text is not null")
    both = split.groupBy("capability").agg(F.min_by("text", "doc_id").alias("a"), F.max_by("text", "doc_id").alias("b"))
    out = D.dropped_requirements(both.select("capability", F.col("b").alias("text")), both.select("capability", F.col("a").alias("text")), ["capability"])
    return out.select("capability", F.explode("dropped").alias("name"))


def j16_near_capabilities(spark, sf_dir):
    changes, canonical = _sides(spark, sf_dir)
    return D.near_capabilities(changes, canonical)


def g20_validation(spark, sf_dir):
    """Each document of a change with what it lacks, how many requirements it drops and the canonical names it may mean."""
    found = D.validation(*_sides(spark, sf_dir))
    return found.select("capability", "file", F.array_join("issues", "; ").alias("issues"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join("near", ",").alias("near"))


QUERIES = {f.__name__: f for f in (g20_validate, g20_validation, f7_requirements, pr16_open_tasks, pr17_reports, k10_sync_plan, j15_dropped, j16_near_capabilities)}

_REQ = "regexp_extract_all({}, '(?m)^###\\s+Requirement:[ \\t]*(\\S.*?)\\s*$', 1)"
_SPLIT = """s as (select doc_id, text, regexp_extract(path, '^lawbook/(specs|changes)/([^/]+)/(.+)$', 1) as area, regexp_extract(path, '^lawbook/(specs|changes)/([^/]+)/(.+)$', 2) as capability,
  regexp_extract(path, '^lawbook/(specs|changes)/([^/]+)/(.+)$', 3) as file from documents where regexp_matches(path, '^lawbook/(specs|changes)/([^/]+)/(.+)$'))"""
_SIDES = _SPLIT + ", m as (select s.* from s join (select area, capability, file, min(doc_id) as doc_id from s where text is not null group by all) using (doc_id)), o as (select distinct area, capability, file from s)"
_ISSUES = """case when text is null then '' else concat_ws('; ', case when not regexp_matches(text, '\\b(SHALL|MUST)\\b') then 'no normative requirement (use SHALL/MUST)' end,
      case when not regexp_matches(text, '(?m)^####\\s+Scenario:') then 'no "#### Scenario:" acceptance criteria' end,
      case when not regexp_matches(text, '(?m)^###\\s+Requirement:') then 'no "### Requirement:" header' end) end"""
SQL = {
    "g20_validation": f"""with {_SIDES}, near as (
        select a.capability, string_agg(b.capability, ',' order by levenshtein(a.capability, b.capability), b.capability) as near
        from (select distinct capability from o where area = 'changes') a join (select distinct capability from o where area = 'specs') b on levenshtein(a.capability, b.capability) <= 2
        where a.capability not in (select capability from o where area = 'specs') group by a.capability)
      select o.capability, o.file, {_ISSUES.replace('text', 'mc.text')} as issues,
        coalesce(len(list_distinct(list_filter({_REQ.format('mk.text')}, lambda x: not list_contains({_REQ.format('mc.text')}, x)))), 0)::bigint as n_dropped, coalesce(near.near, '') as near
      from o left join m mc on mc.area = 'changes' and mc.capability = o.capability and mc.file = o.file
      left join m mk on mk.area = 'specs' and mk.capability = o.capability and mk.file = o.file left join near on near.capability = o.capability where o.area = 'changes'""",
    "g20_validate": """select doc_id, case when text is null then '' else concat_ws('; ', case when not regexp_matches(text, '\\b(SHALL|MUST)\\b') then 'no normative requirement (use SHALL/MUST)' end,
      case when not regexp_matches(text, '(?m)^####\\s+Scenario:') then 'no "#### Scenario:" acceptance criteria' end,
      case when not regexp_matches(text, '(?m)^###\\s+Requirement:') then 'no "### Requirement:" header' end) end as issues from documents where kind = 'spec'""",
    "f7_requirements": f"select doc_id, name, count(*) as n from (select doc_id, unnest({_REQ.format('text')}) as name from documents) group by all",
    "pr16_open_tasks": "select doc_id, len(regexp_extract_all(text, '(?m)^\\s*[-*]\\s+\\[ \\]'))::bigint as n from documents",
    "pr17_reports": "select kind, count(*) as n from documents where path like '%.md' and lower(regexp_extract(path, '([^/]+)$', 1)) <> 'readme.md' group by all",
    "k10_sync_plan": f"""with {_SIDES}
      select c.capability, c.file, case when k.capability is null then 'created' when mc.text is not distinct from mk.text then 'same' else 'updated' end as action
      from (select * from o where area = 'changes') c left join (select * from o where area = 'specs') k using (capability, file)
      left join m mc on mc.area = 'changes' and mc.capability = c.capability and mc.file = c.file left join m mk on mk.area = 'specs' and mk.capability = c.capability and mk.file = c.file""",
    "j15_dropped": f"""with {_SPLIT}, x as (select capability, arg_min(text, doc_id) as a, arg_max(text, doc_id) as b from s where text is not null group by all)
      select distinct capability, name from (select capability, unnest({_REQ.format('a')}) as name, {_REQ.format('b')} as has from x) where not list_contains(has, name)""",
    "j16_near_capabilities": f"""with {_SPLIT} select a.capability as name, b.capability as near, levenshtein(a.capability, b.capability)::int as distance
      from (select distinct capability from s where area = 'changes') a join (select distinct capability from s where area = 'specs') b on levenshtein(a.capability, b.capability) <= 2
      where a.capability not in (select capability from s where area = 'specs')""",
}
