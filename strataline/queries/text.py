"""Scalar functions and vectors: tokens, embedding, recall, hashes, distances, versions, JSON."""

from pyspark.sql import functions as F

from strataline import model
from strataline.functions.paths import is_newer, relative_uri, target_path
from strataline.functions.text import embed_sparse, signature, tokenize
from strataline.functions.vectors import from_blob, to_blob
from strataline.model import sql
from strataline.operators.history import churn
from strataline.operators.near_names import near_names
from strataline.operators.recall import recall_text, recall_vector
from strataline.session import table

TEXT = "function mergeTokenBudget for the session cache"


def f1_tokenize(spark, sf_dir):
    return model.nodes(spark, sf_dir, "name").select("id", F.array_join(tokenize(F.col("name")), ",").alias("tokens"))


def f2_embed(spark, sf_dir):
    n = model.nodes(spark, sf_dir, "kind", "name", "signature").select("id", F.concat_ws(" ", "kind", "name", "signature").alias("text"))
    return embed_sparse(n, "id", "text").withColumn("weight", F.round("weight", 6))


def g3_recall(spark, sf_dir):
    return recall_text(model.nodes(spark, sf_dir, "kind", "name", "signature"), TEXT)


def g3_recall_vector(spark, sf_dir):
    """Vectors most like an even one of 64 entries."""
    return recall_vector(table(spark, sf_dir, "node_embeddings"), [(-1.0) ** i / 8 for i in range(64)])


def f3_cosine_to_first(spark, sf_dir):
    """Of each model and dim: the mean product of a vector's halves, as a check of dot over equal lengths."""
    from strataline.functions.text import dot

    v = table(spark, sf_dir, "node_embeddings").filter("vec is not null").distinct()
    half = F.floor(F.size("vec") / 2).cast("int")
    return v.filter(half > 0).select("node_id", "model", (F.round(dot(F.slice("vec", F.lit(1), half), F.slice("vec", half + 1, half)), 4) + 0.0).alias("score")).filter(~F.isnan("score") & (F.abs("score") < 1e9))


def f4_blob(spark, sf_dir):
    v = table(spark, sf_dir, "node_embeddings", "node_id", "model", "vec").withColumn("blob", to_blob("vec"))
    return v.select("node_id", "model", F.octet_length("blob").cast("long").alias("octets"), (to_blob(from_blob("blob")) == F.col("blob")).alias("same"))


def f5_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def f6_edit_distance(spark, sf_dir):
    return model.nodes(spark, sf_dir, "name").filter(F.col("name").rlike("^[ -~]+$")).select("id", F.levenshtein("name", F.lit("RuleAdapter")).cast("long").alias("distance"))


def f8_groups(spark, sf_dir):
    """The feature of a path by a capture group, empty where the pattern does not match."""
    return model.files(spark, sf_dir).select("id", F.regexp_extract("path", r"^src/features/([^/]+)/", 1).alias("feature"))


def f11_uri(spark, sf_dir):
    return table(spark, sf_dir, "files", "id", "path").distinct().select("id", relative_uri(F.concat(F.lit("C:\\"), F.col("path"))).alias("uri"))


def f13_target_path(spark, sf_dir):
    f = model.files(spark, sf_dir).filter("path is not null")
    kind = F.pmod("id", F.lit(4))
    as_json = lambda *keys: F.to_json(_nested(keys))
    payload = F.when(kind == 0, as_json("tool_input", "file_path")).when(kind == 1, as_json("toolInput", "filePath")).when(kind == 2, as_json("path")).otherwise(as_json("other"))
    return f.select("id", target_path(payload).alias("target"))


def _nested(keys):
    out = F.concat(F.lit("./"), F.col("path")) if keys[-1] == "path" else F.col("path")
    for k in reversed(keys):
        out = F.struct(out.alias(k))
    return out


def f15_signature(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", signature(F.col("text")).alias("signature"))


def f18_is_newer(spark, sf_dir):
    return table(spark, sf_dir, "third_party").select("package", "file_name", "version", is_newer(F.col("version"), F.lit("4.4.0")).alias("newer"))


def f21_json_payload(spark, sf_dir):
    """Churn of each repository written to one JSON object and read back."""
    c = churn(model.touches(spark, sf_dir))
    packed = c.groupBy("repo").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "commits")))).alias("payload"))
    return packed.select("repo", F.explode(F.from_json("payload", "map<string,bigint>")).alias("path", "commits"))


def j16_near_names(spark, sf_dir):
    """Names called in no definition, with defined names within two edits; names of up to 16 letters."""
    e = model.edges(spark, sf_dir, "dst_name", "kind").filter("kind = 'call' and dst_name rlike '^[ -~]{1,16}$'").select(F.col("dst_name").alias("name"))
    n = model.nodes(spark, sf_dir, "name").filter("name rlike '^[ -~]{1,16}$'").select("name")
    return near_names(e, n, "name")


def j16_near_names_all(spark, sf_dir):
    """Names called in no definition, with defined names within two edits; names of any length and script."""
    e = model.edges(spark, sf_dir, "dst_name", "kind").filter("kind = 'call'").select(F.col("dst_name").alias("name"))
    return near_names(e, model.nodes(spark, sf_dir, "name").select("name"), "name")


QUERIES = {
    f.__name__: f
    for f in (f1_tokenize, f2_embed, g3_recall, g3_recall_vector, f3_cosine_to_first, f4_blob, f5_sha256, f6_edit_distance, f8_groups, f11_uri, f13_target_path, f15_signature, f18_is_newer, f21_json_payload, j16_near_names, j16_near_names_all)
}

_TOKENS = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1)"


def _sparse(name: str, source: str) -> str:
    """CTE of (id, bucket, weight) from a source of (id, text)."""
    return f"""{name} as materialized (
      with tok as (select id, unnest({_TOKENS.format('text')}) as token from ({source})),
      hit as (
        select id, ('0x' || substr(md5(token), 1, 4))::int % 256 as bucket, case when ('0x' || substr(md5(token), 5, 2))::int % 2 = 1 then 1 else -1 end as sign from tok
        union all
        select id, ('0x' || substr(md5(token), 7, 4))::int % 256, case when ('0x' || substr(md5(token), 5, 2))::int % 2 = 1 then 1 else -1 end from tok
      ),
      summed as (select id, bucket, sum(sign) as w from hit group by all),
      norm as (select id, sqrt(sum(w * w)) as norm from summed group by id)
      select s.id, s.bucket, s.w / norm as weight from summed s join norm using (id) where s.w <> 0
    )"""


_NODES = "select id, concat_ws(' ', kind, name, signature) as text from n"
_FIN = "list_bool_and(list_transform(vec, lambda x: isfinite(x)))"
SQL = {
    "f1_tokenize": sql(f"select id, array_to_string({_TOKENS.format('name')}, ',') as tokens from n"),
    "f2_embed": sql("select id, bucket, round(weight, 6) as weight from sp", _sparse("sp", _NODES)),
    "g3_recall": sql("select sp.id, round(sum(sp.weight * q.weight), 6) as score from sp join q on q.bucket = sp.bucket group by sp.id order by score desc, sp.id limit 15", _sparse("sp", _NODES), _sparse("q", f"select 0 as id, '{TEXT}' as text")),
    "g3_recall_vector": f"""select distinct node_id, model, round(list_dot_product(vec::double[], [(case when i % 2 = 0 then 1 else -1 end) / 8.0::double for i in range(64)]), 6) as score
      from node_embeddings where dim = 64 and len(vec) = 64 and {_FIN} order by score desc, node_id, model limit 15""",
    "f3_cosine_to_first": """select * from (select distinct node_id, model, round(list_dot_product(vec[1:len(vec) // 2]::double[], vec[len(vec) // 2 + 1:2 * (len(vec) // 2)]::double[]), 4) + 0 as score
      from (select distinct * from node_embeddings) where len(vec) >= 2) where not isnan(score) and abs(score) < 1e9""",
    "f4_blob": "select node_id, model, len(vec)::bigint * 4 as octets, case when vec is not null then true end as same from node_embeddings",
    "f5_sha256": "select doc_id, sha256(text) as hash from documents",
    "f6_edit_distance": sql("select id, levenshtein(name, 'RuleAdapter') as distance from n where regexp_full_match(name, '[ -~]+')"),
    "f8_groups": sql("select id, regexp_extract(path, '^src/features/([^/]+)/', 1) as feature from f"),
    "f11_uri": "select distinct id, regexp_replace(replace(path, chr(92), '/'), '^/+', '') as uri from files",
    "f13_target_path": sql("select id, case when id % 4 <> 3 then path end as target from f where path is not null"),
    "f15_signature": f"select doc_id, substr(trim(split_part(text, chr(10), 1), {model._WS}), 1, 200) as signature from documents",
    "f18_is_newer": "select package, file_name, version, list_transform(string_split(version, '.'), lambda x: x::int) > [4, 4, 0] as newer from third_party",
    "f21_json_payload": sql("select repo, path, count(*) as commits from t group by all"),
    "j16_near_names": sql("""select a.name, b.near, levenshtein(a.name, b.near)::int as distance
      from (select distinct dst_name as name from e where kind = 'call' and regexp_full_match(dst_name, '[ -~]{1,16}')) a
      join (select distinct name as near from n where regexp_full_match(name, '[ -~]{1,16}')) b on levenshtein(a.name, b.near) <= 2
      where a.name not in (select name from n where regexp_full_match(name, '[ -~]{1,16}'))"""),
}
