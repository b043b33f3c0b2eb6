"""Generated, minified, vendored and data files among source files.

1. Known copies: the hash is one of a published third-party file.
2. Edited copies, by an inverted index of line hashes. Files of equal lines are one class. A
   class looks for the holders of its rarest lines, so many that a file with a large enough
   share of its lines holds one of them (prefix filter); lines of one repository only drop out.
   For each proposed pair the share of the file's lines that the other holds is computed exactly.
3. Edited copies of which little is left, or of which only the head is at hand, by the same
   index over lines of comments: the share of a file's rare notes that a known copy in another
   repository holds is computed exactly.
4. Notes that cite a published package with its version, banners and folders of packages.
5. What is left is judged by composition: generator's notes, generated names, numbered or
   repeated line shapes, line length and white space, and the share of data tokens.

Everything is built of Spark's own string functions; nothing is collected. Jobs run while a result is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.references import salted_join
from strataline.session import materialize, table

#: Shorter lines say nothing about where a file comes from.
LINE_CHARS = 12
#: A file is an edited copy if it shares so many lines and such a share of them with one in another repository.
SHARED_LINES, SHARED_PART = 4, 0.5
#: A note says something if it has so many characters, and is rare if at most one in so many files, or a few, hold it.
NOTE_CHARS, RARE, FEW = 8, 1_000, 8
#: Holders of a line, and classes that look for it, whose pairs are made together.
HOLDERS = 2_048
#: A line so long with so little white space is not written by hand.
LONG_LINE, LOOSE = 320, 0.14
#: Bytes for each line beyond which lines are packed.
PACKED = 400
#: Share of data tokens in a head, and the least length of a head that is judged by it.
DATA_PART, DATA_CHARS = 0.8, 400
#: Lines, and the share of different shapes among them, from which lines count as turned out by a program.
SHAPE_LINES, SHAPE_PART = 8, 0.35

# Used by the SQL too: a line of comment, and the characters that are taken off both ends of a line.
NOTE = r"^\s*(//|#|/\*|\*|<!--)"
MARKS = " \t\n\r\f\v/*#<!>-"

# Fixed patterns of the rules.
SHEBANG = r"^\s*#![^\n]*\n\s*"
# (possessive, so that a comment of any length needs no stack)
LEADING = r"^\s*+(?:#![^\n]*+\n\s*+)?+(?:(?:/\*(?s:.*?)\*/\s*+|//[^\n]*+(?:\n|$)\s*+|#[^\n]*+(?:\n|$)\s*+|<!--(?s:.*?)-->\s*+)++)"
MADE_NOTE = (
    r"(?i)(auto-?\s?generated\b|auto-?created\b|@generated\b|<auto-generated|\bcode generated (by|from)\b|^\W*(this (file|code) (is|was) )?generated (by|from|using|with)\b"
    r"|\bfile (is|was) (automatically )?(generated|produced|created) (by|from)\b|\bmachine[- ](output|generated|made)\b|\bproduced (by|from) \S+|\bwritten by \S+( \S+)?; edit\b"
    r"|\bre-?generate with\b|\bchanges (made )?(here|to this file) (will|may) be lost\b|\bdo not edit\b(?!\s+without)(?=\W*$|\W*(this|by hand|directly|manually))"
    r"|automatisch (erzeugt|erstellt|generiert)|nicht von hand ändern|(creado|generado) automáticamente|archivo generado|arquivo gerado|gerado (por|automaticamente)"
    r"|(généré|créé) automatiquement|fichier généré|自動生成|自动生成|자동 생성|сгенерирован автоматически)"
)
NOT_MADE_NOTE = r"(?i)(not (itself |auto-?)?generated|never generated)"
PACKAGE_NOTE = (
    r"(?i)(\bcopied from (upstream )?\S+ \(?v?\d+\.\d+|\btaken from \S+ v?\d+\.\d+|\b(vendored|imported|adapted) from \S+ v?\d+\.\d+|@license \S+ \|? ?v?\d+\.\d+"
    r"|^\W*[\w.@/-]+ v\d+\.\d+[\w.-]*\W+(released|licen[sc]ed|distributed|\(c\)|copyright)|[\w.-]+ - version \d+\.\d+[\w.-]* - \(c\))"
)
PACKAGE_PLACE = r"(?i)(^|/)(_?vendor(ed)?|bower_components|node_modules|site-packages|third[_-]?party|deps|contrib|externals?|static/js)/(@[^/]+/)?[^/]+/[^/]+$"
MADE_NAME = r"(?i)((^|/)(__generated__|generated|autogen|gen|stubs|_generated)/[^/]+$|(\.|_)(g|gen|generated|pb|pb2|pb2_grpc|stubs|designer)\.[a-z]+$|\.d\.[cm]?ts$)"
SMALL_NAME = r"(?i)([.-]min\.[cm]?jsx?$|\.(bundle|packed)\.[cm]?js$|[.-][0-9a-f]{6,}\.[cm]?js$)"
TRANSPILED = r"(var __\w+ = \(this && this\.__\w+\)|Object\.defineProperty\(exports, ['\"]__esModule['\"]|\b__webpack_require__\b|\beval\(function\(p,a,c,k,e,[rd]\)|^\W*System\.register\(\[)"
DATA_TOKEN = r"-?0x[0-9a-fA-F]{2,8}\s*,?\s*|-?\d+\.\d{3,}\s*,?\s*|\b\d{1,12}\s*,\s*|\"[^\"\n]{1,80}\":\s*(\"[^\"\n]*(\"|$)|\[[-\d.,\s]*(\]|$))\s*,?\s*|[A-Za-z0-9+/=]{80,}|[\[\]{}()]"


def _head_facts(heads: DataFrame) -> DataFrame:
    """file_id, size facts, comment, body lines (trimmed, telling ones), and measures of composition."""
    one = heads.filter("file_id is not null").groupBy("file_id").agg(F.max(F.struct("head", "n_bytes", "n_lines")).alias("h"))
    one = one.select("file_id", F.coalesce("h.head", F.lit("")).alias("head"), "h.n_bytes", "h.n_lines")
    # found once: the leading comment with its shebang; what follows it is the body
    one = one.withColumn("lead", F.regexp_extract("head", LEADING, 0))
    comment = F.regexp_replace("lead", SHEBANG, "")
    body = F.expr("substring(head, length(lead) + 1)")
    lines = F.split("head", "\n")
    chars = F.length("head")
    tight = F.length(F.translate("head", " \t\r\n", ""))
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    facts = one.select("file_id", "head", "n_bytes", "n_lines", comment.alias("comment"), body.alias("body"), chars.alias("chars"), (F.lit(1) - tight / F.greatest(chars, F.lit(1))).alias("loose"), longest.alias("longest"))
    telling = F.filter(F.transform(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: F.length(x) >= LINE_CHARS)
    plain = lambda x: F.lower(F.btrim(x, F.lit(MARKS)))
    said = F.transform(F.filter(F.split("head", "\n"), lambda x: x.rlike(NOTE)), lambda x: F.regexp_replace(plain(x), r"\s+", " "))
    notes = F.array_distinct(F.filter(said, lambda x: F.length(x) >= NOTE_CHARS))
    all_lines = F.filter(F.transform(F.split("head", "\n"), plain), lambda x: F.length(x) >= LINE_CHARS)
    # a cut head ends inside a line
    whole = F.when((F.col("chars") >= DATA_CHARS) & (F.size(F.split("body", "\n")) > 1), F.regexp_replace("body", r"\n[^\n]*$", "")).otherwise(F.col("body"))
    return facts.withColumn("notes", notes).withColumn("all_lines", all_lines).withColumn("body", whole).withColumn("lines", telling)


def _composition(facts: DataFrame) -> DataFrame:
    shapes = F.array_distinct(F.transform("lines", lambda x: F.regexp_replace(x, r"\d+", "0")))
    data = F.lit(1) - F.length(F.regexp_replace("head", DATA_TOKEN, "")) / F.greatest(F.col("chars"), F.lit(1))
    per_line = F.col("n_bytes") / F.greatest(F.col("n_lines"), F.lit(1))
    is_data = (F.col("chars") >= DATA_CHARS) & (data >= DATA_PART)
    packed = (F.col("loose") <= LOOSE) & ((F.col("longest") >= LONG_LINE) | F.coalesce((per_line >= PACKED) & (F.col("longest") >= 120), F.lit(False)))
    turned_out = (F.size("lines") >= SHAPE_LINES) & (F.size(shapes) <= F.size("lines") * SHAPE_PART)
    note = F.col("comment")
    noted = note.rlike(MADE_NOTE) & ~note.rlike(NOT_MADE_NOTE)
    return facts.select(
        "file_id", "all_lines", "notes", note.rlike(PACKAGE_NOTE).alias("package_note"), noted.alias("made_note"), is_data.alias("is_data"),
        packed.alias("packed"), (turned_out | F.col("head").rlike(TRANSPILED)).alias("turned_out"),
    )


def edited_copies(lines: DataFrame) -> DataFrame:
    """id, copied_from, shared: files with a large share of their lines in a file of another repository.

    lines: id, repo, lines (array). Of several sources the one with most shared lines is named.
    A file without a repository is no evidence. No pair is left out: of n lines of which t must be
    shared, any n - t + 1 hold a shared one, so a file need only look for its rarest n - t + 1 lines.
    """
    bag = F.array_sort(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))))
    files = lines.filter("repo is not null").select("id", "repo", bag.alias("bag")).withColumn("cls", F.xxhash64("bag"))
    files = materialize(files, "bags")
    # files of equal lines are one class; its least and greatest (repo, id) have a file of another repository than any given one
    at = F.struct("repo", "id")
    bags = materialize(files.groupBy("cls").agg(F.first("bag").alias("bag"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n_refs")), "classes")
    need = F.greatest(F.lit(SHARED_LINES), F.ceil(F.size("bag") * F.lit(SHARED_PART))).cast("int")
    hashed = bags.select("cls", F.explode("bag").alias("line"), "lo", "hi", F.size("bag").alias("n"), need.alias("need"))
    index = hashed.groupBy("line").agg((F.min("lo.repo") < F.max("hi.repo")).alias("two"), F.count(F.lit(1)).alias("n_refs")).withColumn("held", F.col("n_refs"))
    met = salted_join(hashed.drop("lo", "hi"), index, ["line"], "cls")
    met = materialize(met, "met")
    asks = met.filter("n >= need").groupBy("cls", "n", "need").agg(F.collect_list(F.struct("held", "line", "two")).alias("all"))
    asks = asks.select("cls", "need", F.explode(F.expr("slice(array_sort(all), 1, n - need + 1)")).alias("l")).filter("l.two").select("cls", "need", "l.line", "l.held")
    # the pairs of a line are worked on in blocks of at most HOLDERS x HOLDERS
    blocks = F.ceil(F.col("held") / F.lit(float(HOLDERS))).cast("int")
    own, every = F.pmod(F.xxhash64("cls", F.lit(3)), blocks), F.explode(F.sequence(F.lit(0), blocks - 1))
    asks = asks.withColumn("a", own.cast("int")).withColumn("b", every).drop("held")
    holders = met.filter("two").withColumn("b", own.cast("int")).withColumn("a", every).select("line", "a", "b", F.col("cls").alias("other"), F.col("n").alias("size"))
    proposed = asks.join(holders, ["line", "a", "b"]).filter("size >= need").select("cls", "other").distinct()
    proposed = materialize(proposed, "proposed")
    # classes are proposed to many others: their lines are joined once for each proposed class, then dealt out
    goals = proposed.groupBy("other").agg(F.count(F.lit(1)).alias("n_refs")).join(bags.select(F.col("cls").alias("other"), F.col("bag").alias("bag2"), "lo", "hi"), "other")
    both = salted_join(proposed, goals, ["other"], "cls").join(bags.select("cls", "bag"), "cls")
    shared = F.size(F.array_intersect("bag", "bag2"))
    close = both.withColumn("shared", shared).filter((F.col("shared") >= SHARED_LINES) & (F.col("shared") >= F.size("bag") * SHARED_PART))
    found = close.select("cls", "shared", F.explode(F.array("lo", "hi")).alias("o")).select("cls", F.struct("shared", "o.id", "o.repo").alias("o"))
    found = materialize(found, "sources")
    # the best source of a class, and the best of another repository than that one's
    best = found.groupBy("cls").agg(F.max("o").alias("best"))
    next_best = found.join(best, "cls").filter("o.repo <> best.repo").groupBy("cls").agg(F.max("o").alias("next"))
    best = best.join(next_best, "cls", "left").join(bags.select("cls", "n_refs"), "cls")
    named = salted_join(files.select("id", "repo", "cls"), best, ["cls"], "id")
    source = F.when(F.col("best.repo") != F.col("repo"), F.col("best")).otherwise(F.col("next"))
    return named.select("id", source.alias("s")).filter("s is not null").select("id", F.col("s.id").alias("copied_from"), "s.shared")


def noted_copies(notes: DataFrame, published: DataFrame) -> DataFrame:
    """id, shared, n_notes: files at least half of whose rare notes are those of one published file, known in another repository.

    notes: id (once each), repo, notes (array without repetition) of all files. published: id, hash of known copies. A note is
    rare if at most one in RARE of all files, or FEW files, hold it. ``shared`` is the most notes that one published file
    shares with the file. A file without a repository is no evidence and is not judged.
    """
    each = materialize(notes.filter("repo is not null").select("id", "repo", F.explode("notes").alias("note")), "notes")
    # a published file is met in many repositories: two of them are enough to tell that one is another
    known = each.join(published.select("id", "hash"), "id").groupBy("note", "hash").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    known = materialize(known, "known")
    # only files with such a note can come out, and only their notes need be counted
    some = each.join(each.join(known.select("note").distinct(), "note", "left_semi").select("id").distinct(), "id", "left_semi")
    some = materialize(some, "some")
    most = max(FEW, notes.count() // RARE)
    counts = each.join(some.select("note").distinct(), "note", "left_semi").groupBy("note").agg(F.count(F.lit(1)).alias("n_refs"))
    rare = materialize(counts.filter(F.col("n_refs") <= most), "rare")
    held = materialize(salted_join(some, rare, ["note"], "id"), "held")
    totals = held.groupBy("id").agg(F.count(F.lit(1)).alias("n_notes"))
    keys = known.join(rare, "note")
    met = salted_join(held, keys, ["note"], "id").filter("lo <> repo or hi <> repo")
    shared = met.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("shared")).groupBy("id").agg(F.max("shared").alias("shared"))
    return shared.join(totals, "id").filter(F.col("shared") >= F.col("n_notes") * SHARED_PART).select("id", "shared", "n_notes")


def citing(notes: DataFrame, third_party: DataFrame) -> DataFrame:
    """id: files with a note that has the name and the version of a published package. notes: id, notes (array). A version has a digit."""
    words = F.split("note", r"[^\w.@/-]+")
    numbered = F.filter("notes", lambda x: x.rlike("[0-9]"))
    spoken = notes.select("id", F.explode(numbered).alias("note")).select("id", words.alias("words"), F.explode(F.array_distinct(words)).alias("package"))
    listed = third_party.select(F.lower("package").alias("package"), F.lower("version").alias("version")).filter("package is not null and version rlike '[0-9]'").distinct()
    said = F.expr("exists(words, w -> ltrim('v', w) = version)")
    return spoken.join(listed, "package").filter(said).select("id").distinct()


def _folder(path: Column) -> Column:
    """The folder of a file, without a version at its end."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), r"-\d+(\.\d+)+[\w.-]*$", "")


def _stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[^./]*$", ""))


def classify_files(files: DataFrame, heads: DataFrame, third_party: DataFrame) -> DataFrame:
    """file_id, label, reason for each id of files.

    label: ``handwritten``, ``vendored``, ``minified``, ``data`` or ``generated``; the first
    reason in the order of the module decides. A file without a head is judged by path and
    hash alone; a null hash, path or size is no evidence; heads of unknown files are not read.
    Repeated rows of an id count once (they may differ in indexed_at). An empty table of heads
    or of third-party files is allowed. Extra columns are not read.
    """
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"/+", "/")
    one = files.filter("id is not null").groupBy("id").agg(F.min("path").alias("path"), F.min("hash").alias("hash"), F.min("repo").alias("repo"))
    one = one.withColumn("path", path).withColumn("folder", _folder(F.col("path"))).withColumn("stem", _stem(F.regexp_extract("path", r"([^/]+)$", 1)))
    facts = materialize(_composition(_head_facts(heads.select("file_id", "n_bytes", "n_lines", "head"))), "facts")

    known = third_party.select("hash").dropna().distinct().withColumn("known", F.lit(True))
    packages = third_party.select(F.col("package").alias("folder")).dropna().distinct().withColumn("package", F.lit(True))
    stems = third_party.select(_stem(F.col("file_name")).alias("stem")).dropna().distinct().withColumn("usual", F.lit(True))
    whole = one.join(known, "hash", "left").join(packages, "folder", "left").join(stems, "stem", "left")
    whole = whole.join(facts.drop("all_lines", "notes").withColumnRenamed("file_id", "id"), "id", "left")
    whole = materialize(whole.drop("hash"), "whole")
    texts = whole.select("id", "repo").join(facts.select(F.col("file_id").alias("id"), F.col("all_lines").alias("lines"), "notes"), "id")
    copies = edited_copies(texts.filter(F.size("lines") >= SHARED_LINES))
    noted = noted_copies(texts, one.join(known, "hash", "left_semi")).select("id", F.lit(True).alias("noted"))
    cited = citing(facts.select(F.col("file_id").alias("id"), "notes"), third_party).withColumn("cited", F.lit(True))
    whole = whole.join(copies, "id", "left").join(noted, "id", "left").join(cited, "id", "left")

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    headless = F.col("packed").isNull()
    own_name = F.col("stem") == F.lower(F.regexp_replace("folder", r"[^A-Za-z0-9]+", "_"))
    placed = F.coalesce(F.col("path").rlike(PACKAGE_PLACE), F.lit(False)) & (yes("package") | yes("usual") | F.coalesce(own_name, F.lit(False)))
    named = lambda p: F.coalesce(F.col("path").rlike(p), F.lit(False))
    rules = [
        (yes("known"), "vendored", "known hash"),
        (F.col("copied_from").isNotNull(), "vendored", "lines of another repository"),
        (yes("noted"), "vendored", "notes of a known copy"),
        (yes("cited"), "vendored", "note of a package and its version"),
        (yes("package_note"), "vendored", "package banner"),
        (placed | (yes("package") & yes("usual")), "vendored", "package folder"),
        (yes("made_note"), "generated", "generator's note"),
        (yes("is_data"), "data", "data tokens"),
        (yes("packed"), "minified", "packed lines"),
        (headless & named(SMALL_NAME), "minified", "name of a packed file"),
        (yes("turned_out"), "generated", "shape of lines"),
        (named(MADE_NAME), "generated", "name of a generated file"),
    ]
    verdict = F.lit(None).cast("struct<label:string,reason:string>")
    for fits, label, reason in reversed(rules):
        verdict = F.when(fits, F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))).otherwise(verdict)
    verdict = F.coalesce(verdict, F.struct(F.lit("handwritten").alias("label"), F.lit("").alias("reason")))
    return whole.select(F.col("id").alias("file_id"), verdict.alias("v")).select("file_id", "v.label", "v.reason")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(table(spark, sf_dir, "files", "id", "path", "hash", "repo"), table(spark, sf_dir, "file_heads"), table(spark, sf_dir, "third_party"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).filter("label <> 'handwritten'").select("file_id")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its label and the reason for it."""
    return _classified(spark, sf_dir)


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """id, repo, lines, notes of all files with a head; id, hash of known copies."""
    files = table(spark, sf_dir, "files", "id", "hash", "repo").filter("id is not null").groupBy("id").agg(F.min("hash").alias("hash"), F.min("repo").alias("repo"))
    heads = _head_facts(table(spark, sf_dir, "file_heads", "file_id", "n_bytes", "n_lines", "head")).select(F.col("file_id").alias("id"), F.col("all_lines").alias("lines"), "notes")
    known = files.join(table(spark, sf_dir, "third_party", "hash").dropna().distinct(), "hash", "left_semi")
    return files.join(heads, "id"), known


def p3_line_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share at least half of their lines with a file of another repository, and the most lines so shared."""
    texts, _ = _texts(spark, sf_dir)
    return edited_copies(texts).select(F.col("id").alias("file_id"), F.col("shared").cast("long").alias("shared"))


def p3_noted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose rare notes are those of a known copy in another repository."""
    return noted_copies(*_texts(spark, sf_dir)).select(F.col("id").alias("file_id"), "shared", "n_notes")


QUERIES = {"p3_found": p3_found, "p3_files": p3_files, "p3_line_copies": p3_line_copies, "p3_noted_copies": p3_noted_copies}
_MARKS = " || ".join(f"chr({ord(c)})" for c in MARKS)
_LINES = f"""
with f as (select id, min(hash) as hash, min(repo) as repo from files where id is not null group by id),
h as (select f.id, f.repo, f.hash, head from f join (select file_id, max(head) as head from file_heads where file_id is not null group by file_id) on file_id = f.id),
raw as materialized (select id, repo, hash, unnest(string_split(coalesce(head, ''), chr(10))) as l from h where repo is not null),
plain as materialized (
  select id, repo, hash, regexp_matches(l, '{NOTE}') as is_note, lower(trim(l, {_MARKS})) as line from raw
)
"""
SQL = {
    "p3_line_copies": _LINES
    + f""", w as materialized (select distinct id, repo, line from plain where length(line) >= {LINE_CHARS}),
n as (select id, count(*) as n from w group by id),
s as (select a.id, b.id as other, count(*) as shared from w a join w b on a.line = b.line and a.repo <> b.repo group by all)
select s.id as file_id, max(shared) as shared from s join n on n.id = s.id where shared >= {SHARED_LINES} and shared >= n * {SHARED_PART} group by s.id""",
    "p3_noted_copies": _LINES
    + f""", said as (select id, repo, hash, regexp_replace(line, '\\s+', ' ', 'g') as line from plain where is_note),
w as materialized (select distinct id, repo, hash, line from said where length(line) >= {NOTE_CHARS}),
rare as (select line from w group by line having count(*) <= {FEW} or count(*) * {RARE} <= (select count(*) from h)),
r as materialized (select * from w where line in (select line from rare)),
n as (select id, count(*) as n_notes from r group by id),
k as (select distinct line, hash, repo from r where hash in (select hash from third_party)),
s as (select r.id, k.hash, count(distinct r.line) as shared from r join k on k.line = r.line and k.repo <> r.repo group by all),
m as (select id, max(shared) as shared from s group by id)
select m.id as file_id, shared, n_notes from m join n using (id) where shared >= n_notes * {SHARED_PART}""",
}
