"""Source trees as DataFrames: listing, reading, language by extension, extraction of definitions and references.

Python is parsed with the standard library's ast. JavaScript and TypeScript have no parser
here: definitions, calls and imports are found by a tokenizer that knows strings, comments,
templates and braces, so it is an approximation (see the README).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are not read.
MAX_BYTES = 1_500_000
# Folders that are not entered, and extensions of each language.
SKIPPED = (".git", "node_modules", "dist", "build", ".next", "out", "coverage", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", "vendor", "target", ".turbo", ".cache")
EXTENSIONS = {"python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx", "mts", "cts")}

SYMBOLS = "array<struct<name:string,kind:string,start_line:int,end_line:int,start_byte:int,end_byte:int,parent:int,signature:string>>"
REFS = "array<struct<name:string,kind:string,line:int,owner:int>>"


def lang_for_path(column: str) -> Column:
    """The language of an extension (case ignored); null for others."""
    ext = F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, known in EXTENSIONS.items():
        out = F.when(ext.isin(*known), F.lit(lang)).otherwise(out)
    return out


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), lang, hash, text of the source files of a tree.

    Skipped folders, unknown extensions and files above the size limit are left out, by
    filters on path and length before any content is decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^file:/*", "/")
    rel = F.substring(base, len(root.rstrip("/")) + 2, 1_000_000)
    known = raw.withColumn("path", rel).withColumn("lang", lang_for_path("path"))
    skipped = F.col("path").rlike("(^|/)(" + "|".join(re.escape(s) for s in SKIPPED) + ")/")
    known = known.filter(F.col("lang").isNotNull() & ~skipped & (F.col("length") <= MAX_BYTES))
    return known.select("path", "lang", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def _signature(text: str) -> str:
    return text.split("\n")[0].strip()[:200]


def _extract_python(text: str) -> tuple[list, list]:
    symbols: list[tuple] = []
    refs: list[tuple] = []
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)
    chars = [0]
    for line in lines:
        chars.append(chars[-1] + len(line) + 1)

    def offset(row: int, byte_col: int) -> int:
        return chars[row - 1] + len(lines[row - 1].encode()[:byte_col].decode("utf-8", "ignore"))

    work: list[tuple] = [(ast.parse(text), None)]
    while work:
        node, owner = work.pop()
        inside = owner
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            start, end = offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset)
            inside = len(symbols)
            symbols.append((node.name, kind, node.lineno, node.end_lineno, start, end, owner, _signature(text[start:end])))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                refs.append((name, "call", node.lineno, owner))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            whole = text[offset(node.lineno, node.col_offset) : offset(node.end_lineno, node.end_col_offset)]
            refs.append((_signature(whole), "import", node.lineno, owner))
        work += [(c, inside) for c in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, refs


_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_PARTS = re.compile(
    r"(?P<imp>(?m:^[ \t]*)(?:import\b[^;\n(]*(?:\{[^}]*\}[^;\n]*)?|export\b[^;\n]*\bfrom\b[^;\n]*))"
    r"|\b(?P<def>function\*?|class|interface|enum)\s+(?P<dname>[A-Za-z_$][\w$]*)"
    r"|\btype\s+(?P<tname>[A-Za-z_$][\w$]*)\s*(?:<[^=;{]*>)?\s*="
    r"|(?P<new>\bnew\s+[A-Za-z_$][\w$.]*)"
    r"|(?P<word>[A-Za-z_$][\w$]*)\s*(?:<[\w$,\s.\[\]]*>)?\((?P<open>)"
    r"|(?P<brace>[{}])"
)
_WORDS = frozenset("if for while switch catch return function typeof await super with do else throw new delete void in of yield case import constructor".split())


def _close(text: str, at: int) -> int:
    """Place after the brace that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def _closing_paren(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                return i
    return -1


def _extract_script(text: str, typed: bool) -> tuple[list, list]:
    """Definitions, calls and imports of JavaScript or TypeScript, approximately."""
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    symbols: list[tuple] = []
    refs: list[tuple] = []
    open_: list[tuple[int, int, str]] = []  # end, symbol, kind

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    def add(name: str, kind: str, start: int, end: int) -> None:
        owner = open_[-1][1] if open_ else None
        open_.append((end, len(symbols), kind))
        symbols.append((name, kind, line(start), line(max(start, end - 1)), start, end, owner, _signature(text[start:end])))

    for m in _PARTS.finditer(quiet):
        while open_ and open_[-1][0] <= m.start():
            open_.pop()
        owner = open_[-1][1] if open_ else None
        if m.group("imp"):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            refs.append((_signature(text[at : m.end()]), "import", line(at), owner))
        elif m.group("dname"):
            kind = {"interface": "interface", "enum": "enum", "class": "class"}.get(m.group("def"), "function")
            if kind in ("interface", "enum") and not typed:
                continue
            brace = quiet.find("{", m.end())
            add(m.group("dname"), kind, m.start(), _close(quiet, brace) if brace >= 0 else m.end())
        elif m.group("tname"):
            if typed:
                end = quiet.find(";", m.end())
                add(m.group("tname"), "type", m.start(), end + 1 if end >= 0 else m.end())
        elif m.group("word") and m.group("word") not in _WORDS:
            close = _closing_paren(quiet, m.end() - 1)
            after = quiet[close + 1 : close + 200].lstrip() if close >= 0 else ""
            body = re.match(r"(?::[^{;=]*)?\{", after)
            in_class = bool(open_) and open_[-1][2] == "class"
            if in_class and body:
                add(m.group("word"), "method", m.start(), _close(quiet, quiet.find("{", close)))
            elif not (open_ and open_[-1][2] == "interface") and not (symbols and symbols[-1][0] == m.group("word") and symbols[-1][4] <= m.start() <= symbols[-1][4] + len(symbols[-1][0]) + 12):
                refs.append((m.group("word"), "call", line(m.start()), owner))
    return symbols, refs


Extractor = Callable[[str], tuple[list, list]]
#: How each language is read; more are added by register_language.
EXTRACTORS: dict[str, Extractor] = {
    "python": _extract_python, "javascript": lambda text: _extract_script(text, False), "typescript": lambda text: _extract_script(text, True),
}


def register_language(lang: str, extensions: tuple[str, ...], extractor: Extractor) -> None:
    """Read files of some extensions as ``lang``. The extractor gives symbols (name, kind, lines and bytes from and to, parent, signature) and references (name, kind, line, owner) of a text."""
    EXTENSIONS[lang], EXTRACTORS[lang] = extensions, extractor


def extract(text: str | None, lang: str | None, extractors: dict[str, Extractor] | None = None) -> tuple[list, list]:
    """Symbols and references of one source; none if it cannot be parsed or the language is unknown."""
    how = (EXTRACTORS if extractors is None else extractors).get(lang)
    if not text or how is None:
        return [], []
    try:
        return how(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []


def extract_files(files: DataFrame) -> DataFrame:
    """path, lang, hash, symbols, refs: both arrays, joined by positions, as in one walk over the source.

    Parsing is outside of what SQL can express: sources go through Python in Arrow batches.
    """

    known = dict(EXTRACTORS)  # goes to the workers with the job

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("name", "kind", "start_line", "end_line", "start_byte", "end_byte", "parent", "signature")
        for pdf in pdfs:
            both = [extract(t, lang, known) for t, lang in zip(pdf["text"], pdf["lang"])]
            yield pd.DataFrame(
                {
                    "path": pdf["path"], "lang": pdf["lang"], "hash": pdf["hash"],
                    "symbols": [[dict(zip(names, s)) for s in a] for a, _ in both],
                    "refs": [[dict(zip(("name", "kind", "line", "owner"), r)) for r in b] for _, b in both],
                }
            )

    return files.select("path", "lang", "hash", "text").mapInPandas(work, f"path string, lang string, hash string, symbols {SYMBOLS}, refs {REFS}")
