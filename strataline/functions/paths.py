"""Path functions: globs, scopes, prefixes, URIs, payload targets."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys under which a payload may name its file, first one first.
TARGET_KEYS = ("file_path", "filePath", "path", "notebook_path", "notebookPath")


class GlobError(ValueError):
    """A glob whose brackets or braces do not pair up, or whose class is empty."""


# A glob is a run of these; what is none of them is a lone bracket.
_PART = re.compile(r"(?P<span>\*\*/?)|(?P<one>[*?])|(?P<brace>[{},])|\[(?P<unlike>!?)(?P<chars>[^\]]+)\]|(?P<plain>[^*?{},\[]+)")
_NAME, _SPAN = "[^/]*", "(?:[^/]*/)*"
_BRACES = {"{": "(?:", ",": "|", "}": ")"}


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob, in the subset that Java and RE2 share.

    ``*`` and ``?`` stay inside a segment, ``**`` (with a slash after it or at the end) spans
    segments, ``{a,b}`` are alternatives, ``[..]`` and ``[!..]`` classes.
    """
    found = list(_PART.finditer(pattern))
    if sum(len(m[0]) for m in found) != len(pattern):
        raise GlobError(f"{pattern}: a class is empty or does not end")
    opened = list(accumulate(({"{": 1, "}": -1}.get(m["brace"], 0) for m in found), initial=0))
    if min(opened) < 0 or opened[-1]:
        raise GlobError(f"{pattern}: braces do not pair up")

    def translated(m: re.Match, level: int) -> str:
        if m["span"]:
            return _SPAN + (_NAME if m.end() == len(pattern) else "")
        if m["one"]:
            return _NAME if m["one"] == "*" else "[^/]"
        if m["brace"]:
            return _BRACES[m["brace"]] if level or m["brace"] == "{" else m["brace"]
        if m["chars"]:
            return f"[{'^' if m['unlike'] else ''}{m['chars']}]"
        return re.sub(r"[][.+^$()|\\]", r"\\\g<0>", m["plain"])

    return "^(?:" + "".join(map(translated, found, opened)) + r")\z"


def glob_error(pattern: str) -> str | None:
    try:
        glob_regex(pattern.removeprefix("!"))
    except GlobError as e:
        return str(e)
    return None


def scope_patterns(scope: list[str]) -> tuple[list[str], list[str]]:
    """Patterns to match and not to match; malformed globs are dropped."""
    good = [g for g in scope if glob_error(g) is None]
    return [glob_regex(g) for g in good if not g.startswith("!")], [glob_regex(g[1:]) for g in good if g.startswith("!")]


def in_scope(path: Column, scope: list[str]) -> Column:
    """(no positive glob or any matches) and no negative one does; an empty scope holds everything."""
    yes, no = scope_patterns(scope)
    hit = reduce(lambda a, b: a | b, (path.rlike(p) for p in yes)) if yes else F.lit(True)
    return reduce(lambda a, b: a & ~b, (path.rlike(p) for p in no), hit)


def under(path: Column, roots: list[str] | None) -> Column:
    """The path is one of the roots or lies below it; no roots means every path."""
    if not roots:
        return F.lit(True)
    return reduce(lambda a, b: a | b, ((path == r) | path.startswith(r + "/") for r in (x.rstrip("/") for x in roots)))


def relative_uri(path: Column) -> Column:
    """Forward slashes, without a drive and leading slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[A-Za-z]:", ""), "^/+", "")


def relative_path(path: Column, root: str) -> Column:
    """Below ``root`` if it is absolute and lies there, without ./ at the front."""
    base = root.rstrip("/") + "/"
    inside = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(path)
    return F.regexp_replace(inside, r"^\./", "")


def target_path(payload: Column, root: str = "") -> Column:
    """The file that an action's JSON payload names, under tool_input, toolInput or at the top; null if none does."""
    inputs = ("$.tool_input.", "$.toolInput.", "$.")
    found = F.coalesce(*(F.get_json_object(payload, i + k) for i in inputs for k in TARGET_KEYS))
    return relative_path(found, root) if root else F.regexp_replace(found, r"^\./", "")


def is_newer(a: Column, b: Column) -> Column:
    """Dotted version a is greater than b, part by part as numbers; what follows a dash or plus is ignored."""

    def parts(v: Column) -> Column:
        nums = F.transform(F.split(F.regexp_replace(F.regexp_replace(v, "^v", ""), "[-+].*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
        return F.slice(F.concat(nums, F.array_repeat(F.lit(0), 3)), 1, 3)

    return parts(a) > parts(b)
