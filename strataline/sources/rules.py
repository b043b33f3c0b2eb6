"""Rule manifests: reading, checking and writing.

A rule is a dict: id, title, severity (error, warn, info), scope (globs), prose, enforcement,
source {file, line}, verification {kind, rule}. Kinds with a batch engine are deps and graph,
the kind with a check at action time is path.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from strataline.functions.paths import glob_error

SEVERITIES = ("error", "warn", "info")
BATCH_KINDS = ("deps", "graph")
ACTION_KINDS = ("path",)
_SCHEMA = (
    "id string, title string, severity string, scope array<string>, prose string, enforcement string, source struct<file:string,line:int>, "
    "verification struct<kind:string,rule:struct<from:string,to:string,toNot:string,type:string,edgeKinds:array<string>,circular:boolean,reachable:boolean>>"
)


class ManifestError(ValueError):
    """What is wrong with a manifest, naming the rule and the field."""


def pattern_error(pattern: str) -> str | None:
    """A pattern must be in the subset that Java, RE2 and Python share; $1, $2 .. stand for groups."""
    plain = re.sub(r"\$\d+", "x", pattern)
    if re.search(r"\(\?(<?[=!]|>)|\\[1-9]", plain):
        return "look-around and back-references are not supported"
    try:
        re.compile(plain)
    except re.error as e:
        return str(e)
    return None


def check_manifest(rules: list[dict]) -> list[dict]:
    """The rules as they are, or ManifestError."""
    seen = set()
    for r in rules:
        rid = r.get("id")
        if not rid or rid in seen:
            raise ManifestError(f"rule id missing or repeated: {rid!r}")
        seen.add(rid)
        if r.get("severity") not in SEVERITIES:
            raise ManifestError(f"{rid}: severity: {r.get('severity')!r}")
        for g in r.get("scope") or []:
            if wrong := glob_error(g):
                raise ManifestError(f"{rid}: scope: {wrong}")
        rule = (r.get("verification") or {}).get("rule") or {}
        for name in ("from", "to", "toNot"):
            if rule.get(name) and (wrong := pattern_error(rule[name])):
                raise ManifestError(f"{rid}: {name}: {wrong}")
    return rules


def read_manifest(path: str, fallback: list[dict] | None = None) -> list[dict]:
    """Rules of a JSON file {"rules": [...]}; where it is missing or wrong, ``fallback`` if there is one."""
    try:
        with open(path, encoding="utf-8") as f:
            return check_manifest(json.load(f)["rules"])
    except (OSError, ValueError, KeyError, TypeError):
        if fallback is None:
            raise
        return check_manifest(fallback)


def write_manifest(path: str, rules: list[dict]) -> None:
    check_manifest(rules)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"rules": rules}, f, indent=2, ensure_ascii=False)
        f.write("\n")


def merge_rules(own: list[dict], seed: list[dict]) -> list[dict]:
    """Own rules, and those of the seed whose id is not among them."""
    ids = {r["id"] for r in own}
    return [*own, *(r for r in seed if r["id"] not in ids)]


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a DataFrame; fields that a kind lacks are null."""
    names = ("from", "to", "toNot", "type", "edgeKinds", "circular", "reachable")
    rows = []
    for r in rules:
        v, src = r.get("verification") or {}, r.get("source") or {}
        rule = v.get("rule") or {}
        rows.append((r["id"], r.get("title"), r["severity"], r.get("scope") or [], r.get("prose"), r.get("enforcement"), (src.get("file"), src.get("line")), (v.get("kind"), tuple(rule.get(n) for n in names))))
    return spark.createDataFrame(rows, _SCHEMA)
