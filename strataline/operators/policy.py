"""Path policy: which rules an action on a file meets, and whether it is allowed."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.paths import in_scope, target_path
from strataline.sources.rules import ACTION_KINDS

BLOCKING = "block"
EVENT = "PreToolUse"


def cite(rule: dict) -> str:
    src = rule.get("source") or {}
    at = f"{src.get('file')}:{src['line']}" if src.get("line") else str(src.get("file"))
    return f"{rule['id']} ({at}): «{rule.get('prose')}»"


def _known(rules: list[dict]) -> list[dict]:
    return [r for r in rules if (r.get("verification") or {}).get("kind") in ACTION_KINDS]


def _ids(rules: list[dict], path: Column) -> Column:
    hits = [F.when(in_scope(path, r.get("scope") or []), F.lit(r["id"])) for r in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def check_actions(actions: DataFrame, rules: list[dict] | None, path: str = "path", event: str = "event") -> DataFrame:
    """The actions with matched (rule ids), blocked_by, verdict and diagnostic.

    Rules are few and compiled into one expression, so a table of actions is checked in one
    scan. Only a blocking rule on the event before the use denies. Without rules (None) or
    without a path everything is allowed, in the former case with a diagnostic.
    """
    if rules is None:
        none = F.array().cast("array<string>")
        return actions.withColumns({"matched": none, "blocked_by": none, "verdict": F.lit("allow"), "diagnostic": F.lit("no rules could be read")})
    known = _known(rules)
    at = F.col(path)
    there = at.isNotNull()
    none = F.array().cast("array<string>")
    matched = F.when(there, _ids(known, at)).otherwise(none)
    blocked = F.when(there & (F.col(event) == EVENT), _ids([r for r in known if r.get("enforcement") == BLOCKING], at)).otherwise(none)
    out = actions.withColumns({"matched": matched, "blocked_by": blocked})
    return out.withColumns({"verdict": F.when(F.size("blocked_by") > 0, "deny").otherwise("allow"), "diagnostic": F.lit(None).cast("string")})


def check_payloads(payloads: DataFrame, rules: list[dict] | None, payload: str = "payload", event: str = "event", root: str = "") -> DataFrame:
    """check_actions for JSON payloads, see target_path."""
    return check_actions(payloads.withColumn("path", target_path(F.col(payload), root)), rules, "path", event)


def rules_of_file(rules: list[dict], file: str | None) -> list[str]:
    """Rules that an instructions file declares; all of them if the file is not known."""
    return [r["id"] for r in rules if file is None or (r.get("source") or {}).get("file") == file]


def log_coverage(path: str, at: str, file: str | None, ids: list[str]) -> None:
    """Append one line to the context log."""
    if ids:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"at": at, "file": file, "ruleIds": ids}, ensure_ascii=False) + "\n")


def loaded_rules(log: DataFrame, column: str = "ruleIds") -> DataFrame:
    """Distinct rule ids of a context log that was read as JSON; malformed lines have nulls and count for nothing."""
    return log.select(F.explode(column).alias("rule_id")).distinct()


def coverage(rules: DataFrame, loaded: DataFrame) -> DataFrame:
    """total, seen: how many rules were ever loaded."""
    seen = rules.select("id").join(loaded.select(F.col("rule_id").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("seen"))
    return rules.agg(F.count(F.lit(1)).alias("total")).crossJoin(seen)  # one row each


def hook_events(rules: list[dict]) -> dict[str, bool]:
    """Events that are needed for the rules' ways of enforcement."""
    kinds = {r.get("enforcement") for r in _known(rules)}
    return {"PreToolUse": bool(kinds & {BLOCKING}), "PostToolUse": bool(kinds - {BLOCKING, None}), "InstructionsLoaded": bool(rules)}


def scope_counts(paths: DataFrame, rules: list[dict], path: str = "path") -> DataFrame:
    """rule_id, n: paths in the scope of each rule, of any kind; one scan."""
    hits = [F.when(in_scope(F.col(path), r.get("scope") or []), F.lit(r["id"])) for r in rules]
    return paths.filter(F.col(path).isNotNull()).select(F.explode(F.array_compact(F.array(*hits))).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)
