"""References `$(settings.K)` and `$(artifacts.K)`, placeholders `{C}` and templates of plans."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = re.compile(r"\$\(([^)]+)\)")
EXPANDED = ("artifacts.", "settings.")


def expand(value: Any, scope: str, known: dict) -> Any:
    """A value that is one reference becomes what it refers to, with its type; references inside a text
    become text; unknown ones stay as they are. Lists and dicts are gone through."""
    if isinstance(value, dict):
        return {k: expand(v, scope, known) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, scope, known) for v in value]
    if not isinstance(value, str):
        return value
    one = rf"\$\({scope}\.([^)]+)\)"
    if whole := re.fullmatch(one, value):
        return known.get(whole[1], value)
    return re.sub(one, lambda m: str(known.get(m[1], m[0])), value)


def expand_column(text: Column, scope: str, known: dict[str, str]) -> Column:
    """The same for a text column and a table of few names."""
    for k, v in known.items():
        text = F.replace(text, F.lit(f"$({scope}.{k})"), F.lit(str(v)))
    return text


def unknown_references(text: Column) -> Column:
    """References that nothing expands, by their prefix."""
    found = F.regexp_extract_all(text, F.lit(r"\$\(([^)]+)\)"), F.lit(1))
    return F.filter(found, lambda r: ~(F.startswith(r, F.lit("artifacts.")) | F.startswith(r, F.lit("settings."))))


def substitute(value: Any, compound: dict) -> Any:
    """{C} is the compound's id (or name), {C.field} one of its fields; gone through recursively."""
    if isinstance(value, dict):
        return {k: substitute(v, compound) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, compound) for v in value]
    if not isinstance(value, str):
        return value
    fields = {**compound, "": compound.get("id", compound.get("name"))}
    return re.sub(r"\{C(?:\.(\w+))?\}", lambda m: str(fields[m[1] or ""]) if (m[1] or "") in fields else m[0], value)


def expand_template(plan: dict) -> dict:
    """Nodes of a template for each compound, those without a placeholder once at the end, then the
    nodes after it for the compounds they apply to. Raises for leftovers and repeated ids."""
    template = plan.get("template")
    if not isinstance(template, dict) or not template:
        return plan
    compounds = plan.get("compounds")
    if not isinstance(compounds, list) or not compounds:
        raise ValueError("a template needs compounds")
    kinds = {"targets_only": lambda c: c.get("role", "target") != "reference", "references_only": lambda c: c.get("role", "target") == "reference"}
    each = template.get("per_compound") or []
    nodes = [substitute(n, c) for c in compounds for n in each if "{C" in (n.get("id") or "")]
    once = {n["id"]: substitute(n, compounds[0]) for n in reversed(each) if n.get("id") and "{C" not in n["id"]}
    nodes += [once[i] for i in dict.fromkeys(n["id"] for n in each if n.get("id") in once)]
    for n in template.get("post_template") or []:
        to = n.get("applies_to", "all")
        body = {k: v for k, v in n.items() if k != "applies_to"}
        nodes += [body] if to == "once" else [substitute(body, c) for c in compounds if kinds.get(to, lambda c: True)(c)]
    flat = lambda patterns: list(dict.fromkeys(v for p in patterns or [] for v in ([substitute(p, c) for c in compounds] if "{C" in str(p) else [p])))
    left = sorted(set(re.findall(r"\{C[^}]*\}", str(nodes))))
    if left:
        raise ValueError(f"unresolved: {left}")
    ids = [n["id"] for n in nodes if "id" in n]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated ids: {repeated}")
    return {**plan, "nodes": nodes, "geom_ids": flat(plan.get("geom_ids")), "artifacts_to_save": flat(plan.get("artifacts_to_save"))}


def expand_nodes(template: DataFrame, compounds: DataFrame) -> DataFrame:
    """The same as tables: template (pos, id, tool, input_id, output_id, applies_to) against compounds
    (name, role). A node without a placeholder comes once. Templates are a plan's few rows."""
    columns = ["id", "tool", "input_id", "output_id"]
    fits = F.when(F.col("applies_to") == "targets_only", F.col("role") != "reference").when(F.col("applies_to") == "references_only", F.col("role") == "reference").otherwise(F.lit(True))
    each = compounds.crossJoin(F.broadcast(template.where(F.contains("id", F.lit("{C}"))))).where(fits)
    put = lambda c: F.replace(c, F.lit("{C}"), F.col("name"))
    return each.select(*(put(F.col(c)).alias(c) for c in columns)).unionByName(template.where(~F.contains("id", F.lit("{C}"))).select(*columns))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def rule(text: Column) -> Column:
    """(code, max_attempts) of a retry rule in JSON, in any of its three spellings; "any" and 2 by default."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(text, p) for p in paths))
    code = F.coalesce(get("$.code", "$.match.error_code", "$.when.code_in[0]"), F.lit("any"))
    return F.struct(code.alias("code"), F.coalesce(get("$.max_attempts", "$.retries").try_cast("int"), F.lit(2)).alias("max_attempts"))


def with_value(nested: Column, path: str, value: Column) -> Column:
    """A struct with the field at a dotted path replaced or added; all others stay."""
    return nested.withField(path, value)


def json_value(text: Column, path: str) -> Column:
    """The value at a dotted path of JSON text; numbers are places in lists. Null if there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(text, f"${steps}")
