"""Explain: the logical plan as a tree, a hash of it, literals masked on request, and Spark's own plan."""

from __future__ import annotations

import hashlib
import json

from graphloom.model import PropertyGraph
from graphloom.plans import predicates as pr
from graphloom.plans.compiler import Step, compile_query
from graphloom.plans.spec import Query


def shown(p: pr.Predicate, redact: bool) -> dict:
    if isinstance(p, pr.Group):
        return {"op": p.op, "args": [shown(x, redact) for x in p.parts]}
    out = {"op": p.op, "var": p.var, "prop": p.prop}
    if p.values:
        out["values"] = ["?"] * len(p.values) if redact else [v.hex() if isinstance(v, bytes) else v if v is None or isinstance(v, bool | int | float | str) else str(v) for v in p.values]
    if p.op == "between":
        out["inclusive"] = list(p.inclusive)
    return out


def tree(step: Step, redact: bool = False) -> dict:
    detail = {k: shown(v, redact) if isinstance(v, pr.Test | pr.Group) else v for k, v in step.detail.items()}
    return {"op": step.op, **detail, "inputs": [tree(s, redact) for s in step.inputs]}


def explain(graph: PropertyGraph, query: Query | dict | str, redact_literals: bool = False) -> dict:
    """{"plan", "plan_hash", "spark"}: the hash is that of the plan with its literals, whether or not they are masked;
    Spark's plan is left out when they are."""
    compiled = compile_query(graph, query)
    full = tree(compiled.plan)
    out = {"plan": tree(compiled.plan, redact_literals), "plan_hash": hashlib.sha256(json.dumps(full, sort_keys=True).encode()).hexdigest()[:16]}
    if not redact_literals:
        out["spark"] = compiled.df._jdf.queryExecution().toString()
    return out
