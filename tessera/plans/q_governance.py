"""Registered tool-governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import governance as G
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register

# Stand-in requirement per tool (tool = event type); 'error' requires nothing.
TOOL_REQUIREMENTS = {
    "view": ["basic:read"],
    "click": ["api:access"],
    "signup": ["data:process"],
    "purchase": ["api:access", "data:process"],
    "error": [],
}
PARAM_SPEC = [("k", "int", True, None), ("limit", "int", False, 10)]


def _tool_calls(spark, sf_dir):
    """Tool calls from events: tool = event type, params = props, roles from ``user_id % 4``."""
    e = fx.table(spark, sf_dir, "events")
    role = F.element_at(F.array(F.lit("admin"), F.lit("developer"), F.lit("guest"), F.lit("unknown")), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("tool"), F.col("props").alias("params"),
                    F.array(role).alias("roles"), "value")


def _required():
    m = F.create_map(*[x for t, p in TOOL_REQUIREMENTS.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in p]).cast("array<string>"))])
    return F.coalesce(F.element_at(m, F.col("tool")), F.array().cast("array<string>"))


@register("rule_filter")
def rule_filter(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    out = G.rule_filter(li, [("l_returnflag", "R"), ("l_linestatus", "F")])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


@register("permission_audit")
def permission_audit(spark, sf_dir):
    a = G.permission_audit(_tool_calls(spark, sf_dir), fx.roles(spark), _required())
    return a.select("event_id", "tool", F.col("roles")[0].alias("role"), "allowed", F.array_join("missing", ",").alias("missing"))


@register("validate_params")
def validate_params(spark, sf_dir):
    v = G.validate_params(_tool_calls(spark, sf_dir), PARAM_SPEC)
    return v.select("event_id", "k", "limit", "is_valid", F.array_join("errors", ";").alias("errors"))


@register("call_keys")
def call_keys(spark, sf_dir):
    c = G.with_call_key(_tool_calls(spark, sf_dir))
    return c.groupBy("call_key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@register("tool_outcomes")
def tool_outcomes(spark, sf_dir):
    """Log lines written from the calls (failure when value >= 100), parsed back and counted per tool."""
    calls = _tool_calls(spark, sf_dir)
    lines = G.format_tool_log(calls, "ts", "tool", "params", F.col("value") >= 100, F.concat(F.lit("latency "), F.col("value").cast("string")))
    return G.tool_outcomes(G.parse_tool_log(lines))
