"""Tool governance over tables of tool calls: rule filter, permissions, parameter validation, call keys, log outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.guards import collect_bounded

LOG_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - (\w+) - (.*)$"


# P1
def rule_filter(df: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """Keep rows where every ``row[field] == value`` (null-safe, like Python ``==`` on None)."""
    cond = F.lit(True)
    for field, value in rules:
        cond = cond & F.col(field).eqNullSafe(F.lit(value))
    return df.where(cond)


# J4 / X3
def role_permissions(roles: DataFrame, max_roles: int = 100_000) -> Column:
    """Role -> permissions as a map literal built from a bounded dimension table."""
    pdf = collect_bounded(roles.select("role", "perms"), max_roles, "role map")
    if len(pdf) == 0:
        return F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[x for r in pdf.itertuples() for x in (F.lit(r.role), F.array(*[F.lit(p) for p in r.perms]).cast("array<string>"))])


# P3
def permission_audit(calls: DataFrame, roles: DataFrame, required: Column, user_roles: str = "roles") -> DataFrame:
    """``allowed`` iff the union of the caller's role permissions covers ``required`` or contains ``*``.

    Unknown roles add nothing; an empty requirement is always allowed.  No
    shuffle: the role map is a literal, the requirement a column.
    """
    rmap = role_permissions(roles)
    perms = F.array_distinct(F.flatten(F.transform(F.col(user_roles), lambda r: F.coalesce(F.element_at(rmap, r), F.array().cast("array<string>")))))
    x = calls.withColumn("perms", perms).withColumn("required", required)
    star = F.array_contains("perms", "*")
    missing = F.when(star, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(F.col("required"), F.col("perms"))))
    return x.withColumn("missing", missing).withColumn("allowed", F.size("missing") == 0)


# P4
def validate_params(df: DataFrame, spec: list[tuple], params: str = "params") -> DataFrame:
    """Validate a JSON parameter object against ``spec = [(name, type, required, default)]``.

    Adds one typed column per field, ``errors`` (array of messages) and ``is_valid``.
    Missing optional fields take the default; present values that do not cast are errors.
    """
    m = F.from_json(F.col(params), "map<string,string>")
    x = df.withColumn("_p", m)
    errs = []
    for name, typ, required, default in spec:
        raw = F.element_at(F.col("_p"), F.lit(name))
        val = raw.try_cast(typ)
        dflt = F.lit(default).cast(typ) if default is not None else F.lit(None).cast(typ)
        x = x.withColumn(name, F.when(raw.isNull(), dflt).otherwise(val))
        errs.append(F.when(F.col("_p").isNull(), F.lit("params: not a JSON object"))
                    .when(raw.isNull() & F.lit(bool(required)), F.lit(f"{name}: field required"))
                    .when(raw.isNotNull() & val.isNull(), F.lit(f"{name}: not a valid {typ}")))
    x = x.withColumn("errors", F.array_distinct(F.filter(F.array(*errs), lambda e: e.isNotNull())))
    return x.withColumn("is_valid", F.size("errors") == 0).drop("_p")


# F2
def with_call_key(df: DataFrame, name: str = "tool", params: str = "params") -> DataFrame:
    return df.withColumn("call_key", T.call_key(F.col(name), F.from_json(F.col(params), "map<string,string>")))


# S8
def format_tool_log(events: DataFrame, ts: str, tool: str, params: str, failed: Column, detail: Column) -> DataFrame:
    """The three line kinds of the tool logger, one invocation line plus one outcome line per call."""
    stamp = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format(ts, "SSS"))
    inv = F.concat(stamp, F.lit(" - AgentTools - INFO - Invoking "), F.col(tool), F.lit(" with params "), F.col(params))
    ok = F.concat(stamp, F.lit(" - AgentTools - INFO - Tool "), F.col(tool), F.lit(" executed successfully"))
    bad = F.concat(stamp, F.lit(" - AgentTools - ERROR - Tool "), F.col(tool), F.lit(" failed: "), detail)
    return events.select(F.explode(F.array(inv, F.when(failed, bad).otherwise(ok))).alias("value"))


def parse_tool_log(lines: DataFrame) -> DataFrame:
    """``ts, logger, level, tool, outcome, detail`` from raw lines (``value``), a row for each line.

    A line that misses the pattern, or a null one, has the outcome ``rejected``, the line as
    its detail and null in the other columns.
    """
    v = F.col("value")
    fits = F.coalesce(v.rlike(LOG_PATTERN), F.lit(False))
    given = lambda c: F.when(fits, c)
    msg = F.regexp_extract(v, LOG_PATTERN, 4)
    outcome = (F.when(msg.startswith("Invoking "), "invocation")
               .when(msg.rlike(r"^Tool \S+ executed successfully$"), "success")
               .when(msg.rlike(r"^Tool \S+ failed: "), "failure"))
    tool = F.coalesce(F.nullif(F.regexp_extract(msg, r"^Invoking (\S+) with params", 1), F.lit("")),
                      F.nullif(F.regexp_extract(msg, r"^Tool (\S+) ", 1), F.lit("")))
    return lines.select(
        given(F.to_timestamp(F.regexp_extract(v, LOG_PATTERN, 1), "yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        given(F.regexp_extract(v, LOG_PATTERN, 2)).alias("logger"),
        given(F.regexp_extract(v, LOG_PATTERN, 3)).alias("level"),
        given(tool).alias("tool"), F.when(fits, outcome).otherwise("rejected").alias("outcome"),
        F.when(fits, F.regexp_extract(msg, r"^(?:Invoking \S+ with params |Tool \S+ failed: )(.*)$", 1)).otherwise(v).alias("detail"),
    )


def read_tool_log(spark, path: str) -> DataFrame:
    return parse_tool_log(spark.read.text(path))


# G17
def tool_outcomes(log: DataFrame) -> DataFrame:
    return log.where("outcome is null or outcome <> 'rejected'").groupBy("tool").agg(
        F.count_if(F.col("outcome") == "invocation").alias("invocations"),
        F.count_if(F.col("outcome") == "success").alias("successes"),
        F.count_if(F.col("outcome") == "failure").alias("failures"),
    )
