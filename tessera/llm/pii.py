"""Personal data by bootstrapped contextual extraction (operator 5): DataFrame functions only.

``base_spans`` finds the four seed kinds by their fixed formats.  ``candidates`` are the
other tokens with a digit or an at sign, and the longest runs of digit tokens with one
space between that have the look of a kind as a whole.  Seeds and candidates are
instances; the word before an instance, and that word together with the one after it,
are lexical patterns.  ``discover`` scores the graph of patterns and instances in rounds:
a pattern is worth the mean confidence of its distinct instances (less when it has few),
where candidates of the look that no round has scored yet don't count, and those of
another look or kind count as 0; an instance is worth what its patterns say together,
seeds always 1.  Candidates of a kind's general look whose patterns are confident, and
which enough seeds or confident instances induced, are added to its spans.

Defined results: a null or empty text has no spans; repeated rows (same id and text)
get equal results; ties in position are ordered by kind; of added spans one within another the longer stays; a null id is kept as null;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Kinds in output order.  A match starts where the last one ended or where no character
#: of its first run stands before, which is where the leftmost match starts anyway, and
#: never gives back what it took, so the time is linear in the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = [*KINDS]
#: What a text must have for a kind to be looked for.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Tokens with a digit or an at sign, from their first character on.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Runs of two or more digit tokens; each token ends where white space or closing punctuation stands.
RUN_PART = r"""[0-9][0-9().-]*+(?![^\x20\x09-\x0D)\]}>"'`,;:!?])"""
RUN = rf"""(?<![^\x20\x09-\x0D])[(\[{{<"'`]*+(?:[A-Za-z_]++[=:]["']?)?[+(]?{RUN_PART}(?:\x20[(]?{RUN_PART})++"""
#: What may stand around the identifier in a token: brackets, quotes and a name with = or :.
LEAD, TRAIL = r"""^[(\[{<"'`]*(?:[A-Za-z_]+[=:]["']?)?""", r"""[)\]}>"'`.,;:!?]*$"""
#: The look of a kind, wider than its seeds' format.
LOOKS = {
    "email": r"^[^@]+(?:@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}$",
    "card": r"^(?:[0-9][ .-]?){12,19}$",
    "phone": r"^[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}$",
}
#: Characters of context kept on each side; rounds; what a pattern's mean is thinned by.
CONTEXT, ROUNDS, THINNED = 64, 3, 1.0
#: Least confidence of a pattern and of an added instance, and fewest distinct seeds or confident instances of a pattern.
PATTERN_LEAST, INSTANCE_LEAST, SEEDS_LEAST = 0.8, 0.9, 5
KEY = ["id", "text_key"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``id`` and ``text_key`` name a row; rows that agree in both have the same spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(whole).alias("text_key"), "doc_id", whole.alias("text"))


def occurrences(rows: DataFrame, kind: str, pattern: str, needs: str) -> DataFrame:
    """id, text_key, kind, i, gap, value, left, right of all matches in each text, with the text around."""
    parts = F.split("text", pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("value"), parts.alias("before"), F.slice(parts, F.lit(2), F.lit(1 << 30)).alias("after"))
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            i.alias("i"), x["value"].alias("value"), F.length(x["before"]).alias("gap"), F.substring(x["before"], -CONTEXT, CONTEXT).alias("left"), F.substring(x["after"], 1, CONTEXT).alias("right")
        ),
    )
    found = rows.where(F.col("text").rlike(needs)).select(*KEY, F.explode_outer(each).alias("m")).where("m.value is not null")
    return found.select(*KEY, F.lit(kind).alias("kind"), "m.*")


def placed(found: DataFrame) -> DataFrame:
    """With ``start`` and ``end`` in code points."""
    once = found.dropDuplicates([*KEY, "kind", "i"])
    passed = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*KEY, "kind").orderBy("i"))
    return once.withColumn("end", passed).withColumn("start", F.col("end") - F.length("value")).drop("gap", "i")


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a seed kind's format is one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    card = (n >= 13) & (n <= 19) & F.call_function("luhn_check", digits)
    ip = value.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    phone = (n >= 9) & (n <= 15)
    return F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).otherwise(F.lit(True))


def all_occurrences(rows: DataFrame) -> DataFrame:
    """Seeds (kind by name), tokens (kind "token") and runs (kind "run") of all texts, placed; failing matches are dropped."""
    kinds = [occurrences(rows, kind, pattern, NEEDS[kind]) for kind, pattern in KINDS.items()]
    found = reduce(DataFrame.unionByName, [*kinds, occurrences(rows, "token", TOKEN, "[0-9@]"), occurrences(rows, "run", RUN, r"[0-9][0-9().-]*+\x20[(]?[0-9]")])
    return placed(found).where(valid(F.col("kind"), F.col("value")))


def candidates(found: DataFrame) -> DataFrame:
    """Tokens and runs without what surrounds the identifier, as far as no seed overlaps them; ``name`` is a name stuck to them.

    Runs need the look of a kind; tokens within such a run need one of their own.
    """
    lead = F.regexp_extract("value", LEAD, 0)
    core = F.regexp_replace(F.expr("substring(value, length(lead) + 1)"), TRAIL, "")
    tokens = found.where("kind in ('token', 'run')").withColumn("lead", lead).withColumn("value", core).where(F.length("value") > 0)
    tokens = tokens.withColumn("start", F.col("start") + F.length("lead")).withColumn("end", F.col("start") + F.length("value"))
    seeds = found.where("kind not in ('token', 'run')").select(*KEY, F.col("start").alias("from"), F.col("end").alias("to"))
    free = tokens.join(seeds, [tokens[k] == seeds[k] for k in KEY] + [F.col("start") < F.col("to"), F.col("from") < F.col("end")], "left_anti")
    free = free.withColumn("looked", F.size(F.array_compact(looks())) > 0).where("kind = 'token' or looked")
    # ends at or beyond that of a run which starts before the token or with it
    until = F.max(F.when(F.col("kind") == "run", F.col("end"))).over(Window.partitionBy(*KEY).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    free = free.withColumn("until", until).where(F.expr("kind = 'run' or looked or until is null or until < end"))
    return free.withColumn("name", F.regexp_extract("lead", "[A-Za-z_]+[=:]", 0)).drop("lead", "looked", "until")


def looks() -> Column:
    """The kinds whose look ``value`` has; null in place of the others."""
    return F.array(*[F.when(F.col("value").rlike(look), F.lit(kind)) for kind, look in LOOKS.items()])


def edges(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """kind, pattern, instance, seed: each distinct instance under each of its patterns, for every kind whose look it has."""
    before = F.lower(F.regexp_extract("left", r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1))
    after = F.lower(F.regexp_extract("right", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1))
    word = lambda c: F.regexp_replace(c, "[0-9]", "0")
    known = seeds.select("kind", "value", "left", "right", F.lit("").alias("name"), F.lit(True).alias("seed"))
    # a candidate is an instance of the kinds it looks like; for the others it counts against their patterns
    rivals = others.select(F.explode(F.array(*map(F.lit, ORDER))).alias("kind"), "value", "left", "right", "name", F.lit(False).alias("seed"), looks().alias("looks"))
    rivals = rivals.withColumn("fits", F.array_contains(F.array_compact("looks"), F.col("kind"))).drop("looks")
    foreign = known.withColumn("own", F.col("kind")).withColumn("kind", F.explode(F.array(*map(F.lit, ORDER)))).where("kind <> own").drop("own").withColumn("seed", F.lit(False)).withColumn("fits", F.lit(False))
    rows = known.withColumn("fits", F.lit(True)).unionByName(rivals).unionByName(foreign)
    left = F.when(F.col("name") != "", F.lower("name")).otherwise(word(before))
    patterns = F.array(F.concat(F.lit("L "), left), F.concat(F.lit("B "), left, F.lit(" "), word(after)))
    spread = rows.select("kind", "value", "seed", "fits", F.explode(patterns).alias("pattern")).where("pattern not in ('L ', 'B  ')")
    return spread.groupBy("kind", "pattern", F.col("value").alias("instance")).agg(F.max("seed").alias("seed"), F.max("fits").alias("fits"))


def discover(graph: DataFrame) -> DataFrame:
    """kind, instance, confidence of the candidates to add."""
    graph = materialize(graph, "pii-graph")
    scores = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("confidence")).distinct()
    for _ in range(ROUNDS):
        known = graph.join(scores, ["kind", "instance"], "left")
        told = F.col("confidence").isNotNull() | ~F.col("fits")  # scored, or a misfit or foreign kind
        mean = F.sum(F.coalesce("confidence", F.lit(0.0))) / (F.count_if(told) + THINNED)
        patterns = known.groupBy("kind", "pattern").agg(mean.alias("worth"), F.count_if(F.col("confidence") >= INSTANCE_LEAST).alias("seeds"))
        good = patterns.where((F.col("worth") >= PATTERN_LEAST) & (F.col("seeds") >= SEEDS_LEAST)).select("kind", "pattern", "worth")
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("worth"), F.lit(0.999)))))
        said = graph.where("fits").join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("seed").alias("seed"), (1 - doubt).alias("worth"))
        seeds = graph.where("seed").select("kind", "instance", F.lit(1.0).alias("confidence")).distinct()
        scores = materialize(seeds.union(said.where("not seed").select("kind", "instance", F.col("worth").alias("confidence"))), "pii-scores")
    added = scores.join(graph.where("seed").select("kind", "instance").distinct(), ["kind", "instance"], "left_anti")
    return added.where(F.col("confidence") >= INSTANCE_LEAST)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by kind and start, for every row of ``docs``."""
    rows = keyed(docs, text)
    found = materialize(all_occurrences(rows), "pii-found")
    base = found.where("kind not in ('token', 'run')")
    free = materialize(candidates(found), "pii-candidates")
    new = discover(edges(base, free))
    # an instance that two kinds claim goes to the one with the higher confidence, then by name
    new = new.groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("instance", "best.kind")
    more = free.drop("kind").join(new, free.value == new.instance).select(*KEY, "kind", "start", "end", F.lit(False).alias("base"))
    outer = Window.partitionBy(*KEY).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    more = more.withColumn("until", F.max("end").over(outer)).where("until is null or until < end").drop("until")
    spans = base.select(*KEY, "kind", "start", "end", F.lit(True).alias("base")).unionByName(more)
    number = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), "start", "end", "base", "kind"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    by_row = spans.groupBy(*KEY).agg(listed.alias("spans"))
    out = rows.select(*KEY, "doc_id").join(by_row, KEY, "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
