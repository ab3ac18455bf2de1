"""Query plans: validation, scope normalisation, constraint extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

#: Names of venues and tracks as questions give them.
VENUES = {v: v for v in ("acl", "emnlp", "naacl", "eacl", "coling", "tacl", "iclr", "neurips", "icml", "aaai", "ijcai")} | {"nips": "neurips"}
TRACKS = {t: t for t in ("long", "short", "findings", "demo", "industry", "library")}


def invalid_plans(queries: DataFrame, buckets: DataFrame) -> DataFrame:
    """(plan_id, problem): plans that break a rule - an empty global query, fewer than 3 or more than 5 aspects,
    repeated ids, weights that are negative or sum to nothing, buckets without query, description or target."""
    q = queries.withColumn("query", F.trim("query")).withColumn("id", F.lower(F.trim("name")))
    a = q.where("kind = 'aspect'").groupBy("plan_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("weight").alias("least"), F.sum("weight").alias("total"), F.count_if((F.col("query") == "") | (F.col("id") == "")).alias("blank"))
    every = queries.select("plan_id").distinct()
    j = every.join(a, "plan_id", "left")
    rule = lambda df, bad, name: df.where(bad).select("plan_id", F.lit(name).alias("problem"))
    out = rule(j, F.coalesce("n", F.lit(0)).between(3, 5) == F.lit(False), "aspect count")
    out = out.unionByName(rule(j, F.col("ids") < F.col("n"), "repeated aspect")).unionByName(rule(j, F.col("blank") > 0, "blank aspect"))
    out = out.unionByName(rule(j, (F.col("least") < 0) | (F.col("total") <= 0), "weights"))
    out = out.unionByName(rule(every.join(q.where("kind = 'global' AND query <> ''"), "plan_id", "left_anti"), F.lit(True), "global query"))
    b = buckets.withColumn("id", F.lower(F.trim("bucket_id")))
    asked = q.where("kind = 'bucket' AND query <> ''").select("plan_id", "id").distinct()
    out = out.unionByName(rule(every.join(b, "plan_id", "left_anti"), F.lit(True), "no bucket"))
    out = out.unionByName(rule(b.join(asked, ["plan_id", "id"], "left_anti"), F.lit(True), "bucket without query"))
    out = out.unionByName(rule(b, (F.col("id") == "") | (F.trim(F.coalesce("description", F.lit(""))) == "") | (F.coalesce("target", F.lit(0)) <= 0), "bucket"))
    twice = b.groupBy("plan_id", "id").agg(F.count("*").alias("c")).where("c > 1")
    return out.unionByName(rule(twice, F.lit(True), "repeated bucket")).distinct()


def normalised_weights(queries: DataFrame) -> DataFrame:
    """Aspect weights scaled to sum to 1 within each plan."""
    total = queries.where("kind = 'aspect'").groupBy("plan_id").agg(F.sum("weight").alias("_t"))
    return queries.join(total, "plan_id", "left").withColumn("weight", F.when(F.col("kind") == "aspect", F.col("weight") / F.col("_t")).otherwise(F.col("weight"))).drop("_t")


def _aliased(values: Column, names: dict[str, str]) -> Column:
    """Known names: a value as a whole, else each of its parts between blanks, slashes and hyphens."""
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    low = F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    whole = lambda v: F.try_element_at(known, v)
    parts = lambda v: F.transform(F.split(F.translate(v, "/-", "  "), r"\s+"), lambda t: F.try_element_at(known, t))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(low, lambda v: F.when(whole(v).isNotNull(), F.array(whole(v))).otherwise(parts(v))))))


def scope(venues: Column | str, years: Column | str, tracks: Column | str) -> Column:
    """struct<venues, years, tracks> with aliases resolved; years also out of venue names of four digits."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    v = F.coalesce(as_col(venues), F.array().cast("array<string>"))
    t = F.coalesce(as_col(tracks), F.array().cast("array<string>"))
    unknown = F.filter(F.transform(v, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin(list(VENUES)))
    inside = F.transform(F.filter(F.flatten(F.transform(unknown, lambda x: F.split(F.translate(x, "/-", "  "), r"\s+"))), lambda x: x.rlike(r"^\d{4}$")), lambda x: x.cast("int"))
    y = F.array_sort(F.array_distinct(F.concat(F.coalesce(as_col(years), F.array().cast("array<int>")), inside)))
    return F.struct(_aliased(v, VENUES).alias("venues"), y.alias("years"), _aliased(t, TRACKS).alias("tracks"))


def constraints(query: Column | str) -> Column:
    """struct<venues, years, tracks, phrases, excluded, priors> out of a question: names and years it mentions,
    quoted phrases, terms after "not", "without" or "except", and the section kinds it asks for."""
    q = F.col(query) if isinstance(query, str) else query
    words = T.tokens(q)
    known = lambda names: F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    pick = lambda names: F.array_distinct(F.array_compact(F.transform(words, lambda w: F.try_element_at(known(names), w))))
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))))
    phrases = F.filter(F.transform(F.regexp_extract_all(q, F.lit(r"[\"“]([^\"”]{2,80})[\"”]"), F.lit(1)), T.squash), lambda p: p != "")
    excluded = F.transform(F.regexp_extract_all(q, F.lit(r"(?i)\b(?:not|without|except|excluding)\s+([\p{L}\d-]+)"), F.lit(1)), lambda w: F.lower(w))
    return F.struct(pick(VENUES).alias("venues"), years.alias("years"), pick(TRACKS).alias("tracks"), phrases.alias("phrases"), F.array_distinct(excluded).alias("excluded"), T.section_priors(q).alias("priors"))


def constraint_graph(question: Column | str, c: Column | str) -> Column:
    """struct<root_operator, operators, nodes>: the constraints of a question as numbered nodes of a conjunction.

    c: the struct constraints() gives. Scopes come first, then the wanted section kinds, which weigh 0.8.
    """
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    c = F.col(c) if isinstance(c, str) else c
    node = lambda kind, weight, scope: lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"), F.lit(weight).alias("weight"), F.lit(scope).alias("scope"))
    lists = [(c["venues"], "scope", 1.0, "venue"), (c["years"], "scope", 1.0, "year"), (c["tracks"], "scope", 1.0, "track"), (c["priors"], "section", 0.8, "prior")]
    flat = F.concat(*[F.transform(F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != "")), node(kind, weight, scope)) for values, kind, weight, scope in lists])
    nodes = F.transform(flat, lambda n, i: F.struct(F.concat_ws("_", n["kind"], (i + 1).cast("string")).alias("node_id"), n["kind"].alias("kind"), n["value"].alias("value"), n["weight"].alias("weight"), n["scope"].alias("scope")))
    operators = F.array_compact(F.array(F.when(q.rlike(r"\bor\b"), "or"), F.when(q.rlike(r"\b(?:not|without|except)\b"), "not")))
    return F.struct(F.lit("and").alias("root_operator"), operators.alias("operators"), nodes.alias("nodes"))
