"""Record linkage across cases: candidate pairs of value classes, factors, score and method.

Rows of equal attributes form one class, so that copies are compared once. Classes pair by an equal phone,
vehicle, account, typed identifier or alias, by common neighbours, or by names whose edit ratio reaches the
bar; the latter come from a filter that proves the other pairs impossible, so no pair of one type in different
cases is lost. A district that differs counts against a pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import edit_ratio
from weftline.operators.relational import without_known_pairs
from weftline.plans.lineage import Scratch


#: Types whose normalised value is itself an identifier (fixed values).
IDENTIFIER_TYPES = ("PHONE", "VEHICLE", "ACCOUNT", "EMAIL")
ATTRIBUTES = ("type", "name", "phone", "vehicle", "account", "value", "district", "aliases")


def classes(entities: DataFrame) -> DataFrame:
    """(class_id, *ATTRIBUTES, cases, members, n): rows of equal attributes, so that copies are compared once.

    ``entities`` needs entity_id, case_id, type and name; phone, vehicle, account, value (else the name),
    district and aliases (array) count where they are there. Rows without name or type are left out.
    """
    opt = lambda c, kind="string": F.col(c).cast(kind) if c in entities.columns else F.lit(None).cast(kind)
    given = lambda c: F.when(c != "", c)
    kept = lambda c, p: given(F.upper(F.regexp_replace(c, p, "")))
    name = F.lower(F.trim(F.regexp_replace("name", r"[^\p{L}\p{Nd}]+", " ")))
    digits = kept(opt("phone"), r"[^0-9]")
    kind = F.upper("type")
    value = F.when(kind.isin(*IDENTIFIER_TYPES), given(F.lower(F.trim(F.coalesce(opt("value"), F.col("name"))))))
    aliases = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(opt("aliases", "array<string>"), F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[^\p{L}\p{Nd}]+", " ")))), lambda x: x != "")))
    c = entities.where("name is not null and type is not null").select(
        kind.alias("type"), name.alias("name"), F.when(F.length(digits) >= 10, digits).alias("phone"), kept(opt("vehicle"), "[^a-zA-Z0-9]").alias("vehicle"),
        given(F.lower(F.trim(opt("account")))).alias("account"), value.alias("value"), given(F.lower(F.trim(opt("district")))).alias("district"), aliases.alias("aliases"), "case_id", "entity_id",
    )
    own = F.array_sort(F.collect_set("entity_id"))
    return c.where("name <> ''").groupBy(*ATTRIBUTES).agg(F.min("entity_id").alias("class_id"), F.array_sort(F.collect_set("case_id")).alias("cases"), own.alias("members"), F.count("*").alias("n"))


def class_members(entities: DataFrame) -> DataFrame:
    """(class_id, entity_id, case_id): the rows of each class; those of a class in several cases match exactly."""
    kept = entities.where("name is not null and type is not null").select("entity_id", "case_id").distinct()
    return classes(entities).select("class_id", F.explode("members").alias("entity_id")).join(kept, "entity_id").select("class_id", "entity_id", "case_id").distinct()


def near_names(names: DataFrame, least: float = 0.7, salts: int = 8) -> DataFrame:
    """(type, na, nb), both ways and with itself: all names of a type whose edit ratio is at least ``least`` (above 0).

    A name of n characters is cut into k + 1 parts, k = (1 - least) n being the faults allowed to it
    and any shorter name. One part at least is whole in the other name, and some whole part i has at
    most i - 1 faults before it and k + 1 - i behind it, which bounds the shift of its place.
    """
    n = names.select("type", "name").distinct().withColumn("n", F.length("name"))
    faults = f"cast(floor({{0}} * {1 - least!r} + 1e-6) as int)".format
    k = n.withColumn("k", F.expr(faults("n"))).withColumn("w", F.expr("n div (k + 1)")).withColumn("short", F.expr("k + 1 - n % (k + 1)"))
    part = k.withColumn("i", F.explode(F.expr("sequence(1, k + 1)"))).withColumn("p", F.expr("cast((i - 1) * w + greatest(0, i - 1 - short) as int)"))
    part = part.withColumn("text", F.expr("substring(name, p + 1, cast(w + int(i > short) as int))"))
    part = part.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "type", "text", "i", "p", "k", F.col("n").alias("nl"), F.col("name").alias("long"))
    longest = f"cast(floor(n / {least!r} + 1e-6) as int)"
    widths = F.expr(f"array_distinct(flatten(transform(sequence(n, {longest}), l -> array(l div ({faults('l')} + 1), l div ({faults('l')} + 1) + 1))))")
    piece = n.withColumn("w", F.explode(widths)).where("w <= n").withColumn("q", F.explode(F.expr("sequence(0, cast(n - w as int))")))
    piece = piece.select(F.pmod(F.hash("name"), F.lit(salts)).alias("salt"), "type", F.expr("substring(name, q + 1, cast(w as int))").alias("text"), "q", F.col("n").alias("ns"), F.col("name").alias("brief"))
    hit = piece.join(part.hint("shuffle_hash"), ["salt", "type", "text"]).where(
        "nl >= ns and nl - ns <= k and abs(q - p) < i and abs((ns - q) - (nl - p)) <= k + 1 - i and brief <> long and levenshtein(brief, long) <= k"
    )
    near = hit.select("type", F.least("brief", "long").alias("na"), F.greatest("brief", "long").alias("nb")).distinct()
    return near.unionByName(near.select("type", F.col("nb").alias("na"), F.col("na").alias("nb"))).unionByName(n.select("type", F.col("name").alias("na"), F.col("name").alias("nb")))


def score_of(exact: Column, positives: Column, alias: Column, name: Column, person: Column, context: Column, conflict: Column) -> Column:
    """Final score: exact identifiers first, then aliases, then names; a person's name alone gives at most 0.55."""
    bad = F.when(conflict, 0.15).otherwise(0.0)
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    # a person's name alone is capped; with a conflict beside it, it isn't alone
    alone = person & ~conflict & (context <= 0)
    by_name = F.when(context > 0, F.least(F.lit(0.95), name + 0.15 * context)).when(alone, F.least(F.lit(0.55), name)).otherwise(name)
    return (
        F.when(exact, clamp(0.88 + 0.05 * (positives - 1) - bad, 0.60, 0.99))
        .when(alias, clamp(0.75 + F.when(name >= 0.85, 0.10).otherwise(0.0) + F.when(context > 0, 0.08).otherwise(0.0) - bad, 0.50, 0.95))
        .otherwise(clamp(by_name - bad, 0.0, 1.0))
    )


def shared_neighbours(c: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(a, b, n_shared): classes of one type with common neighbours; ``neighbours`` is (entity_id, neighbour)."""
    of = c.select("type", "class_id", F.explode("members").alias("entity_id")).join(neighbours.select("entity_id", "neighbour").distinct(), "entity_id").select("type", "class_id", "neighbour").distinct()
    return of.withColumnRenamed("class_id", "a").join(of.withColumnRenamed("class_id", "b"), ["type", "neighbour"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def candidates(entities: DataFrame, least: float = 0.60, least_name: float = 0.70, neighbours: DataFrame | None = None, similarity=edit_ratio) -> DataFrame:
    """(a, b, name_score, score, method, factors): classes of equal type in different cases that may mean one entity.

    Every pair with a factor is scored: an equal phone (ten digits or more, one the end of the other), vehicle,
    account or typed identifier, an alias, common neighbours, or names of an edit ratio of ``least_name``; no pair
    that has one is lost to blocking. ``similarity`` scores the names of the pairs found.
    """
    c = Scratch(entities.sparkSession, "resolution").cut(classes(entities))

    def by(key: Column, other: Column | None = None) -> DataFrame:
        left = c.select("type", F.col("class_id").alias("a"), key.alias("key")).where("key is not null")
        right = c.select("type", F.col("class_id").alias("b"), (key if other is None else other).alias("key")).where("key is not null")
        return left.join(right, ["type", "key"]).select("a", "b")

    near = near_names(c, least_name)
    named = near.join(c.select("type", F.col("name").alias("na"), F.col("class_id").alias("a")), ["type", "na"]).join(c.select("type", F.col("name").alias("nb"), F.col("class_id").alias("b")), ["type", "nb"])
    found = [named.select("a", "b"), by(F.right("phone", F.lit(10))), by(F.col("vehicle")), by(F.col("account")), by(F.col("value"))]
    found += [by(F.explode("aliases"), F.col("name")), by(F.explode("aliases"))]
    shared = None if neighbours is None else shared_neighbours(c, neighbours)
    if shared is not None:
        found.append(shared.select("a", "b"))
    pairs = reduce(DataFrame.unionByName, found).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda p: c.select(F.col("class_id").alias(p), *[F.col(x).alias(f"{x}_{p}") for x in (*ATTRIBUTES, "cases")])
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("type_a = type_b and size(array_union(cases_a, cases_b)) > 1")
    pairs = pairs.join(shared, ["a", "b"], "left") if shared is not None else pairs.withColumn("n_shared", F.lit(None).cast("bigint"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    same = lambda x: yes(F.col(f"{x}_a") == F.col(f"{x}_b"))
    pairs = pairs.withColumn("name_score", similarity(F.col("name_a"), F.col("name_b")))
    hit = {
        "SHARED_PHONE": yes(F.endswith("phone_a", F.col("phone_b")) | F.endswith("phone_b", F.col("phone_a"))),
        "SHARED_VEHICLE": same("vehicle"),
        "SHARED_ACCOUNT": same("account"),
        "EXACT_IDENTIFIER": same("value"),
        "NAME_SIMILARITY": F.col("name_score") >= least_name,
        "ALIAS_MATCH": F.arrays_overlap("aliases_a", "aliases_b") | F.array_contains("aliases_a", F.col("name_b")) | F.array_contains("aliases_b", F.col("name_a")),
        "CONTEXT_SIMILARITY": F.coalesce("n_shared", F.lit(0)) > 0,
    }
    pairs = pairs.withColumn("hit", F.struct(*[v.alias(k) for k, v in hit.items()]))
    f = {k: F.col(f"hit.{k}") for k in hit}
    exact = f["SHARED_PHONE"] | f["SHARED_VEHICLE"] | f["SHARED_ACCOUNT"] | f["EXACT_IDENTIFIER"]
    positives = sum((x.cast("int") for x in f.values()), F.lit(0))
    conflict = yes(F.col("district_a") != F.col("district_b")) & ~exact & (F.col("name_score") < 0.90)
    context = F.least(F.lit(1.0), 0.5 * F.coalesce("n_shared", F.lit(0)))
    score = score_of(exact, positives, f["ALIAS_MATCH"], F.col("name_score"), F.col("type_a") == "PERSON", context, conflict)
    method = F.when(exact & (positives > 1), "MULTI_SIGNAL").when(exact, "EXACT_IDENTIFIER").when(f["ALIAS_MATCH"], "ALIAS_MATCH").otherwise("FUZZY_NAME")
    said = F.array_join(F.array_compact(F.array(*[F.when(v, k) for k, v in f.items()], F.when(conflict, "CONTRADICTORY_ATTRIBUTE"))), ",")
    scored = pairs.where(positives > 0).select("a", "b", "name_score", score.alias("score"), method.alias("method"), said.alias("factors"))
    return scored.where(F.col("score") >= least)


def new_candidates(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates that are not stored yet in either direction, scores rounded to two places."""
    return without_known_pairs(found, stored).withColumn("score", F.bround("score", 2))


def connections(reviewed: DataFrame) -> DataFrame:
    """(a, b, status, kind) of reviewed candidates: approved ones become connections."""
    ok = F.upper(F.regexp_replace("status", r"[\s_]+", "")).isin("APPROVED", "ACCEPTEDREPRESENTATION")
    no = F.upper(F.regexp_replace("status", r"[\s_]+", "")) == "REJECTED"
    status = F.when(ok, "APPROVED").when(no, "REJECTED").otherwise("PENDING")
    return reviewed.select("a", "b", status.alias("status"), F.when(ok, "CROSS_CASE_CONNECTION").alias("kind"))
