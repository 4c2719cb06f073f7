"""Names matched to entities by edit distance, through segments that must agree.

Two names are alike if one minus their distance over the longer length reaches ``least`` percent.
An entity's name of length l is cut into one more segments than the edits that its farthest
partner allows, so that at least one stands unchanged in any name alike to it, moved no further
than the edits left and right of it permit.  Names join on (length, segment, its text); only
those pairs are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _segments(least: int) -> dict[str, str]:
    """SQL of the number of segments, and of a segment's start and size, for length ``l``."""
    n = f"(({100 - least} * ((100 * l) div {least})) div 100 + 1)"
    return {"n": n, "start": f"(i * (l div {n}) + greatest(0, i - ({n} - l % {n})))", "size": f"(l div {n} + if(i >= {n} - l % {n}, 1, 0))"}


def alike(names: DataFrame, variants: DataFrame, least: int = 80) -> DataFrame:
    """(name, variant, distance) of distinct strings of ``names`` (name) and ``variants`` (variant)
    that are alike to ``least`` percent; empty strings are alike to nothing."""
    s = _segments(least)
    own = variants.select("variant").where("variant <> ''").distinct().withColumn("l", F.length("variant"))
    own = own.withColumn("i", F.explode(F.expr(f"sequence(0, least({s['n']}, l) - 1)")))
    own = own.withColumn("part", F.expr(f"substring(variant, {s['start']} + 1, {s['size']})"))
    asked = names.select("name").where("name <> ''").distinct().withColumn("q", F.length("name"))
    asked = asked.withColumn("l", F.explode(F.expr(f"sequence(cast(({least} * q + 99) div 100 as int), cast((100 * q) div {least} as int))")))
    asked = asked.withColumn("d", F.expr(f"cast(({100 - least} * greatest(l, q)) div 100 as int)"))
    asked = asked.withColumn("i", F.explode(F.expr(f"sequence(0, least({s['n']}, l) - 1)")))
    # An unchanged segment moved by k has at least |k| edits before it and |q - l - k| after.
    low = f"greatest(0, {s['start']} + cast(ceil((q - l - d) / 2) as int))"
    high = f"least(q - {s['size']}, {s['start']} + cast(floor((q - l + d) / 2) as int))"
    asked = asked.withColumn("low", F.expr(f"cast({low} as int)")).withColumn("high", F.expr(f"cast({high} as int)")).where("low <= high")
    asked = asked.withColumn("at", F.explode(F.sequence("low", "high")))
    asked = asked.select("name", "l", "i", "d", F.expr(f"substring(name, at + 1, {s['size']})").alias("part"))
    pairs = asked.join(own, ["l", "i", "part"]).select("name", "variant", "d").distinct()
    compared = pairs.withColumn("distance", F.levenshtein("name", "variant")).where("distance <= d")
    return compared.select("name", "variant", "distance")


def resolve(names: DataFrame, entities: DataFrame, least: int = 80) -> DataFrame:
    """(key, entity, ratio): each of ``names`` (key, name) with the entity of ``entities`` (entity,
    name, aliases) whose name or alias is most alike in lower case, ties to the lesser entity;
    those without one are left out."""
    spelled = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = entities.select("entity", F.explode(F.transform(spelled, lambda x: F.lower(x))).alias("variant")).where("variant is not null").distinct()
    asked = names.select("key", F.lower(F.trim("name")).alias("name"))
    found = alike(asked, known, least).join(known, "variant")
    ratio = 1 - F.col("distance") / F.greatest(F.length("name"), F.length("variant"))
    chosen = found.withColumn("ratio", ratio).groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("least"), "entity")).alias("x"))
    chosen = chosen.select("name", "x.entity", (-F.col("x.least")).alias("ratio"))
    return asked.join(chosen, "name").select("key", "entity", "ratio")
