"""Briefings: scoring, diverse selection, token budgets; and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.operators.dedup import nearest
from larkspur.operators.scratch import discard, scratch_path, written, written_at
from larkspur.operators.search import cosine

MOST_CANDIDATES = 300
#: Steps of a selection after which likeness is written down.
HELD = 8


def score(importance: Column, age_days: Column, pinned: Column, cluster: Column, skill: Column, w: dict[str, float] = fixed.BRIEFING_WEIGHTS) -> Column:
    return w["importance"] * importance + w["recency"] * F.exp(-F.greatest(age_days, F.lit(0.0)) / 30.0) + w["pinned"] * pinned.cast("double") + w["cluster"] * cluster + w["skill"] * skill.cast("double")


def centroid(vectors: DataFrame) -> DataFrame:
    """One row: the mean vector, null if there is none or sizes differ."""
    sized = vectors.where("vector is not null").select("vector", F.size("vector").alias("n"))
    cells = sized.select("n", F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min("n").alias("low"), F.max("n").alias("high"))
    row = cells.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high"))
    return row.select(F.when(F.col("low") == F.col("high"), F.transform("cells", lambda c: c["x"])).alias("vector"))


def pool(memories: DataFrame, cap: int) -> DataFrame:
    """Pinned rows and the newest ones, once each."""
    pinned = memories.where("is_pinned").orderBy(F.desc("created_minute"), "id").limit(min(50, cap))
    newest = memories.orderBy(F.desc("created_minute"), "id").limit(max(80, min(MOST_CANDIDATES, 10 * cap)))
    return pinned.unionByName(newest).dropDuplicates(["id"])


def select_diverse(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """(id, score) by maximal marginal relevance over all rows (id, score, is_pinned,
    vector): pinned ones always stay, ties go to the higher score, then the earlier id.

    Each of at most ``k`` steps takes the best row that is not pinned.  Between steps only the rows
    taken are kept, and every ``HELD`` steps what all others are alike to so far, in place of the
    table before.  Likeness to pinned rows comes from blocks of both sides in tasks.
    """
    if k <= 0:
        return candidates.select("id", "score").limit(0)
    rows = written(candidates.select("id", "score", F.coalesce("is_pinned", F.lit(False)).alias("is_pinned"), "vector"), "diverse")
    pinned = rows.where("is_pinned").select("id", "score")
    steps = k - pinned.limit(k).count()
    if steps <= 0:
        return pinned
    sized = rows.where("vector is not null").select("id", "vector", "is_pinned", F.size("vector").alias("size"))
    alike = None
    for n in sorted(r["size"] for r in sized.where("is_pinned").select("size").distinct().collect() if r["size"]):
        near = nearest(*(sized.where((F.col("is_pinned") == p) & (F.col("size") == n)) for p in (False, True)))
        alike = near if alike is None else alike.unionByName(near)
    rest = rows.where("not is_pinned").select("id", "score", "vector")
    if alike is None:
        rest = rest.withColumn("alike", F.lit(0.0))
    else:
        rest = rest.join(alike, "id", "left").withColumn("alike", F.greatest(F.coalesce("alike", F.lit(0.0)), F.lit(0.0)))
    spark, at = rows.sparkSession, scratch_path(rows.sparkSession, "diverse-rest")
    rest = written_at(rest, at)
    taken: list[tuple[int, float]] = []
    for step in range(steps):
        best = rest.orderBy(F.desc(F.lit(balance) * F.col("score") - F.lit(1 - balance) * F.col("alike")), F.desc("score"), "id").first()
        if best is None:
            break
        taken.append((best.id, best.score))
        vector = F.lit(None).cast("array<double>") if best.vector is None else F.array(*[F.lit(float(x)) for x in best.vector]).cast("array<double>")
        rest = rest.where(F.col("id") != best.id).withColumn("alike", F.greatest("alike", cosine(F.col("vector"), vector)))
        if step % HELD == HELD - 1:
            before, at = at, scratch_path(spark, "diverse-rest")
            rest = written_at(rest, at)
            discard(spark, before)
    return pinned.unionByName(rows.sparkSession.createDataFrame(taken, pinned.schema)) if taken else pinned


def compact(memories: DataFrame, since_minute: int, limit: int = 5) -> DataFrame:
    """The newest active memories from ``since_minute`` on, or, where there is none, the most
    important ones of all times."""
    recent = memories.where(F.col("created_minute") >= since_minute).orderBy(F.desc("created_minute"), "id").limit(limit)
    top = memories.orderBy(F.desc("importance"), F.desc("created_minute"), "id").limit(limit)
    return recent.unionByName(top.join(F.broadcast(recent.agg(F.count("*").alias("_n")))).where("_n = 0").drop("_n"))


def snippets(memories: DataFrame, limit: int) -> DataFrame:
    """(id, snippet) of the newest ``limit`` memories that hold any text, on one line of at most 280 characters."""
    flat = F.trim(F.translate("content", "\n", " "))
    cut = F.when(F.length(flat) > 280, F.concat(F.substring(flat, 1, 277), F.lit("..."))).otherwise(flat)
    newest = memories.orderBy(F.desc("created_minute"), "id").limit(limit).where(flat != "")
    return newest.select("id", F.concat(F.lit("["), F.coalesce("platform", F.lit("unknown")), F.lit("/"), F.coalesce("content_type", F.lit("fact")), F.lit("] "), cut).alias("snippet"))


def weights(*layers: dict[str, object]) -> dict[str, float]:
    """The default weights under layers of which later ones win; unknown names and values
    that are no numbers are ignored, negative ones refused."""
    out = dict(fixed.BRIEFING_WEIGHTS)
    for layer in layers:
        for name, value in layer.items():
            try:
                number = float(value)  # type: ignore[arg-type]
            except (TypeError, ValueError):
                continue
            if name in out:
                out[name] = number
    if any(v < 0 for v in out.values()):
        raise ValueError(f"weights must not be negative: {out}")
    return out


def tier_budget(tier: Column, context_tokens: Column, most_tokens: Column) -> tuple[Column, Column]:
    """(tokens, rows) of a tier T0 to T4; a positive ``most_tokens`` only lowers them."""
    tokens, rows = budget(context_tokens)
    plain = F.when(tier == "T0", 120).when(tier == "T1", tokens).when(tier == "T2", 500).when(tier == "T3", 1500).when(tier == "T4", 800)
    return F.when(most_tokens > 0, F.least(plain, most_tokens)).otherwise(plain), F.when(tier == "T0", 0).when(tier == "T1", rows).when(tier == "T2", 12).when(tier == "T3", 20).when(tier == "T4", 15)


def budget(context_tokens: Column) -> tuple[Column, Column]:
    """(tokens, rows) for a context size."""
    return F.when(context_tokens < 32_000, 400).when(context_tokens < 200_000, 800).otherwise(1500), F.when(context_tokens < 32_000, 8).when(context_tokens < 200_000, 15).otherwise(25)


def metrics(found: Column, gold: Column, k: int) -> tuple[Column, Column, Column]:
    """(recall, reciprocal rank, precision) of a ranked list against a set, at k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    top = F.slice(found, 1, k)
    hit = F.filter(top, lambda x: F.array_contains(gold, x))
    first = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull()))
    recall = F.when(F.size(hit) > 0, 1.0).otherwise(0.0)
    return recall, F.coalesce(1.0 / first, F.lit(0.0)), F.size(hit) / F.lit(float(k))
