"""Rules and experiments applied to search results: boosted scores, pins in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.functions import predicates
from vitrine.operators import experiments
from vitrine.session import checkpointed

SETTING = ["tenant", "query", "setting"]


def settings(hits: DataFrame, *context: str) -> DataFrame:
    """The different settings under which each query is answered, one row per setting and definition.

    ``hits(tenant, query, *context, label, place, patch)``: matched definitions. Contexts (quarter hours or
    sessions) that match the same definitions are one setting, so results grow with the definitions, not with
    the log.
    """
    labelled = hits.groupBy("tenant", "query", *context).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("setting"))
    different = labelled.select(*SETTING).distinct()
    patches = hits.groupBy("tenant", "query", "label").agg(F.min("place").alias("place"), F.any_value("patch").alias("patch"))
    members = different.withColumn("label", F.explode(F.split("setting", ",")))
    return members.join(patches, ["tenant", "query", "label"])


def pins(chosen: DataFrame, products: DataFrame) -> DataFrame:
    """Pinned products per setting: those of the last definition that names the query or associates categories.

    Within one definition the association goes before the pins it lists; one that finds no product changes nothing.
    """
    visible = products.filter(predicates.visible(F.col("hidden")))
    listed = (
        chosen.select(*SETTING, "place", F.explode("patch.pinnedResults").alias("pin"))
        .filter(F.lower(F.coalesce("pin.query", F.lit(""))) == F.col("query"))
        .select(*SETTING, "place", F.lit(0).alias("kind"), F.posexplode("pin.productIds").alias("pin_position", "id"))
        .withColumn("pin_position", F.col("pin_position") + 1)
        .join(visible.select("tenant", "id"), ["tenant", "id"], "left_semi")
    )
    # A definition's association is the same under every setting of a query: resolved once.
    wanted = chosen.filter("patch.categoryAssociation is not null").select("tenant", "query", "place", "patch.categoryAssociation.*").distinct()
    key = F.to_json(F.struct("query", "place"))
    found = experiments.association_pins(
        wanted.select(
            "tenant", key.alias("query"), "categories", F.col("softCategories").alias("soft_categories"), "limit"
        ), products,
    ).select("tenant", F.from_json("query", "query string, place int").alias("of"), "id", "pin_position").select("tenant", "of.*", "id", "pin_position")
    associated = chosen.select(*SETTING, "place").join(found, ["tenant", "query", "place"]).select(
        *SETTING, "place", F.lit(1).alias("kind"), "pin_position", "id"
    )
    both = listed.select(*associated.columns).unionByName(associated)
    last = both.groupBy(*SETTING).agg(F.max(F.struct("place", "kind")).alias("last")).select(*SETTING, "last.*")
    return both.join(last, [*SETTING, "place", "kind"]).select(*SETTING, "id", "pin_position")


def applied(pool: DataFrame, products: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every search's results under each of its settings: pins first, the rest by boosted score, no product twice.

    ``pool(tenant, in_stock, query, id, rrf, text_rank, vector_rank)`` with the query as asked; ``chosen``
    comes from ``settings``.
    """
    chosen = checkpointed(chosen)
    asked = pool.withColumn("asked", F.col("query")).withColumn("query", F.lower("query"))
    rows = asked.join(chosen.select(*SETTING).distinct(), ["tenant", "query"]).join(
        products.select("tenant", "id", "soft_category"), ["tenant", "id"]
    )
    scored = experiments.boosted(
        rows,
        experiments.effective_boosts(chosen, "productBoosts", *SETTING),
        experiments.effective_boosts(chosen, "softCategoriesBoost", *SETTING),
        experiments.effective_multiplier(chosen, *SETTING),
        keys=SETTING, row_keys=["in_stock", "asked"],
    ).withColumn("boosted_score", F.round("boosted_score", 9))
    search = [*SETTING, "in_stock", "asked"]
    # What sorts after the score, kept as one value so that a pinned result of the pool stays one row.
    ranks = F.struct("boosted_score", "text_rank", "vector_rank")
    front = rows.select(*search).distinct().join(pins(chosen, products), SETTING)
    merged = (
        scored.select(*search, "id", ranks.alias("r"), F.lit(None).cast("int").alias("pin_position"))
        .unionByName(front.select(*search, "id", F.lit(None).cast(scored.select(ranks.alias("r")).schema["r"].dataType).alias("r"), F.col("pin_position").cast("int").alias("pin_position")))
        .groupBy(*search, "id")
        .agg(F.max("r").alias("r"), F.min("pin_position").alias("pin_position"))
    )
    w = Window.partitionBy(*search).orderBy(
        F.asc_nulls_last("pin_position"), F.desc_nulls_last("r.boosted_score"), F.asc_nulls_last("r.text_rank"), F.asc_nulls_last("r.vector_rank"), "id"
    )
    return merged.select(
        "tenant", "in_stock", F.col("asked").alias("query"), "setting", "id", F.col("pin_position").isNotNull().alias("pinned"),
        F.col("r.boosted_score").alias("boosted_score"), F.row_number().over(w).cast("long").alias("position"),
    )
