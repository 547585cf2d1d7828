"""The listing flow as lazy Spark stages (§3.1 of the blueprint):

    clean (per source) -> merge -> featured -> model_listing -> (ML)

Every stage is a plain DataFrame -> DataFrame function over the declared layer
schemas; nothing is collected except fitted scalars (furnishing clusters,
quantile edges).  Write a stage with :func:`acreage.sources.io.stage` to cut
lineage between steps.  Errors are raised, never swallowed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.functions import parse as P
from acreage.operators import features, impute, rules
from acreage.session import cut_lineage

# ---- clean -----------------------------------------------------------------


def clean(raw: DataFrame) -> DataFrame:
    """B1-B7 on a raw listing table (17 string columns)."""
    return (raw.withColumnsRenamed({"price": "price_text", "area": "rate_text"})
               .withColumns({
                   "price_in_cr": P.price_cr("price_text"),
                   "price_parse_error": P.is_bad_price("price_text"),
                   "price_per_sqft": P.rate("rate_text"),
                   "bedrooms": P.leading_number("bedrooms"),
                   "bathrooms": P.leading_number("bathrooms"),
                   "balcony": P.balcony("balcony"),
                   "additional_room": P.fill_lower("additional_room"),
                   "facing": P.fill_lower("facing"),
                   "society": P.trim_lower("society"),
               }).drop("price_text", "rate_text"))


def merge(frames: Mapping[str, DataFrame]) -> DataFrame:
    """G1: tag each cleaned source with its property type and union by name."""
    return features.tag_union(dict(frames), "property_type")


# ---- featured ---------------------------------------------------------------


def featured(df: DataFrame, sector_map: DataFrame | None = None,
             furnish_model: features.FurnishClusters | None = None,
             min_amenity_rows: int = 30) -> tuple[DataFrame, features.FurnishClusters]:
    """B8-B15, G3-G6 on a merged clean listing table.  Returns the featured
    table and the (fitted or given) furnishing cluster model."""
    d = df.withColumn("sector", P.locality("property_name"))
    if sector_map is not None:
        d = P.standardize(d, "sector", sector_map)
    d = d.withColumn("floornum", P.floor_num("floor_info"))
    d = d.withColumns(P.areas("areawithtype"))
    d = d.withColumns(P.room_flags("additional_room"))
    d = d.withColumn("age_possession_category", P.age_band("property_age"))
    # furnishing: item counts -> clusters (labels in place, no join-back fan-out)
    d = d.withColumn("__furnish", P.clean_list_text("furnishing_details"))
    d = d.withColumns(P.item_counts("__furnish"))
    d = d.withColumn("known", F.col("__furnish") != "No Info")
    d = cut_lineage(d)   # parsed layer: reused by the fit and by every amenity branch below
    model = furnish_model or features.FurnishClusters(P.FURNISHING_ITEMS).fit(d)
    d = model.transform(d).drop("furnish_cluster", "known", "__furnish", *P.FURNISHING_ITEMS)
    # amenities -> premium weights -> luxury score
    d = d.withColumn("features", P.decode_literal("features", "array<string>"))
    w = features.amenity_weights(d, "property_id", "features", "price_per_sqft", min_amenity_rows)
    lux = features.luxury_score(d, "property_id", "features", w)
    d = d.join(lux, "property_id", "left")
    # fixed values: columns of the featured table, in their order
    keep = ["property_id", "property_type", "link", "society", "sector", "price_in_cr", "price_per_sqft",
            "areawithtype", "plot_area", "super_built_up_area", "built_up_area", "carpet_area", "bedrooms",
            "bathrooms", "balcony", "floornum", "study_room", "servant_room", "store_room", "pooja_room", "others",
            "facing", "furnishing_type", "age_possession_category", "features", "luxury_score"]
    return cut_lineage(d.select(*keep)), model


# ---- model listing ------------------------------------------------------------

AREA_COLS = ["super_built_up_area", "built_up_area", "carpet_area", "plot_area"]
# Columns of the model listing, in their order.
MODEL_ORDER = ["property_type", "society", "sector", "price_in_cr", "price_per_sqft", "total_area_sqft", "bedrooms",
               "bathrooms", "balcony", "floornum_category", "study_room", "servant_room", "store_room",
               "pooja_room", "others", "facing", "furnishing_type", "age_possession_category",
               "super_built_up_area_missing", "built_up_area_missing", "carpet_area_missing",
               "plot_area_missing", "area_per_bedroom", "luxury_category"]


def model_listing(df: DataFrame, area_cap: float = 15000, rate_cap: float = 100000,
                  rare_min: int = 5) -> DataFrame:
    """F1-F10, C1-C4, K1 on a featured table -> the 23-column model listing."""
    d = impute.missing_flags(df, AREA_COLS)
    d = d.withColumn("total_area_sqft", impute.primary_area("property_type", "super_built_up_area", "plot_area"))
    d = d.withColumn("total_area_sqft", impute.fallback_area("total_area_sqft",
                                                             ["super_built_up_area", "built_up_area", "carpet_area"]))
    d = impute.coerce_numeric(d, ["price_in_cr", "price_per_sqft", "total_area_sqft", "bedrooms", "bathrooms"])
    d = d.withColumn("floornum", F.col("floornum").try_cast("double"))
    d = rules.apply(d, {"require": rules.require(["price_in_cr", "price_per_sqft"]),
                        "area_cap": rules.cap("total_area_sqft", area_cap)})
    d = d.withColumn("area_per_bedroom", P.area_per_bedroom("total_area_sqft", "bedrooms"))
    d = rules.apply(d, {"ratio": rules.ratio_rule("total_area_sqft", "bedrooms")})
    d = rules.apply(d, {"rate_cap": rules.cap("price_per_sqft", rate_cap)})
    d = cut_lineage(d)   # filtered layer: the fills below each run a size check / edge job on it
    d = impute.median_fill(d, "floornum")
    d = impute.mode_fill(d, "age_possession_category", "Undefined")
    d = impute.cap_rare(d, "society", rare_min)
    d = impute.qcut(d, "luxury_score", 3, ["Budget", "Semi-Luxury", "Luxury"], out="luxury_category")
    d = d.withColumn("floornum_category", impute.floor_band("floornum"))
    out = d.select(*[c for c in MODEL_ORDER if c in d.columns]).drop("price_per_sqft")
    return out.withColumnRenamed("age_possession_category", "age_possession")


# ---- price requests (§3.3) ------------------------------------------------------

# Fixed values that must equal the reference's: the request age labels.
AGE_REQUEST_MAP = {"New": "Relatively New", "Old": "Moderately Old", "Under Construction": "Under Construction"}


def request_features(requests: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """C10 -> F11 -> B21/B22 over a table of price requests: validation flags,
    default society per sector (from the model listing), area per bedroom
    (area itself when bedrooms = 0), plot_area_missing = 0, age label map."""
    if "age_label" in requests.columns:
        m = F.create_map(*[x for k, v in AGE_REQUEST_MAP.items() for x in (F.lit(k), F.lit(v))])
        requests = requests.withColumn("age_possession", m[F.col("age_label")])
    d = rules.validate(requests, rules.request_spec(), defaults=rules.REQUEST_DEFAULTS)
    if listings is not None:
        from acreage.operators.views import default_category
        soc = default_category(listings, "sector", "society", skip="other")
        d = d.join(soc, "sector", "left").withColumn(
            "society", F.coalesce(F.col("default_society"), F.lit("other"))).drop("default_society")
    d = d.withColumn("area_per_bedroom", F.when(F.col("bedrooms") > 0,
                                                F.try_divide(F.col("total_area_sqft"), F.col("bedrooms")))
                     .otherwise(F.col("total_area_sqft")))
    return d.withColumn("plot_area_missing", F.lit(0))
