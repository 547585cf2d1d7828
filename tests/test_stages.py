"""The listing flow end to end on hand-written raw listings (fixture traps)."""

from pyspark.sql import functions as F

from acreage.plans import stages
from acreage.sources.io import RAW_LISTING_COLUMNS


def _raw(spark, n=36):
    furn = ["['1 Water Purifier', '5 Fan', '1 Fridge', 'No Bed']", "['2 Exhaust Fan','5 Fan']", "[]",
            "['3 AC', '2 Bed', '1 Sofa', '4 Light', '1 TV', '1 Dining Table']"]
    feats = ["['Swimming Pool', 'Gym']", "[\"Kid's Area\"]", None, "['Gym', 'Lift', 'Park']"]
    ages = ["0 to 1 Year Old", "1 to 5 Year Old", "5 to 10 Year Old", "10+ Year Old", "By Dec 2027", "Resale", None]
    floors = ["Lower Ground of 3 Floors", "Ground of 4 Floors", "12th of 20 Floors", None, "5th of 10 Floors"]
    titles = ["3 BHK Flat in Sector 67A, Gurgaon", "Independent House in Civil Lines, Gurgaon",
              "2 BHK Flat in Sector 42, Gurgaon"]
    prices = ["₹1.25 Cr", "₹85 Lac", "₹3.4 Cr", "₹2.1 Cr", "Price on Request", "₹abc"]
    rows = []
    for i in range(n):
        beds = 2 + i % 4
        rows.append((
            f"A{i}", titles[i % 3], f"https://x/p-spid-A{i}", [" DLF The Crest ", "M3M Golf", None][i % 3],
            prices[i % 6], f"₹{9000 + 250 * i:,}/sqft",
            f"{1200 + 37 * i:,} sqft ({(1200 + 37 * i) // 10} sqm) Super Built-up Area", f"{beds} Bedrooms",
            f"{1 + i % 3} Bathrooms", ["No Balcony", "2 Balconies", "3+ Balconies"][i % 3],
            ["Servant Room,Others", None, "Pooja Room"][i % 3], floors[i % 5], ["North-East", None][i % 2],
            ages[i % 7], "['Metro','Mall']", furn[i % 4], feats[i % 4]))
    return spark.createDataFrame(rows, ",".join(f"{c} string" for c in RAW_LISTING_COLUMNS))


def test_listing_flow(spark):
    raw = _raw(spark)
    clean = stages.clean(raw)
    assert clean.where(F.col("price_parse_error")).count() == 6
    merged = stages.merge({"Flat": clean.where(F.col("property_name").contains("Flat")),
                           "Independent House": clean.where(~F.col("property_name").contains("Flat"))})
    mapping = spark.createDataFrame([("sector 67a", "sector 67"), ("civil l", "sector 15")], "raw string, standard string")
    feat, model = stages.featured(merged, mapping, min_amenity_rows=2)
    f = feat.toPandas()
    assert set(f.sector) == {"sector 67", "sector 15", "sector 42"}
    assert set(f.furnishing_type) <= {"Furnished", "Semi-Furnished", "Unfurnished"}
    assert (f[f.property_id == "A2"].furnishing_type == "Unfurnished").all()   # "[]" -> no info
    assert f.luxury_score.min() >= 0
    m = stages.model_listing(feat, rare_min=2).toPandas()
    assert "age_possession" in m.columns and "price_per_sqft" not in m.columns
    assert m.price_in_cr.notna().all()
    assert set(m.luxury_category.dropna()) <= {"Budget", "Semi-Luxury", "Luxury"} | {f"bin_{i}" for i in range(3)}
    assert len(m.columns) == 23


def test_request_features(spark):
    req = spark.createDataFrame(
        [("Flat", "sector 42", 100.0, 2, 2, 0, 0, "New"), ("Flat", "sector 42", 100.01, 0, 2, 0, 0, "Old"),
         ("Independent House", "sector 99", 15000.0, 11, 2, 0, 1, "Under Construction")],
        "property_type string, sector string, total_area_sqft double, bedrooms int, bathrooms int, "
        "servant_room int, pooja_room int, age_label string").withColumn("balcony", F.lit(None).cast("string")) \
        .withColumn("facing", F.lit(None).cast("string"))
    listings = spark.createDataFrame([("sector 42", "a"), ("sector 42", "a"), ("sector 42", "Other"),
                                      ("sector 42", "Other"), ("sector 42", "Other")], "sector string, society string")
    out = {r["total_area_sqft"]: r for r in stages.request_features(req, listings).collect()}
    assert out[100.0]["is_valid"] is False and "total_area_sqft" in out[100.0]["invalid_reasons"]
    assert out[100.01]["area_per_bedroom"] == 100.01 and "bedrooms" in out[100.01]["invalid_reasons"]
    assert out[15000.0]["society"] == "other" and out[100.0]["society"] == "a"
    assert out[100.0]["age_possession"] == "Relatively New" and out[100.0]["facing"] == "east"
