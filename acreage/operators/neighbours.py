"""The k nearest items of every item, exactly.

Vectors are long tables (key, feature, weight) with positive weights and a norm of at most 1, such as
TF-IDF weights.  No table of all pairs is made:

1. Items of equal vectors form one class, worked on once; a class names its k + 1 least keys.
2. Each class gets a floor: the exact score of its k-th best partner among a few seeds (the heaviest
   postings of its heaviest features).  No neighbour can score less.
3. A class's features are ordered, rare ones first.  What the features from a place on can add is at most
   the sum of weight times the feature's greatest weight, and at most their norm.  Where that is below the
   floor, the rest of the features is not looked up at all.
4. A feature's postings stand in blocks by weight (four an octave).  A block is opened only where its
   greatest weight, with all that later features can add, can reach the floor; within it the bound is taken
   for each posting, with the norm that the posting leaves to the others.
5. The pairs that remain are scored in full and ranked.

A pair that reaches the floor passes the bounds at the first feature that both have, so none is lost.

Defined results: scores are rounded to 9 places, ties go to the smaller key; an item with fewer than k
partners that share a feature has fewer rows; rows without key or feature, or without a positive weight, are
left out, so an item without features is neither asked for nor found; an empty index gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.operators.similarity import top_k
from acreage.session import Tables

SLACK = 1e-7              # above the rounding of scores, so that ties at the floor stay
BLOCKS = 4                # blocks for each halving of the weight


def bounded_vectors(rows: DataFrame) -> DataFrame:
    """(x, f, w) with the bounds: ``top`` (the feature's greatest weight), ``here`` (what this feature and the later
    ones can add), ``tail_sum`` and ``tail_norm`` (what the later ones can), ``block``.  Features of one class alone
    add to no score and are left out."""
    best = rows.groupBy("f").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("x").orderBy("df", "f")       # one item's features
    on, after = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(1, Window.unboundedFollowing)
    add, square = F.col("w") * F.col("top"), F.col("w") * F.col("w")
    return rows.join(best, "f").select(
        "x", "f", "w", "top", F.least(F.sum(add).over(on), F.sqrt(F.sum(square).over(on))).alias("here"),
        F.coalesce(F.sum(add).over(after), F.lit(0.0)).alias("tail_sum"),
        F.sqrt(F.coalesce(F.sum(square).over(after), F.lit(0.0))).alias("tail_norm"),
        F.floor(-BLOCKS * F.log2("w")).cast("int").alias("block"))


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(x, y, score) of pairs (x, y)."""
    left, right = vectors.select("x", "f", "w"), vectors.select(F.col("x").alias("y"), "f", F.col("w").alias("wy"))
    return pairs.join(left, "x").join(right, ["y", "f"]).groupBy("x", "y").agg(F.sum(F.col("w") * F.col("wy")).alias("score"))


def floors(vectors: DataFrame, k: int, seeds: int) -> DataFrame:
    """(x, floor): the exact score of the k-th best of x's seeds."""
    heaviest = Window.partitionBy("x").orderBy((F.col("w") * F.col("top")).desc(), "f")
    asked = vectors.withColumn("r", F.row_number().over(heaviest)).where(F.col("r") <= seeds).select("x", "f", "w")
    heavy = top_k(vectors.select("f", "x", "w"), "f", "w", k + 1, "x").select("f", F.col("x").alias("y"), F.col("w").alias("wy"))
    met = asked.join(heavy, "f").where("x != y").groupBy("x", "y").agg(F.sum(F.col("w") * F.col("wy")).alias("part"))
    # at most seeds * (k + 1) partners of each x
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.col("part").desc(), "y"))).where(F.col("r") <= k)
    scored = pair_scores(first.select("x", "y"), vectors)
    return scored.groupBy("x").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("x", "floor")


def candidate_pairs(vectors: DataFrame, floor: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) in which y can be one of x's k nearest."""
    least = F.col("floor") - SLACK
    asked = vectors.drop("block").join(floor, "x", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).where(F.col("here") >= least)
    blocks = vectors.groupBy("f", "block").agg(F.max("w").alias("hi"))
    opened = (asked.join(blocks, "f").where(F.col("w") * F.col("hi") + F.least("tail_sum", "tail_norm") >= least)
              .select("x", "f", "block", "w", "tail_sum", "tail_norm", "floor"))
    postings = vectors.select("f", "block", F.col("x").alias("y"), F.col("w").alias("wy"))
    left_over = F.sqrt(F.greatest(F.lit(0.0), 1 + SLACK - F.col("wy") * F.col("wy")))
    bound = F.col("w") * F.col("wy") + F.least(F.col("tail_sum"), F.col("tail_norm") * left_over)
    return opened.join(postings, ["f", "block"]).where("x != y").where(bound >= least).select("x", "y").distinct()


def nearest(index: DataFrame, key: str, k: int, feature: str = "term", weight: str = "weight", seeds: int = 4) -> DataFrame:
    """(key, neighbour, score, rank) of the k nearest other items of every item by the sum of products of weights."""
    t = Tables(index.sparkSession, "nearest")
    rows = index.select(F.col(key).alias("key"), F.col(feature).alias("f"), F.round(F.col(weight).cast("double"), 12).alias("w"))
    rows = rows.where("key is not null and f is not null and w > 0")
    vector = F.struct(F.bit_xor(F.xxhash64("f", "w")).alias("a"), F.bit_xor(F.xxhash64("w", "f", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n"))
    t.put(of=rows.groupBy("key").agg(vector.alias("vector")))
    classes = t["of"].groupBy("vector").agg(F.min("key").alias("x"))
    t.put(named=t["of"].join(classes, "vector").select("key", "x"))
    members = top_k(t["named"].withColumn("same", F.lit(0)), "x", "same", k + 1, "key").select(F.col("x").alias("y"), F.col("key").alias("neighbour"))
    of_class = rows.join(t["named"].where("key = x").select("key"), "key", "left_semi").withColumnRenamed("key", "x")
    t.put(rows=of_class)
    t.put(vectors=bounded_vectors(t["rows"]))
    t.put(floor=floors(t["vectors"], k, seeds))
    t.put(pairs=candidate_pairs(t["vectors"], t["floor"]))
    itself = t["rows"].groupBy("x").agg(F.sum(F.col("w") * F.col("w")).alias("score")).select("x", F.col("x").alias("y"), "score")
    scored = pair_scores(t["pairs"], t["vectors"]).unionByName(itself).withColumn("score", F.round("score", 9))
    # the k + 1 first items of a class stand in its k + 1 first classes: each of those has its least key before
    near = top_k(scored, "x", "score", k + 1, "y").select("x", "y", "score").join(members, "y")
    place = Window.partitionBy("x").orderBy(F.col("score").desc(), "neighbour")        # at most (k + 1)^2 rows
    first = near.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
    lists = first.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("key")), 1, k)
    t.put(out=t["named"].join(lists, "x").select("key", F.posexplode(others).alias("at", "n"))
          .select(F.col("key").alias(key), F.col("n.neighbour").alias("neighbour"), F.col("n.score").alias("score"), (F.col("at") + 1).cast("int").alias("rank")))
    out = t["out"]
    t.drop("of", "named", "rows", "vectors", "floor", "pairs")
    return out
