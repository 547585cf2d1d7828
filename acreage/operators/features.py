"""Feature construction (inventory 2.G).

Amenity lists are kept *long* (one row per listing x amenity) — never a wide
multi-hot matrix whose width grows with the vocabulary.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.operators.ordered import plan_splitters, with_bucket


def tag_union(frames: dict[str, DataFrame], tag_col: str = "property_type") -> DataFrame:
    """G1/H5: literal type tag per input, union by name (missing columns null).
    The reference's shuffle of the union is a no-op for a set: not done."""
    out = None
    for tag, df in frames.items():
        d = df.withColumn(tag_col, F.lit(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def long_amenities(df: DataFrame, key: str, arr: str, out: str = "amenity") -> DataFrame:
    """G2 (long form): one row per (key, distinct amenity)."""
    return df.select(key, F.explode(F.array_distinct(F.col(arr))).alias(out)).where(F.col(out).isNotNull())


def multi_hot(df: DataFrame, arr: str, out: str = "features", vocab_size: int = 1 << 18):
    """G2 (vector form): binary CountVectorizer; returns (model, transformed)."""
    from pyspark.ml.feature import CountVectorizer
    cv = CountVectorizer(inputCol=arr, outputCol=out, binary=True, vocabSize=vocab_size, minDF=1.0)
    m = cv.fit(df)
    return m, m.transform(df)


def values_at(counts: DataFrame, value: str, cum: str, weight: str, positions: DataFrame, at: str, by: str) -> DataFrame:
    """``positions`` plus the value at each 0-based position of the ordered multiset
    ``counts`` (value, weight, inclusive running total) of the same ``by``.  An as-of lookup: both
    sides are read in order, so no key joins many positions with many values."""
    side = counts.select(by, F.col(value).alias("_v"), (F.col(cum) - F.col(weight)).cast("long").alias("_pos"),
                         F.lit(None).cast(positions.select(F.struct("*")).schema[0].dataType).alias("_q"))
    ask = positions.select(by, F.lit(None).cast(side.schema["_v"].dataType).alias("_v"), F.col(at).cast("long").alias("_pos"),
                           F.struct(*positions.columns).alias("_q"))
    inside = Window.partitionBy(by).orderBy("_pos", F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = side.unionByName(ask).withColumn(value, F.last("_v", True).over(inside)).where(F.col("_q").isNotNull())
    return found.select("_q.*", value)


def _median_asks(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets that hold the middle ranks of every amenity's values and of the values of all other rows, and
    the middle ranks counted from the bucket's start: two tables (amenity, _b, _r) of one or two rows an amenity.

    ``sizes`` is (amenity, _b, _n), the rows of each bucket of values, in order; the rows of no amenity are all rows.
    These totals (one for each bucket) are a literal, so an amenity needs no row for a bucket it does not occur in."""
    totals = sorted((r["_b"], r["_n"]) for r in sizes.where(F.col("amenity").isNull() & F.col("_b").isNotNull()).collect())
    buckets, cums = [b for b, _ in totals], list(itertools.accumulate(n for _, n in totals))
    at, ends = F.array(*[F.lit(b) for b in buckets]).cast("array<double>"), F.array(*[F.lit(n) for n in cums]).cast("array<long>")
    before = F.array(F.lit(0), *[F.lit(n) for n in cums]).cast("array<long>")
    whole = Window.partitionBy("amenity")
    own = (sizes.where(F.col("amenity").isNotNull() & F.col("_b").isNotNull())
           .withColumn("_c", F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("_in", F.sum("_n").over(whole)).withColumn("_h", F.get(ends, (F.array_position(at, F.col("_b")) - 1).cast("int"))))
    middle = lambda n: F.explode(F.array_distinct(F.array(F.floor((n - 1) / 2), F.ceil((n - 1) / 2))))
    start = F.col("_c") - F.col("_n")
    present = (own.select("*", middle(F.col("_in")).alias("_r")).where((F.col("_r") >= start) & (F.col("_r") < F.col("_c")))
               .select("amenity", "_b", (F.col("_r") - start).alias("_r")))
    others = F.lit(cums[-1] if cums else 0) - F.col("_in")
    absent = (own.where(others > 0).select("amenity", "_c", "_h", middle(others).alias("_r")).groupBy("amenity", "_r")
              .agg((F.col("_r") + F.coalesce(F.max(F.when(F.col("_h") - F.col("_c") <= F.col("_r"), F.col("_c"))), F.lit(0))).alias("_at"))
              .withColumn("_i", F.size(F.filter(ends, lambda x: x <= F.col("_at")))))
    return present, absent.select("amenity", F.get(at, F.col("_i")).alias("_b"), (F.col("_at") - F.get(before, F.col("_i"))).alias("_r"))


def _medians(cum: DataFrame, value: str, present: DataFrame, absent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Medians of ``value`` over each amenity's rows, and over all other rows without materialising them.

    ``cum`` (amenity, _b, value, _n, _c) has the running counts within the asked buckets, of all rows where the
    amenity is null.  With H the running count of all rows and P that of the amenity's rows, the complement has
    H(v) - P(v) rows up to a value v of the amenity.  For a rank r let P* be the amenity's rows up to its last value
    with H - P <= r: then the complement's value of rank r is the value of all rows at position r + P*.  H meets P by
    an equality join on the value."""
    own, every = cum.where(F.col("amenity").isNotNull()), cum.where(F.col("amenity").isNull()).drop("amenity")
    hit = own.join(present, ["amenity", "_b"]).where((F.col("_r") >= F.col("_c") - F.col("_n")) & (F.col("_r") < F.col("_c")))
    middle = lambda d, name: d.groupBy("amenity").agg(((F.min(value) + F.max(value)) / 2).cast("double").alias(name))
    steps = own.select("amenity", "_b", value, "_c").join(every.select("_b", value, F.col("_c").alias("_h")), ["_b", value])
    upto = F.coalesce(F.max(F.when(F.col("_h") - F.col("_c") <= F.col("_r"), F.col("_c"))), F.lit(0))
    ask = absent.join(steps, ["amenity", "_b"], "left").groupBy("amenity", "_b", "_r").agg((F.col("_r") + upto).alias("_at"))
    found = values_at(every, value, "_c", "_n", ask.select("amenity", "_b", "_at"), "_at", "_b")
    return middle(hit, "median_present"), middle(found, "median_absent")


def amenity_weights(df: DataFrame, key: str, arr: str, rate: str, min_count: int = 30) -> DataFrame:
    """For each amenity present in more than ``min_count`` rows,
    premium = max(median rate with it - median rate without it, 0), else 0;
    weights are divided by the largest premium when it is positive.  Null
    rates are skipped by both medians.  Returns (amenity, n_present,
    median_present, median_absent, premium, weight).

    The rates and amenities of all rows are stored once.  Rows are counted by (amenity, bucket of rates), which is
    added up before the shuffle; only the rows of the buckets that hold a middle rank are put in order."""
    from acreage.session import cut_lineage, discard, store
    base, path = store(df.select(F.col(rate).alias("__rate"), F.array_compact(F.array_distinct(F.col(arr))).alias("__has")), "rates")
    inner = [x for x in plan_splitters(base, "__rate") if not math.isinf(x)]
    base = with_bucket(base, "__rate", inner).withColumn("_b", F.when(F.col("__rate").isNotNull(), F.col("_b")))
    none = F.lit(None).cast(base.schema["__has"].dataType.elementType)
    rows = base.select("_b", "__rate", F.explode(F.concat(F.array(none), F.coalesce("__has", F.array().cast(base.schema["__has"].dataType)))).alias("amenity"))
    sizes = cut_lineage(rows.groupBy("amenity", "_b").agg(F.count(F.lit(1)).alias("_n")))
    n_pres = sizes.where(F.col("amenity").isNotNull()).groupBy("amenity").agg(F.sum("_n").alias("n_present"))
    present, absent = (cut_lineage(x) for x in _median_asks(sizes))
    asked = present.select("amenity", "_b").unionByName(absent.select("amenity", "_b")).distinct()
    near = rows.where(F.col("_b").isin([r["_b"] for r in asked.select("_b").distinct().collect()]))
    near = near.where(F.col("amenity").isNull()).unionByName(near.join(asked, ["amenity", "_b"], "left_semi"))
    counts = cut_lineage(near.groupBy("amenity", "_b", "__rate").agg(F.count(F.lit(1)).alias("_n")))
    discard(df.sparkSession, path)
    upto = Window.partitionBy("amenity", "_b").orderBy("__rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    med_p, med_a = _medians(counts.withColumn("_c", F.sum("_n").over(upto)), "__rate", present, absent)
    t = n_pres.join(med_p, "amenity", "left").join(med_a, "amenity", "left")
    prem = F.when(F.col("n_present") > min_count,
                  F.greatest(F.col("median_present") - F.col("median_absent"), F.lit(0.0))).otherwise(F.lit(0.0))
    t = cut_lineage(t.withColumn("premium", F.coalesce(prem, F.lit(0.0))))
    # largest premium: a one-row aggregate attached as a scalar subquery (the amenity
    # vocabulary can be large, so no global window)
    from acreage.operators.scalars import attach_row
    t = attach_row(t, t.agg(F.max("premium").alias("__mx")))
    return t.withColumn("weight", F.when(F.col("__mx") > 0, F.col("premium") / F.col("__mx"))
                        .otherwise(F.col("premium"))).drop("__mx")


def luxury_score(df: DataFrame, key: str, arr: str, weights: DataFrame, out: str = "luxury_score") -> DataFrame:
    """log1p of the summed weights of the row's (distinct) amenities; no
    amenities -> 0.  Returns (key, score)."""
    lng = long_amenities(df, key, arr)
    s = lng.join(weights.select("amenity", "weight"), "amenity", "left").groupBy(key).agg(
        F.sum(F.coalesce(F.col("weight"), F.lit(0.0))).alias("__s"))
    keys = df.select(key).distinct()
    return keys.join(s, key, "left").select(key, F.log1p(F.coalesce(F.col("__s"), F.lit(0.0))).alias(out))


def rarity_score(df: DataFrame, key: str, arr: str, out: str = "rarity_score") -> DataFrame:
    """G5 (older variant): sum of 1/document-frequency of the row's amenities,
    min-max scaled over rows (constant -> 0)."""
    lng = long_amenities(df, key, arr)
    dfreq = lng.groupBy("amenity").agg(F.count(F.lit(1)).alias("__df"))
    s = lng.join(dfreq, "amenity").groupBy(key).agg(F.sum(1.0 / F.col("__df")).alias("__s"))
    s = df.select(key).distinct().join(s, key, "left").fillna(0.0, ["__s"])
    mm = s.agg(F.min("__s").alias("__mn"), F.max("__s").alias("__mx"))
    from acreage.operators.scalars import attach_row
    j = attach_row(s, mm)
    return j.select(key, F.when(F.col("__mx") > F.col("__mn"),
                                (F.col("__s") - F.col("__mn")) / (F.col("__mx") - F.col("__mn")))
                    .otherwise(F.lit(0.0)).alias(out))


# ---- G6/G7 furnishing clusters ----------------------------------------------

FURNISH_LABELS = ["Furnished", "Semi-Furnished", "Unfurnished"]


class FurnishClusters:
    """Item counts -> z-score (with mean) -> KMeans(k) -> clusters ranked
    by the sum of their centroid -> labels; rows without details get the last
    label.  ``fit`` returns a fitted object whose ``transform`` is lazy; the
    Spark ``PipelineModel`` is saved/loaded with ``save``/``load``."""

    def __init__(self, items: Sequence[str], k: int = 3, seed: int = 42, labels: Sequence[str] = FURNISH_LABELS):
        self.items, self.k, self.seed, self.labels = list(items), k, seed, list(labels)
        self.model = None
        self.label_of = None

    def _pipeline(self):
        from pyspark.ml import Pipeline
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import StandardScaler, VectorAssembler
        return Pipeline(stages=[
            VectorAssembler(inputCols=self.items, outputCol="__raw", handleInvalid="keep"),
            StandardScaler(inputCol="__raw", outputCol="__z", withMean=True, withStd=True),
            KMeans(featuresCol="__z", predictionCol="furnish_cluster", k=self.k, seed=self.seed),
        ])

    def fit(self, df: DataFrame, known: str = "known") -> FurnishClusters:
        # KMeans iterates over its input: persist the 18 small count columns
        # (not the whole table) for the fit, then release them.
        from pyspark import StorageLevel
        x = df.where(F.col(known)).select(*self.items).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.model = self._pipeline().fit(x)
        finally:
            x.unpersist()
        self._labels_from_centers()
        return self

    def _labels_from_centers(self):
        # clusters ranked by the sum of their centroid coordinates in the
        # standardised space the model was fitted in (most items first)
        centers = self.model.stages[-1].clusterCenters()
        totals = [float(sum(c)) for c in centers]
        order = sorted(range(len(centers)), key=lambda i: -totals[i])
        self.label_of = {cid: self.labels[min(r, len(self.labels) - 1)] for r, cid in enumerate(order)}

    def transform(self, df: DataFrame, known: str = "known", out: str = "furnishing_type") -> DataFrame:
        m = F.create_map(*[x for cid, lb in self.label_of.items() for x in (F.lit(cid), F.lit(lb))])
        k = self.model.transform(df.where(F.col(known))).withColumn(out, m[F.col("furnish_cluster")])
        u = df.where(~F.col(known)).withColumn("furnish_cluster", F.lit(None).cast("int")).withColumn(
            out, F.lit(self.labels[-1]))
        return k.drop("__raw", "__z").unionByName(u)

    def save(self, path: str):
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, items: Sequence[str], labels: Sequence[str] = FURNISH_LABELS) -> FurnishClusters:
        from pyspark.ml import PipelineModel
        obj = cls(items, labels=labels)
        obj.model = PipelineModel.load(path)
        obj.k = len(obj.model.stages[-1].clusterCenters())
        obj._labels_from_centers()
        return obj


def cluster_diagnostics(df: DataFrame, features: str, ks: Sequence[int], seed: int = 42, inits: int = 1) -> DataFrame:
    """Silhouette (k >= 2) and within-cluster cost per k, of the cheapest of ``inits`` starts.  The cost of
    one cluster is the sum of squared deviations from the mean (one aggregate)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = []
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="__pred")
    for k in ks:
        if k == 1:
            whole = df.select(Summarizer.metrics("variance", "count").summary(F.col(features)).alias("s"))
            cost = whole.select(F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v) * (F.col("s.count") - 1)).first()[0]
            rows.append((1, float(cost), None))
            continue
        fits = [KMeans(featuresCol=features, predictionCol="__pred", k=k, seed=seed + i).fit(df) for i in range(inits)]
        m = min(fits, key=lambda x: x.summary.trainingCost)
        rows.append((int(k), float(m.summary.trainingCost), float(ev.evaluate(m.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
