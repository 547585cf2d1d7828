"""K5-K9: column typing and encoders (fit on train only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = {"int", "bigint", "double", "float", "smallint", "tinyint", "decimal"}


def column_types(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """K5: (numeric columns, categorical columns) from the schema."""
    num, cat = [], []
    for c, t in df.dtypes:
        if c in exclude:
            continue
        (num if t.split("(")[0] in NUMERIC else cat).append(c)
    return num, cat


def ordinal_fit(train: DataFrame, cols: Sequence[str]):
    """K6: one StringIndexer per column, levels sorted ascending."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep") for c in cols]
    return Pipeline(stages=stages).fit(train)


def ordinal_apply(model, df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Unseen (and null) levels -> -1: the indexer's extra 'keep' slot equals
    the number of levels; map it to -1."""
    out = model.transform(df)
    for st, c in zip(model.stages, cols):
        n = len(st.labels)
        out = out.withColumn(f"{c}{suffix}", F.when(F.col(f"{c}__idx") >= n, F.lit(-1))
                             .otherwise(F.col(f"{c}__idx").cast("int"))).drop(f"{c}__idx")
    return out


def onehot_scale_fit(train: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], out: str = "features"):
    """K7: z-scores of the numerics (population deviation; a constant column is only
    centred) and one-hot of the categoricals with the alphabetically first level
    dropped; levels unseen in ``train`` and nulls give all zeros.

    Returns (fitted pipeline, names): the pipeline holds Spark's own stages only, so it
    can be saved, and names are the plain numeric names and "<column>_<level>" in the
    order of the vector."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
    stages, parts, names = [], [], []
    if num_cols:
        row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num_cols)],
                        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
        z = [f"(CAST(`{c}` AS DOUBLE) - CAST('{row[f'm{i}']!r}' AS DOUBLE)) / CAST('{row[f's{i}'] or 1.0!r}' AS DOUBLE) AS `__z_{c}`"
             for i, c in enumerate(num_cols)]
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(z) + " FROM __THIS__"))
        parts += [f"__z_{c}" for c in num_cols]
        names += list(num_cols)
    for c in cat_cols:
        indexer = StringIndexer(inputCol=c, outputCol=f"__i_{c}", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
        # the last slot is the one of unseen levels: dropping it leaves them all zeros
        encoder = OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", dropLast=True).fit(indexer.transform(train))
        stages += [indexer, encoder]
        if len(indexer.labels) > 1:
            stages.append(VectorSlicer(inputCol=f"__o_{c}", outputCol=f"__d_{c}", indices=list(range(1, len(indexer.labels)))))
            parts.append(f"__d_{c}")
            names += [f"{c}_{level}" for level in indexer.labels[1:]]
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return PipelineModel(stages=stages), names


def target_encode_fit(train: DataFrame, cols: Sequence[str], target: str, smoothing: float = 0.0) -> dict:
    """K8: per level mean of the target on train (optionally smoothed towards
    the global mean with weight ``smoothing``).  Returns per-column level tables
    (small: one row per level) and the global mean (a scalar)."""
    gm = train.agg(F.avg(target)).first()[0]
    tables = {}
    for c in cols:
        t = train.groupBy(c).agg(F.count(F.lit(1)).alias("__n"), F.avg(target).alias("__m"))
        enc = (F.col("__n") * F.col("__m") + F.lit(smoothing) * F.lit(gm)) / (F.col("__n") + F.lit(smoothing))
        tables[c] = t.select(c, enc.alias(f"{c}_te"))
    return {"tables": tables, "global_mean": gm}


def target_encode_apply(fit: dict, df: DataFrame) -> DataFrame:
    """Join the level tables (AQE broadcasts them when measured small); unseen
    levels get the global train mean."""
    out = df
    for c, t in fit["tables"].items():
        out = out.join(t, c, "left").withColumn(f"{c}_te", F.coalesce(F.col(f"{c}_te"), F.lit(fit["global_mean"])))
    return out


def robust_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """K9: (x - median) / IQR with exact quantiles of the fitting frame."""
    from acreage.operators.ordered import quantiles
    src = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        q = quantiles(src, c, [0.25, 0.5, 0.75], names=["__q1", "__med", "__q3"])
        from acreage.operators.scalars import attach_row
        out = attach_row(out, q)
        iqr = F.col("__q3") - F.col("__q1")
        out = out.withColumn(c, (F.col(c) - F.col("__med")) / F.when(iqr != 0, iqr).otherwise(F.lit(1.0))).drop(
            "__q1", "__med", "__q3")
    return out
