import math

from pyspark.sql import functions as F

from rosterlens import JobSpec


def spec(**changes):
    values = dict(title="AI Engineer", vector=(1.0, 0.0, 0.0, 0.0), target_domains=("ai_ml",),
                  keywords=(), exp_min=0.0, exp_max=50.0, exp_ideal=0.0, cities=(),
                  countries=(), excluded=())
    return JobSpec(**{**values, **changes})


def evaluate(spark, schema, rows, column):
    """Values of ``column`` for literal rows, in row order."""
    names = [f"{i}" for i in range(len(rows))]
    df = spark.createDataFrame([(int(n), *r) for n, r in zip(names, rows)], f"_i INT, {schema}")
    return [r[1] for r in sorted(df.select("_i", column.alias("v")).collect())]


def same(got, want):
    return all(g == w or (g is not None and w is not None and isinstance(w, float)
                          and math.isclose(g, w, rel_tol=1e-12)) for g, w in zip(got, want)) \
        and len(got) == len(want)


c = F.col
