"""Baselines on pyspark.ml: TF-IDF with logistic regression, vocabulary scorer, linear probe, neighbours."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusmill.functions.text import casefold, tokens
from corpusmill.operators.terms import Runs, row_weights, vocabulary
from corpusmill.session import new_folder


def char_ngrams(text: str | Column, low: int = 3, high: int = 5) -> Runs:
    """All runs of low to high characters."""
    return Runs(casefold(text), tuple(range(low, high + 1)))


def word_ngrams(text: str | Column) -> Runs:
    """Words of two characters and more, and pairs of neighbours."""
    return Runs(F.filter(tokens(text), lambda x: F.length(x) >= 2), (1, 2))


def tfidf_vectors(train: DataFrame, rows: DataFrame, id_col: str, grams: Runs | Column, min_df: int = 3, most: int = 200_000) -> DataFrame:
    """(id, features): sublinear TF times smoothed IDF, length one, written to the shared folder.

    The vocabulary, the `most` terms that occur most often in train (a parameter of the model), and the IDF come from train.
    An array column holds its terms as they are.
    """
    grams = grams if isinstance(grams, Runs) else Runs(grams, (1,))
    v = vocabulary(train, grams, min_df, most, in_order=True)
    # the fields that a sparse vector is stored as; read back, the column is one
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(len(v)).alias("size"), F.col("at").alias("indices"), F.col("w").alias("values"))
    path = new_folder(rows.sparkSession, "tfidf")
    row_weights(rows, id_col, grams, v).select(id_col, parts.alias("features")).write.parquet(path)
    schema = StructType([rows.schema[id_col], StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def logistic(train: DataFrame, c: float = 4.0, rounds: int = 100):
    """L2 logistic regression with inverse strength c, on (features, label)."""
    return LogisticRegression(regParam=1.0 / (c * max(1, train.count())), elasticNetParam=0.0, standardization=False, maxIter=rounds).fit(train)


def positive_score(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def vocabulary_scores(df: DataFrame, id_col: str, terms: Column, weights: DataFrame) -> DataFrame:
    """(id, cluster, logodds): summed weights of known terms per cluster, against the log-sum-exp of the other clusters."""
    long = df.select(id_col, F.explode(terms).alias("term")).join(F.broadcast(weights), "term").groupBy(id_col, "cluster").agg(F.sum("weight").alias("s"))
    clusters = weights.select("cluster").distinct()
    full = df.select(id_col).crossJoin(F.broadcast(clusters)).join(long, [id_col, "cluster"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))  # a few clusters
    w = Window.partitionBy(id_col)
    full = full.withColumn("__top", F.max("s").over(w)).withColumn("__all", F.sum(F.exp(F.col("s") - F.col("__top"))).over(w))
    rest = F.ln(F.greatest(F.col("__all") - F.exp(F.col("s") - F.col("__top")), F.lit(1e-300))) + F.col("__top")
    return full.select(id_col, "cluster", (F.col("s") - rest).alias("logodds"))


def standardise(df: DataFrame, vec: str, train: Column, clip: float = 5.0) -> DataFrame:
    """df with vec as (x - mean) / (sd + 1e-4), clipped; mean and population deviation of each dimension over the training rows."""
    long = df.filter(train).select(F.posexplode(vec).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("__stats"))  # a row, with an entry for each dimension
    z = F.zip_with(vec, "__stats", lambda x, t: F.greatest(F.least((x - t["m"]) / (t["s"] + 1e-4), F.lit(clip)), F.lit(-clip)))
    return df.crossJoin(F.broadcast(packed)).withColumn(vec, z).drop("__stats")


def probe(df: DataFrame, vec: str, label: str, train: Column, rounds: int = 60) -> DataFrame:
    """df plus the label predicted by a class-balanced multinomial model fitted on the training rows."""
    d = standardise(df, vec, train).withColumn("features", array_to_vector(vec)).withColumn("y", F.col(label).cast("double"))
    fit = d.filter(train)
    n = fit.agg(F.count("*").alias("__n"), F.count_distinct("y").alias("__k"))
    weights = fit.groupBy("y").agg(F.count("*").alias("__c")).crossJoin(F.broadcast(n)).select("y", (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("w"))
    model = LogisticRegression(labelCol="y", weightCol="w", family="multinomial", maxIter=rounds, regParam=0.01).fit(fit.join(F.broadcast(weights), "y"))
    return model.transform(d).withColumn("predicted", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", "features")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)
