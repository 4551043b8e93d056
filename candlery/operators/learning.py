"""Topic models, clusterings, validation and importance of features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlery.operators.news import STOP_WORDS, cleaned_words, importance
from candlery.operators.trend import price_levels  # noqa: F401  levels were here first


def topic_model(documents: DataFrame, k: int = 6, vocabulary: int = 5_000, rounds: int = 10, seed: int = 42) -> DataFrame:
    """doc_id, topic (the likeliest) and weight by latent Dirichlet allocation on TF-IDF words of three documents or more."""
    words = cleaned_words(documents).where("n_words > 0").select("doc_id", F.split("words", " ").alias("ws"))
    counted = CountVectorizer(inputCol="ws", outputCol="tf", vocabSize=vocabulary, minDF=3).fit(words).transform(words)
    weighted = IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted)
    model = LDA(k=k, maxIter=rounds, seed=seed, featuresCol="features").fit(weighted)
    share = vector_to_array("topicDistribution")
    return model.transform(weighted).select("doc_id", (F.array_position(share, F.array_max(share)) - 1).alias("topic"), F.round(F.array_max(share), 6).alias("weight"))


def embedding_clusters(vectors: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """vec_id, cluster, distance to the centre, and the silhouette of the whole clustering."""
    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
    found = model.transform(rows)
    quality = ClusteringEvaluator(predictionCol="cluster").evaluate(found)
    centres = F.lit([[float(v) for v in c] for c in model.clusterCenters()])
    square = F.aggregate(F.zip_with(vector_to_array("features"), F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", "cluster", F.sqrt(square).alias("distance"), F.lit(float(quality)).alias("silhouette"))


def similar_word_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of all pairs of sets of one group whose words have at least this Jaccard similarity, a the earlier by ``at``.

    sets: id, grp, at (orderable, distinct within a group), ws. Exact: two such sets share one of the words that are rarest
    in the group, among the first n - ceil(similarity * n) + 1 of each (prefix filter).
    """
    each = sets.select("id", "grp", F.explode("ws").alias("w"))
    counts = each.groupBy("grp", "w").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(counts, ["grp", "w"]).groupBy("id", "grp").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("rare"))
    n = F.size("ws")
    # words of this set alone come first in its order and match nothing
    room = n - F.ceil(F.lit(similarity) * n - 1e-9) + 1 - (n - F.size("rare"))
    rows = sets.join(ranked, ["id", "grp"]).withColumn("room", room.cast("int")).where("room > 0")
    keys = rows.select("id", "grp", "at", n.alias("n"), F.explode(F.slice("rare", 1, F.col("room"))).alias("k")).select("id", "grp", "at", "n", "k.w")
    l, r = keys.alias("l"), keys.alias("r")
    met = (F.col("l.grp") == F.col("r.grp")) & (F.col("l.w") == F.col("r.w")) & (F.col("l.at") < F.col("r.at"))
    near = (F.col("l.n") >= similarity * F.col("r.n")) & (F.col("r.n") >= similarity * F.col("l.n"))
    pairs = l.join(r, met & near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(s), F.col("ws").alias(f"ws_{s}")), s)
    shared = F.size(F.array_intersect("ws_a", "ws_b"))
    return pairs.where(shared >= similarity * (F.size("ws_a") + F.size("ws_b") - shared)).select("a", "b")


def greedy_followers(pairs: DataFrame) -> DataFrame:
    """id of the sets that aren't the first of a cluster: those similar to an earlier first one. Settled in rounds over
    the pairs, each cut off by a checkpoint: whoever has no earlier neighbour left is first, and its neighbours follow."""
    left, followers = pairs, None
    while not left.isEmpty():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        found = left.join(first, "a").select(F.col("b").alias("id")).distinct().checkpoint()
        left = left.join(found.withColumnRenamed("id", "b"), "b", "left_anti").join(found.withColumnRenamed("id", "a"), "a", "left_anti").checkpoint()
        followers = found if followers is None else followers.union(found)
    return pairs.select(F.col("a").alias("id")).limit(0) if followers is None else followers


def news_clusters(items: DataFrame, hours: int = 24, similarity: float = 0.5, most: int = 2_000) -> DataFrame:
    """doc_id, window_start, part, cluster, representative: greedy clusters by shared words within windows of time and language.

    In order of publication each item joins the first cluster of its window whose first item is similar enough; items
    without words stay alone. Copies (equal sets of words) collapse before anything is compared, and no task holds a
    window. part only spreads the rows of a window with more than ``most`` items; clusters go across parts.
    representative is the most important item of the cluster, the earliest of equals.
    """
    timed = items.where(F.col("published_at").isNotNull() & F.col("doc_id").isNotNull())
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))
    kept = F.filter(found, lambda w: ((F.length(w) > 2) | ~w.rlike("^[a-z]+$")) & ~w.isin(*STOP_WORDS))
    slots = timed.select("doc_id", "published_at", F.window("published_at", f"{hours} hours").start.alias("window_start"), F.coalesce("lang", F.lit("")).alias("lang"), F.array_sort(F.array_distinct(kept)).alias("ws"))
    key = ["window_start", "lang"]
    alone = F.when(F.size("ws") == 0, F.col("doc_id"))
    slots = slots.withColumns({"grp": F.xxhash64(*key), "id": F.xxhash64(*key, "ws", alone)}).checkpoint()
    sets = slots.groupBy("id", "grp", *key).agg(F.min(F.struct("published_at", "doc_id")).alias("at"), F.first("ws").alias("ws")).checkpoint()
    pairs = similar_word_sets(sets.where(F.size("ws") > 0), similarity).checkpoint()
    followers = greedy_followers(pairs)
    heads = sets.join(followers, "id", "left_anti")
    numbers = heads.select("id", "at", (F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1).cast("long").alias("cluster"))
    own = pairs.join(numbers.withColumnRenamed("id", "a"), "a").join(followers.withColumnRenamed("id", "b"), "b").groupBy(F.col("b").alias("id")).agg(F.min("cluster").alias("cluster"))
    labels = numbers.select("id", "cluster").union(own)
    sizes = slots.groupBy(*key).agg(F.ceil(F.count("*") / most).alias("parts"))
    placed = slots.drop("ws").join(labels, "id").join(sizes, key).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    weights = importance(timed).groupBy("doc_id").agg(F.max("importance").alias("importance"))
    best = placed.join(weights, "doc_id").groupBy(*key, "cluster").agg(F.min(F.struct(-F.col("importance"), "published_at", "doc_id"))["doc_id"].alias("representative"))
    return placed.join(best, [*key, "cluster"]).select("doc_id", "window_start", "part", "cluster", "representative")


def tuned_regression(features: DataFrame, columns: Sequence[str], label: str, folds: int = 3) -> DataFrame:
    """reg, mix, rmse of each point of a grid, by validation along time; the best first.

    Time is cut into folds + 1 stretches with equally many rows; each but the first is predicted by a model of all before it.
    """
    rows = features.dropna(subset=[*columns, label])
    cuts = rows.agg(F.percentile(F.unix_micros(F.col("open_time").cast("timestamp")), F.lit([k / (folds + 1) for k in range(1, folds + 1)])).alias("c")).first()["c"] or []
    at = F.unix_micros(F.col("open_time").cast("timestamp"))
    stretch = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    packed = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).select("features", F.col(label).alias("label"), stretch.alias("stretch")).persist()
    scores = []
    for reg in (0.0, 0.01, 0.1):
        for mix in (0.0, 0.5):
            errors = []
            for k in range(1, folds + 1):
                model = LinearRegression(regParam=reg, elasticNetParam=mix).fit(packed.where(F.col("stretch") < k))
                errors.append(RegressionEvaluator(metricName="rmse").evaluate(model.transform(packed.where(F.col("stretch") == k))))
            scores.append((reg, mix, float(np.mean(errors))))
    packed.unpersist()
    return features.sparkSession.createDataFrame(scores, "reg double, mix double, rmse double").orderBy("rmse", "reg", "mix")


def permutation_importance(features: DataFrame, columns: Sequence[str], label: str, share: float = 0.8) -> DataFrame:
    """feature, rise in squared error of a linear model when the feature's values are shuffled among the rows of a symbol.

    The model is fitted on the first ``share`` of each symbol's time and tried on the rest. Shuffled by a fixed hash order, so
    the result is the same in every run.
    """
    known = features.dropna(subset=[*columns, label])
    place = F.percent_rank().over(Window.partitionBy("symbol").orderBy("open_time"))
    known = known.withColumn("_place", place)
    pack = VectorAssembler(inputCols=list(columns), outputCol="features")
    model = LinearRegression(labelCol=label).fit(pack.transform(known.where(F.col("_place") < share)))
    rows = known.where(F.col("_place") >= share)
    mse = F.avg((F.col(label) - F.col("prediction")) ** 2)
    base = model.transform(pack.transform(rows)).agg(mse.alias("base"))
    out = None
    for c in columns:
        order = Window.partitionBy("symbol").orderBy(F.xxhash64("open_time"))
        line = Window.partitionBy("symbol").orderBy("open_time")
        donors = rows.select("symbol", F.row_number().over(order).alias("rn"), F.col(c).alias("shuffled"))
        mixed = rows.withColumn("rn", F.row_number().over(line)).join(donors, ["symbol", "rn"]).withColumn(c, F.col("shuffled"))
        one = model.transform(pack.transform(mixed)).agg(mse.alias("mse")).crossJoin(base).select(F.lit(c).alias("feature"), (F.col("mse") - F.col("base")).alias("importance"))
        out = one if out is None else out.union(one)
    return out
