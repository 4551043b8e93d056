"""Word-list operators on news and document texts: sentiment, mentions, topics, keywords, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# This project's own word lists.
POSITIVE = """gain gains rose surge bullish growth profit rally adoption upgrade record strong doubled raised widest approved recover
 зростав зросла подвоїла залучила прибуток gestiegen stieg verdoppelt gewinn monte double hausse bénéfice subía subió duplicó recaudó ganancia""".split()
NEGATIVE = """loss losses fell crash bearish decline hack exploit ban lawsuit weak paused rejected froze lost flaw slump fear
 втратила зупинила відхилила збиток знизила verloren gesenkt abgelehnt verlust gefallen perd rejette suspend baisse perte perdió rechazó suspendió bajó pérdida""".split()
COINS = {"BTC": "btc|bitcoin", "ETH": "eth|ethereum|ether", "SOL": "sol|solana"}
TOPICS = {
    "regulation": "court|filing|claim|licence|ban|law", "security": "hack|exploit|flaw|audit|multisig", "markets": "volume|spread|range|breakout|support|resistance",
    "funding": "raised|million|fund|grant|treasury", "technology": "release|upgrade|fork|node|rollup|bridge", "trading": "traders|desk|maker|fee|withdrawals",
}
ENTITIES = "treasury|exchange|foundation|committee|court"
STOP_WORDS = "a an the and or of in on at to by for with as is was it its this that after before".split()


def tokens(text: str) -> Column:
    """Lower-case words of a text of any script, in order; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))


def _count(words: str, listed: Sequence[str]) -> Column:
    return F.size(F.filter(F.col(words), lambda w: w.isin(*listed))).cast("long")


def sentiment(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, neg, score ((pos - neg) / (pos + neg), 0 without either) and label (beyond ±0.2)."""
    rows = documents.withColumn("_w", tokens(text)).select("doc_id", _count("_w", POSITIVE).alias("pos"), _count("_w", NEGATIVE).alias("neg"))
    score = F.coalesce(F.try_divide(F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")), F.lit(0.0))
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("label", F.when(F.col("score") > 0.2, "positive").when(F.col("score") < -0.2, "negative").otherwise("neutral"))


def mentions(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, coin, n: how often each coin is named, only where it is."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = F.array(*[F.struct(F.lit(c).alias("coin"), F.size(F.regexp_extract_all(low, F.lit(rf"(\b(?:{p})\b)"), F.lit(1))).cast("long").alias("n")) for c, p in COINS.items()])
    return documents.select("doc_id", F.explode(counts).alias("m")).select("doc_id", "m.*").where("n > 0")


def named_mentions(documents: DataFrame, pattern: str = r"([\p{L}]+coin)(?![\p{L}])", text: str = "text") -> DataFrame:
    """doc_id, coin, n, is_top: names that the pattern finds in each document and how often, the one named most marked (the
    first by name among equals). Documents that name none have no row."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(1))
    counted = documents.select("doc_id", F.explode(found).alias("coin")).groupBy("doc_id", "coin").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "coin"))
    return counted.withColumn("is_top", (place == 1).cast("long"))


def topics(documents: DataFrame, text: str = "text", most: int = 3) -> DataFrame:
    """doc_id, topic, score, place: the up to three topics whose words occur most, min(1, 2 hits / words of the topic)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    each = []
    for name, pattern in TOPICS.items():
        hits = sum((F.when(low.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in pattern.split("|")), F.lit(0))
        each.append(F.struct(F.lit(name).alias("topic"), F.least(F.lit(1.0), 2.0 * hits / len(pattern.split("|"))).alias("score")))
    rows = documents.select("doc_id", F.explode(F.array(*each)).alias("t")).select("doc_id", "t.*").where("score > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "topic")).cast("long")
    return rows.withColumn("place", place).where(f"place <= {most}").withColumn("score", F.round("score", 6))


def keyword_hits(documents: DataFrame, keywords: Sequence[str], least: int, text: str = "text") -> DataFrame:
    """doc_id, hits of the documents that name the keywords at least ``least`` times."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.size(F.regexp_extract_all(low, F.lit(rf"(\b(?:{'|'.join(keywords)})\b)"), F.lit(1))).cast("long")
    return documents.select("doc_id", hits.alias("hits")).where(F.col("hits") >= least)


def importance(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, importance in 0..1 from coins named, category, entities and strength of sentiment."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    weights = {"BTC": 0.3, "ETH": 0.25, "SOL": 0.15}
    coins = sum((F.when(low.rlike(rf"\b(?:{COINS[c]})\b"), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    named = sum((F.when(low.rlike(rf"\b{w}\b"), 1.0).otherwise(0.0) for w in TOPICS["markets"].split("|")), F.lit(0.0))
    entity = F.when(low.rlike(rf"\b(?:{ENTITIES})\b"), 0.15).otherwise(0.0)
    rows = documents.withColumn("_base", coins + 0.4 * F.least(named, F.lit(3.0)) / 3 + entity).select("doc_id", "_base", F.col(text).alias("_text"))
    scored = rows.withColumn("_w", tokens("_text")).select("doc_id", "_base", _count("_w", POSITIVE).alias("p"), _count("_w", NEGATIVE).alias("n"))
    strength = F.coalesce(F.abs(F.try_divide(F.col("p") - F.col("n"), F.col("p") + F.col("n"))), F.lit(0.0))
    return scored.select("doc_id", F.round(F.least(F.lit(1.0), F.col("_base") + 0.2 * strength), 6).alias("importance"))


def cleaned_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, words, n_words: words of three letters or more that are no stop words, in order, joined by spaces."""
    kept = F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return documents.select("doc_id", F.array_join(kept, " ").alias("words"), F.size(kept).cast("long").alias("n_words"))


def topic_trends(documents: DataFrame, at: str, days: int = 30, text: str = "text") -> DataFrame:
    """topic, bucket (windows of ``days`` back from the newest document), n, mood (good less bad words over both, of all
    its documents) and its change from the window before; windows without the topic break the comparison."""
    newest = documents.agg(F.max(at).alias("_newest"))
    bucket = F.floor(F.expr(f"timestampdiff(SECOND, {at}, _newest)") / (days * 86_400))
    rows = documents.where(F.col(at).isNotNull()).crossJoin(F.broadcast(newest)).select("doc_id", bucket.alias("bucket"))
    scored = topics(documents, text).join(sentiment(documents, text).select("doc_id", "pos", "neg"), "doc_id").join(rows, "doc_id")
    mood = F.coalesce(F.try_divide(F.sum(F.col("pos") - F.col("neg")), F.sum(F.col("pos") + F.col("neg"))), F.lit(0.0))
    each = scored.groupBy("topic", "bucket").agg(F.count("*").alias("n"), mood.alias("mood"))
    order = Window.partitionBy("topic").orderBy(F.desc("bucket"))
    change = F.when(F.lag("bucket").over(order) == F.col("bucket") + 1, F.col("mood") - F.lag("mood").over(order))
    return each.select("topic", "bucket", "n", F.round("mood", 6).alias("mood"), F.round(change, 4).alias("mood_change"))


def cosine(vectors: DataFrame, probe: str = "probe") -> DataFrame:
    """vec_id, probe_id, cosine of every vector to the probe rows (ids divisible by 100): a stated query set against all."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    probes = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("p"))
    both = vectors.crossJoin(probes)
    value = F.try_divide(dot("embedding", "p"), F.nullif(F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("p", "p")), F.lit(0.0)))
    return both.select("vec_id", "probe_id", F.round(value, 5).alias("cosine"))


def enriched(documents: DataFrame) -> DataFrame:
    """doc_id, score, label, importance, topic (the likeliest, null without any), coin (named most, null without any): the whole
    analysis of each document. Every step keeps one row a document, so all join on doc_id alone."""
    found = sentiment(documents).select("doc_id", "score", "label").join(importance(documents), "doc_id")
    best = topics(documents).where("place = 1").select("doc_id", "topic")
    coin = named_mentions(documents).where("is_top = 1").select("doc_id", "coin")
    return found.join(best, "doc_id", "left").join(coin, "doc_id", "left")
