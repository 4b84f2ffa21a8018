"""Long-term memory: items searched for phrases and prefixes with bm25 ranking; look-ups by metadata.

Searches are a table: the runs of words of all items are joined with the phrases of all searches, a last word that is a
prefix by its first characters. Runs that no search asks for go before anything is shuffled or written.

Defined cases: null texts have no tokens and match nothing, but count among the items; a phrase without tokens is passed
over, a search without phrases finds nothing; ties go to the smaller id; ids are taken to be unique; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import scratch
from quire.operators.retrieval import _top

#: Fixed values of the ranking function, and the least weight of a phrase that most items have.
K1, B, LEAST_WEIGHT = 1.2, 0.75, 1e-6


def words(x: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrases(searches: DataFrame) -> DataFrame:
    """(search_id, said, n, k) of searches (search_id, phrases: array of texts): the words of each phrase joined by a space, how many they
    are, and the length of the last one where a phrase that ends in * ends in a prefix, else -1. Phrases without words go.
    """
    each = searches.select("search_id", F.explode("phrases").alias("phrase"))
    parts = each.select("search_id", F.trim("phrase").endswith("*").alias("open"), words("phrase").alias("w")).where(F.size("w") > 0)
    k = F.when(F.col("open"), F.length(F.element_at("w", -1))).otherwise(-1)
    return parts.select("search_id", F.array_join("w", " ").alias("said"), F.size("w").alias("n"), k.alias("k"))


def _said(items: DataFrame, n: int, k: int) -> DataFrame:
    """(item_id, size, said): each run of ``n`` words of the items, the last one cut to ``k`` characters if ``k`` is not negative."""

    def runs(w: Column) -> Column:
        # words have no spaces, so joined runs are equal only where their words are
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        return F.when(F.size(w) >= n, F.transform(places, lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + j) for j in range(n - 1))).alias("head"), F.get(w, i + n - 1).alias("last"))))

    # the words are a value of their own: taken anew for each place, they would cost the square of a text
    made = F.get(F.transform(F.array(words("text")), lambda w: F.struct(F.size(w).alias("size"), (w if n == 1 else runs(w)).alias("runs"))), 0)
    each = items.select("item_id", made.alias("made")).select("item_id", "made.size", F.explode("made.runs").alias("run"))
    head, last = (F.lit(""), F.col("run")) if n == 1 else (F.concat("run.head", F.lit(" ")), F.col("run.last"))
    if k >= 0:
        each, last = each.where(F.length(last) >= k), F.substring(last, 1, k)
    return each.select("item_id", "size", F.concat(head, last).alias("said"))


def phrase_hits(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(phrase, item_id, size, tf) of wanted (phrase, said, n, k): in which items each phrase occurs, how many words these have, and how often it does.

    Runs of words are looked up in the scan's stage where the phrases are few enough to be sent there, so only those that are
    asked for are shuffled, once for each task and item.
    """
    shapes = wanted.select("n", "k").distinct().orderBy("n", "k").collect()  # a few numbers, none above the longest phrase or word
    found = [_said(items, x.n, x.k).join(wanted.where((F.col("n") == x.n) & (F.col("k") == x.k)).select("phrase", "said"), "said").select("phrase", "item_id", "size") for x in shapes]
    if not found:
        return wanted.crossJoin(items.select("item_id").limit(0)).select("phrase", "item_id", F.lit(0).alias("size"), F.lit(0).cast("long").alias("tf"))
    return reduce(DataFrame.unionByName, found).groupBy("phrase", "item_id", "size").agg(F.count(F.lit(1)).alias("tf"))


def search(items: DataFrame, searches: DataFrame, k: int = 5) -> DataFrame:
    """(search_id, rank, item_id, score): the items that have all phrases of a search, best bm25 first, at most ``k``.

    Phrases said twice count twice. Token counts of items are taken over all of them, and so are phrases' weights. A phrase
    that several searches have is looked up once; a search's items are those of its rarest phrase that have the others too.
    """
    asked = phrases(searches).groupBy("search_id", "said", "n", "k").agg(F.count(F.lit(1)).alias("times"))
    wanted = scratch.materialize(asked.select("said", "n", "k").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    asked = asked.join(wanted, ["said", "n", "k"]).select("search_id", "phrase", "times")
    hits = scratch.materialize(phrase_hits(items, wanted), "phrase-hits")
    all_items = items.select(F.size(words("text")).alias("size")).agg(F.count(F.lit(1)).alias("items"), F.avg("size").alias("mean"))  # one row
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    each = scratch.materialize(asked.join(df, "phrase", "left"), "asked-phrases")
    rarest = each.groupBy("search_id").agg(F.min_by("phrase", F.struct("df", "phrase")).alias("phrase"), F.min(F.coalesce("df", F.lit(0))).alias("least"), F.count(F.lit(1)).alias("asked"))
    first = rarest.where("least > 0").join(hits, "phrase").select("search_id", "asked", "item_id")
    scored = first.join(each, "search_id").join(hits, ["phrase", "item_id"]).crossJoin(F.broadcast(all_items))
    weight = F.greatest(F.log((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_WEIGHT))
    part = F.col("times") * (weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean"))))
    total = scored.groupBy("search_id", "item_id", "asked").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("had"))
    return _top(total.where("had = asked"), "search_id", [F.desc("score"), F.col("item_id")], k).select("search_id", "rank", "item_id", "score")


def by_metadata(items: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(key, value, rank, item_id): for each wanted (key, value) the latest items whose JSON metadata has that value there, at most ``k``.

    Items (item_id, metadata: JSON text, at); broken or null metadata matches nothing.
    """
    fields = items.select("item_id", "at", F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    found = fields.join(wanted.select("key", "value").distinct(), ["key", "value"])
    rows = found.withColumn("_k", F.struct("key", "value"))
    return _top(rows, "_k", [F.desc("at"), F.col("item_id")], k).select("key", "value", "rank", "item_id")
