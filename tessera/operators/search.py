"""Full-text search: postings and BM25 over weighted fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import materialise
from tessera.model import Model

#: Field weights, and the constants of BM25.
WEIGHTS = {"name": 10.0, "display_kind": 2.0, "path": 3.0, "signature": 2.0, "doc": 1.0, "summary": 1.0}
K1, B = 1.2, 0.75
TEXT_LIMIT = 20_000


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, marks of accents removed."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(term, id, tf, length): weighted term counts of documents (id and fields); length is in words.

    Partition by a prefix of ``term`` when it is written, so a query reads few files.
    """
    weights = weights or WEIGHTS

    def weighted(field: str) -> Column:
        return F.transform(terms(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(weights[field]).alias("w")))

    fields = [weighted(f) for f in weights if f in documents.columns]
    each = documents.select("id", F.concat(*fields).alias("x"))
    rows = each.select("id", F.size("x").cast("long").alias("length"), F.explode("x").alias("x"))
    return rows.groupBy(F.col("x.term").alias("term"), "id").agg(F.sum("x.w").alias("tf"), F.first("length").alias("length"))


def node_documents(model: Model) -> DataFrame:
    """The fields of all nodes that a search reads; routes count as part of the signature."""
    routes = F.coalesce(F.get_json_object("attrs", "$.http_routes"), F.lit(""))
    return model.nodes.select("id", "name", "display_kind", "path", F.concat_ws(" ", "signature", routes).alias("signature"), F.substring("doc", 1, TEXT_LIMIT).alias("doc"), "summary")


def index_nodes(model: Model) -> DataFrame:
    """Postings of all nodes."""
    return postings(node_documents(model))


def search(index: DataFrame, query: str, documents: int, mean_length: float) -> DataFrame:
    """(id, score): documents in which every word of the query begins a word, best first.

    documents and mean_length describe the whole index; one scan of the terms serves all words.
    """
    words = query_words(query)
    if not words:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = F.filter(F.array(*[F.when(F.col("term").startswith(w), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    rows = index.withColumn("word", F.explode(hit)).groupBy("word", "id").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    df = rows.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(documents))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    scored = rows.join(F.broadcast(df), "word").groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("words"))
    return scored.filter(F.col("words") == len(words)).select("id", "score")


def query_words(query: str) -> list[str]:
    words: list[str] = []
    for raw in query.lower().split():
        word = "".join(c for c in raw if c.isalnum())
        if word and word not in words:
            words.append(word)
    return words


def search_documents(documents: DataFrame, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of documents (id and fields) without an index: two scans, and no shuffle but one row of counts.

    Scores are those of ``search`` over ``postings`` of the documents.
    """
    words, weights = query_words(query), weights or WEIGHTS
    if not words:
        return documents.select("id", F.lit(0.0).alias("score")).limit(0)
    fields = [f for f in weights if f in documents.columns]
    split = documents.select("id", F.struct(*[terms(F.col(f)).alias(f) for f in fields]).alias("t"))  # words are split once
    found = {f: F.col("t")[f] for f in fields}
    length = sum((F.size(t) for t in found.values()), F.lit(0))
    begins = lambda t, w: F.size(F.filter(t, lambda x: x.startswith(w)))
    tf = [sum((begins(t, w) * F.lit(weights[f]) for f, t in found.items()), F.lit(0.0)) for w in words]
    rows = materialise(split.select("id", length.alias("length"), F.array(*tf).alias("tf")).filter("length > 0"), "counts")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(words))]).first()
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = max(1e-6, math.log((counts["n"] - counts[f"df{k}"] + 0.5) / (counts[f"df{k}"] + 0.5)))
        here = F.col("tf")[k]
        score = score + F.lit(idf) * here * (K1 + 1) / (here + K1 * (1 - B + B * F.col("length") / F.lit(float(counts["mean"] or 1.0))))
    return rows.filter(F.forall("tf", lambda x: x > 0)).select("id", score.alias("score"))


#: Leading characters of a term that name the folder of its postings.
PREFIX = 2


def store_index(documents: DataFrame, path: str, weights: dict[str, float] | None = None) -> None:
    """Write postings under ``path``, in folders by the first characters of their terms, and the counts of the index."""
    index = materialise(postings(documents, weights), "postings")
    folder = F.hex(F.substring("term", 1, PREFIX))  # any letter makes a valid folder name
    index.withColumn("folder", folder).repartition("folder").sortWithinPartitions("folder", "term", "id").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    lengths = index.groupBy("id").agg(F.first("length").alias("length"))
    lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/counts")


def search_stored(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) from a stored index: only the folders of the query's words are read."""
    counts, index = spark.read.parquet(f"{path}/counts").first(), spark.read.parquet(f"{path}/postings")
    some = F.lit(False)
    for w in query_words(query):
        part = w[:PREFIX].encode().hex().upper()
        some = some | (F.col("folder") == part if len(w) >= PREFIX else F.col("folder").startswith(part))
    return search(index.filter(some).select("term", "id", "tf", "length"), query, counts["documents"], counts["mean"])


def search_nodes(model: Model, query: str, kinds: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Nodes by rank; a query with a slash also finds nodes by pieces of their routes."""
    from tessera.operators.graph import page

    found = search_documents(node_documents(model), query)
    if "/" in query:
        by_route = model.nodes.filter(F.col("attrs").contains(query.strip())).select("id", F.lit(-1.0).alias("score"))
        found = found.unionByName(by_route.join(found, "id", "left_anti"))
    nodes = model.nodes.select("id", "kind", "display_kind", "name", "path")
    out = found.join(nodes, "id")
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds) | F.col("display_kind").isin(*kinds))
    return page(out, [F.desc("score"), F.col("id")], limit, offset)
