"""Measures of retrieval and of detection, and the tables they are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def retrieval(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg, relevant, found) of every query in qrels(query_id, id, relevance).

    hits(query_id, id, rank). Recall and nDCG look at the first k, the reciprocal rank at all
    hits. Queries without hits have zeros; relevance of zero or null counts as one.
    """
    rel = qrels.select("query_id", "id", F.when(F.coalesce("relevance", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("relevance")).alias("relevance")).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    wanted = rel.withColumn("_n", F.row_number().over(ideal))
    best = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("_n") <= k, F.col("relevance") / F.log2(F.col("_n") + 1)).otherwise(0.0)).alias("ideal"))
    got = hits.select("query_id", "id", "rank").join(rel, ["query_id", "id"])
    seen = got.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, F.col("relevance") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    j = best.join(seen, "query_id", "left").fillna({"found": 0, "gain": 0.0})
    ndcg = F.when(F.col("ideal") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("gain") / F.col("ideal")))).otherwise(0.0)
    return j.select("query_id", (F.col("found") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), ndcg.alias("ndcg"), "relevant", "found")


def means(measures: DataFrame, *by: str) -> DataFrame:
    return measures.groupBy(*by).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def best_strategy(summary: DataFrame, order: list[str]) -> DataFrame:
    """The strategy of the highest recall, the first in ``order`` of equals."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy")), F.lit(len(order) + 1))
    return summary.orderBy(F.desc("recall"), place, "strategy").limit(1)


def labelled(df: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    """Counts of agreement and precision, recall and F1; rows with a null label are left out; 0 where nothing can be divided."""
    g, p = F.col(gold), F.col(predicted)
    c = df.where(g.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = part(2 * precision * recall, precision + recall)
    return c.select(*by, "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def total_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """The given total, or where it is null or zero the sum of its parts."""
    return F.coalesce(F.when(total != 0, total), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def question_pack(rows: DataFrame, query: Column, ids: str, texts: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(samples, corpus) from rows with a question and an array of evidence texts.

    Questions are collapsed; empty ones, those over ``most`` characters and those without any
    evidence give no sample. corpus(id, text) has each evidence once.
    """
    flat = rows.select(F.col(ids).cast("string").alias("sample_id"), F.trim(F.regexp_replace(query, rf"[{T.WS}]+", " ")).alias("query"), texts.alias("texts"))
    good = flat.where((F.col("query") != "") & (F.char_length("query") <= most))
    evidence = good.select("sample_id", F.posexplode("texts").alias("n", "text")).where("text is not null and text <> ''").withColumn("id", F.concat_ws("-", F.lit("find"), "sample_id", F.lit("ev"), F.col("n").cast("string")))
    order = Window.partitionBy("id").orderBy("text")
    corpus = evidence.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("id", "text")
    samples = good.join(evidence.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "query").distinct()
    return samples, corpus


def two_contexts(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(id, text): both contexts of each row as rows of a corpus."""
    return rows.selectExpr(f"stack(2, concat(cast({key} as string), ':context1'), {first}, concat(cast({key} as string), ':context2'), {second}) as (id, text)").where("text is not null and text <> ''")


def judged_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements whose query and document both exist, with the query: the three tables of a retrieval benchmark joined."""
    return qrels.join(queries.select("query_id", "query").dropDuplicates(["query_id"]), "query_id").join(corpus.select("id").distinct(), "id", "left_semi").select("query_id", "query", "id", "relevance")


def first_rows(df: DataFrame, n: int, *order: str, all_if_none: bool = False) -> DataFrame:
    """The first n rows by ``order``; none for n below 1, or all where that is meant."""
    if n <= 0:
        return df if all_if_none else df.where("false")
    return df.orderBy(*order).limit(n)


def run_summaries(runs: DataFrame, result: str) -> DataFrame:
    """Means over the strategies in a JSON of results: runs(run_id, result) to (run_id, strategies, recall, mrr, ndcg)."""
    shape = "map<string, struct<recall: double, mrr: double, ndcg: double>>"
    rows = runs.select("run_id", F.explode(F.from_json(result, shape)).alias("strategy", "m"))
    return rows.groupBy("run_id").agg(F.count("*").alias("strategies"), *[F.round(F.avg(f"m.{c}"), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def cost(prompt: Column, completion: Column, per_1k_in: float, per_1k_out: float) -> Column:
    """The cost of tokens at prices for a thousand; nulls count as none."""
    return F.coalesce(prompt, F.lit(0)) / 1000.0 * per_1k_in + F.coalesce(completion, F.lit(0)) / 1000.0 * per_1k_out


def economics(samples: DataFrame, *by: str) -> DataFrame:
    """Sums and means of samples(prompt_tokens, completion_tokens, cost_usd, latency_ms, compression_ratio, llm_calls), columns that lack or are null counting as 0, a ratio as 1; one row of zeros, ratio 1, for no samples."""
    have = lambda c, other: F.coalesce(F.col(c).cast("double"), F.lit(other)) if c in samples.columns else F.lit(other)
    total = lambda c: F.coalesce(F.sum(have(c, 0.0)), F.lit(0.0))
    mean = lambda c, other: F.round(F.coalesce(F.avg(have(c, other)), F.lit(other)), 6)
    return samples.groupBy(*by).agg(
        F.count("*").alias("runs"), total("prompt_tokens").alias("total_prompt_tokens"), total("completion_tokens").alias("total_completion_tokens"), (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
        F.round(total("cost_usd"), 6).alias("total_cost_usd"), mean("latency_ms", 0.0).alias("avg_latency_ms"), mean("compression_ratio", 1.0).alias("avg_compression_ratio"), total("llm_calls").alias("total_llm_calls"),
    )


def judged_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every hit(query_id, id, rank, score) with ``is_relevant``, and of its query ``gold_present`` and ``best_relevant_rank``.

    qrels(query_id, document_id) judge by document, so a query with a large document isn't joined with all its texts; hits have document_id.
    """
    gold = qrels.select("query_id", "document_id").distinct().withColumn("_gold", F.lit(True))
    rows = hits.join(gold, ["query_id", "document_id"], "left").withColumn("is_relevant", F.coalesce("_gold", F.lit(False))).drop("_gold")
    first = F.min(F.when(F.col("is_relevant"), F.col("rank"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("best_relevant_rank", first).withColumn("gold_present", first.isNotNull())


def by_document(hits: DataFrame, qrels: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """The measures of `retrieval` where every text of a query's documents is relevant alike: qrels(query_id, document_id), hits with document_id, sizes(document_id, texts).

    How many texts are relevant is counted by document, so neither side is multiplied.
    """
    gold = qrels.select("query_id", "document_id").distinct()
    of = gold.join(sizes, "document_id").groupBy("query_id").agg(F.sum("texts").alias("relevant"))
    got = hits.join(gold, ["query_id", "document_id"], "left_semi")
    seen = got.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda a, n: a + 1 / F.log2(n + 1))
    j = of.join(seen, "query_id", "left").fillna({"found": 0, "gain": 0.0})
    return j.select("query_id", (F.col("found") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.least(F.lit(1.0), F.col("gain") / ideal).alias("ndcg"), "relevant", "found")


def history_summary(runs: DataFrame, strategies: DataFrame, last: int = 100) -> DataFrame:
    """One row on the last runs(run_id, created_at): their number, the latest, the strategy of the best recall and means over strategies(run_id, strategy, recall, latency)."""
    some = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    each = strategies.join(some.select("run_id"), "run_id", "left_semi")
    head = some.agg(F.count("*").alias("runs"), F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest"))
    best = each.agg(F.min_by("strategy", F.struct(-F.col("recall"), F.col("strategy"))).alias("best_strategy"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 6).alias("latency"))
    # both sides are one row
    return head.join(best, F.lit(True))


def trend(summaries: DataFrame, last: int = 8) -> DataFrame:
    """The last runs(run_id, created_at, recall, mrr, ndcg) in the order of time, numbered, with the change of recall against the run before."""
    some = summaries.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    w = Window.orderBy("created_at", "run_id")  # over at most ``last`` rows
    return some.withColumn("step", F.row_number().over(w)).withColumn("recall_change", F.round(F.col("recall") - F.lag("recall").over(w), 6))


class PackError(Exception):
    """A question pack that can't be built: ``code`` is dataset_access_error, empty_split or schema_mismatch."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def load_pack(read, query: str, ids: str, texts: str, most: int = 8192) -> tuple[DataFrame, DataFrame, int]:
    """(samples, corpus, skipped) of the rows that ``read()`` gives, by `question_pack`; PackError tells why there are none."""
    try:
        rows = read()
        columns = set(rows.columns)
        empty = rows.isEmpty()
    except Exception as e:  # noqa: BLE001 - whatever a reader raises is an access error
        raise PackError("dataset_access_error", f"{type(e).__name__}: {e}"[:300]) from e
    if not {query, ids, texts} <= columns:
        raise PackError("schema_mismatch", f"columns {sorted({query, ids, texts} - columns)} are missing")
    if empty:
        raise PackError("empty_split", "there are no rows")
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(query), F.lit("")), rf"(?U)[{T.SPACE}]+", " "))
    skipped = rows.where((flat == "") | (F.char_length(flat) > most)).count()
    return (*question_pack(rows, F.col(query), ids, F.col(texts), most), skipped)
