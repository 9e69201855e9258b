"""Search over evidence: keyword scores, regular expressions, vectors, and their fusion.

Queries come as a table. Keyword search holds blocks of them against the texts in one pass, of
which each task gives the best (`keyword`). Search within documents joins texts and queries on
their terms, counted by query and text. A phrase is looked for only in texts that have all its
sequences. Regular expressions go through the index, or the sequences they need, first.

Ties are settled by id. Null and empty texts are no hits; a blank query has no hits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..session import materialize
from . import keyword as K
from . import planner

#: Vectors of queries that are held against all rows at once, and texts of queries.
BLOCK, ASKED = 2048, 32768
#: From so many queries on, so many texts are met first, for limits that spare most of the others.
MANY, FIRST = 1024, 16384
STRATEGIES = ("baseline", "lexical", "rg", "semantic", "hybrid")


def flat(text: str) -> str:
    return " ".join(text.lower().split())


def best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each query, with their rank; ties by id. The limit is applied before the shuffle too."""
    order = Window.partitionBy(*(by or ("query_id",))).orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _flat_rows(df: DataFrame, key: str, text: str, within: tuple[str, ...]) -> DataFrame:
    flat_text = T.normalized(text)
    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias(key), *within, flat_text.alias("flat")).where("flat <> ''")


def terms(flat_text: str = "flat") -> Column:
    """The different terms of a text in normal form: its sequences of three characters, and its tokens behind a tab."""
    return F.concat(T.trigrams(flat_text), F.transform(F.array_distinct(T.tokens(flat_text)), lambda t: F.concat(F.lit("\t"), t)))


def counted(corpus: DataFrame, queries: DataFrame, *within: str) -> DataFrame:
    """(query_id, *within, id, tri, n_tri, tok, n_tok, same, n_set, phrase) of each query and text that share a term.

    ``corpus(id, text)`` and ``queries(query_id, query)``. Shared sequences, shared tokens as often
    as the query has them and once each, and whether the query stands in the text. ``within`` are
    columns of both that must be equal, as the document: texts of others are never met.
    """
    rows, asked = _flat_rows(corpus, "id", "text", within), _flat_rows(queries, "query_id", "query", within).distinct()
    side = ["query_id", *within]
    words = T.tokens("flat")
    sizes = asked.select(*side, "flat", F.size(T.trigrams("flat")).alias("n_tri"), F.size(words).alias("n_tok"), F.size(F.array_distinct(words)).alias("n_set"))
    tri = asked.select(*side, F.explode(T.trigrams("flat")).alias("term"), F.lit(1).alias("weight"))
    tok = asked.select(*side, F.explode(words).alias("word")).groupBy(*side, "word").agg(F.count("*").cast("int").alias("weight"))
    wanted = tri.unionByName(tok.select(*side, F.concat(F.lit("\t"), "word").alias("term"), "weight"))
    held = rows.select("id", *within, F.explode(terms()).alias("term"))
    token = F.startswith("term", F.lit("\t"))
    counts = held.join(wanted, ["term", *within]).groupBy(*side, "id").agg(F.count_if(~token).cast("int").alias("tri"), F.coalesce(F.sum(F.when(token, F.col("weight"))), F.lit(0)).cast("int").alias("tok"), F.count_if(token).cast("int").alias("same"))
    hits = counts.join(sizes, side)
    # texts with all sequences of the query, few as they are, are looked through; a query that is too short for one goes by tokens
    whole = hits.where((F.col("tri") == F.col("n_tri")) | ((F.char_length("flat") < 3) & (F.col("same") > 0))).select(*side, "id", F.col("flat").alias("_q"))
    phrases = whole.join(rows.select("id", *within, F.col("flat").alias("_d")), ["id", *within]).where(F.contains("_d", F.col("_q"))).select(*side, "id", F.lit(True).alias("phrase"))
    out = hits.drop("flat").join(phrases, [*side, "id"], "left")
    return out.withColumn("phrase", F.coalesce("phrase", F.lit(False)))


def contained(corpus: DataFrame, queries: DataFrame, *within: str) -> DataFrame:
    """(query_id, *within, id, tok, n_tok) of each query and text in which some tokens of the query stand, inside words too; repeats in the query count.

    A token stands in a text if it stands in one of its words. So the different words of the corpus
    are searched once, by the first characters of a token, and then the texts of those words found.
    """
    rows, asked = _flat_rows(corpus, "id", "text", within), _flat_rows(queries, "query_id", "query", within).distinct()
    side = ["query_id", *within]
    sizes = asked.select(*side, F.size(T.tokens("flat")).alias("n_tok"))
    tok = asked.select(*side, F.explode(T.tokens("flat")).alias("token")).groupBy(*side, "token").agg(F.count("*").cast("int").alias("weight"))
    words = rows.select("id", *within, F.explode(F.array_distinct(T.tokens("flat"))).alias("word"))
    starts = [F.regexp_extract_all("word", F.lit(f"(?=(.{{{n}}}))"), 1) for n in (1, 2, 3)]
    grams = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*starts))).alias("gram"))
    inside = tok.select("token").distinct().withColumn("gram", F.left("token", F.lit(3))).join(grams, "gram").where(F.contains("word", F.col("token"))).select("token", "word").distinct()
    # texts are met with tokens first, then those with the queries, of which many share a token
    held = words.join(inside, "word").select("id", *within, "token").distinct()
    found = held.join(tok, ["token", *within]).select(*side, "id", "token", "weight")
    return found.groupBy(*side, "id").agg(F.sum("weight").cast("int").alias("tok")).join(sizes, side)


def scored(counts: DataFrame, how: str) -> DataFrame:
    """``counts`` of `counted`, or for rg of `contained`, with ``token_hits``, ``tokens`` and ``score``; texts that are no candidates are left out.

    lexical: shares of sequences, tokens and the phrase, of texts that have all sequences or any
    token; baseline: share of different tokens and the phrase; rg: share of tokens in the text.
    """
    if how == "rg":
        return counts.withColumn("token_hits", F.col("tok")).withColumn("tokens", F.col("n_tok")).withColumn("score", F.round(F.col("tok") / F.col("n_tok"), 6))
    phrase = F.col("phrase").cast("int")
    if how == "baseline":
        rows, hits, of = counts.where((F.col("same") > 0) | F.col("phrase")), "same", "n_set"
        score = F.lit(0.8) * F.coalesce(F.col("same") / F.nullif("n_set", F.lit(0)), F.lit(0.0)) + F.lit(0.2) * phrase
    else:
        rows, hits, of = counts.where((F.col("tri") == F.col("n_tri")) | (F.col("tok") > 0)), "tok", "n_tok"
        score = F.lit(0.55) * (F.col("tri") / F.col("n_tri")) + F.lit(0.35) * F.coalesce(F.col("tok") / F.nullif("n_tok", F.lit(0)), F.lit(0.0)) + F.lit(0.10) * phrase
    return rows.withColumn("token_hits", F.col(hits)).withColumn("tokens", F.col(of)).withColumn("score", F.round(score, 6))


def keyword(corpus: DataFrame, queries: DataFrame, k: int = 10, how: str = "lexical", *within: str) -> DataFrame:
    """The k best texts of ``corpus(id, text)`` for each of ``queries(query_id, query)`` by a way of `scored`, with equal ``within`` columns.

    A query shorter than three characters has no sequence but itself; it meets texts that have a token of it.
    """
    if not within:
        return best(scored(topped(corpus, queries, {how: k}).drop("how"), how), k)
    counts = contained(corpus, queries, *within) if how == "rg" else counted(corpus, queries, *within)
    return best(scored(counts, how), k, "query_id", *within)


def _passes(rows: DataFrame, queries: DataFrame, kernel, schema: str, size: int | None = None) -> DataFrame:
    """What ``kernel(block)(batches)`` makes of ``rows`` with each block of queries; rows are kept where there are several."""
    out = None
    for n, some in enumerate(_blocks(queries, size or ASKED)):
        if n == 1:
            rows = materialize(rows, "rows")
        part = rows.mapInArrow(kernel(some), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def topped(corpus: DataFrame, queries: DataFrame, ways: dict[str, int]) -> DataFrame:
    """Columns of `counted`, for rg of `contained`, with ``how``: of each query the texts that may be its k best by each of ``ways``, in one pass over the corpus."""
    rows, asked = _flat_rows(corpus, "id", "text", ()), _flat_rows(queries, "query_id", "query", ()).distinct()
    first = []

    def limited(some: list) -> list:
        if len(some) < MANY:
            return some
        if not first:
            first.append(rows.limit(FIRST).toArrow().combine_chunks().to_batches())
        if not first[0]:
            return some
        spark, texts = rows.sparkSession, first[0][0]
        table = spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=["query_id", "flat"]))
        parts = table.repartition(max(1, min(spark.sparkContext.defaultParallelism, len(some) // 256)))
        found = parts.mapInArrow(lambda batches: K.limits(batches, texts, ways), "query_id string, flat string, limits array<double>")
        return [tuple(r) for r in found.collect()]

    def kernel(some: list):
        some, name = limited(some), uuid.uuid4().hex
        return lambda batches: K.top(batches, some, ways, name)

    return _passes(rows, asked, kernel, K.SCHEMA)


def candidate_counts(hits: DataFrame) -> DataFrame:
    """(query_id, candidate_count): how many texts each query had to rank."""
    return hits.groupBy("query_id").agg(F.countDistinct("id").alias("candidate_count"))


def trigram_index(corpus: DataFrame) -> DataFrame:
    """(trigram, id): the postings of ``corpus(id, text)``."""
    return corpus.select("id", F.explode(T.trigrams("text")).alias("trigram")).select("trigram", "id")


def token_index(corpus: DataFrame) -> DataFrame:
    """(token, id, tf): the postings of the tokens of ``corpus(id, text)``."""
    return corpus.select("id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def candidates(index: DataFrame, plan: planner.Plan) -> DataFrame | None:
    """Ids that have all sequences of one alternative of the plan; None if any row may match."""
    if plan.alternatives is None:
        return None
    wanted = sorted({t for a in plan.alternatives for t in a})
    # one count per alternative in a single pass; the group of an id has at most one row per wanted sequence
    some = index.where(F.col("trigram").isin(wanted)).select("trigram", "id").distinct()
    counts = some.groupBy("id").agg(*[F.sum(F.col("trigram").isin(sorted(a)).cast("int")).alias(f"n{k}") for k, a in enumerate(plan.alternatives)])
    passes = F.lit(False)
    for k, a in enumerate(plan.alternatives):
        passes = passes | (F.col(f"n{k}") == len(a))
    return counts.where(passes).select("id")


def planned(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` with is_regex, valid, pattern (for the JVM) and alternatives: sets of sequences of which a match has one, null where nothing can be asked of an index."""

    def run(batches):
        for batch in batches:
            plans = [planner.plan(q or "") for q in batch.column("query").to_pylist()]
            sets = [None if p.alternatives is None else [sorted(a) for a in p.alternatives] for p in plans]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), pa.array([p.is_regex for p in plans]), pa.array([p.valid for p in plans]), pa.array([p.java() if p.is_regex and p.valid else None for p in plans], pa.string()), pa.array(sets, pa.list_(pa.list_(pa.string())))], names=["query_id", "query", "is_regex", "valid", "pattern", "alternatives"])

    some = queries.select(F.col("query_id").cast("string").alias("query_id"), "query").where("query is not null")
    return some.mapInArrow(run, "query_id string, query string, is_regex boolean, valid boolean, pattern string, alternatives array<array<string>>")


def _matched(rows: DataFrame, scan: bool) -> DataFrame:
    """``rows(text, pattern, ...)`` that match, with match_chars, chars and score: by all matches with ``scan``, else by the first."""
    one = lambda m: F.greatest(F.char_length(m), F.lit(1))
    chars = F.aggregate(F.expr("regexp_extract_all(text, pattern, 0)"), F.lit(0), lambda a, m: a + one(m)) if scan else one(F.expr("regexp_extract(text, pattern, 0)"))
    base, share = (0.5, 0.5) if scan else (0.7, 0.3)
    hits = rows.where(F.expr("text rlike pattern")).withColumn("match_chars", chars).withColumn("chars", F.char_length("text"))
    return hits.withColumn("score", F.round(F.least(F.lit(1.0), F.lit(base) + F.lit(share) * (F.col("match_chars") / F.col("chars"))), 6))


def regexes(corpus: DataFrame, plans: DataFrame, index: DataFrame | None = None, scan: bool = False, sieved: bool = False) -> DataFrame:
    """(query_id, id, match_chars, score): all texts of ``corpus(id, text)`` that match a valid expression of ``plans`` (of `planned`).

    With an ``index(trigram, id)`` each alternative of an expression is counted in its postings,
    and only texts that have all its sequences are verified. ``sieved`` looks for them in the texts
    instead, in one pass. Expressions that ask nothing of an index are held against all texts, as a
    stated set of queries.
    """
    rows = corpus.select("id", "text").where("text is not null and text <> ''")
    good = plans.where("is_regex and valid").select("query_id", "pattern", "alternatives")
    open_ones = good if index is None and not sieved else good.where("alternatives is null")
    full = rows.join(open_ones.select("query_id", "pattern"), F.expr("text rlike pattern"))
    out = _matched(full, scan).select("query_id", "id", "match_chars", "score")
    if sieved:
        flat_rows = rows.select("id", "text", T.normalized("text").alias("flat")).where("flat <> ''")
        some = _passes(flat_rows, good.where("alternatives is not null").select("query_id", "pattern", "alternatives"), lambda some: lambda batches: K.having(batches, some), "query_id string, id string, text string, pattern string")
        return out.unionByName(_matched(some, scan).select("query_id", "id", "match_chars", "score"))
    if index is None:
        return out
    each = good.where("alternatives is not null").select("query_id", F.posexplode("alternatives").alias("alternative", "set"))
    asked = each.select("query_id", "alternative", F.size("set").alias("n"), F.explode("set").alias("trigram"))
    met = index.select("trigram", "id").join(asked, "trigram").groupBy("query_id", "alternative", "n", "id").agg(F.countDistinct("trigram").alias("have")).where("have = n")
    some = met.select("query_id", "id").distinct().join(good.select("query_id", "pattern"), "query_id").join(rows, "id")
    return out.unionByName(_matched(some, scan).select("query_id", "id", "match_chars", "score"))


def regex(corpus: DataFrame, query: str, k: int | None = 10, index: DataFrame | None = None, scan: bool = False) -> DataFrame:
    """(id, match_chars, chars, score): the texts one regular expression matches, the k best.

    What an ``index`` admits is verified on the stored text. An invalid expression has no hits here; `run` searches its words.
    """
    plan = planner.plan(query)
    rows = corpus.select("id", "text").where("text is not null and text <> ''")
    usable = plan.valid and plan.is_regex
    some = candidates(index, plan) if usable and index is not None else None
    if some is not None:
        rows = rows.join(some, "id", "left_semi")
    found = _matched(rows.where(F.lit(usable)).withColumn("pattern", F.lit(plan.java() if usable else "a^")), scan)
    hits = found.select("id", "match_chars", "chars", "score")
    return hits if k is None else hits.orderBy(F.desc("score"), F.asc("id")).limit(k)


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = 10, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """The k best of two ranked lists (query_id, id, score, rank): score within its list, rank, and a bonus for being in both."""

    def side(hits: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        norm = F.when(high <= low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
        return hits.select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), norm.alias(f"{name}_norm"))

    both = side(semantic, "semantic").join(side(lexical, "lexical"), ["query_id", "id"], "full_outer")
    damp = max(60, 6 * k)
    part = lambda name, w: F.coalesce((F.lit(0.65) * F.col(f"{name}_norm") + F.lit(0.35) * (F.lit(1.0) / (F.lit(damp) + F.col(f"{name}_rank")))) * F.lit(w), F.lit(0.0))
    sem, lex = F.col("semantic_rank"), F.col("lexical_rank")
    bonus = F.when(sem.isNotNull() & lex.isNotNull(), F.lit(0.08)).when(sem.isNull() & (lex <= max(3, k // 2)), F.lit(0.03)).otherwise(F.lit(0.0))
    score = F.round(part("semantic", weights[0]) + part("lexical", weights[1]) + bonus, 6)
    sources = F.filter(F.array(F.when(lex.isNotNull(), F.lit("lexical")), F.when(sem.isNotNull(), F.lit("semantic"))), lambda x: x.isNotNull())
    fused = both.select("query_id", "id", score.alias("score"), "semantic_rank", "lexical_rank", F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), sources.alias("sources"))
    return best(fused, k)


def _blocks(queries: DataFrame, size: int):
    """Vectors of the queries in blocks of a fixed size, one after another."""
    block: list = []
    for row in queries.orderBy(*queries.columns[:1]).toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k vectors (id, vector) of highest cosine for each of queries(query_id, vector). Null and zero vectors, and those of another length, are no hits."""
    out = None
    rows = vectors.select(F.col("id").cast("string").alias("id"), "vector").where("vector is not null")
    schema = "query_id string, id string, score double"
    for some in _blocks(queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("vector is not null"), block):
        part = _cosines(rows, some, k, schema)
        out = part if out is None else out.unionByName(part)
    return best(out if out is not None else vectors.sparkSession.createDataFrame([], schema), k)


def _cosines(rows: DataFrame, queries: list, k: int, schema: str) -> DataFrame:
    width = len(queries[0][1])
    kept = [(q, v) for q, v in queries if len(v) == width]
    names, m = [q for q, _ in kept], np.array([v for _, v in kept], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def run(batches):
        short = m.astype(np.float32).T.copy()
        limits = np.full(len(names), -2.0)
        ids: list = []
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def best_of(found: list) -> list:
            # all that tie with the k-th stay, so that ties are settled by id over all tasks
            q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((-s, q))
            q, i, s = q[order], i[order], s[order]
            begin = np.searchsorted(q, np.arange(len(names)))
            full = np.flatnonzero(np.append(begin[1:], len(q)) - begin >= k)
            limits[full] = s[begin[full] + k - 1]
            good = s >= limits[q]
            return [(q[good], i[good], s[good])]

        fresh = 0
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("vector")), width))
            if not batch.num_rows:
                continue
            x = _stacked(batch.column("vector"), width)
            norm = np.linalg.norm(x, axis=1)
            x, own = x[norm > 0] / norm[norm > 0, None], np.array(batch.column("id").to_pylist(), object)[norm > 0]
            size = max(k, (1 << 22) // len(names))
            for begin in range(0, len(x), size):
                some = x[begin : begin + size]
                # products of half the digits leave few pairs to those of all
                near = some.astype(np.float32) @ short
                if limits.min() <= -2 and len(some) >= k:
                    limits = np.maximum(limits, np.partition(near, len(some) - k, axis=0)[len(some) - k] - 1e-5)
                pairs = np.flatnonzero(near >= (limits - 1e-5).astype(np.float32))
                for c in range(0, len(pairs), 1 << 17):
                    i, q = np.divmod(pairs[c : c + (1 << 17)], len(names))
                    s = np.round(np.einsum("ij,ij->i", some[i], m[q]), 6)
                    found.append((q, i + (len(ids) + begin), s))
                fresh += len(pairs)
                if fresh > max(1 << 16, len(names) * k // 2):
                    found, fresh = best_of(found), 0
            ids += own.tolist()
        q, i, s = best_of(found)[0]
        for c in range(0, len(q), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in q[c : c + (1 << 16)]], pa.string()), pa.array([ids[n] for n in i[c : c + (1 << 16)]], pa.string()), pa.array(s[c : c + (1 << 16)])], names=["query_id", "id", "score"])

    return rows.mapInArrow(run, schema)


def late_interaction(tokens: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k documents of tokens(id, vector) for each query of queries(query_id, vector), several vectors each.

    A document scores the sum, over the vectors of the query, of the best product with one of its own.
    """
    rows = tokens.select(F.col("id").cast("string").alias("id"), "vector").where("vector is not null")
    numbered = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("vector is not null")
    out = None
    schema = "query_id string, part int, id string, best double"
    for n, some in enumerate(_blocks(numbered, block)):
        part = _products(rows, some, n * block, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = tokens.sparkSession.createDataFrame([], schema)
    tops = out.groupBy("query_id", "part", "id").agg(F.max("best").alias("best"))
    return best(tops.groupBy("query_id", "id").agg(F.round(F.sum("best"), 4).alias("score")), k)


def _products(rows: DataFrame, queries: list, base: int, schema: str) -> DataFrame:
    width = len(queries[0][1])
    kept = [(q, v) for q, v in queries if len(v) == width]

    def run(batches):
        m = np.array([v for _, v in kept], np.float64)
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("vector")), width))
            if not batch.num_rows:
                continue
            batch = batch.sort_by("id")
            ids = np.array(batch.column("id").to_pylist(), object)
            s = _stacked(batch.column("vector"), width) @ m.T
            begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            top = np.maximum.reduceat(s, begin, axis=0)
            n, q = top.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.array([k[0] for k in kept], object), n), pa.string()), pa.array(np.tile(np.arange(base, base + q, dtype=np.int32), n)), pa.array(np.repeat(ids[begin], q), pa.string()), pa.array(top.reshape(-1))], names=["query_id", "part", "id", "best"])

    return rows.mapInArrow(run, schema)


def resolved_id(*columns: Column) -> Column:
    """The first of several ids that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def of_documents(df: DataFrame, documents: list[str] | None, column: str = "document_id") -> DataFrame:
    """Rows of the given documents; all rows if none are given."""
    return df.where(F.col(column).isin(documents)) if documents else df


def encode_text(df: DataFrame, text: str, width: int = 64) -> DataFrame:
    """``df`` with ``vector``: a stand-in encoder that hashes trigrams into ``width`` signed counts, scaled to length one; zero for null and empty texts."""
    base = df.drop("vector")
    names = base.columns
    which = names.index(text)
    schema = T_.StructType([*base.schema.fields, T_.StructField("vector", T_.ArrayType(T_.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, width))
            for k, t in enumerate(batch.column(which).to_pylist()):
                c = np.frombuffer(flat(t or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
                if len(c) >= 3:
                    h = np.unique((c[:-2] * np.uint64(1 << 42) + c[1:-1] * np.uint64(1 << 21) + c[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))
                    sign = np.where(h & np.uint64(1), 1.0, -1.0)
                    v = np.bincount((h >> np.uint64(1)).astype(np.int64) % width, sign, width)
                    out[k] = v / max(np.linalg.norm(v), 1e-300)
            flat_values = pa.array(out.reshape(-1))
            offsets = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat_values)], names=[*names, "vector"])

    return base.mapInArrow(run, schema)


def filtered(df: DataFrame, condition: str | None, **values) -> DataFrame:
    """Rows that meet a condition with named values, before anything is ranked; all rows without one."""
    if not condition:
        return df
    return df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE coalesce(({condition}), false)", args=values, rows=df)


def semantic(corpus: DataFrame, queries: DataFrame, k: int, encode=None) -> DataFrame:
    """The k nearest texts by vectors of an encoder, the hashed one unless another is given."""
    encode = encode or encode_text
    return nearest(encode(corpus, "text").select("id", "vector"), encode(queries, "query").select("query_id", "vector"), k, ASKED).select("query_id", "id", "score", "rank")


def run(spark: SparkSession, corpus: DataFrame, queries: DataFrame, strategy: str = "hybrid", k: int = 10, encode=None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, candidate_count, semantic_error) by a strategy: baseline, lexical, rg, semantic or, as for any other name, hybrid.

    lexical and rg take queries that are regular expressions as such, rg by a scan; one that is
    no valid expression is searched by its words. If the encoder fails, its error is told and hybrid goes on with keywords.
    """
    strategy = strategy.lower() if strategy.lower() in STRATEGIES else "hybrid"
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query").where("query is not null")
    error, vague = None, None
    if strategy in ("semantic", "hybrid"):
        try:
            vague = semantic(corpus, asked, k if strategy == "semantic" else max(k, min(12, k + 2)), encode)
        except Exception as e:  # noqa: BLE001 - whatever an encoder raises is told
            error = f"{type(e).__name__}: {e}"[:200]
            vague = spark.createDataFrame([], "query_id string, id string, score double, rank int")
    # hits are counted and ranked, so they are found once
    vague = vague if vague is None else materialize(vague, "vague")
    if strategy == "semantic":
        hits, counts = vague, candidate_counts(vague)
    else:
        how = "lexical" if strategy == "hybrid" else strategy
        if how == "baseline":
            every = keyword(corpus, asked, k, how).select("query_id", "id", "score")
        else:
            plans = materialize(planned(asked), "plans")
            # an expression that can't be read is looked for as words
            plain = plans.where("not (is_regex and valid)").select("query_id", "query")
            words = keyword(corpus, plain, k, how).select("query_id", "id", "score")
            found = regexes(corpus, plans, None if how == "rg" else index, how == "rg", how != "rg" and index is None)
            every = words.unionByName(found.select("query_id", "id", "score"))
        hits = materialize(best(every, k).select("query_id", "id", "score", "rank"), "hits")
        counts = candidate_counts(hits)
        if strategy == "hybrid":
            counts = candidate_counts(vague.select("query_id", "id").unionByName(hits.select("query_id", "id")))
            hits = fuse(vague, hits, k).select("query_id", "id", "score", "rank")
    return hits.join(counts, "query_id", "left").withColumn("semantic_error", F.lit(error).cast("string"))


def grounded(corpus: DataFrame, queries: DataFrame, k: int = 5, indexed: DataFrame | None = None, *within: str) -> DataFrame:
    """(query_id, *within, id, rank, score, mode): the best texts of each query's own document, with a way back where there are none.

    ``indexed`` holds the ids an index knows; a query without hits among those is asked again of
    all texts, as after building the index anew, and then of the baseline.
    """
    within = within or ("document_id",)
    side = ["query_id", *within]
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query", *within)
    counts = materialize(counted(corpus, asked, *within), "counts")
    lexical = scored(counts, "lexical")
    ways = [("index", lexical if indexed is None else lexical.join(indexed.select("id").distinct(), "id", "left_semi")), ("reindexed", lexical), ("baseline", scored(counts, "baseline"))]
    out = None
    for mode, hits in ways:
        found = best(hits, k, *side).select(*side, "id", "rank", "score", F.lit(mode).alias("mode"))
        if out is not None:
            found = found.join(out.select(*side).distinct(), side, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out
