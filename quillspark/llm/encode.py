"""Token ids of a whole corpus by a public byte-level tokenizer (problem 7).

A text of up to ``chunk`` code points is encoded where it is read. A longer one is cut into
chunks that overlap, so that one huge text occupies many tasks: every chunk is
pre-tokenised on its own, two neighbours are stitched at the first place in their overlap
where both put a pre-token boundary (from there on both go the same way), and the pieces
between stitches are encoded in parallel and concatenated. Chunks without a common boundary
in their overlap, as inside one very long word, are encoded together, so ids are exact.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary
text. Other columns pass unchanged.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

FOLDER = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = regex.compile(r"\s")
SURE = regex.compile(r"\S(?=\s)")
#: Code points by which the pattern looks ahead of a boundary at most.
AHEAD = 4
CHUNK, OVERLAP = 16384, 512


@lru_cache(4)
def encoder(name: str = "byte_bpe_50k", folder: str = FOLDER) -> tiktoken.Encoding:
    """The tokenizer of the rank file ``folder/name.tiktoken``."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_array(texts: list[str | None], name: str, folder: str) -> pa.Array:
    encode = encoder(name, folder).encode_ordinary
    lists = [encode(t) if t else [] for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    """The text of a list of ids: the raw bytes of the tokens, one after another."""
    return encoder(name, folder).decode_bytes(ids).decode("utf-8")


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Starts of pre-tokens of ``text`` from ``low`` on, before ``high``."""
    out = []
    for m in regex.finditer(PATTERN, text):
        if m.start() >= high:
            break
        if m.start() >= low:
            out.append(m.start())
    return out


def _encode_here(df: DataFrame, text: str, out: str, name: str, folder: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, ids_array(batch.column(text).to_pylist(), name, folder)], names=schema.names)

    return df.mapInArrow(run, schema)


def _chunks(long: DataFrame, text: str, chunk: int, overlap: int) -> DataFrame:
    """(uid, k, begin, part, heads, tails): overlapping chunks with their boundaries in both overlaps."""

    def cut(batches):
        for batch in batches:
            for uid, t in zip(batch.column("uid").to_pylist(), batch.column(text).to_pylist()):
                n = max(1, -(-(len(t) - overlap) // chunk))
                for k in range(n):
                    part = t[k * chunk :] if k == n - 1 else t[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict({"uid": pa.array([uid], pa.int64()), "k": pa.array([k], pa.int32()), "final": [k == n - 1], "part": [part]})

    def mark(batches):
        for batch in batches:
            heads, tails = [], []
            for k, final, part in zip(batch.column("k").to_pylist(), batch.column("final").to_pylist(), batch.column("part").to_pylist()):
                heads.append([] if k == 0 else [k * chunk + b for b in boundaries(part, 0, overlap)])
                # A pre-token never goes from ink to white space: from the first such place on,
                # the boundaries hold whatever came before this chunk. A piece may not end in white
                # space, as the split of a run of it depends on what follows.
                sure = 0 if k == 0 else getattr(SURE.search(part), "end", lambda: len(part))()
                tails.append([] if final else [k * chunk + b for b in boundaries(part, max(chunk, sure), len(part) - AHEAD) if not SPACE.match(part, b - 1)])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], names=[*batch.schema.names, "heads", "tails"])

    raw = long.select("uid", text).mapInArrow(cut, "uid long, k int, final boolean, part string")
    return raw.repartition("uid", "k").mapInArrow(mark, "uid long, k int, final boolean, part string, heads array<long>, tails array<long>")


def with_token_ids(df: DataFrame, text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with the column ``out``: the token ids of ``text`` by the tokenizer ``name``.

    Keeps every row and column; a column called ``out`` is replaced.
    """
    df = df.drop(out)
    short = _encode_here(df.where(F.col(text).isNull() | (F.char_length(text) <= chunk + overlap)), text, out, name, folder)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # no name can clash with ours
    source = f"c{df.columns.index(text)}"
    long = materialize(plain.where(F.char_length(source) > chunk + overlap).withColumn("uid", F.monotonically_increasing_id()), "long")
    parts = materialize(_chunks(long, source, chunk, overlap), "chunks")
    heads = parts.select("uid", (F.col("k") - 1).alias("k"), F.col("heads").alias("next"))
    seams = parts.select("uid", "k", "tails").join(heads, ["uid", "k"], "left").select("uid", "k", F.array_min(F.array_intersect("tails", F.coalesce("next", F.array().cast("array<long>")))).alias("seam"))
    before = seams.select("uid", (F.col("k") + 1).alias("k"), F.col("seam").alias("since"))
    # A chunk opens a piece where it was stitched to the one before; others go on with that piece.
    order = Window.partitionBy("uid").orderBy("k")
    plan = seams.join(before, ["uid", "k"], "left").withColumn("piece", F.sum(F.when(F.col("since").isNotNull() | (F.col("k") == 0), 1).otherwise(0)).over(order))
    begin = F.col("k").cast("long") * chunk
    left = F.when(F.col("since").isNotNull(), F.col("since") - begin).otherwise(0)
    right = F.when(F.col("seam").isNotNull(), F.col("seam") - begin).when(F.col("final"), F.char_length("part")).otherwise(chunk)
    body = F.substring(F.col("part"), left.cast("int") + 1, (right - left).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("body")))), lambda x: x["body"]), "")
    pieces = parts.select("uid", "k", "final", "part").join(plan.select("uid", "k", "seam", "since", "piece"), ["uid", "k"]).groupBy("uid", "piece").agg(whole.alias("body"))
    coded = _encode_here(pieces, "body", "ids", name, folder).select("uid", "piece", "ids")
    joined = coded.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    stitched = long.join(joined, "uid").drop("uid").toDF(*df.columns, out)
    return short.unionByName(stitched)


def with_text(df: DataFrame, ids: str, out: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``df`` with the text of a column of token ids: the raw bytes of the tokens, one after another; null for null."""
    base = df.drop(out)
    kept = [f"c{i}" for i in range(len(base.columns))]
    which = kept[base.columns.index(ids)]
    source = base.toDF(*kept)
    schema = T.StructType([*source.schema.fields, T.StructField("made", T.StringType())])

    def run(batches):
        for batch in batches:
            made = [None if x is None else decode(x, name, folder) for x in batch.column(which).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*base.columns, out)
