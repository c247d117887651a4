"""Filling fixed-capacity containers with documents: cost-balanced packing."""

from __future__ import annotations

import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import rows_of, spill

CAPACITY = 2_048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pre-tokenisation of the vocabulary above (fixed value, as published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that one packing task holds; the last container of each is all that a larger one could fill better.
SHARD_DOCS = 50_000
#: Attention cost of a token pair against the linear cost of a token.
QUADRATIC = 1 / 2_048


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a vocabulary of ranks; a Python worker builds it once for all its tasks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: doc_id, text_hash (of 128 bits), tokens. Null text counts as empty.

    The vocabulary at ``path`` is sent to the executors, where it need not lie at the same place.
    """
    docs.sparkSession.sparkContext.addFile(path)

    def run(batches):
        enc = encoder(SparkFiles.get(os.path.basename(path)), pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "text_hash", "tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.md5(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash string, tokens bigint")


def pack(sizes: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> tuple[np.ndarray, int]:
    """Container of each item (none above the capacity), and the number of containers.

    As many containers as the total needs are open from the start. Items go in descending cost ``n + quadratic * n**2`` to
    the container of lowest cost among those with room; where none has room, a further container is opened.
    """
    into = np.zeros(len(sizes), np.int64)
    count = int(-(-sizes.sum() // capacity))
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, b) for b in range(count)]
    best = np.full(capacity + 1, np.inf)
    best[capacity] = 0.0 if count else np.inf
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        room = n + int(best[n:].argmin())
        if best[room] == np.inf:
            room, cost, b = capacity, 0.0, count
            count += 1
        else:
            cost, b = heapq.heappop(heaps[room])
            best[room] = heaps[room][0][0] if heaps[room] else np.inf
        into[i] = b
        left, cost = room - n, cost + n + quadratic * n * n
        heapq.heappush(heaps[left], (cost, b))
        best[left] = heaps[left][0][0]
    return into, count


def fill_containers(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, pattern: str = PATTERN, quadratic: float = QUADRATIC, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into containers of ``capacity`` tokens: doc_id, part, container, tokens, doc_tokens.

    A text within the capacity is never divided. A longer one fills whole containers of its own with parts 0, 1, ...;
    its rest is packed like a document. Containers are named ``shard-number``. Rows repeating a ``doc_id`` with the same text
    are one document, with another text one more; null and empty texts take no room but have a container.
    Empty input gives no rows. Extra columns are not read.

    Documents are counted, then spread by hash over shards of about ``shard_docs``, each packed by one task, so that
    no task grows with the corpus. A shard leaves no more than its last containers partly filled.
    """
    counted = spill(token_counts(docs, path, pattern, id_col, text_col).dropDuplicates(["doc_id", "text_hash"]))
    shards = max(1, -(-rows_of(counted) // shard_docs))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
        shard = table.column("shard")[0].as_py()
        tokens = table.column("tokens").to_numpy()
        rest = tokens % capacity
        rest[(rest == 0) & (tokens > 0)] = capacity
        whole = (tokens - rest) // capacity
        into, count = pack(rest, capacity, quadratic)
        at = np.repeat(np.arange(len(tokens)), whole)
        begin = np.cumsum(whole) - whole
        row = np.concatenate([at, np.arange(len(tokens))])
        container = np.concatenate([count + np.arange(len(at)), into])
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(row)),
            "part": pa.array(np.concatenate([np.arange(len(at)) - begin[at], whole]), pa.int32()),
            "container": pa.array([f"{shard}-{c}" for c in container]),
            "tokens": pa.array(np.concatenate([np.full(len(at), capacity), rest]), pa.int64()),
            "doc_tokens": pa.array(tokens[row], pa.int64()),
        })

    return counted.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "doc_id bigint, part int, container string, tokens bigint, doc_tokens bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers, tokens, the least number of containers possible, fill (share of the space used)."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("part") == 0).alias("documents"))
    whole = per.agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return whole.select("documents", "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"))
