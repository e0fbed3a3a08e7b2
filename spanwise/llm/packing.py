"""Filling fixed-capacity containers with texts by lexical retrieval (problem 7).

Each shard has a BM25 inverted index of its texts' tokens. The longest unused text seeds a
container; its unused neighbours fill it greedily in the order of their BM25 scores, and what room
is left goes to the longest unused texts that still fit. Only a text above the capacity is divided: into full
containers, and a rest that is packed as a text of its own.

Plan: the corpus streams through Arrow batches without a shuffle. A shard is ``SHARD_DOCS`` texts or
``SHARD_TOKENS`` tokens of one partition in their order, so its index is bounded in memory and
recomputes alike when an executor is lost. Texts are tokenised once for all capacities.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_DOCS = 4096
SHARD_TOKENS = 4_000_000
# The usual BM25 parameters, and the pattern that splits text for the byte-level BPE vocabularies.
K1, B = 1.2, 0.75
#: Steps of a weight, and texts of a shard for each that has a term that goes into the table of frequent terms.
STEPS, FREQUENT = 256, 16
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """An encoding from a file of base64 tokens and ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class BM25:
    """Inverted index of token sequences with BM25 weights in its postings.

    A text's query has all of its terms. Postings of frequent terms, most of all, are one matrix product of the shard; those of the others
    are added for each query. Weights are whole steps, so that sums are exact and recompute alike.
    """

    def __init__(self, docs: Sequence[np.ndarray]) -> None:
        self.n = n = len(docs)
        length = np.array([len(d) for d in docs], np.int64)
        terms = np.concatenate(docs).astype(np.int64) if n else np.empty(0, np.int64)
        own = np.repeat(np.arange(n), length)
        pair, tf = np.unique(terms * max(1, n) + own, return_counts=True)
        term, doc = pair // max(1, n), pair % max(1, n)
        top = int(term.max()) + 1 if len(term) else 0
        df = np.bincount(term, minlength=top)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        weight = np.rint(STEPS * idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        frequent = (df > max(1, n // FREQUENT))[term]
        number = np.cumsum(df > max(1, n // FREQUENT)) - 1
        table = np.zeros((n, int(number[-1]) + 1 if top else 0), np.float32)
        table[doc[frequent], number[term[frequent]]] = weight[frequent]
        self.frequent = (table > 0).astype(np.float32) @ table.T
        rest = ~frequent & (df > 1)[term]
        term, self.doc, self.weight = term[rest], doc[rest], weight[rest]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=top))])
        order = np.argsort(self.doc, kind="stable")
        first = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.queries = [term[order[first[k] : first[k + 1]]] for k in range(n)]

    def neighbours(self, doc: int, among: np.ndarray | None = None) -> np.ndarray:
        """Texts, ``among`` a mask of them, that share a term with one, best first; ties by place."""
        score = self.frequent[doc].astype(np.float64)
        query = self.queries[doc]
        if len(query):
            spans = [slice(self.start[t], self.start[t + 1]) for t in query.tolist()]
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        hits = np.flatnonzero(score if among is None else score * among)
        return hits[np.argsort(-score[hits], kind="stable")]


def pack_shard(index: BM25, lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (text, first token, tokens); every token of every text is in exactly one."""
    full: list[list[tuple[int, int, int]]] = []
    size = lengths.copy()
    for k in np.flatnonzero(lengths > capacity).tolist():
        whole = int(lengths[k]) // capacity
        full += [[(k, p * capacity, capacity)] for p in range(whole)]
        size[k] = int(lengths[k]) - whole * capacity
    free = size > 0
    sizes = size.tolist()
    waiting = sorted((sizes[k], k) for k in np.flatnonzero(free).tolist())
    out = []
    while waiting:
        n, seed = waiting.pop()
        free[seed] = False
        box, room = [seed], capacity - n
        if waiting and room >= waiting[0][0]:
            for k in index.neighbours(seed, free & (size <= room)).tolist():
                if sizes[k] <= room:
                    box.append(k)
                    room -= sizes[k]
                    free[k] = False
                    waiting.pop(bisect_right(waiting, (sizes[k], k)) - 1)
                    if not waiting or room < waiting[0][0]:
                        break
            while waiting and room >= waiting[0][0]:
                n, k = waiting.pop(bisect_right(waiting, (room, len(sizes))) - 1)
                box.append(k)
                room -= n
                free[k] = False
        out.append([(k, int(lengths[k]) - sizes[k], sizes[k]) for k in box])
    return full + out


def pack(docs: DataFrame, id_col: str, text_col: str, targets: Sequence[tuple[int, int]], tokenizer_file: str = TOKENIZER) -> DataFrame:
    """(pack_id, container, place, id, first_token, n_tokens): every text in a container of each target size.

    targets: (pack_id, capacity in tokens). A text isn't divided unless it exceeds the capacity. Null and
    empty texts have no tokens and no row; repeated rows are packed each; ties keep the table's order; an empty table gives no rows.
    """
    if any(c < 1 for _, c in targets):
        raise ValueError("a capacity must be at least 1")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    kind = rows.schema["id"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(tokenizer_file)
        part = TaskContext.get().partitionId()
        ids: list = []
        docs: list[np.ndarray] = []
        held = shards = 0
        id_type = pa.int64()

        def flush() -> pa.RecordBatch:
            index = BM25(docs)
            lengths = np.array([len(d) for d in docs], np.int64)
            flat: list[tuple[int, str, int, int, int, int]] = []
            for pack_id, capacity in targets:
                for number, box in enumerate(pack_shard(index, lengths, capacity)):
                    flat += [(pack_id, f"{part}-{shards}-{number}", place, k, a, n) for place, (k, a, n) in enumerate(box)]
            cols = list(zip(*flat, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array([ids[k] for k in cols[3]], id_type), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                ["pack_id", "container", "place", "id", "first_token", "n_tokens"],
            )

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = np.array(enc.encode_ordinary(text), np.int32)
                ids.append(i)
                docs.append(tokens)
                held += len(tokens)
                if len(docs) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield flush()
                    ids, docs, held, shards = [], [], 0, shards + 1
        if docs:
            yield flush()

    return rows.mapInArrow(fill, f"pack_id int, container string, place int, id {kind}, first_token long, n_tokens long")


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens, and the share of their room that is used."""
    return packed.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).join(targets, "pack_id").withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def integrity(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(pack_id, n_texts, n_broken, n_divided, n_over) per target: texts placed, those whose parts leave a gap or overlap, those divided though they fit, containers over capacity."""
    parts = packed.join(targets, "pack_id").groupBy("pack_id", "capacity_tokens", "id").agg(
        F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("parts"), F.count_distinct("first_token").alias("starts"), F.sum("first_token").alias("at"), F.max("n_tokens").alias("most")
    )
    # parts are full but the last, so their starts are multiples of the largest part
    whole = (F.col("tokens") == F.col("end")) & (F.col("starts") == F.col("parts")) & (2 * F.col("at") == F.col("most") * F.col("parts") * (F.col("parts") - 1))
    texts = parts.groupBy("pack_id").agg(F.count("*").alias("n_texts"), F.count_if(~whole).alias("n_broken"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_divided"))
    boxes = packed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n")).join(targets, "pack_id").groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over"))
    return texts.join(boxes, "pack_id")
