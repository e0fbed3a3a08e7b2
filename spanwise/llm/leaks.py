"""Evaluation texts leaking into training text (problem 8).

A document gives an item away when ``width`` words in a row of it stand in a row in a text of the
item. Words are runs of letters and digits in lower case.

Each training shard has an FM-index of its words: all phrases of ``width`` test words go through the
wavelet-tree ranks backwards at once, a phrase dropping out where its interval empties; occurrences
are located from sampled suffix positions and merged into removal spans. Words that no test text
has can't be in a match and split the shard's sequence; stretches shorter than ``width`` words
aren't indexed.

Plan: the test items are brought to the driver in blocks of about ``BLOCK_CHARS``
characters, one pass over the corpus a block; all texts of an item are in one block, so its spans come out merged whatever the
number of blocks, and a block is released when its pass is done. The corpus streams through Arrow batches without a shuffle, a
shard being a bounded number of indexed words of one partition. Whole documents, no caps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm._fm_index import FMIndex
from spanwise.runtime import materialize

#: Characters of test texts that are broadcast at a time (some 25 bytes each on the driver and in a task).
BLOCK_CHARS = 8_000_000
#: Indexed words of a shard.
SHARD_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


class Phrases:
    """All phrases of ``width`` words of a block of test texts."""

    def __init__(self, texts: list[tuple[str, str]], width: int) -> None:
        self.width = width
        self.ids: dict[str, int] = {}
        self.items = sorted({i for i, _ in texts})
        number = {i: k for k, i in enumerate(self.items)}
        rows, owners = [], []
        for item, text in texts:
            seq = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in _WORD.findall(text.lower())], np.int32)
            if len(seq) >= width:
                own = np.lib.stride_tricks.sliding_window_view(seq, width)
                rows.append(own)
                owners.append(np.full(len(own), number[item], np.int32))
        if not rows:
            self.table, self.owner, self.start = np.empty((0, width), np.int32), np.empty(0, np.int32), np.zeros(1, np.int64)
            return
        self.table, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(owners)], axis=1), axis=0)
        self.owner = pairs[:, 1].astype(np.int32)
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.table) + 1))

    def stretches(self, text: str) -> list[tuple[int, np.ndarray]]:
        """(first word, word numbers) of the document's stretches that could hold a phrase."""
        get = self.ids.get
        seq = np.array([get(w, 0) for w in _WORD.findall(text.lower())], np.int32)
        if len(seq) < self.width:
            return []
        gaps = np.flatnonzero(np.concatenate([[0], seq, [0]]) == 0)
        long = np.flatnonzero(np.diff(gaps) > self.width)
        return [(int(gaps[k]), seq[gaps[k] : gaps[k + 1] - 1]) for k in long]


def _matches(phrases: Phrases, docs: list[list[tuple[int, np.ndarray]]]) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(document's number, item, merged spans of words [first, end)) of one shard."""
    parts, starts, own, offset, at = [], [], [], [], 0
    for k, stretches in enumerate(docs):
        for first, seq in stretches:
            parts += [seq.astype(np.int64) + 1, np.ones(1, np.int64)]
            starts.append(at)
            own.append(k)
            offset.append(first)
            at += len(seq) + 1
    if not parts:
        return []
    index = FMIndex(np.concatenate(parts))
    low, high = index.search(phrases.table.astype(np.int64) + 1)
    found = np.flatnonzero(high > low)
    if not len(found):
        return []
    size = high[found] - low[found]
    phrase = np.repeat(found, size)
    rank = np.repeat(low[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    place = index.locate(rank)
    which = np.searchsorted(starts, place, side="right") - 1
    doc, word = np.array(own)[which], place - np.array(starts)[which] + np.array(offset)[which]
    owners = phrases.start[phrase + 1] - phrases.start[phrase]
    pick = np.repeat(phrases.start[phrase] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(owners.sum())
    rows = np.stack([np.repeat(doc, owners), phrases.owner[pick], np.repeat(word, owners)], axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    out: list[tuple[int, str, list[tuple[int, int]]]] = []
    for d, item, w in rows.tolist():
        end = w + phrases.width
        if not out or out[-1][0] != d or out[-1][1] != phrases.items[item]:
            out.append((d, phrases.items[item], [(w, end)]))
        elif out[-1][2][-1][1] >= w:
            out[-1][2][-1] = (out[-1][2][-1][0], end)
        else:
            out[-1][2].append((w, end))
    return out


def _block(docs: DataFrame, kind: str, sent: Broadcast, shard_words: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = sent.value
        ids, shard, size = [], [], 0

        def flush() -> pa.RecordBatch:
            found = _matches(ph, shard)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _, _ in found], id_type), pa.array([i for _, i, _ in found], pa.string()), pa.array([sum(e - s for s, e in x) for _, _, x in found], pa.int64()), pa.array([[{"first": s, "end": e} for s, e in x] for _, _, x in found], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                ["id", "item", "n_words", "spans"],
            )

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = ph.stretches(text)
                if found:
                    ids.append(i)
                    shard.append(found)
                    size += sum(len(x) + 1 for _, x in found)
                if size >= shard_words:
                    yield flush()
                    ids, shard, size = [], [], 0
        if shard:
            yield flush()

    return docs.mapInArrow(scan, f"id {kind}, item string, n_words long, spans array<struct<first:long,end:long>>")


def leaked(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_texts: tuple[str, ...], width: int = 13, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, item, n_words, spans): each document with each item it gives away, and the spans of words to remove.

    Spans are merged and count words from 0. Null and empty texts and null items match nothing; repeated
    documents are all reported, repeated rows of one id in a row each; an empty table on either side gives
    no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= 2 * width - 1)
    kind = rows.schema["id"].dataType.simpleString()
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.explode(F.array(*[F.col(c).cast("string") for c in item_texts])).alias("text"))
    tests = tests.where("item is not null").where(F.length("text") >= 2 * width - 1)
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(1 + chars // block_chars)
    sc = docs.sparkSession.sparkContext
    parts = []
    for k in range(blocks):
        block = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        sent = sc.broadcast(Phrases([(r["item"], r["text"]) for r in block.toLocalIterator()], width))
        found = _block(rows, kind, sent, shard_words)
        if blocks > 1:
            found = materialize(found)
            sent.destroy()
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def held_out(items: DataFrame, split_col: str = "split") -> DataFrame:
    """Items whose split isn't 'train'; null and blank ones are held out."""
    return items.where(F.coalesce(F.lower(F.trim(F.col(split_col))), F.lit("")) != "train")
