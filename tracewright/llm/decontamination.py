"""Operator 8: benchmark decontamination by BM25 with block-max pruning.

Test items are the indexed side and training passages are the queries. Every
document is cut into passages of ``2 * stride`` words at every ``stride`` words,
with ``stride`` the length of the longest item, so any item that occurs lies
whole in some passage. A passage's score for an item is its BM25 over distinct
shared terms, divided by the score the item gives itself, so one threshold
serves all items. A passage is dropped when the sum of its terms' largest
impacts is below the threshold, then each block of items by its block maxima;
the items left are scored exactly from their postings. All (passage, item) at or
above the threshold are verified: shares of the item's question (all but its last
sentence) and answer word n-grams that occur in the passage.

The index holds the benchmark, which is broadcast in shards of bounded size: each
shard is one pass over the documents, so its size does not limit the benchmark.
Term statistics are sums over the benchmark's table and each shard is built in a
task; driver and executors hold one finished shard at a time.
The documents are only mapped, without an exchange.

Defined results: null or empty texts and items match nothing; items shorter than
an n-gram match as one n-gram; rows with null ids are compared too and keep the
null; repeated rows give repeated results, one row for each document and item
with the best passage (the first of equal ones). Only the id and text columns are
read.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import materialize

K1, B_LENGTH, BLOCK, GRAM = 1.2, 0.75, 16, 3
RETRIEVE, OVERLAP = 0.6, 0.7
#: Words of items in one broadcast shard.
SHARD_WORDS = 500_000
_SENTENCE = re.compile(rb"[.?!]+[\x20\x09-\x0D]+|[\x0A\x0D]+")


@dataclass
class Index:
    """Postings of one shard: terms sorted by hash; ``start`` bounds each term's postings."""

    ids: list
    stride: int
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def _hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    return K.word_hashes(data, starts, ends, lower=True)


def _grams(hashed: np.ndarray) -> np.ndarray:
    return K.shingle_set(hashed, GRAM)


def split_item(text: str) -> tuple[bytes, bytes]:
    """The question and the answer: all before the last sentence, and that; a third if there is one."""
    raw = text.encode().strip(b"\t\n\x0b\x0c\r ")
    ends = [m.end() for m in _SENTENCE.finditer(raw) if m.end() < len(raw)]
    if ends:
        return raw[: ends[-1]], raw[ends[-1] :]
    words = raw.split()
    at = -(-2 * len(words) // 3)
    return b" ".join(words[:at]), b" ".join(words[at:])


def build_index(items: list[tuple[object, str]], stride: int, df: dict[int, int], total: int, mean: float) -> Index:
    """The index of ``items(id, text)``; document frequencies and lengths are of the whole benchmark."""
    term, item, impact, question, answer = [], [], [], [], []
    for i, (_, text) in enumerate(items):
        hashed, count = np.unique(_hashes(text.encode()), return_counts=True)
        seen = np.array([df[int(h)] for h in hashed], float)
        idf = np.log1p((total - seen + 0.5) / (seen + 0.5))
        w = idf * count * (K1 + 1) / (count + K1 * (1 - B_LENGTH + B_LENGTH * count.sum() / mean))
        term.append(hashed)
        item.append(np.full(len(hashed), i))
        impact.append(w / w.sum())
        q, a = split_item(text)
        question.append(_grams(_hashes(q)))
        answer.append(_grams(_hashes(a)))
    term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    terms, start = np.unique(term, return_index=True)
    block = item // BLOCK
    head = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    block_start = np.searchsorted(head, np.append(start, len(term)))
    return Index(
        [x for x, _ in items], stride, terms, np.append(start, len(term)), item, impact,
        block_start, block[head], np.maximum.reduceat(impact, head), np.maximum.reduceat(impact, start), question, answer,
    )


def _expand(at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the list entries of each of ``at``, and which of them each belongs to."""
    size = start[at + 1] - start[at]
    owner = np.repeat(np.arange(len(at)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[at][owner], owner


def search(index: Index, hashed: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word of the passage in the row, item, score) at or above the threshold."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))
    count = np.diff(first)
    cells = -(-count // index.stride)
    cell_first = np.concatenate(([0], np.cumsum(cells)))
    n_cells = int(cell_first[-1])
    if n_cells == 0:
        return none
    at = np.minimum(np.searchsorted(index.terms, hashed), len(index.terms) - 1)
    word = np.flatnonzero(index.terms[at] == hashed)
    term = at[word]
    row = np.searchsorted(first, word, "right") - 1
    cell = cell_first[row] + (word - first[row]) // index.stride
    key = np.unique(cell * len(index.terms) + term)
    cell, term = key // len(index.terms), key % len(index.terms)
    last = np.zeros(n_cells + 1, bool)  # whether a cell is the last of its row
    last[cell_first[1:][cells > 0] - 1] = True
    last[n_cells] = True

    def passages(x: np.ndarray) -> np.ndarray:
        """Sums of each cell with the next of its row, over the first axis."""
        out = x.copy()
        out[:-1] += np.where(last[: n_cells - 1].reshape(-1, *[1] * (x.ndim - 1)), 0, x[1:])
        return out

    near = threshold * (1 - 1e-9)
    live = passages(np.bincount(cell, index.term_max[term], n_cells)) >= near
    if not live.any():
        return none
    needed = live.copy()
    needed[1:] |= live[:-1] & ~last[: n_cells - 1]
    use = needed[cell]
    cell, term = cell[use], term[use]
    # block maxima of the cells left
    place = np.cumsum(needed) - 1
    n_blocks = int(index.block.max()) + 1
    entry, owner = _expand(term, index.block_start)
    left = int(place[-1]) + 1
    bound = np.zeros((left + 1, n_blocks))
    bound[:left] = np.bincount(place[cell[owner]] * n_blocks + index.block[entry], index.block_max[entry], left * n_blocks).reshape(left, n_blocks)
    starts = np.flatnonzero(live)
    after = np.where(last[starts], left, place[np.minimum(starts + 1, n_cells - 1)])
    hit, block = np.nonzero(bound[place[starts]] + bound[after] >= near)
    if len(hit) == 0:
        return none
    # exact scores of the items in those blocks
    cut = np.searchsorted(cell, np.arange(n_cells + 1))
    found = []
    n_items = len(index.ids)
    for lo in range(0, len(hit), 2048):
        c, b = starts[hit[lo : lo + 2048]], block[lo : lo + 2048]
        end = np.where(last[c], c + 1, c + 2)
        from_ = np.concatenate(([0], np.cumsum(cut[end] - cut[c])))
        pos, owner = _expand(np.arange(len(c)), from_)
        pos += (cut[c] - from_[:-1])[owner]
        both = np.unique(owner * len(index.terms) + term[pos])
        owner, t = both // len(index.terms), both % len(index.terms)
        entry, of = _expand(t, index.start)
        inside = index.item[entry] // BLOCK == b[owner[of]]
        entry, of = entry[inside], owner[of[inside]]
        key, back = np.unique(of * n_items + index.item[entry], return_inverse=True)
        score = np.bincount(back, index.impact[entry])
        ok = score >= near
        found.append((c[key[ok] // n_items], key[ok] % n_items, score[ok]))
    c, item, score = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(cell_first, c, "right") - 1
    return row, (c - cell_first[row]) * index.stride, item, score


def _share(grams: np.ndarray, passage: np.ndarray) -> float:
    return len(np.intersect1d(grams, passage, assume_unique=True)) / len(grams) if len(grams) else 1.0


def _verified(index: Index, column: pa.Array, threshold: float, overlap: float):
    """Yield (row, item, first word, score, question share, answer share), the best of each row and item."""
    for lo, _, data, offsets in K.chunks(column):
        starts, ends, first = K.words(data, offsets)
        hashed = K.word_hashes(data, starts, ends, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for row, start, item, score in zip(*(x.tolist() for x in search(index, hashed, first, threshold)), strict=True):
            words = hashed[first[row] + start : min(first[row] + start + 2 * index.stride, first[row + 1])]
            q = _share(index.question[item], _part_grams(words, index.question[item]))
            a = _share(index.answer[item], _part_grams(words, index.answer[item]))
            if min(q, a) >= overlap and (q + a, score) > best.get((row, item), ((-1.0, -1.0),))[0]:
                best[row, item] = ((q + a, score), start, score, q, a)
        for (row, item), (_, *rest) in sorted(best.items()):
            yield lo + row, item, *rest


def _matches(held, threshold: float, overlap: float, item_type: pa.DataType):
    def rows(batches):
        index: Index = held.value
        for batch in batches:
            out = [(batch.column("id")[r].as_py(), index.ids[i], *rest) for r, i, *rest in _verified(index, batch.column("text"), threshold, overlap)]
            if out:
                ids, items, start, score, q, a = zip(*out, strict=True)
                yield pa.record_batch(
                    [pa.array(ids, batch.schema.field("id").type), pa.array(items, item_type), pa.array(start, pa.int64()), *(pa.array(np.round(x, 6)) for x in (score, q, a))],
                    ["id", "item", "first_word", "score", "question_overlap", "answer_overlap"],
                )

    return rows


def _part_grams(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """n-grams of a passage; where the part is shorter than one, all its shorter runs."""
    whole = np.unique(K.gram_hashes(words, GRAM))
    if len(grams) == 1:
        short = [K.mix(K.gram_hashes(words, k) + K.U64(k)) for k in range(1, GRAM)]
        whole = np.unique(np.concatenate([whole, *short]))
    return whole


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = RETRIEVE, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, first_word, score, question_overlap, answer_overlap) of each document that holds an item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = docs.schema["id"].dataType.simpleString()
    names = [id_col, item_col, "first_word", "score", "question_overlap", "answer_overlap"]
    item = benchmark.schema[item_col].dataType
    schema = f"id {kind}, item {item.simpleString()}, first_word long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, item_col, text_col):
        held = spark.sparkContext.broadcast(index)
        # each shard's matches are written before the next shard's index is read, so one index is held at a time
        found = found.union(materialize(docs.mapInArrow(_matches(held, threshold, overlap, to_arrow_type(item)), schema), "leaks"))
        held.unpersist()
    return found.toDF(*names)


def _measured(batches):
    """(part, place, id, text, n) of the items that have words, with their place in the task."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.array([len(_hashes(x.as_py().encode())) for x in batch.column("text")], np.int64)
        use = pa.array(n > 0)
        ids, text, n = batch.column("id").filter(use), batch.column("text").filter(use), n[n > 0]
        where = pa.array(np.arange(place, place + len(n)))
        place += len(n)
        yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), where, ids, text, pa.array(n)], ["part", "place", "id", "text", "n"])


def _terms(batches):
    """(shard, term) of each distinct term of each item."""
    for batch in batches:
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
            term = np.unique(_hashes(text.encode()))
            yield pa.record_batch([pa.array(np.full(len(term), shard, np.int64)), pa.array(K.signed(term))], ["shard", "term"])


def _built(stride: int, total: int, mean: float):
    """The pickled index of one shard from its items and the document frequencies of its terms."""

    def build(items: pa.Table, df: pa.Table) -> pa.Table:
        items = items.sort_by([("part", "ascending"), ("place", "ascending")])
        held = list(zip(items.column("id").to_pylist(), items.column("text").to_pylist(), strict=True))
        seen = dict(zip(df.column("term").to_numpy().view(K.U64).tolist(), df.column("df").to_pylist(), strict=True))
        index = build_index(held, stride, seen, total, mean)
        return pa.table({"shard": items.column("shard").slice(0, 1), "index": pa.array([pickle.dumps(index)], pa.binary())})

    return build


def _indexes(benchmark: DataFrame, item_col: str, text_col: str):
    """Index shards of at most about SHARD_WORDS words; statistics are of all items, those without an id too.

    Items are numbered by a prefix sum of their words, which cuts the shards. A
    shard's index is built in a task and comes to the driver alone.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    items = materialize(items.mapInArrow(_measured, f"part int, place long, id {kind}, text string, n long"), "items")
    whole = items.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    if not whole.total:
        return
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    parts = items.groupBy("part").agg(F.sum("n").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("n").over(inside) - F.col("n")
    items = materialize(items.join(parts, "part").withColumn("shard", F.floor(start / SHARD_WORDS).cast("long")), "shards")
    terms = items.select("shard", "text").mapInArrow(_terms, "shard long, term long").groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df"))
    terms = materialize(terms, "terms")
    df = terms.groupBy("term").agg(F.sum("df").alias("df"))
    df = terms.select("shard", "term").join(df, "term")
    built = items.select("shard", "part", "place", "id", "text").groupBy("shard").cogroup(df.groupBy("shard"))
    built = materialize(built.applyInArrow(_built(whole.longest, whole.total, whole.words / whole.total), "shard long, index binary"), "indexes")
    for row in sorted(built.select("shard").collect()):
        yield pickle.loads(built.where(F.col("shard") == row.shard).first()["index"])


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = RETRIEVE, overlap: float = OVERLAP, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    held = None
    for index in _indexes(benchmark, item_col, text_col):
        if held is not None:  # written before the next shard, so one index is held at a time
            docs = materialize(docs, "clean")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~_holds(held, threshold, overlap)(F.col(text_col)))
    return docs


def _holds(held, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        found = np.zeros(len(text), bool)
        for row, *_ in _verified(held.value, pa.Array.from_pandas(text, type=pa.string()), threshold, overlap):
            found[row] = True
        return pd.Series(found)

    return holds
