"""Operator 7: removal of repeated runs of words, found by recompression.

1. A scan names the distinct texts and their first copies.
2. Each window of ``width`` words is anchored at an interior recompression symbol
   (see ``recompression``). Consecutive windows of one anchor form a unit; units
   are dealt by the anchor's name with a hash of all words they span. A unit that
   an earlier equal unit precedes is a repeat. Only where one symbol occurs with
   different surroundings, the first unit of each is compared window by window.
3. Texts with repeats are cut and hashed.

Words are compared by 64-bit hashes, units by their name and a 64-bit hash of all
words they span, windows by 96 bits; windows are judged on the input.

Defined results: a null or empty text has no words; fewer than ``width`` words
are never removed; a row without an id sorts last. Where an id is on several rows,
or several rows have none, each of their texts is a document of its own: they
follow each other by a hash of their words, and equal ones are one document. Of
copies of one text, all rows but those with the smallest id lose every word. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import SPACE, materialize, shuffle_partitions
from .recompression import anchors

LAST = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Ids that are broadcast at most; beyond it texts and ids meet by shuffle.
BROADCAST_IDS = 500_000
#: Words of texts, and windows, in one part of the shuffles.
PART_WORDS, PART_WINDOWS = 4_000_000, 1_000_000
_CHECK = (1 << 32) - 1


def _span(start: np.ndarray, size: np.ndarray, done: np.ndarray) -> np.ndarray:
    """One long: start of 31 bits, then 32 bits that hold size and done, or of a window more bits of its hash."""
    return (start << 32) | (size << 1) | done.astype(np.int64)


def _unspan(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 32, (span >> 1) & 0xFFFF, span & 1


def _texts(column: pa.Array):
    """(row, bytes of the words, word hashes, key of the word sequence) of each text."""
    for lo, hi, data, offsets in K.chunks(column):
        starts, ends, first = K.words(data, offsets)
        hashed = K.word_hashes(data, starts, ends, lower=False)
        yield lo, hi, data, starts, ends, first, hashed, _keys(hashed, first)


_POW = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C55, np.uint64))


def _spread(hashed: np.ndarray) -> np.ndarray:
    """Prefix sums of word hashes weighted by position, whose differences compare spans."""
    global _POW, _INV
    n = len(hashed)
    if len(_POW) < n + 1:
        _POW = np.multiply.accumulate(np.full(n + 1, 0x9E3779B97F4A7C55, np.uint64))
        _INV = np.multiply.accumulate(np.full(n + 1, int(K._BACK), np.uint64))
    return np.concatenate((np.zeros(1, K.U64), np.cumsum(hashed * _POW[:n], dtype=K.U64)))


_INV = np.multiply.accumulate(np.full(1 << 16, int(K._BACK), np.uint64))


def _spans_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix((total[b] - total[a]) * _INV[a] + (b - a).astype(K.U64))


def _keys(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(hashed) == 0:
        return np.zeros(len(first) - 1, K.U64)
    return _spans_hash(_spread(hashed), np.minimum(first[:-1], len(hashed) - 1), first[1:]) + (first[1:] > first[:-1]).astype(K.U64)


def _scan(batches):
    """(id, n, key, sha): words, key of the word sequence, digest of all words."""
    for batch in batches:
        n, key, sha = [], [], []
        for lo, hi, data, _, _, first, _, keys in _texts(batch.column("text")):
            n.append(np.diff(first))
            key.append(K.signed(keys))
            part = batch.column("text").slice(lo, hi - lo)
            sha.extend(hashlib.sha256(b" ".join(x.as_buffer().to_pybytes().split())).hexdigest() if x.is_valid else EMPTY_SHA for x in part)
        if n:
            yield pa.record_batch([batch.column("id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(key)), pa.array(sha)], ["id", "n", "key", "sha"])


def _is_later(doc: np.ndarray, version: np.ndarray, start: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether a place comes after that of ``lead``, the least place of its group."""
    return (doc != doc[lead]) | (version != version[lead]) | (start != start[lead])


def _first_of(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Mark as done the units that an equal earlier unit of the same task precedes."""
    name, block, doc, version, span = (np.concatenate(x) for x in zip(*rows, strict=True))
    start = span >> 32
    order = np.lexsort((start, version, doc, block, name))
    name, block, doc, version, span, start = (x[order] for x in (name, block, doc, version, span, start))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    lead = np.repeat(at, np.diff(np.append(at, len(name))))
    later = _is_later(doc, version, start, lead)
    # what is done needs no comparison, so it is dealt by its own place
    name = np.where(later, K.signed(K.mix((doc ^ version ^ span).view(K.U64))), name)
    return [name, block, doc, version, span | later]


def _units(width: int):
    names = ["name", "block", "doc", "version", "span"]

    def rows(batches):
        seen: dict[tuple[int, int], int] = {}
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            out = _first_of(held)
            for lo in range(0, len(out[0]), 100_000):
                yield pa.record_batch([pa.array(x[lo : lo + 100_000]) for x in out], names)

        for batch in batches:
            ids, versions = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("id", "version"))
            for lo, hi, _, _, _, first, hashed, keys in _texts(batch.column("text")):
                use = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(np.diff(first) >= width):
                    key, at = int(keys[i]), int(ids[lo + i])
                    if seen.get(key, LAST + 1) > at:
                        seen[key] = at
                        use[i] = True
                if not use.any():
                    continue
                counts = np.where(use, np.diff(first), 0)
                pick = np.repeat(use, np.diff(first))
                hashed = hashed[pick]
                first = np.concatenate(([0], np.cumsum(counts)))
                row = np.repeat(np.arange(hi - lo), counts)
                p, k, name = anchors(hashed, row, first, width)
                block = _spans_hash(_spread(hashed), p, p + k + width - 1)
                at = row[p]
                held.append([K.signed(name), K.signed(block), ids[lo + at], versions[lo + at], _span(p - first[at], k, np.zeros(len(p), bool))])
                size += len(p)
                if size > 400_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows


def _gathered(batches, names: list[str]) -> list[np.ndarray] | None:
    got = [[b.column(x).to_numpy() for x in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else None


def _repeats(batches):
    """Of all units of some names: (doc, version, span, state), 1 a repeat, 2 to be compared by windows."""
    got = _gathered(batches, ["name", "block", "doc", "version", "span"])
    if got is None:
        return
    out = lambda pick, state: pa.record_batch([*(pa.array(x[pick]) for x in (doc, version, span)), pa.array(np.full(pick.sum(), state, np.int8))], ["doc", "version", "span", "state"])
    name, block, doc, version, span = got
    ready = (span & 1) == 1
    if ready.any():
        yield out(ready, 1)
        name, block, doc, version, span = (x[~ready] for x in (name, block, doc, version, span))
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    name, block, doc, version, span = (x[order] for x in (name, block, doc, version, span))
    if len(name) == 0:
        return
    start = span >> 32
    order = np.lexsort((start, version, doc, block, name))
    name, block, doc, version, span, start = (x[order] for x in (name, block, doc, version, span, start))
    new_name = np.concatenate(([True], name[1:] != name[:-1]))
    new_block = new_name | np.concatenate(([True], block[1:] != block[:-1]))
    at = np.flatnonzero(new_block)
    repeat = _is_later(doc, version, start, np.repeat(at, np.diff(np.append(at, len(name)))))
    heads = np.flatnonzero(new_name)
    blocks = np.add.reduceat(new_block.astype(np.int64), heads)
    mixed = np.repeat(blocks > 1, np.diff(np.append(heads, len(name))))
    for state, pick in ((1, repeat), (2, ~repeat & mixed)):
        if pick.any():
            yield out(pick, state)


def _own(batch, at: int) -> np.ndarray:
    """The spans that came with row ``at``."""
    return np.asarray(batch.column("spans")[at].values.to_numpy(zero_copy_only=False), np.int64)


def _windows(width: int):
    """(name, doc, version, span) of all windows of the spans; the low half of a span holds more of the window's hash."""

    def rows(batches):
        for batch in batches:
            ids, versions = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("id", "version"))
            for lo, hi, _, _, _, first, hashed, _ in _texts(batch.column("text")):
                if len(hashed) < width:
                    continue
                total, other = _spread(hashed), _spread(K.mix(hashed + K.U64(0x632BE59BD9B4E019)))
                out: list[list[np.ndarray]] = []
                for i in range(hi - lo):
                    span = _own(batch, lo + i)
                    start, size, _ = _unspan(span)
                    p = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    a = p + first[i]
                    check = (_spans_hash(other, a, a + width) & K.U64(_CHECK)).astype(np.int64)
                    out.append([K.signed(_spans_hash(total, a, a + width)), np.full(len(p), ids[lo + i]), np.full(len(p), versions[lo + i]), (p << 32) | check])
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["name", "doc", "version", "span"])

    return rows


def _later(batches):
    """(doc, version, span) of all but the first of each window."""
    got = _gathered(batches, ["name", "doc", "version", "span"])
    if got is None:
        return
    name, doc, version, span = got
    start, check = span >> 32, span & _CHECK
    order = np.lexsort((start, version, doc, check, name))
    name, check, doc, version, start = (x[order] for x in (name, check, doc, version, start))
    at = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (check[1:] != check[:-1]))))
    later = _is_later(doc, version, start, np.repeat(at, np.diff(np.append(at, len(name)))))
    some = start[later]
    yield pa.record_batch([pa.array(doc[later]), pa.array(version[later]), pa.array(_span(some, np.ones(len(some), np.int64), np.zeros(len(some), bool)))], ["doc", "version", "span"])


def _cut(width: int):
    def rows(batches):
        for batch in batches:
            out = []
            for lo, hi, data, starts, ends, first, _, keys in _texts(batch.column("text")):
                raw = data.tobytes()
                for i in range(hi - lo):
                    start, size, _ = _unspan(_own(batch, lo + i))
                    n = first[i + 1] - first[i]
                    gone = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + size + width - 1, minlength=n + 1))[:n] > 0
                    keep = np.flatnonzero(~gone) + first[i]
                    text = b" ".join(raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
                    out.append((batch.column("id")[lo + i].as_py(), int(K.signed(keys[i : i + 1])[0]), int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4])], ["id", "key", "n_removed", "sha", "kept"])

    return rows


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts that have spans, with the list of them (no longer than the text)."""
    ids = materialize(spans.select("doc", "version").distinct(), "ids")
    own = lambda other: (docs["id"] == other["doc"]) & (docs["version"] == other["version"])
    some = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, own(ids), "left_semi")
    lists = spans.groupBy("doc", "version").agg(F.collect_list("span").alias("spans")).withColumnRenamed("version", "v")
    return some.join(lists, (some["id"] == lists["doc"]) & (some["version"] == lists["v"])).select("id", "version", "text", "spans")


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, kept_sha256 (and ``kept``, the words left)."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    seen = materialize(docs.mapInArrow(_scan, "id long, n long, key long, sha string"), "texts")
    once = seen.groupBy("id").count().where("count > 1").isEmpty()
    # an id alone names a text; else a hash of its words goes with it
    version = F.lit(0).cast("long") if once else F.xxhash64(F.trim(F.regexp_replace("text", SPACE, " ")))
    told = docs.where("text is not null").withColumn("version", version)
    place = "doc long, version long, span long"
    parts = max(shuffle_partitions(docs.sparkSession), -(-(seen.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    units = told.mapInArrow(_units(width), f"name long, block long, {place}")
    found = materialize(units.repartition(parts, "name").mapInArrow(_repeats, f"{place}, state byte"), "units")
    mixed = found.where("state = 2").select("doc", "version", "span")
    windows = mixed.agg(F.sum(F.expr("shiftright(span, 1) & 65535"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-windows // PART_WINDOWS))
    opened = _with_spans(told, mixed).mapInArrow(_windows(width), f"name long, {place}").repartition(parts, "name")
    gone = found.where("state = 1").select("doc", "version", "span").union(opened.mapInArrow(_later, place))
    gone = materialize(gone, "repeats")
    cut = _with_spans(told, gone).mapInArrow(_cut(width), "id long, key long, n_removed long, sha string, kept string")
    if not with_text:
        cut = cut.drop("kept")
    cut = materialize(cut.dropDuplicates(["id", "key"]), "cut")
    first = seen.groupBy("key").agg(F.min("id").alias("first"))
    out = seen.join(first, "key").join(cut.withColumnRenamed("sha", "cut_sha"), ["id", "key"], "left")
    copy = (F.col("n") >= width) & (F.col("id") > F.col("first"))
    cols = [
        F.when(F.col("id") != LAST, F.col("id")).alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)
