"""Operator 11: how the sources of a language differ in their words.

1. A pass over the texts adds up, in each task, how many documents of a language
   hold each term; the terms of at least three are kept. A range sort by language
   and UTF-8 bytes gives every kept term its ordinal.
2. The terms that most documents hold, ``VOCABULARY_BYTES`` of UTF-8 at most,
   become a minimal acyclic transducer for each language (``transducer.py``).
   This bounded vocabulary is broadcast, and a second pass streams all texts
   through it: a word that ends in a final state counts for its ordinal, and
   tasks emit (language, source, ordinal, count). Kept terms beyond the bound, or
   longer than ``LONGEST`` bytes, are counted exactly by an exchange of the words
   that the transducer does not hold, added up in each task before.
3. Sources are compared in tiles of ``TILE`` ordinals by two blocks of at most
   ``BLOCK`` sources, as whole arrays; tiles are added up. Terms are ranked by
   value, then ordinal, which is the order of their UTF-8 bytes.

All arithmetic is of whole numbers; products that may pass 64 bits use decimals.

Defined results: null text, language and source are empty; every row is a document
of its own, also if it repeats another or has no id; a language without kept terms
gives pairs of value 0; a language of one source gives no pairs; an empty table
gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import transducer as T
from .common import materialize, shuffle_partitions

#: The transducer holds terms of at most so many bytes together.
VOCABULARY_BYTES = 8 << 20
LONGEST = 64
CHUNK = 4 << 20
TILE, BLOCK = 8192, 64
#: Counts that a task holds before it hands them on.
HELD = 1 << 21
_SOLID = np.zeros(256, bool)
_SOLID[0x41:0x5B] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, starts, ends and rows of all terms."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = _SOLID[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return K._LOWER[data], starts, ends, row


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings; they are in order and do not overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def _codes(*columns: pa.Array) -> tuple[np.ndarray, pa.Table]:
    """A number for each row by the values of ``columns``, and these values."""
    each = [pc.dictionary_encode(pc.fill_null(c, "")) for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for e in each:
        key = key * max(len(e.dictionary), 1) + e.indices.to_numpy()
    values, first, code = np.unique(key, return_index=True, return_inverse=True)
    return code, pa.table([pc.fill_null(c, "").take(pa.array(first)) for c in columns], [f"c{i}" for i in range(len(columns))])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many of ``docs(lang, source, text)`` each term of a language occurs."""

    def rows(batches):
        for batch in batches:
            code, langs = _codes(batch.column("lang"))
            for lo, hi, data, offsets in K.chunks(batch.column("text"), CHUNK):
                data, starts, ends, row = terms_of(data, offsets)
                if not len(starts):
                    continue
                words = spans(data, starts, ends).dictionary_encode()
                size = len(words.dictionary)
                held = np.unique(row * size + words.indices.to_numpy())  # one for each term of a document
                key, n = np.unique(code[lo:hi][held // size] * size + held % size, return_counts=True)
                yield pa.record_batch([langs["c0"].take(pa.array(key // size)).combine_chunks(), words.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n)], ["lang", "term", "n"])

    parts = docs.select("lang", "text").mapInArrow(rows, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, ordinal, n) of the terms in at least ``least`` documents of their language; ordinals ascend by language and term."""
    kept = materialize(document_counts(docs).where(F.col("n") >= least), "kept")
    dealt = kept.repartitionByRange(shuffle_partitions(kept.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted")
    # the id is the partition's number and the place in it
    part, place = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("size"))  # one row for each partition
    first = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(first, F.lit(0)).alias("first"))
    return dealt.withColumn("part", part).join(F.broadcast(offsets), "part").select("lang", "term", (F.col("first") + place).alias("ordinal"), "n")


def bounded_share(words: DataFrame, limit: int) -> int:
    """The least class of document counts, eight for each doubling, whose terms and those above have ``limit`` bytes at most."""
    length = F.octet_length("term")
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = words.where(length <= LONGEST).groupBy(level.alias("level")).agg(F.sum(length).alias("bytes")).collect()  # at most 512 rows
    total, least = 0, 1 << 20
    for level, size in sorted(sizes, reverse=True):
        total += size
        if total > limit:
            break
        least = level
    return least


def build_transducers(words: DataFrame) -> tuple[list[str], T.Transducer] | None:
    """Languages and their transducers over ``words(lang, term, ordinal)``, built in one task for each language."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        made = T.build(x.encode() for x in frame["term"])._replace(ordinals=frame["ordinal"].to_numpy())
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "made": [pickle.dumps(tuple(made))]})

    got = words.groupBy("lang").applyInPandas(build, "lang string, made binary").orderBy("lang").collect()  # bounded by VOCABULARY_BYTES
    return ([r.lang for r in got], T.union([T.Transducer(*pickle.loads(r.made)) for r in got])) if got else None


def stream_counts(docs: DataFrame, held, with_rest: bool) -> DataFrame:
    """(lang, source, ordinal, term, n): words of the broadcast transducers by ordinal, others by term if ``with_rest``."""
    schema, most = "lang string, source string, ordinal long, term string, n long", HELD

    def rows(batches):
        langs, made = held.value
        number = {x: i for i, x in enumerate(langs)}
        size = max(len(made.ordinals), 1)
        groups: dict[tuple[str, str], int] = {}
        keys, counts, waiting = [], [], 0

        def merged():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        def emit(key, n):
            names = list(groups)
            lang, source = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
            for lo in range(0, len(key), 1 << 16):
                k = key[lo : lo + (1 << 16)]
                at = pa.array(k // size)
                yield pa.record_batch([lang.take(at), source.take(at), pa.array(made.ordinals[k % size]), pa.nulls(len(k), pa.string()), pa.array(n[lo : lo + (1 << 16)])], ["lang", "source", "ordinal", "term", "n"])

        for batch in batches:
            code, values = _codes(batch.column("lang"), batch.column("source"))
            pairs = list(zip(values["c0"].to_pylist(), values["c1"].to_pylist()))
            group = np.array([groups.setdefault(x, len(groups)) for x in pairs], np.int64)
            which = np.array([number.get(x[0], -1) for x in pairs], np.int64)
            for lo, hi, data, offsets in K.chunks(batch.column("text"), CHUNK):
                data, starts, ends, row = terms_of(data, offsets)
                if not len(starts):
                    continue
                of = code[lo:hi][row]
                at = T.walk(made, data, starts, ends, which[of])
                hit = at >= 0
                key, n = np.unique(group[of[hit]] * size + at[hit], return_counts=True)
                keys.append(key)
                counts.append(n)
                waiting += len(key)
                if waiting > most:
                    key, n = merged()
                    if len(key) > most // 2:
                        yield from emit(key, n)
                        keys, counts, waiting, groups = [], [], 0, {}
                        group = np.array([groups.setdefault(x, len(groups)) for x in pairs], np.int64)
                    else:
                        keys, counts, waiting = [key], [n], len(key)
                if with_rest and not hit.all():
                    words = spans(data, starts[~hit], ends[~hit]).dictionary_encode()
                    wide = len(words.dictionary)
                    key, n = np.unique(of[~hit] * wide + words.indices.to_numpy(), return_counts=True)
                    at = pa.array(key // wide)
                    yield pa.record_batch([values["c0"].take(at).combine_chunks(), values["c1"].take(at).combine_chunks(), pa.nulls(len(key), pa.int64()), words.dictionary.take(pa.array(key % wide)).cast(pa.string()), pa.array(n)], ["lang", "source", "ordinal", "term", "n"])
        if keys:
            yield from emit(*merged())

    return docs.select("lang", "source", "text").mapInArrow(rows, schema)


def term_counts(docs: DataFrame, words: DataFrame, limit: int = VOCABULARY_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the kept ``words`` in each source, where there are any."""
    spark = docs.sparkSession
    least = bounded_share(words, limit)
    chosen = (F.octet_length("term") <= LONGEST) & (F.floor(8 * F.log2("n")) >= least)
    made = build_transducers(words.where(chosen))
    rest = words.where(~chosen).select("lang", "term", F.col("ordinal").alias("at"))
    beyond = not rest.isEmpty()
    if made is None:
        made = [], T.build([])
    counts = stream_counts(docs, spark.sparkContext.broadcast(made), beyond)
    key = ["lang", "source", "ordinal"]
    if not beyond:
        return counts.groupBy(*key).agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    near = counts.where("ordinal is not null").groupBy(*key).agg(F.sum("n").alias("n"))
    far = counts.where("ordinal is null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return near.unionByName(far.join(rest, ["lang", "term"]).select("lang", "source", F.col("at").alias("ordinal"), "n"))


def _share(n) -> F.Column:
    """1 + floor(10^9 (n + 1) / size)."""
    return F.expr(f"1L + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST(size AS DECIMAL(19, 0))")


def _tile(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Sums over one tile of ordinals for each pair of sources of its two blocks of ``size``."""
    head = frame[frame["ordinal"].isna()].drop_duplicates("ix").sort_values("ix")
    body = frame[frame["ordinal"].notna()]
    lang, first, width = head["lang"].iloc[0], int(head["first"].iloc[0]), int(head["width"].iloc[0])
    share = np.repeat(head["p"].to_numpy(np.int64)[:, None], width, axis=1)
    share[np.searchsorted(head["ix"].to_numpy(), body["ix"].to_numpy()), body["ordinal"].to_numpy(np.int64) - first] = body["p"].to_numpy(np.int64)
    block, names = head["ix"].to_numpy() // size, head["source"].to_numpy()
    low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
    out = []
    for i in range(len(head)):
        step = share[i] - share
        value = (step * step // share).sum(axis=1)
        # a pair inside one block belongs to that block's own tile
        mine = (block != block[i]) if low != high else np.ones(len(head), bool)
        mine[i] = False
        out.append(pd.DataFrame({"lang": lang, "source": names[i], "item": names[mine], "value": value[mine]}))
    return pd.concat(out)


def source_divergence(docs: DataFrame, least: int = 3, ranks: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", limit: int = VOCABULARY_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources (``pair``) and the words that mark them (``term``)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).alias("text"))
    words = materialize(vocabulary(docs, least), "vocabulary")
    counts = materialize(term_counts(docs, words, limit), "terms")

    # the size of each group: its words and one for each kept term of the language
    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.min("ordinal").alias("from"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().withColumn("ix", F.row_number().over(order) - 1).withColumn("blocks", F.floor(F.max("ix").over(Window.partitionBy("lang")) / BLOCK) + 1)
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", "ix", "blocks", (F.coalesce("words", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("size"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("from", F.lit(0)).alias("from"))
    groups = materialize(groups, "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n"))

    # pairs: tiles of (ordinals, block of sources, block of sources); a row goes to every tile of its block
    body = shares.select("lang", "source", "ix", "blocks", "ordinal", "p", F.expr(f"ordinal - (ordinal - from) % {TILE}").alias("first"), F.lit(None).cast("long").alias("width"))
    last = F.greatest(F.expr(f"(v - 1) div {TILE}"), F.lit(0))
    head = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "lang", "source", "ix", "blocks", F.lit(None).cast("long").alias("ordinal"),
        F.when(F.col("size") > 0, _share("0")).otherwise(F.lit(1)).alias("p"),
        F.expr(f"from + k * {TILE}").alias("first"), F.expr(f"least({TILE}L, v - k * {TILE})").alias("width"),
    )
    mine = F.floor(F.col("ix") / BLOCK)
    size = BLOCK
    dealt = body.unionByName(head).withColumn("near", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least(mine, "near"), "high": F.greatest(mine, "near")})
    sums = dealt.groupBy("lang", "first", "low", "high").applyInPandas(lambda frame: _tile(frame, size), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).cast("int").alias("rank"))

    # terms: against the whole language
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("words")).join(langs, "lang").select("lang", (F.col("words") + F.col("v")).alias("size"))
    whole = whole.join(F.broadcast(total), "lang").select("ordinal", _share("n").alias("q"))
    marks = shares.select("lang", "source", "ordinal", "p").join(whole, "ordinal").where("p > q")
    marks = marks.select("lang", "source", "ordinal", F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    marks = marks.withColumn("rank", F.row_number().over(by_ordinal).cast("int")).where(F.col("rank") <= ranks)
    marks = marks.join(words.select("ordinal", F.col("term").alias("item")), "ordinal").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(marks)
