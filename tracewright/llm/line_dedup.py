"""Operator 10: fuzzy line deduplication by MinHash over character shingles.

Distinct lines get one-permutation MinHash signatures; bands of them are dealt by
hash, lines that share a band are compared exactly (Jaccard of k-character
shingles), and the links are joined to components by distributed contraction.
The first line of each component stays, by document id and line number; equal
lines are one node, so a very common line is a partial minimum from each task.
With ``rows`` = 5 and ``bands`` = 20 a pair at the threshold of 0.75 meets with a
probability of 0.995; buckets larger than ``TINY`` are compared by a star first and
then between the components left, so no pair of a bucket is dropped.

Lines end at newlines and are compared without outer whitespace; blank lines
always stay and never match.

Defined results: a null text has no lines and stays null, an empty text has one
blank line; a line shorter than k characters is one shingle; a row without an id
sorts last, and all such rows count as one document by line number; rows that
repeat an id are one document by line number, each with its own text; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import lines as L
from .common import components, materialize, shuffle_partitions
from .ngram_join import bucket_links, pair_buckets

LAST = (1 << 63) - 1
#: Longs of a line's parity sketch. Lines of 450 shingles with a similarity of 0.69 differ in 165: 512 bits show 122 of these, 1,024 show 141, the limit is 128.
SKETCH = 16
SKETCHES = [f"s{i}" for i in range(SKETCH)]
#: Keys or ids that are broadcast at most; beyond it rows meet by shuffle.
BROADCAST_KEYS = 1_000_000


#: Bytes of text looked at together: arrays of eight bytes for each stay in a core's cache.
CHUNK = 1 << 17


def _each(column: pa.Array):
    for lo, hi, data, offsets in K.chunks(column, CHUNK):
        starts, ends, first = L.lines(data, offsets)
        yield lo, hi, data, starts, ends, first, L.line_keys(data, starts, ends)


def _occurrences(batches):
    """(key, doc, version, line) of all lines that are not blank; ``version`` is a hash of the text."""
    for batch in batches:
        ids, versions = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "version"))
        for lo, hi, _, _, _, first, keys in _each(batch.column("text")):
            doc, version = (np.repeat(x[lo:hi], np.diff(first)) for x in (ids, versions))
            at = np.arange(len(keys)) - np.repeat(first[:-1], np.diff(first))
            use = keys != 0
            columns = [pa.array(K.signed(keys[use])), *(pa.array(x[use].astype(np.int64)) for x in (doc, version)), pa.array(at[use].astype(np.int32))]
            yield pa.record_batch(columns, ["key", "doc", "version", "line"])


def _bands(k: int, rows_: int, bands: int, parts: int):
    """Bands dealt to parts, packed: (part, keys, bands) with 8 bytes for each entry."""

    def packed(keys, sigs):
        key, sig = np.repeat(np.concatenate(keys), bands), np.concatenate(sigs).ravel()
        to = (((sig >> K.U64(40)) * K.U64(parts)) >> K.U64(24)).astype(np.int32)
        order = np.argsort(to.astype(np.uint16) if parts <= 1 << 16 else to, kind="stable")
        key, sig, to = key[order], sig[order], to[order]
        at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        ends = np.append(at[1:], len(to))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())
        return pa.record_batch([pa.array(to[at]), cut(key), cut(sig)], ["part", "keys", "bands"])

    def rows(batches):
        seen: set[int] = set()
        keys, sigs, held = [], [], 0
        for batch in batches:
            for _, _, data, starts, ends, _, key in _each(batch.column("text")):
                once, at = np.unique(key, return_index=True)
                new = np.fromiter((x not in seen for x in once.tolist()), bool, len(once)) & (once != 0)
                if not new.any():
                    continue
                at = np.sort(at[new])
                once = key[at]
                seen.update(once.tolist())
                shingles, line = L.char_shingles(data, starts[at], ends[at], k)
                keys.append(once)
                sigs.append(L.band_hashes(shingles, line, len(at), rows_, bands))
                held += len(at)
                if held * bands > 800_000:
                    yield packed(keys, sigs)
                    keys, sigs, held = [], [], 0
        if held:
            yield packed(keys, sigs)

    return rows


def _meetings(batches):
    keys, sigs = [], []
    for batch in batches:
        for name, out in (("keys", keys), ("bands", sigs)):
            for x in batch.column(name):
                out.append(np.frombuffer(x.as_buffer(), K.U64).copy())
    if keys:
        node = K.signed(np.concatenate(keys))
        yield from pair_buckets(node, np.ones(len(node), np.int64), np.concatenate(sigs), 1, 1)


#: Lines whose shingles are told apart by the low bits of one sorted array.
LANES = 256


def _lanes(shingles: np.ndarray, line: np.ndarray, n: int):
    """(first line, end line, values) of runs of LANES of ``n`` lines: sorted distinct (56 bits of a shingle, place of its line in 8 bits)."""
    cut = np.searchsorted(line, np.arange(0, n + LANES, LANES))
    for i, lo in enumerate(range(0, n, LANES)):
        here = slice(cut[i], cut[i + 1])
        yield lo, min(lo + LANES, n), K.distinct((shingles[here] & ~K.U64(LANES - 1)) | (line[here] - lo).astype(K.U64))


def _sketched(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size of each line, and its parity sketch (see ``ngram_join.sketch``)."""
    n, bits = np.zeros(len(starts), np.int64), np.zeros((SKETCH, len(starts)), np.int64)
    width = 64 * SKETCH
    for lo, hi, held in _lanes(*L.char_shingles(data, starts, ends, k), len(starts)):
        line = (held & K.U64(LANES - 1)).astype(np.int64)
        n[lo:hi] = np.bincount(line, minlength=hi - lo)
        bit = ((held >> K.U64(8)) * K.U64(0xD6E8FEB86659FD93) >> K.U64(65 - width.bit_length())).view(np.int64)
        odd = np.zeros((hi - lo) * width, np.uint8)  # parities stay where a count wraps
        np.add.at(odd, line * width + bit, np.uint8(1))
        bits[:, lo:hi] = np.packbits((odd & 1).reshape(hi - lo, width), axis=1).view(np.int64).T
    return n, bits


def _lines_of(needed, k: int):
    """(key, text, n, s0 ...) of lines, of the needed ones where those are given: text, set size and sketch."""

    def rows(batches):
        want = needed.value if needed is not None else None
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, starts, ends, _, key in _each(batch.column("text")):
                once, at = np.unique(key, return_index=True)
                use = once != 0
                if want is not None and len(want):
                    place = np.minimum(np.searchsorted(want, once), len(want) - 1)
                    use &= want[place] == once
                use &= np.fromiter((x not in seen for x in once.tolist()), bool, len(once))
                if not use.any():
                    continue
                at = np.sort(at[use])
                once = key[at]
                seen.update(once.tolist())
                raw = data.tobytes()
                text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                n, bits = _sketched(starts[at], ends[at], data, k)
                yield pa.record_batch([pa.array(K.signed(once)), pa.array(text), pa.array(n), *(pa.array(x) for x in bits)], ["key", "text", "n", *SKETCHES])

    return rows


def _similar(k: int, num: int, den: int):
    """The rows (a, b, ta, tb) whose lines ta and tb are similar, as (a, b)."""

    def sets(column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield from _lanes(*L.char_shingles(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], k), len(column))

    def rows(batches):
        lanes = lambda x, n: np.bincount((x & K.U64(LANES - 1)).astype(np.int64), minlength=n)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            # so many lines at once that their shingles stay within a few MB
            for at in range(0, batch.num_rows, 8 * LANES):
                sides = (sets(batch.column(c).slice(at, 8 * LANES)) for c in ("ta", "tb"))
                for (lo, hi, x), (_, _, y) in zip(*sides, strict=True):
                    held = np.sort(np.concatenate((x, y)))
                    both = lanes(held[1:][held[1:] == held[:-1]], hi - lo)
                    keep[at + lo : at + hi] = (den + num) * both >= num * (lanes(x, hi - lo) + lanes(y, hi - lo))
            yield pa.record_batch([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return rows


def _needed_lines(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(key, text, n, s0 ...) of the lines with these keys."""
    keys = materialize(keys.distinct(), "keys")
    schema = "key long, text string, n long, " + ", ".join(f"{x} long" for x in SKETCHES)
    if keys.count() <= BROADCAST_KEYS:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy().view(K.U64)))
        got = docs.mapInArrow(_lines_of(held, k), schema)
    else:
        got = docs.mapInArrow(_lines_of(None, k), schema).join(keys, "key", "left_semi")
    return materialize(got.groupBy("key").agg(*(F.min(c).alias(c) for c in ("text", "n", *SKETCHES))), "lines")


#: Bands that one task sorts, and bands of a task below which the parts are fewer than the shuffle partitions.
PART_BANDS, FEW_BANDS = 3_000_000, 1_000_000


def line_links(docs: DataFrame, n_lines: int, k: int = 6, num: int = 75, den: int = 100, rows: int = 5, bands: int = 20) -> DataFrame:
    """Verified links (a, b) of line keys that join all similar lines found in ``docs(id, text)`` of ``n_lines`` lines.

    Lines that share a band are candidates; parity sketches rule out pairs that cannot be similar.
    """
    total = n_lines * bands
    parts = max(1, min(shuffle_partitions(docs.sparkSession), -(-total // FEW_BANDS)), -(-total // PART_BANDS))
    dealt = docs.mapInArrow(_bands(k, rows, bands, parts), "part int, keys binary, bands binary").repartitionById(parts, "part")
    found = materialize(dealt.mapInArrow(_meetings, "bucket long, a long, b long"), "candidates")
    larger = materialize(found.where("bucket is not null").select("bucket", F.col("a").alias("node")).distinct(), "buckets")
    tiny = found.where("bucket is null").select("a", "b").distinct()  # similar lines share several bands
    text = _needed_lines(docs, found.select(F.explode(F.array("a", "b")).alias("key")).where("key is not null"), k)
    sets = text.select(F.col("key").alias("node"), "n", *SKETCHES)
    tokens = text.select(F.col("key").alias("node"), F.col("text").alias("tokens"))
    # buckets are named by their least line, so those of the same least line are one group already
    return bucket_links(tiny, larger, sets, lambda nodes: tokens.join(nodes, "node", "left_semi"), num, den, _similar(k, num, den))[0]


def _cut(batches):
    for batch in batches:
        out = []
        for lo, hi, data, _, _, first, keys in _each(batch.column("text")):
            raw = data.tobytes()
            at = 0
            for i in range(hi - lo):
                own = K.signed(keys[first[i] : first[i + 1]])
                gone = batch.column("gone")[lo + i].values
                line, key = gone.field("line").to_numpy(), gone.field("key").to_numpy()
                fits = line < len(own)
                fits[fits] &= own[line[fits]] == key[fits]
                drop = np.zeros(len(own), bool)
                drop[line[fits]] = True
                text = batch.column("text")[lo + i].as_py()
                kept = "\n".join(x for x, d in zip(text.split("\n"), drop.tolist(), strict=True) if not d)
                out.append((batch.column("id")[lo + i].as_py(), len(own), int(drop.sum()), kept))
        if out:
            columns = [pa.array(x, pa.int64()) for x in zip(*(x[:3] for x in out), strict=True)]
            yield pa.record_batch([*columns, pa.array([x[3] for x in out])], ["id", "n_lines", "n_removed", "kept"])


def dedup_lines(docs: DataFrame, k: int = 6, num: int = 75, den: int = 100, rows: int = 5, bands: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, kept) of every row of ``docs``; ``kept`` is the text that is left."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    told = docs.where("text is not null")
    told = told.withColumn("version", F.xxhash64("text"))
    seen = materialize(told.mapInArrow(_occurrences, "key long, doc long, version long, line int"), "occurrences")
    place = F.struct("doc", "line")
    firsts = materialize(seen.groupBy("key").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")), "firsts")
    root = components(line_links(told.select("id", "text"), seen.count(), k, num, den, rows, bands)).withColumnRenamed("node", "key")
    small = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows
    tied = materialize(firsts.join(small(root), "key").select("key", "root", "f"), "tied")
    least = tied.groupBy("root").agg(F.min("f").alias("rf"))
    tied = tied.join(least, "root").select(F.col("key").alias("tk"), "rf")
    tied = materialize(tied, "least")
    several = firsts.join(small(tied), firsts["key"] == tied["tk"], "left").where("c > 1 or rf is not null")
    keep = materialize(several.select("key", F.coalesce("rf", "f").alias("first")), "keep")
    gone = seen.join(small(keep), "key").where(place != F.col("first")).select("doc", "version", "line", "key")
    gone = materialize(gone, "gone")
    # rows of one id, or of none, meet only the lines of their own text
    ids = materialize(gone.select("doc", "version").distinct(), "ids")
    lists = gone.groupBy("doc", "version").agg(F.collect_set(F.struct("line", "key")).alias("gone"))  # no longer than a text
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    own = lambda other: (told["id"] == other["doc"]) & (told["version"] == other["version"])
    some = told.join(ids, own(ids), "left_semi")
    cut = some.join(lists, (some["id"] == lists["doc"]) & (some["version"] == lists["version"])).select("id", "text", "gone")
    cut = cut.mapInArrow(_cut, "id long, n_lines long, n_removed long, kept string")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    same = told.join(ids, own(ids), "left_anti").select("id", count.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    none = docs.where("text is null").select("id", F.lit(0).cast("long"), F.lit(0).cast("long"), "text")
    known = F.when(F.col("id") != LAST, F.col("id")).alias(id_col)
    return cut.union(same).union(none).select(known, "n_lines", "n_removed", "kept")
