"""Operator 2: exact Jaccard self-join of word n-gram sets by universe-partition pigeonhole.

1. ``signatures`` (see ``jaccard_kernel``) are dealt by their hash; sets that share
   one are candidates. Signatures that a sample shows to be held by many sets skip
   the deal and go straight to the table of larger buckets, so no part holds them.
2. A parity sketch of each set (bit i: whether an odd number of its hashes fall on
   i) bounds the symmetric difference from below, so pairs it rules out are no
   links; the rest are compared exactly by the sets of their whole texts.
3. Buckets of more than ``TINY`` sets first compare all with a few hubs, so that a
   group of copies becomes one component by a few stars, however many buckets it shares.
   Rounds of stars follow, with new hubs from what a group's largest component does not
   hold, for as long as they join and the rest has many partners left.
4. All other pairs that share a bucket are compared unless that component already
   joins both, so the components are complete. Sets of one group that stay apart look at each
   other's sizes and sketches, and only possible pairs leave that join.
5. ``link_counts`` counts every link: the sets of a component meet in blocks of
   bounded size, each pair of blocks is compared exactly inside one task, and only
   a count for each set leaves it.

Defined results: a null or wordless text has an empty set and links with
nothing; a text with fewer words than ``k`` is one shingle; equal sets are one
class; a row without an id gets a null component and takes no part in links;
rows that repeat an id are each kept. Only the id and text columns are read, so
other columns and their names do not matter. Shingles are compared by 64-bit
hashes, and sets are one class where 128 bits over all their shingles agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, materialize
from .jaccard_kernel import Bands, signatures

#: Sets of a bucket up to which its pairs are made at once.
TINY = 4
#: Sets of a larger bucket that all its sets are compared with first.
HUBS = 4
#: Hubs of a group in each later round, and partners a node up to which the rest is compared without another round.
MORE_HUBS, PARTNERS = 8, 16
#: Signatures that one task sorts.
PART_SIGNATURES = 1_500_000
#: Members of larger buckets that a task looks at together.
MEMBERS = 1_000_000
#: Longs of a parity sketch, and of the wide one that sets from a size on have: 1,024 bits let any two sets of 3,600 pass.
SKETCH, WIDE, WIDE_FROM = 16, 64, 900
#: Documents in the sample that names popular shingles, how many of them make
#: one popular, and how many are named at most. They steer cost, not results.
SAMPLE_DOCS, POPULAR_AT, POPULAR_MOST = 20_000, 4, 65_536
#: Sampled sets that make a signature one of a large bucket, and how many signatures are named at most.
HOT_AT, HOT_MOST = 16, 65_536
#: Document ids that are broadcast at most; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 500_000
#: Sets and shingles of one block in which links are counted.
BLOCK_SETS, BLOCK_TOKENS = 256, 131_072


def set_key(tokens: np.ndarray) -> bytes:
    """128-bit key of a set of hashed shingles."""
    with np.errstate(over="ignore"):
        sums = np.array([np.add.reduce(K.mix(tokens)), np.add.reduce(K.mix(tokens ^ K.U64(0xA5A5F00D5EED1234)))], K.U64)
        return K.mix(sums + K.U64(len(tokens))).tobytes()


def address(key: bytes) -> int:
    """The long by which sets are named where signatures meet; longs are in the order of the keys."""
    return int.from_bytes(key[:8], "big") - (1 << 63)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of each text."""
    for lo, hi, data, offsets in K.chunks(column):
        starts, ends, first = K.words(data, offsets)
        hashed = K.word_hashes(data, starts, ends, lower=True)
        for i in range(hi - lo):
            yield lo + i, K.shingle_set(hashed[first[i] : first[i + 1]], k)


def sketch(tokens: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Parity of the number of tokens that hash to each of 64 * ``longs`` bits, of which more tell larger sets apart."""
    bits = np.bincount((K.mix(tokens + K.U64(0xC2B2AE35)) >> K.U64(33)) % K.U64(64 * longs), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SKETCHES = [f"s{i}" for i in range(SKETCH)]


def shingle_sizes(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, node, addr, s0 ..., wide) of ``docs(id, text)``: set size, key of the set (null if empty), its address and sketches."""

    def rows(batches):
        for batch in batches:
            n, key, bits = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, np.zeros((SKETCH, batch.num_rows), np.int64)
            wide = [None] * batch.num_rows
            for i, tokens in _sets(batch.column("text"), k):
                n[i] = len(tokens)
                key[i] = set_key(tokens) if len(tokens) else None
                bits[:, i] = sketch(tokens)
                wide[i] = sketch(tokens, WIDE) if len(tokens) >= WIDE_FROM else None
            addr = pa.array([None if x is None else address(x) for x in key], pa.int64())
            yield pa.record_batch([batch.column("id"), pa.array(n), pa.array(key, pa.binary()), addr, *(pa.array(x) for x in bits), pa.array(wide, pa.list_(pa.int64()))], ["id", "n", "node", "addr", *SKETCHES, "wide"])

    longs = ", ".join(f"{x} long" for x in SKETCHES)
    return docs.mapInArrow(rows, f"id {docs.schema['id'].dataType.simpleString()}, n long, node binary, addr long, {longs}, wide array<long>")


def _sampled(docs: DataFrame) -> DataFrame:
    """The distinct texts of at most about SAMPLE_DOCS documents, chosen by a hash of the id."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return materialize(some.select("text").distinct(), "sample")


def _most_frequent(texts: DataFrame, hashes, at: int, most: int) -> np.ndarray:
    """Sorted values of ``hashes(text column)`` found in ``at`` or more texts, ``most`` at most."""

    def rows(batches):
        for batch in batches:
            for found in hashes(batch.column("text")):
                yield pa.record_batch([pa.array(K.signed(found))], ["h"])

    top = texts.mapInArrow(rows, "h long").groupBy("h").count().where(F.col("count") >= at)
    got = top.orderBy(F.desc("count"), "h").limit(most).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(got.view(K.U64))


def popular_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles found in POPULAR_AT or more of ``texts``."""
    return _most_frequent(texts, lambda column: (tokens for _, tokens in _sets(column, k)), POPULAR_AT, POPULAR_MOST)


def hot_signatures(texts: DataFrame, k: int, num: int, den: int, popular: np.ndarray) -> np.ndarray:
    """Sorted signatures that HOT_AT or more of ``texts`` have."""
    bands = Bands(num, den)
    return _most_frequent(texts, lambda column: (K.distinct(signatures(tokens, bands, popular)) for _, tokens in _sets(column, k)), HOT_AT, HOT_MOST)


#: Signatures and sets that a task packs together; set numbers in a pack have 16 bits.
PACK_SIGNATURES, PACK_SETS = 300_000, 60_000
PACKED = "part int, hot boolean, nodes binary, sizes binary, owners binary, sigs binary"


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``some``."""
    if len(some) == 0:
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _pack(keys: list[int], sizes: list[int], sigs: list[np.ndarray], parts: int, hot: np.ndarray) -> pa.RecordBatch:
    """One row for each part: its signatures, and the sets they are of by number; those of large buckets go anywhere."""
    owner = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(x) for x in sigs])
    sig = np.concatenate(sigs)
    to = (((sig >> K.U64(40)) * K.U64(parts)) >> K.U64(24)).astype(np.int32)
    to[_among(sig, hot)] = parts
    order = np.argsort(to, kind="stable")
    owner, sig, to = owner[order], sig[order], to[order]
    node, size = np.array(keys, np.int64), np.array(sizes, np.int32)
    at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    out = []
    for a, b in zip(at.tolist(), np.append(at[1:], len(to)).tolist(), strict=True):
        here, number = np.unique(owner[a:b], return_inverse=True)
        out.append((node[here].tobytes(), size[here].tobytes(), number.astype(np.uint16).tobytes(), sig[a:b].tobytes()))
    large = to[at] == parts
    part = np.where(large, keys[0] % parts, to[at]).astype(np.int32)
    return pa.record_batch([pa.array(part), pa.array(large), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], ["part", "hot", "nodes", "sizes", "owners", "sigs"])


def _dealt(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """Signatures of all distinct sets, packed by each task and dealt to ``parts`` parts."""
    context, sample = docs.sparkSession.sparkContext, _sampled(docs)
    named = popular_shingles(sample, k)
    popular, hot = context.broadcast(named), context.broadcast(hot_signatures(sample, k, num, den, named))

    def rows(batches):
        bands, seen = Bands(num, den), set()
        keys, sizes, sigs, held = [], [], [], 0
        for batch in batches:
            for _, tokens in _sets(batch.column("text"), k):
                if len(tokens) == 0 or (key := set_key(tokens)) in seen:
                    continue
                seen.add(key)
                keys.append(address(key))
                sizes.append(len(tokens))
                sigs.append(signatures(tokens, bands, popular.value))
                held += len(sigs[-1])
                if held > PACK_SIGNATURES or len(keys) >= PACK_SETS:
                    yield _pack(keys, sizes, sigs, parts, hot.value)
                    keys, sizes, sigs, held = [], [], [], 0
        if keys:
            yield _pack(keys, sizes, sigs, parts, hot.value)

    return docs.mapInArrow(rows, PACKED).repartitionById(parts, "part")


def _held_twice(x: np.ndarray) -> np.ndarray:
    """Whether a value of sorted ``x`` is there more than once."""
    same = x[1:] == x[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(x) else np.zeros(0, bool)


def pair_buckets(node: np.ndarray, n: np.ndarray, sig: np.ndarray, num: int, den: int):
    """Batches (bucket, a, b): null, a, b are pairs of tiny buckets; bucket, a, null members of larger ones.

    Pairs whose sizes ``n`` are too far apart for a similarity of num/den are left out.
    Larger buckets with the same least node are given out as one (see ``grouped``), each member once.
    """
    if len(sig) == 0:
        return
    order = np.argsort(sig)
    node, n, sig = node[order], n[order], sig[order]
    held = _held_twice(sig)
    node, n, sig = node[held], n[held], sig[held]
    order = np.lexsort((node, sig))
    node, n, sig = node[order], n[order], sig[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    node, n, sig = node[fresh], n[fresh], sig[fresh]
    if len(sig) == 0:
        return
    at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(at, len(sig)))
    # buckets with the same members say the same: one of each is enough
    content = K.mix(np.add.reduceat(K.mix(node.view(K.U64)), at) + size.astype(K.U64))
    content, once = np.unique(content, return_index=True)
    at, size = at[once], size[once]
    found = []
    for s in range(2, TINY + 1):
        i, j = np.triu_indices(s, 1)
        places = at[size == s][:, None] + np.arange(s)
        left, right = places[:, i].ravel(), places[:, j].ravel()
        fits = np.minimum(n[left], n[right]) * den >= num * np.maximum(n[left], n[right])
        found.append(np.stack((node[left[fits]], node[right[fits]]), 1))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if len(pairs):
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]
    for lo in range(0, len(pairs), 100_000):
        some = pairs[lo : lo + 100_000]
        yield pa.record_batch([pa.nulls(len(some), pa.int64()), pa.array(some[:, 0]), pa.array(some[:, 1])], ["bucket", "a", "b"])
    large = size > TINY
    at, size = at[large], size[large]
    order = np.argsort(node[at], kind="stable")
    at, size = at[order], size[order]
    total = np.cumsum(size)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + MEMBERS, "right")))
        some = size[lo:hi]
        place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(at[lo:hi], some)
        hub, member = np.repeat(node[at[lo:hi]], some), node[place]
        order = np.lexsort((member, hub))
        hub, member = hub[order], member[order]
        once = np.concatenate(([True], (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])))
        yield from _members(member[once], K.mix(hub[once].view(K.U64)))
        lo = hi


def _members(node: np.ndarray, sig: np.ndarray):
    for lo in range(0, len(sig), 100_000):
        some = pa.array(node[lo : lo + 100_000])
        yield pa.record_batch([pa.array(K.signed(sig[lo : lo + 100_000])), some, pa.nulls(len(some), pa.int64())], ["bucket", "a", "b"])


def _bucket_pairs(num: int, den: int):
    """Of one part: (null, a, b) to compare from tiny buckets, (bucket, a, null) of members of larger ones."""

    def rows(batches):
        nodes, sizes, owners, sigs, base = [], [], [], [], 0
        for batch in batches:
            for hot, node, size, owner, sig in zip(*(batch.column(x) for x in ("hot", "nodes", "sizes", "owners", "sigs")), strict=True):
                node, owner, sig = (np.frombuffer(x.as_buffer(), t).copy() for x, t in ((node, np.int64), (owner, np.uint16), (sig, K.U64)))
                if hot.as_py():
                    yield from _members(node[owner], sig)
                    continue
                nodes.append(node)
                sizes.append(np.frombuffer(size.as_buffer(), np.int32).copy())
                owners.append(owner.astype(np.int32) + np.int32(base))
                sigs.append(sig)
                base += len(node)
        if not nodes:
            return
        owner, sig = np.concatenate(owners), np.concatenate(sigs)
        owners.clear()
        sigs.clear()
        # most signatures are of one set: only the others are given their sets
        order = np.argsort(sig).astype(np.int32)
        sig, owner = sig[order], owner[order]
        held = _held_twice(sig)
        sig, owner = sig[held], owner[held]
        yield from pair_buckets(np.concatenate(nodes)[owner], np.concatenate(sizes)[owner].astype(np.int64), sig, num, den)

    return rows


def _sketched(sets: DataFrame) -> list[str]:
    return [c for c in sets.columns if re.fullmatch(r"s\d+", c)]


def _possible(sets: DataFrame, num: int, den: int) -> F.Column:
    """Whether sizes na, nb and sketches a0 ..., b0 ... (and wa, wb of large sets) leave a pair the chance to be similar."""
    fits = lambda apart: apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(len(_sketched(sets)))), F.lit(0))
    likely = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & fits(apart)
    if "wide" not in sets.columns:
        return likely
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return likely & (F.col("wa").isNull() | F.col("wb").isNull() | fits(apart))


def _sided(sets: DataFrame, side: str) -> DataFrame:
    wide = [F.col("wide").alias(f"w{side}")] if "wide" in sets.columns else []
    return sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), *(F.col(s).alias(f"{side}{i}") for i, s in enumerate(_sketched(sets))), *wide)


def likely_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and sketches in ``sets(node, n, s0 ...)`` leave them the chance to be similar."""
    both = pairs.join(_sided(sets, "a"), "a").join(_sided(sets, "b"), "b")
    return both.where(_possible(sets, num, den)).select("a", "b")


def grouped(buckets: DataFrame) -> DataFrame:
    """``buckets(bucket, node)`` with those of the same least node as one group, so sets that share many buckets meet in one place.

    Nodes are hashes, so their order is random, and buckets with about the same members have the same least node.
    """
    least = buckets.groupBy("bucket").agg(F.min("node").alias("hub"))
    return materialize(buckets.join(least, "bucket").select(F.xxhash64("hub").alias("bucket"), "node").distinct(), "groups")


def hub_pairs(groups: DataFrame) -> DataFrame:
    """Distinct pairs a < b of each node of ``groups(bucket, node)`` and the hubs of its group: its least node, which shares a bucket with each, and others."""
    others = (F.min_by("node", F.xxhash64(F.lit(t), "node")) for t in range(1, HUBS))
    hubs = groups.groupBy("bucket").agg(F.array_distinct(F.array(F.min("node"), *others)).alias("hubs"))
    met = groups.join(hubs, "bucket").select("node", F.explode("hubs").alias("hub"))
    return met.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def open_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root, k, top) of the groups that hold several roots: their size and most frequent root."""
    named = groups.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    count = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    count = count.groupBy("bucket").agg(F.sum("c").alias("k"), F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("c", "root")).alias("top"))
    return materialize(named.join(count.where("roots > 1").drop("roots"), "bucket"), "mixed")


def round_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs a < b of each node and hubs of its group with another root; the hubs are drawn anew from outside the most frequent root."""
    outside = F.col("root") != F.col("top")
    draw = lambda t: F.when(outside, F.xxhash64(F.lit(turn * MORE_HUBS + t), "node"))
    hubs = mixed.groupBy("bucket").agg(F.array_distinct(F.array(*(F.min_by(F.struct("node", "root"), draw(t)) for t in range(MORE_HUBS)))).alias("hubs"))
    met = mixed.join(hubs, "bucket").select("node", "root", F.explode("hubs").alias("hub")).where("hub.root <> root")
    return met.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def rest_pairs(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Possible pairs a < b of ``mixed`` (see ``open_groups``) that share a group and not a root.

    Every such pair holds a node outside the most frequent root of its group, so only
    these nodes look for partners, among blocks of their group. A pair that shares
    several groups is looked at in the first of them, and once where both look.
    """
    blocks = F.ceil(F.col("k") / 1024).cast("int")
    sided = lambda rows, side: rows.withColumnRenamed("node", side).join(_sided(sets, side), side)
    own = mixed.groupBy("node").agg(F.collect_list("bucket").alias("own"))  # no more than a set's signatures
    named = mixed.join(own, "node")
    left = named.where("root <> top").select("bucket", "node", F.col("root").alias("ra"), F.col("own").alias("ga"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    right = named.select("bucket", "node", F.col("root").alias("rb"), F.col("own").alias("gb"), (F.col("root") != F.col("top")).alias("looks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    once = (~F.col("looks") | (F.col("a") < F.col("b"))) & (F.array_min(F.array_intersect("ga", "gb")) == F.col("bucket"))
    possible = _possible(sets, num, den)
    both = sided(left, "a").join(sided(right, "b"), ["bucket", "block"]).where((F.col("ra") != F.col("rb")) & possible & once)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def node_tokens(docs: DataFrame, members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens): the sorted shingle hashes of the sets ``nodes(node)``, of one whole text each."""
    named = members.where("id is not null and node is not null")
    found = materialize(named.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("node", "id"), "ids")
    ids = found.select("id")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def rows(batches):
        for batch in batches:
            key, held = [], []
            for _, tokens in _sets(batch.column("text"), k):
                if len(tokens):
                    key.append(set_key(tokens))
                    held.append(tokens.tobytes())
                if len(held) >= 1000:
                    yield pa.record_batch([pa.array(key, pa.binary()), pa.array(held, pa.binary())], ["node", "tokens"])
                    key, held = [], []
            if held:
                yield pa.record_batch([pa.array(key, pa.binary()), pa.array(held, pa.binary())], ["node", "tokens"])

    got = texts.select("text").mapInArrow(rows, "node binary, tokens binary")
    # an id may be on several rows: only sets that were asked for stay, each once
    repeated = members.where("id is not null").groupBy("id").count().where("count > 1")
    if not repeated.isEmpty():
        got = got.join(found.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return materialize(got, "tokens")


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), K.U64) for x in column]


def similar_sets(num: int, den: int):
    """The rows (a, b, ta, tb) whose sets of hashes ta and tb are similar, as (a, b)."""

    def rows(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(_tokens(batch.column("ta")), _tokens(batch.column("tb")), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(x).filter(pa.array(keep)) for x in ("a", "b")], ["a", "b"])

    return rows


def compared(pairs: DataFrame, tokens: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) of nodes whose ``tokens(node, tokens)`` the kernel ``similar`` finds similar."""
    both = pairs.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    kind = pairs.schema["a"].dataType.simpleString()
    return materialize(both.mapInArrow(similar, f"a {kind}, b {kind}"), "links")


def bucket_links(tiny: DataFrame, groups: DataFrame, sets: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], num: int, den: int, similar) -> tuple[DataFrame, DataFrame]:
    """(links, tokens): verified ``links(a, b)`` that join all similar sets that share a bucket.

    ``tiny(a, b)`` are the pairs of small buckets, ``groups(bucket, node)`` the distinct
    members of the others, those of the same least node as one group (see ``grouped``); ``tokens_of(nodes)`` gives ``(node, tokens)`` of ``nodes(node)`` as the kernel ``similar`` takes them.
    """
    stars = materialize(likely_pairs(hub_pairs(groups), sets, num, den), "stars")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    tokens = tokens_of(ends(stars))
    links = compared(stars, tokens, similar)
    before, turn = None, 0
    while True:
        roots = components(links)
        mixed = open_groups(groups, roots)
        work, nodes = mixed.agg(F.sum(F.when(F.col("root") != F.col("top"), F.col("k"))), F.count(F.lit(1))).first()
        # go on while the rest would look at many partners a node and the last round made it smaller
        if not work or work <= PARTNERS * nodes or (before and work > before * 7 / 8):
            break
        before, turn = work, turn + 1
        found = materialize(likely_pairs(round_pairs(mixed, turn), sets, num, den), "stars")
        tokens = tokens.union(tokens_of(ends(found).join(tokens.select("node"), "node", "left_anti")))
        links = links.union(compared(found, tokens, similar))
    # what the stars have not joined
    tiny = likely_pairs(tiny, sets, num, den)
    apart = tiny.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    rest = materialize(apart.union(rest_pairs(mixed, sets, num, den)).distinct(), "likely")
    more = tokens_of(ends(rest).join(tokens.select("node"), "node", "left_anti"))
    tokens = tokens.union(more)
    return links.union(compared(rest, tokens, similar)), tokens


def ngram_join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, tokens): ``members(id, n, node)`` of every row, verified ``links(a, b)`` that join the classes.

    The links connect all linked sets; ``link_counts`` counts those too that the
    components already imply, from ``tokens(node, tokens)``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = materialize(shingle_sizes(docs, k), "members")
    docs = docs.where("id is not null and text is not null")
    named = members.where("id is not null and node is not null").groupBy("node")
    sets = materialize(named.agg(F.min("addr").alias("addr"), F.min("n").alias("n"), *(F.min(x).alias(x) for x in (*SKETCHES, "wide"))), "sets")
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-shingles * 6 // (10 * PART_SIGNATURES)))
    found = _dealt(docs, k, num, den, parts).mapInArrow(_bucket_pairs(num, den), "bucket long, a long, b long")
    found = materialize(found, "candidates")
    addr = sets.select(F.col("addr").alias("a"), "node")
    larger = materialize(found.where("bucket is not null").select("bucket", "a").distinct().join(addr, "a").select("bucket", "node"), "buckets")
    tiny = found.where("bucket is null").select("a", "b").distinct().join(addr.toDF("a", "x"), "a").join(addr.toDF("b", "y"), "b")
    tiny = tiny.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links, tokens = bucket_links(tiny, grouped(larger), sets, lambda nodes: node_tokens(docs, members, nodes, k), num, den, similar_sets(num, den))
    return members, links, tokens


def _block_links(num: int, den: int):
    """(node, links) of the sets of each pair of blocks, weighted by the rows of the other set's class."""

    def similar(sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in sets])
        held = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        pick = _held_twice(held)
        held, owner = held[pick], owner[pick]
        both = np.zeros((len(sets), len(sets)), np.float32)
        if len(held):
            column = np.cumsum(np.concatenate(([True], held[1:] != held[:-1]))) - 1
            step = max(1, 4_000_000 // len(sets))
            for lo in range(0, int(column[-1]) + 1, step):
                a, b = np.searchsorted(column, [lo, lo + step])
                table = np.zeros((len(sets), int(column[b - 1]) - lo + 1), np.float32)
                table[owner[a:b], column[a:b] - lo] = 1
                both += table @ table.T
        both = both.astype(np.int64)
        return den * both >= num * (sizes[:, None] + sizes[None, :] - both)

    def counted(rows: list[tuple]) -> pa.RecordBatch:
        node, side, weight, tokens = zip(*rows, strict=True)
        side, weight = np.array(side), np.array(weight, np.int64)
        linked = similar(list(tokens))
        np.fill_diagonal(linked, False)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        return pa.record_batch([pa.array(node, pa.binary()), pa.array(linked @ weight)], ["node", "links"])

    def rows(batches):
        at, held = None, []
        for batch in batches:
            where = list(zip(*(batch.column(x).to_pylist() for x in ("root", "i", "j")), strict=True))
            side, weight, node = (batch.column(x).to_pylist() for x in ("block", "w", "node"))
            for row, tokens in enumerate(_tokens(batch.column("tokens"))):
                if where[row] != at:
                    if len(held) > 1:
                        yield counted(held)
                    at, held = where[row], []
                held.append((node[row], side[row], weight[row], tokens.copy()))
        if len(held) > 1:
            yield counted(held)

    return rows


def link_counts(members: DataFrame, roots: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(node, links): rows of other classes that each set of ``roots(node, root)`` links with.

    A component of many sets is cut into blocks, and each two blocks meet in one group of bounded size.
    """
    named = members.where("id is not null and node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("n"))
    tied = materialize(roots.join(named, "node"), "tied")
    cut = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    tied = tied.join(tied.groupBy("root").agg(cut.alias("g")), "root")
    block = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    tied = tied.select("root", "node", "w", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    tied = tied.select("root", "node", "w", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = tied.join(tokens, "node").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    counts = met.select("root", "i", "j", "node", "block", "w", "tokens").mapInArrow(_block_links(num, den), "node binary, links long")
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(id, n_shingles, class_id, component_id, n_links) of every row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable by links; both are the row's own id for an empty set.
    ``n_links`` is the number of other rows with an id whose sets link with this
    one's, equal sets included; without ``count_links`` it is left out.
    """
    members, links, tokens = ngram_join(docs, k, num, den, id_col, text_col)
    reps = members.where("id is not null and node is not null").groupBy("node").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("same"))
    roots = components(links)
    tied = roots.join(reps, "node")
    least = tied.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = reps.join(tied.select("node", "root"), "node", "left").join(least, "root", "left")
    named = named.select("node", "class_id", "same", F.coalesce("component_id", "class_id").alias("component_id"))
    if count_links:
        named = named.join(link_counts(members, roots, tokens, num, den), "node", "left")
    out = members.join(named, "node", "left")
    known = F.col("id").isNotNull()
    cols = [
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(known, F.coalesce("component_id", "id")).alias("component_id"),
    ]
    if count_links:
        cols.append(F.when(known, F.coalesce("same", F.lit(0)) + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"))
    return out.select(*cols)


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all their columns, but of each component only the document with the smallest id.

    Texts without words and rows without an id stay; of rows that repeat an id and a text one stays.
    """
    told = materialize(ngram_components(docs, k, num, den, id_col, text_col, count_links=False).select(F.col(id_col).alias("_nj_id"), "component_id"), "components")
    known = told.where("_nj_id is not null")
    gone = materialize(known.where("_nj_id <> component_id").select("_nj_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs[id_col] == gone["_nj_id"], "left_anti")
    twice = materialize(known.groupBy("_nj_id").count().where("count > 1").select("_nj_id"), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept[id_col] == twice["_nj_id"], "left_anti")
    return once.union(kept.join(twice, kept[id_col] == twice["_nj_id"], "left_semi").dropDuplicates([id_col, text_col]))
