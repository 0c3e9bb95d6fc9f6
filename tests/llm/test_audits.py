"""Token counts, filter audit and source divergence: against a library, SQL over hand-made tables, and on edge cases."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewright.llm import filter_audit, source_divergence, token_counts, transducer
from tracewright.llm.common import table
from tracewright.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n long, id long, part string, term string, key string, size long, words long, ordinal long"
LONG = " ".join(f"wort{i % 977} Zé{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "One two three, two THREE. A$B", "en", "a"),
    (2, "One two three, two THREE. A$B", "en", "b"),
    (2, "One two three, two THREE. A$B", "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t \x0b", "", "a"),
    (6, LONG, "en", "a"),
    (7, LONG, "de", "a"),
    (8, LONG + " tail", "de", "b"),
    (8, "three two", "de", "c"),
    (None, "One two three, two THREE. A$B", "en", "b"),
    (None, None, None, None),
    (9, "漢字 漢字 é|ü İ ſ  x", "zz", "only"),
    (10, "ABC DEF " * 60, "de", "c"),
    (11, "ABC DEF " * 60, "en", "c"),
    (-5, "ABC DEF " * 60, "de", None),
    (12, "q" * 1_200_000 + " two", "en", "b"),
    (13, "q" * 1_200_000 + " two", "en", "b"),
    (14, "q" * 1_200_000 + " one", "en", "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (10, 1, 1), (11, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, 1, None, "p", "t", "k", 2, 3, 4) for row in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    held = pa.table({"doc_id": [r[0] for r in TEXTS], "text": [r[1] for r in TEXTS], "lang": [r[2] for r in TEXTS], "source": [r[3] for r in TEXTS]})
    c.register("documents", held)
    c.register("labels", pa.table({"doc_id": [r[0] for r in LABELS], "quality": [r[1] for r in LABELS], "toxic": [r[2] for r in LABELS]}))
    return c


def rows(frame, columns):
    return sorted(repr([r[c] for c in columns]) for r in frame.collect())


def same(frame, other):
    columns = sorted(frame.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    assert rows(frame, columns) == sorted(repr([r[i] for i in at]) for r in other.fetchall())


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(BPE)
    want = {}
    for r in table(spark, SF, "documents").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 512)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark, SF, "documents"), BPE).collect()}
    assert got == want


def test_tokens_of_odd_texts():
    library, of = Tokenizer.from_file(BPE), token_counts.text_counter(*token_counts.read_merges(BPE))
    r = random.Random(5)
    odd = ["".join(r.choice("ab c'stre l\n\t ​12é漢<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    odd += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "  \n ", "a" * 5000, "\x1c\x1d\x85﻿", "\U0001f468‍\U0001f469 I'll we'Re", "é" * 3000]
    for text in odd:
        assert of(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_tokens_of_edge_cases(docs, none):
    library = Tokenizer.from_file(BPE)
    short = docs.where("n < 2 and length(coalesce(text, '')) < 1000000")
    got = token_counts.count_tokens(short, BPE).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in TEXTS if len(t or "") < 1_000_000]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_filters_equal_sql_on_edge_cases(docs, labels, duck):
    same(filter_audit.audit_filters(docs, labels), duck.sql(ORACLE_SQL["op13_filter_interactions"]))


def test_filters_of_no_rows(none, labels):
    assert filter_audit.audit_filters(none, labels).count() == 0


def test_filters_without_labels(docs, labels):
    got = filter_audit.audit_filters(docs, labels.where("false")).selectExpr("sum(good_lost)", "sum(toxic_lost)", "count(*)").collect()[0]
    assert tuple(got) == (0, 0, 600 * len({r[2] or "" for r in TEXTS}))


def test_byte_pass_equals_plain_counting():
    r = random.Random(7)
    texts = ["".join(r.choice("aA #é漢\t\x0c|Z\U0001f600 b") for _ in range(r.randint(0, 80))) for _ in range(500)] + [None, "", "x", " x", "x ", "word", LONG]
    got = filter_audit.count_bytes(pa.array(texts))
    for text, counts in zip(texts, got):
        w = [x for x in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        t = text or ""
        assert counts.tolist() == [len(w), len(set(w)), sum("A" <= x <= "Z" for x in t), len(t), sum(x in "#$%&*|" for x in t)]


def test_hash_table_verifies_bytes(monkeypatch):
    """Words of one slot and one hash are still told apart."""
    monkeypatch.setattr(filter_audit.K, "word_hashes", lambda data, starts, ends, lower: np.zeros(len(starts), np.uint64))
    texts = ["aa ab ac aa ab", "abcdefgh abcdefghi abcdefghij abcdefghi x", "aa"]
    assert filter_audit.count_bytes(pa.array(texts))[:, 1].tolist() == [3, 4, 1]


def test_divergence_equals_sql_on_edge_cases(docs, duck):
    same(source_divergence.source_divergence(docs), duck.sql(ORACLE_SQL["op11_source_divergence"]))


@pytest.mark.parametrize("limit", [0, 40, 3000])
def test_divergence_beyond_the_vocabulary_bound(spark, limit, monkeypatch):
    """Terms that the transducer has no room for are counted all the same."""
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    monkeypatch.setattr(source_divergence, "HELD", 500)
    same(source_divergence.source_divergence(table(spark, SF, "documents"), limit=limit), c.sql(ORACLE_SQL["op11_source_divergence"]))


def test_divergence_in_several_tiles(spark, monkeypatch):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    monkeypatch.setattr(source_divergence, "TILE", 17)
    monkeypatch.setattr(source_divergence, "BLOCK", 3)
    same(source_divergence.source_divergence(table(spark, SF, "documents")), c.sql(ORACLE_SQL["op11_source_divergence"]))


def test_divergence_of_no_rows(none):
    assert source_divergence.source_divergence(none).count() == 0


def test_transducer_is_minimal_and_ordered():
    r = random.Random(3)
    terms = sorted({"".join(r.choice("abcé漢") for _ in range(r.randint(1, 8))).encode() for _ in range(2000)})
    made = transducer.build(terms)
    rest = {t[i:] for t in terms for i in range(len(t) + 1)}
    # states of the minimal automaton: distinct sets of endings
    ends = {}
    for t in terms:
        for i in range(len(t) + 1):
            ends.setdefault(t[:i], set()).add(t[i:])
    assert len(made.final) == len({frozenset(x) for x in ends.values()}) and rest
    probe = terms + [t + b"x" for t in terms] + [t[:-1] for t in terms]
    data, cut = np.frombuffer(b"".join(probe), np.uint8), np.cumsum([0, *map(len, probe)])
    at = transducer.walk(made, data, cut[:-1], cut[1:], np.zeros(len(probe), np.int64))
    place = {t: i for i, t in enumerate(terms)}
    assert at.tolist() == [place.get(t, -1) for t in probe]
    both = transducer.union([transducer.build([]), made, transducer.build([b"abc"])])
    at = transducer.walk(both, data, cut[:-1], cut[1:], np.full(len(probe), 2))
    assert {probe[i] for i in np.flatnonzero(at >= 0)} <= {b"abc"}
