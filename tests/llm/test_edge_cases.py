"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, no rows and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import chat, decontamination, line_dedup, media, mixing, ngram_join, pii, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, h long, part int, shard int, size long, key string, root long, kept string, tag string, found string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, "   \n\t \n"),
    (6, "two words"),
    (7, LONG),
    (8, LONG),
    (None, "one two three four five six seven"),
    (None, None),
    (9, "é ü 漢字 mixed\nline\nline\r\nlast"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if k % 3 else None, None, k, None, 3, 1, 2, None, "k", 5, "x", None, "f") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (6, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five six seven"), (2, None), (3, ""), (None, "a b")], "item_id long, text string")


CASES = {
    "pii": lambda d, lab, ben: pii.pseudonymize(d, "k"),
    "ngram": lambda d, lab, ben: ngram_join.ngram_components(d),
    "shards": lambda d, lab, ben: sharding.shard_documents(d, 3),
    "toxicity": lambda d, lab, ben: toxicity.toxicity(d, lab),
    "mixing": lambda d, lab, ben: mixing.mix_sources(d),
    "media": lambda d, lab, ben: media.text_media(d),
    "substrings": lambda d, lab, ben: substring_dedup.remove_repeats(d),
    "lines": lambda d, lab, ben: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_for_each_row(docs, none, labels, benchmark, name):
    got = CASES[name](docs, labels, benchmark)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _ in TEXTS)
    empty = CASES[name](none, labels.limit(0), benchmark)
    assert empty.count() == 0 and empty.columns == got.columns


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_ngram_values(docs):
    got = by_id(ngram_join.ngram_components(docs))
    assert {r.component_id for i in (1, 2) for r in got[2]} == {1} and got[1][0].component_id == 1
    assert got[8][0].component_id == 7 and got[6][0].n_shingles == 1
    assert all((got[i][0].n_shingles, got[i][0].component_id) == (0, i) for i in (3, 4, 5))
    assert {r.component_id for r in got[None]} == {None}


def test_substring_values(docs):
    got = by_id(substring_dedup.remove_repeats(docs))
    assert got[7][0].n_removed == 0 and got[8][0].n_removed == got[8][0].n_words == 30_000
    assert all(r.n_removed == 0 for i in (1, 2, 3, 4, 5, 6, 9) for r in got[i])


def test_line_values(docs):
    got = by_id(line_dedup.dedup_lines(docs))
    assert got[9][0].n_lines == 4 and got[9][0].kept == "é ü 漢字 mixed\nline\nlast"
    assert (got[3][0].n_lines, got[3][0].kept) == (0, None) and (got[4][0].n_lines, got[4][0].kept) == (1, "")
    assert (got[5][0].n_lines, got[5][0].n_removed) == (3, 0)
    assert got[1][0].n_removed == 0 and got[8][0].n_removed == 1 and got[2][0].kept == ""
    assert sorted(r.n_removed for r in got[None]) == [0, 1]


def test_rows_without_an_id_meet_their_own_lines(spark, monkeypatch):
    """No row is given the lines of another text of its id; equal rows share one list."""
    lists = []
    inner = spark.createDataFrame([], "id long").__class__.mapInArrow

    def spied(df, func, schema, *rest, **more):
        if func is line_dedup._cut:
            lists.extend((r.text.count("\n") + 1, len(r.gone)) for r in df.collect())
        return inner(df, func, schema, *rest, **more)

    monkeypatch.setattr(spark.createDataFrame([], "id long").__class__, "mapInArrow", spied)
    common = "a line that all of these texts have in common"
    rows = [(0, common)] + [(None if k % 2 else 7, f"{k * 7919:x} own words {k ** 5:x}\n{common}") for k in range(40)] * 2
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 81 and all(r.n_removed == 1 and common not in r.kept for r in got if r.doc_id != 0)
    assert len(lists) == 80 and all(held <= n for n, held in lists)


def test_shards_are_contiguous_and_gapless(docs):
    rows = sharding.shard_documents(docs, 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    known = sorted((r.doc_id, r.shard) for r in rows if r.doc_id is not None)
    assert [s for _, s in known] == sorted(s for _, s in known)


def test_mix_reaches_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert {r.source for r in rows} == {None, "s"}
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_item_ids_of_any_type(docs, benchmark):
    named = benchmark.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, named).collect()}
    assert got == {(r.doc_id, None if r.item_id is None else f"q{r.item_id}") for r in decontamination.leaks(docs, benchmark).collect()} and got


def test_leaks(docs, none, benchmark):
    got = decontamination.leaks(docs, benchmark)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "2", "None"]
    assert decontamination.drop_leaked(docs, benchmark).columns == docs.columns
    assert decontamination.drop_leaked(docs, benchmark).count() == len(TEXTS) - 4
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.leaks(none, benchmark).count() == 0


def test_leaks_of_items_without_an_id(spark, monkeypatch):
    """Items without an id are found, and shards of any size find the same."""
    items = [(k if k % 3 else None, " ".join(f"t{k}x{j}" for j in range(6 + k)) + f". answer a{k} b{k} c{k}") for k in range(9)]
    rows = [(k, f"before it {t} and after") for k, (_, t) in enumerate(items)] + [(20, "no item at all in this one"), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, [(k, i) for k, (i, _) in enumerate(items)] + [(None, None)]))
    seen = []
    for words in (500_000, 25):
        monkeypatch.setattr(decontamination, "SHARD_WORDS", words)
        seen.append(sorted(map(str, decontamination.leaks(docs, benchmark).collect())))
        assert sorted(str((r.doc_id, r.item_id)) for r in decontamination.leaks(docs, benchmark).collect()) == want
        assert [r.doc_id for r in decontamination.drop_leaked(docs, benchmark).collect()] == [20]
    assert seen[0] == seen[1] and len(list(decontamination._indexes(benchmark, "item_id", "text"))) > 3


def test_toxicity_without_labels_scores_zero(docs, labels):
    rows = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.0, 0)} and not any(r.held_out for r in rows if r.doc_id is None)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"),
        (4, 0, "user", None), (5, 0, "user", ""), (5, 3, None, "x"), (6, None, "user", "hi"), (None, 0, "user", "hi"), (7, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "conv_id long, turn long, role string, text string, conv long, block string")
    got = {r.conv_id: r for r in chat.render_chats(df).collect()}
    assert sorted(got) == [2, 4, 5, 7] and got[2].n_same == 2 and got[7].n_turns == 2
    assert got[5].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert chat.render_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, docs, none, labels, benchmark, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, str(tmp_path))
    if stage != "sharding":
        assert out.columns == corpus_pipeline.COLUMNS
    n = out.count()
    want = {"ngram_join": 9, "decontamination": 8, "sharding": 12}.get(stage)
    assert want is None or n == want
    assert f(spark, none, str(tmp_path)).count() == 0


def test_blocks_can_be_sought(spark):
    rows = spark.createDataFrame([(1, bytearray(range(192)) * 50), (2, None), (2, bytearray(192))], "id long, payload binary")
    decoded = media.decode_media(media.encode_media(rows))
    blocks = media.pcm_blocks(decoded, 960).where("id = 1").orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == bytes(range(192)) * 50
    assert [b.first_sample for b in blocks] == [960 * i for i in range(10)]
    assert decoded.where("pcm is null").count() == 1
    cut = decoded.where("id = 1").select("id", F.expr("overlay(media PLACING X'00' FROM 200 FOR 1)").alias("media"))
    with pytest.raises(Exception, match="FLAC"):
        media.decode_media(cut).collect()
