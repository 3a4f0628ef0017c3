from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cases import SMALL
from storygauge.llm import lang_id, mixing
from test_near_dedup import brute_classes
from test_exact_dedup import plain
from test_packing import check


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The result of every stage on all that the one before has kept."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), small, {"documents": small}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(stages, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    assert all(stages[n].columns == small.columns for n in ("language", "exact", "near", "mix"))


def test_language(stages, small):
    given = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(small).collect()}
    assert {i for i, _ in rows(stages["language"])} == {i for i, (lang, score) in given.items() if lang != "und" and score >= 0.3}


def test_exact(stages):
    first = {}
    for i, t in rows(stages["language"]):
        first[plain(t)] = min(i, first.get(plain(t), i))
    assert sorted(i for i, _ in rows(stages["exact"])) == sorted(first.values())


def test_near(stages):
    expected = {c for _, c, _ in brute_classes(rows(stages["exact"]))}
    assert sorted(i for i, _ in rows(stages["near"])) == sorted(expected)


def test_mix(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages["near"]).collect()}
    assert Counter(i for i, _ in rows(stages["mix"])) == Counter({i: n for i, n in copies.items() if n})


def test_pack(spark, stages):
    from storygauge.llm import packing

    whole = packing.pack(stages["mix"], with_ids=True)
    check(stages["mix"], whole)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(stages["pack"].select(key).collect()) == sorted(whole.select(key).collect())


def test_stages_stand_messy_and_empty_tables(spark, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SMALL)
            assert name == "pack" or result.schema == docs.schema
            assert result.count() >= 0 if docs is messy else result.count() == 0


def test_run(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    by_sequence = defaultdict(int)
    for r in packed.collect():
        by_sequence[r.sequence_id] += r.length
    assert by_sequence and all(n & (n - 1) == 0 for n in by_sequence.values())
