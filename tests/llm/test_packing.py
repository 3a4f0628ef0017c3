import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storygauge.llm import packing


def token_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(docs, packed):
    """Every id of every document lies in one piece; sequences are gapless and of a power of two."""
    given = defaultdict(list)
    for r, ids in zip(rows := docs.collect(), token_ids([r.text for r in rows])):
        given[r.doc_id].append(tuple(ids))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in packed.collect():
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        pieces[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    for (doc_id, total), own in pieces.items():
        copies = [t for t in given[doc_id] if len(t) == total]
        own.sort(key=lambda p: p.start)
        covered = defaultdict(list)
        for p in own:
            for k, x in enumerate(p.ids):
                covered[p.start + k].append(x)
        assert sorted(covered) == list(range(total))
        assert all(sorted(covered[k]) == sorted(t[k] for t in copies) for k in covered)
    assert sum(len(t) for ts in given.values() for t in ts) == sum(p.length for own in pieces.values() for p in own)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert total <= 2048 and total & (total - 1) == 0 and {p.sequence_tokens for p in own} == {total}


def test_pieces_make_up_the_documents(small, messy):
    for docs in (small.repartition(3), messy.coalesce(1), messy.repartition(7)):
        check(docs, packing.pack(docs.select("doc_id", "text").checkpoint(), with_ids=True))


def test_long_sequences_and_even_steps(small):
    rows = packing.pack(small.coalesce(1)).collect()
    by_length, groups = defaultdict(int), defaultdict(int)
    for r in rows:
        by_length[r.sequence_tokens] += r.length
        groups[r.step_group] += r.length
    assert sum(n for t, n in by_length.items() if t < 256) < 256
    assert sum(n == packing.STEP_TOKENS for n in groups.values()) >= len(groups) - 3
    assert max(groups.values()) == packing.STEP_TOKENS


def test_short_documents_stay_whole_when_they_fit():
    packer = packing.Packer(0)
    for i in range(400):
        packer.add(i, np.arange(300 + i % 150, dtype=np.uint32))
    packer.finish()
    cut = defaultdict(int)
    for p in packer.out:
        cut[p[0]] += 1
    assert sum(n == 1 for n in cut.values()) > 150 and sum(p[2] for p in packer.out) == sum(300 + i % 150 for i in range(400))


def test_rank_file_gives_the_ids_of_the_json_file(messy, small):
    texts = [r.text or "" for r in messy.collect()] + [r.text for r in small.limit(80).collect()] + ["<|end|> it's  we'LL\r\n\t x", " 　 a"]
    mark = next(iter(packing.ADDED_TOKENS))
    texts += [f"hello {mark} world", mark, f"{mark}{mark}", f"a  {mark}  b\n", f"{mark[:-1]} {mark.upper()}"]
    encode = packing.encoder()
    assert [[*encode.encode_to_numpy(t, allowed_special="all").tolist(), 1] for t in texts] == token_ids(texts)
    assert token_ids([f"hello {mark} world"]) == [[31373, 220, 50256, 995, 1]]


def test_pieces_of_texts_with_the_added_token(spark):
    mark = next(iter(packing.ADDED_TOKENS))
    docs = spark.createDataFrame([(i, f"{mark} word {i} {mark}" * i) for i in range(40)], "doc_id long, text string").coalesce(2)
    check(docs, packing.pack(docs, with_ids=True))


def test_empty_and_wrong_tiers(nothing):
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, tiers=(2048, 1000))
