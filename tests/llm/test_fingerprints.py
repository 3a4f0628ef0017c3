import hashlib
import re
import statistics

from pyspark.sql import functions as F

from storygauge.llm import fingerprints as fp


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rows):
    """(id, edited text, next text) in the order of ids, null ids last, then of MD5; repeated rows are one."""
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    for (unnamed, i, _, t), (*_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        yield None if unnamed else i, t, t[:len(t) - half] + after[:half], after


def test_edited_texts_and_likeness(small, messy, many_parts):
    for docs in (small, messy):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        with many_parts():
            got = fp.with_edited(docs).select("doc_id", "n_chars", "edited_text", "near_edited", "near_next").collect()
        assert len(got) == len(rows)
        expected = {(i, e): (t, n) for i, t, e, n in edited(rows)}
        assert {(r.doc_id, r.edited_text) for r in got} == set(expected)
        off = []
        for r in got:
            text, after = expected[r.doc_id, r.edited_text]
            assert r.n_chars == len(text)
            off += [r.near_edited - jaccard(text, r.edited_text), r.near_next - jaccard(text, after)]
        assert max(map(abs, off)) < 0.25 and abs(statistics.mean(off)) < 0.02


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("a  b\nc d e f g",), ("",), (None,), ("a b",)], "t string")
    prints = [tuple(r[0]) for r in df.select(fp.fingerprint(F.col("t"))).collect()]
    assert prints[0] == prints[1] and prints[2] == prints[3] and len(set(prints)) == 3
    assert all(len(p) == 8 for p in prints)


def test_densified_against_plain_python(spark):
    """Bins, low bits and borrowing written out step by step give the same packed words."""
    texts = ["one two three four five six seven", "a b", " ".join(f"w{i}" for i in range(90))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    starts, steps, _ = fp.probe_orders()
    for r in df.select(fp.shingle_hashes(F.col("t")).alias("h"), fp.fingerprint(F.col("t")).alias("f")).collect():
        least = {}
        for h in sorted(r.h):
            least.setdefault((h & (1 << 64) - 1) >> (64 - fp.BIN_BITS), h & 15)
        filled = []
        for j in range(fp.BINS):
            order = [j] + [(starts[j] + steps[j] * k) % fp.BINS for k in range(fp.BINS)]
            filled.append(next(least[b] for b in order if b in least))
        packed = [int("".join(f"{x:x}" for x in filled[g:g + 16]), 16) for g in range(0, fp.BINS, 16)]
        assert [x & (1 << 64) - 1 for x in r.f] == packed


def test_likeness_is_corrected_for_chance(spark):
    texts = [(" ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400)))] + [
        (" ".join(f"c{k}{i}" for i in range(400)), " ".join(f"c{k}{i}" for i in range(200, 600))) for k in range(20)]
    df = spark.createDataFrame(texts, "a string, b string")
    near = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert near[0] < 0.08 and abs(statistics.mean(near[1:]) - 196 / 596) < 0.04


def test_empty(nothing):
    assert fp.with_edited(nothing).count() == 0
