import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from storygauge.llm import exact_dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row; null ids come last."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    keep = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    return sorted(((i, keep[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows), key=repr)


def test_matches_brute_force(small, messy, many_parts):
    for docs in (small, messy):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        with many_parts():
            got = exact_dedup.exact_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
        assert sum(r.kept for r in got) == len({plain(t) for _, t in rows})


def test_a_hash_that_collides_changes_nothing(messy):
    weak = lambda t: F.unhex(F.md5(F.substring(t, 1, 1)))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    expected = exact_dedup.exact_duplicates(messy).select(columns)
    got = exact_dedup.exact_duplicates(messy, weak).select(columns)
    assert sorted(got.collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_kept_documents_have_all_their_columns(messy):
    kept = exact_dedup.without_duplicates(messy)
    assert kept.schema == messy.schema
    rows = kept.collect()
    assert len(rows) == len({plain(r.text) for r in messy.collect()})
    assert [r.doc_id for r in rows].count(10) == 2  # two texts of one id; the repeated row is gone


def test_empty(nothing):
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert exact_dedup.without_duplicates(nothing).count() == 0
