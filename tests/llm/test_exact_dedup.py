import hashlib

import pytest

from corefkit.llm import exact_dedup as op
from tests.llm.conftest import SCHEMA, ordered, pairs


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def brute(rows):
    groups = {}
    for i, t in pairs(rows):
        groups.setdefault(lower(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1, sha))
            left -= i == keep
    return ordered(out)


@pytest.mark.parametrize("block_bytes", [7, 64, 4096])
def test_equals_brute_force(docs, rows, block_bytes):
    got = op.exact_groups(docs, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert ordered(got.collect()) == brute(rows)


def test_blocks_that_share_a_hash_keep_their_own_names(docs, rows):
    got = op.exact_groups(docs, block_bytes=64, hash_of=lambda b: b[0] % 5 if b else 0)
    assert ordered(got.collect()) == brute(rows)


def test_one_row_of_each_group_stays(docs, rows):
    stay = op.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(lower(r.text) for r in stay.collect()) == sorted({lower(t) for _, t in pairs(rows)})
    kept = {(i, sha) for i, _, _, k, sha in brute(rows) if k}
    assert {(r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in stay.collect()} == kept


def test_empty_table(no_docs):
    assert op.exact_groups(no_docs).count() == 0
    assert op.drop_copies(no_docs).count() == 0


def test_a_row_repeated_more_often_than_one_array_holds(spark, monkeypatch):
    monkeypatch.setattr(op, "COPIES", 4)
    many = spark.createDataFrame([(1, "Same")] * 11 + [(0, "same")], "doc_id long, text string")
    got = op.exact_groups(many).collect()
    assert len(got) == 12 and sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {12}
    assert op.drop_copies(many).count() == 1


def test_names_are_places_in_the_sorted_order(spark, docs):
    found = [{(r.doc_id, r.text_sha256): (r.level, r.name) for r in op.identities(docs.repartition(n), block_bytes=32).collect()}
             for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
    rows = spark.range(500).selectExpr("id * 7 % 100 as l", "id % 13 as r").distinct()
    names = {(r.l, r.r): r.name for r in op._named_pairs(rows).collect()}
    assert [names[k] for k in sorted(names)] == list(range(len(names)))


def test_drop_copies_with_any_column_names(spark):
    rows = [(1, "a", "p", 1), (2, "A", "q", 2), (2, "a", "r", 3), (3, "b", "s", 4), (3, "b", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, row int")
    kept = sorted(map(tuple, op.drop_copies(docs).collect()))
    assert kept == [(2, "A", "q", 2), (3, "b", "s", 4)] or kept == [(2, "a", "r", 3), (3, "b", "s", 4)]
    assert op.drop_copies(docs).columns == docs.columns
