import pytest

from corefkit.llm import line_dedup as op
from tests.llm.conftest import SCHEMA, ordered, pairs

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_docs=3, min_chars=20):
    def key(line):
        return line.strip(BLANK).translate({k: k + 32 for k in range(65, 91)})

    holders = {}
    for n, (i, t) in enumerate(pairs(rows)):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in pairs(rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return ordered(out)


def many_lines(n):
    lines = [f"A line of number {k % 90:04d} that is long enough" for k in range(200)] + ["short", "", "  \t"]
    return [(k, "\n".join(lines[(k * 7 + j * (1 + k % 3)) % len(lines)] for j in range(k % 17)), None, None, None) + ("x",) * 12
            for k in range(n)]


def test_equals_brute_force(docs, rows):
    assert ordered(op.dedup_lines(docs).collect()) == brute(rows)


def test_filters_are_probed_by_shard_as_in_place(spark):
    rows = many_lines(80)
    docs = spark.createDataFrame(rows, SCHEMA)
    index = op.LineIndex.build(docs, shard_keys=16)
    assert index.shards > 1
    want = brute(rows)
    assert ordered(index.dedup(docs).collect()) == want
    for probe_keys in (op.PROBE_KEYS, 3):
        assert ordered(index.dedup(docs, max_bytes=0, probe_keys=probe_keys).collect()) == want
    # lines that no listed key covers are held back by the filters, not by the counts
    others = [(k, "\n".join(f"unlisted line {k} {j} of this document" for j in range(200)), None) for k in range(20)]
    keyed = op._keyed(spark.createDataFrame([r[:2] for r in others], "doc_id long, text string"), op.MIN_CHARS)
    here, shards = (ordered(index.probe(keyed, max_bytes=m, probe_keys=50).collect()) for m in (op.MAX_FILTER_BYTES, 0))
    assert here == shards and len(here) < 40  # of 4,000 lines


def test_deleting_what_was_inserted_restores_the_index(spark):
    rows = many_lines(120)
    first, more = spark.createDataFrame(rows[:70], SCHEMA), spark.createDataFrame(rows[70:], SCHEMA)
    both = spark.createDataFrame(rows, SCHEMA)
    start = op.LineIndex.build(first, shard_keys=16)
    assert start.shards > 1
    grown = start.insert(more)
    assert ordered(grown.dedup(both).collect()) == brute(rows)
    back = grown.delete(more.select("doc_id"))
    assert ordered(back.counts.collect()) == ordered(start.counts.collect())
    assert ordered(back.dedup(first).collect()) == brute(rows[:70])
    # deleting the largest holder passes its lines on to the next
    less = grown.delete(spark.createDataFrame([(119,), (118,), (3,)], "doc_id long"))
    left = [r for r in rows if r[0] not in (119, 118, 3)]
    assert ordered(less.dedup(spark.createDataFrame(left, SCHEMA)).collect()) == brute(left)


def test_a_full_filter_is_rebuilt(spark):
    def docs_of(a, b):
        rows = [(k, "\n".join(f"line {j} of the many that all hold" for j in range(a, b))) for k in range(3)]
        return spark.createDataFrame(rows, "doc_id long, text string"), rows

    one, _ = docs_of(0, 3)
    two, rows = docs_of(0, 300)
    index = op.LineIndex.build(one).insert(docs_of(3, 300)[0])
    assert index.counts.where("refs >= 3").count() == 300
    assert ordered(index.dedup(two).collect()) == ordered((i, 300, 0 if i == 2 else 300, t if i == 2 else "") for i, t in rows)


def test_cuckoo_filter_holds_and_forgets():
    import random

    import numpy as np

    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-2**63, 2**63 - 1, (2, 3000))
    held = op.CuckooFilter.sized_for(3000)
    assert held.insert_all(k1, k2, random.Random(0))
    probe = op.Filters(1, {0: held.table.tobytes()})
    assert probe.probe(k1, k2).all()
    others = rng.integers(-2**63, 2**63 - 1, (2, 20000))
    assert probe.probe(*others).mean() < 0.001
    for a, b in zip(k1[:1500].tolist(), k2[:1500].tolist()):
        held.delete(a, b)
    probe = op.Filters(1, {0: held.table.tobytes()})
    assert probe.probe(k1[1500:], k2[1500:]).all() and probe.probe(k1[:1500], k2[:1500]).mean() < 0.01


def test_empty_table(no_docs):
    assert op.dedup_lines(no_docs).count() == 0
