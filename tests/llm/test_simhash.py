import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corefkit.llm import simhash as op
from tests.llm.conftest import SCHEMA, ordered, pairs


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits):
    """prints: (doc_id, fp) -> fp -> smallest id reachable."""
    parent = {fp: fp for _, fp in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    low = {}
    for i, fp in prints:
        if i is not None:
            low[find(fp)] = min(i, low.get(find(fp), i))
    return {fp: low.get(find(fp)) for fp in nodes}


def test_equals_brute_force(docs, rows):
    prints = [(i, brute_print(t)) for i, t in pairs(rows)]
    group = brute_groups(prints, 2)
    want = ordered((i, f"{fp:016x}", group[fp]) for i, fp in prints)
    assert ordered(op.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()) == want


def fake_prints(seed):
    """Random prints, chains of one- and two-bit steps, and a dense ball around one value."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(120)]
    for start in out[:10]:
        x = start
        for _ in range(12):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5 and 1 << rng.randrange(64)) for _ in range(150)]
    out += [0, 1, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 4]
    return [(k, x) for k, x in enumerate(out)]


@pytest.mark.parametrize("max_bucket,bits", [(64, 2), (3, 2), (1, 2), (64, 1), (1, 1), (64, 0)])
def test_every_link_counts_at_any_bucket_size(spark, max_bucket, bits):
    prints = fake_prints(bits)
    df = spark.createDataFrame([(i, op._signed(x)) for i, x in prints], "doc_id long, fp long")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in op.group_fingerprints(df, bits, max_bucket).collect()}
    assert got == brute_groups(prints, bits)


@pytest.mark.parametrize("parts,max_bucket", [(5, 64), (7, 3), (11, 64)])
def test_every_link_counts_at_any_number_of_parts(spark, parts, max_bucket):
    prints = fake_prints(parts)
    df = spark.createDataFrame([(i, op._signed(x)) for i, x in prints], "doc_id long, fp long")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in op.group_fingerprints(df, 2, max_bucket, parts).collect()}
    assert got == brute_groups(prints, 2)


def test_two_bits_always_leave_a_key_alone():
    """Whatever two blocks the differing bits lie in, some key has neither; keys lengthen with the input."""
    for parts in op.PARTS:
        masks = op.key_masks(parts)
        assert sorted(set(op.dealt(parts))) == list(range(parts))
        assert all(any(not mask >> 2 * a & 3 and not mask >> 2 * b & 3 for mask in masks)
                   for a in range(32) for b in range(32))
    chosen = [op.parts_for(10**k) for k in range(0, 12)]
    assert chosen == sorted(chosen) and chosen[0] == 4 and chosen[-1] in op.PARTS
    for k, parts in enumerate(chosen):
        sharers = 10**k * 0.375 ** min(m.bit_count() // 2 for m in op.key_masks(parts))
        assert sharers <= op.KEY_ROWS


def test_pivots_decide_without_crowds(spark):
    """No key of unlike fingerprints is dense at the number of parts that is chosen."""
    rng = random.Random(3)
    table = op.pivot_table(spark.createDataFrame([(op._signed(rng.getrandbits(64)),) for _ in range(20000)], "fp long"))
    for mask in op.key_masks(op.parts_for(20000)):
        assert table.groupBy(F.col("blocks").bitwiseAND(F.lit(op._signed(mask)))).count().agg(F.max("count")).first()[0] <= 64


def test_chunks_do_not_change_a_print(monkeypatch):
    text = " ".join(f"w{k % 91}" for k in range(1000)).encode()
    whole = op.fingerprint(text)
    monkeypatch.setattr(op, "CHUNK", 7)
    assert op.fingerprint(text) == whole == brute_print(text.decode())


def test_one_of_each_group_stays(docs, rows):
    group = {r.doc_id: r.component_id for r in op.near_groups(docs).collect()}
    stay = op.drop_near(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({v for v in group.values() if v is not None})


def test_empty_table(no_docs):
    assert op.near_groups(no_docs).count() == 0
    assert op.drop_near(no_docs).count() == 0


def test_no_cross_join(spark, docs):
    df = docs.select("doc_id", op.fingerprint_column(F.col("text")).alias("fp"))
    plan = op.links(df.select("fp").distinct())._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_drop_near_with_any_column_names_and_repeated_ids(spark):
    rows = [(1, "a b c d", "p", 1), (1, "a b c d", "p", 1), (1, "A b c D", "q", 2), (2, "a b c d", "r", 3), (None, "", "s", 4),
            (None, None, "t", 5), (7, "x y z", "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __fp string, key int")
    got = op.drop_near(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted((r[0] is None, r[0]) for r in kept) == [(False, 1), (False, 7), (True, None)]
    assert set(kept) <= set(rows)
