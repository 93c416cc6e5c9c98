import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from corefkit.llm import scaled_sketch as op
from corefkit.llm.common import WORD_PATTERN
from tests.llm.conftest import ordered, pairs


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_sketch(text, k=5, scale=8):
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
    grams = [words[i:i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = set()
    for g in grams:
        h = 42
        for w in g:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        hashes.add(signed(h))
    few = {h for h in hashes if h < -(1 << 63) + (1 << 64) // scale}
    return sorted(few or ([min(hashes)] if hashes else []))


def brute(rows, scale=8):
    at = {}
    for i, t in pairs(rows):
        at.setdefault(i, []).append(t or "")
    ids = sorted(at, key=lambda i: (i is not None, i))
    out = []
    for i, t in pairs(rows):
        t = t or ""
        after = at[ids[(ids.index(i) + 1) % len(ids)]]
        need = max(len(x) for x in at[i]) // 4
        prefix, following = min((x[:need].encode(), brute_sketch(x, 5, scale)) for x in after)
        q = len(t) // 4
        edited = t[:len(t) - q] + prefix.decode()[:q]
        a, b = brute_sketch(t, 5, scale), brute_sketch(edited, 5, scale)

        def near(x, y):
            least = min(len(x), len(y))
            return len(set(x) & set(y)) / least if least else float(len(x) == len(y))

        hexes = ["".join(f"{h & (1 << 64) - 1:016x}" for h in x) for x in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexes, near(a, b), near(a, following)))
    return ordered(out)


@pytest.mark.parametrize("scale, bucket_rows", [(1, 1024), (8, 1024), (8, 3), (8, 1)])
def test_equals_brute_force(docs, rows, scale, bucket_rows):
    got = op.fingerprint_edits(docs, scale=scale, bucket_rows=bucket_rows)
    assert ordered(got.collect()) == brute(rows, scale)


def test_scattered_ids(spark):
    ids = [-(2**63), -7, -1, 0, 3, 4, 10**12, 10**12 + 1, 2**63 - 1, None]
    rows = [(i, " ".join(f"w{k}x{j}" for j in range(30 + k))) for k, i in enumerate(ids)]
    got = op.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=2)
    assert ordered(got.collect()) == brute(rows, 2)


def test_texts_are_shuffled_once(spark):
    plan = op.query(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    exchanges = {line for line in plan.splitlines() if "Exchange hashpartitioning(bucket" in line and "REPARTITION" in line}
    assert exchanges


def test_sketches_merge(spark):
    a, b = " ".join(f"a{k}" for k in range(300)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(op.sketch(F.col("a")).alias("x"), op.sketch(F.col("b")).alias("y")).select(
        op.merge(F.array("x", "y")).alias("m"), "x", "y").first()
    assert r.m == sorted({*r.x, *r.y} if r.x and r.y else r.m)


def test_containment_of_a_part_in_a_much_longer_text(spark):
    whole = " ".join(f"w{k}" for k in range(6000))
    part = " ".join(f"w{k}" for k in range(1000, 1400))
    df = spark.createDataFrame([(whole, part)], "a string, b string")
    assert df.select(op.containment(op.sketch(F.col("a")), op.sketch(F.col("b")))).first()[0] == 1.0


def exact(a, b):
    """Containment of the texts' shingle sets, on all hashes."""
    x, y = (set(brute_sketch(t or "", 5, 1)) for t in (a, b))
    least = min(len(x), len(y))
    return len(x & y) / least if least else float(len(x) == len(y))


def test_short_parts_of_long_texts(spark):
    """Parts of 8 to 30 words before and after the long text that holds them whole, and as unlike neighbours."""
    texts = []
    for n in range(8, 31):
        words = [f"w{n}x{k}" for k in range(3000)]
        texts += [" ".join(words[500:500 + n]), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op.fingerprint_edits(df, whole=op.WHOLE).collect()}
    for k in range(0, len(texts), 2):
        assert got[k].near_next == 1.0  # the long text is next
        assert got[k + 1].near_next == 0.0  # the part of another text is next
    turned = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.fingerprint_edits(turned, whole=op.WHOLE).collect()}
    for k in range(0, len(texts), 2):
        assert got[len(texts) - k - 1].near_next == 1.0  # the part is next


def parsed(text):
    """The hashes of a printed fingerprint."""
    return {signed(int(text[k:k + 16], 16)) for k in range(0, len(text), 16)}


def from_prints(a, b, scale=op.SCALE):
    """Likeness of two printed fingerprints, from them alone."""
    a, b = parsed(a), parsed(b)
    limit = -(1 << 63) + (1 << 64) // scale
    if a and b and not (max(a) >= limit and max(b) >= limit):
        a, b = ({h for h in x if h < limit} for x in (a, b))
    least = min(len(a), len(b))
    return len(a & b) / least if least else float(len(a) == len(b))


def test_likeness_follows_from_the_printed_fingerprints(spark):
    """Of every row; and it is exact between two short texts, close to exact otherwise."""
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op.query(spark, path).collect()}
    short = 0
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        text, row = r.text or "", got[r.doc_id]
        q = len(text) // 4
        edited = text[:len(text) - q] + (after.text or "")[:q]
        assert row.near_edited == from_prints(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == from_prints(row.fingerprint, got[after.doc_id].fingerprint)
        for near, other in ((row.near_edited, edited), (row.near_next, after.text or "")):
            if max(len(brute_sketch(t, 5, 1)) for t in (text, other)) <= op.WHOLE and all(
                    max(brute_sketch(t, 5, 1), default=0) >= 0 for t in (text, other)):
                short += 1
                assert near == exact(text, other)
            else:
                assert abs(near - exact(text, other)) < 0.3
    assert short > 0


def test_likeness_of_whole_thin_and_empty_sketches(spark):
    df = spark.createDataFrame([([-9, -5, 3, 7], [-9, -5, -4], [1, 2], [])],
                               "whole array<long>, part array<long>, upper array<long>, empty array<long>")
    near = lambda a, b: df.select(op.likeness(F.col(a), F.col(b))).first()[0]
    assert near("whole", "whole") == near("upper", "upper") == near("empty", "empty") == 1.0
    assert near("whole", "part") == near("part", "whole") == 1.0  # of -9, -5 and -9, -5, -4
    assert near("upper", "part") == near("upper", "whole") == 0.0
    assert near("empty", "upper") == near("part", "empty") == 0.0


def test_single_document_and_empty_table(spark, no_docs):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert op.fingerprint_edits(one).first().near_next == 1.0
    assert op.fingerprint_edits(no_docs).count() == 0


def test_native(spark, docs):
    plan = op.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert WORD_PATTERN in plan
