import pytest
from pyspark.sql import functions as F

from corefkit.llm import mixing as op
from tests.llm.conftest import SCHEMA, ordered, pairs


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Share by weight, cap at twice the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / rest > 2 * sizes[s] + 1e-9} if rest else set()
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        capped |= over
        left -= sum(2 * sizes[s] for s in over)


def test_targets_and_limits(docs, rows):
    got = op.mix(docs, ["doc_id", "source"], block_words=4, shard_words=200).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "taken")
    got = got.collect()
    assert ordered((r.doc_id, r.size) for r in got) == ordered((i, len((t or "").split())) for i, t in pairs(rows))
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 + 4 * (1 + sizes[s] // 200)


def test_order_and_partitions_do_not_matter(docs):
    a = op.mix(docs, ["doc_id"], shard_words=300).select("row.doc_id", "size", "target", "taken")
    b = op.mix(docs.orderBy(F.desc("doc_id")).repartition(7), ["doc_id"], shard_words=300).select(
        "row.doc_id", "size", "target", "taken")
    assert ordered(a.collect()) == ordered(b.collect())


def brute_seats(weights, seats):
    ranked = sorted(((-w / (2 * j - 1), k, j) for k, w in weights.items() if w > 0 for j in range(1, seats + 1)))
    out = dict.fromkeys(weights, 0)
    for _, k, _ in ranked[:seats]:
        out[k] += 1
    return out


def test_apportion_equals_all_quotients(spark):
    import random

    rng = random.Random(3)
    groups = {}
    for g in range(40):
        n = rng.choice([1, 2, 5, 30])
        groups[g] = ({k: rng.choice([0, 1, 7, 50, 1000, 99999]) * rng.randrange(1, 9) for k in range(n)}, rng.choice([0, 1, 3, 17, 200]))
    df = spark.createDataFrame([(g, k, w, s) for g, (ws, s) in groups.items() for k, w in ws.items()], "g long, k long, w long, s long")
    got = {(r.g, r.k): r.quota for r in op.apportion(df, ["g"], "k", "w", "s").collect()}
    for g, (ws, s) in groups.items():
        want = brute_seats(ws, s) if sum(ws.values()) else dict.fromkeys(ws, 0)
        assert {k: got[g, k] for k in ws} == want


def test_mixed_documents_hold_the_taken_words(docs):
    taken = {}
    for r in op.mix(docs, ["doc_id", "text"], block_words=4).collect():
        key = (r.row.doc_id, r.row.text)
        taken[key] = taken.get(key, 0) + r.taken
    out = op.mixed_documents(docs, block_words=4)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    by_id, want = {}, {}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.text.split()
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + len(r.text.split())
    for (i, _), n in taken.items():
        if n:
            want[i] = want.get(i, 0) + n
    assert by_id == want


def test_parts_keep_their_layout(spark):
    text = "  a b\n\n    c\td \n  e  f\n g h\t\n"
    df = spark.createDataFrame([(text,)], "text string")

    def cut(*part):
        return df.select(op.cut_out(F.col("text"), F.array(*[
            F.struct(F.lit(a).cast("long").alias("at"), F.lit(n).cast("long").alias("words")) for a, n in part]))).first()[0]

    assert cut((0, 4), (4, 4)) == text
    assert cut((0, 3)) == "  a b\n\n    c"
    assert cut((2, 2), (4, 1)) == "    c\td \n  e"
    assert cut((1, 1), (3, 1), (4, 1), (7, 1)) == "b\nd \n  e\nh\t\n"


def test_mix_of_texts_cuts_few_and_keeps_lines(spark):
    rows = [(k, "\n".join(f"  w{k}x{j}\ty{j}" for j in range(100 + k % 50)), f"s{k % 5}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    texts = {k: t for k, t, _ in rows}
    taken = op.mixed_documents(docs).collect()
    cut = [r for r in taken if r.text != texts[r.doc_id]]
    assert len(cut) < 0.1 * len(taken)
    whole_lines = 0
    for r in cut:
        lines = set(texts[r.doc_id].split("\n"))
        whole_lines += sum(x in lines for x in r.text.split("\n"))
        assert len(r.text.split()) <= 2 * len(r.text.split("\n"))
    assert whole_lines > 0 or not cut
    sizes, words = {}, {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in taken:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    want = brute_targets(sizes)
    for s in sizes:  # as exact as with blocks drawn one by one
        assert abs(words[s] - want[s]) <= op.BLOCK_WORDS * (2 + sizes[s] // op.SHARD_WORDS)


def test_empty_and_wordless_tables(spark, no_docs):
    assert op.mix(no_docs, ["doc_id"]).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in op.mix(blank, ["doc_id"]).collect()] == [0, 0]
    assert op.mixed_documents(blank).count() == 0


def test_native(spark):
    plan = op.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
