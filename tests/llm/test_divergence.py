import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corefkit.llm import divergence as op
from tests.llm.conftest import ordered

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    """The contract, word by word, over (text, lang, source)."""
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        groups[lang].add(source)
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        ps = {s: p(tf[lang, s]) for s in sources}
        q = p(sum((tf[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(ps[s][t] - q[t], t) for t in kept if tf[lang, s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                limit = len(found) if part == "pair" else top
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return ordered(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "naïve", "漢字", "a1b", "x-y", "z", "ÄB", "äb"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    out = []
    for k in range(n):
        source = rng.choice([None, "", "s1", "s2", "S2", "é", "hot", "hot", "hot"])
        text = " ".join(rng.choice(words[: rng.choice([9, 30, 69])]) for _ in range(rng.randrange(40)))
        out.append((rng.choice([None, "", text, text, text, text + "\x00 B", text.upper()]), rng.choice(["en", "en", "de", None, "xx"]), source))
    return out + [("lonely", "one", "only"), (None, "one", "empty"), ("zq " * 3, "two", "a")]


@pytest.mark.parametrize("seed, n, min_docs, index", [
    (1, 300, 5, {}), (2, 300, 30, {"block_postings": 40}), (3, 200, 1, {"block_bytes": 300, "shards": 3}), (4, 60, 1000, {})])
def test_equals_brute_force(spark, monkeypatch, seed, n, min_docs, index):
    rows = corpus(seed, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = op.audit(docs.repartition(3), min_docs, top_terms=50, **index)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert ordered(got.collect()) == brute(rows, min_docs)


def test_odd_rows(docs, rows):
    assert ordered(op.audit(docs, 2).collect()) == brute([(r[1], r[2], r[3]) for r in rows], 2)


def test_empty_table(no_docs):
    assert op.audit(no_docs).count() == 0


def test_spilled_runs_are_sorted_and_memory_is_freed():
    rows = corpus(9, 200)
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows],
                                        "text": [(r[0] or "").encode() for r in rows]})
    runs = [r for b in op._index(4, 50, 1 << 30)(iter([batch])) for r in b.to_pylist()]
    groups = {(r["lang"], s) for r in runs if r["shard"] == -1 for s in r["sources"]}
    assert groups == {(r[1] or "", r[2] or "") for r in rows}
    seen, docs = Counter(), Counter()
    for r in runs:
        found = [t for t, _, _ in op.read_run(0, r["terms"], r["sizes"])]
        assert found == sorted(found) and len(found) < 100
        assert all(op.shard_of(t, 4) == r["shard"] for t in found)
        ids, counts = np.frombuffer(r["ids"], np.uint32).tolist(), np.frombuffer(r["counts"], np.int64).tolist()
        at = 0
        for t, n, d in zip(found, np.frombuffer(r["posts"], np.uint32).tolist(), np.frombuffer(r["n_docs"], np.int64).tolist()):
            docs[r["lang"], t] += d
            for k, c in zip(ids[at:at + n], counts[at:at + n]):
                seen[r["lang"], r["sources"][k], t] += c
            at += n
        assert at == len(ids) == len(counts)
    want, want_docs = Counter(), Counter()
    for text, lang, source in rows:
        terms = [t.translate(LOWER).encode() for t in TERM.findall(text or "")]
        want.update((lang or "", source or "", t) for t in terms)
        want_docs.update((lang or "", t) for t in set(terms))
    assert seen == want and docs == want_docs


@pytest.mark.parametrize("block, held", [(256, 64), (2, 64), (2, 2), (1, 1)])
def test_pair_corrections_in_blocks(monkeypatch, block, held):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de"]), sorted(rng.sample("abcdefg", 4)), [rng.randrange(90) for _ in range(4)],
             [rng.randrange(9) for _ in range(4)]) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict(dict(zip(["lang", "source", "p", "base"], map(list, zip(*rows)))))
    monkeypatch.setattr(op, "PAIR_BLOCK", block)
    monkeypatch.setattr(op, "BLOCKS_HELD", held)
    got, want = Counter(), Counter()
    for b in op._pair_corrections(iter([batch])):
        for r in b.to_pylist():
            if r["source"] != r["other"]:
                got[r["lang"], r["source"], r["other"]] += r["value"]
    for lang, sources, p, base in rows:
        for i, s in enumerate(sources):
            for j, o in enumerate(sources):
                if i != j:
                    want[lang, s, o] += abs(p[i] - p[j]) - abs(p[i] - base[j]) - abs(p[j] - base[i]) + abs(base[i] - base[j])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_probability_is_exact(spark):
    counts = [(0, 10, 3), (7, 7, 1), (10**12, 3 * 10**12, 10**6), (123456789012, 999999999999, 77), (0, 0, 1)]
    rows = spark.createDataFrame(counts, "c long, n long, v long")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(op.probability(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in counts]
    assert np.all(np.array(got) > 0)
