"""The pipeline's stages on a small table, and that each works on what the one before kept."""
import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from corefkit.llm import bpe, exact_dedup, mixing, simhash, toxicity
from corefkit.llm.common import staged
from tests.llm.test_exact_dedup import lower
from tests.llm.test_simhash import brute_groups, brute_print

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = staged(stage(spark, docs, SF), "test")
        counts.append(docs.count())
        if k < 3:
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0  # filters change no row
        if k == 1:
            assert exact_dedup.exact_groups(docs).where("group_size > 1").count() == 0
        if k == 2:
            assert simhash.near_groups(docs).where("component_id <> doc_id").count() == 0
        if k == 3:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert counts[4] == counts[5]
    assert docs.where("decoded_sha256 is null or n_tokens < 1").count() == 0


def test_odd_rows_pass_every_stage(spark, docs, no_docs):
    for start in (docs, no_docs):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            table = staged(stage(spark, table, SF), "test")
            if name != "byte-level BPE":
                assert table.columns == start.columns
        if start is no_docs:
            assert table.count() == 0
        else:
            assert table.count() > 0


def test_run_equals_the_stages(spark):
    a = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_every_stage_equals_brute_force(spark):
    """Each stage on the rows that the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        outputs.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    matcher = toxicity.Matcher(model.lexicon)
    clean = [r for r in start if model.score(np.array([matcher.features(r.text or "")]))[0] < 0.5]
    assert {r.doc_id for r in outputs[0]} == {r.doc_id for r in clean}

    last = {}
    for r in outputs[0]:
        last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), r.doc_id))
    assert {r.doc_id for r in outputs[1]} == set(last.values())

    prints = [(r.doc_id, brute_print(r.text)) for r in outputs[1]]
    assert {r.doc_id for r in outputs[2]} == set(brute_groups(prints, 2).values())

    taken = {r.row.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(outputs[2]), ["doc_id"]).collect()}
    words = dict.fromkeys(taken, 0)
    texts = {r.doc_id: r.text.split() for r in outputs[2]}
    for r in outputs[3]:
        words[r.doc_id] += len(r.text.split())
        rest = iter(texts[r.doc_id])
        assert all(w in rest for w in r.text.split())  # the words of the document in their order
    assert words == taken

    with open(P.path(bpe.RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in outputs[3]:
        ids = np.array(own.encode_ordinary(r.text), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r)[:4] for r in outputs[4]) == sorted(want)
