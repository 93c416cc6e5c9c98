"""The response store: its bucketed state, recovery between commits, and what a lookup reads."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corefkit.operators import inference as INF
from corefkit.plans import fixtures as fx
from corefkit.plans import stubs
from corefkit.session import shared_dir
from corefkit.sources import response_store as RS
from corefkit.streaming.collect_stream import collect_stream, collected_table
from tests.conftest import SF_SMALL


def chunk(spark, ids, attempt=1, failed=()):
    rows = [(i, attempt, None if i in failed else "Yes", None if i in failed else "t", "e" if i in failed else None) for i in ids]
    return spark.createDataFrame(rows, RS.RESPONSE_LOG_SCHEMA)


def ids_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "pair_id string")


def rows_read(spark, ids, store):
    """Rows in the files that a lookup of ``ids`` opens."""
    found = RS._state_files(ids_frame(spark, ids), store)
    return spark.read.parquet(*found).count() if found else 0


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(RS, "BUCKET_ROWS", 8)
    monkeypatch.setattr(RS, "FIRST_BUCKETS", 2)


def test_state_follows_the_log(spark, small_buckets):
    store, rng = shared_dir(spark, "test_state", unique=True), random.Random(3)
    want = {}
    for attempt in range(1, 5):
        ids = [f"p{k}" for k in rng.sample(range(120), 40)]
        failed = set(rng.sample(ids, 10))
        RS.append_chunk(chunk(spark, ids, attempt, failed), store)
        for i in ids:
            _, done = want.get(i, (0, False))
            want[i] = (attempt, done or i not in failed)
    asked = [f"p{k}" for k in range(120)]
    got = {r.pair_id: (r.last, r.done) for r in RS.read_state(ids_frame(spark, asked), store).collect()}
    assert got == want
    few = {r.pair_id: (r.last, r.done) for r in RS.read_state(ids_frame(spark, ["p3", "p77"]), store).collect()}
    assert {i: want[i] for i in ("p3", "p77") if i in want} == {i: v for i, v in few.items() if i in ("p3", "p77")}
    assert all(want[i] == v for i, v in few.items())


def test_rows_read_do_not_grow_with_the_store(spark, small_buckets):
    store = shared_dir(spark, "test_growth", unique=True)
    asked, read, size = [f"q{k}" for k in range(4)], [], []
    for wave in range(4):
        new = [f"w{wave}-{k}" for k in range(40 * 3**wave)]
        RS.append_chunk(chunk(spark, new), store)
        read.append(rows_read(spark, asked, store))
        size.append(RS.read_log(spark, store).count())
    assert size[-1] > 20 * size[0]
    assert max(read) <= 2 * 2 * RS.BUCKET_ROWS * len(asked)  # twice the bound of an average bucket
    _, buckets, covered, rows = RS._generation(spark, store)
    assert buckets * RS.BUCKET_ROWS >= rows and covered >= 1


def test_a_chunk_without_a_marker_is_recorded_at_the_next_lookup(spark, monkeypatch):
    store = shared_dir(spark, "test_lost", unique=True)
    RS.append_chunk(chunk(spark, ["a", "b"]), store)
    with monkeypatch.context() as m:
        m.setattr(RS, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            RS.append_chunk(chunk(spark, ["c"], 1, {"c"}), store)
    got = {r.pair_id: (r.last, r.done) for r in RS.read_state(ids_frame(spark, ["a", "b", "c"]), store).collect()}
    assert got == {"a": (1, True), "b": (1, True), "c": (1, False)}
    RS.append_chunk(chunk(spark, ["d"]), store)
    assert RS.read_log(spark, store).count() == 4


def test_a_broken_chunk_is_not_read_and_its_number_is_used_again(spark):
    store = shared_dir(spark, "test_broken", unique=True)
    RS.append_chunk(chunk(spark, ["a"]), store)
    bad = chunk(spark, ["b"]).withColumn("error", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        RS.append_chunk(bad, store)
    RS.append_chunk(chunk(spark, ["c"]), store)
    assert {r.pair_id for r in RS.read_log(spark, store).collect()} == {"a", "c"}
    assert RS._chunks(spark, store) == [0, 1]


def test_each_prompt_is_read_once(spark):
    store = shared_dir(spark, "test_prompts", unique=True)
    pairs = fx.pairs(spark, SF_SMALL).where("pair_id % 5 = 0")
    n = pairs.count()
    waves = list(INF.prompt_waves(pairs, store, wave_rows=25))
    files = [set(w.inputFiles()) for w in waves]
    assert len(waves) > 3 and sum(map(len, files)) == len(set().union(*files))  # no file belongs to two waves
    assert sum(spark.read.parquet(*f).count() for f in files) == n
    seen = [r.pair_id for w in waves for r in w.collect()]
    assert len(seen) == len(set(seen)) == n


def test_stream_asks_new_rows_only(spark):
    base = shared_dir(spark, "test_stream", unique=True)
    pairs = fx.pairs(spark, SF_SMALL)
    part = F.pmod(F.xxhash64("pair_id"), F.lit(3))
    asked = []
    for k in range(3):  # the last delivery brings the first rows again
        (pairs.where(part == k) if k < 2 else pairs.where(part == 0)).write.mode("append").parquet(f"{base}/pairs")
        collect_stream(spark, f"{base}/pairs", pairs.schema, lambda: stubs.HashStubClient(fail_mod=10**9), f"{base}/store",
                       f"{base}/checkpoint")
        asked.append(RS.read_log(spark, f"{base}/store").count())
    n = [pairs.where(part == k).count() for k in range(2)]
    assert asked == [n[0], n[0] + n[1], n[0] + n[1]]
    merged = collected_table(spark, pairs.where(part < 2).withColumn("pair_id", F.col("pair_id").cast("string")), f"{base}/store")
    assert merged.where("model_response is null").count() == 0


def test_the_state_is_written_once_for_the_waves_of_a_call(spark, small_buckets, monkeypatch):
    store, record, calls = shared_dir(spark, "test_waves", unique=True), RS._record, []
    monkeypatch.setattr(RS, "_record", lambda *a: (calls.append(a), record(*a)))
    pairs = fx.pairs(spark, SF_SMALL).where("pair_id % 5 = 0")
    INF.ask_pending(pairs, lambda: stubs.HashStubClient(fail_mod=10**9), store, tasks=2, wave_rows=25)
    assert len(RS._chunks(spark, store)) > 3 and set(RS._recorded(spark, store)) == set(RS._chunks(spark, store))
    assert len(calls) == 1
    state = RS.read_state(pairs.select(F.col("pair_id").cast("string")), store)
    assert state.where("done and last = 1").count() == pairs.count()


def test_waves_before_a_failed_one_are_recorded_at_the_next_lookup(spark):
    store = shared_dir(spark, "test_failed_wave", unique=True)
    bad = chunk(spark, ["c"]).withColumn("error", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        RS.append_chunks(iter([chunk(spark, ["a"]), chunk(spark, ["b"], 1, {"b"}), bad]), store)
    got = {r.pair_id: (r.last, r.done) for r in RS.read_state(ids_frame(spark, ["a", "b", "c"]), store).collect()}
    assert got == {"a": (1, True), "b": (1, False)}


def own_pairs(spark, ids):
    rows = [(k, f"Sentence {n} has words", 1, 1, str(n), "Another sentence", 0, 0, "Another", n % 2) for n, k in enumerate(ids)]
    return spark.createDataFrame(rows, "pair_id long, sentence1 string, e1_trigger_start int, e1_trigger_end int, e1_trigger string, "
                                 "sentence2 string, e2_trigger_start int, e2_trigger_end int, e2_trigger string, label int")


def files_below(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def test_a_call_leaves_nothing_but_the_store(spark):
    base, store = shared_dir(spark), shared_dir(spark, "test_leaves_nothing", unique=True)
    pairs = own_pairs(spark, range(60)).repartition(3)
    before = files_below(base)
    for client in (lambda: stubs.HashStubClient(fail_mod=3, fail_once=True),) * 2:
        merged = INF.collect_responses(pairs, client, store, tasks=2, wave_rows=20)
    assert merged.where("reasoning_content is null").count() == 0
    left = files_below(base) - before
    assert left and all(f.startswith(f"{store}/") for f in left)


def test_a_micro_batch_is_not_copied(spark):
    base = shared_dir(spark, "test_no_copy", unique=True)
    own_pairs(spark, range(60)).write.parquet(f"{base}/pairs")
    before = files_below(shared_dir(spark))
    collect_stream(spark, f"{base}/pairs", own_pairs(spark, []).schema, lambda: stubs.HashStubClient(fail_mod=10**9), f"{base}/store",
                   f"{base}/checkpoint")
    assert RS.read_log(spark, f"{base}/store").count() == 60
    left = files_below(shared_dir(spark)) - before
    assert left and all(f.startswith((f"{base}/store/", f"{base}/checkpoint/")) for f in left)


def test_repeated_and_null_ids_are_asked_as_often_as_they_come(spark):
    store = shared_dir(spark, "test_repeated_ids", unique=True)
    pairs = own_pairs(spark, [1, 2, 2, 3, 3, 3, None, None]).repartition(4)
    RS.append_chunk(chunk(spark, ["1", "3"], 1, {"3"}), store)
    waves = [[(r.pair_id, r.attempt) for r in w.collect()] for w in INF.prompt_waves(pairs, store, wave_rows=3)]
    assert len(waves) > 1
    got = sorted((x for w in waves for x in w), key=str)
    assert got == sorted([("2", 1)] * 2 + [("3", 2)] * 3 + [(None, 1)] * 2, key=str)
