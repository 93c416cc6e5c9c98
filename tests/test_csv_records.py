"""Multi-line CSV by splits, against Spark's own reader of whole files."""

import random

import pytest

from corefkit.session import shared_dir
from corefkit.sources import tables as T

SCHEMA = "pair_id bigint, text string, more string"


def rows(seed, n):
    rng = random.Random(seed)
    pieces = ["a", 'say "yes"', "line\nbreak", "\n\n", "comma, inside", "", None, '"', "ä漢", "x" * 90, " blank ", '""\n"', "tail\\"]
    out = []
    for k in range(n):
        text = "".join(p for p in rng.sample(pieces, rng.randrange(1, 5)) if p is not None)
        out.append((k, text or None, rng.choice(pieces) or None))
    return out


def key(r):
    return str(tuple(r))


@pytest.mark.parametrize("size", ["64b", "300b", "1000b", "1m"])
def test_equals_the_reader_of_whole_files(spark, size):
    path = shared_dir(spark, "test_csv", unique=True)
    data = spark.createDataFrame(rows(int(size[0]), 300), SCHEMA)
    T.write_pairs_csv(data.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = T.read_pairs_csv(spark, path, SCHEMA)
        found = sorted(map(key, got.collect()))
        tasks = spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = spark.read.schema(SCHEMA).options(**T.CSV_READ).csv(path)
    assert found == sorted(map(key, want.collect())) == sorted(map(key, data.collect()))
    assert tasks > 10 or size == "1m"  # one file, many tasks


def test_a_record_longer_than_many_splits(spark):
    path = shared_dir(spark, "test_csv_long", unique=True)
    data = [(1, "first", "x"), (2, "\n".join(f"line {k} \"q\"" for k in range(200)), "y"), (3, None, "z\n")]
    T.write_pairs_csv(spark.createDataFrame(data, SCHEMA).coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        assert sorted(map(tuple, T.read_pairs_csv(spark, path, SCHEMA).collect())) == data
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_crlf_blank_lines_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'pair_id,text,more\r\n1,a,"b\r\nc"\r\n\r\n2,"d ""e""",\r\n')
    (tmp_path / "b.csv").write_bytes(b'"pair_id","te\nxt",more\n\n3,f,g')
    (tmp_path / "c.csv").write_bytes(b"pair_id,text,more\n")
    got = sorted(map(tuple, T.read_pairs_csv(spark, f"file://{tmp_path}", SCHEMA).collect()))
    assert got == [(1, "a", "b\r\nc"), (2, 'd "e"', None), (3, "f", "g")]


def test_bad_values_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pair_id,text,more\nx,a,b\n")
    with pytest.raises(Exception):
        T.read_pairs_csv(spark, f"file://{tmp_path}", SCHEMA).collect()


def test_splits_from_csv(spark):
    base = shared_dir(spark, "test_csv_splits", unique=True)
    for k, name in enumerate(T.SPLITS):
        T.write_pairs_csv(spark.createDataFrame([(k, "a\nb", None)], SCHEMA), f"{base}/{name}")
    got = T.load_split_paths(spark, {n: f"{base}/{n}" for n in T.SPLITS}, "csv", SCHEMA)
    assert sorted(map(tuple, got.select("pair_id", "text", "split").collect())) == [(0, "a\nb", "train"), (1, "a\nb", "dev"), (2, "a\nb", "test")]
