"""Periodic runs: stretches of words that repeat with a period, at least four times.

A run is a maximal stretch whose words ``q`` apart are identical, ``q`` its smallest
period, of at least max(``MIN_WORDS``, ``MIN_EXPONENT`` * q) words.

1. Scale tiles. Periods are taken by octaves, B <= q < 2B for B = 1, 2, 4, ... For
   each octave, tiles around the boundaries c = 0, B, 2B, ... hold the words from c - B
   to c + 3B. A text of more than ``split`` words is written out and its tiles are
   dealt over the cluster, in slices of neighbouring boundaries: one set of
   slices for all small octaves, and one per large octave. A shorter text keeps its
   tiles where it lies.
2. Boundary Z-functions. In a tile, the Z-function of the words after c gives for
   every period q how far the text agrees with itself q words on, the one of the
   reversed words before c how far back. Only tiles are solved whose B words after c have a
   hash that comes again q words on, and the tile after them; equal words have equal
   hashes, so none is lost, and words decide. In a tile with at most ``FEW`` such periods
   the Z-values of these are read off by comparing the words themselves, for all such
   tiles at once; with more the whole functions are made, in linear time.
3. Fragments. Each tile reports [c - back, c + ahead) per period where the text agrees
   up to a neighbouring boundary. A run agrees over 3q >= 3B words, so its tiles' fragments
   touch from end to end. Touching ones of a slice are joined before they are shuffled.
4. Stitching. Fragments are shuffled by text and period and joined where they touch.
   Of stretches with equal ends the smallest period stays (the others are its
   multiples, by Fine and Wilf).
5. The runs of a text meet its words again, only for texts that had fragments.

Work is near n log n per text of n words; memory is one text per task, or some
slices of it. Words are compared as their numbers in the text or slice at hand, which are exact.

Null and empty texts have no words and no runs. Rows are independent: null or
repeated ids and equal rows each give a row; extra columns are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.llm.common import documents, staged

MIN_WORDS = 6
MIN_EXPONENT = 4
#: Texts of more words have their tiles dealt out; a power of two, and the boundaries of a slice span as many words.
SPLIT = 1 << 13
#: Periods of one boundary that are compared one by one.
FEW = 4
OUT_BYTES = 8 << 20
FRAGMENTS = "array<struct<period:bigint,start:bigint,stop:bigint>>"
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


# ---------------------------------------------------------------- one tile


def z_function(s: list[int], upto: int) -> list[int]:
    """How far ``s`` agrees with itself from each of its first ``upto`` positions on (0 at position 0)."""
    z, left, right, n = [0] * upto, 0, 0, len(s)
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        if k:
            z[i], left, right = k, i, i + k
    return z


def solve_tile(tile: list[int], at: int, octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of the octave, and how far the tile agrees back from and ahead of its boundary ``at``.

    Both are cut at the octave's width: there the next tile takes over.
    """
    ahead_words = tile[at:]
    stop = min(2 * octave, len(ahead_words))
    periods = np.arange(octave, stop)
    ahead = np.minimum(z_function(ahead_words, stop)[octave:], octave)
    if not at:
        return periods, np.zeros(len(periods), np.int64), ahead
    # the suffixes of tile[:at] and tile[:at + q] agree as far as the reversed words do
    mirrored = tile[at - 1::-1] + [-1] + tile[at + stop - 1::-1]
    z = z_function(mirrored, at + 1 + stop - octave + 1)
    back = np.minimum(np.array(z)[at + 1 + stop - periods], octave)
    return periods, back, ahead


# ---------------------------------------------------------------- tiles of a stretch of words


def number_words(words: list[bytes]) -> list[int]:
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return list(map(names.__getitem__, words))


def stretch_fragments(words: list[bytes], offset: int, octaves: list[int], first: int, last: int) -> np.ndarray:
    """Joined fragments (period, start, stop) of the tiles at the boundaries from ``first`` to before ``last``.

    ``words`` are the text's from number ``offset`` on, at least those of all the tiles.
    """
    numbers = number_words(words)
    ids = np.array(numbers, dtype=np.int64)
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(31)
    width, found = 1, []
    for octave in octaves:
        while width < octave and len(hashes) > width:  # hashes of 2 * width words
            hashes = hashes[:-width] * np.uint64(0xD6E8FEB86659FD93) + hashes[width:]
            hashes ^= hashes >> np.uint64(29)
            width *= 2
        if width < octave:
            break
        found.extend(_octave_fragments(numbers, ids, hashes, octave, first - offset, last - offset))
    if not found:
        return np.zeros((3, 0), np.int64)
    out = joined(np.concatenate(found, axis=1))
    out[1:] += offset
    return out


def _octave_fragments(numbers: list[int], ids: np.ndarray, hashes: np.ndarray, octave: int,
                      first: int, last: int) -> Iterator[np.ndarray]:
    """Fragments of the boundaries at which the words come again a period on, up to the next boundary at least."""
    n = min((len(hashes) - octave - first - 1) // octave + 1, -(-(last - first) // octave))  # those with hashes a period on
    if n <= 0:
        return
    later = hashes[first + octave:first + (n + 1) * octave]
    if short := n * octave - len(later):
        later = np.concatenate([later, ~np.repeat(hashes[first + (n - 1) * octave], short)])
    hit = later.reshape(n, octave) == hashes[first:first + n * octave:octave, None]
    places, over = np.nonzero(hit)
    if not len(places):
        return
    many = np.bincount(places, minlength=n) > FEW
    if many.any():
        # the tile and the one after it, in which its periods may end
        for place in np.flatnonzero(many | np.append(False, many[:-1])).tolist() + [n] * bool(many[-1]):
            c = first + place * octave
            if c + octave >= len(ids):
                continue
            low = max(0, c - octave)
            periods, back, ahead = solve_tile(numbers[low:c + 3 * octave], c - low, octave)
            reach = (back == octave) | (ahead == octave)
            if reach.any():
                yield np.array([periods[reach], c - back[reach], c + ahead[reach]])
    few = ~many[places]
    if few.any():
        yield _few_periods(ids, hit, places[few], over[few], octave, first)


def _few_periods(ids: np.ndarray, hit: np.ndarray, places: np.ndarray, over: np.ndarray, octave: int, first: int) -> np.ndarray:
    """The same for boundaries with few periods: their Z-values are read off by comparing words, all at once."""
    steps = np.arange(octave)
    c, q = first + places * octave, octave + over
    at = c[:, None] + steps
    good = (ids[at] == ids[at + q[:, None]]).all(axis=1)  # words decide, not hashes
    hit[places[~good], over[~good]] = False
    places, over, c, q = places[good], over[good], c[good], q[good]
    start, stop = c.copy(), c + octave
    # a period that the boundary before (or after) has too goes on there
    head = np.flatnonzero((places == 0) | ~hit[places - 1, over])
    at = c[head, None] - 1 - steps
    start[head] -= _agreed((at >= 0) & (ids[np.maximum(at, 0)] == ids[np.maximum(at, 0) + q[head, None]]))
    tail = np.flatnonzero((places == len(hit) - 1) | ~hit[np.minimum(places + 1, len(hit) - 1), over])
    at = stop[tail, None] + steps
    there = at + q[tail, None]
    limit = len(ids) - 1
    stop[tail] += _agreed((there <= limit) & (ids[np.minimum(at, limit)] == ids[np.minimum(there, limit)]))
    return np.array([q, start, stop])


def _agreed(same: np.ndarray) -> np.ndarray:
    """Length of the leading run of True in each row."""
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1))


def joined(fragments: np.ndarray) -> np.ndarray:
    """Fragments (period, start, stop) with those of one period that touch made one."""
    period, start, stop = fragments[:, np.lexsort((fragments[1], fragments[0]))]
    # no stop exceeds the later ones' of its period by more than a tile, but the running maximum must not pass periods
    shift = period * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(period), dtype=bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    if not len(heads):
        return fragments
    ends = np.append(heads[1:], len(period)) - 1
    return np.stack([period[heads], start[heads], reach[ends] - shift[ends]])


def octaves_of(n_words: int) -> list[int]:
    """Octaves that can hold a run in a text of so many words."""
    out, octave = [], 1
    while octave * MIN_EXPONENT <= n_words:
        out.append(octave)
        octave *= 2
    return out


def slices(n_words: int, split: int) -> Iterator[tuple[int, int, list[int], int, int]]:
    """(from word, to word, octaves, first boundary, last boundary) of the slices that hold all tiles of a text."""
    octaves = octaves_of(n_words)
    small = [b for b in octaves if b * 16 <= split]
    groups = [(small, max(small), split)] if small else []
    groups += [([b], b, 4 * b) for b in octaves[len(small):]]
    for members, widest, span in groups:
        for first in range(0, n_words, span):
            yield max(0, first - widest), min(n_words, first + span + 3 * widest), members, first, min(n_words, first + span)


# ---------------------------------------------------------------- on Spark


def _solve(split: int, with_text: bool, edit: Callable[[int | None, list[bytes]], list[bytes]] | None):
    """Per text: its result if it has no run, else (or with its text) its words and, unless they are dealt out, its fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (value.as_py() or b"").split()
                if edit is not None:
                    words = edit(doc_id, words)
                far, found = len(words) > split, ()
                if not far:
                    period, start, stop = stretch_fragments(words, 0, octaves_of(len(words)), 0, len(words))
                    # all tiles were here, so the fragments are whole
                    good = stop - start + period >= np.maximum(MIN_WORDS, MIN_EXPONENT * period)
                    found = [{"period": p, "start": s, "stop": e} for p, s, e in
                             zip(period[good].tolist(), start[good].tolist(), stop[good].tolist())]
                text = b" ".join(words)
                open_ = far or bool(found) or with_text
                rows.append((doc_id, text if open_ else None, None if open_ else hashlib.sha256(text).hexdigest(), far, found))
                size += (len(text) + 24 * len(found)) if open_ else 100
                if size > OUT_BYTES:
                    yield _solved(rows)
                    rows, size = [], 0
            if rows:
                yield _solved(rows)

    return run


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.list_(FRAGMENT)]
    names = ["doc_id", "words", "collapsed_sha256", "far", "fragments"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _slicer(split: int):
    """The slices of each long text, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = value.as_py().split(b" ")
                for low, high, octaves, first, last in slices(len(words), split):
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int64()), "low": pa.array([low], pa.int64()),
                        "octaves": pa.array([octaves], pa.list_(pa.int64())), "first": pa.array([first], pa.int64()),
                        "last": pa.array([last], pa.int64()), "words": pa.array([b" ".join(words[low:high])], pa.binary())})

    return run


def _solve_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, low, octaves, first, last, words in zip(*(c.to_pylist() for c in batch.columns)):
            period, start, stop = stretch_fragments(words.split(b" "), low, octaves, first, last)
            if len(period):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(period), row)), pa.array(period), pa.array(start), pa.array(stop)],
                    ["row", "period", "start", "stop"])


def _stitch(fragments: DataFrame) -> DataFrame:
    """Runs (row, start, length, period) from fragments (row, period, start, stop)."""
    in_order = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = marked.withColumn("part", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return (whole.withColumn("length", length)
            .where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_EXPONENT * F.col("period")))
            .groupBy("row", "start", "length").agg(F.min("period").alias("period")))


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = value.as_py().split(b" ") if value.as_py() else []
                runs = [(r["start"], r["length"], r["period"]) for r in runs.as_py() or ()]
                text = b" ".join(collapse(words, runs))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                row = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                       hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                if with_text:
                    row += ([{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode())
                    size += len(text) + 24 * len(runs)
                rows.append(row)
                if size > OUT_BYTES:
                    yield _finished(rows)
                    rows, size = [], 0
            if rows:
                yield _finished(rows)

    return run


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(run), pa.string()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs",
             "collapsed_text"]
    width = len(rows[0])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:width])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def find_runs(docs: DataFrame, split: int = SPLIT, with_text: bool = True,
              edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    doc_id, n_runs, start, length, period, exponent_milli (1000 * length / period, rounded
    down) of the longest run (then the first, then the least period; nulls without a run), digests
    of all runs and of the collapsed text and, if asked, runs and collapsed_text themselves.
    ``edit`` may change a text's words (doc_id, words) before runs are sought.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id long, words binary, collapsed_sha256 string, far boolean, fragments {FRAGMENTS}"
    # numbered once, when written, so equal rows stay apart
    solved = staged(rows.mapInArrow(_solve(split, with_text, edit), schema).withColumn("row", F.monotonically_increasing_id()), "runs_solved")
    near = solved.where("not far").select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    far = (solved.where("far").select("row", "words")
           .mapInArrow(_slicer(split), "row long, low long, octaves array<long>, first long, last long, words binary")
           .repartition("row", "first", "octaves")
           .mapInArrow(_solve_slices, "row long, period long, start long, stop long"))
    runs = _stitch(near.unionByName(far)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string" * with_text
    met = solved.where("words is not null").join(runs, "row", "left").select("doc_id", "words", "runs")
    out = met.mapInArrow(_finish(with_text), schema)
    if with_text:
        return out
    none = F.lit(None).cast("long")
    closed = solved.where("words is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
    return closed.unionByName(out)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: one id in ten (by crc32) repeats a stretch of its words up to its end; a null id never."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(documents(spark, sf_dir, "doc_id", "text"), with_text=False, edit=planted)
