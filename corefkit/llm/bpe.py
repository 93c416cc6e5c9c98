"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes. Every neighbouring pair that is in
the vocabulary waits in the bucket of its merge rank, and a two-level bitmap
over the ranks marks the buckets in use, so find-first-set gives the next rank
in two steps. Each merge touches two neighbours; entries whose pair has
changed since are stale and skipped. Work per pre-token is near linear in its
length, so a pre-token of a million bytes is no special case.

Texts are encoded in Arrow batches where they lie; nothing is shuffled. The rank
file (under 1 MB) is read on the driver and broadcast. Each Python worker builds one
encoder and keeps it for its later tasks, with the ids of the short pre-tokens it
has met last, two generations of ``CACHE_ENTRIES``.

Null texts count as empty and give no ids. Rows are independent: repeated rows,
null ids and extra columns pass through without effect.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import documents, per_worker

RANK_FILE = "byte_bpe_50k.tiktoken"
#: The cache of a Python worker holds two generations of so many pre-tokens of at most so many characters.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48
OUT_TOKENS = 1_000_000
#: Ranks per word of the bitmap: 256 words of 256 ranks make the upper level one word.
SHIFT = 8
MASK = (1 << SHIFT) - 1
BIT = [1 << k for k in range(1 << SHIFT)]
#: Unicode White_Space, as the pattern's \\s is meant (Python's own class has U+001C to U+001F too).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Generation(dict):
    """Packed ids by pre-token. What is missing comes from the generation before, or is made; short ones stay."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes] | None = None):
        super().__init__()
        self.make = make
        self.before = dict(before or ())  # a plain copy, so that it keeps no generation before itself

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word) or self.make(word)
        if len(word) <= CACHE_CHARS:
            self[word] = packed
        return packed


class Encoder:
    """Encodes and decodes with one rank file and split pattern; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        n_ranks = max(ranks.values(), default=0) + 1
        self.ranks = ranks
        self.tokens = [b""] * n_ranks
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # The rank queue: buckets of positions, and a word of the bitmap for every 2^SHIFT ranks.
        # Both are empty between pre-tokens; the upper level of the bitmap lives in ``merge``.
        self.buckets: dict[int, list[int]] = {}
        self.bitmap = [0] * ((n_ranks >> SHIFT) + 1)
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(spaced).findall
        self.cache = Generation(self.pack)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, the leftmost of equal ranks."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        buckets, bitmap, upper = self.buckets, self.bitmap, 0
        n = len(piece)
        end = list(range(1, n + 1))  # where the node that starts here ends, which is where the next starts
        before = list(range(-1, n))  # the start of the node before
        # the rank under which a node waits for its right neighbour
        waits: list[int | None] = [rank_of(piece[i:i + 2]) for i in range(n - 1)]
        waits.append(None)
        entries = enumerate(waits)
        while True:
            for i, rank in entries:
                if rank is None:
                    continue
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, i)
                    continue
                buckets[rank] = [i]
                at = rank >> SHIFT
                bitmap[at] |= BIT[rank & MASK]
                upper |= BIT[at]
            if not upper:
                break
            # find-first-set on both levels gives the smallest rank in use
            at = (upper & -upper).bit_length() - 1
            word = bitmap[at]
            bit = (word & -word).bit_length() - 1
            rank = at << SHIFT | bit
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                word = bitmap[at] = word ^ BIT[bit]
                if not word:
                    upper ^= BIT[at]
            entries = ()
            if waits[i] != rank:
                continue  # stale: the pair has changed since
            right = end[i]
            stop = end[i] = end[right]
            waits[right] = None
            if stop < n:
                before[stop] = i
                rank = rank_of(piece[i:end[stop]])
            else:
                rank = None
            waits[i] = rank
            left = before[i]
            if left < 0:
                if rank is not None:
                    entries = ((i, rank),)
                continue
            other = rank_of(piece[left:stop])
            if other != waits[left]:
                waits[left] = other
                entries = ((i, rank), (left, other))
            else:
                entries = ((i, rank),)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def pack(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache = Generation(self.pack, self.cache)
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids as bytes."""
    ranks = _rank_bytes(rank_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
             ("decoded_sha256", pa.string()), *[("ids", pa.binary())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("byte_bpe", key, lambda: Encoder(read_ranks(shared.value), pattern))
        rows, tokens = [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(value.as_py() or "")
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                       hashlib.sha256(encoder.decode(ids)).hexdigest())
                rows.append(row + (ids,) if with_ids else row)
                tokens += len(ids) // 4 + 50
                if tokens >= OUT_TOKENS:
                    yield _rows(rows, kinds)
                    rows, tokens = [], 0
        if rows:
            yield _rows(rows, kinds)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _rows(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])


def production(docs: DataFrame, with_ids: bool) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(documents(spark, sf_dir, "doc_id", "text"), with_ids=False)
