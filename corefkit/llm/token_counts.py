"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both sides agree.

A text of up to ``chunk`` + ``overlap`` code points is encoded where it lies. A longer
one is cut into chunks that reach ``overlap`` code points into the next, the
chunks are dealt over the cluster, and each is encoded by itself. Around every seam
both chunks then have tokens over the same stretch of text, and the two
encodings are spliced at a token that both have: same id, same offset.

Why that is exact. Byte-pair merging always joins the neighbouring pair of the best
rank, the leftmost of equal ones. Two facts follow.

* Any two neighbouring tokens of an encoding, taken alone, encode to themselves:
  the merges inside their stretch were the best of the whole text at their time, so
  they are the best there, in the same order.
* A sequence of tokens of which every two neighbours encode to themselves is the
  encoding of its text: the first merge across one of its boundaries would be the
  best pair of the two tokens at that boundary as well, which do not merge.

In the spliced sequence all neighbours come from one chunk's encoding or the
other's, since the shared token belongs to both; so it is the encoding of the whole.
The blank that the library puts before a text lies before every offset that counts.

Where a seam shows no shared token (one long run of a letter, say), its text
is encoded anew with ``WIDEN`` times the overlap and chunks of at least twice that,
until all its seams align; at the length of the text one chunk is left. Each
round is a Spark job over the texts still open, so there are as many as the longest
such stretch needs, about log8 of its length.

The model file (under 1 MB) is broadcast and read once per Python worker.

Null texts count as empty: no bytes, no tokens. Rows are independent: null or
repeated ids and equal rows each give a row; extra columns are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import documents, per_worker, staged

MODEL_FILE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
CHUNK = 16_384
OVERLAP = 256
WIDEN = 8
BLANK = "▁"  # how the library writes a space


class Tokenizer:
    """The library's encoder with the bytes of every id's piece, for offsets."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_bytes = np.array([1 if self.model.is_byte(k) else len(self.model.id_to_piece(k).encode())
                                 for k in range(self.model.vocab_size())], dtype=np.int64)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def chunk(self, text: str, left: int, right: int) -> tuple[int, bytes | None, bytes | None]:
        """Tokens of a chunk, and those that start in its first ``left`` and last ``right`` code points.

        Offsets are bytes from the start of the stretch, spaces written as the library does;
        packed with the id in one integer per token.
        """
        ids = np.array(self.model.encode(text), dtype=np.int64)
        sizes = self.n_bytes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes - len(BLANK.encode())  # the blank that the library puts first is at negative offsets
        head = tail = None
        if left:
            head = _packed(starts, ids)[: np.searchsorted(starts, _width(text[:left]))].tobytes()
        if right:
            at = starts - (_width(text) - _width(text[-right:]))
            tail = _packed(at, ids)[np.searchsorted(at, 0):].tobytes()
        return len(ids), head, tail


def _width(text: str) -> int:
    return len(text.encode()) + (len(BLANK.encode()) - 1) * text.count(" ")


def _packed(starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return starts << 32 | ids


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunks of ``chunk`` code points, each with the first ``overlap`` of the next; the last takes the rest."""
    n = max(1, len(text) // chunk)
    return [text[k * chunk:(k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk:] for k in range(n)]


def surplus(tail: bytes, head: bytes) -> int | None:
    """Tokens counted twice at a seam: those after the first shared token on the left, up to it on the right."""
    before, after = np.frombuffer(tail, np.int64), np.frombuffer(head, np.int64)
    _, i, j = np.intersect1d(before, after, assume_unique=True, return_indices=True)
    if not len(i):
        return None
    k = int(np.argmin(i))
    return int(len(before) - 1 - i[k]) + int(j[k]) + 1


def count_tokens(docs: DataFrame, model_path: str, token_limit: int = TOKEN_LIMIT,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, one row per row of ``docs``."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    shared, key = spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()

    def tokenizer() -> Tokenizer:
        return per_worker("token_counts", key, lambda: Tokenizer(shared.value))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [tokenizer().count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tokenizer().chunk(t.as_py(), l, r) for t, l, r in
                    zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            n, head, tail = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(head, pa.binary()),
                 pa.array(tail, pa.binary())], ["row", "k", "n_tokens", "head", "tail"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    fits = F.char_length("text") <= chunk + overlap
    short = texts.where(fits).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
    # the rows are numbered once, when they are written, so equal rows stay apart
    huge = staged(texts.where(~fits).withColumn("row", F.monotonically_increasing_id()), "huge_texts")
    open_rows, parts = huge, [short]
    while not open_rows.isEmpty():
        chunks = open_rows.select("row", "text").mapInArrow(
            _cutter(chunk, overlap), "row long, k long, text string, head int, tail int")
        encoded = staged(chunks.repartition("row", "k").mapInArrow(
            encode, "row long, k long, n_tokens long, head binary, tail binary"), "encoded_chunks")
        spliced = staged(_splice(encoded), "spliced_texts")
        parts.append(huge.join(spliced.where("aligned"), "row").select("doc_id", "n_bytes", "n_tokens"))
        open_rows = huge.join(spliced.where("not aligned"), "row", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 2 * overlap)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("over_limit", F.col("n_tokens") > token_limit)


def _cutter(chunk: int, overlap: int):
    """The chunks of each text, one at a time; head and tail are the code points shared with the neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces = cut(value.as_py(), chunk, overlap)
                last = len(pieces) - 1
                for k, piece in enumerate(pieces):
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int64()), "text": [piece],
                        "head": pa.array([overlap if k else 0], pa.int32()),
                        "tail": pa.array([overlap if k < last else 0], pa.int32())})

    return run


def _splice(encoded: DataFrame) -> DataFrame:
    """row, n_tokens, aligned of each text, from its chunks' counts less what its seams count twice."""

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twice = [surplus(t.as_py(), h.as_py()) for t, h in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(twice, pa.int64())], ["row", "twice"])

    ends = encoded.select("row", F.col("k").alias("seam"), "tail", F.lit(None).cast("binary").alias("head")).where(
        "tail is not null").unionByName(encoded.select(
            "row", (F.col("k") - 1).alias("seam"), F.lit(None).cast("binary").alias("tail"), "head").where("head is not null"))
    met = ends.groupBy("row", "seam").agg(F.max("tail").alias("tail"), F.max("head").alias("head"))
    twice = met.select("row", "tail", "head").mapInArrow(seams, "row long, twice long")
    both = encoded.select("row", "n_tokens", F.lit(True).alias("aligned")).unionByName(
        twice.select("row", (-F.col("twice")).alias("n_tokens"), F.col("twice").isNotNull().alias("aligned")))
    return both.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"), F.bool_and("aligned").alias("aligned"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(MODEL_FILE))
