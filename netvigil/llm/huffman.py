"""Token-ID output: canonical length-limited Huffman blocks.

``write_token_files`` encodes whole texts, counts every id over all documents, gives
the ids canonical codes of bounded length (package-merge) and writes blocks in
ascending ``doc_id`` order to the shared folder. A block holds whole documents; each
document starts at a byte and has a checkpoint (its bit offset, stored as the bits
since the last one) every ``CHECKPOINT`` ids, so that a reader decodes all stretches
of a block side by side through one table. ``read_token_files`` decodes them.

Format: a Parquet folder ``blocks`` with a row for each block (bucket, block,
start in the bucket, doc_ids, counts, sizes, checkpoints, payload), and a folder ``codes`` with (id, bits) for each
id that occurs; the canonical codes follow from the bits. All integers are
little-endian, codes are written from the highest bit.

Defined results: a null or empty text holds only the end id; a null doc_id sorts
first; rows with equal doc_id stay apart, ordered by their ids; no rows give no blocks
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, parts_for, scratch_path, stored, table
from netvigil.llm.tokens import tokenizer, vocabulary_path

#: Ids between two checkpoints.
CHECKPOINT = 64
#: Ids in a block, but for a single longer document.
BLOCK_IDS = 1 << 18
#: Ids for each written bucket, on average.
BUCKET_IDS = 4_000_000
LEAST_BITS = 16


def code_bits(weights: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Code lengths that are optimal under a limit, by package-merge over sorted weights."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = limit or max(LEAST_BITS, int(n - 1).bit_length() + 1)
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[:even:2] + level[1:even:2]])
        place = np.argsort(both, kind="stable")
        level = both[place]
        marks.append(place < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(marks):
        used = int(is_leaf[:take].sum())
        bits[order[:used]] += 1
        take = 2 * (min(take, len(is_leaf)) - used)
    return bits


@dataclass
class Codes:
    """Canonical codes: shorter first, then by id."""

    ids: np.ndarray
    bits: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.bits))
        self.ids, self.bits = self.ids[order].astype(np.uint32), self.bits[order].astype(np.int64)
        self.most = int(self.bits.max(initial=1))
        size = np.int64(1) << (self.most - self.bits)
        first = np.cumsum(size) - size
        self.code = (first >> (self.most - self.bits)).astype(np.uint64)
        self.size = size

    def for_encoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        top = int(self.ids.max(initial=0)) + 1
        code, bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.ids], bits[self.ids] = self.code, self.bits
        return code, bits

    def for_decoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``most`` bits."""
        ids, bits = np.repeat(self.ids, self.size), np.repeat(self.bits, self.size)
        short = (1 << self.most) - len(ids)
        return np.concatenate([ids, np.zeros(short, np.uint32)]), np.concatenate([bits, np.ones(short, np.int64)])


def pack(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload of documents that follow each other in ids (counts > 0); bytes of each; bits between checkpoints."""
    n_bits, values = bits[ids], code[ids]
    ends = np.cumsum(counts)
    begins = ends - counts
    after = np.cumsum(n_bits)
    before = after - n_bits
    own = after[ends - 1] - before[begins]
    sizes = (own + 7) // 8
    base = (np.cumsum(sizes) - sizes) * 8
    at = before + np.repeat(base - before[begins], counts)
    stretch = -(-counts // CHECKPOINT)
    point = np.arange(int(stretch.sum())) - np.repeat(np.cumsum(stretch) - stretch, stretch)
    points = before[np.repeat(begins, stretch) + point * CHECKPOINT]
    nexts = np.concatenate([points[1:], [after[-1]]])
    word, over = at >> 6, (at & 63) + n_bits - 64
    high = np.where(over > 0, values >> np.maximum(over, 0).astype(np.uint64), values << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    cross = np.flatnonzero(over > 0)
    words[word[cross] + 1] |= values[cross] << (64 - over[cross]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(sizes.sum())], sizes, (nexts - points).astype("<u2")


def unpack(payload: bytes, counts: np.ndarray, sizes: np.ndarray, gaps: np.ndarray, by_code: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """The ids of all documents of a block, one after the other."""
    padded = np.frombuffer(payload + b"\0" * 8, np.uint8)
    windows = np.ndarray((len(padded) - 3,), ">u4", padded, strides=(1,))
    stretch = -(-counts // CHECKPOINT)
    document = np.repeat(np.arange(len(counts)), stretch)
    first = np.cumsum(stretch) - stretch
    gaps = gaps.astype(np.int64)
    before = np.cumsum(gaps) - gaps
    at = before - before[first][document] + ((np.cumsum(sizes) - sizes) * 8)[document]
    left = np.minimum(CHECKPOINT, counts[document] - (np.arange(len(document)) - first[document]) * CHECKPOINT)
    order = np.argsort(-left, kind="stable")
    at, sorted_left = at[order], left[order]
    out = np.zeros((len(order), CHECKPOINT), np.uint32)
    mask = np.int64((1 << most) - 1)
    for k in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-sorted_left, -k, side="left"))
        here = at[:live]
        code = (windows[here >> 3].astype(np.int64) >> (32 - most - (here & 7))) & mask
        out[:live, k] = by_code[code]
        here += bits[code]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(CHECKPOINT)[None, :] < left[:, None]]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            at = 0
            for ids, ends in own.encode_column(batch.column(1), end_id):
                width = 4 if ids.max() > 0xFFFF else 2
                offsets = np.concatenate([[0], ends * width]).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), pa.array(np.diff(ends, prepend=0)), data.cast(pa.binary())], ["doc_id", "n", "ids"])
                at += len(ends)

    return run


def ids_of(n: int, data: bytes) -> np.ndarray:
    """Ids as the token table keeps them: 2 bytes each where all of a row fit."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def all_ids(n: pa.Array, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a batch of the token table, one after the other, and how many each row has."""
    counts = n.to_numpy()
    flat = data.cast(pa.large_binary())
    if pc.all(pc.equal(pc.binary_length(data), pc.multiply(n, 2))).as_py():
        at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        return np.frombuffer(flat.buffers()[2], "<u2", int(counts.sum()), int(at[0])), counts
    return np.concatenate([ids_of(k, memoryview(x.as_buffer())) for k, x in zip(counts.tolist(), data, strict=True)]), counts


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids) of each whole text with the end id, written once to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stored(texts.mapInArrow(_tokenise(path, end_id), "doc_id long, n long, ids binary"), "tokens")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row for each id that it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.bincount(all_ids(batch.column(0), batch.column(1))[0])
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass
class TokenFiles:
    """Where a written corpus lies, and the ids before each bucket (one number for each)."""

    path: str
    before: dict[int, int]


def write_token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> TokenFiles:
    """Writes all texts as Huffman blocks in ascending doc_id order."""
    spark = docs.sparkSession
    tokens = token_table(docs, vocabulary_path(vocabulary), end_id)
    counts = id_counts(tokens).toPandas().sort_values("id")  # at most a row for each id of the vocabulary
    codes = Codes(counts["id"].to_numpy(), code_bits(counts["n"].to_numpy()))
    code, bits = codes.for_encoding()
    total = int(counts["n"].sum())
    n_buckets = parts_for(total, BUCKET_IDS)
    cuts = tokens.approxQuantile("doc_id", [k / n_buckets for k in range(1, n_buckets)], 0.2 / n_buckets) if n_buckets > 1 else []
    bounds = np.array(sorted(set(cuts)), np.float64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, n = all_ids(part.column(1), part.column(2))
                payload, sizes, gaps = pack(ids, n, code, bits)
                ends, points = np.cumsum(sizes), np.cumsum(-(-n // CHECKPOINT))
                bucket = np.searchsorted(bounds, part.column(0).fill_null(-(1 << 62)).to_numpy().astype(np.float64), side="right")
                own = [payload[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                own_gaps = [x.tobytes() for x in np.split(gaps, points[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), part.column(0), part.column(1), pa.array(own_gaps, pa.binary()), pa.array(own, pa.binary())], ["bucket", "doc_id", "n", "gaps", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, start, held, rows = None, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            ids, n, gaps, payload = zip(*rows, strict=True)
            fields = [[bucket], [number], [start], [list(ids)], [list(n)], [[len(x) for x in payload]], [b"".join(gaps)], [b"".join(payload)]]
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "start", "doc_ids", "counts", "sizes", "checkpoints", "payload"])

        for batch in batches:
            for b, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (b != bucket or held >= BLOCK_IDS):
                    yield flush()
                    rows, start, held, number = [], start + held, 0, number + 1
                if b != bucket:
                    bucket, number, start = b, 0, 0
                rows.append(row)
                held += row[1]
        if rows:
            yield flush()

    encoded = tokens.mapInArrow(encode, "bucket long, doc_id long, n long, gaps binary, payload binary")
    dealt = encoded.repartition(max(1, n_buckets // 2), "bucket") if n_buckets > 1 else encoded.coalesce(1)
    path = scratch_path(spark, "token-files")
    (dealt.sortWithinPartitions("bucket", "doc_id", "n", "payload").mapInArrow(blocks, "bucket long, block long, start long, doc_ids array<long>, counts array<long>, sizes array<long>, checkpoints binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks"))
    spark.createDataFrame(list(zip(codes.ids.tolist(), codes.bits.tolist(), strict=True)), "id long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    held = spark.read.parquet(f"{path}/blocks").groupBy("bucket").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).orderBy("bucket").collect()
    before, so_far = {}, 0
    for row in held:  # a row for each bucket of millions of ids
        before[row["bucket"]], so_far = so_far, so_far + row["n"]
    return TokenFiles(path, before)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, ids array<long>) of each document, decoded from the files."""
    return _decoded(spark, files, "doc_id long, start long, ids array<long>", lambda ids: ids.astype(np.int64), pa.list_(pa.int64()))


def read_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    return _decoded(spark, files, "doc_id long, start long, n_tokens long, ids_crc32 long", crc_of, pa.int64())


def _decoded(spark: SparkSession, files: TokenFiles, schema: str, of: Callable, kind: pa.DataType) -> DataFrame:
    stored_codes = spark.read.parquet(f"{files.path}/codes").toPandas()
    codes = Codes(stored_codes["id"].to_numpy(), stored_codes["bits"].to_numpy())
    before = files.before

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code, bits = codes.for_decoding()
        for batch in batches:
            for bucket, start, doc_ids, n, sizes, gaps, payload in zip(*[batch.column(c).to_pylist() for c in ("bucket", "start", "doc_ids", "counts", "sizes", "checkpoints", "payload")], strict=True):
                n = np.array(n, np.int64)
                ids = unpack(payload, n, np.array(sizes, np.int64), np.frombuffer(gaps, "<u2"), by_code, bits, codes.most)
                ends = np.cumsum(n)
                values = [of(ids[e - k : e]) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(before[bucket] + start + ends - n, pa.int64())]
                cols += [] if "ids array" in schema else [pa.array(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(values, kind)], [x.split()[0] for x in schema.split(", ")])

    return spark.read.parquet(f"{files.path}/blocks").mapInArrow(decode, schema)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as Huffman blocks, reads them back and returns each document's place and digest."""
    return read_digests(spark, write_token_files(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
