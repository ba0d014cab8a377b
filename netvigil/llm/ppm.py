"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts: how often each byte followed each context of up to
``order`` bytes in the training texts. A byte that a context has not seen is escaped to
the next shorter one, where symbols that the longer one has seen are left out (symbol
exclusion); escapes are estimated by the number of different symbols, half a count for
each (PPMD). What a longer context has seen was seen in its shorter ones too, so the
exclusion at each step depends on two nodes of the trie only, and one pass from short to
long contexts gives the probability of every string of order + 1 bytes.

Nothing is broadcast that grows with the corpus. Texts are dealt into chunks of bounded
size, each with its own different strings; the trie is dealt to tasks by the last three
bytes of a context, which go first in a key, so a node's children are neighbours in key
order; then each chunk gets the probabilities of its own strings, and its texts are scored
where they meet. Words for the base score go the same way.

Texts are lower-cased (A-Z) first. A text is its bytes and one end symbol, in the context
of end symbols at its start. Null and empty texts are one end symbol. Rows are scored one
by one, so repeated ids stay; a null doc_id trains. Without training rows every byte has
the probability 1/256 and the base is 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netvigil.llm.common import only, stored, table
from netvigil.llm.rawtext import LOWER, SPACE, hashes, runs, slices, text_array, text_bytes

#: Bytes of context; a key has one byte more and must fit into eight.
ORDER = 5
#: Bytes of context that deal the trie to tasks: a task's unit has at most 256 ** (order + 1 - LOCAL) strings.
LOCAL = 3
#: Symbols, and the one that ends a text and stands before it; no UTF-8 text has it.
SYMBOLS, END = 256, 0xFF
#: UTF-8 bytes of a chunk's texts.
CHUNK_BYTES = 32_000_000
#: Bytes that are worked on in one go, and rows in one batch to Spark.
SLICE_BYTES, ROWS = 2_000_000, 100_000
STRINGS, WORDS, TEXTS = 1, 2, 3
_WORK = "chunk long, kind int, texts binary, key long, word string, salt int, n long"
_MEET = "chunk long, kind int, texts binary, keys binary, values binary, salt int"
_DONE = "doc_id long, n_tokens long, n_known long, log_sum double, score double"


def context_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the end of each text: its context, last byte first, then itself, as one number; and where each text begins."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    first = order + offsets[:-1] + order * np.arange(n)
    padded = np.full(order + len(data) + order * n, END, np.uint8)
    for k in np.flatnonzero(size):
        padded[first[k] : first[k] + size[k]] = data[offsets[k] : offsets[k + 1]]
    keys = np.zeros(len(padded) - order, np.int64)
    for back in range(1, order + 1):
        keys <<= 8
        keys |= padded[order - back : len(padded) - back]
    keys <<= 8
    keys |= padded[order:]
    real = np.ones(len(keys), bool)
    if n:
        real[((first - order + size)[:, None] + np.arange(1, order)).ravel()] = False
    return keys[real], np.concatenate([[0], np.cumsum(size + 1)])


def _rows(schema: str, **given: pa.Array) -> Iterator[pa.RecordBatch]:
    """Batches of a schema with these columns, and null in the others."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    n = len(next(iter(given.values())))
    names = [x.split() for x in schema.split(", ")]
    for at in range(0, n, ROWS):
        m = min(ROWS, n - at)
        yield pa.RecordBatch.from_arrays([given[name].slice(at, m).cast(types[t]) if name in given else pa.nulls(m, types[t]) for name, t in names], [name for name, _ in names])


def _same(value: int, n: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int64))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their summed counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


def _sealed(doc_ids: pa.Array, texts: pa.Array) -> bytes:
    """Texts and their ids as one compressed value."""
    batch = pa.RecordBatch.from_arrays([doc_ids, texts], ["doc_id", "text"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def chunked(docs: DataFrame, train: Column, order: int) -> DataFrame:
    """Texts with their chunk, and for each chunk its strings and words with their counts in training texts.

    Written once, so that a chunk stays what it is; counts of texts that are not for
    training are zero. The word '' stands for the end of a text. A word's key is a hash
    by which its chunk tells it from all its others: the salt is the first that does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, keys, words = TaskContext.get().partitionId() << 32, 0, [], []

        def merge() -> None:
            keys[:] = [_merged(keys)]
            coded = pa.concat_arrays([w for w, _ in words]).dictionary_encode()
            total = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([n for _, n in words]), minlength=len(coded.dictionary))
            words[:] = [(coded.dictionary, total.astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            (strings, n), (known, seen) = keys[0], words[0]
            yield from _rows(_WORK, chunk=_same(chunk, len(n)), kind=_same(STRINGS, len(n)), key=pa.array(strings), n=pa.array(n))
            salt = 0
            while len(np.unique(own := hashes(known, salt))) < len(known):
                salt += 1
            yield from _rows(_WORK, chunk=_same(chunk, len(known)), kind=_same(WORDS, len(known)), key=pa.array(own), word=known, salt=_same(salt, len(known)), n=pa.array(seen))

        for part, data, offsets in slices(batches, limit=SLICE_BYTES):
            trains = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            small = LOWER[data]
            string, begin = context_keys(small, offsets, order)
            taught = np.repeat(trains, np.diff(begin))
            keys.append(np.unique(string[taught], return_counts=True))
            rest = np.unique(string[~taught])
            keys.append((rest, np.zeros(len(rest), np.int64)))
            word, doc = runs(small, offsets, ~SPACE)
            coded = word.dictionary_encode()
            words.append((coded.dictionary, np.bincount(coded.indices.to_numpy(), weights=trains[doc], minlength=len(coded.dictionary))))
            words.append((pa.array([""], pa.large_string()), np.array([trains.sum()])))
            sealed = _sealed(part.column("doc_id"), text_array(small, offsets))
            yield from _rows(_WORK, chunk=_same(chunk, 1), kind=_same(TEXTS, 1), texts=pa.array([sealed], pa.binary()))
            size += len(data)
            if sum(len(k) for k, _ in keys[1:]) >= 10 * ROWS:
                merge()
            if size >= CHUNK_BYTES:
                yield from flush()
                chunk, size, keys, words = chunk + 1, 0, [], []
        if keys:
            yield from flush()

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.withColumn("train", F.coalesce(train, F.lit(True))).mapInArrow(run, _WORK), "ppm-work")


def _edge(key: Column, order: int, k: int) -> Column:
    """The last k bytes of a context and the symbol."""
    return F.shiftleft(F.shiftright(key, 8 * (order + 1 - k)), 8).bitwiseOR(key.bitwiseAND(F.lit(255)))


def predicted(keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, ...], order: int, local: int) -> tuple[np.ndarray, ...]:
    """(t, q, tail, score) of sorted keys, all those of some contexts of ``local`` bytes.

    low: n, t, q and tail of the context one byte shorter than local. t and q are counts
    and different symbols of the whole context; tail is the log10 probability of a symbol
    once it is escaped from there, score that from the start.
    """
    n_low, t_low, q_low, tail_low = low
    symbol = keys & 255
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(local, order + 1):
            edges, first, at = np.unique((keys >> 8 * (order + 1 - k) << 8) | symbol, return_index=True, return_inverse=True)
            own = np.bincount(at, weights=n, minlength=len(edges))
            begins = np.flatnonzero(np.diff(edges >> 8, prepend=-1))
            node = np.cumsum(np.diff(edges >> 8, prepend=-1) != 0) - 1
            t, q = np.add.reduceat(own, begins)[node], np.add.reduceat((own > 0).astype(np.int64), begins)[node]
            passed, tail = n_low[first], tail_low[first]
            left = t_low[first] - np.add.reduceat(np.where(own > 0, passed, 0), begins)[node]
            more = q_low[first] - q
            escaped = np.where(passed > 0, np.log10((passed - 0.5) / left), np.log10(0.5 * more / left) + tail)
            tail = np.where(left > 0, escaped, tail)
            n_low, t_low, q_low, tail_low = own[at], t[at], q[at], tail[at]
        score = np.where(n_low > 0, np.log10((n_low - 0.5) / t_low), np.where(q_low > 0, np.log10(0.5 * q_low / t_low), 0.0) + tail_low)
    return t_low, q_low, tail_low, score


def _level(strings: DataFrame, low: DataFrame, order: int, local: int) -> DataFrame:
    """(key, n, t, q, tail, score) of strings (key, n); low has these of their edges one byte shorter than local."""
    unit = 8 * (order + 1 - local)
    names = ["key", "n", "n_low", "t_low", "q_low", "tail_low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column(x).to_numpy() for x in names]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            whole = int(np.searchsorted(held[0] >> unit, held[0][-1] >> unit)) if len(held[0]) else 0
            if whole >= ROWS:
                yield from done([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held and len(held[0]):
            yield from done(held)

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, q, tail, score = predicted(rows[0], rows[1], tuple(rows[2:]), order, local)
        yield from _rows(schema, key=pa.array(rows[0]), n=pa.array(rows[1]), t=pa.array(t).cast(pa.int64()), q=pa.array(q), tail=pa.array(tail), score=pa.array(score))

    schema = "key long, n long, t long, q long, tail double, score double"
    edges = low.select(F.col("key").alias("edge"), *[F.col(x).alias(f"{x}_low") for x in ("n", "t", "q", "tail")])
    rows = strings.withColumn("edge", _edge(F.col("key"), order, local - 1)).join(edges, "edge").select(*names)
    return rows.repartition(F.shiftright("key", unit)).sortWithinPartitions("key").mapInArrow(run, schema)


def probabilities(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, score): log10 probability of the last byte of each string (key, n) after the others."""
    by_edge = lambda k: strings.groupBy(_edge(F.col("key"), order, k).alias("key")).agg(F.sum("n").alias("n"))
    bytes_ = by_edge(0)  # 256 rows at most
    total = bytes_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count_if(F.col("n") > 0).alias("q"))
    low = bytes_.crossJoin(F.broadcast(total)).withColumn("tail", -F.log10((F.lit(SYMBOLS) - F.col("q")).cast("double")))
    return _level(strings, _level(by_edge(LOCAL - 1), F.broadcast(low), LOCAL - 1, 1), order, LOCAL).select("key", "score")


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes of their steps, high bytes first, which shuffle files compress well."""
    return np.ascontiguousarray(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(np.int64).ravel())


def _packed(rows: DataFrame, kind: int) -> DataFrame:
    """Rows (chunk, key, value, salt) with many of a chunk in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 5 * ROWS:
                yield from pack(held)
                held, n = [], 0
        if n:
            yield from pack(held)

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, key, value, salt = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("chunk", "key", "value", "salt"))
        order = np.lexsort((key, chunk))
        chunk, key, value, salt = chunk[order], key[order], value[order], salt[order]
        ends = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        blobs = [(_planes(key[a:b]), value[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
        yield from _rows(_MEET, chunk=pa.array(chunk[ends[:-1]]), kind=_same(kind, len(blobs)), keys=pa.array([k for k, _ in blobs], pa.binary()), values=pa.array([v for _, v in blobs], pa.binary()), salt=pa.array(salt[ends[:-1]]))

    return rows.select("chunk", "key", "value", "salt").mapInArrow(run, _MEET)


class Table:
    """Values by 64-bit key for keys that are all there: open addressing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.none = next(k for k in range(-1, -len(keys) - 2, -1) if not (keys == k).any())
        self.keys, self.values = np.full(1 << bits, self.none, np.int64), np.zeros(1 << bits, values.dtype)
        owner = np.full(1 << bits, -1, np.int64)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = owner[at[left]] < 0
            tried = left[free]
            owner[at[tried]] = tried  # of those that meet in a slot, one stays
            left = np.concatenate([left[~free], tried[owner[at[tried]] != tried]])
            at[left] = (at[left] + 1) & self.mask
        held = owner >= 0
        self.keys[held], self.values[held] = keys[owner[held]], values[owner[held]]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(np.ascontiguousarray(keys))
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


class _Chunk:
    """What a task holds of one chunk: its strings and words."""

    def __init__(self, order: int):
        self.order, self.salt, self.ready = order, 0, False
        self.keys: dict[int, list[np.ndarray]] = {STRINGS: [], WORDS: []}
        self.values: dict[int, list[np.ndarray]] = {STRINGS: [], WORDS: []}

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        self.keys[kind] += [_from_planes(b) for b in rows.column("keys").to_pylist()]
        self.values[kind] += [np.frombuffer(b, np.float64 if kind == STRINGS else np.int64) for b in rows.column("values").to_pylist()]
        if kind == WORDS:
            self.salt = rows.column("salt")[0].as_py()

    def score(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.strings, self.words = (Table(np.concatenate(self.keys.pop(kind)), np.concatenate(self.values.pop(kind))) for kind in (STRINGS, WORDS))
            self.end = int(self.words.of(hashes(pa.array([""], pa.large_string()), self.salt))[0])
            self.ready = True
        for sealed in rows.column("texts"):
            with pa.ipc.open_stream(sealed.as_buffer()) as reader:
                part = reader.read_next_batch()
            small, offsets = text_bytes(part.column("text"))
            string, begin = context_keys(small, offsets, self.order)
            found = self.strings.of(string)
            word, doc = runs(small, offsets, ~SPACE)
            count = self.words.of(hashes(word, self.salt)) if len(word) else np.zeros(0, np.int64)
            n = part.num_rows
            of = lambda weights: np.bincount(doc, weights=weights, minlength=n)  # noqa: E731, B023
            values = {"n_tokens": np.bincount(doc, minlength=n) + 1, "n_known": of(count > 0).astype(np.int64) + (self.end > 0), "log_sum": of(np.log10(count + 1.0)) + np.log10(self.end + 1.0), "score": np.add.reduceat(found, begin[:-1])}
            yield from _rows(_DONE, doc_id=part.column("doc_id"), **{k: pa.array(v) for k, v in values.items()})


def score_texts(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of documents with doc_id and text.

    train: which rows teach the model. score is the model's log10 probability of the text,
    base_score that of its words by their add-one frequencies. The model is that of the
    whole table: training rows are scored by counts that include their own.
    """
    if not LOCAL <= order <= 6:
        raise ValueError(f"order must be {LOCAL} to 6")
    work = chunked(docs, train, order)
    own = work.where(F.col("kind") == STRINGS).select("chunk", "key", "n")
    strings = stored(own.groupBy("key").agg(F.sum("n").alias("n")), "ppm-strings")
    scores = own.select("chunk", "key").join(probabilities(strings, order), "key").select("chunk", "key", F.col("score").alias("value"), F.lit(0).alias("salt"))
    in_word = Window.partitionBy("word")
    words = work.where(F.col("kind") == WORDS).select("chunk", "key", "salt", F.sum("n").over(in_word).alias("value"), (F.row_number().over(in_word.orderBy("chunk")) == 1).alias("first"))
    words = stored(words, "ppm-words")
    texts = work.where(F.col("kind") == TEXTS).select("chunk", "kind", "texts")
    meeting = _packed(scores, STRINGS).unionByName(_packed(words, WORDS)).unionByName(texts, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, None
        for batch in batches:
            numbers, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != chunk:
                    chunk, held = numbers[a], _Chunk(order)
                if kinds[a] == TEXTS:
                    yield from held.score(batch.slice(a, b - a))
                else:
                    held.take(int(kinds[a]), batch.slice(a, b - a))

    chunks = work.select("chunk").distinct().count()
    scored = meeting.repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, _DONE)
    totals = words.where("first").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("train_tokens"), F.count_if(F.col("value") > 0).alias("_known"))
    base = F.col("log_sum") - F.col("n_tokens") * F.log10((F.col("train_tokens") + F.col("_known") + 1).cast("double"))
    return scored.crossJoin(F.broadcast(totals)).select("doc_id", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from those that are not held out."""
    done = score_texts(table(spark, sf_dir, "documents"), ~is_held_out(F.col("doc_id")))
    return done.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
