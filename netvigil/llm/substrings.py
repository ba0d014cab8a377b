"""Removal of repeated substrings across documents, by suffix arrays.

A byte goes if some string of ``LENGTH`` bytes over it also starts in a document with a
smaller doc_id. Strings meet through anchors: each such string has one anchor, the
``GRAM`` bytes in it with the smallest hash (leftmost of equal ones), so equal strings
have equal anchors. The steps, all as Spark jobs:

1. Each task sends the hashes of its anchors, marked if several of its documents have
   them; those of more than one document go into a Bloom filter of bounded size. A
   false match costs work, nothing else. Anchors that very many slices send are hot.
2. Documents are read again. An anchor that passes the filter gives its occurrence
   and, once for each slice, its context: the bytes of the strings that it stands for,
   with the smallest doc_id there. They are dealt by anchor over buckets whose number
   follows from the bytes of all texts, so that a bucket has a bounded share of them.
   A hot anchor's strings are contexts of their own, dealt by their bytes; their
   occurrences go to one of ``SALTS`` buckets, each of which gets those contexts.
3. A task takes one bucket at a time. Contexts are one where all their bytes are equal.
   It orders all suffixes of the different contexts of its anchors by linear grouping
   (``grouping.suffix_array``; the anchor, which all strings of a context hold, is one
   symbol), cuts the order where neighbours differ in their strings, takes the smallest
   doc_id of each piece, and gives every occurrence the strings with a smaller one. An
   anchor with one single context needs no order; one with too many for an array is
   taken string by string. Hashes only bring rows together: anchors, contexts and
   strings are told apart by their bytes.
4. Spans meet by blocks of documents, one row from each bucket to each block, and are
   merged there; then they meet their documents and the bytes under them are dropped.

Defined results: a null or empty text has no bytes; texts shorter than ``LENGTH`` keep
all; rows with equal doc_id are compared with smaller doc_ids only; a row without
doc_id takes no part and keeps its text; other columns are ignored; no rows, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, stored, table
from netvigil.llm.decontam import slices, text_bytes
from netvigil.llm.grouping import suffix_arrays

LENGTH, GRAM = 50, 28
#: Bytes of a string beside its anchor.
BESIDE = LENGTH - GRAM
#: Window starts that are looked at in one go.
BLOCK = 1 << 17
#: Bytes of text whose anchors a task sends together, and of text for each bucket, of which at most a power of two are made.
SLICE, BUCKET_BYTES, MOST_BUCKETS = 4_000_000, 8_000_000, 18
#: Bytes of the longest context: all strings over one anchor.
WIDTH = LENGTH + LENGTH - GRAM
#: Occurrences whose strings are looked up in one go.
OCCURRENCES = 50_000
#: Bits of the filter for each shared anchor, and at most (64 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 29
#: An anchor sent by so many slices is hot, where a slice counts once more for each ``OFTEN`` occurrences: fewer are no
#: more than a bucket's share, and each string of a hot one is sent ``SALTS`` times, to all buckets that have its occurrences.
HOT_SLICES, OFTEN, SALTS = 20_000, 16, 16
#: Symbols of one suffix array.
ARRAY_BYTES = 150_000

_BASE = 0xD6E8FEB86659FD93
_U = np.uint64


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; kept for the next texts."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _TABLES[name] = np.cumprod(factors, dtype=_U)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and the factors that make a part's hash independent of its place."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    return total, down


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@dataclass
class Anchors:
    """Runs of string starts (first to last, in the joined texts) that share an anchor."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    key: np.ndarray


def anchors_of(data: np.ndarray, at: np.ndarray) -> Anchors:
    """The anchors of all strings inside the texts."""
    sizes = np.diff(at)
    out = []
    for lo in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[lo : lo + BLOCK + LENGTH - 1]
        total, turn = _prefix(part)
        grams = mix((total[GRAM:] - total[:-GRAM]) * turn[: len(total) - GRAM])
        low = (grams & _U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=_U)
        size, span = LENGTH - GRAM + 1, 1
        while span * 2 <= size:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < size:
            low = np.minimum(low[: len(low) - (size - span)], low[size - span :])
        place = (low & _U(0xFFFFFF)).astype(np.int64)
        edges = np.clip(at, lo, lo + len(place))
        own_doc = np.repeat(np.arange(len(sizes)), np.diff(edges))
        fits = np.ones(len(place), bool)
        for end in at[1:][(at[1:] > lo) & (at[1:] - LENGTH + 1 < lo + len(place))].tolist():
            fits[max(0, end - LENGTH + 1 - lo) : max(0, end - lo)] = False
        starts = np.flatnonzero(fits)
        if not len(starts):
            continue
        p = place[starts]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
        # An anchor's hash is the least of many; spread anew, keys fill all buckets alike.
        out.append((own_doc[first], first + lo, last + lo, p[new] + lo, mix(grams[p[new]])))
    if not out:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(_U))
    return Anchors(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key: its highest bits; n is a power of two."""
    return (keys >> _U(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)


def _six(keys: np.ndarray) -> bytes:
    return (keys >> _U(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(">u8").astype(_U)


def shared_anchors(docs: DataFrame, buckets: int, tasks: int, hot_slices: int = HOT_SLICES) -> DataFrame:
    """(bucket, n, shared, hot): 48-bit keys that more than one row has, and those that very many slices have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, at = text_bytes(part.column(1))
                found = anchors_of(data, at)
                order = np.argsort(found.key, kind="stable")
                key, doc = found.key[order], found.doc[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                if not len(new):
                    continue
                several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
                more = np.diff(new, append=len(key)) // OFTEN
                key = key[new]
                cuts = np.searchsorted(_buckets(key, buckets), np.arange(buckets + 1))
                rows = [(b, key[x:y], several[x:y], more[x:y]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
                single, twice, often = ([_six(k[w(s, m)]) for _, k, s, m in rows] for w in (lambda s, m: ~s, lambda s, m: s, lambda s, m: m > 0))
                times = [m[m > 0].astype("<u4").tobytes() for _, _, _, m in rows]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, *_ in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in (single, twice, often, times))], ["bucket", "single", "several", "often", "times"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _by_bucket(batches):
            single, several, often, times = (b"".join(x) for x in zip(*rows, strict=True))
            twice = _from_six(several)
            key, n = np.unique(np.concatenate([_from_six(single), twice]), return_counts=True)
            shared = key[(n > 1) | np.isin(key, twice)]
            np.add.at(n, np.searchsorted(key, _from_six(often)), np.frombuffer(times, "<u4").astype(n.dtype))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(shared)], pa.int64()), pa.array([_six(shared << _U(16))], pa.binary()), pa.array([_six(key[n >= hot_slices] << _U(16))], pa.binary())], ["bucket", "n", "shared", "hot"])

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, single binary, several binary, often binary, times binary")
    return stored(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "bucket int, n long, shared binary, hot binary"), "anchors")


@dataclass
class Filter:
    """A Bloom filter in blocks, one for each bucket, and the hot keys."""

    buckets: int
    block: int
    bits: np.ndarray
    hot: np.ndarray

    def places(self, key: np.ndarray) -> list[np.ndarray]:
        """Four bits for each 48-bit key, in its bucket's block."""
        spread = mix(key)
        base = _buckets(key << _U(16), self.buckets) * self.block
        return [base + ((spread >> _U(16 * k)) * _U(self.block // 256) + (spread >> _U(8 * k)) % _U(self.block)).astype(np.int64) % self.block for k in range(4)]

    def passes(self, key: np.ndarray) -> np.ndarray:
        """Which keys may be shared."""
        out = np.ones(len(key), bool)
        short = key >> _U(16)
        for p in self.places(short):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out

    def is_hot(self, key: np.ndarray) -> np.ndarray:
        return np.isin(key >> _U(16), self.hot)


def filter_of(shared: DataFrame, buckets: int) -> Filter:
    """Builds the filter block by block in tasks; its size is bounded whatever the input."""
    n = shared.agg(F.max("n")).first()[0] or 0
    block = 1 << max(10, int(n * FILTER_BITS - 1).bit_length())
    block = min(block, MOST_BITS // buckets)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, keys, hot in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shared", "hot")), strict=True):
                own = Filter(buckets, block, np.zeros(0, np.uint8), np.zeros(0, _U))
                bits = np.zeros(block, np.uint8)
                for p in own.places(_from_six(keys)):
                    bits[p - b * block] = 1
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([hot], pa.binary())], ["bucket", "bits", "hot"])

    out = np.zeros(buckets * block // 8, np.uint8)
    hot = []
    for row in shared.mapInArrow(fill, "bucket int, bits binary, hot binary").toLocalIterator():  # MOST_BITS in all
        out[row["bucket"] * block // 8 : (row["bucket"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
        hot.append(bytes(row["hot"]))
    return Filter(buckets, block, out, _from_six(b"".join(hot)))


def records_of(data: np.ndarray, first: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` bytes for each context: its bytes, then zeros."""
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[first]
    out[np.arange(WIDTH) >= (LENGTH + span)[:, None]] = 0
    return out


def record_hash(records: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """A hash of each row; it puts equal rows side by side and proves nothing."""
    factors = mix(np.arange(1, WIDTH // 8 + 1, dtype=_U)) | _U(1)
    return mix((np.ascontiguousarray(records).view("<u8").astype(_U) * factors).sum(1, dtype=_U) ^ mix(extra.astype(_U)))


def same_records(records: np.ndarray, left: np.ndarray, span: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): one row of each run of equal contexts in hash order, and the run of every row.

    Rows are equal only byte by byte. Equal rows that a collision keeps apart stay two
    contexts, which costs work and changes no result.
    """
    order = np.argsort(hashes, kind="stable")
    rows = np.ascontiguousarray(records[order]).view("<u8")
    new = np.ones(len(order), bool)
    new[1:] = (left[order][1:] != left[order][:-1]) | (span[order][1:] != span[order][:-1]) | (rows[1:] != rows[:-1]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _less(values: np.ndarray) -> bytes:
    """Integers as the bytes of their differences, lowest bytes of all first."""
    steps = np.diff(values, prepend=0).astype("<i8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _more(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<i8").reshape(-1)) if n else np.zeros(0, np.int64)


def _pack(doc_ids: np.ndarray, hashes: np.ndarray | None, occ: tuple[np.ndarray, ...], ctx: tuple[np.ndarray, ...]) -> bytes:
    """Occurrences (document, start, context) and contexts (left, span, least document, record) of one bucket."""
    doc, start, context = occ
    left, span, least, record = ctx
    used, doc = np.unique(np.concatenate([doc, least]), return_inverse=True)
    doc, least = doc[: len(start)], doc[len(start) :]
    size = np.arange(WIDTH) < (LENGTH + span)[:, None]
    parts = [_less(doc_ids[used]), hashes[used].tobytes() if hashes is not None else b"", _less(doc), _less(start), _less(context), left.astype("u1").tobytes(), span.astype("u1").tobytes(), _less(least), record[size].tobytes()]
    head = np.array([len(used), len(start), len(left), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> tuple:
    """(doc_ids, hashes, occurrences, contexts) as ``_pack`` was given them; documents by place in doc_ids."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n_docs, n_occ, n_ctx, *sizes = np.frombuffer(data[:48], "<u4").tolist()
    ends = np.cumsum([48, *sizes]).tolist()
    parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    left, span = (np.frombuffer(x, "u1").astype(np.int64) for x in parts[5:7])
    record = np.zeros((n_ctx, WIDTH), np.uint8)
    record[np.arange(WIDTH) < (LENGTH + span)[:, None]] = np.frombuffer(parts[8], np.uint8)
    hashes = np.frombuffer(parts[1], "<i8") if parts[1] else np.zeros(n_docs, np.int64)
    return _more(parts[0], n_docs), hashes, tuple(_more(p, n_occ) for p in parts[2:5]), (left, span, _more(parts[7], n_ctx), record)


def deal(data: np.ndarray, at: np.ndarray, doc_ids: np.ndarray, hashes: np.ndarray | None, known: Filter, salt: int) -> list[tuple[int, bytes]]:
    """(bucket, packed occurrences and contexts) of a slice's anchors that pass the filter."""
    found = anchors_of(data, at)
    keep = np.flatnonzero(known.passes(found.key))
    if not len(keep):
        return []
    doc, first, last, place, key = (x[keep] for x in (found.doc, found.first, found.last, found.place, found.key))
    hot = known.is_hot(key)
    home = _buckets(key, known.buckets)
    if hot.any():  # each string of a hot anchor is a context of its own, dealt by its bytes
        times = np.where(hot, last - first + 1, 1)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        doc, place, hot, home = (np.repeat(x, times) for x in (doc, place, hot, home))
        first = np.repeat(first, times) + step
        last = np.where(hot, first, np.repeat(last, times))
    left, span = place - first, last - first
    record = records_of(data, first, span)
    content = record_hash(record, left * LENGTH + span)
    home = np.where(hot, _buckets(content, known.buckets), home)
    one, which = same_records(record, left, span, content)
    low = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(low, which, doc_ids[doc])
    least = np.empty(len(one), np.int64)
    holds = doc_ids[doc] == low[which]
    least[which[holds]] = doc[holds]
    spread = np.arange(SALTS) * max(1, known.buckets // SALTS)
    occ_home = np.where(hot, (home + spread[salt % SALTS]) % known.buckets, home)
    many = np.flatnonzero(hot[one])
    extra = np.unique(np.stack([np.repeat(many, SALTS), (home[one[many]][:, None] + spread).reshape(-1) % known.buckets], 1), axis=0)
    cold = np.flatnonzero(~hot[one])
    ctx, ctx_home = np.concatenate([cold, extra[:, 0]]), np.concatenate([home[one[cold]], extra[:, 1]])
    order = np.lexsort((one[ctx], ctx_home))  # in the order of their first occurrences
    ctx, ctx_home = ctx[order], ctx_home[order]
    occ = np.argsort(occ_home, kind="stable")
    occ_home = occ_home[occ]
    out, number = [], np.empty(len(one), np.int64)
    for b in np.unique(ctx_home).tolist():
        x, y = np.searchsorted(ctx_home, [b, b + 1])
        p, q = np.searchsorted(occ_home, [b, b + 1])
        o, c = occ[p:q], ctx[x:y]
        number[c] = np.arange(len(c))
        f = one[c]
        out.append((b, _pack(doc_ids, hashes, (doc[o], first[o] - at[doc[o]], number[which[o]]), (left[f], span[f], least[c], record[f]))))
    return out


def packed_contexts(docs: DataFrame, known: Filter, doubled: bool) -> DataFrame:
    """(bucket, packed): occurrences and contexts of the anchors that pass the filter; hashes only where doc_ids repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                turn += 1
                data, at = text_bytes(part.column(1))
                doc_ids = part.column(0).to_numpy()
                rows = deal(data, at, doc_ids, part.column(2).to_numpy() if doubled else None, sent.value, turn + int(doc_ids[0]) if len(doc_ids) else 0)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "packed"])

    return docs.mapInArrow(run, "bucket int, packed binary")


def _anchor_numbers(records: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number for each context's anchor, the same for the same bytes and no others."""
    grams = np.lib.stride_tricks.sliding_window_view(records, GRAM, axis=1)[np.arange(len(left)), left]
    words = np.zeros((len(left), 32), np.uint8)
    words[:, :GRAM] = grams
    words = words.view("<u8")
    keys = mix((words.astype(_U) * (mix(np.arange(1, 5, dtype=_U)) | _U(1))).sum(1, dtype=_U))
    order = np.argsort(keys, kind="stable")
    turns = keys[order][1:] != keys[order][:-1]
    if ((words[order][1:] != words[order][:-1]).any(1) & ~turns).any():  # two anchors with one hash
        return np.unique(words, axis=0, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(left), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(turns)])
    return out


def least_by_string(left: np.ndarray, span: np.ndarray, least: np.ndarray, anchor: np.ndarray, records: np.ndarray) -> np.ndarray:
    """For each string start of each context: the least doc_id of any context with that string.

    Contexts of one anchor lie side by side and form a text: their bytes with the anchor
    between them as one symbol, so a string of LENGTH bytes is BESIDE + 1 symbols, and a
    separator behind each.
    """
    sizes = span + BESIDE + 1
    last = np.concatenate([anchor[1:] != anchor[:-1], [True]])  # of its anchor's text
    begins = np.cumsum(sizes + 1 + last) - sizes - 1 - last
    n = int((sizes + 1 + last).sum())
    joined = np.ones(n, np.int64)
    middle = begins + left
    inside = np.ones(n, bool)
    inside[begins + sizes] = inside[middle] = inside[(begins + sizes + 1)[last]] = False
    column = np.arange(WIDTH)
    beside = (column < (LENGTH + span)[:, None]) & ((column < left[:, None]) | (column >= (left + GRAM)[:, None]))
    joined[inside] = records[beside].astype(np.int64) + 2
    joined[middle] = 258
    joined[(begins + sizes + 1)[last]] = 0
    strings = span + 1
    starts = np.arange(int(strings.sum())) + np.repeat(begins - (np.cumsum(strings) - strings), strings)
    owner = np.full(n, -1)
    owner[starts] = np.repeat(np.arange(len(sizes)), strings)
    order = suffix_arrays(joined, np.concatenate([[0], (begins + sizes + 2)[last]]))
    order = order[owner[order] >= 0]
    a, b = order[:-1], order[1:]
    same = anchor[owner[a]] == anchor[owner[b]]
    for k in range(BESIDE + 1):  # neighbours whose strings agree
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = joined[a[live] + k] == joined[b[live] + k]
    piece = np.concatenate([[0], np.cumsum(~same)])
    low = np.full(int(piece[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, piece, least[owner[order]])
    out = np.empty(n, np.int64)
    out[order] = low[piece]
    return out[starts]


def _in_parts(left: np.ndarray, span: np.ndarray, least: np.ndarray, anchor: np.ndarray, records: np.ndarray) -> np.ndarray:
    """least_by_string for an anchor with too many contexts for one array: string by string, dealt by their bytes."""
    times = span + 1
    owner = np.repeat(np.arange(len(span)), times)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    strings = np.zeros((len(owner), WIDTH), np.uint8)
    strings[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(records, LENGTH, axis=1)[owner, step]
    own_left, none = left[owner] - step, np.zeros(len(owner), np.int64)
    hashes = record_hash(strings, own_left)
    one, which = same_records(strings, own_left, none, hashes)
    low = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(low, which, least[owner])
    parts = -(-len(one) * (BESIDE + 2) // ARRAY_BYTES)
    part = (mix(hashes[one] + _U(1)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if y - x > 1:
            own = one[order[x:y]]
            low[order[x:y]] = least_by_string(own_left[own], none[own], low[order[x:y]], anchor[owner[own]], strings[own])
    return low[which]


def _least_of(left: np.ndarray, span: np.ndarray, least: np.ndarray, records: np.ndarray) -> np.ndarray:
    """For each string start of each context of a bucket: the least doc_id; suffix arrays hold whole anchors."""
    strings = span + 1
    out = np.empty(int(strings.sum()), np.int64)
    first = np.cumsum(strings) - strings
    anchor = _anchor_numbers(records, left)
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]]))
    after = np.concatenate([[0], np.cumsum((span + BESIDE + 2)[order])])
    size = after[cuts[1:]] - after[cuts[:-1]]
    by_size = np.argsort(size, kind="stable")  # texts of like sizes side by side
    done = np.cumsum(size[by_size])
    lo = 0
    while lo < len(by_size):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + ARRAY_BYTES, side="right")))
        own = by_size[lo:hi]
        n = cuts[own + 1] - cuts[own]
        some = order[np.arange(int(n.sum())) + np.repeat(cuts[own] - (np.cumsum(n) - n), n)]
        t = strings[some]
        to = np.arange(int(t.sum())) + np.repeat(first[some] - (np.cumsum(t) - t), t)
        of = _in_parts if size[own[0]] > ARRAY_BYTES else least_by_string
        out[to] = of(left[some], span[some], least[some], anchor[some], records[some])
        lo = hi
    return out


def bucket_spans(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, hash, spans) of all packed rows of one bucket."""
    ids, hashes, row, start, context, contexts = [], [], [], [], [], []
    base = n = 0
    for blob in blobs:
        own_ids, own_hashes, occ, (left, span, least, record) = _unpack(blob)
        ids.append(own_ids)
        hashes.append(own_hashes)
        row.append(occ[0] + base)
        start.append(occ[1])
        context.append(occ[2] + n)
        contexts.append((left, span, own_ids[least], record))
        base += len(own_ids)
        n += len(left)
    doc_ids, row, start, context = (np.concatenate(x) for x in (ids, row, start, context))
    left, span, least, record = (np.concatenate(x) for x in zip(*contexts, strict=True))
    del contexts
    one, which = same_records(record, left, span, record_hash(record, left * LENGTH + span))
    low = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(low, which, least)
    left, span, record = left[one], span[one], record[one]
    context = which[context]
    strings = span + 1
    first = np.cumsum(strings) - strings
    low = _least_of(left, span, low, record)
    parts = []
    for lo in range(0, len(row), OCCURRENCES):
        own_row, own_start, own = row[lo : lo + OCCURRENCES], start[lo : lo + OCCURRENCES], context[lo : lo + OCCURRENCES]
        t = strings[own]
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        occ = np.repeat(np.arange(len(own)), t)
        gone = low[first[own][occ] + step] < doc_ids[own_row[occ]]
        r, at = own_row[occ[gone]], own_start[occ[gone]] + step[gone]
        if len(r):
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)]))
            parts.append((r[new], at[new], at[np.concatenate([new[1:] - 1, [len(r) - 1]])] + LENGTH))
    if not parts:
        return
    r, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((begin, r))
    r, pairs = r[order], np.stack([begin[order], end[order]], 1).astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]])).tolist()
    text_hashes = np.concatenate(hashes)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        yield int(doc_ids[r[x]]), int(text_hashes[r[x]]), pairs[x:y].tobytes()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(bucket, the lists of its other columns) of rows sorted by bucket, one bucket at a time."""
    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(row)
    if held:
        yield bucket, held


def _to_blocks(found: list[tuple[int, int, bytes]], blocks: int) -> list[tuple[int, bytes]]:
    """(block, packed spans) of a bucket's (doc_id, hash, spans); a document is in one block whatever its bucket."""
    doc, hashes, spans = zip(*found, strict=True)
    times = np.fromiter(map(len, spans), np.int64, len(spans)) // 8
    doc, hashes = (np.repeat(np.array(x, np.int64), times) for x in (doc, hashes))
    begin, end = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).T.astype(np.int64)
    block = (mix(doc.view(_U)) % _U(blocks)).astype(np.int64)
    order = np.lexsort((begin, hashes, doc, block))
    cuts = np.searchsorted(block[order], np.arange(blocks + 1)).tolist()
    rows = [(k, order[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
    return [(k, zstandard.ZstdCompressor(1).compress(b"".join(map(_less, (doc[own], hashes[own], begin[own], end[own] - begin[own]))))) for k, own in rows]


def _block_spans(blobs: list[bytes]) -> pa.RecordBatch:
    """(doc_id, hash, spans) of one block, a row for each document: its maximal runs from all buckets."""
    parts = []
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        size = len(data) // 4
        parts.append([_more(data[k * size : (k + 1) * size], size // 8) for k in range(4)])
    doc, hashes, begin, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((begin, hashes, doc))
    doc, hashes, begin, size = (x[order] for x in (doc, hashes, begin, size))
    own = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
    base = np.cumsum(own) << 32  # each document's places lie above those of the one before
    reach = np.maximum.accumulate(base + begin + size)
    new = np.flatnonzero(np.concatenate([[True], (base + begin)[1:] > reach[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(begin) - 1]])
    pairs = np.stack([begin[new], (reach - base)[last]], 1).astype("<u4")
    first = np.flatnonzero(own)
    ends = np.concatenate([np.searchsorted(new, first), [len(new)]])* 8
    spans = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(hashes[first]), spans], ["doc_id", "hash", "spans"])


def repeated_spans(packed: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, hash, spans): for each row with repeated bytes, starts and ends of them as 32-bit pairs.

    A bucket gives one row for each block of documents, not for each document: a text
    has anchors in very many buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            found = list(bucket_spans([x for (x,) in rows]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*_to_blocks(found, tasks), strict=True), (pa.int32(), pa.binary()), strict=True)], ["block", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            yield _block_spans([x for (x,) in rows])

    found = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block int, packed binary")
    return found.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(merge, "doc_id long, hash long, spans binary")


def merged_spans(spans: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    pairs = sorted(map(tuple, np.frombuffer(b"".join(spans or []), "<u4").reshape(-1, 2).tolist()))
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_repeats(docs: DataFrame, hot_slices: int = HOT_SLICES, name: str = "spans") -> DataFrame:
    """All columns of docs and one more: a list of packed (start, end) byte spans, null where nothing repeats."""
    text_hash = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    by_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    seen = by_id.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    doubled = seen["n"] > 1  # texts of one doc_id are told apart by their hashes
    rows = rows.withColumn("hash", text_hash if doubled else F.lit(0).cast("long"))
    buckets = 1 << min(MOST_BUCKETS, max(4, int(seen["size"] // BUCKET_BYTES).bit_length()))
    tasks = max(buckets // 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = shared_anchors(rows, buckets, tasks, hot_slices)
    packed = packed_contexts(rows, filter_of(shared, buckets), doubled)
    # Stored, so that the contexts' shuffle is gone from the disks before that of the texts comes.
    spans = stored(repeated_spans(packed, tasks), "spans").select(F.col("doc_id").alias("_span_doc"), F.col("hash").alias("_span_hash"), F.array("spans").alias("_spans"))
    meets = docs["doc_id"].cast("long") == spans["_span_doc"]
    if doubled:
        meets &= F.xxhash64(docs["text"]) == spans["_span_hash"]
    return docs.join(spans, meets, "left").select(*[docs[f"`{c}`"] for c in docs.columns], spans["_spans"].alias(name))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each document, and the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, gone = (text or "").encode(), merged_spans(spans)
                edges = [0, *[x for s in gone for x in s], len(data)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    digest.update(data[a:b])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return find_repeats(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The same with a dictionary of all strings, for tests."""
    least: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - LENGTH + 1):
            s = data[k : k + LENGTH]
            if least.get(s, doc) >= doc:
                least[s] = doc
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        edge = np.zeros(len(data) + 1, np.int64)
        for k in range(len(data) - LENGTH + 1):
            if least[data[k : k + LENGTH]] < doc:
                edge[k] += 1
                edge[k + LENGTH] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
