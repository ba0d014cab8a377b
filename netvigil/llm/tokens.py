"""Whole-text tokenisation inside Spark tasks.

``PieceTokenizer`` cuts texts at single spaces between two visible characters, where
neither of the supported vocabularies can join anything. Arrow cuts a batch and brings
its equal pieces together; each different piece is a few units (a word after a space,
marks, a line end, a word below it), whose ids are remembered. The tokenizers library
encodes each unit that it has not seen, and each piece that isn't of this form. A text
with any other white space next to a cut is encoded in one call, so the ids always
equal those of one library call over the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that one worker remembers from batch to batch (memory bound only).
MAX_UNITS = 400_000
#: UTF-8 bytes of text that are looked up in one go.
BATCH_BYTES = 8_000_000
#: Latin letters, ASCII marks but the apostrophe, and the same once more after one line end.
_PLAIN = r"\A(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)(?P<end>\n(?P<below>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<more>[!-&(-/:-@\[-`{-~]*))?\z"
_LOADED: dict[str, "PieceTokenizer"] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Latin-1 letters as the byte-level alphabet writes their UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letter)
    letter |= {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class PieceTokenizer:
    """Encodes texts with one tokenizer file, through a bounded cache of units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_spaces = self._ids(" of") == self._ids("of")
        self.latin = byte_letters()
        # One call of the model per new word, where that is known to be the whole story.
        self.direct = isinstance(self.tokenizer.model, models.BPE) and all(self._word(w) == self._ids(w) for a in ("the", "Été", "Größe", "thonea") for w in (a, " " + a))
        self.unit: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self._keep([("", []), ("\n", [] if self.drops_spaces else self._ids("\n"))])

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, unit: str) -> list[int]:
        """Ids of one pre-token of Latin letters or ASCII marks, with or without a space before it, given to the model."""
        text = unit.strip().lower() if self.drops_spaces else unit.replace(" ", "Ġ", 1)
        return [t.id for t in self.tokenizer.model.tokenize(text if unit.isascii() else text.translate(self.latin))]

    def _keep(self, found: list[tuple[str, list[int]]]) -> None:
        """Appends units with their ids."""
        n, lengths = len(self.unit), np.fromiter((len(x) for _, x in found), np.int64, len(found))
        self.unit.update((k, n + i) for i, (k, _) in enumerate(found))
        used = int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0
        while n + len(found) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while used + int(lengths.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.lengths[n : n + len(found)] = lengths
        self.starts[n : n + len(found)] = used + np.cumsum(lengths) - lengths
        self.ids[used : used + int(lengths.sum())] = np.fromiter((i for _, x in found for i in x), np.uint32, int(lengths.sum()))

    def _numbers(self, keys: list[str], whole: bool) -> np.ndarray:
        """The number of each different unit; whole ones ("\\0" before them) are given to the library as they are."""
        new = [k for k in keys if k not in self.unit]
        if new and whole:
            self._keep([(k, e.ids) for k, e in zip(new, self.tokenizer.encode_batch_fast([k[1:] for k in new], add_special_tokens=False), strict=True)])
        elif new:
            self._keep([(k, self._word(k)) for k in new])
        return np.fromiter(map(self.unit.__getitem__, keys), np.int64, len(keys))

    def _pieces(self, strings: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """(units, safe) of different pieces: five units each, and whether cuts beside the piece change nothing."""
        units, safe = np.zeros((len(strings), 5), np.int64), np.ones(len(strings), bool)
        plain = np.zeros(len(strings), bool)
        if self.direct and len(strings):
            found = pc.extract_regex(strings, _PLAIN)
            plain = found.is_valid().to_numpy(zero_copy_only=False)
            found = found.filter(pa.array(plain))
            for k, (name, before) in enumerate([("word", space), ("marks", ""), ("end", ""), ("below", ""), ("more", "")]):
                own = pc.struct_field(found, name)
                if name == "end":
                    units[plain, k] = (pc.binary_length(own).to_numpy(zero_copy_only=False) > 0) * self.unit["\n"]
                    continue
                own = own.dictionary_encode()
                units[plain, k] = self._numbers([before + x for x in own.dictionary.to_pylist()], False)[own.indices.to_numpy()]
        if not plain.all():
            other = strings.filter(pa.array(~plain)).to_pylist()
            units[~plain, 0] = self._numbers(["\0" + space + x for x in other], True)
            safe[~plain] = [bool(x) and x == x.strip() for x in other]
        return units, safe

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for ids, ends in self.encode_column(pa.array(list(texts), pa.string())):
            out += np.split(ids, ends[:-1])
        return out

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) for runs of texts in order: the ids of all of them, and where each text ends; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield self._encode(texts.slice(at, end - at), end_id)
            at = end

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        code = pieces.indices.to_numpy().astype(np.int64)
        heads = pieces.dictionary.take(pa.array(code[at[:-1]])).dictionary_encode()  # no space before these
        code[at[:-1]] = len(pieces.dictionary) + heads.indices.to_numpy()
        (units, safe), (head_units, head_safe) = self._pieces(pieces.dictionary, " "), self._pieces(heads.dictionary, "")
        units, safe = np.concatenate([units, head_units, np.zeros((1, 5), np.int64)]), np.concatenate([safe, head_safe, [True]])
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        code[at[:-1][empty]] = len(units) - 1
        bad = np.add.reduceat(~safe[code], at[:-1]) > 0
        # The ids of each different piece, then those of the texts.
        size = self.lengths[units]
        flat = self.ids[_ranges(self.starts[units].reshape(-1), size.reshape(-1))]
        length = size.sum(1)
        begin = np.cumsum(length) - length
        own = length[code]
        ids = flat[_ranges(begin[code], own)]
        ends = np.cumsum(own)[at[1:] - 1]
        if bad.any():
            rows = np.split(ids, ends[:-1])
            for k in np.flatnonzero(bad).tolist():
                rows[k] = np.array(self._ids(texts[k].as_py()), np.uint32)
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        if end_id is not None:
            ends = ends + np.arange(1, len(ends) + 1)
            whole = np.full(int(ends[-1]), end_id, np.uint32)
            inside = np.ones(len(whole), bool)
            inside[ends - 1] = False
            whole[inside] = ids
            ids = whole
        while len(self.unit) > MAX_UNITS:  # frequent units came first
            self.unit.popitem()
        return ids, ends


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after the other."""
    after = np.cumsum(size)
    return np.arange(int(after[-1]) if len(after) else 0) + np.repeat(first - after + size, size)


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]
