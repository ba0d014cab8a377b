"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together again.

A text's bytes and code points part only at multibyte characters, so an index holds just
those: where each stands and how many bytes more than one it takes. A binary search in it
turns byte cuts into code points and back; between two entries the difference is a
constant, and an ASCII text has an empty index. Batches of texts are indexed at once.

A text is cut into units (tokens of white space and what follows it, or code points).
Hashes of the doc_id choose two cuts and the form, so a row that runs again gives the
same. Null text is empty and stays plain; a null doc_id hashes as no digits; equal ids
cut at equal draws; columns of the input that have our names are left out of the result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import only, table
from netvigil.llm.rawtext import SPACE, slices, text_array

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Multibyte characters of UTF-8 bytes: their places and excess bytes."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])  # excess bytes of the first k of them
        self.at_char = self.at_byte - self.before[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte cuts that stand between characters."""
        return cuts - self.before[np.searchsorted(self.at_byte, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before code-point cuts."""
        return cuts + self.before[np.searchsorted(self.at_char, cuts)]


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where tokens end: behind each run without white space, and behind white space that ends a text."""
    ends = ~SPACE[data]
    ends[:-1] &= SPACE[data[1:]]
    filled = offsets[1:] > offsets[:-1]
    ends[offsets[1:][filled] - 1] = True
    return np.flatnonzero(ends) + 1


def _draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit draws for each id."""
    texts = [f"{seed}:{'' if d is None else d}".encode() for d in doc_ids]
    return np.array([struct.unpack(">4I", hashlib.sha256(t).digest()[:16]) for t in texts], np.int64).reshape(-1, 4)


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, unit: str = "token") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents with doc_id and text.

    rate: percent of texts that are transformed; spm_rate: percent of those that put the
    suffix first. unit: "token" or "char". Texts that hold a mark stay plain, so the marks
    of an output are the first of their kind in it.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            index = ExceptionIndex(data)
            start, starts = offsets[:-1], index.chars(offsets)
            if unit == "token":
                ends = token_ends(data, offsets)
                upto = np.searchsorted(ends, offsets, "right")
                n = np.diff(upto)
            else:
                n = np.diff(starts)
            draws = _draws(part.column("doc_id").to_pylist(), seed)
            units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            if unit == "token":
                behind = np.concatenate([[0], ends])
                cuts = np.where(units == 0, start[:, None], behind[upto[:-1, None] + units])
            else:
                cuts = index.bytes(starts[:-1, None] + units)
            chars = index.chars(cuts) - starts[:-1, None]
            form, outputs = [], []
            for k, ((a, b), draw) in enumerate(zip(cuts.tolist(), draws.tolist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if not text or draw[2] % 100 >= rate or any(x in text for x in marks):
                    form.append("plain")
                    outputs.append(text)
                    continue
                a, b = a - int(offsets[k]), b - int(offsets[k])
                spm = draw[3] % 100 < spm_rate
                form.append("spm" if spm else "psm")
                outputs.append(b"".join([s, text[b:], p, text[:a], m, text[a:b]] if spm else [p, text[:a], s, text[b:], m, text[a:b]]))
            plain = np.array([f == "plain" for f in form], bool)
            sizes = np.cumsum([0, *map(len, outputs)])
            written = text_array(np.frombuffer(b"".join(outputs), np.uint8), sizes).cast(pa.string())
            columns = [part.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1] - chars[:, 0], mask=plain), written]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    between = lambda first, second: F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
    tail = lambda mark: F.substr(output, F.instr(output, mark) + len(mark))
    middle = tail(MIDDLE)
    psm = F.concat(between(PREFIX, SUFFIX), middle, F.substring_index(tail(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(tail(PREFIX), MIDDLE, 1), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all documents, with digests of each output and of the text put together again."""
    made = transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, h3, h4, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b
  FROM (
    SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
      CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)
  )
), parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
