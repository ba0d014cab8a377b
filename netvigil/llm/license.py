"""License scans: canonical digest lookup.

A text is brought to a canonical form: lower case A-Z, copyright lines and pure
rule lines dropped, equivalent spellings made one, everything but ASCII letters,
digits and other scripts turned into single spaces. The sha256 of the whole
canonical text is looked up among the digests of known licences and notices. The same
is done for each line on its own, so that a notice inside a document is found too.

Only DataFrame functions are used. The registry is a table (license_id, text). Its
digests are a map of constants up to ``MAP_ROWS``, so that a text is read once and
nothing is shuffled; a larger registry is joined, broadcast only under
``BROADCAST_ROWS`` rows, else by a shuffle after each digest has been made distinct.

Defined results: a null text is empty; an empty canonical text matches nothing; a
digest known under several ids gives the smallest; repeated rows stay, each with its own
notices, with a doc_id or without; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import stored, table

BROADCAST_ROWS = 10_000
#: Up to so many digests are looked up in a map of constants.
MAP_ROWS = 500

# Equivalent spellings, by the public SPDX matching guidelines.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantability", "merchantability"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Notices and short licences as their publishers give them.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("WTFPL", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
]

# Lines that licence files carry above the text.
TITLES = {"ISC": ["ISC License", "The ISC License", "ISC License (ISC)"], "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"]}

#: A line that only states a copyright: a sign, a year or a holder follows the word, not the rest of a sentence about it.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright(?=[ \t:,]*(\(c\)|©|[0-9]{4})|[ \t:,]+(?!(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|in|is|to|of|for|the above)\b)[^ \t\n])|\(c\)|©)[^\n]*"
#: ASCII marks and white space but the line end.
MARKS = r"[\x00-\x09\x0B-/:-@\[-`{-\x7F]+"
#: The same runs but a single space, which stays as it is.
RUNS = r"[\x00-\x09\x0B-/:-@\[-`{-\x7F]{2,}|[\x00-\x09\x0B-\x1F!-/:-@\[-`{-\x7F]"
ONE_WORD = [(a, b) for a, b in SPELLINGS if " " not in a]
TWO_WORDS = [(a, b) for a, b in SPELLINGS if " " in a]


def _spelled(text: Column, rules: list[tuple[str, str]]) -> Column:
    for a, b in rules:
        text = F.replace(text, F.lit(f" {a} "), F.lit(f" {b} "))
    return text


def _shaped(text: Column) -> Column:
    """Lower case, no copyright lines, words between single spaces, `` \n `` for line ends."""
    low = F.lower(text)
    stated = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    kept = F.when(stated, F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low)
    words = F.replace(F.regexp_replace(kept, RUNS, " "), F.lit("\n"), F.lit(" \n "))
    words = F.replace(F.replace(words, F.lit("  \n"), F.lit(" \n")), F.lit("\n  "), F.lit("\n "))
    return _spelled(F.concat(F.lit(" "), words, F.lit(" ")), ONE_WORD)


def _whole(shaped: Column) -> Column:
    """The canonical form of a shaped text."""
    return F.trim(_spelled(F.regexp_replace(shaped, r"[ \n]{2,}", " "), TWO_WORDS))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    return _whole(_shaped(F.coalesce(text, F.lit(""))))


def registry(spark: SparkSession) -> DataFrame:
    """The notices and licences that this module knows, whole licences also under their titles."""
    titled = [(a, f"{t}\n{b}") for a, b in KNOWN if b.startswith("Permission ") for t in TITLES.get(a, [])]
    rows = F.array(*[F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in [*KNOWN, *titled]])
    return spark.range(1).select(F.inline(rows))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices).

    ``license_id`` is that of the entire text, or null; ``notices`` are the sorted ids
    of the row's lines that are a known text by themselves.
    """
    shapes = known.select("license_id", canonical(F.col("text")).alias("shape")).where("shape != ''")
    digests = shapes.groupBy(F.sha2("shape", 256).alias("digest"), F.length("shape").alias("chars")).agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", _shaped(F.coalesce("text", F.lit(""))).alias("shaped"))
    shape, lines = _whole(F.col("shaped")).alias("shape"), F.split(_spelled(F.col("shaped"), TWO_WORDS), "\n").alias("lines")
    rows = rows.select("doc_id", shape, lines)
    n = digests.count()
    if n > MAP_ROWS:
        return _joined(rows, F.broadcast(digests) if n <= BROADCAST_ROWS else digests)
    entries = digests.orderBy("digest").collect()
    ids = F.create_map(*[F.lit(x) for r in entries for x in (r["digest"], r["license_id"])]) if entries else F.create_map().cast("map<string,string>")
    # Equal digests need equal lengths, so most lines are never hashed.
    lengths = sorted({r["chars"] for r in entries})
    trimmed = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    notices = F.array_compact(F.transform(trimmed, lambda x: F.try_element_at(ids, F.sha2(x, 256))))
    found = rows.select("doc_id", F.when(F.col("shape") != "", F.sha2("shape", 256)).alias("canonical_sha256"), F.array_sort(F.array_distinct(notices)).alias("notices"))
    return found.select("doc_id", "canonical_sha256", F.try_element_at(ids, F.col("canonical_sha256")).alias("license_id"), "notices")


def _joined(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The same with a registry that is joined: whole texts and lines meet it together, equal digests of a row once."""
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")
    whole = F.when(F.col("shape") != "", F.sha2("shape", 256))
    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole.alias("canonical_sha256"), F.transform(F.array_distinct(lines), lambda x: F.sha2(x, 256)).alias("lines"))
    marked = stored(marked, "license-digests")  # row numbers stay those written, whichever task runs again
    wanted = marked.select("row", F.explode("lines").alias("digest"), F.lit(True).alias("line")).unionByName(marked.select("row", F.col("canonical_sha256").alias("digest"), F.lit(False).alias("line")))
    # A digest that many rows share meets the registry as one row.
    hits = wanted.select("digest").distinct().join(digests.select("digest", "license_id"), "digest")
    found = wanted.join(hits, "digest")
    ids = found.groupBy("row").agg(F.max(F.when(~F.col("line"), F.col("license_id"))).alias("license_id"), F.array_sort(F.collect_set(F.when(F.col("line"), F.col("license_id")))).alias("notices"))
    return marked.join(ids, "row", "left").select("doc_id", "canonical_sha256", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents; notices comma-joined."""
    found = scan_licenses(table(spark, sf_dir, "documents"), registry(spark))
    return found.select("doc_id", "canonical_sha256", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_spelled(text: str, rules: list[tuple[str, str]]) -> str:
    for a, b in rules:
        text = f"replace({text}, ' {a} ', ' {b} ')"
    return text


def _sql_shaped(text: str) -> str:
    low = rf"regexp_replace(lower({text}), '(^|\n)[ \t*#/;-]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
    words = rf"regexp_replace(regexp_replace({low}, '{MARKS}', ' ', 'g'), ' ?\n ?', ' ' || chr(10) || ' ', 'g')"
    return _sql_spelled(f"(' ' || {words} || ' ')", ONE_WORD)


def _sql_whole(shaped: str) -> str:
    return "trim(" + _sql_spelled(rf"regexp_replace({shaped}, '[ \n]+', ' ', 'g')", TWO_WORDS) + ")"


OP9_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}),
digests AS (
  SELECT sha256({_sql_whole(_sql_shaped("text"))}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1
), rows AS (
  SELECT doc_id, {_sql_shaped("coalesce(text, '')")} AS shaped FROM documents
), whole AS (
  SELECT doc_id, nullif({_sql_whole("shaped")}, '') AS shape FROM rows
), lines AS (
  SELECT DISTINCT doc_id, sha256(trim({_sql_spelled("line", TWO_WORDS)})) AS digest
  FROM (SELECT doc_id, unnest(string_split(shaped, chr(10))) AS line FROM rows)
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN digests USING (digest) GROUP BY doc_id
)
SELECT whole.doc_id, CASE WHEN shape IS NOT NULL THEN sha256(shape) END AS canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN digests ON digest = sha256(shape) LEFT JOIN notices ON notices.doc_id = whole.doc_id
"""
