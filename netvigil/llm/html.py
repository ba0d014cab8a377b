"""Main-text extraction by union-free wrapper inference.

A page becomes a token stream: opening and closing containers (tag and class or id
words) and text slots named by their block tag. Repeats inside a page are folded into
one-or-more groups. The distinct folded streams of a host are aligned one after the
other into a wrapper: equal tokens stay, a stretch that only one side has becomes an
optional group, a stretch that is a repeat of what stands beside it becomes a repeated
group. Every slot of a page has its slot in the wrapper; how often each text stands in a
wrapper slot over the different pages of the host tells constants from text slots. The
wrapper's slots are then labelled (``label``): in article and main containers all is
content but boxes of constants; where a host has none, varying texts that are no links
are, wherever they stand outside menus and the like. A page takes the texts of its
content slots. Slots without a place in the wrapper, and hosts with a single page, are
labelled by the page alone.

Streams are counted per host and folded stream before they meet, so a host with many
pages brings as many rows as it has page shapes; hosts with many shapes are aligned in
parts whose wrappers are aligned again.

Defined results: a null or empty html gives an empty text; a null url is a host of its
own; repeated rows are extracted each; other columns are ignored; no pages, no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import stored, table

# Roles of HTML elements, and words of class, id and role attributes.
RAW = "script style noscript template svg annotation iframe object textarea select option button title".split()
TEXTUAL = "script style noscript textarea title".split()
DROPPED = "head nav footer aside form header dialog".split()
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input picture source meta link math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mspace mover munder mstyle".split()
LOOSE = "p li dt dd tr td th thead tbody tfoot colgroup option optgroup".split()
DROPPED_WORDS = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
#: What may stand beside such a word in the name of a box, and what turns such a name into one of a layout.
BOX_WORDS = "area bar block body bottom box button buttons card cards center column container count cta dialog element feed fixed form global group icons inline inner item items left link links list main media mobile module outer page panel popular post posts primary prompt right row secondary section site slot sticky strip small text thread title top unit wrap wrapper zone".split()
LAYOUT_WORDS = "has no with without is not".split()
COMMENT_WORDS = "comment comments reply replies respond".split()
MAIN_TAGS = ["article", "main"]
#: A word that no attribute has, for containers that are the page.
PAGE = "=page"
MAIN_WORDS = "article articlebody content entry entry-content main post post-content story".split()
#: Longest group of tokens that is looked for as a repeat, and shapes of a host that one task aligns.
REPEAT, SHAPES = 8, 400

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")
_SPACE = re.compile(r"\s+")


def host_of(url: str | None) -> str | None:
    """The host of a URL; the whole text where there is none."""
    found = url and _HOST.match(url)
    return found[1].lower() if found else url


@dataclass
class Page:
    """A folded stream and its blocks in page order: (slot, text, characters in links)."""

    shape: str
    blocks: list[tuple[int, str, int]]


def _signature(tag: str, attributes: str) -> str:
    words = sorted({w.lower() for _, v in _NAMED.findall(attributes) for w in v.strip("\"'").split()}) if attributes else []
    if len(words) > 6:  # words that tell nothing by themselves become one
        rest = [w for w in words if not (_drops(w) or w in MAIN_WORDS)]
        short = ["x" + blake2b(" ".join(rest).encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()] if rest else []
        words = [w for w in words if _drops(w) or w in MAIN_WORDS] + short
    return ".".join([tag, *words])


def _parts(word: str) -> list[str]:
    return re.split("[-_]+", word)


def _drops(word: str) -> bool:
    """Whether a word speaks of a box at all: by itself, or as a part."""
    return any(p in DROPPED_WORDS for p in [word, *_parts(word)])


def _box(word: str) -> bool:
    """Whether a word names a box: ``share``, ``ad-slot``, ``related_posts``, but not ``has-banner`` or ``social-history``."""
    parts = _parts(word)
    named = _drops(word) and all(p in DROPPED_WORDS or p in BOX_WORDS or p.isdigit() for p in parts)
    return word in DROPPED_WORDS or (named and parts[0] not in LAYOUT_WORDS)


@lru_cache(100_000)
def _hints(token: str) -> bool:
    """Whether words of a container speak of a box without naming one, so that what it holds must decide."""
    tag, *words = token[1:].split(".")
    speaks = any(_drops(w) and not _box(w) and _parts(w)[0] not in LAYOUT_WORDS for w in words)
    return PAGE not in words and (tag == "menu" or (tag not in MAIN_TAGS and speaks))


@lru_cache(100_000)
def _rules(token: str) -> bool:
    return _hints(token) or _dropped(token)


def tokens_of(html: str) -> tuple[list[str], list[str], list[int]]:
    """Tokens (``<div.ad``, ``/div``, ``#p``), the text of each slot and its characters in links, in page order."""
    out: list[str] = []
    texts: list[str] = []
    links: list[int] = []
    linked, in_link = 0, False
    stack: list[str] = []
    block, parts = "", []
    at, end = 0, len(html)

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append("#" + block)
                texts.append(text)
                links.append(min(linked, len(text)))
            parts.clear()
        linked = 0

    while at < end and (m := _TOKEN.match(html, at)):
        at = m.end()
        text, tag = m[4], (m[2] or "").lower()
        if text is not None:
            parts.append(text)
            linked += len(text) * in_link
        elif tag == "a":
            in_link = not m[1]
        elif tag in RAW and not m[1]:
            if m[0].endswith("/>") and tag not in TEXTUAL:
                continue  # closed in itself
            stop = _RAW_END[tag].search(html, at)
            at = stop.end() if stop else end if tag in TEXTUAL else at
        elif not tag or tag in INLINE or tag in RAW:
            continue
        elif tag == "br" or tag == "hr":
            close()
        elif tag in LOOSE:
            close()
            block = "" if m[1] else tag
        elif m[1]:
            close()
            block = ""
            if tag in stack:  # what was left open inside ends here
                while True:
                    inner = stack.pop()
                    out.append("/" + inner)
                    if inner == tag:
                        break
        elif re.fullmatch("h[1-6]", tag):
            close()
            block = "h"
        else:
            close()
            block = ""
            if tag in ("ul", "ol", "table", "html", "body", "center", "dl"):
                continue
            stack.append(tag)
            out.append("<" + _signature(tag, m[3]))
    close()
    out += ["/" + t for t in reversed(stack)]
    return out, texts, links


def fold(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Folds repeats; the folded tokens and, for each slot of tokens, its slot in the fold."""
    items: list[tuple[str, list[int]]] = []
    slot = 0
    for t in tokens:
        if t[0] == "#":
            if items and items[-1][0] == t:  # a slot stands for one or more
                items[-1][1].append(slot)
            else:
                items.append((t, [slot]))
            slot += 1
        else:
            items.append((t, []))
    for size in range(2, REPEAT + 1):
        k = 0
        while k + 2 * size <= len(items):
            if all(items[k + j][0] == items[k + size + j][0] for j in range(size)) and _balanced([x[0] for x in items[k : k + size]]):
                last = k + size
                while [x[0] for x in items[last : last + size]] == [x[0] for x in items[k : k + size]]:
                    for j in range(size):
                        items[k + j][1].extend(items[last + j][1])
                    last += size
                items[k:last] = [("(", []), *items[k : k + size], (")+", [])]
                k += size + 2
            else:
                k += 1
    home, number = [0] * slot, 0
    for key, slots in items:
        if key[0] == "#":
            for s in slots:
                home[s] = number
            number += 1
    return [x[0] for x in items], home


def _balanced(tokens: list[str]) -> bool:
    depth = 0
    for t in tokens:
        depth += t[0] == "<" or t == "("
        depth -= t[0] == "/" or t == ")+"
        if depth < 0:
            return False
    return depth == 0


def _with_page(tokens: list[str], chars: list[int]) -> list[str]:
    """Tokens where a container around most of a page's article text has ``PAGE`` as a word: it is the page and no box, whatever its name."""
    if not any(_rules(t) for t in tokens if t[0] == "<"):
        return tokens
    slots, homes = slots_of(tokens), paths_of(tokens)
    held: dict[int, int] = {}
    whole = 0
    for (_, path), home, n in zip(slots, homes, chars, strict=True):
        outer = next((k for k, t in enumerate(path) if t[1:].split(".")[0] in MAIN_TAGS), None)
        if outer is not None:
            whole += n
            for place in home[:outer]:
                held[place] = held.get(place, 0) + n
    return [f"{t}.{PAGE}" if 2 * held.get(k, 0) >= whole > 0 and _rules(t) else t for k, t in enumerate(tokens)]


def read_page(html: str | None) -> Page:
    """The folded stream and blocks of a page."""
    tokens, texts, links = tokens_of(html or "")
    folded, home = fold(_with_page(tokens, [len(t) for t in texts]))
    return Page(" ".join(folded), list(zip(home, texts, links, strict=True)))


MARKS = ("(", ")+", "[", "]?")


def align(wrapper: list[str], shape: list[str]) -> list[str]:
    """The smallest wrapper by this method that covers both streams."""
    a, b = [t for t in wrapper], [t for t in shape]
    if a == b:
        return a
    out: list[str] = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += a[i:j]
            continue
        left, right = _bare(a[i:j]), _bare(b[k:m])
        if left and left == right:  # one or both sides repeat it
            out += ["(", *left, ")+"]
            continue
        for part, whole in ((a[i:j], left), (b[k:m], right)):
            if not whole:
                continue
            if out[-len(whole) :] == whole and _balanced(whole):  # a repeat of what stands before it
                out[-len(whole) :] = ["(", *whole, ")+"]
            elif _balanced(part) and _balanced(whole):
                out += part if part[0] == "[" and part[-1] == "]?" else ["[", *part, "]?"]
            else:
                out += part
    return out


def _bare(tokens: list[str]) -> list[str]:
    return [t for t in tokens if t not in MARKS]


@lru_cache(100_000)
def _dropped(token: str) -> bool:
    """Whether a container is none of the text by its tag or name; an article is text whatever its words, unless it is a reader's comment."""
    tag, *words = token[1:].split(".")
    if tag in MAIN_TAGS:
        return tag == "article" and any(w in COMMENT_WORDS for w in words)
    return PAGE not in words and (tag in DROPPED or any(map(_box, words)))


def _heads(token: str) -> bool:
    """Whether nothing but its being a header speaks against a container."""
    tag, *words = token[1:].split(".")
    return all(p not in DROPPED_WORDS or p == "header" for w in words if _box(w) for p in [w, *_parts(w)]) and (tag == "header" or tag not in DROPPED)


@lru_cache(100_000)
def _main(token: str) -> bool:
    tag, *words = token[1:].split(".")
    return tag in MAIN_TAGS or any(w in MAIN_WORDS for w in words)


def slots_of(tokens: list[str]) -> list[tuple[str, list[str]]]:
    """Each slot with the containers around it."""
    stack: list[str] = []
    out = []
    for t in tokens:
        if t[0] == "<":
            stack.append(t)
        elif t[0] == "/" and stack:
            stack.pop()
        elif t[0] == "#":
            out.append((t, list(stack)))
    return out


@dataclass
class Use:
    """What the different pages of a host have in a wrapper slot."""

    blocks: int = 0
    texts: int = 0
    chars: int = 0
    again: int = 0
    linked: int = 0

    def constant(self, times: int = 2, share: float = 0.8) -> bool:
        """Whether its texts come back, each ``times`` times on average and ``share`` of their characters."""
        return self.texts * times <= self.blocks and self.again >= share * self.chars


def label(tokens: list[str], uses: list[Use], by_name: bool = True) -> list[bool]:
    """Which slots of a wrapper are content; by_name: main containers, if there are any, hold it all."""
    slots, homes = slots_of(tokens), paths_of(tokens)
    kept = _kept(slots, uses)
    inside = [k and any(_main(t) for t in path) for k, (_, path) in zip(kept, slots, strict=True)]
    if by_name and any(inside):
        return _without_boxes(slots, homes, uses, inside)
    live = [k and not u.constant() and 2 * u.linked <= u.chars for k, u in zip(kept, uses, strict=True)]
    if not any(live):
        return kept
    # A constant amid varying texts of its own container belongs to them, as does a heading before them.
    out = list(live)
    for k, (name, _) in enumerate(slots):
        if kept[k] and not live[k] and 2 * uses[k].linked <= uses[k].chars:
            beside = [j for j in range(len(slots)) if live[j] and homes[j] == homes[k]]
            out[k] = bool(beside) and beside[-1] > k and (name == "#h" or beside[0] < k)
    return out


def _kept(slots: list[tuple[str, list[str]]], uses: list[Use]) -> list[bool]:
    """Which slots no container around them rules out.

    A box's name rules out all in it; words that merely speak of boxes rule out what is
    mostly links or the same on page after page.
    """
    out = []
    for (_, path), use in zip(slots, uses, strict=True):
        inner = max([0, *[k + 1 for k, t in enumerate(path) if t[1:].split(".")[0] in MAIN_TAGS]])
        # The header of an article belongs to it; the header of a page doesn't.
        boxed = any(_dropped(t) and not (k >= inner > 0 and _heads(t)) for k, t in enumerate(path))
        stale = (use.blocks > 0 and use.constant()) or 2 * use.linked > use.chars
        out.append(not boxed and not (stale and any(map(_hints, path))))
    return out


def paths_of(tokens: list[str]) -> list[tuple[int, ...]]:
    """For each slot the places of the containers around it in the stream."""
    stack: list[int] = []
    out = []
    for k, t in enumerate(tokens):
        if t[0] == "<":
            stack.append(k)
        elif t[0] == "/" and stack:
            stack.pop()
        elif t[0] == "#":
            out.append(tuple(stack))
    return out


def _without_boxes(slots: list[tuple[str, list[str]]], homes: list[tuple[int, ...]], uses: list[Use], inside: list[bool]) -> list[bool]:
    """Main slots but for boxes: containers within main ones that hold the same texts on page after page.

    A box holds no heading and less text than varies beside it, so that copied articles stay.
    """
    varying = sum(u.chars for u, i in zip(uses, inside, strict=True) if i and not u.constant(4, 0.95))
    boxes: dict[tuple[int, ...], list[int]] = {}
    for k, (_, path) in enumerate(slots):
        first = next((d for d, t in enumerate(path) if _main(t)), len(path))
        for d in range(first + 2, len(path) + 1):
            boxes.setdefault(homes[k][:d], []).append(k)
    out = list(inside)
    for own in boxes.values():
        if all(uses[k].constant(4, 0.95) and uses[k].blocks and slots[k][0] != "#h" for k in own) and sum(uses[k].chars for k in own) < varying:
            for k in own:
                out[k] = False
    return out


def label_alone(tokens: list[str], chars: list[int], linked: list[int]) -> list[bool]:
    """Which slots of a stream are content, by itself: without a main container, those of the innermost one with nine tenths of the text."""
    uses = [Use(1, 1, c, 0, l) for c, l in zip(chars, linked, strict=True)]
    out = label(tokens, uses)
    slots, homes = slots_of(tokens), paths_of(tokens)
    if any(o and any(_main(t) for t in path) for o, (_, path) in zip(out, slots, strict=True)):
        return out
    weight: dict[tuple[int, ...], int] = {}
    for k, path in enumerate(homes):
        if out[k]:
            for d in range(len(path) + 1):
                weight[path[:d]] = weight.get(path[:d], 0) + chars[k]
    if not weight:
        return out
    most = max(weight.values())
    root = max((p for p, w in weight.items() if 10 * w >= 9 * most), key=len)
    return [o and path[: len(root)] == root for o, path in zip(out, homes, strict=True)]


def places_in(wrapper: list[str], shape: list[str]) -> list[int]:
    """The wrapper slot of each slot of a stream, -1 where it has none, or none in like articles and boxes."""
    number = {k: n for n, k in enumerate(k for k, t in enumerate(wrapper) if t[0] == "#")}
    mine = {k: n for n, k in enumerate(k for k, t in enumerate(shape) if t[0] == "#")}
    out = [-1] * len(mine)
    for block in SequenceMatcher(None, wrapper, shape, autojunk=False).get_matching_blocks():
        for d in range(block.size):
            if block.b + d in mine:
                out[mine[block.b + d]] = number[block.a + d]
    theirs = _named_paths(wrapper)
    return [p if p < 0 or theirs[p] == own else -1 for p, own in zip(out, _named_paths(shape), strict=True)]


def _named_paths(tokens: list[str]) -> list[str]:
    """For each slot the containers around it that have a say by their names."""
    stack = [""]
    out = []
    for t in tokens:
        if t[0] == "<":
            stack.append(f"{stack[-1]} {t}" if _rules(t) or _main(t) else stack[-1])
        elif t[0] == "/" and len(stack) > 1:
            stack.pop()
        elif t[0] == "#":
            out.append(stack[-1])
    return out


def _shape_key(shape: str) -> int:
    return int.from_bytes(blake2b(shape.encode(), digest_size=8).digest(), "little", signed=True)


def _tokens(joined: str | None) -> list[str]:
    return joined.split(" ") if joined else []


def marks_alone(page: Page) -> str:
    """0 or 1 for each slot of a page, by the page itself."""
    tokens = _tokens(page.shape)
    chars, linked = [0] * sum(t[0] == "#" for t in tokens), [0] * sum(t[0] == "#" for t in tokens)
    for slot, text, n in page.blocks:
        chars[slot] += len(text)
        linked[slot] += n
    return "".join("01"[x] for x in label_alone(tokens, chars, linked))


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, shape_key, shape, slots, texts, linked, alone) of each page; alone labels its slots by itself."""
    schema = "page_id long, url string, host string, shape_key long, shape string, slots array<int>, texts array<string>, linked array<int>, alone string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                urls = part.column(1).to_pylist()
                read = [read_page(h) for h in part.column(2).to_pylist()]
                lists = [pa.array([[b[k] for b in p.blocks] for p in read], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.string(), pa.int32()))]
                cols = [part.column(0), pa.array(urls, pa.string()), pa.array([host_of(u) for u in urls], pa.string()), pa.array([_shape_key(p.shape) for p in read], pa.int64()), pa.array([p.shape for p in read], pa.string()), *lists, pa.array([marks_alone(p) for p in read], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def host_wrappers(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (host, shape_key, named, places): whether a page shape has a main container, the wrapper slot of each of its slots."""
    shapes = read.groupBy("host", "shape_key").agg(F.first("shape").alias("shape"), F.count("*").alias("pages"))
    sizes = shapes.groupBy("host").agg(F.count("*").alias("n")).withColumnRenamed("host", "h")
    part = F.pmod(F.col("shape_key"), F.greatest(F.lit(1), F.ceil(F.col("n") / SHAPES))).cast("long")
    counted = stored(shapes.join(sizes, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("part", part), "shapes")

    def union(streams: pd.Series) -> str:
        wrapper: list[str] = []
        for stream in streams:
            wrapper = align(wrapper, _tokens(stream)) if wrapper and stream else _tokens(stream) or wrapper
        return " ".join(wrapper)

    def infer(frame: pd.DataFrame) -> pd.DataFrame:
        own = union(frame.sort_values(["pages", "shape_key"], ascending=False)["shape"])
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [own], "pages": [int(frame["pages"].sum())]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [union(frame.sort_values(["pages", "wrapper"], ascending=False)["wrapper"])]})

    parts = counted.groupBy("host", "part").applyInPandas(infer, "host string, wrapper string, pages long")
    wrappers = stored(parts.groupBy("host").applyInPandas(meet, "host string, wrapper string"), "wrappers")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_tokens(r["wrapper"]), _tokens(r["shape"])) for r in batch.select(["wrapper", "shape"]).to_pylist()]
            named = pa.array([any(t[0] == "<" and _main(t) for t in shape) for _, shape in rows], pa.bool_())
            places = pa.array([places_in(wrapper, shape) for wrapper, shape in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape_key"), named, places], ["host", "shape_key", "named", "places"])

    both = counted.join(wrappers.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).select("host", "shape_key", "shape", "wrapper")
    return wrappers, stored(both.mapInArrow(place, "host string, shape_key long, named boolean, places array<int>"), "places")


def slot_uses(read: DataFrame, places: DataFrame) -> DataFrame:
    """(host, slot, blocks, texts, chars, again, linked) of each wrapper slot over the different pages of a host."""
    hashes = F.transform("texts", lambda t: F.xxhash64(t))
    slim = read.select("host", "shape_key", "slots", hashes.alias("hashes"), F.transform("texts", F.length).alias("sizes"), "linked")
    # Copies of a page say nothing about what its host repeats.
    once = slim.dropDuplicates(["host", "shape_key", "slots", "hashes"])
    at = places.withColumnRenamed("host", "h").withColumnRenamed("shape_key", "k")
    placed = once.join(at, F.col("host").eqNullSafe(F.col("h")) & (F.col("shape_key") == F.col("k")))
    block = F.explode(F.arrays_zip(F.transform("slots", lambda s: F.element_at("places", s + 1)).alias("slot"), F.col("hashes").alias("hash"), F.col("sizes").alias("size"), "linked"))
    blocks = placed.select("host", block.alias("b")).select("host", "b.*").where("slot >= 0")
    texts = blocks.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.sum("linked").alias("linked"))
    return texts.groupBy("host", "slot").agg(F.sum("n").alias("blocks"), F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("n") > 1, F.col("chars")).otherwise(0)).alias("again"), F.sum("linked").alias("linked"))


def host_labels(wrappers: DataFrame, uses: DataFrame) -> DataFrame:
    """(h, labels, loose): a mark for each slot of a host's wrapper, with and without a say of its main containers."""
    per_host = uses.groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("slot", "blocks", "texts", "chars", "again", "linked")).alias("uses"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[str], list[str]] = ([], [])
            for r in batch.select(["wrapper", "uses"]).to_pylist():
                tokens = _tokens(r["wrapper"])
                own = [Use() for t in tokens if t[0] == "#"]
                for u in r["uses"]:
                    slot = u.pop("slot")
                    own[slot] = Use(**u)
                for labels, by_name in zip(out, (True, False), strict=True):
                    labels.append("".join("01"[x] for x in label(tokens, own, by_name)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), *[pa.array(x, pa.string()) for x in out]], ["h", "labels", "loose"])

    return wrappers.join(per_host, F.col("host").eqNullSafe(F.col("h"))).select("host", "wrapper", "uses").mapInArrow(mark, "h string, labels string, loose string")


def page_labels(read: DataFrame) -> DataFrame:
    """(h, k, marks): for each slot of each page shape of each host 0, 1, or ? where the page alone decides."""
    wrappers, places = host_wrappers(read)
    digest = F.xxhash64("shape_key", "slots", F.transform("texts", lambda t: F.xxhash64(t)))
    several = read.groupBy("host").agg((F.min(digest) != F.max(digest)).alias("several")).where("several").select("host")
    by_host = host_labels(wrappers, slot_uses(read, places))
    known = by_host.join(several, F.col("h").eqNullSafe(F.col("host"))).drop("host")

    def marks(labels: str) -> F.Column:
        return F.array_join(F.transform("places", lambda p: F.when((p < 0) | F.col(labels).isNull(), "?").otherwise(F.substring(labels, p + 1, F.lit(1)))), "")

    # A page without a main container, none of whose text has its place in one, is of another kind.
    own = F.when(F.col("named") | marks("labels").contains("1"), marks("labels")).otherwise(marks("loose"))
    return places.join(known, F.col("host").eqNullSafe(F.col("h")), "left").select(F.col("host").alias("h"), F.col("shape_key").alias("k"), own.alias("marks"))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page."""
    read = stored(read_pages(pages), "pages")
    joined = read.join(stored(page_labels(read), "labels"), F.col("host").eqNullSafe(F.col("h")) & (F.col("shape_key") == F.col("k")), "left")

    def of(labels: str, k: F.Column) -> F.Column:
        return F.substring(labels, F.element_at("slots", k + 1) + 1, F.lit(1))

    kept = F.filter("texts", lambda t, k: (of("marks", k) == "1") | ((of("marks", k) == "?") & (of("alone", k) == "1")))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
