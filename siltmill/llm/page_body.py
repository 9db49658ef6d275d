"""Problem 5: the main text of a web page, without the site's furniture.

Two passes over the lines (the blocks of a text page). The first classifies a line by its length, its density of stop
words and its density of links. A text page has no markup, but its links show in the corpus: link texts and set phrases
of a site come back from page to page as whole lines, or between separators, and their words hardly stand in running
text. So the links are counted first, over all pages: the labels that recur (`recurring_labels`), and for the words in
them on how many pages they stand in labels and on how many elsewhere (`label_use`). No list of phrases is used. Labels are
known by hash and as many are kept as recur, whatever the number of pages.

Of the lines, dense in links are the site's; long ones, sentences with stop words, list entries and table rows are main
text; what is left is short or recurs and is ambiguous. In the second pass these inherit from the nearest decided lines:
between the end of the text and the footer, after a heading of links, or among lines of the site they are the site's,
elsewhere they are titles and remarks of the page's own.

Results: line numbers count from 0 after splitting at line feeds; blank lines are in neither class. Null and empty
texts have no lines of either and a main text of "". In a table whose labels do not recur (fewer than LEAST_PAGES pages
with one) only copyright lines and paging are found. Copies of a page count as pages.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .line_shape import COMMON_WORDS
from .text_batch import TextBlock, blocks, span_hashes

#: Most characters of a label and of one between separators.
LABEL, PART = 400, 50
#: Most words of a label with names left open.
TEMPLATE_WORDS = 24
#: Pages on which a label stands at least, in a table of any size.
LEAST_PAGES = 4
#: Share of labels among the pages of a label's words (geometric mean), from which it is a link; the second for labels dense in stop words, as titles are.
LINK_SHARE, DENSE_LINK_SHARE = 0.35, 0.55
#: Density of links from which a line is the site's.
LINK_DENSITY = 0.55
#: Density of stop words and number of words of running text; the number of words from which a line without links is.
STOP_DENSITY, TEXT_WORDS, LONG_WORDS = 0.25, 4, 15
#: Most characters of a title.
TITLE = 80
#: Lines whose class a worker remembers.
MEMORY = 200_000

MAIN, SITE, HEADING, OPEN, BLANK, SENTENCE, TEMPLATE = range(7)

_COMMON = frozenset(COMMON_WORDS)
_MARK = re.compile(r"(?:[*+•·–—»›>-]|\d+\.)\s+")
_SEPARATOR = re.compile(r"[|·•/›»→\[\]\t]| [-–—>]+ |  ")
_MARKS = frozenset("*+•·–—»›>-0123456789")
_DIGITS = frozenset("0123456789")
_LATER_NAME = re.compile(r" [A-ZÀ-Þ]")
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NAMES = re.compile(r"(?<!\w)[A-ZÀ-Þ]\w*(?: [A-ZÀ-Þ]\w*)*")
_ENDS = frozenset(".!?…:;。！？\"'”’»)]*_")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]*_]*$")
_PAIR = re.compile(r"[^:]{1,40}: \S{1,12}")
_ENTRY = re.compile(r"\(\d[^()]*\)$|\d%?$")
_COPYRIGHT = re.compile(r"^\W*©|© ?\d{4}|^(?:copyright|\(c\)) \W*\d{4}", re.I)
_PAGING = re.compile(r"[<>«»‹›←→…]|\.\.\.")
_CELLS = re.compile(r"\|.*\||\t.*\t|;.*;|^[-:| ]+$")


def bare_line(line: str) -> str:
    """The line without its list mark and outer blanks, numbers as 0."""
    text = line.strip()
    if text and text[0] in _MARKS and (marked := _MARK.match(text)):
        text = text[marked.end() :]
    return text if _DIGITS.isdisjoint(text) else _NUMBER.sub("0", text)


def segments(bare: str) -> list[str]:
    """What stands between separators."""
    if _SEPARATOR.search(bare) is None:
        return [bare]
    return [x for x in map(str.strip, _SEPARATOR.split(bare)) if x]


def is_titled(text: str) -> bool:
    """Whether the line reads like a title: short, no end mark, a capital or a script without capitals first."""
    if not text or len(text) > TITLE or not text[0].isalpha() or text[0].islower() or text[-1] in _ENDS and _END.search(text):
        return False
    return "|" not in text and "\t" not in text and not _PAIR.fullmatch(text)


def line_labels(line: str) -> tuple[str, list[str], list[str]]:
    """The bare line, what stands between its separators if it has any, and itself with names left open; "" for lines too long for a label."""
    if not 1 < len(line) <= LABEL + 100:
        return "", [], []
    bare = bare_line(line)
    if not 1 < len(bare) <= LABEL:
        return "", [], []
    parts = segments(bare)
    return bare, parts if len(parts) > 1 else [], templates(bare)


def labels_of(line: str) -> list[str]:
    """The labels a line may be or hold. None begins with a small letter."""
    bare, parts, opened = line_labels(line)
    out = [bare] if bare and not bare[0].islower() else []
    if parts:
        out += [x for x in parts if 1 < len(x) <= PART and not x[0].islower()]
    return out + opened if opened else out


def templates(bare: str) -> list[str]:
    """The line with its runs of capitalised words left open, with and without the first. Only of lines with such a word after the first."""
    if bare[0].islower() or bare.count(" ") >= TEMPLATE_WORDS or _LATER_NAME.search(bare) is None:
        return []
    first, _, rest = bare.partition(" ")
    rest = _NAMES.sub("_", rest)
    later = f"{first} {rest}"
    # a capitalised first word is one run with those behind it
    every = ("_" + rest[1:] if rest[0] == "_" else f"_ {rest}") if rest and first.isalnum() and first[0].isupper() else later
    return [x for x in ((later, every) if later != every else (later,)) if x != bare and len(x) >= 8]


def label_hash(label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass")) - (1 << 63)


class Labels:
    """A set of labels as sorted hashes: eight bytes for each."""

    def __init__(self, hashes: Iterable[int] | np.ndarray):
        self.hashes = array("q")
        self.hashes.frombytes(np.unique(hashes if isinstance(hashes, np.ndarray) else np.array(list(hashes), np.int64)).astype(np.int64).tobytes())

    def __len__(self) -> int:
        return len(self.hashes)

    def __contains__(self, label: str) -> bool:
        wanted = label_hash(label)
        at = bisect_left(self.hashes, wanted)
        return at < len(self.hashes) and self.hashes[at] == wanted

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Labels) and self.hashes == other.hashes


class Sums:
    """Numbers by hash, added up by array arithmetic."""

    def __init__(self, columns: int):
        self.keys, self.parts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros((0, columns), np.int64)], 0

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.keys.append(keys)
        self.parts.append(numbers)
        self.waiting += len(keys)
        if self.waiting > 2_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        parts = np.concatenate(self.parts)
        numbers = np.stack([np.bincount(where, parts[:, i], len(keys)) for i in range(parts.shape[1])], 1).astype(np.int64)
        self.keys, self.parts, self.waiting = [keys], [numbers], 0
        return keys, numbers


def label_counts(df: DataFrame, text: str) -> DataFrame:
    """label (a hash) and pages: on how many pages each stands.

    Labels are summed by task before they are shuffled; of a label that many pages have, a task sends one row.
    """

    def sent(counts: Counter) -> Iterator[pa.RecordBatch]:
        rows, pages = list(counts), list(counts.values())
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 100_000], pa.int64()), pa.array(pages[i : i + 100_000], pa.int64())], ["label", "pages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts.update({label_hash(x) for line in (page or "").split("\n") for x in labels_of(line)})
                if len(counts) > 500_000:
                    yield from sent(counts)
                    counts = Counter()
        yield from sent(counts)

    found = df.select(df[text].alias("text")).mapInArrow(run, "label bigint, pages bigint")
    return found.groupBy("label").agg(F.sum("pages").alias("pages"))


def hashes_of(df: DataFrame, column: str) -> np.ndarray:
    """A column of hashes on the driver, in no order."""
    return df.select(column).toArrow().column(0).to_numpy()


def recurring_labels(df: DataFrame, text: str) -> Labels:
    """All labels on at least LEAST_PAGES pages."""
    return Labels(hashes_of(label_counts(df, text).where(F.col("pages") >= LEAST_PAGES), "label"))


def cased_hashes(block: TextBlock) -> np.ndarray:
    return span_hashes(block.codes, block.word_start, block.word_end)


def label_words(labels: list[str]) -> Iterator[tuple[list[int], int]]:
    """For each label the hashes of its words, stop words and numbers left out, and how many stop words it has."""
    block = TextBlock(labels or [""])
    hashes = cased_hashes(block).astype(np.int64).tolist()
    first = np.searchsorted(block.word_text, np.arange(len(block) + 1)).tolist()
    for i in range(len(labels)):
        found, stops = [], 0
        for k in range(first[i], first[i + 1]):
            word = "".join(map(chr, block.low[block.word_start[k] : block.word_end[k]].tolist()))
            if word in _COMMON or not word[0].isalpha():
                stops += word in _COMMON
            else:
                found.append(hashes[k])
        yield found, stops


def use_counts(texts: list[str], known: Labels, words: Sums, alone: dict[str, list[int]]) -> None:
    """Adds to words the pages with a word outside and inside of labels, and to alone, for each label met, the lines it has to itself and those of them that two titles follow."""
    block = TextBlock(texts)
    kinds = []
    for page in texts:
        lines = page.split("\n")
        own, bares = [], []
        for line in lines:
            bare, parts, opened = line_labels(line)
            bares.append(bare)
            if not bare:
                own.append(0 if line.strip() else -1)
                continue
            labels = [x for x in parts if x in known]
            made_of = bool(parts) and len(labels) == len(parts)
            templated = [x for x in opened if x in known]
            alone_here = bare in known
            for x in (*labels, *templated, *([bare] if alone_here else ())):
                if x not in alone:
                    alone[x] = [0, 0]
            own.append(2 if alone_here else 1 if made_of or templated else 0)
        kinds += own
        if 2 not in own:
            continue
        filled = [i for i, k in enumerate(own) if k >= 0]
        title = lambda i: is_titled(bare := bare_line(lines[i])) and bare.count(" ") >= 2  # noqa: E731, B023
        for j, i in enumerate(filled):
            if own[i] == 2:
                count = alone[bares[i]]
                count[0] += 1
                count[1] += len(filled) > j + 2 and title(filled[j + 1]) and title(filled[j + 2])
    hashes = cased_hashes(block)
    inside = np.array(kinds, np.int8)[block.word_line] > 0
    # one of each word, text and place
    where = block.word_text.astype(np.uint64) * np.uint64(2) + inside
    _, once = np.unique(hashes ^ (where * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    words.add(hashes[once], np.stack((~inside[once], inside[once]), 1).astype(np.int64))


def label_use(df: DataFrame, text: str, labels: Labels) -> DataFrame:
    """use_counts over all texts: a row for each word that stands in labels (word, outside, inside) and for each label (label, words, stops, lines, heads)."""
    sent = df.sparkSession.sparkContext.broadcast(labels)
    columns = {"word": pa.int64(), "outside": pa.int64(), "inside": pa.int64(), "label": pa.int64(), "words": pa.list_(pa.int64()), "stops": pa.int32(), "lines": pa.int64(), "heads": pa.int64()}

    def batches_of(n: int, **given) -> Iterator[pa.RecordBatch]:
        for i in range(0, n, 100_000):
            part = min(100_000, n - i)
            yield pa.RecordBatch.from_arrays([pa.array(given[c][i : i + part], k) if c in given else pa.nulls(part, k) for c, k in columns.items()], list(columns))

    def rows(words: Sums, alone: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        keys, numbers = words.merge()
        yield from batches_of(len(keys), word=keys.astype(np.int64), outside=numbers[:, 0], inside=numbers[:, 1])
        described = list(label_words(list(alone)))
        yield from batches_of(len(alone), label=[label_hash(x) for x in alone], words=[w for w, _ in described], stops=[n for _, n in described], lines=[a for a, _ in alone.values()], heads=[b for _, b in alone.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alone = Sums(2), {}
        for batch in batches:
            for _, part in blocks(batch.column(0).to_pylist()):
                use_counts(part, sent.value, words, alone)
                if len(alone) > 200_000 or len(words.keys[0]) > 1_000_000:
                    yield from rows(words, alone)
                    words, alone = Sums(2), {}
        yield from rows(words, alone)

    found = df.select(df[text].alias("text")).mapInArrow(run, "word bigint, outside bigint, inside bigint, label bigint, words array<bigint>, stops int, lines bigint, heads bigint")
    summed = found.groupBy("word", "label").agg(*(F.sum(c).alias(c) for c in ("outside", "inside", "lines", "heads")), *(F.max(c).alias(c) for c in ("words", "stops")))
    return durable(summed.where("label IS NOT NULL OR inside > 0"))


@dataclass
class Links:
    """Labels that are links, those of them that head other links, and all that recur."""

    links: Labels
    headings: Labels
    recurring: Labels

    def density(self, bare: str, parts: list[str]) -> float:
        """Share of the line's characters in links."""
        if bare in self.links:
            return 1.0
        if parts:
            return sum(len(x) for x in parts if x in self.links) / sum(map(len, parts))
        # links with only blanks between them: the longest first
        words = bare.split()
        if not 2 <= len(words) <= 16 or bare[0].islower():
            return 0.0
        held = at = 0
        while at < len(words):
            for n in (3, 2, 1):
                if at + n <= len(words) and not words[at][0].islower() and (x := " ".join(words[at : at + n])) in self.links:
                    held += len(x)
                    at += n
                    break
            else:
                at += 1
        return held / len(bare)


def least_share(stops: int, words: int) -> float:
    """The share of labels among the pages of a label's words from which it is a link, less what rounding may take."""
    return (DENSE_LINK_SHARE if stops >= STOP_DENSITY * (stops + words) else LINK_SHARE) - 1e-9


def corpus_links(df: DataFrame, text: str) -> Links:
    """The links of all pages, the labels whose words stand in labels more than elsewhere: two passes over the texts, of which only hashes and counts are shuffled and only hashes come back."""
    labels = recurring_labels(df, text)
    if not len(labels):
        return Links(labels, labels, labels)
    used = label_use(df, text, labels)
    words = used.where("word IS NOT NULL").select("word", (F.col("inside") / F.greatest(F.col("inside") + F.col("outside"), F.lit(1))).alias("share"))
    shares = used.where("label IS NOT NULL").select("label", "stops", "lines", "heads", F.explode("words").alias("word")).join(words, "word", "left")
    share = F.coalesce("share", F.lit(0.0))
    judged = shares.groupBy("label", "stops", "lines", "heads").agg(F.count("*").alias("words"), F.min(share).alias("least"), F.exp(F.avg(F.log("share"))).alias("mean"))
    dense = F.col("stops") >= STOP_DENSITY * (F.col("stops") + F.col("words"))
    links = judged.where((F.col("least") > 0) & (F.col("mean") >= F.when(dense, least_share(1, 0)).otherwise(least_share(0, 1))))
    found = links.select("label", (F.col("heads") * 2 >= F.col("lines")) & (F.col("lines") > 0)).toDF("label", "heading").toArrow()
    hashes, heading = found.column(0).to_numpy(), found.column(1).to_numpy().astype(bool)
    return Links(Labels(hashes), Labels(hashes[heading]), labels)


def sample_links(texts: list[str]) -> Links:
    """The links of some pages, without a session."""
    counts: Counter = Counter()
    for page in texts:
        counts.update({label_hash(x) for line in page.split("\n") for x in labels_of(line)})
    labels = Labels(x for x, n in counts.items() if n >= LEAST_PAGES)
    words, alone = Sums(2), {}
    for _, part in blocks(texts):
        use_counts(part, labels, words, alone)
    keys, numbers = words.merge()
    share = dict(zip(keys.astype(np.int64).tolist(), (numbers[:, 1] / np.maximum(numbers.sum(1), 1)).tolist()))
    links = set()
    for label, (used, stops) in zip(alone, label_words(list(alone))):
        if used and float(np.prod([share.get(w, 0) for w in used])) ** (1 / len(used)) >= least_share(stops, len(used)):
            links.add(label)
    return Links(Labels(map(label_hash, links)), Labels(label_hash(x) for x in links if alone[x][1] * 2 >= alone[x][0] > 0), labels)


def line_class(line: str, links: Links) -> int:
    """First pass: what the line alone says."""
    text = line.strip()
    if not text:
        return BLANK
    bare, parts, opened = line_labels(line)
    recurs = bool(bare) and bare in links.recurring
    template = any(x in links.links for x in opened)
    if ("©" in text or text[0] in "Cc(") and len(text) <= LABEL and _COPYRIGHT.search(text):
        return SITE
    if len(text) > TITLE and not (recurs or template or parts):
        return MAIN
    words = _WORD.findall(text)
    if not words:
        return SITE if _PAGING.search(text) and "|" not in text and len(_NUMBER.findall(text)) > 1 else MAIN
    ends = text[-1] in _ENDS and bool(_END.search(text))
    if ends and text[-1] != ":" and len(words) >= TEXT_WORDS and sum(w.lower() in _COMMON for w in words) >= STOP_DENSITY * len(words):
        return SENTENCE if recurs or template else MAIN
    if _PAIR.fullmatch(text):
        return MAIN
    if links.density(bare, parts) >= LINK_DENSITY:
        return HEADING if bare in links.headings else SITE
    if len(parts) == 2 and parts[1] in links.links:
        return SITE  # the site's name and a section
    if text[-1] == ":" or _ENTRY.search(text) or _CELLS.search(text) or all(w[0].isupper() for w in words):
        return MAIN
    if template:
        return TEMPLATE if len(words) < LONG_WORDS else SENTENCE
    return OPEN if is_titled(bare) and 2 <= len(words) < LONG_WORDS else MAIN


def remembered_class(line: str, links: Links, memory: dict[str, int]) -> int:
    """line_class, taken from the memory where the line was met before."""
    found = memory.get(line)
    if found is None:
        found = line_class(line, links)
        if len(line) <= LABEL:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[line] = found
    return found


def page_classes(lines: list[str], links: Links, memory: dict[str, int]) -> list[int]:
    """Class MAIN, SITE or BLANK of each line of a page."""
    out = [remembered_class(line, links, memory) for line in lines]
    filled = [i for i, k in enumerate(out) if k != BLANK]
    # a line that is said again and again is no list of links
    for a, b, c in zip(filled, filled[1:], filled[2:]):
        if lines[a] == lines[b] == lines[c]:
            out[a] = out[b] = out[c] = MAIN
    # sentences that recur are the site's where the nearest decided lines on both sides are, or the page begins or ends
    first = [out[i] for i in filled]
    ours = (SITE, HEADING)

    def is_link(line: str) -> bool:
        bare, _, opened = line_labels(line)
        return bare in links.links or any(x in links.links for x in opened)

    for j, i in enumerate(filled):
        if first[j] == SENTENCE:
            before = next((k for k in reversed(first[:j]) if k != SENTENCE), None)
            after = next((k for k in first[j + 1 :] if k != SENTENCE), None)
            near = (before in ours) + (after in ours)
            link = is_link(lines[i]) and before in (None, *ours)
            out[i] = SITE if near == 2 or near and None in (before, after) or before is None and after == OPEN or link else MAIN
    a = 0
    while a < len(filled):
        if out[filled[a]] not in (OPEN, HEADING, TEMPLATE):
            a += 1
            continue
        b = a
        while b < len(filled) and out[filled[b]] in (OPEN, HEADING, TEMPLATE):
            b += 1
        run = filled[a:b]
        kinds = [out[x] for x in run]
        before = out[filled[a - 1]] if a else None
        after = out[filled[b]] if b < len(filled) else None
        heading = next((i for i, k in enumerate(kinds) if k == HEADING), len(run))
        marked = any(_MARK.match(lines[x].strip()) for x in run)
        # a line of a wrapped paragraph goes on from a long one without an end
        last = lines[filled[a - 1]].rstrip() if a else ""
        wrapped = before == MAIN and not marked and heading == len(run) and len(last) >= 40 and not _END.search(last)
        for i, x in enumerate(run):
            if i >= heading:
                # The last of the links is the page's own title where the text follows at once and others stand above it.
                own = after == MAIN and i == len(run) - 1 and i > heading + 1 and not _MARK.match(lines[x].strip())
                out[x] = MAIN if own else SITE
            elif before == MAIN and (after == SITE or heading < len(run)):
                out[x] = MAIN if wrapped else SITE
            elif before == SITE and after == SITE:
                out[x] = SITE if len(run) > 1 or marked or kinds[i] == TEMPLATE else MAIN
            elif kinds[i] == TEMPLATE and (after is None or after == SITE) and not wrapped:
                out[x] = SITE
            else:
                out[x] = MAIN
        a = b
    return out


def _pages(batch: pa.RecordBatch, links: Links, memory: dict[str, int]) -> Iterator[tuple[int, list[str], list[int]]]:
    for i, text in enumerate(batch.column(1).to_pylist()):
        if text:
            lines = text.split("\n")
            yield i, lines, page_classes(lines, links, memory)


def site_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and line_no of every line that belongs to the site. The texts are not shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(corpus_links(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            rows, numbers = [], []
            for i, _, classes in _pages(batch, sent.value, memory):
                if SITE in classes:
                    found = [n for n, k in enumerate(classes) if k == SITE]
                    rows += [i] * len(found)
                    numbers += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())], ["key", "line_no"])

    schema = f"key {df.schema[key].dataType.simpleString()}, line_no int"
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def main_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, main_text (the lines that are not the site's, in order) and site_lines, of every row. The texts are not shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(corpus_links(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, part in blocks(texts):
                bodies, counts = [], []
                for body in part:
                    lines = body.split("\n")
                    classes = page_classes(lines, sent.value, memory)
                    bodies.append("\n".join(x for x, k in zip(lines, classes) if k != SITE).strip("\n"))
                    counts.append(classes.count(SITE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), pa.array(bodies, pa.string()), pa.array(counts, pa.int32())], ["key", "main_text", "site_lines"])

    schema = f"key {df.schema[key].dataType.simpleString()}, main_text string, site_lines int"
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
