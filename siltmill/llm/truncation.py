"""Problem 3: texts that lost their end.

Whole texts are cut artificially to get positives; hashed logistic regression on how a text closes (last characters and
words, punctuation, the last line against the one before, what is left open, length against the limit) tells the two
apart and scores every row. Some of the texts taken as whole are cut in fact: those the first fit finds are left out,
and the model is fitted again. The fit sees as many cut as whole texts, a table does not: from the part of the table
that was held out, the share of cut texts and the best threshold are estimated for each kind of end (running text,
entries, table rows, with and without punctuation). Every row is fitted on or held out, counted and scored: the rows are
dealt to shards of about SHARD by a hash, a shard's examples are fitted in one task, and the weights of all shards are
mixed (`mixing`). Words, links and thresholds are those of the whole table.

Results: null and blank texts have score 0 and are never cases, nor are texts that are mostly junk. White space at the
end does not count as an end. A table without one filled text that is not junk has score 0 throughout. A table of few
rows is fitted on those; kinds of end that are too rare to calibrate share a threshold, which is 0.5 where nothing is held out.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .line_shape import LineShape
from .mixing import SCHEMA, joined, mixed, parts_of
from .page_body import SITE, Links, corpus_links, label_hash, line_class, page_classes, remembered_class, sample_links
from .text_batch import TextBlock, blocks
from .text_quality import junk_texts

#: Rows that a shard has about; each row of the table is in one.
SHARD = 20_000
#: Hash buckets of features; features of one row.
BUCKETS, WIDTH = 1 << 18, 48
#: Share of the rows that are not fitted on, but calibrated; texts of a kind there from which it has its own threshold.
HELD_OUT, LEAST_OWN = 0.25, 150
#: Texts as which the threshold of all kinds, or of a broader kind, counts when one of its kinds gets its own.
PRIOR = 100
#: What broken transfers and field limits leave behind.
REMAINS = (" [...]", "[...]", "\ufffd", '<a href="/', "</", "&nbs", "&#", "\\u00", "…", "...")
#: Passes over the examples in each fit.
PASSES = 6

_ENDER = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*(?=\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
_RUNS = re.compile(r"(.)\1{2,}")
_ENTRY_MARK = re.compile(r"(?:[*+>•·–»-]|\d+[.)]|\[.?\])\s|\d+\.\d+ ")
_PAIR = re.compile(r"[^:]{1,40}: \S{1,12}")
_BROKEN = re.compile(r"&#?\w{0,7}$|\\u?[0-9a-f]{0,3}$|</?(?:\w[^<>]{0,20})?$|\ufffd$|[\[(](?:\.\.\.|…)[\])]$")
_NAME = re.compile(r"(?:[—–-]\s*)?[A-ZÀ-Þ][^\W\d_]+(?: [A-ZÀ-Þ][^\W\d_]+)?")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_NAMES = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DIGIT = re.compile(r"[0-9]")
_MARKS = (".", "!", "?", "…")
_OPENERS = {"(": ")", "[": "]", "“": "”", "„": "“", "«": "»", "{": "}"}


def _char_class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c


def _shape(token: str) -> str:
    """Classes of the characters, runs of three and more shortened."""
    out = "".join(_char_class(c) for c in token[-12:])
    return _RUNS.sub(r"\1\1+", out)


def digits_in(text: str) -> int:
    return sum(map(text.count, "0123456789")) if _DIGIT.search(text) else 0




def _line_kind(line: str) -> str:
    text = line.strip()
    if not text:
        return "none"
    if text.count("|") > 1 or text.count("\t") or text.count(";") > 1 or "   " in text:
        return "cells"
    if _ENTRY_MARK.match(text):
        return "entry"
    if _PAIR.fullmatch(text):
        return "pair"
    if text.startswith(("http:", "https:")):
        return "url"
    words = text.split()
    if len(words) <= 3:
        return "short"
    if len(text) > 75:
        return "long"
    digits = digits_in(text)
    if digits * 4 > len(text):
        return "cells"
    return "line"


def end_kind(text: str, whole: Whole | None = None) -> str:
    """Kind of the last line, and whether the text has sentences. whole: a text that begins with this one."""
    body = text.rstrip()
    begin = body.rfind("\n") + 1
    head = body[:begin].rstrip()
    ends = (len(_ENDER.findall(body)) if whole is None else bisect_left(whole.stops, len(body))) + (head[-1:] in _MARKS)
    return f"{_line_kind(body[begin:])}.{'s' if ends > 1 + body.count(chr(10)) // 4 else 'e' if ends else 'n'}"


def broad_kind(kind: str) -> str:
    """Running text or something else, with or without sentences."""
    line, _, run = kind.partition(".")
    return f"{'text' if line in ('long', 'line', 'short') else 'other'}.{run}"


class Whole:
    """What is looked up once in a text for all that begin as it does: where the sentences end that white space follows, where its words are, and how many of those before each are known."""

    def __init__(self, text: str, known: Words):
        self.text, self.known = text, known
        self.stops = [m.end() for m in _ENDER.finditer(text)]
        spans = [m.span() for m in _WORDS.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.met = [0, *accumulate(map(bool, map(known.memory.__getitem__, lowered(text, _WORDS))))]

    def near(self, size: int) -> tuple[int, int]:
        """Of the first `size` characters' last 400 the last 40 words without the very last: how many are known, and how many there are."""
        begin, last = max(size - 400, 0), bisect_right(self.starts, size - 2) - 1
        first = bisect_left(self.ends, begin + 2)
        if last - first >= 40:
            first = last - 39
        if last <= first:
            return 0, 0
        met = self.met[last] - self.met[first]
        if self.starts[first] < begin:
            # begun before the 400 characters
            a, b = self.starts[first], self.ends[first]
            met += (self.known.level(self.text[begin:b].lower()) > 0) - (self.known.level(self.text[a:b].lower()) > 0)
        return met, last - first


class _Levels(dict):
    """The levels of the words met last."""

    def __init__(self, words: Words):
        self.words = words

    def __missing__(self, word: str) -> int:
        wanted, of = label_hash(word), self.words
        at = bisect_left(of.hashes, wanted)
        found = of.levels[at] if at < len(of.hashes) and of.hashes[at] == wanted else 0
        if len(self) >= 200_000:
            self.clear()
        self[word] = found
        return found


class Words:
    """How often words occur, as the binary length of the number: nine bytes for each word that occurs twice or more."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.levels = array("q"), levels[order].astype(np.uint8).tobytes()
        self.hashes.frombytes(hashes[order].astype(np.int64).tobytes())

    @classmethod
    def of(cls, counts: Counter) -> Words:
        kept = [(label_hash(w), n.bit_length()) for w, n in counts.items() if n > 1]
        return cls(np.array([h for h, _ in kept], np.int64), np.array([n for _, n in kept], np.uint8))

    def __reduce__(self):
        return _words_of, (self.hashes.tobytes(), self.levels)

    @functools.cached_property
    def memory(self) -> _Levels:
        return _Levels(self)

    def level(self, word: str) -> int:
        return self.memory[word]


def _words_of(hashes: bytes, levels: bytes) -> Words:
    return Words(np.frombuffer(hashes, np.int64), np.frombuffer(levels, np.uint8))


def last_tokens(line: str) -> list[str]:
    """The last two tokens of a line, or fewer. Only the first two of a piece may differ from those of the line."""
    found = _WORD.findall(line[-40:])
    return (found if len(found) >= 4 or len(line) <= 40 else _WORD.findall(line[-160:]))[-2:]


def lowered(text: str, words: re.Pattern) -> list[str]:
    """The words of a text, each in lower case."""
    # of these letters the small ones hang on the neighbours, or are two
    return [w.lower() for w in words.findall(text)] if "İ" in text or "Σ" in text else words.findall(text.lower())


def features(text: str, limit_tokens: int | None, known: Words, links: Links, where: str, memory: dict[str, int], whole: Whole | None = None) -> list[str]:
    """What the end of the text says. where is its end_kind, memory that of page_classes, whole as in end_kind."""
    body = text.rstrip()
    begin = body.rfind("\n") + 1
    last = body[begin:]
    head = body[:begin].rstrip()
    before = head[head.rfind("\n") + 1 :]
    kind_before = _line_kind(before)
    # running text has sentence ends; a text without any is judged by its words
    kind, _, run = where.partition(".")
    tokens = last_tokens(last)
    word = tokens[-1] if tokens else ""
    pair = " ".join(tokens).lower()
    seen = known.level(word.lower()) if word[:1].isalpha() else -1
    site = memory.get(last)
    if site is None:
        site = line_class(last, links)
    site_before = remembered_class(before, links, memory)
    if whole is None:
        near = lowered(body[-400:], _WORDS)[-40:-1]
        met, of = len(near) - list(map(known.memory.__getitem__, near)).count(0), len(near)
    else:
        met, of = whole.near(len(body))
    met = met * 4 // max(of, 1)
    words = len(last.split())
    ended = last[-1:] in ".!?…"
    mark = _char_class(last[-1:])
    f = [
        "bias", f"w:{where}", f"k:{kind_before}>{kind}", f"c:{last[-1:]}|{where}", f"c0:{last[-1:]}", f"c2:{last[-2:]}|{run}", f"c3:{last[-3:].lower()}", f"c4:{last[-4:].lower()}", f"t:{word.lower()}", f"t:{word.lower()}|{where}", f"p:{pair}", f"p:{pair}|{run}",
        f"s:{_shape(word)}|{where}", f"n:{seen}|{where}", f"n:{seen}|{_char_class(word[:1])}|{kind}", f"e:{ended}|{run}", f"site:{site}", f"site:{site}|{site_before}|{run}", f"met:{met}|{run}", f"digits:{min(9, 10 * digits_in(last) // max(len(last), 1))}|{'=' in last}|{run}",
        f"m:{min(words, 12)}|{where}", f"tail:{text[len(body):][:2]!r}|{run}", f"rows:{min(body.count(chr(10)), 5)}|{kind}",
    ]
    if word[:1].isalpha():
        f.append(f"lower:{word[:1].islower()}|{where}|{seen > 1}")
    first, first_before = last.lstrip()[:1], before.lstrip()[:1]
    same = kind == kind_before
    if before:
        words_before = len(before.split())
        marks, marks_before = sum(map(last.count, ",;|\t:")), sum(map(before.count, ",;|\t:"))
        f += [
            f"d:{max(-4, min(4, words - words_before))}|{kind}|{same}", f"g:{max(-3, min(3, marks - marks_before))}|{kind}|{same}", f"h:{mark}{_char_class(before[-1:])}|{kind}|{same}", f"i:{_char_class(first)}{_char_class(first_before)}|{kind}",
            f"j:{before[-1:] in '.!?…'}{ended}|{kind}", f"l:{max(-4, min(4, (len(last) - len(before)) // 12))}|{kind}|{same}",
        ]
    for a, b in _OPENERS.items():
        if (at := last.rfind(a)) >= 0 and at > last.rfind(b):
            f.append(f"open:{a}")
    if last.count('"') % 2:
        f.append("open:quote")
    # an entity or escape without its end
    if _BROKEN.search(last[-40:]):
        f.append("broken")
    # since the last sentence end
    if whole is None:
        rest = _ENDER.split(last)[-1]
    else:
        at = bisect_left(whole.stops, len(body))
        rest = body[max(begin, whole.stops[at - 1]) :] if at else last
    f.append(f"r:{min(len(rest.split()), 8)}|{run}|{ended}")
    if limit_tokens and limit_tokens > 0:
        f.append(f"limit:{min(9, int(len(body) / 4.2 / limit_tokens * 8))}|{ended}")
    # sign-off or name alone on its line
    if _NAME.fullmatch(last.strip()):
        f.append(f"name:{min(words, 4)}|{seen > 0}|{before[-1:] in '.!?…'}")
    return f


_NOTHING = [[-1] * n for n in range(WIDTH + 1)]


def hashed(names: list[str]) -> list[int]:
    """A hash of each name, and -1 for those that are missing to WIDTH."""
    names = names[:WIDTH]
    parts = "\0".join(names).encode("utf-8", "surrogatepass").split(b"\0")
    if len(parts) != len(names):
        parts = [x.encode("utf-8", "surrogatepass") for x in names]
    return [*map(zlib.crc32, parts), *_NOTHING[WIDTH - len(names)]]


def bucketed(rows: list[list[int]]) -> np.ndarray:
    """The buckets of rows of hashes."""
    out = np.array(rows, np.int64).reshape(-1, WIDTH)
    return np.where(out < 0, BUCKETS, out & (BUCKETS - 1)).astype(np.int32)


@dataclass
class EndModel:
    """Weights by bucket (the last is the empty feature's), and how often words occur in the table."""

    weights: np.ndarray
    known: Words
    links: Links
    #: The score from which a text is a case, by end_kind or broad_kind; "" holds for kinds that are too rare for their own.
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})
    memory: dict[str, int] = field(default_factory=dict)

    def rows(self, texts: list[str], limits: list[int | None], kinds: list[str] | None = None) -> np.ndarray:
        kinds = list(map(end_kind, texts)) if kinds is None else kinds
        return bucketed([hashed(features(t, m, self.known, self.links, k, self.memory)) for t, m, k in zip(texts, limits, kinds)])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[rows].sum(1), -30, 30)))

    def threshold(self, kind: str) -> float:
        return self.thresholds.get(kind, self.thresholds.get(broad_kind(kind), self.thresholds[""]))


def is_ended(text: str) -> bool:
    """Whether an end mark, with closing marks or white space behind it, ends the text."""
    return text.rstrip().rstrip("\"'”’»)").endswith(_MARKS)


def artificial_cut(text: str, rng: np.random.Generator) -> str | None:
    """The text cut inside a word, sentence or entry; None where the place found is none of these."""
    body = text.rstrip()
    n = len(body)
    if n < 12:
        return None
    # half of the cuts near the end, where lists and last lines are
    at = int(rng.integers(max(2, n - 120), n)) if rng.random() < 0.5 else int(rng.integers(max(2, n // 5), n))
    cut = body[:at]
    if body[at - 1] == "\n" or body[at] == "\n" or not cut.strip() or is_ended(cut):
        return None
    return cut + REMAINS[int(rng.integers(len(REMAINS)))] if rng.random() < 0.1 else cut


def end_places(text: str, links: Links, memory: dict[str, int]) -> list[int]:
    """Where the sentences, entries, table rows and lines of the site of a text end, without its first fifth and its last end."""
    body = text.rstrip()
    least = len(body) // 5
    places = [m.end() for m in _ENDER.finditer(body, least)]
    at = 0
    lines = body.split("\n")
    for line, found in zip(lines, page_classes(lines, links, memory)):
        at += len(line) + 1
        if least < at <= len(body) and line.strip() and (found == SITE or _line_kind(line) in ("cells", "entry", "pair", "url")):
            places.append(at - 1)
    return places


def artificial_end(text: str, rng: np.random.Generator, links: Links, memory: dict[str, int] | None = None, places: list[int] | None = None) -> str | None:
    """The text up to the end of one of its sentences, entries, table rows or lines of the site; None where it has none but its last. places: its end_places, if they are known."""
    if places is None:
        places = end_places(text, links, {} if memory is None else memory)
    return text[: places[int(rng.integers(len(places)))]] if places else None


def unpunctuated(text: str, questions: bool = False) -> str:
    """The text as those who write without capitals and punctuation would have it; some of them keep question marks."""
    return re.sub(r"[^\w\s'’?-]|_" if questions else r"[^\w\s'’-]|_", "", text.lower())


def _fit(rows: np.ndarray, labels: np.ndarray, seed: int) -> np.ndarray:
    """Adaptive gradient descent on the log loss, with a small pull to zero."""
    weights, squares = np.zeros(BUCKETS + 1, np.float64), np.full(BUCKETS + 1, 1e-2)
    has, place = np.zeros(BUCKETS + 1, bool), np.zeros(BUCKETS + 1, np.int32)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            x = rows[part].astype(np.intp)
            error = 1 / (1 + np.exp(-np.clip(weights[x].sum(1), -30, 30))) - labels[part]
            # the distinct buckets in order, and the place of each among them
            has[x] = True
            used = np.flatnonzero(has)
            has[used] = False
            place[used] = np.arange(len(used))
            gradient = np.bincount(place[x].ravel(), np.repeat(error, x.shape[1]), minlength=len(used)) / len(part) + 2e-5 * weights[used]
            squares[used] += gradient**2
            weights[used] -= 0.15 * gradient / np.sqrt(squares[used])
            weights[BUCKETS] = 0
    return weights


#: Scores that may be a threshold.
GRID = np.arange(0.45, 0.96, 0.01)


def grid_counts(scores: np.ndarray) -> np.ndarray:
    """How many scores there are, and how many of them reach each of GRID."""
    places = np.bincount(np.searchsorted(GRID, scores, "right"), minlength=len(GRID) + 1)
    return np.cumsum(places[::-1])[::-1]


def best_threshold(natural: np.ndarray, cut: np.ndarray, whole: np.ndarray) -> float:
    """threshold_of the scores themselves."""
    return threshold_of(*map(grid_counts, (natural, cut, whole)))


def threshold_of(natural: np.ndarray, cut: np.ndarray, whole: np.ndarray) -> float:
    """The score from which a text is best taken for a cut one, from the grid_counts of texts as they are, of cut ones and of ones that end at a boundary.

    Where the last two differ most, they give the share of cut texts among the first, and with it the F1 of every threshold. Of nearly equal ones it is the middle.
    """
    found, held, false = (x[1:] / max(x[0], 1) for x in (natural, cut, whole))
    at = int(np.argmax(held - false))
    share = float(np.clip((found[at] - false[at]) / max(held[at] - false[at], 1e-9), 0.002, 0.9))
    f1 = 2 * share * held / (np.maximum(found, share * held) + share)
    best = np.flatnonzero(f1 >= f1.max() - 0.004)
    return float(GRID[best[len(best) // 2]])


#: What an example of the fit is: a text as it is, up to one of its ends, one of its cuts (a turn of the fit has its own), and of texts held out the same.
OWN, OWN_END, HELD, HELD_CUT, HELD_END, FIRST_CUT, TURNS = 0, 1, 2, 3, 4, 5, 3
#: A row without an example: blank or junk.
NONE = -1


@dataclass
class Examples:
    """Rows of hashed features with the text they are of, what they are, and their end_kind."""

    text: np.ndarray
    what: np.ndarray
    kind: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, made: list[tuple[int, int, str, list[int], int]]) -> Examples:
        made = sorted(made, key=lambda x: x[:2])
        column = lambda i, kind: np.array([x[i] for x in made], kind)
        return cls(column(0, np.int64), column(1, np.int64), column(2, object), bucketed([x[3] for x in made]))


def text_words(text: str) -> set[str]:
    """The words before the last one of a text."""
    body = text.rstrip()
    return {w.lower() for w in _NAMES.findall(body[: -len(body.split()[-1])])}


def examples_of(numbered: list[tuple[int, str, int | None]], known: Words, links: Links, seed: int, hold_out: bool, memory: dict[str, int] | None = None) -> list[tuple[int, int, str, list[int], int]]:
    """The examples of some texts (number, text, limit), each with the place of its text, which hang on nothing but the text, its number and the seed. Junk gives none."""
    out = []
    memory = {} if memory is None else memory

    def add(number: int, what: int, t: str, limit: int | None, whole: Whole) -> None:
        of = whole if whole.text.startswith(t) else None
        out.append((number, what, kind := end_kind(t, of), hashed(features(t, limit, known, links, kind, memory, of)), place))

    for begin, part in blocks([t for _, t, _ in numbered]):
        block = TextBlock(part)
        junk = junk_texts(block, LineShape(block))
        for place, ((i, text, limit), bad) in enumerate(zip(numbered[begin : begin + len(part)], junk), begin):
            if bad:
                continue
            rng = np.random.default_rng((seed, i))
            if hold_out and rng.random() < HELD_OUT:
                whole, places = Whole(text, known), end_places(text, links, memory)
                add(2 * i, HELD, text, limit, whole)
                for _ in range(2):
                    for what, made in ((HELD_CUT, artificial_cut(text, rng)), (HELD_END, artificial_end(text, rng, links, memory, places))):
                        if made is not None:
                            add(2 * i, what, made, limit, whole)
                continue
            own = [(2 * i, text)]
            # Texts without punctuation are too few to learn from; some of those with it stand in for them.
            if i % 3 == 0 and _ENDER.search(text) and text.rstrip().rstrip("\"'”’»)").endswith((".", "!", "?")):
                own.append((2 * i + 1, unpunctuated(text, questions=i % 2 == 0)))
            for number, t in own:
                whole = Whole(t, known)
                add(number, OWN, t, limit, whole)
                if (made := artificial_end(t, rng, links, memory)) is not None:
                    add(number, OWN_END, made, limit, whole)
                for turn in range(TURNS):
                    if (made := artificial_cut(t, rng)) is not None:
                        add(number, FIRST_CUT + turn, made, limit, whole)
    return out


def fit_weights(e: Examples, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The weights of the examples, and how many of the examples fitted on last have each bucket. None if there is none to learn from."""
    own = np.flatnonzero(e.what == OWN)
    if not len(own):
        return None
    ends = np.flatnonzero(e.what == OWN_END)
    model = EndModel(np.zeros(BUCKETS + 1, np.float32), None, None)
    for turn in range(TURNS):
        if turn:
            own = own[model.scores(e.rows[own]) < 0.5]
        cuts = np.flatnonzero((e.what == FIRST_CUT + turn) & np.isin(e.text, e.text[own]))
        used = e.rows[np.concatenate((own, ends, cuts))]
        labels = np.concatenate((np.zeros(len(own) + len(ends)), np.ones(len(cuts))))
        model.weights = _fit(used, labels, seed).astype(np.float32)
    return model.weights, np.bincount(used.ravel(), minlength=BUCKETS + 1)


def calibrated(counts: dict[tuple[str, int], np.ndarray], model: EndModel) -> EndModel:
    """The model with the thresholds that follow from the grid_counts of the examples held out, by end_kind and what they are."""
    for level in (lambda k: "", broad_kind, lambda k: k):
        of: dict[str, np.ndarray] = {}
        for (kind, what), n in counts.items():
            of.setdefault(level(kind), np.zeros((3, len(n)), np.int64))[what - HELD] += n
        for k in sorted(of):
            sizes = of[k][:, 0]
            if sizes[0] >= LEAST_OWN and sizes.min() >= LEAST_OWN // 4:
                # drawn to the threshold of the kinds it is one of, as by so many texts
                wider = model.threshold(k)
                model.thresholds[k] = float((sizes[0] * threshold_of(*of[k]) + PRIOR * wider) / (sizes[0] + PRIOR))
    return model


def held_counts(e: Examples, model: EndModel) -> dict[tuple[str, int], np.ndarray]:
    """The grid_counts of the examples held out."""
    held = np.flatnonzero((e.what >= HELD) & (e.what <= HELD_END))
    scores, what, kind = model.scores(e.rows[held]), e.what[held], e.kind[held]
    return {(k, int(w)): grid_counts(scores[(kind == k) & (what == w)]) for k in sorted(set(kind)) for w in sorted(set(what[kind == k]))}


def fit_ends(texts: list[str], limits: list[int | None], seed: int = 7) -> EndModel | None:
    """The model of some texts, most of them whole, without a session. None if no text has an end to learn from."""
    kept = [(i, t, m) for i, (t, m) in enumerate(zip(texts, limits)) if t and t.strip()]
    counts: Counter = Counter()
    for _, t, _ in kept:
        counts.update(text_words(t))
    known, links = Words.of(counts), sample_links([t for _, t, _ in kept])
    e = Examples.of(examples_of(kept, known, links, seed, len(kept) >= 2 / HELD_OUT))
    fitted = fit_weights(e, seed)
    if fitted is None:
        return None
    model = EndModel(fitted[0], known, links)
    return calibrated(held_counts(e, model), model)


def corpus_words(df: DataFrame, text: str) -> tuple[Words, int]:
    """The words of all texts, and how many texts are filled. Words are summed by task, and as hashes, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        filled = 0

        def sent() -> Iterator[pa.RecordBatch]:
            hashes, numbers = [None, *map(label_hash, counts)], [filled, *counts.values()]
            for i in range(0, len(hashes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 100_000], pa.int64()), pa.array(numbers[i : i + 100_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and t.strip():
                    filled += 1
                    counts.update(text_words(t))
            if len(counts) > 500_000:
                yield from sent()
                counts, filled = Counter(), 0
        yield from sent()

    found = df.select(df[text].alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # of a word the binary length of its number, of the texts the number
    level = F.when(F.col("word").isNull(), F.col("n")).otherwise(F.length(F.bin("n")))
    rows = found.where("word IS NULL OR n > 1").select("word", level.alias("level")).toArrow()
    words, levels = rows.column(0), rows.column(1).to_numpy()
    is_word = words.is_valid().to_numpy()
    return Words(words.drop_null().to_numpy(), levels[is_word]), int(levels[~is_word].sum())


def _packed(rows: np.ndarray) -> list[bytes]:
    """Buckets in three bytes each."""
    return [r.tobytes() for r in np.ascontiguousarray(rows.astype("<u4").reshape(-1, WIDTH, 1).view(np.uint8)[:, :, :3])]


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WIDTH, 4), np.uint8)
    out[:, :, :3] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH, 3)
    return out.view("<u4").reshape(-1, WIDTH).astype(np.int32)


_EXAMPLE = {"shard": pa.int32(), "text": pa.int64(), "what": pa.int32(), "kind": pa.string(), "row": pa.binary(), "scored": pa.bool_()}
_FITTED = {"part": pa.int32(), "shard": pa.int32(), "value": pa.binary(), "seen": pa.binary(), "what": pa.int32(), "kind": pa.string()}


def fitted_ends(df: DataFrame, key: str, text: str, limit_tokens: str, seed: int = 7) -> EndModel | None:
    """The model of all rows of the table; scoring takes it as often as needed."""
    return fitted_rows(df, key, text, limit_tokens, (), seed)[0]


def _chosen(df: DataFrame, key: str, text: str, limit_tokens: str, extra: tuple[str, ...]) -> tuple[DataFrame, list[str], str]:
    """The text, its limit, the key and the extra columns under names of their own, with the names and types of the last two."""
    names = ["key", *(f"extra_{i}" for i in range(len(extra)))]
    chosen = df.select(df[text].alias("text"), df[limit_tokens].cast("bigint").alias("limit_tokens"), *(df[c].alias(n) for c, n in zip((key, *extra), names)))
    return chosen, names, ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, (key, *extra)))


def fitted_rows(df: DataFrame, key: str, text: str, limit_tokens: str, extra: tuple[str, ...], seed: int = 7) -> tuple[EndModel | None, DataFrame | None]:
    """The model of all rows, and each row's key, extra columns, kind and features (null where it is blank or junk), from which it is scored without its text.

    Examples are made where the texts are, shuffled by shard, and fitted shard by shard.
    """
    spark = df.sparkSession
    known, filled = corpus_words(df, text)
    if not filled:
        return None, None
    chosen, names, types = _chosen(df, key, text, limit_tokens, extra)
    sent, hold_out, shards = spark.sparkContext.broadcast((known, corpus_links(df, text))), filled >= 2 / HELD_OUT, -(-filled // SHARD)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            texts, limits, numbers = (batch.column(i).to_pylist() for i in (0, 1, -1))
            for begin in range(0, len(texts), 1000):
                part = range(begin, min(begin + 1000, len(texts)))
                kept = [i for i in part if texts[i] and texts[i].strip()]
                made = examples_of([(numbers[i], texts[i], limits[i]) for i in kept], *sent.value, seed, hold_out, memory)
                number, what, kind, row, place = zip(*made) if made else ((), (), (), (), ())
                place = [kept[i] for i in place]
                bare = sorted({*part}.difference(place))
                number = np.array([*number, *(2 * numbers[i] for i in bare)], np.int64)
                # the example that is the text itself stands for its row
                scored = [n % 2 == 0 and w in (OWN, HELD) for n, w in zip(number.tolist(), what)] + [True] * len(bare)
                # the text's number and its shard are of different bits
                columns = ((number >> 20) % shards, number, [*what, *[NONE] * len(bare)], [*kind, *[None] * len(bare)], [*_packed(bucketed(row)), *[None] * len(bare)], scored)
                own = pa.array([i if s else None for i, s in zip([*place, *bare], scored)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, _EXAMPLE.values())), *(batch.column(n).take(own) for n in names)], [*_EXAMPLE, *names])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[list]] = {}
        fields = dict(_FITTED)

        def given(n: int, **columns) -> pa.RecordBatch:
            arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in fields.items()]
            return pa.RecordBatch.from_arrays(arrays, list(fields))

        for batch in batches:
            fields.update((n, batch.column(n).type) for n in names)
            scored = batch.filter(batch.column("scored"))
            yield given(len(scored), value=scored.column("row"), **{c: scored.column(c) for c in ("shard", "what", "kind", *names)})
            batch = batch.filter(pc.not_equal(batch.column("what"), NONE))
            shard, *columns = (batch.column(c).to_pylist() for c in ("shard", "text", "what", "kind", "row"))
            rows = _unpacked(columns[3])
            for s in sorted(set(shard)):
                mine = np.flatnonzero(np.array(shard) == s)
                of.setdefault(s, []).append([*(np.array(c, k)[mine] for c, k in zip(columns[:3], (np.int64, np.int64, object))), rows[mine]])
        for s, parts in sorted(of.items()):
            e = Examples(*map(np.concatenate, zip(*parts)))
            # an order of their own, whatever that of the files
            order = np.lexsort((*e.rows.T[:8], e.what, e.text))
            e = Examples(e.text[order], e.what[order], e.kind[order], e.rows[order])
            held = np.flatnonzero((e.what > HELD) & (e.what <= HELD_END))
            fitted = fit_weights(e, seed)
            if fitted:
                part, _, value, seen = zip(*parts_of(s, *fitted))
                yield given(len(part), part=part, shard=[s] * len(part), value=value, seen=seen)
            yield given(len(held), shard=[s] * len(held), value=_packed(e.rows[held]), what=e.what[held], kind=e.kind[held])

    number = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 60))
    examples = chosen.withColumn("number", number).mapInArrow(make, f"shard int, text bigint, what int, kind string, row binary, scored boolean, {types}")
    done = durable(examples.repartitionById(shards, "shard").mapInArrow(fit, f"{SCHEMA}, what int, kind string, {types}"))
    parts = mixed(done.where("part IS NOT NULL"))
    if not parts:
        return None, None
    model = EndModel(joined(parts), known, sent.value[1])
    weights = spark.sparkContext.broadcast(model.weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judging, sums = EndModel(weights.value, None, None), {}
        for batch in batches:
            value, what, kind = (c.to_pylist() for c in batch.columns)
            if value:
                e = Examples(np.zeros(len(what)), np.array(what), np.array(kind, object), _unpacked(value))
                for k, n in held_counts(e, judging).items():
                    sums[k] = sums.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([w for _, w in sums], pa.int32()), pa.array([n.tolist() for n in sums.values()], pa.list_(pa.int64()))], ["kind", "what", "counts"])

    counts: dict[tuple[str, int], np.ndarray] = {}
    for r in done.where(F.col("what").between(HELD, HELD_END)).select("value", "what", "kind").mapInArrow(judge, "kind string, what int, counts array<bigint>").collect():
        counts[r["kind"], r["what"]] = counts.get((r["kind"], r["what"]), 0) + np.array(r["counts"])
    return calibrated(counts, model), done.where(F.col("what").isin(OWN, HELD, NONE)).select("kind", "value", *names)


def score_ends(df: DataFrame, key: str, text: str, limit_tokens: str, extra: tuple[str, ...] = (), model: EndModel | None = None) -> DataFrame:
    """key, the extra columns, cut_score and is_cut of every row. Texts are not shuffled; the model (1 MB, and hashes of words and labels) goes to the workers.

    Without a model given, one is fitted on the table, and the features that each row was fitted on or calibrated with are scored.
    """
    chosen, names, types = _chosen(df, key, text, limit_tokens, extra)
    rows = None
    if model is None:
        model, rows = fitted_rows(df, key, text, limit_tokens, extra)
    sent = df.sparkSession.sparkContext.broadcast(model if rows is None else EndModel(model.weights, None, None, model.thresholds))

    def judged(begin: int, batch: pa.RecordBatch, n: int, filled: list[int], buckets: np.ndarray | None, kinds: list[str]) -> pa.RecordBatch:
        score, is_cut = np.zeros(n), np.zeros(n, bool)
        if filled:
            score[filled] = sent.value.scores(buckets)
            is_cut[filled] = score[filled] >= [sent.value.threshold(k) for k in kinds]
        columns = [batch.column(2 + i).slice(begin, n) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), pa.array(is_cut)], [*names, "cut_score", "is_cut"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            texts, limits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, part in blocks(texts):
                if fitted is None:
                    yield judged(begin, batch, len(part), [], None, [])
                    continue
                block = TextBlock(part)
                junk = junk_texts(block, LineShape(block))
                filled = [i for i, t in enumerate(part) if not junk[i] and t.strip()]
                ends = [part[i] for i in filled]
                kinds = list(map(end_kind, ends))
                yield judged(begin, batch, len(part), filled, fitted.rows(ends, [limits[begin + i] for i in filled], kinds), kinds)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            filled = [i for i, v in enumerate(values) if v is not None]
            yield judged(0, batch, len(values), filled, _unpacked([values[i] for i in filled]), [kinds[i] for i in filled])

    result = f"{types}, cut_score double, is_cut boolean"
    out = chosen.mapInArrow(of_texts, result) if rows is None else rows.mapInArrow(of_rows, result)
    for n, c in zip(names, (key, *extra)):
        out = out.withColumnRenamed(n, c)
    return out


def cut_rate(scored: DataFrame, source: str) -> DataFrame:
    """By source: rows, cut rows and their share."""
    cut = F.count_if("is_cut")
    return scored.groupBy(source).agg(F.count("*").alias("rows"), cut.alias("cut_rows"), (cut / F.count("*")).alias("cut_share"))
