"""What each line of a text looks like: counts and flags that several operators combine into rules."""

from __future__ import annotations

import functools

import numpy as np

from .text_batch import LETTER, MARK, NUMBER, OTHER, SPACE, TextBlock, is_in, word_hashes

#: Frequent function words of English, French, Spanish and German.
COMMON_WORDS = (
    "the a an of to in at by and or for with on is are was were be been that this it they we you he she her his not but as have had has would so all from their there what when if who how one no than "
    "de le la les un une des et est que qui dans sur pour pas ce il elle on au du en avec son sa plus puis "
    "el los las una y por con su se es lo al muy pero para como del sin más "
    "der die das und den von zu ist nicht ein eine im auf mit sich wird war dem des dass sind so noch aber nach hat wer für"
).split()
#: Punctuation that prose uses, beside letters, digits and white space.
PROSE_MARKS = ".,;:!?'\"()-‐‑–—‘’‚“”„«»…¿¡%/&$€*_[]"
#: Characters that end a sentence, and closing marks that may follow them.
ENDERS, CLOSERS = ".!?…:", "\"')’”»]“*_"
#: Marks that open a list entry.
BULLETS = "*-+>•–·▪‣»"


@functools.cache
def common_hashes() -> np.ndarray:
    return word_hashes(COMMON_WORDS)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(0x3000, bool)
    out[[ord(c) for c in chars]] = True
    return out


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    return {"prose": _flags(PROSE_MARKS), "ender": _flags(ENDERS), "closer": _flags(CLOSERS), "bullet": _flags(BULLETS), "cell": _flags("|\t;")}


def _look(codes: np.ndarray, name: str) -> np.ndarray:
    return (codes < 0x3000) & _tables()[name][np.minimum(codes, 0x2FFF)]


class LineShape:
    """Arrays with an entry for each line of the block."""

    def __init__(self, block: TextBlock):
        self.block = block
        b, kinds, codes = block, block.kinds, block.codes
        start, end = b.line_start, b.line_end
        visible = kinds != SPACE
        self.chars = b.per_line(visible)
        self.letters = b.per_line((kinds == LETTER) | (kinds == MARK))
        self.digits = b.per_line(kinds == NUMBER)
        self.other_script = b.per_line((kinds == LETTER) & (codes >= 0x370))
        strange = (kinds == OTHER) & ~_look(codes, "prose") & ~_look(codes, "bullet") & ~_look(codes, "cell")
        self.strange = b.per_line(strange)
        self.words = b.words_per_line()
        self.common = b.words_per_line(is_in(b.word_hash, common_hashes()))
        self.blank = self.chars == 0
        # first and last visible characters of each line
        at = np.flatnonzero(visible)
        if len(at):
            first = at[np.minimum(np.searchsorted(at, start), len(at) - 1)]
            last = at[np.maximum(np.searchsorted(at, end) - 1, 0)]
        else:
            first = last = np.zeros(len(start), np.int64)
        self.first, self.last = np.where(self.blank, start, first), np.where(self.blank, start, last)
        self.first_code, self.last_code = codes[self.first], codes[self.last]
        before = codes[np.maximum(self.last - 1, start)]
        before2 = codes[np.maximum(self.last - 2, start)]
        closed = _look(self.last_code, "closer")
        self.ends = ~self.blank & (_look(self.last_code, "ender") | closed & (_look(before, "ender") | _look(before, "closer") & _look(before2, "ender")))
        spaced = kinds[np.minimum(self.first + 1, len(codes) - 1)] == SPACE
        self.bullet = ~self.blank & _look(self.first_code, "bullet") & spaced
        self.lower_start = ~self.blank & (kinds[self.first] == LETTER) & (b.low[self.first] == b.clipped[self.first])
        self.cells = b.per_line(_look(codes, "cell"))
        self.text = b.line_text

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """Hash of the words of each line; of the first character and the length where there are no words."""
        b = self.block
        out = self.first_code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.chars.astype(np.uint64)
        if len(b.word_hash):
            lines, begin = np.unique(b.word_line, return_index=True)
            within = np.arange(len(b.word_hash)) - np.repeat(begin, np.diff(np.append(begin, len(b.word_hash))))
            mixed = b.word_hash * (np.uint64(2) * within.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            out[lines] = np.add.reduceat(mixed, begin)
        return out

    @functools.cached_property
    def titled(self) -> np.ndarray:
        """The line ends in a year or a page number, or in a quantity in brackets, as entries of lists do."""
        codes, kinds = self.block.codes, self.block.kinds
        inner = codes[np.maximum(self.last - 1, self.block.line_start)]
        inner_kind = kinds[np.maximum(self.last - 1, self.block.line_start)]
        bracketed = (self.last_code == ord(")")) & ((inner_kind == NUMBER) | (inner_kind == LETTER))
        numbered = (kinds[self.last] == NUMBER) & ~self.blank
        return bracketed & (inner != 10) | numbered
