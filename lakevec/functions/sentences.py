"""Sentences by the default boundaries of Unicode text segmentation (UAX 29)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"(?:\r\n|[\p{SB=Sep}\p{SB=CR}\p{SB=LF}])"
_MARKS = r"[\p{SB=Extend}\p{SB=Format}]*+"
_TAIL = rf"(?:\p{{SB=Close}}{_MARKS})*+ (?:\p{{SB=Sp}}{_MARKS})*+"
_GOES_ON = r"(?![\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}])"
#: What ends a sentence, with the closing signs, spaces and line break that belong to it. A full stop ends none before a digit, between a
#: letter and a capital, or where the next letter is a small one; no stop does before a comma or another stop.
_END = regex.compile(
    rf"""{_BREAK}
    | \p{{SB=STerm}}{_MARKS} {_TAIL} (?: {_BREAK} | {_GOES_ON} )
    | \p{{SB=ATerm}}{_MARKS} (?!\p{{SB=Numeric}})
      (?!\p{{SB=Upper}}(?<=[\p{{SB=Upper}}\p{{SB=Lower}}][\p{{SB=Extend}}\p{{SB=Format}}]*\p{{SB=ATerm}}[\p{{SB=Extend}}\p{{SB=Format}}]*\p{{SB=Upper}}))
      {_TAIL} (?: {_BREAK} | {_GOES_ON}
      (?![^\p{{SB=OLetter}}\p{{SB=Upper}}\p{{SB=Lower}}\p{{SB=Sep}}\p{{SB=CR}}\p{{SB=LF}}\p{{SB=STerm}}\p{{SB=ATerm}}]*+\p{{SB=Lower}}) )""",
    regex.VERBOSE | regex.VERSION1,
)
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]")


def split_sentences(text: str) -> list[str]:
    """The text cut at every boundary, in order; joined again it is the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def unicode_sentences(text: str) -> list[str]:
    """Sentences that hold a letter or a digit, with the spaces after them."""
    return [s for s in split_sentences(text) if _WORD.search(s)]


def sentences(text: Column) -> Column:
    """``unicode_sentences`` as a column of arrays; a null or empty text has none. Boundaries depend on Sentence_Break classes that the
    JVM's expressions do not know, so texts go to Python in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicode_sentences(t or ""))

    return F.pandas_udf(run, "array<string>")(text)
