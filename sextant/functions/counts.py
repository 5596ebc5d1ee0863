"""Counts of tokens of texts, in Arrow batches inside tasks.

The tokens are those of ``text.word_tokens``. A text has each word many times and a
batch has it more often still, so tokens are worked out once for a word, and kept for
words that are not their own token. Only
words of code points below ``KNOWN`` are split here, whose classes do not depend on a
version of Unicode; tokens of all other words come with the text, from the columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import word_tokens, words

KNOWN = 0x180  # ASCII, Latin-1 and Latin Extended-A
#: In Java's syntax: a word with one is not split here. A capital I with a dot has a lower case of two.
UNKNOWN = r"[^\x{0}-\x{12F}\x{131}-\x{17F}]"
#: Words whose tokens a task keeps, and texts of a batch of its results.
KEPT_WORDS = 100_000
BATCH_TEXTS = 256

_known = [chr(i) for i in range(KNOWN) if i != 0x130]
_class = lambda test: "[" + re.escape("".join(filter(test, _known))) + "]"
_UPPER, _LOWER = _class(str.isupper), _class(str.islower)
_CUT = re.compile(rf"(?<={_LOWER})(?={_UPPER})|(?<=.)(?={_UPPER}{_LOWER})")
_PART = re.compile("[-_.]")
_ODD = re.compile(rf"[^{re.escape(''.join(_known))}]")
_NO_SPACES = "\x1c\x1d\x1e\x1f"  # str.split takes them for white space, Unicode does not
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def known_tokens(word: str) -> tuple[str, ...]:
    """``word_tokens`` of a word; none if a code point is not known."""
    if not word.isascii() and _ODD.search(word):
        return ()
    low = word.lower()
    one_hump = word[1:] == low[1:] or word.isupper()
    if one_hump and word.isalnum():
        return (low,) if _long(low) else ()
    humps = () if word == low else (low,) if one_hump else [p.lower() for p in _CUT.split(word) if _long(p)]
    parts = ["".join(filter(str.isalnum, p)) for p in _PART.split(low)]
    whole = "".join(parts) if "_" not in low else "".join(c for c in low if c == "_" or c.isalnum())
    return tuple(dict.fromkeys(t for t in (*humps, *parts, whole) if _long(t)))


def _long(x: str) -> bool:
    """More than one byte in UTF-8."""
    return len(x) > 1 or x > "\x7f"


def split(text: str) -> list[str]:
    """Words between Unicode white space; there may be empty ones."""
    return _SPACE.split(text) if any(c in text for c in _NO_SPACES) else text.split()


def other_tokens(text: Column) -> Column:
    """Tokens of the words that ``known_tokens`` passes over, those of each word once."""
    odd = F.filter(words(text), lambda w: w.rlike(UNKNOWN))
    return F.when(text.rlike(UNKNOWN), F.flatten(F.transform(odd, word_tokens))).otherwise(F.array().cast("array<string>"))


def token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, key, tf) of each row (key, text, other tokens)."""
    kept: dict[str, tuple[str, ...]] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_TEXTS):
            batch = whole.slice(at, BATCH_TEXTS)
            tokens, tfs, rows = [], [], []
            for row, (text, others) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                counts = dict(Counter(others))
                for word, n in Counter(split(text)).items() if text is not None else ():
                    if word.islower() and word.isalnum() and word.isascii():  # most words
                        own = (word,) if len(word) > 1 else ()
                    elif (own := kept.get(word)) is None:
                        if len(kept) >= KEPT_WORDS:
                            kept.clear()
                        own = kept[word] = known_tokens(word)
                    for token in own:
                        counts[token] = counts.get(token, 0) + n
                tokens += counts
                tfs += counts.values()
                rows += [row] * len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), batch.column(0).take(pa.array(rows, pa.int32())), pa.array(tfs, pa.int64())], ["token", "key", "tf"])
