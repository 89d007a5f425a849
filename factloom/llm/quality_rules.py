"""Quality rules: base counts, and the divergence of a text from language references.

A text's character-class histogram and its common-word histogram are compared with those of each reference
language by Jensen-Shannon distance (base 2, square root). One language counts for both: of those that the text isn't
rejected for, or else of all, the one of the least sum of both distances; a text of another language than these is
far from most, but one of a near language may pass (Italian prose is kept as French). A text is rejected for a language if its
character distance exceeds MAX_CHAR_DISTANCE, or its word distance MAX_WORD_DISTANCE, each by more than
1 / sqrt(n) for the n characters or words counted: a histogram of few samples strays that far by chance. That both
stray by chance is unlikely, so a text is rejected too if both distances exceed their plain limits. Texts of
fewer than MIN_CHARS characters are too short for the character rule and pass it, those of fewer than MIN_WORDS words
pass the word rule, and the rule of both distances is for texts that are long enough for both. With the base rule's own
least length of base_words = 50 words no text that is kept is too short for the word rule; callers can lower it.

Defined cases: a null text counts as empty; an empty text fails the base rule (fewer than 50 words); rows
are judged one by one, so repeated rows get the same verdict, and a null doc_id stays; other columns pass through
filter_quality and are left out of quality_report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, bounded, packed, text_buffers, unpacked, windows, words_of

MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 200, 50, 0.2, 0.29

CLASSES = ("vowel", "consonant", "upper", "beyond ASCII", "digit", "space", "punctuation", "symbol")
#: Shares of the classes in ordinary prose, rounded.
CHAR_REFERENCES = {
    "en": (0.30, 0.475, 0.025, 0.002, 0.005, 0.165, 0.027, 0.001),
    "de": (0.28, 0.475, 0.05, 0.02, 0.005, 0.14, 0.029, 0.001),
    "fr": (0.325, 0.40, 0.025, 0.05, 0.005, 0.165, 0.029, 0.001),
    "es": (0.35, 0.40, 0.025, 0.03, 0.005, 0.16, 0.029, 0.001),
}
#: Common words of each language and their shares of running words in percent, rounded.
WORD_REFERENCES = {
    "en": "the 6 of 3 and 2.8 to 2.6 a 2.2 in 2 is 1 that 1 for 0.9 it 0.9 was 0.9 on 0.7 with 0.7 as 0.7 be 0.6 by 0.5 at 0.5 are 0.5 this 0.5 or 0.4 from 0.4",
    "de": "der 3.3 die 3.2 und 2.8 in 1.9 den 1.2 von 1 zu 1 das 1 mit 0.9 sich 0.8 des 0.8 auf 0.8 für 0.8 ist 0.8 im 0.8 dem 0.7 nicht 0.7 ein 0.7 eine 0.6 als 0.6",
    "fr": "de 5 la 3 le 2.3 et 2.2 les 2 des 1.8 en 1.5 un 1.2 du 1.2 une 1.1 que 1 est 1 pour 0.9 qui 0.9 dans 0.8 par 0.7 sur 0.6 au 0.6 pas 0.5 avec 0.4",
    "es": "de 6 la 4 que 2.9 el 2.8 en 2.6 y 2.5 los 1.6 del 1.2 se 1.2 las 1.1 un 1 por 1 con 0.9 una 0.9 para 0.7 su 0.7 es 0.7 al 0.6 no 0.6 como 0.5",
}


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    """Class of each byte; 8 for bytes inside a code point."""
    of = np.full(256, 7)
    of[0xC0:] = 3
    of[0x80:0xC0] = 8
    for k, chars in ((0, "aeiou"), (1, "bcdfghjklmnpqrstvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, "0123456789"), (6, ".,;:!?'\"()-")):
        of[[ord(c) for c in chars]] = k
    of[SPACE] = 5
    return of.astype(np.uint8)


@dataclass
class Words:
    """The common words of all languages as sorted hashes, and each language's expected shares."""

    hashes: np.ndarray
    shares: dict[str, np.ndarray]


@lru_cache(maxsize=1)
def _words() -> Words:
    lists = {lang: dict(zip(x.split()[::2], map(float, x.split()[1::2]), strict=True)) for lang, x in WORD_REFERENCES.items()}
    every = sorted({w for x in lists.values() for w in x})
    ((_, _, hashes, _),) = words_of(pa.array([" ".join(every)]), fold=True)
    order = np.argsort(hashes)
    shares = {}
    for lang, x in lists.items():
        own = np.array([x.get(every[k], 0.0) for k in order]) / 100
        shares[lang] = np.r_[own, 1 - own.sum()]
    return Words(hashes[order], shares)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum(0.0, (half(p) + half(np.broadcast_to(q, p.shape))) / 2))


def distances(counts: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """Distance of each row of counts from each reference; 0 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return np.where(total > 0, np.stack([js_distance(p, q) for q in references], axis=1), 0.0)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _histograms(part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the 9 byte classes of each text."""
    rows = len(offsets) - 1
    kind = _class_of()[part]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    return np.bincount(row * 9 + kind, minlength=rows * 9).reshape(rows, 9)


SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def repeated_words(words: np.ndarray, k: int = 3) -> int:
    """Words in k-word windows that are found twice or more."""
    found = windows(words, k)
    if len(found) < 2:
        return 0
    order = np.sort(found)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.isin(found, again)
    inside = np.zeros(len(words), bool)
    for j in range(k):
        inside[j : j + len(found)] |= at
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _measured(max_char: float, max_word: float):
    return partial(_measure, max_char, max_word)


def _measure(max_char: float, max_word: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    references = [np.array(v) / sum(v) for v in CHAR_REFERENCES.values()]
    languages, common = np.array(list(CHAR_REFERENCES)), _words()
    shares = [common.shares[x] for x in languages]
    for batch in batches:
        column = batch.column("text").fill_null("")
        n = len(column)
        data, offsets = text_buffers(column)
        out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        chars, hits = np.zeros((n, 9), np.int64), np.zeros((n, len(common.hashes) + 1), np.int64)
        for lo, hi, words, bounds in words_of(column, fold=False):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            chars[lo:hi] = _histograms(part, at)
            out["n_words"][lo:hi] = np.diff(bounds)
            out["n_symbols"][lo:hi] = _sums(SYMBOLS[part], at)
            for row in range(lo, hi):
                out["n_repeat_words"][row] = repeated_words(words[bounds[row - lo] : bounds[row - lo + 1]])
        for lo, hi, words, bounds in words_of(column, fold=True):
            place = np.minimum(np.searchsorted(common.hashes, words), len(common.hashes) - 1)
            place = np.where(common.hashes[place] == words, place, len(common.hashes))
            row = np.repeat(np.arange(hi - lo), np.diff(bounds))
            hits[lo:hi] = np.bincount(row * hits.shape[1] + place, minlength=(hi - lo) * hits.shape[1]).reshape(hi - lo, -1)
        for row, text in enumerate(column):
            out["n_dup_lines"][row] = repeated_lines(text.as_py())
        # code points: bytes inside a code point don't count
        out["word_chars"] = chars[:, :8].sum(axis=1) - chars[:, 5]
        far, away = distances(chars[:, :8], references), distances(hits, shares)
        size, n_words = chars[:, :8].sum(axis=1)[:, None], out["n_words"][:, None]
        long, wordy = size >= MIN_CHARS, n_words >= MIN_WORDS
        unfit = long & (far > max_char + 1 / np.sqrt(np.maximum(size, 1))) | wordy & (away > max_word + 1 / np.sqrt(np.maximum(n_words, 1))) | long & wordy & (far > max_char) & (away > max_word)
        each, nearest = np.arange(n), (far + away + 10 * unfit).argmin(axis=1) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x) for x in out.values()], pa.array(chars[:, :8].sum(axis=1)), pa.array(languages[nearest], pa.string()), pa.array(far[each, nearest]), pa.array(away[each, nearest])],
            names=["doc_id", *out, "chars", "language", "char_distance", "word_distance"],
        )


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars long, language string, char_distance double, word_distance double"


def _verdict(measured: DataFrame, max_char: float, max_word: float, base_words: int) -> DataFrame:
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars, words = F.col("chars") >= MIN_CHARS, F.col("n_words") >= MIN_WORDS
    chance = lambda n: 1 / F.sqrt(F.greatest(F.col(n), F.lit(1)))
    far = chars & (F.col("char_distance") > max_char + chance("chars")) | words & (F.col("word_distance") > max_word + chance("n_words"))
    both = chars & words & (F.col("char_distance") > max_char) & (F.col("word_distance") > max_word)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~far & ~both})


def filter_quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, base_words: int = 50) -> DataFrame:
    """The rows of docs that are kept, with their own columns; texts are read once and nothing is shuffled."""
    inner = docs.select(packed(docs).alias("doc_id"), F.col("text"))
    measured = bounded(inner).mapInArrow(_measured(max_char, max_word), f"doc_id {inner.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
    return _verdict(measured, max_char, max_word, base_words).filter("kept").withColumnRenamed("doc_id", "rest").select(*unpacked(docs))


def quality_report(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, base_words: int = 50) -> DataFrame:
    """One row per document: base counts, base_failed, kept, and the nearest language with its two distances."""
    measured = bounded(docs).select("doc_id", "text").mapInArrow(_measured(max_char, max_word), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _verdict(measured, max_char, max_word, base_words).select(*first, "language", "char_distance", "word_distance")
