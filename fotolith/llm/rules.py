"""Quality rules, line first.

Every line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed; a document that loses too much of its text, or that
fails the whole-text base rules, is rejected. The rules look at a line's shape,
not at words of a language:

- punctuation: too many symbols, ``!!`` after most words, capitals only, a stray line of one or two words or a
  run of ``RUN_ON`` words or more without the end of a sentence;
- navigation: items between bars, or labels (nearly every word capitalised) without an end;
- boilerplate: a repeated line, legal signs on a short line, mostly addresses, or one word over half of the line.

Base measures (words are ``[^\\x20\\x09-\\x0D]+``):

- ``word_chars``: code points in words;
- ``n_symbols``: characters of ``[#*$%&|<>]``;
- ``n_dup_lines``: lines with a word that equal an earlier line;
- ``n_repeat_words``: words inside 8-word windows found twice or more in the text.

Null and empty texts have no words, fail the base rules and are not kept.
Repeated rows give repeated results; null ids stay null. Extra columns are not
read, except that ``clean`` passes all of them on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolith.llm.common import fresh, prepare, tidied

SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document stays if at least this share of its words is on lines that stay.
MIN_KEPT_PERCENT = 50
#: Per word of a line.
MAX_LINE_SYMBOLS, MAX_LINE_BARS, MAX_LINE_BANGS = 0.3, 0.25, 0.5
#: Signs between the items of a menu, signs of legal lines, ends of sentences, marks of addresses.
BARS, LEGAL, ENDS, ADDRESS = "|›»·•", "©®™", ".!?…。！？", ("://", "www.", "@")
#: Words from which on a line of capitals, of labels, of one word, or without an end of a sentence fails; words of a short line.
CAPITALS, LABELS, STUFFED, RUN_ON, SHORT = 4, 4, 8, 30, 40
MIN_LABEL_SHARE, MAX_WORD_SHARE, MAX_ADDRESS_SHARE = 0.8, 0.5, 0.5
#: What a line fails by.
PUNCTUATION, NAVIGATION, BOILERPLATE = 1, 2, 3
TERMINAL = tuple(".!?\"'”’»:;)]…。！？")

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_lines_removed long, words_kept long, clean_text string, "
    "n_punctuation long, n_navigation long, n_boilerplate long"
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """``n_repeat_words`` of each text, for all texts of a batch at once.

    Words become numbers; a window's name is a 64-bit hash of its eight numbers
    and its text; names found twice mark the words of their windows.
    """
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    number: dict[bytes, int] = {}
    setdefault = number.setdefault
    ids = np.fromiter((setdefault(w, len(number)) for doc in words for w in doc), np.uint64, total)
    ids = _mix((ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.repeat(np.arange(len(words)), counts)
    n = total - WINDOW + 1
    name = doc[:n].astype(np.uint64)
    for j in range(WINDOW):
        name = _mix(name * np.uint64(0xD6E8FEB86659FD93) + ids[j : j + n])
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = at[np.argsort(name[at], kind="stable")]
    same = name[order[1:]] == name[order[:-1]]
    hit = np.zeros(total + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(hit[:total]) > 0, minlength=len(words)).astype(np.int64)


def line_fault(line: str, n_words: int) -> int:
    """The rule that one line fails, or 0; ``n_words``: its number of words, one at least."""
    bars = sum(map(line.count, BARS))
    if bars >= 3 and bars >= MAX_LINE_BARS * n_words:
        return NAVIGATION
    if sum(map(line.count, SYMBOLS)) > MAX_LINE_SYMBOLS * n_words + 2 or line.count("!!") > MAX_LINE_BANGS * n_words:
        return PUNCTUATION
    ended = line.rstrip(ASCII_SPACE).endswith(TERMINAL)
    if n_words < 3 and not ended or n_words >= RUN_ON and not any(c in line for c in ENDS):
        return PUNCTUATION
    if n_words >= CAPITALS and line.isupper():
        return PUNCTUATION
    if n_words < SHORT and any(c in line for c in LEGAL):
        return BOILERPLATE
    words = line.split()
    if n_words >= LABELS and not ended and sum(w[0].isupper() for w in words) >= MIN_LABEL_SHARE * len(words):
        return NAVIGATION
    if any(c in line for c in ADDRESS) and sum(any(c in w for c in ADDRESS) for w in words) > MAX_ADDRESS_SHARE * len(words):
        return BOILERPLATE
    if n_words >= STUFFED and 2 * len(set(words)) <= len(words) and max(Counter(words).values()) > MAX_WORD_SHARE * len(words):
        return BOILERPLATE
    return 0


def judge(texts: list[str]) -> list[tuple]:
    """A row of ``SCHEMA`` for each text."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    repeats = repeat_words(words).tolist()
    rows = []
    for text, own, repeat in zip(texts, words, repeats):
        n = len(own)
        lines = text.split("\n")
        seen: set[str] = set()
        dups = lost = 0
        faults = [0, 0, 0, 0]
        stay = []
        for line in lines:
            k = len(line.encode("utf-8", "surrogatepass").split())
            if not k:
                stay.append(line)
                continue
            dup = line in seen
            seen.add(line)
            dups += dup
            if fault := BOILERPLATE if dup else line_fault(line, k):
                faults[fault] += 1
                lost += k
            else:
                stay.append(line)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        kept = not failed and 100 * (n - lost) >= MIN_KEPT_PERCENT * n
        rows.append((
            n, len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)), dups, repeat, failed,
            kept, len(lines), sum(faults), n - lost, "\n".join(stay) if any(faults) else text, *faults[1:],
        ))
    return rows


def evaluate(docs: DataFrame, text_col: str = "text", out: str = "rules") -> DataFrame:
    """Judge every text: all columns of ``docs``, then the struct ``out`` (see ``SCHEMA``).

    One pass over the rows and no shuffle. A column of ``docs`` that has the
    name ``out`` is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    names = SCHEMA.replace(",", "").split()[::2]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge([t or "" for t in batch.column(at).to_pylist()])
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cols, names=names)], names=[*batch.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType.fromDDL(SCHEMA))])
    return docs.mapInArrow(tidied(run), schema)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with their failing lines removed; same columns as ``docs``."""
    out = fresh(docs, "rules")
    judged = evaluate(docs, text_col, out).where(F.col(f"{out}.kept"))
    return judged.withColumn(text_col, F.col(f"{out}.clean_text")).select(docs.columns)
