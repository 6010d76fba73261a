"""Quality rules: counts of a text's repetitions and symbols, and its distance from normal text.

The base rules are counts. What they miss is told by distributions: the shares
of character classes (letters, digits, kinds of punctuation, symbols ...) and of
each language's common words in a document are compared with those of ordinary
documents by the Jensen-Shannon distance. A text is judged by the language it is
closest to, and only if it is long enough for its shares to mean something.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.llm.common import python_ready
from sparkmail.llm.shingles import SPACES, U, mix
from sparkmail.session import stage_table

SYMBOLS = "#*$%&|<>"
#: Words of a window of which two in a text count as a repetition.
WINDOW = 5
#: Counts that a fitting task keeps at most before it passes them on (and those of one batch).
MOST_KEYS = 200_000
#: Common words of a language's reference; languages whose references the driver holds at most.
COMMON, MOST_LANGUAGES = 64, 200
#: Distances (0 to 1) beyond which a text fails, in code points and words that the text must have for each.
CHAR_LIMIT, CHAR_LEAST = 0.15, 200
#: Code points of an ordinary text that one number or key may take up: the character limit is wider by their share.
CHAR_SLACK = 20
WORD_LIMIT, WORD_LEAST = 0.45, 40

#: Character classes by first match; everything else is the last class.
CLASSES = ("lower", "upper", "letter", "digit", "blank", "break", "stop", "mark", "quote", "symbol", "other")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its class, whether it is ASCII white space, whether it is one of SYMBOLS."""
    kinds = {"Ll": 0, "Lu": 1, "Nd": 3, "Zs": 4, "Zl": 5, "Zp": 5}
    group = np.full(0x110000, 10, dtype=np.uint8)
    for c in range(0x30000):
        kind = unicodedata.category(chr(c))
        group[c] = kinds.get(kind, 2 if kind[0] in "LM" else 9 if kind[0] == "S" else 10)
    for chars, own in ((" ", 4), ("\t\n\v\f\r", 5), (".,;:", 6), ("!?", 7), ("'\"()-’“”«»", 8), (SYMBOLS, 9)):
        group[[ord(c) for c in chars]] = own
    space, symbol = np.zeros((2, 0x110000), dtype=bool)
    space[list(SPACES)] = True
    symbol[[ord(c) for c in SYMBOLS]] = True
    return group, space, symbol


def common_form(word: bytes) -> str:
    """A word as it is counted: lower-case, without what is not a letter at both ends ('' if nothing is left)."""
    word = word.decode().lower()
    if word.isalpha():
        return word
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0]:at[-1] + 1] if at else ""


def numbered(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of some texts, and each text's words as numbers of these."""
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(w, len(known)) for w in t.encode().split()], dtype=np.int64) for t in texts]
    return list(known), numbers


def repeated_words(words: np.ndarray) -> int:
    """Words (as numbers) that lie in a WINDOW-word window found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = mix(words.astype(U) + U(1))
    key = np.zeros(n, dtype=U)
    for i in range(WINDOW):
        key = mix(key * U(0x2545F4914F6CDD1D) + codes[i:i + n])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    hit[at] += 1
    hit[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(hit)))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` from each row of ``q``; rows are counts or shares.
    A row of zeros is at distance 1 from all."""
    def shares(x):
        total = x.sum(axis=1, keepdims=True)
        return np.divide(x, total, out=np.zeros(x.shape), where=total > 0)

    a, b = shares(np.asarray(p, dtype=float))[:, None, :], shares(np.asarray(q, dtype=float))[None, :, :]
    m = (a + b) / 2
    total = sum((x * np.log2(np.divide(x, m, out=np.ones(m.shape), where=(x > 0) & (m > 0)))).sum(axis=2) for x in (a, b)) / 2
    empty = (a.sum(axis=2) == 0) | (b.sum(axis=2) == 0)
    return np.where(empty, 1.0, np.sqrt(np.clip(total, 0.0, 1.0)))


@dataclass(frozen=True)
class Reference:
    """A language's shares of character classes, and its common words with theirs (the last share is that of all other words)."""
    language: str
    chars: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules (as in ``failed``) and of the distances."""
    least_words: int = 10
    repeat_percent: int = 20
    char_limit: float = CHAR_LIMIT
    char_slack: int = CHAR_SLACK
    char_least: int = CHAR_LEAST
    word_limit: float = WORD_LIMIT
    word_least: int = WORD_LEAST

    def failed(self, n_words: int, n_repeat: int) -> bool:
        return n_words < self.least_words or 100 * n_repeat > self.repeat_percent * n_words

    def beyond(self, n_chars: int, n_words: int, by_chars: float, by_words: float) -> bool:
        """Whether a text that is long enough is too far from all references."""
        return bool(n_chars >= self.char_least and by_chars > self.char_limit + self.char_slack / n_chars
                    or n_words >= self.word_least and by_words > self.word_limit)


def class_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: code points of each class, code points that are not white space, symbols."""
    group, space, symbol = tables()
    counts, chars, symbols = np.zeros((len(texts), len(CLASSES)), dtype=np.int64), *np.zeros((2, len(texts)), dtype=np.int64)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        counts[i] = np.bincount(group[codes], minlength=len(CLASSES))
        chars[i] = len(codes) - np.count_nonzero(space[codes])
        symbols[i] = np.count_nonzero(symbol[codes])
    return counts, chars, symbols


class Judge:
    """Distances of texts from the references."""

    def __init__(self, references: list[Reference]):
        self.references = references
        self.chars = np.array([r.chars for r in references]).reshape(len(references), len(CLASSES))
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for r in references for w in r.words}))}
        self.own = [np.array([self.vocabulary[w] for w in r.words], dtype=np.int64) for r in references]

    def __call__(self, counts: np.ndarray, known: list[bytes], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The smallest distance of each text by character classes and by common words (0 without references)."""
        if not self.references:
            return np.zeros((2, len(numbers)))
        size = len(self.vocabulary)  # the number of other words; size + 1: that of words without a letter
        forms = np.array([self.vocabulary.get(f, size) if (f := common_form(w)) else size + 1 for w in known], dtype=np.int64)
        tally = np.array([np.bincount(forms[n], minlength=size + 2) for n in numbers]).reshape(len(numbers), size + 2)
        total = tally[:, :size + 1].sum(axis=1)
        by_words = np.ones(len(numbers))
        for r, own in zip(self.references, self.own):
            seen = tally[:, own]
            by_words = np.minimum(by_words, distance(np.column_stack([seen, total - seen.sum(axis=1)]), np.array([r.shares]))[:, 0])
        return distance(counts, self.chars).min(axis=1), by_words


def fit_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   common: int = COMMON, rules: Rules = Rules()) -> list[Reference]:
    """The references of each value of ``lang_col``, languages in order.

    All documents are counted, without those that fail the base rules. They are fitted twice: the second time
    without the documents that the first references reject, so that junk does not shape them; only the counts of
    the rejected ones are taken off again. Rows with a null id, text or language are not used.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where("id is not null and text is not null and lang is not null")
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    if not sizes:
        return []

    def count(references):
        """Counts of the documents that pass the base rules; with references, of those among them that these reject."""
        def run(batches):
            judge = Judge(references)
            words: dict[str, dict[bytes, int]] = {}
            classes: dict[str, np.ndarray] = {}
            for batch in batches:
                langs, texts = (c.to_pylist() for c in batch.columns)
                known, numbers = numbered(texts)
                counts = class_counts(texts)[0]
                used = [not rules.failed(len(w), repeated_words(w)) for w in numbers]
                if references:
                    used = [u and rules.beyond(*x) for u, x in zip(used, zip(counts.sum(axis=1), map(len, numbers), *judge(counts, known, numbers)))]
                of_lang: dict[str, list[int]] = {}
                for i, lang in enumerate(langs):
                    if used[i]:
                        of_lang.setdefault(lang, []).append(i)
                for lang, rows in of_lang.items():
                    tally = np.bincount(np.concatenate([numbers[i] for i in rows]), minlength=len(known))
                    own, at = words.setdefault(lang, {}), np.flatnonzero(tally)
                    for i, n in zip(at.tolist(), tally[at].tolist()):
                        own[known[i]] = own.get(known[i], 0) + n
                    classes[lang] = classes.get(lang, 0) + counts[rows].sum(axis=0)
                if sum(map(len, words.values())) > MOST_KEYS:
                    yield flushed(words, classes)
            yield flushed(words, classes)
        return run

    def flushed(words, classes):
        rows = []
        for lang, own in words.items():
            forms: dict[str, int] = {}
            for word, n in own.items():
                if form := common_form(word):
                    forms[form] = forms.get(form, 0) + n
            rows += [(lang, form, n) for form, n in forms.items()]
            rows += [(lang, f"\x00{i}", n) for i, n in enumerate(classes[lang].tolist()) if n]
        words.clear()
        classes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          names=["lang", "key", "n"])

    python_ready(docs.sparkSession)
    texts = labelled.select("lang", "text")
    references: list[Reference] = []
    tally = None
    for _ in range(2):
        found = texts.mapInArrow(count(references), "lang string, key string, n long")
        if tally is not None:
            found = tally.unionByName(found.withColumn("n", -F.col("n")))
        tally = stage_table(found.groupBy("lang", "key").agg(F.sum("n").alias("n")).where("n > 0"), "quality-tally")
        references = references_of(tally, common)
        if not references:
            break
    return references


def references_of(tally: DataFrame, common: int) -> list[Reference]:
    """The references by the counts (lang, key, n) of character classes (keys from ``\\0`` on) and words of each language."""
    chars: dict[str, dict[int, int]] = {}
    words = tally.where(~F.col("key").startswith("\x00"))
    for r in tally.where(F.col("key").startswith("\x00")).collect():
        chars.setdefault(r.lang, {})[int(r.key[1:])] = r.n
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    first = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= common)
    top: dict[str, list] = {}
    for r in first.orderBy("lang", "rank").collect():
        top.setdefault(r.lang, []).append((r.key, r.n / totals[r.lang]))
    references = []
    for lang in sorted(chars.keys() | top.keys()):
        own, found = chars.get(lang, {}), top.get(lang, [])
        total, shares = sum(own.values()), [n for _, n in found]
        references.append(Reference(lang, tuple(own.get(i, 0) / max(total, 1) for i in range(len(CLASSES))),
                                    tuple(w for w, _ in found), (*shares, max(0.0, 1.0 - sum(shares)))))
    return references


def judge_quality(docs: DataFrame, references: list[Reference], id_col: str = "doc_id", text_col: str = "text",
                  rules: Rules = Rules()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept)
    for each row of ``docs``.

    Words are runs of anything but ASCII white space. ``kept`` is false where the base rules fail, and where a text of
    ``char_least`` code points is farther than ``char_limit`` (and ``char_slack`` / code points) from every language's character classes, or one of
    ``word_least`` words farther than ``word_limit`` from every language's common words. Without references only
    the base rules judge.

    A null or empty text has no words and fails. Repeated rows and null ids stay; an empty table gives an empty
    result; other columns of ``docs`` are not read.
    """
    schema = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "char_distance double, word_distance double, base_failed boolean, kept boolean")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        judge = Judge(references)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known, numbers = numbered(texts)
            counts, chars, symbols = class_counts(texts)
            repeats = [repeated_words(w) for w in numbers]
            by_chars, by_words = judge(counts, known, numbers)
            failed = [rules.failed(len(w), r) for w, r in zip(numbers, repeats)]
            kept = [not f and not rules.beyond(*x) for f, x in zip(failed, zip(counts.sum(axis=1), map(len, numbers), by_chars, by_words))]
            longs = [pa.array(x, pa.int64()) for x in ([len(w) for w in numbers], chars, symbols, [repeated_lines(t) for t in texts], repeats)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(by_chars), pa.array(by_words),
                                              pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=names)

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
