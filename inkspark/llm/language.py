"""Language identification: proportions of languages in a document by expectation-maximisation (operator 13).

A text is lower-cased and split into words, runs of letters. A word's likelihood in a language is that of its letters one
after another, each given the two before (word ends count as a letter): p(c | ab) = (n(abc) + SMOOTH / LETTERS) / (n(ab) + SMOOTH). A
document is a mixture: each of its words comes from one of its languages. Expectation-maximisation estimates the proportions; a
set of languages is worth its log likelihood less PENALTY * ln(words) for each language after the first. Sets are searched
backwards: from all languages, those with less than half a word go at once, then the least one by one, and the best set counts.
The prediction is the largest language of that set (ties: the first by name) and the score its proportion.

Learned from text and lang of rows whose crc32(id as text) mod 5 is not 0: of each of the LANGS most frequent languages
PER_LANG documents, or a few per cent more or less where there are more, picked by a hash of the id and read whole; of several rows of an id and language the text with the
largest hash counts. Of the letter triples the GRAMS with the largest share of any language are known; others tell nothing.
Both bound what the driver and each task hold. Scoring reads every row and whole text. Words count as units, so a
long word weighs no more than FLOOR (in nats) against a language.

Null texts and texts without a letter are ``und`` with score 0; a text of unknown letters only has equal proportions. A null id
is neither learned from nor held out. Null languages are not learned; where nothing can be learned (an empty table, no
language) all is ``und``, 0. Repeated rows get equal predictions. Clashing names: only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

LANGS, PER_LANG, GRAMS = 256, 1000, 50_000
SMOOTH, LETTERS, FLOOR, PENALTY = 10.0, 40, 12.0, 3.0
ROUNDS, CLOSE = 30, 1e-3
#: Characters that are scored at a time, for each language.
CHUNK = 8 << 20

_WORD = re.compile(r"[^\W\d_]+")
_TAIL = (1 << 42) - 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter triples of words with an end on either side, as numbers of 3 x 21 bits, and where each word's begin: n of n
    letters. starts() has one more."""
    line = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 2) - size - 2
    code = (line[:-2] << 42) | (line[1:-1] << 21) | line[2:]
    keep = np.ones(len(code) + 2, bool)
    keep[start + size] = keep[start + size + 1] = False
    return code[keep[:-2]], np.cumsum(size) - size


def starts(words: list[str]) -> np.ndarray:
    """A word's first letter, as a triple that begins with two ends."""
    return np.fromiter((ord(w[0]) for w in words), np.int64, len(words)) | (32 << 42) | (32 << 21)


@dataclass
class Model:
    """Languages by name, known triples in order, and the log likelihood of each in each language."""

    langs: list[str]
    codes: np.ndarray
    table: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words (rows) in each language, the best 0 and none under -FLOOR."""
        code, first = triples(words)
        total = np.add.reduceat(self._rows(code), first, axis=0) + self._rows(starts(words))
        return np.maximum(total - total.max(1, keepdims=True), -FLOOR)

    def _rows(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return self.table[at] * (self.codes[at] == code)[:, None]


def table_of(counts: dict[str, dict[int, int]], context: dict[str, dict[int, int]], codes: np.ndarray) -> Model:
    """A model of counts of triples and of their first two letters, for each language."""
    langs = sorted(counts)
    table = np.zeros((len(codes), len(langs)), np.float32)
    for k, lang in enumerate(langs):
        n = np.array([counts[lang].get(int(c), 0) for c in codes], float)
        before = np.array([context[lang].get(int(c) >> 21, 0) for c in codes], float)
        table[:, k] = np.log((n + SMOOTH / LETTERS) / (before + SMOOTH))
    return Model(langs, codes, table)


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, first, axis=0)


def _estimate(like: np.ndarray, weight: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document by expectation-maximisation from ``share``, and its log likelihood. Document d has the
    rows from first[d] on."""
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(like))))
    total = _sums(weight, first)[:, None]
    for _ in range(ROUNDS):
        p = like * share[doc]
        new = _sums(p * (weight / p.sum(1))[:, None], first) / total
        moved, share = np.abs(new - share).max(), new
        if moved < CLOSE:
            break
    return share, _sums(weight * np.log(np.maximum((like * share[doc]).sum(1), 1e-300)), first)


def mixtures(like: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The proportions of languages in the best set of each document; ``like`` has the likelihoods of a distinct word of a document
    in each row, ``weight`` its number."""
    n = _sums(weight, first)
    share, worth = _estimate(like, weight, first, np.full((len(first), like.shape[1]), 1 / like.shape[1]))
    few = share * n[:, None] < 0.5
    few[np.arange(len(share)), share.argmax(1)] = False
    best, value = np.zeros_like(share), np.full(len(share), -np.inf)
    todo, share = np.arange(len(first)), np.where(few, 0, share)
    ends = np.append(first, len(like))
    while len(todo):
        rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in todo]) if len(todo) < len(first) else slice(None)
        size = (ends[1:] - ends[:-1])[todo]
        share, worth = _estimate(like[rows], weight[rows], np.cumsum(size) - size, share / share.sum(1, keepdims=True))
        members = (share > 0).sum(1)
        worth = worth - PENALTY * np.log(n[todo] + 1) * (members - 1)
        better = worth > value[todo]
        best[todo[better]], value[todo[better]] = share[better], worth[better]
        more = members > 1
        todo, share = todo[more], share[more].copy()
        least = share.shape[1] - 1 - np.where(share > 0, share, np.inf)[:, ::-1].argmin(1)
        share[np.arange(len(share)), least] = 0
    return best


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    found = [[] if t is None else words_of(t) for t in texts]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, w in enumerate(found) if w]
    if model is None or not known:
        return lang, score
    words = pa.array([w for i in known for w in found[i]], pa.large_string()).dictionary_encode()
    like = np.exp(model.of_words(words.dictionary.to_pylist()).astype(np.float64))
    doc = np.repeat(np.arange(len(known)), [len(found[i]) for i in known])
    pair, weight = np.unique(doc * len(like) + words.indices.to_numpy(), return_counts=True)
    first = np.searchsorted(pair, np.arange(len(known)) * len(like))
    share = mixtures(like[pair % len(like)], weight.astype(float), first)
    for i, s in zip(known, share, strict=True):
        lang[i], score[i] = model.langs[s.argmax()], float(min(s.max(), 1.0))
    return lang, score


def _fold(id_col: F.Column) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(lang, text) of the documents to learn from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold(F.col("id")) != 0))
    ids = rows.groupBy("lang", "id").agg(F.lit(1).alias("one"))
    langs = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    share = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * per_lang / F.col("n")
    picked = ids.join(F.broadcast(langs), "lang").where(share)
    picked = F.broadcast(materialize(picked.select("lang", "id")))  # about LANGS x PER_LANG rows at most
    return rows.join(picked, ["lang", "id"]).groupBy("lang", "id").agg(F.max(F.struct(F.xxhash64("text"), "text")).alias("x")).select("lang", "x.text")


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = PER_LANG, grams: int = GRAMS) -> Model | None:
    """A model of a bounded sample (see above); None where there is nothing to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    code, n = np.unique(np.concatenate([triples(words)[0], starts(words)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n, pa.int64())], ["lang", "code", "n"])

    counted = sample(docs, text_col, id_col, lang_col, per_lang).mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counted.join(F.broadcast(total), "lang").groupBy("code").agg(F.max(F.col("n") / F.col("total")).alias("share"))
    known = F.broadcast(share.orderBy(F.desc("share"), "code").limit(grams).select("code"))
    counts: dict[str, dict[int, int]] = {}
    context: dict[str, dict[int, int]] = {}
    for r in counted.join(known, "code").collect():  # GRAMS x LANGS rows at most
        counts.setdefault(r.lang, {})[r.code] = r.n
    if not counts:
        return None
    pairs = counted.groupBy("lang", F.shiftright("code", 21).alias("pair")).agg(F.sum("n").alias("n"))
    for r in pairs.join(known.select(F.shiftright("code", 21).alias("pair")).distinct(), "pair").collect():
        context.setdefault(r.lang, {})[r.pair] = r.n
    return table_of(counts, {x: context.get(x, {}) for x in counts}, np.array(sorted({c for of in counts.values() for c in of}), np.int64))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = CHUNK // (len(held.value.langs) if held.value else 1)
        for b in batches:
            texts, begin, size = b.column(2).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= most or i + 1 == len(texts):
                    lang, score = predict(texts[begin : i + 1], held.value)
                    part = b.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])
                    begin, size = i + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(_fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
