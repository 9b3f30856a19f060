"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network (operator 10).

Words are runs other than white space. A word is known by itself (the VOCABULARY most frequent of the sample) and by its
shape (upper, lower and mixed case, digits, punctuation); a word equal to the one before also counts as a repetition.
Random indexing: each of these has a fixed sparse ternary index vector made from a hash of its name; its vector is
that plus the normalised sum of the index vectors of its neighbours within WINDOW words, over the sample. A document is
the mean of its words' vectors, over its whole text. A network (one tanh layer, one logistic unit) in numpy gives the
score; a temperature fitted on a fold of its own calibrates it. Texts alone are inputs.

Fitting uses a bounded sample of labelled documents: PER_CLASS of each label at most, picked by a hash of the id and weighted to
the labels' true shares; each of them is read whole, however long. Their texts stay on the executors, in a table: tasks
count names, then add up neighbours, then pool documents, and the driver gets the VOCABULARY and SHAPES most frequent names, a
matrix of at most that many rows from each of PARTS tasks, and a vector of each document. Scoring has no such bound. Rows
whose crc32(id as text) mod 4 is 2 are held out, and those with 3 calibrate. Labels that are null or not 0 or 1 are left
out; of several labels of an id the least counts, and of several texts the one with the largest hash. With one label value in the
sample, every score is that label's share, and with none 0.5. A null or empty text has one word with an empty name.
Repeated rows each give a score; an empty table gives no rows and a model without labels. Only the named columns are read;
keep_good() keeps all, whatever they are called.
"""

from __future__ import annotations

import itertools
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize

PER_CLASS, VOCABULARY, SHAPES, DIM, NONZERO, WINDOW, HIDDEN = 3000, 4096, 1024, 64, 6, 2, 24
CACHE, PARTS = 200_000, 16
#: Longer words are known by their shape alone.
LONG = 64
_TAIL = string.punctuation


def shape(word: str) -> str:
    core = word.rstrip(_TAIL)
    tail = "".join(dict.fromkeys(word[len(core) :]))[:4]
    if core.isalpha():
        kind = "x" if core.islower() else "X" if core.isupper() and len(core) > 1 else "Xx" if core[1:].islower() or len(core) == 1 else "xX"
    else:
        kind = "".join(dict.fromkeys("9" if c.isdigit() else "x" if c.isalpha() else c for c in core))[:6]
    return f"{kind} {tail}"


def index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
    v = np.zeros(DIM, np.float32)
    v[rng.permutation(DIM)[:NONZERO]] = rng.choice((-1.0, 1.0), NONZERO)
    return v


class _Rows(dict):
    """Word to row of the vector table; shapes stand for words that are not known."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]) -> None:
        super().__init__(words)
        self.words, self.shapes = words, shapes

    def __missing__(self, word: str) -> int:
        row = self.shapes.get(shape(word), 0)
        if len(word) < 40:
            self[word] = row
        return row

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self.update(self.words)


@dataclass
class Model:
    """Vectors of shapes (row 0: any other) and words, the repetition's vector, and the network."""

    words: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    repeated: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    net: dict[str, np.ndarray] | None = None
    temperature: float = 1.0
    share: float = 0.5
    labelled: bool = True

    def rows(self) -> _Rows:
        return _Rows(self.words, self.shapes)

    def pooled(self, text: str | None, rows: _Rows) -> np.ndarray:
        words = (text or "").split() or [""]
        at = np.fromiter(map(rows.__getitem__, words), np.int32, len(words))
        total = np.zeros(DIM)
        for i in range(0, len(at), 1 << 16):
            total += self.table[at[i : i + (1 << 16)]].sum(0)
        again = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
        return (total + again * self.repeated) / len(words)

    def logits(self, x: np.ndarray) -> np.ndarray:
        n = self.net
        return np.tanh((x - n["mean"]) / n["scale"] @ n["w1"] + n["b1"]) @ n["w2"] + n["b2"]

    def scores(self, texts: list[str | None], rows: _Rows) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        x = np.stack([self.pooled(t, rows) for t in texts]) if texts else np.zeros((0, DIM))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def name_counts(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each word and each shape occurs."""
    words, shapes = Counter(), Counter()
    for t in texts:
        split = t.split()
        words.update(w for w in split if len(w) <= LONG)
        shapes.update(map(shape, split))
    return words, shapes


def index(words: list[str], shapes: list[str]) -> tuple[Model, np.ndarray]:
    """A model of these names, its table still empty, and the index vector of each row."""
    shape_rows = {s: i + 1 for i, s in enumerate(shapes)}
    model = Model({w: len(shape_rows) + 1 + i for i, w in enumerate(words)}, shape_rows)
    of_shape = np.stack([index_vector("shape ?"), *(index_vector(f"shape {s}") for s in shapes)])
    own = [of_shape[shape_rows.get(shape(w), 0)] + index_vector(f"word {w}") for w in words]
    return model, np.concatenate([of_shape, np.stack(own)]) if own else of_shape


def neighbours(texts: Iterable[str], model: Model, own: np.ndarray) -> np.ndarray:
    """For each row, the sum of the index vectors of what stands within WINDOW words of it."""
    around, rows = np.zeros_like(own, dtype=np.float64), model.rows()
    for t in texts:
        at = np.fromiter(map(rows.__getitem__, t.split()), np.int32)
        for i in range(0, len(at), 1 << 15):
            part = at[max(0, i - WINDOW) : i + (1 << 15) + WINDOW]
            near = np.zeros((len(part), DIM), np.float32)
            for d in range(1, min(WINDOW, len(part) - 1) + 1):
                near[d:] += own[part[:-d]]
                near[:-d] += own[part[d:]]
            inside = slice(min(i, WINDOW), min(i, WINDOW) + len(at[i : i + (1 << 15)]))
            part, near = part[inside], near[inside]
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            around[part[order][first]] += np.add.reduceat(near[order], first, axis=0)
        rows.trim()
    return around


def finish(model: Model, own: np.ndarray, around: np.ndarray) -> Model:
    norm = np.linalg.norm(around, axis=1, keepdims=True)
    model.table = (own + np.divide(around, norm, out=np.zeros_like(around), where=norm > 0)).astype(np.float32)
    model.repeated = 4 * index_vector("repetition")
    return model


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 120) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    scale = x.std(0) + 1e-3
    z = (x - x.mean(0)) / scale
    p = {"w1": rng.standard_normal((DIM, HIDDEN)) / np.sqrt(DIM), "b1": np.zeros(HIDDEN), "w2": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[part] @ p["w1"] + p["b1"])
            error = weight[part] * (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - y[part]) / len(part)
            back = np.outer(error, p["w2"]) * (1 - h * h)
            grad = {"w1": z[part].T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ error + 1e-4 * p["w2"], "b2": np.array([error.sum()])}
            step += 1
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": x.mean(0), "scale": scale}


def _fold(id_col: F.Column) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(part, id, text, y, fold) of the sample, and how many labels of each value there are to learn from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = known.withColumn("fold", _fold(F.col("id"))).where("fold <> 2")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").groupBy("id").agg(F.max(F.struct(F.xxhash64("text"), "text", "y", "fold")).alias("x"))
    return sample.select(F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), "id", "x.text", "x.y", "x.fold"), counts


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample (see above); the network is trained on the driver."""
    sample, counts = labelled_sample(docs, labels, text_col, id_col, label_col, per_class)
    sample = materialize(sample.repartition(PARTS, "part").sortWithinPartitions("part", "id"))
    spark = docs.sparkSession

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        return (t for b in batches for t in b.column("text").to_pylist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of_words, names in zip((True, False), name_counts(texts(batches))):
            yield pa.RecordBatch.from_pydict({"is_word": [of_words] * len(names), "name": list(names), "n": list(names.values())}, pa.schema([("is_word", pa.bool_()), ("name", pa.string()), ("n", pa.int64())]))

    learning = sample.where("fold <> 3")
    names = learning.mapInArrow(count, "is_word boolean, name string, n long").groupBy("is_word", "name").agg(F.sum("n").alias("n"))
    words, shapes = ([r.name for r in names.where(F.col("is_word") == w).orderBy(F.desc("n"), "name").limit(most).collect()] for w, most in ((True, VOCABULARY), (False, SHAPES)))
    model, own = index(words, shapes)
    shared = spark.sparkContext.broadcast((model, own))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The files have part after part; texts are read one after another and none is kept."""
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for part, of_part in itertools.groupby(rows, key=lambda x: x[0]):
            around = neighbours((t for _, t in of_part), *shared.value).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([around], pa.binary())], ["part", "around"])

    parts = learning.select("part", "text").mapInArrow(add, "part int, around binary").collect()  # a matrix of each part, or two where a file is read in two
    parts.sort(key=lambda r: (r.part, r.around))
    model = finish(model, own, sum((np.frombuffer(r.around, np.float32).reshape(own.shape).astype(np.float64) for r in parts), np.zeros(own.shape)))
    ready = spark.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ready.value.rows()
        for batch in batches:
            x = pa.array([ready.value.pooled(t, found) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), x], names=["key", "y", "fold", "x"])

    pooled = sample.select("text", F.xxhash64("id").alias("key"), "y", "fold").mapInArrow(pool, "key long, y int, fold long, x array<double>")
    rows = sorted(map(tuple, pooled.collect()))  # 2 * per_class vectors; sorted, so fitting does not depend on their order
    drop(sample)
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(share=float(y.mean()) if len(y) else 0.5, labelled=bool(len(y)))
    fold, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    weight /= weight.mean()
    learn = fold != 3 if len(set(y[fold != 3].tolist())) == 2 else np.full(len(y), True)
    model.net = _train(x[learn], y[learn], weight[learn])
    check = ~learn
    if len(set(y[check].tolist())) == 2:
        z = model.logits(x[check])

        def loss(t: float) -> float:
            return float((weight[check] * np.logaddexp(0, np.where(y[check] == 1, -z, z) / t)).sum())

        model.temperature = float(min(np.geomspace(0.25, 4, 65), key=loss))
    return model


def _scorer(model: Model, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(rows: _Rows | None, texts: list[str | None]) -> tuple[_Rows, np.ndarray]:
        rows = rows if rows is not None else shared.value.rows()
        found = shared.value.scores(texts, rows)
        rows.trim()
        return rows, found

    return scores


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, held_out, score, predicted."""
    scores, kind = _scorer(model, docs), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            rows, found = scores(rows, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return made.select(F.col("id").alias(id_col), F.coalesce(_fold(F.col("id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with the columns of ``docs``; rows never shuffle. A model that saw no
    label at all can reject nothing, so all documents stay."""
    if not model.labelled:
        return docs
    scores, at = _scorer(model, docs), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            rows, found = scores(rows, batch.column(at).to_pylist())
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
