"""Language identification with string kernels.

The kernel of two blocks of text is the cosine of the presence of their character n-grams, n = 1 to 4 blended: shared distinct
n-grams over the root of the product of their numbers.  A text of more than BLOCK letters is several blocks, weighted
by their letters, and the kernel of two texts the cosine of their mean embeddings: presence is that of a block and
doesn't fill up, however long the text.  Nystroem landmarks stand for the corpus: with K the kernel among landmarks,
K^(-1/2) maps a text's kernels with them to features, on which one-versus-rest kernel ridge regression is fitted.  Both
maps are linear, so scoring a batch is two matrix products: texts times the landmarks, times one matrix of weights;
they are multiplied together once, beforehand.

N-grams are taken within words padded by a space, words being runs of letters of the lower-cased whole text; their
hashes fall into SLOTS slots, presence being that of a slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import cut, scope, ship
from .rows import append


SLOTS = 1 << 15
GRAMS = 4
#: Letters of a block; characters that are looked at together.
BLOCK, PIECE = 4096, 1 << 20
#: Bounds of the labelled sample: rows for each language, languages, rows in all, and bytes of their vectors in all.
SAMPLE, LANGUAGES, ROWS, FIT_BYTES = 300, 256, 1 << 14, 256 << 20
#: Landmarks for each language, and in all.
LANDMARKS, MAX_LANDMARKS = 50, 1 << 11

#: A text is familiar if its share of known n-grams is at least this part of the least among the language's sampled rows
#: beside the landmarks, of which there must be ENOUGH.
SLACK, ENOUGH = 0.75, 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the blocks of a text, words apart by one space; blocks end at the end of a word, but for longer words."""
    for at in range(0, len(text), PIECE):
        cp = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letter_table()[cp]
        if not letter.any():
            continue
        if not letter.all():  # runs of anything else become one space
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            cp = np.where(letter, cp, 32)[keep]
        spaces, a = np.flatnonzero(cp == 32), 0
        while a < len(cp):
            b = len(cp)
            if b - a > BLOCK:
                i = int(np.searchsorted(spaces, a + BLOCK, "right")) - 1
                b = int(spaces[i]) if i >= 0 and spaces[i] > a else a + BLOCK
            part, a = cp[a:b], b
            part = part[int(part[0] == 32) : len(part) - int(part[-1] == 32)]
            if len(part):
                yield np.concatenate([[32], part, [32]]).astype(np.uint64)


def _presence(cp: np.ndarray) -> np.ndarray:
    """Sorted slots of the n-grams of a block."""
    seen, h = np.zeros(SLOTS, bool), np.zeros(len(cp), np.uint64)
    space = cp == 32
    inner = np.zeros(len(cp), bool)
    for n in range(1, min(GRAMS, len(cp)) + 1):
        m = len(cp) - n + 1
        h = h[:m] * np.uint64(0x100000001B3) + cp[n - 1 :]
        if n > 2:  # none across words: a space only at either end
            inner = inner[:m] | space[n - 2 : n - 2 + m]
            g = h[~inner[:m]]
        else:
            g = h
        seen[(((g + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


class Vector(NamedTuple):
    """The unit mean embedding of a text: slots and their values."""

    slots: np.ndarray  # uint16
    values: np.ndarray  # float32, or one for all


def embed(text: str | None) -> Vector | None:
    """None for a text without letters."""
    found = [(len(b), _presence(b)) for b in _blocks(text)] if text and len(text) <= PIECE else None
    if found is not None and len(found) <= 1:
        return Vector(found[0][1].astype(np.uint16), np.array([len(found[0][1]) ** -0.5], np.float32)) if found else None
    total = np.zeros(SLOTS)
    for n, slots in found if found is not None else ((len(b), _presence(b)) for b in _blocks(text or "")):
        total[slots] += n / np.sqrt(len(slots))
    if not total.any():
        return None
    slots = np.flatnonzero(total)
    return Vector(slots.astype(np.uint16), (total[slots] / np.sqrt(total @ total)).astype(np.float32))


def _dense(vectors: list[Vector]) -> np.ndarray:
    x = np.zeros((len(vectors), SLOTS), np.float32)
    for row, v in zip(x, vectors):
        row[v.slots] = v.values
    return x


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages: landmarks times their weights
    known: np.ndarray  # SLOTS x languages: 1 for the n-grams of a language's landmarks
    offset: np.ndarray
    scale: float
    least: np.ndarray  # for each language the familiarity below which a text is none of it


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """The model of these texts; those without letters are left out."""
    return fit_vectors([embed(t) for t in texts], labels, landmarks, ridge)


def fit_vectors(vectors: list[Vector | None], labels: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features.

    The first ``landmarks`` texts of each language are the landmarks, fewer if all would be more than MAX_LANDMARKS.
    Without any usable text the model knows nothing.  Matrices: MAX_LANDMARKS x SLOTS floats and rows x MAX_LANDMARKS doubles at most.
    """
    rows = [(v, y) for v, y in zip(vectors, labels) if v is not None]
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0, np.zeros(0))
    y = np.array([y for _, y in rows])
    marks = [np.flatnonzero(y == c)[: max(1, min(landmarks, MAX_LANDMARKS // len(languages)))] for c in languages]
    land = _dense([rows[i][0] for m in marks for i in m])
    value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    known, at = np.zeros((SLOTS, len(languages)), np.float32), np.cumsum([0, *map(len, marks)])
    for c in range(len(languages)):
        known[:, c] = land[at[c] : at[c + 1]].any(0)
    kernels, familiar = [], []
    for a in range(0, len(rows), 256):
        x = _dense([v for v, _ in rows[a : a + 256]])
        kernels.append((x @ land.T).astype(np.float64))
        familiar.append((x @ known) / x.sum(1, keepdims=True))
    features, familiar = np.concatenate(kernels) @ root, np.concatenate(familiar)
    target = np.where(y[:, None] == np.array(languages), 1.0, -1.0)
    weight = 1 / np.array([np.sum(y == c) for c in y])  # each language counts alike
    weight *= len(y) / weight.sum()
    mean = (weight[:, None] * features).sum(0) / weight.sum()
    centre = (weight[:, None] * target).sum(0) / weight.sum()
    f, t = features - mean, target - centre
    w = np.linalg.solve((f * weight[:, None]).T @ f + ridge * len(y) * np.eye(f.shape[1]) / f.shape[1], (f * weight[:, None]).T @ t)
    others = [np.setdiff1d(np.flatnonzero(y == c), m) for c, m in zip(languages, marks)]
    least = np.array([SLACK * familiar[o, c].min() if len(o) >= ENOUGH else 0.0 for c, o in enumerate(others)])
    return Model(languages, (land.T.astype(np.float64) @ (root @ w)).astype(np.float32), known, centre - mean @ w, 4.0, least)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """(languages, scores, familiar): ``und``, 0 and False for a text that is null or has no letter, or if the model knows no language.

    A score is the probability of the prediction by the softmax of the regressions; ties take the first language by name.
    A text is familiar if the share of its n-grams, by their values, that the prediction's landmarks have is at least
    the model's threshold for it, however many languages there are.
    """
    found = [embed(t) for t in texts]
    names, scores, familiar = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    at = [i for i, v in enumerate(found) if v is not None]
    both, n = np.concatenate([model.weights, model.known], 1), len(model.languages)
    for a in range(0, len(at) if n else 0, 128):
        part = at[a : a + 128]
        x = _dense([found[i] for i in part])
        y = (x @ both).astype(np.float64)
        z = y[:, :n] + model.offset
        e = np.exp(model.scale * (z - z.max(1, keepdims=True)))
        best, each = z.argmax(1), np.arange(len(part))
        p = e[each, best] / e.sum(1)
        known = y[each, n + best] / x.sum(1) >= model.least[best]
        for i, b, q, k in zip(part, best.tolist(), p.tolist(), known.tolist()):
            names[i], scores[i], familiar[i] = model.languages[b], min(1.0, max(0.0, q)), k
    return names, scores, familiar


def train(rows: DataFrame, sample: int = SAMPLE, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", languages: int = LANGUAGES, landmarks: int = LANDMARKS, total: int = ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """A model from a bounded sample: for each language the rows with the smallest hashes of their id, ``sample`` at most.

    Rows with a null label, text or id are left out.  Of the labels the ``languages`` most frequent ones are learned.  The
    sample has ``total`` rows at most, and its vectors ``fit_bytes`` bytes, both shared out evenly to the labels; each
    has one row at least.  Texts are embedded whole, where they are read; the driver gets their vectors.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = rows.groupBy(F.col(label_col).alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(languages).collect()
    if not counts:
        return fit_vectors([], [], landmarks)
    sample = max(1, min(sample, total // len(counts)))
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40))
    # a threshold on the hash that lets through about 1.3 times the sample of each language
    chosen = F.coalesce(*[F.when(F.col(label_col) == r.y, h < int(min(1.0, (sample * 1.3 + 50) / r.n) * (1 << 40))) for r in counts], F.lit(False))

    def embedded(batches):
        for b in batches:
            found = [(i, v) for i, t in enumerate(b.column(2)) if (v := embed(t.as_py())) is not None]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([v.slots.tobytes() for _, v in found], pa.binary()), pa.array([v.values.tobytes() for _, v in found], pa.binary())], ["y", "h", "slots", "values"])

    with scope(spark):
        found = cut(rows.where(chosen).select(F.col(label_col).alias("y"), h.alias("h"), F.col(text_col).alias("t")), by=embedded, batch=64, schema="y string, h long, slots binary, values binary")
        sizes = found.select("y", "h", (F.length("slots") + F.length("values")).alias("size")).orderBy("y", "h").limit(2 * (sample + 50) * len(counts)).collect()
        last: dict[str, list[int]] = {}  # rows and bytes so far, and the last hash that fits
        for r in sizes:
            n, size, _ = last.get(r.y, (0, 0, -1))
            if n < sample and (not n or size + r.size <= fit_bytes // len(counts)):
                last[r.y] = [n + 1, size + r.size, r.h]
        taken = spark.createDataFrame([(y, h) for y, (*_, h) in last.items()], "y string, last long")
        kept = found.join(F.broadcast(taken), "y").where("h <= last").orderBy("y", "h", "slots", "values").select("y", "slots", "values").limit(sum(n for n, *_ in last.values())).collect() if last else []
    return fit_vectors([Vector(np.frombuffer(r.slots, np.uint16), np.frombuffer(r["values"], np.float32)) for r in kept], [r.y for r in kept], landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and familiar, from whole texts alone; other columns pass through, save those of these names.

    A null or empty text, or one without letters, is ``und`` with score 0 and not familiar; repeated rows and null ids are
    rows like others.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(b: pa.RecordBatch, held: Model) -> list:
        out = [[], [], []]
        for i in range(0, b.num_rows, 128):
            for column, x in zip(out, predict(held, b.column(at).slice(i, 128).to_pylist())):
                column += x
        return out

    return append(docs, "lang_pred string, score double, familiar boolean", score, lambda: shared.value)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text", "familiar")


QUERIES = {"op6_language_id": op6_language_id}
