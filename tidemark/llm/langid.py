"""Language ID by string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge regression.

A text's features are the buckets of its byte n-grams of 1 to ORDERS bytes (A-Z lower-cased; digits, punctuation and
control characters as one blank), each there or not. The kernel of two texts is the number of shared buckets over the
geometric mean of their numbers, over the buckets that some landmark has. Landmarks are labelled texts; one ridge
regression per language (targets 1 and -1, less what an even guess has) is solved in their Nyström feature space and folded back into one matrix, so
that a batch is scored by two products: presence by landmarks, and kernels by languages.

The model is fitted on a bounded sample: TRAIN_ROWS labelled texts, as even over languages as the labels allow, but of no
language fewer than LEAST_ROWS; chosen by a hash of the id; of each, TRAIN_CHARS code points from its first letter on.
Every language with a labelled text that has a letter is learned; landmarks grow with the languages, LEAST_LANDMARKS of
each at least. What comes to the driver is that sample; the model, which goes to every worker, has a bit for each bucket
and landmark. Prediction reads whole texts of any length, in pieces, with a block of landmarks unpacked at a time.

Letters are those of Unicode's categories L; null texts and texts without one are `und` with score 0. Without any labelled text every text is `und`. Of equal
scores the language first in code point order wins. Rows with a null id are never learned from and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches
from ._words import U64, mix64, text_bytes
from .mixing import seeded_uniform

ORDERS = 4
BITS = 20
TRAIN_ROWS = 1600
TRAIN_CHARS = 20_000
LEAST_ROWS = 8
LANDMARKS, LEAST_LANDMARKS = 128, 2
#: Landmarks that are unpacked for products at once.
BLOCK = 128
RIDGE = 1e-3
PIECE_BYTES = 1 << 19
PIECE_DOCS = 128
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FACTORS = [np.uint32(int(x) & 0xFFFFFFFF | 1) for x in mix64(np.arange(1, ORDERS + 1, dtype=U64))]
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # by bucket: its column in `landmarks`, or -1
    landmarks: list[np.ndarray]  # by block of landmarks: packed bits, columns by landmarks
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray  # by language: the value of a text that shares nothing with any landmark
    sizes: np.ndarray  # root of the buckets of each landmark
    dense: np.ndarray | None = None  # the only block for products, made where it is first needed


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte."""
    n = len(data) - order + 1
    code = data[:n].astype(np.uint32)
    for j in range(1, order):
        code |= data[j : n + j].astype(np.uint32) << np.uint32(8 * j)
    return (code * _FACTORS[order - 1] + _FACTORS[order - 1]) >> np.uint32(32 - BITS)


def _presence(data: np.ndarray, offs: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """uint8, texts by columns; `data` holds the texts from offs[0] on."""
    n = len(offs) - 1
    out = np.zeros(n * width, np.uint8)
    folded = _FOLD[data]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    for order in range(1, ORDERS + 1):
        if len(folded) < order:
            break
        at = column[buckets(folded, order)]
        first, last = owner[: len(at)], owner[order - 1 :]
        keep = (at >= 0) & (first == last)
        out[first[keep] * width + at[keep]] = 1
    return out.reshape(n, width)


def presence_batches(column: pa.Array, of: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Presence matrices of the texts, in order; a very long text is folded in piece by piece."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE_BYTES, "right")) - 1), lo + PIECE_DOCS)
        a, b = int(offs[lo]), int(offs[hi])
        if hi - lo == 1 and b - a > PIECE_BYTES:
            whole = np.zeros((1, width), np.uint8)
            for at in range(a, b, PIECE_BYTES):
                part = data[at : min(b, at + PIECE_BYTES + ORDERS - 1)]
                whole |= _presence(part, np.array([0, len(part)]), of, width)
            yield whole
        else:
            yield _presence(data[a:b], offs[lo : hi + 1] - a, of, width)
        lo = hi


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    landmarks = max(landmarks, LEAST_LANDMARKS * len(languages))
    # Landmarks in turn from each language.
    turn: dict[str, list[int]] = {k: [] for k in languages}
    for i, k in enumerate(labels):
        turn[k].append(i)
    order = [i for r in range(max(map(len, turn.values()))) for k in languages for i in turn[k][r : r + 1]]
    chosen = order[:landmarks]
    all_of = np.arange(1 << BITS, dtype=np.int32)
    seen = np.zeros(1 << BITS, bool)
    for i in chosen:
        for m in presence_batches(pa.array([texts[i]]), all_of, 1 << BITS):
            seen |= m[0].astype(bool)
    column = np.full(1 << BITS, -1, np.int32)
    column[seen] = np.arange(int(seen.sum()))
    width = max(1, int(seen.sum()))
    of_chosen = pa.array([texts[i] for i in chosen])
    blocks, sizes = [], []
    for at in range(0, len(chosen), BLOCK):
        marks = np.concatenate(list(presence_batches(of_chosen.slice(at, BLOCK), column, width)))
        sizes.append(np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.int64), 1)).astype(np.float32))
        blocks.append(np.packbits(np.ascontiguousarray(marks.T), axis=1))
    model = Model(languages, column, blocks, np.zeros((len(chosen), len(languages)), np.float32), np.full(len(languages), 2 / len(languages) - 1), np.concatenate(sizes))
    within = np.concatenate([kernels(model, m) for m in presence_batches(of_chosen, column, width)]).astype(np.float64)
    values, vectors = np.linalg.eigh(within)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = np.concatenate([kernels(model, m) for m in presence_batches(pa.array(texts), column, width)]).astype(np.float64) @ root
    targets = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0) - model.bias
    solved = np.linalg.solve(features.T @ features + RIDGE * len(texts) * np.eye(len(chosen)), features.T @ targets)
    model.weights, model.dense = (root @ solved).astype(np.float32), None
    return model


def kernels(model: Model, presence: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(presence.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    there, shared, n = presence.astype(np.float32), [], len(model.sizes)
    for i, packed in enumerate(model.landmarks):
        if model.dense is None or len(model.landmarks) > 1:
            model.dense = np.unpackbits(packed, axis=1, count=min(BLOCK, n - i * BLOCK)).astype(np.float32)
        shared.append(there @ model.dense)
    return np.concatenate(shared, axis=1) / own[:, None] / model.sizes


def predict(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the winning regression's value brought from -1..1 to 0..1."""
    letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    if model is None or not len(column):
        return [UNKNOWN] * len(column), np.zeros(len(column))
    scores = np.concatenate([kernels(model, m) @ model.weights + model.bias for m in presence_batches(column, model.column, len(model.landmarks[0]))])
    best = scores.argmax(axis=1)
    value = np.where(letters, np.clip((scores.max(axis=1) + 1) / 2, 0, 1), 0).astype(np.float64)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], value


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on labelled, not held-out (doc_id, text, lang) rows."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    each = max(LEAST_ROWS, rows // len(counts))
    u = seeded_uniform(F.col("doc_id"), "langid-1")
    # Twice the share in expectation, and all of a language with little more; the window then has a bounded number of rows per language.
    chances = docs.sparkSession.createDataFrame([(k, 1.0 if n <= 4 * each else 2.0 * each / n) for k, n in counts.items()], "lang string, chance double")
    few = labelled.join(F.broadcast(chances), "lang").filter(u < F.col("chance"))
    piece = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, TRAIN_CHARS)
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    sample = few.select("lang", "doc_id", piece.alias("text"), u.alias("u")).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= each)
    kept = sorted(sample.select("u", "doc_id", "text", "lang").collect())
    return fit([r.text for r in kept], [r.lang for r in kept])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        for texts in batches:
            names, scores = predict(held, texts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    found = docs.drop("lang_pred", "score").withColumn("_language", language(F.col(text)))
    return found.select("*", "_language.lang_pred", "_language.score").drop("_language")
