"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bandweave.session import collect_bounded, cut_lineage

from .text import sliced

SYMBOLS = 0x110000
ORDERS = 3
SAMPLE_PER_LANGUAGE = 2_000
LANDMARKS = 256
MAX_LANGUAGES = 200
RIDGE = 1e-3
ROWS = 64
COLUMNS = 16_384
DENSE = 1 << 25


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts and the offsets of each."""
    low = [t.lower() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), off


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbol_table(letters: np.ndarray) -> np.ndarray:
    """Symbol of each code point: a letter is its own symbol, anything else 0."""
    return np.where(letters, np.arange(len(letters), dtype=np.int32), 0)


def text_grams(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each distinct run of 1 to ORDERS symbols in each text, in order. Runs of blanks alone do not count.

    The number of a run is exact: its symbols as digits to the base SYMBOLS, after the numbers of all shorter runs.
    """
    n = len(off) - 1
    used = np.zeros(SYMBOLS, bool)
    used[symbols] = used[0] = True
    used = np.flatnonzero(used)
    place, base = np.zeros(SYMBOLS, np.int64), len(used)
    place[used] = np.arange(base)
    local, owner = place[symbols], np.repeat(np.arange(n), np.diff(off))
    owners, numbers, value, first = [], [], np.zeros(len(symbols), np.int64), 0
    for size in range(1, ORDERS + 1):
        if len(symbols) < size:
            break
        value = value[:len(symbols) - size + 1] * base + local[size - 1:]
        inside = (owner[:len(value)] == owner[size - 1:]) & (value > 0)
        space = base ** size
        keys = owner[:len(value)][inside] * space + value[inside]
        if n * space <= DENSE:
            has = np.zeros(n * space, bool)
            has[keys] = True
            keys = np.flatnonzero(has)
        else:
            keys = np.unique(keys)
        whose, rest = np.divmod(keys, space)
        number, scale = np.full(len(rest), first, np.int64), 1
        for _ in range(size):
            rest, digit = np.divmod(rest, base)
            number += used[digit] * scale
            scale *= SYMBOLS
        owners.append(whose)
        numbers.append(number)
        first += SYMBOLS ** size
    none = np.zeros(0, np.int64)
    owner, number = np.concatenate([none, *owners]), np.concatenate([none, *numbers])
    order = np.argsort(owner, kind="stable")
    return owner[order], number[order]


@dataclass
class Classifier:
    """Landmark columns (grams that any landmark has), the landmarks as bits of each column, and the ridge weights."""
    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray


def kernel(symbols: np.ndarray, off: np.ndarray, columns: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shared grams over the geometric mean of the gram numbers, of each text with each landmark; COLUMNS grams at a time."""
    owner, gram = text_grams(symbols, off)
    own = np.maximum(np.bincount(owner, minlength=len(off) - 1), 1)
    at = np.searchsorted(columns, gram)
    hit = columns[np.minimum(at, len(columns) - 1)] == gram if len(columns) else np.zeros(len(gram), bool)
    owner, at = owner[hit], at[hit]
    shared = np.zeros((len(off) - 1, len(sizes)), np.float32)
    for start in range(0, len(columns), COLUMNS):
        inside = (at >= start) & (at < start + COLUMNS)
        bits = np.unpackbits(landmarks[start:start + COLUMNS], axis=1, count=len(sizes)).astype(np.float32)
        rows = np.zeros((len(off) - 1, len(bits)), np.float32)
        rows[owner[inside], at[inside] - start] = 1
        shared += rows @ bits
    return (shared / np.sqrt(own[:, None] * np.maximum(sizes, 1)[None, :])).astype(np.float64)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def drawn(docs: DataFrame, trusted: Column, sample: int) -> tuple[list[str], DataFrame]:
    """Languages of the trusted rows and at most ``sample`` different texts of each, by a hash of the text.

    The bar of a language comes from the number of its different texts, so copies neither fill its places nor
    keep them empty.
    """
    labelled = docs.where(trusted & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counted = labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n"))
    sizes = {r["lang"]: r["n"] for r in collect_bounded(counted, MAX_LANGUAGES, "languages")}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    bar = F.lit(0)
    for lang, n in sizes.items():
        bar = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * sample / n) * (1 << 40)))).otherwise(bar)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    picked = labelled.withColumn("draw", draw).where(F.col("draw") < bar).distinct().withColumn("place", place).where(F.col("place") <= sample)
    return sorted(sizes), cut_lineage(picked.select("lang", "place", "text"))


def train(docs: DataFrame, trusted: Column, sample: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """A classifier from ``text`` and ``lang`` of the rows where ``trusted`` holds.

    It is fitted on at most ``sample`` hash-drawn different texts of each language. Rows with a null text or lang take no part;
    repeated rows count once, ties of the draw go by text; an empty table gives a model that knows no language. Only text and lang
    are read, besides what ``trusted`` reads. Every letter of Unicode is a symbol of its own,
    so grams of any script count. The first texts of each language, ``landmarks`` in all, are the landmarks; the kernel matrix among them gives
    the Nyström projection. Tasks add up the normal equations of the ridge regression, one sum of
    landmarks x landmarks values a task.
    """
    languages, picked = drawn(docs, trusted, sample)
    if not languages:
        none = np.zeros((0, 0))
        return Classifier([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros(0), none)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(letter_table())
        for batch in sliced(batches, "text"):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                points, off = code_points(texts_of(part.column(0)))
                owner, gram = text_grams(table[points], off)
                sets = np.split(gram, np.searchsorted(owner, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["grams"])

    each = max(1, landmarks // len(languages))
    chosen = picked.where(F.col("place") <= each).select("text").mapInArrow(grams, "grams array<long>").collect()
    sets = [np.array(r["grams"], np.int64) for r in chosen]
    columns = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]))
    marks = np.zeros((len(columns), -(-len(sets) // 8)), np.uint8)
    for k, own in enumerate(sets):
        marks[np.searchsorted(columns, own), k // 8] |= 128 >> k % 8
    sizes = np.array([len(s) for s in sets], float)
    among = np.zeros((len(sets), len(sets)))
    for start in range(0, len(columns), COLUMNS):
        bits = np.unpackbits(marks[start:start + COLUMNS], axis=1, count=len(sets)).astype(np.float32)
        among += bits.T @ bits
    among /= np.sqrt(np.maximum(sizes, 1)[:, None] * np.maximum(sizes, 1)[None, :])
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max(initial=1e-6)
    project = vectors[:, keep] / np.sqrt(values[keep])
    width = int(keep.sum()) + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(letter_table())
        left, right = np.zeros((width, width)), np.zeros((width, len(languages)))
        for batch in sliced(batches, "text"):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                points, off = code_points(texts_of(part.column(1)))
                x = np.column_stack([kernel(table[points], off, columns, marks, sizes) @ project, np.ones(part.num_rows)])
                y = np.array([[lang == name for name in languages] for lang in part.column(0).to_pylist()], float)
                left += x.T @ x
                right += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([left.ravel()], pa.list_(pa.float64())), pa.array([right.ravel()], pa.list_(pa.float64()))], names=["left", "right"])

    sums = picked.select("lang", "text").repartition(16).mapInArrow(equations, "left array<double>, right array<double>").collect()
    left = sum(np.array(r["left"]).reshape(width, width) for r in sums)
    right = sum(np.array(r["right"]).reshape(width, len(languages)) for r in sums)
    beta = np.linalg.solve(left + ridge * np.trace(left) / width * np.eye(width), right)
    return Classifier(languages, columns, marks, sizes, np.vstack([project @ beta[:-1], beta[-1:]]))


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with lang_pred and score added (both replaced if present); every whole text is scored.

    score is the part of the winning language in the positive ridge outputs (0 to 1). Null text and text without
    a letter (Unicode L*) are ``und`` with score 0, as is everything if no language was learned. Ties go to the
    first language by name. Repeated rows are scored each; nulls in other columns do not matter.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = letter_table()
        table = symbol_table(known)
        for batch in sliced(batches, "text"):
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                points, off = code_points(texts_of(part.column("text")))
                named, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if model.languages:
                    letters = np.concatenate([[0], np.cumsum(known[points])])
                    some = letters[off[1:]] > letters[off[:-1]]
                    out = kernel(table[points], off, model.columns, model.landmarks, model.sizes) @ model.weights[:-1] + model.weights[-1]
                    best, positive = np.argmax(out, axis=1), np.clip(out, 0, None)
                    whole = positive.sum(axis=1)
                    share = np.where(whole > 0, positive.max(axis=1) / np.where(whole > 0, whole, 1), 1 / len(model.languages))
                    named = [model.languages[b] if s else "und" for b, s in zip(best, some)]
                    score = np.where(some, share, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(score)], names=names)

    plain = docs.drop("lang_pred", "score")
    names = [*plain.columns, "lang_pred", "score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(modulus: int = 4, rest: int = 2) -> Column:
    """Is the CRC-32 of doc_id as text in the held-out class? False for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))
