"""Quality by distribution divergence: Jensen-Shannon distance of a text's histograms to its language's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bandweave.session import collect_bounded, cut_lineage

from .text import SpanHasher, flat, sliced, space_table, spans, windows, words

# ---- fixed values: the contract's symbols, and the character classes of the histogram ----
SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "blank", "mark", "symbol", "control", "beyond"]
# ---- end of fixed values ----
COMMON_WORDS = 200
MAX_LANGUAGES = 256
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.58


def class_table() -> np.ndarray:
    """Character class of each byte; 8 for bytes that continue a character."""
    table = np.full(256, CLASSES.index("mark"), np.int64)
    table[:32], table[127] = CLASSES.index("control"), CLASSES.index("control")
    table[97:123], table[65:91], table[48:58] = CLASSES.index("lower"), CLASSES.index("upper"), CLASSES.index("digit")
    table[space_table()] = CLASSES.index("blank")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[128:192], table[192:] = len(CLASSES), CLASSES.index("beyond")
    return table


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values within each text."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[off[1:]] - running[off[:-1]]


@dataclass
class Looked:
    """What one slice of texts gives: the contract's counts and the histograms' raw material."""
    base: dict[str, np.ndarray]
    classes: np.ndarray
    word: np.ndarray
    doc: np.ndarray


def repeated_later(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of positions in order: is the value equal to that of an earlier position of the same owner?"""
    order = np.lexsort([np.arange(len(values)), values, owner])
    same = np.zeros(len(values), bool)
    same[order[1:]] = (values[order[1:]] == values[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return same


def look(texts: pa.Array, exact: SpanHasher, lower: SpanHasher) -> Looked:
    data, off = flat(texts)
    n, kind = len(texts), class_table()[data]
    start, end, doc = words(data, off)
    starts_char = (data & 0xC0) != 0x80
    blank = space_table()[data]
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    hashes = exact(data, start, end)
    at, triple = windows(hashes, doc, 3)
    again = repeated_later(doc[at], triple)
    twice = again.copy()
    order = np.lexsort([np.arange(len(at)), triple, doc[at]])
    twice[order[:-1]] |= again[order[1:]]
    covered = np.zeros(len(start) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    lstart, lend, ldoc = spans(data != 10, off)
    lined = np.searchsorted(start, lend) > np.searchsorted(start, lstart)
    lines, ldoc = exact(data, lstart[lined], lend[lined]), ldoc[lined]
    base = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_text(starts_char & ~blank, off), "n_symbols": per_text(symbol, off),
            "n_dup_lines": np.bincount(ldoc, repeated_later(ldoc, lines), n).astype(np.int64),
            "n_repeat_words": np.bincount(doc, covered[:len(start)], n).astype(np.int64)}
    owner = np.repeat(np.arange(n), np.diff(off))
    wide = len(CLASSES) + 1
    classes = np.bincount(owner * wide + kind, minlength=n * wide).reshape(n, wide)[:, :-1]
    return Looked(base, classes, lower(data, start, end), doc)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1) of rows of counts or shares; no counts give 0."""
    def shares(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(axis=-1)

    some = p.sum(axis=-1) > 0
    p, q = shares(p.astype(float)), shares(q.astype(float))
    return np.where(some, np.sqrt(np.clip(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0, 1)), 0.0)


@dataclass
class References:
    """For each language: counts of character classes, the common words' hashes (sorted) and counts, last the count of all other words."""
    languages: list[str]
    classes: np.ndarray
    words: list[np.ndarray]
    counts: list[np.ndarray]


def language_references(docs: DataFrame, common_words: int = COMMON_WORDS) -> References:
    """References from every text with a non-null lang. Tasks sum words by hash before the shuffle; the driver
    gets common_words rows for each of at most MAX_LANGUAGES languages."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = SpanHasher(lower=True)
        for batch in sliced(batches, "text"):
            names = batch.column(0).dictionary_encode()
            lang, n = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names.dictionary)
            data, off = flat(batch.column(1))
            start, end, doc = words(data, off)
            keys, own = lower(data, start, end), lang[doc]
            order = np.lexsort([keys, own])
            keys, own = keys[order], own[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(keys)))
            kind = class_table()[data]
            wide = len(CLASSES) + 1
            classes = np.bincount(np.repeat(lang, np.diff(off)) * wide + kind, minlength=n * wide).reshape(n, wide)[:, :-1]
            which = np.concatenate([own[new], np.repeat(np.arange(n), len(CLASSES))])
            yield pa.RecordBatch.from_arrays([
                names.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(np.repeat([0, 1], [len(new), n * len(CLASSES)]).astype(np.int32)),
                pa.array(np.concatenate([keys[new].view(np.int64), np.tile(np.arange(len(CLASSES)), n)])), pa.array(np.concatenate([count, classes.ravel()]))], schema=schema)

    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counted = cut_lineage(known.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counted.where("kind = 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= common_words)
    bound = MAX_LANGUAGES * (common_words + len(CLASSES))
    rows = collect_bounded(top.select("lang", "kind", "key", "n").unionByName(counted.where("kind = 1")), bound, "language references")
    totals = {r["lang"]: r["n"] for r in collect_bounded(counted.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")), MAX_LANGUAGES, "languages")}
    languages = sorted({r["lang"] for r in rows})
    classes, names, counts = np.zeros((len(languages), len(CLASSES))), [], []
    for k, lang in enumerate(languages):
        own = sorted((r["key"] % (1 << 64), r["n"]) for r in rows if r["lang"] == lang and r["kind"] == 0)
        names.append(np.array([h for h, _ in own], np.uint64))
        counts.append(np.array([*[n for _, n in own], totals.get(lang, 0) - sum(n for _, n in own)], float))
        for r in rows:
            if r["lang"] == lang and r["kind"] == 1:
                classes[k, r["key"]] = r["n"]
    return References(languages, classes, names, counts)


def quality(docs: DataFrame, references: References | None = None, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS,
            max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept of each row.

    A text is compared with its own language's reference, with null or unknown lang with the nearest (least
    sum of both distances). Guards: class histograms are judged from ``min_chars`` characters, word histograms
    from ``min_words`` words; shorter texts get the distance but no verdict from it. kept is false if
    base_failed (n_words < 50 or 100 n_repeat_words > 50 n_words), or a judged distance is beyond its maximum.

    Null and empty texts: zero counts, distances 0, base_failed. Repeated rows are judged each; a null doc_id is
    kept. Without any language the distances are 0. Only doc_id, text and lang are read.
    """
    refs = references or language_references(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, lower = SpanHasher(), SpanHasher(lower=True)
        every = np.unique(np.concatenate(refs.words)) if refs.languages else np.zeros(0, np.uint64)
        place = [np.searchsorted(every, w) for w in refs.words]
        for batch in sliced(batches, "text"):
            seen, n = look(batch.column(1), exact, lower), batch.num_rows
            at = np.searchsorted(every, seen.word)
            hit = (at < len(every)) & (every[np.minimum(at, max(len(every) - 1, 0))] == seen.word if len(every) else False)
            table = np.bincount(seen.doc[hit] * max(len(every), 1) + at[hit], minlength=n * max(len(every), 1)).reshape(n, -1)
            lang = [refs.languages.index(x) if x in refs.languages else -1 for x in batch.column(2).to_pylist()]
            by_class, by_word = np.zeros(n), np.zeros(n)
            lang, best = np.array(lang), np.full(n, np.inf)
            for k in range(len(refs.languages)):
                rows = np.flatnonzero((lang == k) | (lang == -1))
                if not len(rows):
                    continue
                common = table[rows][:, place[k]]
                whole = np.column_stack([common, seen.base["n_words"][rows] - common.sum(axis=1)])
                c, w = distance(seen.classes[rows], refs.classes[k]), distance(whole, refs.counts[k])
                nearer = c + w < best[rows]
                by_class[rows[nearer]], by_word[rows[nearer]], best[rows[nearer]] = c[nearer], w[nearer], (c + w)[nearer]
            failed = (seen.base["n_words"] < 50) | (100 * seen.base["n_repeat_words"] > 50 * seen.base["n_words"])
            far = ((seen.classes.sum(axis=1) >= min_chars) & (by_class > max_class_distance)) | ((seen.base["n_words"] >= min_words) & (by_word > max_word_distance))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(seen.base[c].astype(np.int64)) for c in names], pa.array(failed),
                                              pa.array(by_class), pa.array(by_word), pa.array(~failed & ~far)],
                                             names=["doc_id", *names, "base_failed", "class_distance", "word_distance", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, class_distance double, word_distance double, kept boolean")
