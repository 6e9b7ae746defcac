"""Operators of the llm folder against brute force, and on edge cases: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import heapq
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bandweave.llm import (adaptive_scan, components, divergence, length_buckets, line_dedup, lpt_shards, near_dups, ngram_lm, phrase_mining, queries,
                           rans_files, separator_scan, simhash_trie, string_kernel, text as text_tools, token_mix, zone_clusters)
from bandweave.llm.flatfiles import mapped, write_flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, text_key string, shard int, number int, hash int, key int, fp long, band int, " \
           "lang_pred string, score double, n_tokens int, part int, weight int, size int, n int, path string, domain string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Null text, empty, blanks, one very long text, repeated rows, null keys, names that clash with inner ones."""
    long = " ".join(f"word{k % 977} filler" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "Hello World. The the the"), (5, "Hello World. The the the"), (None, "no key here at all"),
            (None, None), (6, "a\n\nb\r\n  A \n"), (7, "ümlaut ß 漢字 \U0001F600 end"), (8, "12345 !!! ###"), (9, long)]
    rest = [None] * (len(CLASHING.split(", ")) - 2)
    return spark.createDataFrame([(d, t, *rest) for d, t in rows], CLASHING)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


# ---- text helpers ----

def test_words_and_hashes_match_the_pattern(texts):
    import pyarrow as pa
    some = [*list(texts.values())[:40], "", None, "  x ", "\n", "é\x0bü\x1cz"]
    data, off = text_tools.flat(pa.array(some, pa.string()))
    start, end, doc = text_tools.words(data, off)
    found = defaultdict(list)
    for s, e, d in zip(start, end, doc):
        found[int(d)].append(bytes(data[s:e]).decode())
    assert [found[k] for k in range(len(some))] == [WORD.findall(t or "") for t in some]
    hashes = text_tools.SpanHasher(lower=True)(data, start, end)
    by_word = defaultdict(set)
    for s, e, h in zip(start, end, hashes.tolist()):
        by_word[bytes(data[s:e]).decode().translate(LOWER)].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def test_numbering_is_gapless_in_every_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("o"))
    rows = text_tools.numbered(df, ["g"], ["o"], "n", 7).collect()
    for g in range(3):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))


# ---- op1 ----

def base_counts(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    triples, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if triples[tuple(w[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_divergence_counts_and_distances(docs, texts, edge, empty):
    refs = divergence.language_references(docs)
    rows = divergence.quality(docs, refs).collect()
    assert len(rows) == docs.count()
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    table = divergence.class_table()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        kinds = Counter(table[b] for b in texts[r["doc_id"]].encode())
        p = np.array([kinds[k] for k in range(len(divergence.CLASSES))], float)
        q = refs.classes[refs.languages.index(langs[r["doc_id"]])]
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        kl = [sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0) for x in (p, q)]
        assert abs(r["class_distance"] - math.sqrt(sum(kl) / 2)) < 1e-9
    whole = Counter()
    for d, t in texts.items():
        if langs[d] == "en":
            whole.update(words(t))
    k = refs.languages.index("en")
    assert refs.counts[k].sum() == sum(whole.values()) and sorted(refs.counts[k][:-1])[-3:] == sorted(whole.values())[-3:]
    on_edge = divergence.quality(edge, refs).collect()
    assert len(on_edge) == 12 and {r["n_words"] for r in on_edge if r["doc_id"] == 4} == {80_000}
    assert all(base_counts(t)[0] == r["n_words"] for t, r in zip([x["text"] for x in edge.collect()], on_edge))
    assert divergence.quality(empty, refs).count() == 0 and divergence.quality(empty).count() == 0
    assert divergence.quality(edge).count() == 12


def test_divergence_keeps_good_and_drops_junk(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    judged = divergence.quality(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


# ---- op2 ----

def exact_nearest(rows, ids, k):
    x = np.array([v for _, v in rows], float)
    names = np.array([i for i, _ in rows])
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i, v in rows:
        if i in ids:
            score = (x * np.array(v, float)).sum(axis=1) / (norm * np.linalg.norm(v))
            at = [a for a in np.lexsort([names, -score]) if names[a] != i][:k]
            out[i] = [(int(names[a]), float(score[a])) for a in at]
    return out


def test_adaptive_scan_recall_and_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = exact_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = defaultdict(dict)
    for r in adaptive_scan.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        found = [got[q][k] for k in range(1, 6)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        truth = dict(best)
        assert all(abs(truth[i] - s) < 1e-12 for i, s in found if i in truth)
        hits += sum(i in truth for i, _ in found)
    assert hits / (5 * len(want)) >= 0.9


def test_repeated_query_ids_lose_no_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=32).tolist()) for k in range(2000)]
    rows += [r for r in rows if r[0] % 50 == 0 for _ in range(11)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = defaultdict(list)
    for r in adaptive_scan.nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(want[q], got[q]))
    assert hits / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("kind", ["shifted", "flat"])
def test_adaptive_scan_finds_neighbours_on_other_rows(spark, kind):
    rng = np.random.default_rng(21)
    points = rng.normal(size=(3000, 32))
    points = 1 + 1e-5 * points if kind == "shifted" else points * (np.arange(32) < 12)
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = defaultdict(set)
    for r in adaptive_scan.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(i in got[q] for q in want for i, _ in want[q]) / (5 * len(want)) >= 0.98


def test_adaptive_scan_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (2, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, list string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in adaptive_scan.nearest(vectors, vectors.where("vec_id = 0 or vec_id = 4")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 3)]
    assert adaptive_scan.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


# ---- op3 ----

def water(budget, kids):
    """kids: name -> (able, weight); budgets by repeated sharing of what is over."""
    out, open_ = dict.fromkeys(kids, 0.0), {k for k, (a, w) in kids.items() if a > 0 and w > 0}
    while open_ and budget > 1e-9:
        unit = budget / sum(kids[k][1] for k in open_)
        full = {k for k in open_ if out[k] + unit * kids[k][1] >= kids[k][0] - 1e-9}
        for k in full or open_:
            add = kids[k][0] - out[k] if k in full else unit * kids[k][1]
            out[k] += add
            budget -= add
        if not full:
            break
        open_ -= full
    return out


def test_token_mix_budgets_and_prefixes(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    rows = [(r["doc_id"], "d" + str(len(r["source"])), r["lang"], r["source"], len(words(r["text"]))) for r in docs.collect()]
    got = queries.op3_token_mix(spark, sf_dir).collect()
    tokens = Counter()
    for _, d, l, s, n in rows:
        tokens[d, l, s] += n
    weight = lambda path: queries.MIX_WEIGHTS.get(path, 1.0)

    def able(path):
        return sum(2.0 * n for leaf, n in tokens.items() if leaf[:len(path)] == path)

    budget = {(): min(queries.MIX_SHARE * sum(tokens.values()), able(()))}
    for depth in range(3):
        for path in [p for p in budget if len(p) == depth]:
            kids = {leaf[:depth + 1] for leaf in tokens if leaf[:depth] == path}
            budget |= water(budget[path], {k: (able(k), weight(k)) for k in kids})
    taken = Counter()
    for r in got:
        taken[r["domain"], r["lang"], r["source"]] += r["take_tokens"]
    for leaf in tokens:
        assert abs(taken[leaf] - math.floor(budget[leaf] + 1e-6)) <= 1, leaf
    by = defaultdict(list)
    for r in got:
        by[r["domain"], r["lang"], r["source"], r["epoch"]].append(r)
    for (d, l, s, epoch), some in by.items():
        order = sorted((hashlib.md5(f"{queries.MIX_SEED}:{epoch}:{i}".encode()).hexdigest(), i, n) for i, a, b, c, n in rows if (a, b, c) == (d, l, s) and n)
        names = [i for _, i, _ in order]
        assert {r["doc_id"] for r in some} == set(names[:len(some)])
        short = [r for r in some if r["take_tokens"] < r["n_tokens"]]
        assert len(short) <= 1 and all(r["doc_id"] == names[len(some) - 1] for r in short)


def test_token_mix_edges(edge, empty):
    levels = ["domain", "lang", "source"]
    got = token_mix.mixed(edge, levels, {}, 1.0, 1).collect()
    assert sorted((r["doc_id"] or 0, r["take_tokens"]) for r in got) == [(0, 5), (4, 80_000), (5, 5), (5, 5), (6, 3), (7, 5), (8, 3), (9, 80_000)]
    assert token_mix.mixed(edge, levels, {(None,): 0.0}, 1.0, 1).count() == 0
    assert sum(r["take_tokens"] for r in token_mix.mixed(edge, levels, {}, 5.0, 3).collect()) == 3 * 160_026
    assert token_mix.mixed(empty, levels, {}).count() == 0


# ---- op4 ----

def test_string_kernel_accuracy_and_edges(spark, sf_dir, edge, empty):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.op4_string_kernel(spark, sf).join(queries.documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    docs = queries.documents(spark, sf_dir)
    model = string_kernel.train(docs, F.lit(True), sample=50, landmarks=20)
    got = [r["lang_pred"] for r in string_kernel.predict(edge, model).collect()]
    assert [x == "und" for x in got] == [t is None or not any(c.isalpha() for c in t) for t in [r["text"] for r in edge.collect()]]
    assert string_kernel.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in string_kernel.predict(edge, string_kernel.train(empty, F.lit(True))).collect()} == {"und"}


def plain_grams(text):
    """Distinct runs of one to three code points, anything but letters as a blank, runs of blanks left out."""
    s = [c if c.isalpha() else " " for c in text.lower()]
    return {g for n in (1, 2, 3) for g in ("".join(s[i:i + n]) for i in range(len(s) - n + 1)) if g.strip(" ")}


def plain_kernel(some, others):
    a, b = [plain_grams(t) for t in some], [plain_grams(t) for t in others]
    return np.array([[len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])


def test_string_kernel_equals_a_dense_solution(spark, docs):
    table = docs.select("doc_id", "lang", F.substring("text", 1, 400).alias("text")).where("lang is not null")
    extra = spark.createDataFrame([(9001, "en", "Ünï 漢字 a1b2 -- c"), (9002, "fr", ""), (9003, "de", "..."), (9004, "fr", "x" * 300)], table.schema)
    table = table.unionByName(extra)
    languages, picked = string_kernel.drawn(table, F.col("doc_id") % 3 != 0, 40)
    picked = sorted((r["lang"], r["place"], r["text"]) for r in picked.collect())
    each = max(1, 24 // len(languages))
    marks = [t for _, place, t in picked if place <= each]
    values, vectors = np.linalg.eigh(plain_kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep])
    features = lambda some: np.column_stack([plain_kernel(some, marks) @ project, np.ones(len(some))])
    x = features([t for _, _, t in picked])
    y = np.array([[lang == name for name in languages] for lang, _, _ in picked], float)
    left = x.T @ x
    beta = np.linalg.solve(left + string_kernel.RIDGE * np.trace(left) / len(left) * np.eye(len(left)), x.T @ y)
    rows = table.collect()
    out = np.clip(features([r["text"] or "" for r in rows]) @ beta, 0, None)
    model = string_kernel.train(table, F.col("doc_id") % 3 != 0, sample=40, landmarks=24)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in string_kernel.predict(table, model).collect()}
    for r, o in zip(rows, out):
        if any(c.isalpha() for c in r["text"] or ""):
            assert abs(got[r["doc_id"]][1] - o.max() / o.sum()) < 1e-3
            assert got[r["doc_id"]][0] == languages[int(np.argmax(o))] or np.sort(o)[-1] - np.sort(o)[-2] < 1e-3
        else:
            assert got[r["doc_id"]] == ("und", 0.0)


@pytest.mark.parametrize("many", [1, 3])
def test_copies_do_not_steer_the_draw(spark, many):
    """A language of thousands of rows of few texts is learned; its copies take one place each."""
    rng = np.random.default_rng(many)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    rows = [("aa", " ".join(word("abcdef") for _ in range(20))) for _ in range(200)]
    rows += [("bb", " ".join(word("uvwxyz") for _ in range(20))) for _ in range(many)] * (6000 // many)
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    languages, picked = string_kernel.drawn(table, F.lit(True), 20)
    found = Counter(r["lang"] for r in picked.collect())
    assert languages == ["aa", "bb"] and found == {"aa": 20, "bb": many}
    got = string_kernel.predict(table, string_kernel.train(table, F.lit(True), sample=20, landmarks=8)).select("lang", "lang_pred").distinct().collect()
    assert {tuple(r) for r in got} == {("aa", "aa"), ("bb", "bb")}


def test_string_kernel_tells_languages_of_one_script(spark):
    """Two languages in each of three scripts beside a large Latin one that fills any short list of common letters."""
    rng = np.random.default_rng(9)
    letters = {"lat": [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0x101, 0x180, 2)], "ru": range(0x430, 0x440), "uk": range(0x440, 0x450),
               "fa": range(0x627, 0x635), "ur": range(0x635, 0x643), "zh": range(0x4E00, 0x4E40), "yue": range(0x4E40, 0x4E80)}
    rows = []
    for lang, own in letters.items():
        for _ in range(400 if lang == "lat" else 24):
            rows.append((len(rows), lang, " ".join("".join(map(chr, rng.choice(list(own), rng.integers(2, 7)))) for _ in range(40))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = string_kernel.train(docs, F.col("doc_id") % 2 == 0)
    got = string_kernel.predict(docs.where("doc_id % 2 = 1"), model).select("lang", "lang_pred").collect()
    assert len(got) == 272 and all(r["lang"] == r["lang_pred"] for r in got)


# ---- op5 ----

def test_line_dedup_matches_brute_force(spark, docs, edge, empty):
    rows = docs.select("doc_id", "text").collect() + docs.select("doc_id", "text").limit(20).collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if key(line):
                found[key(line)].add(r["doc_id"])
    common = {k for k, d in found.items() if len(d) >= 5}
    want = sorted((r["doc_id"], len(t := (r["text"] or "").split("\n")), sum(key(x) in common for x in t), "\n".join(x for x in t if key(x) not in common)) for r in rows)
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows), 5).collect()
    assert common and sorted(tuple(r) for r in got) == want
    lines = {(r["doc_id"], r["n_lines"], r["n_dropped"]): r["kept_text"] for r in line_dedup.drop_common_lines(edge, 2).collect()}
    assert lines[1, 1, 0] == "" and lines[6, 5, 0] == "a\n\nb\r\n  A \n" and lines[4, 1, 1] == "" and lines[5, 1, 0] == "Hello World. The the the"
    one = [(r["doc_id"], r["n_dropped"], r["kept_text"]) for r in line_dedup.drop_common_lines(edge, 1).collect() if r["doc_id"] == 6]
    assert one == [(6, 3, "\n")]
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_line_keys_lower_ascii_letters_alone(spark):
    lines = [" Ab Z\t", "\u212a \u0130 A\u00c9", "\u00a0A", "", " \r", "[@A`{Z"]
    got = [r["k"] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup.line_key(F.col("x")).alias("k")).collect()]
    assert got == ["ab z", "\u212a \u0130 a\u00c9", "\u00a0a", "", "", "[@a`{z"]


# ---- op6 ----

def test_lpt_matches_a_plain_heap(docs, edge, empty):
    rows = lpt_shards.shard_groups(docs, 6).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    weight = defaultdict(int)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
        weight[t] += len(t) + 8
    load = [(0, s) for s in range(6)]
    for w in sorted(weight.values(), reverse=True):
        at, s = load[0]
        heapq.heapreplace(load, (at + w, s))
    got = defaultdict(int)
    for r in rows:
        got[r["shard"]] += r["size"]
    assert abs(max(got.values()) - max(load)[0]) < 0.01 * sum(got.values())
    assert all(len({r["shard"] for r in rows if texts[r["doc_id"]] == t}) == 1 for t in list(texts.values())[:30])
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    out = lpt_shards.shard_groups(edge, 24).collect()
    assert len(out) == 12 and len({r["shard"] for r in out if r["size"] == 8 and r["doc_id"] in (1, None)}) == 1
    assert lpt_shards.shard_groups(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_bulk_dealing_equals_one_by_one(shards):
    rng = np.random.default_rng(shards)
    classes = [(int(s), int(n), float(s)) for s, n in zip(rng.permutation(500)[:40] + 8, rng.integers(1, 300, 40))]
    heap, want = [(0.0, s) for s in range(shards)], {}
    for name, n, size in sorted(classes, key=lambda c: -c[2]):
        want[name] = [0] * shards
        for _ in range(n):
            at, s = heap[0]
            want[name][s] += 1
            heapq.heapreplace(heap, (at + size, s))
    assert dict(lpt_shards.dealt_counts(classes, shards)) == want


# ---- op7 ----

def brute_fingerprint(text, k=3):
    w = words(text)
    runs = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components_match_all_pairs(docs, texts, edge, empty):
    rows = simhash_trie.simhash_components(docs, budget=6).collect()
    fp = {r["doc_id"]: r["fp"] % (1 << 64) for r in rows}
    assert fp == {d: brute_fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 6:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: find(d) for d in fp}
    out = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash_trie.simhash_components(edge).collect()]
    assert len(out) == 12 and {c for d, f, c in out if f == 0} == {1} and {c for d, _, c in out if d in (4, 9)} == {4}
    assert simhash_trie.simhash_components(empty).count() == 0


@pytest.mark.parametrize("budget,leaf", [(0, 8), (2, 8), (3, 50), (5, 1000)])
def test_trie_join_spans_all_links(spark, budget, leaf):
    rng = np.random.default_rng(budget)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash_trie.trie_join(spark.createDataFrame([(b, v) for v in signed for b in (0, 3)], "band int, fp long"), budget, leaf).collect()

    def label(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {v: find(v) for v in values}
    want = label([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= budget])
    for band in (0, 3):
        assert label([(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links if r["band"] == band]) == want


def test_components_of_chain_star_and_pairs(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(201)}, 5000: 5000, 5001: 5000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_find_planted_copies(spark, edge, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, want = [], {}
    for k in range(60):
        base = [vocabulary[i] for i in rng.integers(0, 5000, rng.integers(60, 900))]
        rows.append((k * 10, " ".join(base)))
        for c in range(k % 4):
            copy = list(base)
            for at in rng.choice(len(base), max(1, len(base) // 80), replace=False):
                copy[at] = "changed"
            rows.append((k * 10 + 1 + c, " ".join(copy).upper() if c == 1 else " ".join(copy)))
        want |= {k * 10 + c: k * 10 for c in range(k % 4 + 1)}
    got = {r["doc_id"]: r["group"] for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    out = {r["doc_id"]: r["group"] for r in near_dups.near_duplicates(edge).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert near_dups.near_duplicates(empty).count() == 0


def test_similarity_is_exact_on_whole_sets():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(400, rng.integers(1, 300), replace=False)).astype(np.uint32) for _ in range(40)] + [np.arange(100, dtype=np.uint32), np.arange(80, dtype=np.uint32)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(x) for x in near_dups.similar_links(sets, 512, 0.5).tolist()} == want and want


def test_near_duplicates_decide_long_texts_exactly(spark):
    """Texts of over 2,000 shingles at similarities from 0.79 to 0.81, against the Jaccard similarity by brute force."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(40):
        base = [f"p{k}w{i}" for i in rng.integers(0, 4000, 2500 + 40 * k)]
        copy, jaccard, order = list(base), 1.0, rng.permutation(len(base))
        runs = lambda t: {" ".join(t[i:i + 5]) for i in range(len(t) - 4)}
        goal, one, at = 0.79 + 0.02 * k / 39, runs(base), 0
        while jaccard > goal:
            copy[order[at]] = f"changed{at}"
            at += 1
            two = runs(copy)
            jaccard = len(one & two) / len(one | two)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (jaccard < 0.8)}
    got = {r["doc_id"]: r["group"] for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 10 < sum(d == g for d, g in want.items() if d % 2) < 30 and got == want


def test_whole_sets_are_compared_over_ranges(monkeypatch):
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 1 << 64, 900, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(500, 900), replace=False)) for _ in range(30)] + [pool[:0], pool[:0]]
    want = near_dups.similar_links(sets, None, 0.7).tolist()
    monkeypatch.setattr(near_dups, "RANGE", 1000)
    monkeypatch.setattr(near_dups, "COLUMNS", 16)
    exact = [[i, j] for i in range(32) for j in range(i + 1, 32) if len(np.intersect1d(sets[i], sets[j])) >= 0.7 * len(np.union1d(sets[i], sets[j]))]
    assert near_dups.similar_links(sets, None, 0.7).tolist() == want == exact and len(want) > 5


# ---- op8 ----

def brute_kneser_ney(train, order):
    def grams(tokens, n):
        padded = ["<s>"] * (order - 1) + tokens
        return [tuple(padded[i - n + 1:i + 1]) for i in range(order - 1, len(padded))]
    count = {order: Counter(g for t in train for g in grams(t, order))}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    size = len({w for t in train for w in t})
    level = {}
    for n in count:
        coc = Counter(count[n].values())
        n1, n2, n3, n4 = (coc[k] for k in (1, 2, 3, 4))
        d = [0.0, 0.5, 1.0, 1.5]
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            new = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            d = [0.0] + [v if 0 < v <= k else p for k, v, p in zip((1, 2, 3), new, d[1:])]
        total, spare = Counter(), Counter()
        for g, c in count[n].items():
            total[g[:-1]] += c
            spare[g[:-1]] += d[min(c, 3)]
        level[n] = d, total, spare

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (size + 1)
        d, total, spare = level[n]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        c = count[n][g]
        return (c - d[min(c, 3)]) / total[h] + spare[h] / total[h] * p(g[1:])
    return (lambda t: [p(g) for g in grams(t, order)]), size


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_matches_brute_force(spark, docs, edge, empty, order):
    held = string_kernel.held_out(7)
    model = ngram_lm.train(docs.where(~held), order)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, model).collect()}
    rows = docs.collect()
    train = [words(r["text"]) + ["</s>"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    score, size = brute_kneser_ney(train, order)
    for r in rows[:60]:
        t = words(r["text"]) + ["</s>"]
        want = sum(math.log10(x) for x in score(t))
        g = got[r["doc_id"]]
        assert abs(g["score"] - want) < 1e-4 * abs(want)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(uni[w] > 0 for w in t), sum(uni.values()))
        base = sum(math.log10((uni[w] + 1) / (sum(uni.values()) + size + 1)) for w in t)
        assert abs(g["base_score"] - base) < 1e-9 * abs(base)
    assert len(ngram_lm.score(edge, model).collect()) == 12 and ngram_lm.score(empty, model).count() == 0
    nothing = ngram_lm.score(edge, ngram_lm.train(empty, order)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nothing)
    assert len(ngram_lm.score(edge, ngram_lm.train(edge, order)).collect()) == 12


def test_kneser_ney_segments_hold_exact_narrow_counts(tmp_path):
    rows = np.array([[1, 5], [1, 6], [2, 5], [3, 9]], np.uint64)
    for counts, kinds in (([1, 2, 3, 1], "BBBBB"), ([1, 2, 300, 1], "HHBBB"), ([1, 2, (1 << 24) + 1, (1 << 32) + 1], "QQBBB")):
        counts = np.array(counts, np.uint64)
        by = np.lexsort((rows[:, 1], ngram_lm.context_hash(rows[:, :1])))
        stats, _ = ngram_lm.Writer(str(tmp_path), 2, False).segment(0, rows[by], counts[by])
        assert stats["kinds"] == kinds
        level = ngram_lm.Level([(stats["path"], stats["entries"], stats["contexts"], stats["kinds"], 0, (1 << 64) - 1)])
        context = ngram_lm.context_hash(rows[:, :1])
        order = np.argsort(keys := ngram_lm.entry_keys(context, rows[:, 1]))
        assert ngram_lm.Lookup(level)(keys[order])[0][0].tolist() == counts[order].tolist()
        order = np.argsort(context)
        total = {1: 3, 2: counts[2], 3: counts[3]}
        assert ngram_lm.Lookup(level, True)(context[order])[0][0].tolist() == [total[int(w)] for w in rows[order, 0]]


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("a b a c a b",), ("b c b a",), ("c c a b d",)], "text string")
    model = ngram_lm.train(texts, 2)
    size = model.vocabulary.distinct
    scorer = ngram_lm.Scorer(model)
    for before in [*range(size), ngram_lm.START_ID, ngram_lm.UNKNOWN_ID]:
        grams = np.array([[before, w] for w in [*range(size), ngram_lm.UNKNOWN_ID]], np.uint64)
        assert abs(scorer.probabilities(grams).sum() - 1) < 1e-6


def test_kneser_ney_beats_the_base_on_held_out(spark, sf_dir):
    r = queries.op8_kneser_ney(spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert r["a"] > r["b"]


def test_kneser_ney_query_uses_two_words_of_context(spark, sf_dir, docs):
    got = {r["doc_id"]: r["score"] for r in queries.op8_kneser_ney(spark, sf_dir).collect()}
    rows = docs.collect()
    score, _ = brute_kneser_ney([words(r["text"]) + ["</s>"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2], 3)
    for r in rows[:30]:
        want = sum(math.log10(x) for x in score(words(r["text"]) + ["</s>"]))
        assert abs(got[r["doc_id"]] - want) < 1e-4 * abs(want)


def test_writer_cuts_segments_and_merges(spark, docs, monkeypatch):
    whole = ngram_lm.train(docs, 2)
    monkeypatch.setattr(ngram_lm, "SEGMENT", 3000)
    monkeypatch.setattr(ngram_lm, "PENDING", 2000)
    parts = ngram_lm.train(docs, 2)
    assert len(parts.levels[1].segments) > len(whole.levels[1].segments)
    a, b = ({r["doc_id"]: r["score"] for r in ngram_lm.score(docs, m).collect()} for m in (whole, parts))
    assert all(abs(a[k] - b[k]) < 1e-5 * abs(a[k]) for k in a)


def test_kneser_ney_packed_rows_come_back():
    rng = np.random.default_rng(3)
    for width, top in ((1, 1 << 63), (2, 40), (3, 12), (3, 1 << 31), (4, 5)):
        rows = rng.integers(0, top, (3000, width)).astype(np.uint64)
        rows[:50] = ngram_lm.START_ID
        rows, counts = ngram_lm.combined(rows, rng.integers(1, 1 << 40, 3000).astype(np.uint64), 64 if width == 1 else 32)
        assert (np.unique(rows, axis=0) == rows).all()
        back, n = ngram_lm.unpacked(ngram_lm.packed(rows, counts), width)
        assert (back == rows).all() and (n == counts).all()
        back, n = ngram_lm.unpacked(ngram_lm.packed(rows[:1], counts[:1]), width)
        assert (back == rows[:1]).all() and (n == counts[:1]).all()


def test_kneser_ney_levels_stay_small(spark, sf_dir):
    texts = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    model = ngram_lm.train(texts.where(~string_kernel.held_out(7)), 3)
    for level, most in zip(model.levels, (9.5, 10, 14)):
        assert sum(len(mapped(s[0])) for s in level.segments) < most * level.distinct
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_kneser_ney_cuts_the_contexts_of_common_words(spark, monkeypatch):
    rows = [" ".join(f"the w{(7 * d + k) % 900} of" for k in range(60)) for d in range(80)]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    whole = ngram_lm.train(texts, 3)
    monkeypatch.setattr(ngram_lm, "SEGMENT", 500)
    parts = ngram_lm.train(texts, 3)
    assert max(s[1] for s in parts.levels[1].segments) < 300 < max(s[1] for s in whole.levels[1].segments)
    assert [(x.distinct, x.total, x.coc) for x in whole.levels] == [(x.distinct, x.total, x.coc) for x in parts.levels]
    a, b = ({r["doc_id"]: r["score"] for r in ngram_lm.score(texts, m).collect()} for m in (whole, parts))
    want, _ = brute_kneser_ney([words(t) + ["</s>"] for t in rows], 3)
    for k, t in enumerate(rows):
        assert abs(a[k] - b[k]) < 1e-9 * abs(a[k]) and abs(a[k] - sum(math.log10(x) for x in want(words(t) + ["</s>"]))) < 1e-9 * abs(a[k])


def test_kneser_ney_files_grow_with_the_tokens(spark, monkeypatch):
    rng = np.random.default_rng(7)
    share = 1 / np.arange(1, 201)
    rows = [(k, " ".join(f"w{x}" for x in rng.choice(200, 200, p=share / share.sum()))) for k in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = ngram_lm.train(texts, 3)
    monkeypatch.setattr(ngram_lm, "SEGMENT", 100)
    parts = ngram_lm.train(texts, 3)
    shards = 1 << parts.deal.bits
    assert parts.deal.parts.max() > 20 and whole.levels[2].apart == []
    assert all(len(x.segments) <= shards and len(x.apart) <= shards for x in parts.levels) and parts.levels[1].apart and parts.levels[2].apart
    assert max(s[1] for x in parts.levels for s in [*x.segments, *x.apart]) < 300
    assert [(x.distinct, x.total, x.coc) for x in whole.levels] == [(x.distinct, x.total, x.coc) for x in parts.levels]
    a, b = ({r["doc_id"]: r["score"] for r in ngram_lm.score(texts, m).collect()} for m in (whole, parts))
    assert all(abs(a[k] - b[k]) < 1e-9 * abs(a[k]) for k in a)


@pytest.mark.skipif(sys.version_info < (3, 13), reason="mappings hold their file open")
def test_mapped_files_are_closed(tmp_path):
    paths = [write_flat(str(tmp_path), [np.arange(k + 1)]) for k in range(50)]
    before = len(os.listdir("/proc/self/fd"))
    held = [mapped(p) for p in paths]
    assert len(os.listdir("/proc/self/fd")) == before and all((x.view(np.int64) == np.arange(k + 1)).all() for k, x in enumerate(held))


# ---- op9 ----

def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_are_optimal():
    from itertools import combinations
    rng = np.random.default_rng(1)
    for _ in range(15):
        lengths = rng.integers(0, 12, 60).tolist()
        have = sorted(set(lengths))
        for k in (1, 2, 3, 4):
            best = min(padding(lengths, [*c, have[-1]]) for n in range(k) for c in combinations(have[:-1], min(n, len(have) - 1)))
            got = length_buckets.optimal_bounds(dict(Counter(lengths)), k)
            assert len(got) <= k and padding(lengths, got) == best
    assert length_buckets.optimal_bounds({}, 3) == []


def test_packed_batches_keep_every_token(docs, texts, edge, empty):
    rows = length_buckets.packed_batches(docs, 4, 1000, 300).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert r["n_tokens"] == len(words(r["text"])) <= r["bucket_len"] <= 300
    assert {d: "".join(r["text"] for r in sorted(p, key=lambda r: r["piece"])) for d, p in by.items()} == texts
    batches = defaultdict(list)
    for r in rows:
        batches[r["bucket_len"], r["batch"]].append(r["slot"])
    lengths = Counter(r["n_tokens"] for r in rows)
    assert {b for b, _ in batches} <= set(length_buckets.optimal_bounds(dict(lengths), 4))
    for (b, at), slots in batches.items():
        each = max(1, 1000 // max(b, 1))
        last = max(x for y, x in batches if y == b)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == each if at < last else len(slots) <= each)
    out = length_buckets.packed_batches(edge).collect()
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None] and [r["text"] for r in out if r["doc_id"] == 2] == [""]
    long = {r["doc_id"]: r["text"] for r in edge.collect()}[4]
    assert "".join(r["text"] for r in sorted((r for r in out if r["doc_id"] == 4), key=lambda r: r["piece"])) == long
    assert len([r for r in out if r["doc_id"] == 5]) == 2 and length_buckets.packed_batches(empty).count() == 0


# ---- op10 ----

@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {"a": [5, 0, 0, 30, 1], "b": [200], "c": [], "d": [0], "e": [3, 100, 2]}
    rows, want = [], []
    for name, lengths in files.items():
        stream, start = [], 0
        for k, n in enumerate(lengths):
            stream += rng.integers(1, 60_000, n).tolist() + [0]
            want.append((name, k, start, n, True))
            start += n + 1
        if name == "e":
            stream += [9, 9]
            want.append((name, len(lengths), start, 2, False))
        raw = np.array(stream, "<u2").tobytes() + (b"\x01" if name == "b" else b"")
        (tmp_path / name).write_bytes(raw)
        rows.append((str(tmp_path / name), len(raw)))
    got = separator_scan.scan_separators(spark.createDataFrame(rows + rows[:1], "path string, bytes long"), 2, 0, block).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in got) == sorted(want)


def test_token_counts_edges(edge, empty, docs, texts):
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in separator_scan.token_counts(edge, block_tokens=1000).collect())
    assert got == [(0, 0), (0, 5), (1, 0), (2, 0), (3, 0), (4, 80_000), (5, 5), (5, 5), (6, 3), (7, 5), (8, 3), (9, 80_000)]
    assert separator_scan.token_counts(empty).count() == 0
    found = {r["doc_id"]: r["n_tokens"] for r in separator_scan.token_counts(docs, 4, 500, 10_000).collect()}
    assert found == {d: len(words(t)) for d, t in texts.items()}


# ---- op11 ----

def brute_collocations(rows, min_count, max_words, top):
    """Plain counts and scores in Python integers."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, found in counts.items():
        cand = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * cand[p[i:j]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("min_count,max_words,top", [(3, 5, 2000), (10, 3, 7), (2, 2, 2000)])
def test_collocations_match_brute_force(spark, docs, monkeypatch, min_count, max_words, top):
    monkeypatch.setattr(phrase_mining, "PART_BYTES", 50_000)
    more = spark.createDataFrame([("xx", "a b a b a b a b. A\tB  a,b!c d c d\x0bc d"), (None, "a b a b"), ("und", "a b"), ("xx", "é ü é ü é ü"), ("xx", None), (None, "")], "lang string, text string")
    table = docs.select("lang", "text").unionByName(more)
    found = phrase_mining.collocations(table, min_count, max_words, top, bits=1 << 20)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations([tuple(r) for r in table.collect()], min_count, max_words, top)


def test_collocations_edges(spark, edge, empty):
    found = phrase_mining.collocations(edge, 2, bits=1 << 16).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations([(r["lang"], r["text"]) for r in edge.collect()], 2, 5, 2000)
    assert phrase_mining.collocations(empty).count() == 0
    wide = 9_000_000_000
    big = spark.createDataFrame([("l", 2, "a b", wide), ("l", 1, "a", wide), ("l", 1, "b", wide), ("l", 0, "", 3 * wide)], "lang string, size int, phrase string, a long")
    assert 1000 * wide * 3 * wide > 1 << 64
    original, phrase_mining.phrase_counts = phrase_mining.phrase_counts, lambda *a: big
    try:
        assert [tuple(r) for r in phrase_mining.collocations(edge).collect()] == [("l", 1, "a b", wide, wide, wide, 3 * wide, 3000)]
    finally:
        phrase_mining.phrase_counts = original


@pytest.mark.parametrize("seed", range(4))
def test_summaries_lose_no_frequent_key(seed, monkeypatch):
    monkeypatch.setattr(phrase_mining, "MERGE_ENTRIES", 50)
    rng = np.random.default_rng(seed)
    stream = np.concatenate([rng.integers(0, 1 << 32, 6_000, dtype=np.uint32), np.repeat(rng.integers(0, 1 << 32, 20, dtype=np.uint32), rng.integers(60, 140, 20))])
    rng.shuffle(stream)
    threshold = 100
    summary = phrase_mining.Summary(len(stream) // threshold + 1)
    for some in np.array_split(stream, 40):
        summary.add(*phrase_mining.unpack(phrase_mining.pack(*np.unique(some, return_counts=True))))
    summary.merge()
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert len(left) <= summary.capacity and summary.error < threshold
    for key, n in Counter(stream.tolist()).items():
        assert left.get(key, 0) <= n <= left.get(key, 0) + summary.error
        assert n < threshold or key in left


def test_packed_counts_and_equal_hashes_are_exact():
    keys, counts = np.array([0, 5, 1 << 31, (1 << 32) - 1], np.uint32), np.array([1, 254, 255, 1 << 40])
    back = phrase_mining.unpack(phrase_mining.pack(keys, counts))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts.tolist()
    ids, lang = np.array([7, 8, 7, 8, 9, 8]), np.zeros(6, np.int64)  # one hash for "7 8", "7 8" and "9 8"
    first, n = phrase_mining.grouped(np.array([0, 2, 4]), np.zeros(3, np.uint64), ids, lang, 2)
    assert sorted(zip(first.tolist(), n.tolist())) == [(0, 2), (4, 1)]


# ---- op12 ----

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def brute_ids(vocabulary, texts):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary)
    return [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check_round_trip(back, rows, vocabulary):
    """Every row once, in doc_id order (null first), with the ids of its whole text and no gap between documents."""
    got = sorted(back.collect(), key=lambda r: r["start"])
    wanted = defaultdict(list)
    for (doc, _), ids in zip(rows, brute_ids(vocabulary, [t for _, t in rows])):
        wanted[doc].append(np.array(ids, "<u4").tobytes())
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d or 0))
    start, found = 0, defaultdict(list)
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
        found[r["doc_id"]].append(bytes(r["ids"]))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in wanted.items()}


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_token_files_round_trip(docs, vocabulary, segment):
    check_round_trip(rans_files.round_trip(docs, vocabulary, segment_tokens=segment), [(r["doc_id"], r["text"]) for r in docs.collect()], vocabulary)


def test_token_files_edges(spark, edge, empty, vocabulary):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    check_round_trip(rans_files.round_trip(edge, vocabulary, segment_tokens=50), rows, vocabulary)
    assert rans_files.round_trip(empty, vocabulary).collect() == []
    same = [(3, "one text")] * 300 + [(3, f"other {k}") for k in range(300)] + [(-1, "minus"), (None, "x")]
    check_round_trip(rans_files.round_trip(spark.createDataFrame(same, "doc_id long, text string"), vocabulary, segment_tokens=100), same, vocabulary)


def test_units_give_the_ids_of_whole_texts(vocabulary, monkeypatch):
    import random
    import pyarrow as pa
    rng = random.Random(7)
    pieces = [*"aAbcéßİΣσ'.,;:!?0189 \t\n\x0b\x0c\r\x1c\x85\xa0 -|<>#_̸́漢ÅK\U0001F600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'re", "don't", "hello", *"\"$%&()*+/=@[\\]^`{}~ÀÖ×Øöø÷ÿñÑªº"]
    some = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(4_000)] + [None, "", "word " * 50_000]
    monkeypatch.setattr(rans_files, "CACHED_UNITS", 3_000)
    encode = rans_files.UnitEncoder(vocabulary)
    wanted = brute_ids(vocabulary, some)
    for at in range(0, len(some), 500):
        ids, sizes = encode(pa.array(some[at:at + 500], pa.string()), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted[at:at + 500]


@pytest.mark.parametrize("count", [1, 31, 32, 33, 16_384, 16_385, 50_001])
def test_coder_returns_the_ids(count):
    rng = np.random.default_rng(count)
    ids = np.minimum(rng.zipf(1.3, count), 49_000)
    table = rans_files.table_of(np.bincount(ids))
    state, found, sizes = rans_files.encode_blocks(ids, table)
    assert table.frequency.sum() == 1 << rans_files.SCALE_BITS
    assert (rans_files.decode_blocks(count, state, found, sizes, table) == ids).all()
    shares = np.bincount(ids)[np.bincount(ids) > 0] / count
    if count > 50_000:
        assert len(found) * 32 < 1.06 * count * -(shares * np.log2(shares)).sum()
    one = rans_files.table_of(np.bincount([5]))
    state, found, sizes = rans_files.encode_blocks(np.full(count, 5), one)
    assert len(found) == 0 and (rans_files.decode_blocks(count, state, found, sizes, one) == 5).all()


def test_table_keeps_rare_ids():
    table = rans_files.table_of(np.array([10**12, 0, *[1] * 40_000]))
    assert table.frequency.sum() == 1 << rans_files.SCALE_BITS and table.frequency[1] == 0 and (table.frequency[2:] == 1).all()


def test_damage_is_found(vocabulary):
    import pyarrow as pa
    ids = np.arange(40_000) % 300
    table = rans_files.table_of(np.bincount(ids))
    raw = rans_files.segment_bytes(ids, np.array([30_000, 10_000]), pa.array([4, None], pa.int64()), table)
    back, sizes, doc_ids = rans_files.read_segment(raw, table)
    assert (back == ids).all() and sizes.tolist() == [30_000, 10_000] and doc_ids.to_pylist() == [4, None]
    for at in (40, len(raw) // 2, len(raw) - 9):
        with pytest.raises(ValueError):
            rans_files.read_segment(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1:], table)


# ---- op13 ----

def brute_clusters(rows, clusters, rounds, dimensions):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    cents = [v for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        now = assign()
        for k in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, now) if c == k]
            if own:
                cents[k] = [sum(x) // len(own) for x in zip(*own)]
    now = assign()
    per = Counter()
    for d, c in now:
        per[c] += d
    return [(i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, now)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_zone_clusters_match_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = [tuple(r) for r in zone_clusters.cluster(vectors, block=16).collect()]
    assert ordered(found) == ordered(brute_clusters([(r["vec_id"], r["embedding"]) for r in vectors.collect()], 16, 3, 64))


def test_zone_clusters_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(0, 3, 4)]) for k in range(200)]
    rows += [(500, [1.0, 2.0, 3.0, 4.0])] * 150 + [(7, [0.0] * 4), (7, [9.0] * 4), (None, [1.0] * 4), (600, None), (601, []), (602, [1.0] * 3), (603, [1.0, None, 1.0, 1.0]),
             (604, [1.0, float("nan"), 1.0, 1.0]), (605, [1.0, float("inf"), 1.0, 1.0]), (606, [1000.0] * 4)]
    names = "vec_id long, embedding array<double>, cluster string, vector string, distance string, place string, packed string, low string, high string"
    table = spark.createDataFrame([(*r, *[None] * 7) for r in rows], names)
    for clusters in (1, 5, 300):
        found = [tuple(r) for r in zone_clusters.cluster(table, clusters, dimensions=4, block=8).collect()]
        assert ordered(found) == ordered(brute_clusters(rows, clusters, 3, 4))
    assert zone_clusters.cluster(table.limit(0)).count() == 0 and zone_clusters.cluster(table.where("vec_id is null")).count() == 0
    few = zone_clusters.cluster(table.where("vec_id < 3"), dimensions=4).collect()
    assert sorted(r["distance"] for r in few) == [0, 0, 0] and len({r["cluster"] for r in few}) == 3
    with pytest.raises(Exception, match="64 bits"):
        zone_clusters.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dimensions=4).count()


@pytest.mark.parametrize("dimensions,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_the_cube_in_single_steps(dimensions, bits):
    points = np.array(np.meshgrid(*[np.arange(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    keys = zone_clusters.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(11)
    ruled_out = 0
    for _ in range(50):
        values, cents = rng.integers(-40, 40, (30, 6)) + rng.integers(-200, 200, 6), rng.integers(-200, 200, (20, 6))
        among = zone_clusters.candidates(values.min(0), values.max(0), cents)
        ruled_out += 20 - len(among)
        assert [x.tolist() for x in zone_clusters.nearest(values, cents, among)] == [x.tolist() for x in zone_clusters.nearest(values, cents, np.arange(20))]
    assert ruled_out > 300


# ---- pipeline ----

def test_pipeline_stages(spark, sf_dir, edge):
    import corpus_pipeline as pipeline
    docs = queries.documents(spark, sf_dir)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "target_mix", "packing"]
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == docs.columns
        if name == "simhash_near_dedup":
            groups = near_dups.near_duplicates(before).collect()
            assert {r["doc_id"] for r in kept.collect()} == {r["group"] for r in groups}
        if name == "line_dedup":
            want = {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_common_lines(before).collect()}
            assert {r["doc_id"]: r["text"] for r in kept.collect()} == want
    packed = pipeline.run(spark, sf_dir).collect()
    final = {r["doc_id"]: r["text"] for r in kept.collect()}
    whole = defaultdict(list)
    for r in packed:
        whole[r["doc_id"]].append((r["piece"], r["text"]))
    assert {d: "".join(t for _, t in sorted(p)) for d, p in whole.items()} == final


def test_pipeline_stages_take_any_column_names(spark, sf_dir):
    """Nulls, repeats, blanks and columns with the names the operators use inside; every kept row keeps its own values."""
    import corpus_pipeline as pipeline
    clashing = ["kept_text", "n_lines", "n_dropped", "__id", "__m", "__n", "__words", "__place", "__domain", "__t0", "score", "lang_pred", "group", "often_id", "held", "other0", "gone", "key", "same", "node"]
    line = "a line of words that everyone has in common and shares"
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "ALPHA beta gamma delta epsilon zeta eta theta"),
             (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, "one two three"), (3, None), (4, ""), (5, " \t "), (6, "12 34"), *((k, f"{line}\nown text number {k}") for k in range(10, 25))]
    rows = [(d, t, "en", "src0", 7, *[f"{c}:{k}" for c in clashing]) for k, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing))
    own = {tuple(r[c] for c in clashing): r for r in docs.collect()}
    out = {}
    for name, stage in pipeline.STAGES[:-1]:
        out[name] = stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs, sf_dir).columns == docs.columns
        for r in out[name]:
            given = own[tuple(r[c] for c in clashing)]
            assert (r["doc_id"], r["lang"], r["source"]) == (given["doc_id"], given["lang"], given["source"])
            assert name == "line_dedup" or (r["text"], r["n_chars"]) == (given["text"], given["n_chars"])
        assert len({tuple(r[c] for c in clashing) for r in out[name]}) == len(out[name])
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    with_letters = [(d, t) for d, t in texts if any(c.isalpha() for c in t or "")]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in out["language_id"]), key=key) == sorted(with_letters, key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in out["line_dedup"]), key=key) == sorted(((d, (t or "").replace(line + "\n", "")) for d, t in texts), key=key)
    kept = [(r["doc_id"], r["text"]) for r in out["simhash_near_dedup"]]
    assert sorted(d for d, t in kept if d is not None and d < 10) == [1, 3, 6] and sum(d is None for d, _ in kept) == 2
    assert len([d for d, _ in kept if d is not None and d >= 10]) == len({g["group"] for g in near_dups.near_duplicates(docs.where("doc_id >= 10")).collect()})
    assert pipeline.packing(spark, docs, sf_dir).count() > 0 and pipeline.packing(spark, docs.limit(0), sf_dir).count() == 0


def test_target_mix_keeps_null_and_repeated_ids(spark, sf_dir, edge, monkeypatch):
    import corpus_pipeline as pipeline
    mixed = edge.withColumn("lang", F.lit("en")).withColumn("source", F.lit("src0"))
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    monkeypatch.setattr(pipeline, "MIX_SHARE", 1.0)
    whole = [(r["doc_id"], r["text"]) for r in edge.collect() if words(r["text"])]
    assert rows(pipeline.target_mix(spark, mixed, sf_dir)) == sorted(whole, key=str) and (None, "no key here at all") in whole
    monkeypatch.setattr(pipeline, "MIX_SHARE", 0.5)
    some = [(1, "a b c d"), (1, "a b c e"), (1, "f g"), (None, "h i j"), (None, "k l m"), (None, "n"), (2, "o p q r"), (2, "o p q r")] * 3
    docs = spark.createDataFrame([(d, t, "en", "src0") for d, t in some], "doc_id long, text string, lang string, source string")
    want = Counter()
    for r in token_mix.mixed(docs.withColumn("__domain", F.lit("d4")), pipeline.MIX_LEVELS, pipeline.MIX_WEIGHTS, 0.5, 1).collect():
        want[r["doc_id"], r["n_tokens"]] += 1
    got = rows(pipeline.target_mix(spark, docs, sf_dir))
    assert Counter((d, len(words(t))) for d, t in got) == want and 0 < len(got) < len(some) and not Counter(got) - Counter(some)
