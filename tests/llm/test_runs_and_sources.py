"""Periodic runs, source divergence and SimHash groups against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm import buffers, divergence, periodic_runs, simhash
from lintlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, expected):
    assert sorted(map(key, found)) == sorted(map(key, expected))


# Periodic runs


def runs_by_force(w, min_length=6, min_exponent=4):
    found = {}
    for p in range(len(w) // min_exponent, 0, -1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_exponent * p):
                found[i, j + p] = p
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def runs_found(texts, min_length=6, min_exponent=4):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = buffers.random_words(64, 1)[np.array([x for t in texts for x in t], np.int64)]
    row, *columns = periodic_runs.find_runs(words, first, min_length, min_exponent)
    out = [[] for _ in texts]
    for r, *run in zip(row.tolist(), *[c.tolist() for c in columns], strict=True):
        out[r].append(tuple(run))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5), st.integers(2, 4), st.integers(1, 9))
def test_runs_of_few_words_against_force(texts, min_exponent, min_length):
    assert runs_found(texts, min_length, min_exponent) == [runs_by_force(t, min_length, min_exponent) for t in texts]


def test_planted_runs_against_force(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_CELLS", 64)  # many small steps
    rng, texts = random.Random(5), []
    for _ in range(40):
        t = [rng.randrange(40) for _ in range(rng.randrange(300))]
        for _ in range(3):
            a, p, n = rng.randrange(300), rng.randrange(1, 45), rng.randrange(250)
            t[a : a + n] = [(t[a:] or [0])[i % max(min(p, len(t) - a), 1)] for i in range(min(n, max(len(t) - a, 0)))]
        texts.append(t)
    texts += [[3] * 1000, [1, 2] * 500 + [1], [], [7], list(range(30)) * 9]
    for min_exponent in (2, 4):
        assert runs_found(texts, 6, min_exponent) == [runs_by_force(t, 6, min_exponent) for t in texts]


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def digest_by_force(doc_id, text):
    w = plant(doc_id, WORD.findall(text or ""))
    runs = runs_by_force(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *hashes)


def test_periodic_runs_on_edges(spark, edge_docs, edge_rows):
    rng = random.Random(2)
    short = [r for r in edge_rows if len(r[1] or "") < 20000]
    more = [(100 + i, " ".join(rng.choice(["a", "b", "ü", "B"]) for _ in range(rng.randrange(120)))) for i in range(80)]
    more += [(1000 + i, "\n".join(f"w{j}" for j in range(3 * i))) for i in range(60)] + [(5, "x " * 700), (6, " x y " * 9)]
    docs = edge_docs.filter("doc_id IS NULL OR doc_id <> 13").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(docs))).collect()
    same(found, [digest_by_force(r[0], r[1]) for r in [*short, *more]])
    whole = periodic_runs.periodic_runs(edge_docs).filter("doc_id = 13").first()
    assert whole.n_words == 20400 and whole.runs == [] and whole.collapsed == " ".join(WORD.findall(edge_rows[13][1]))


# Source divergence


def divergence_by_force(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, seen = Counter(), defaultdict(int)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))
        counts.update((lang, source, t) for t in terms)
        for t in set(terms):
            seen[lang, t] += 1
    out = []
    groups = {(lang, source) for _, lang, source in rows}
    for lang, source in groups:
        kept = [t for (x, t), n in seen.items() if x == lang and n >= min_docs]
        mates = [s for x, s in groups if x == lang]

        def shares(count, kept=kept):
            n = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s, lang=lang: counts[lang, s, t]) for s in mates}
        whole = shares(lambda t, lang=lang, mates=mates: sum(counts[lang, s, t] for s in mates))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(o, sum(f(p[source][t], p[o][t]) for t in kept)) for o in mates if o != source]
        terms = [(t, f(p[source][t], whole[t])) for t in kept if counts[lang, source, t] and p[source][t] > whole[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items = sorted(items, key=lambda i: (-i[1], i[0].encode()))
            out += [(lang, source, part, item, v, r) for r, (item, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return out


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_divergence_on_edges(edge_docs, edge_rows, min_docs):
    found = divergence.divergence(edge_docs, min_docs=min_docs, top=10).collect()
    same(found, divergence_by_force([(r[1], r[2], r[3]) for r in edge_rows], min_docs, 10))


def test_divergence_of_many_sources(spark):
    rng = random.Random(3)
    names = ["É", "zebra", "Ant", "ant", "x1y", "日本", "ß", "ÿ"]
    rows = [(" ".join(rng.choices(names, k=rng.randrange(30))), rng.choice(["a", "a", None]), f"s{rng.randrange(12)}") for _ in range(300)]
    found = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5), min_docs=10, top=3)
    same(found.collect(), divergence_by_force(rows, 10, 3))


def test_shares_beyond_a_long(spark):
    n = 10**13
    row = spark.sql(f"SELECT {n}L AS n, {3 * n}L AS total, 7L AS v").select(divergence._share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 14)


# SimHash


def fingerprint_by_force(text, width):
    w = (text or "").translate(LOW)
    w = WORD.findall(w)
    grams = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(fps, bits):
    """The smallest reachable position of each fingerprint."""
    a = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    return [find(i) for i in range(len(fps))]


def groups_by_force(rows, width, bits):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    fps = [fingerprint_by_force(r[1], width) for r in rows]
    return [(r[0], f"{fp:016x}", rows[g][0]) for r, fp, g in zip(rows, fps, joined(fps, bits), strict=True)]


@pytest.mark.parametrize("width,bits", [(3, 3), (1, 2), (5, 0)])
def test_simhash_on_edges(edge_docs, edge_rows, width, bits):
    same(simhash.near_duplicates(edge_docs, width, bits).collect(), groups_by_force([r[:2] for r in edge_rows], width, bits))


def test_simhash_of_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.near_duplicates(docs, width=3, bits=3).collect()
    same(found, groups_by_force([(r.doc_id, r.text) for r in docs.collect()], 3, 3))


@pytest.mark.parametrize("bits,short", [(1, 2), (3, 32), (3, 2), (4, 2)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, short, bits):
    """Walks of few flips from common starts: long lists, chains, and fingerprints just too far apart."""
    monkeypatch.setattr(simhash, "SHORT", short)
    rng, fps = random.Random(bits), {0, (1 << 64) - 1}
    for _ in range(4):
        at = rng.getrandbits(64)
        places = rng.sample(range(64), 14)
        for _ in range(90):
            fps.add(at ^ sum(1 << i for i in rng.sample(places, rng.randrange(9))))
    fps = sorted(fps, key=simhash._signed)
    found = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), bits)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= bits for r in found.collect())
    at = {r.node: r.component for r in components(found).collect()}
    assert [at.get(simhash._signed(x), simhash._signed(x)) for x in fps] == [simhash._signed(fps[g]) for g in joined(fps, bits)]


def test_new_operators_on_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert divergence.divergence(no_docs).count() == 0
    assert periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(no_docs))).count() == 0
    texts = no_docs.sparkSession.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.divergence(texts.withColumn("doc_id", F.lit(1))).count() == 0
