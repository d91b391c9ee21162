"""Learned operators against plain Python, and the pipeline's stages against SQL over what their predecessors kept."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import language_id, mixing, oracles, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Language ID: vectors as lists of signs, bound, shifted and bundled one by one


def bundle_by_force(text):
    letters = [chr(ord(c)).lower()[0] if unicodedata.category(c)[0] == "L" else " " for c in text or ""]
    total = np.zeros(language_id.DIM)
    n = 0
    for word in "".join(letters).split():
        padded = f" {word} "
        for i in range(len(padded) - language_id.GRAM + 1):
            product = np.ones(language_id.DIM)
            for k, letter in enumerate(padded[i : i + language_id.GRAM]):
                signs = language_id.letter_vectors(np.array([ord(letter)], np.uint32))[0]
                product = product * np.array([signs[(j - k) % language_id.DIM] for j in range(language_id.DIM)])
            total += product
            n += 1
    return total, n


def test_language_against_plain_vectors(spark):
    taught = [("the cat sat on a mat", "en"), ("Der Hund läuft", "de"), ("DER Tag", "de"), ("un été à la plage", "fr"), ("12 !", "zz"), (None, "en"), ("x", None)]
    asked = ["the hat", "der Läufer", "une plage", "", None, "99", "Ça va", "a", "ŒUVRE ß", "cat\ncat\tcat"]
    profiles = defaultdict(lambda: np.zeros(language_id.DIM))
    for text, lang in taught:
        if text is not None and lang is not None:
            profiles[lang] += bundle_by_force(text)[0]
    expected = {}
    for i, text in enumerate(asked):
        vector, n = bundle_by_force(text)
        if not n:
            expected[i] = ("und", 0.0)
            continue
        cosines = {k: float(v @ vector / ((np.linalg.norm(v) or 1) * np.linalg.norm(vector))) for k, v in profiles.items()}
        best = min(cosines, key=lambda k: (-cosines[k], k))
        expected[i] = (best, max(cosines[best], 0.0))
    training = spark.createDataFrame(taught, "text string, lang string")
    found = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), training).collect()
    assert len(found) == len(asked)
    for r in found:
        assert r.lang_pred == expected[r.doc_id][0] and math.isclose(r.score, expected[r.doc_id][1], abs_tol=1e-5)


# Toxicity: log-odds, segments, the extreme-value statistic and the calibration


def features_of(text):
    """For every word the names of its features; prefixes are told apart from words."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOW).encode())
    return [[(0, w), *((k, w[:k]) for k in toxicity.PREFIXES)] for w in words]


def segments_by_force(scores):
    """The best stretch, and then the same to its left and to its right."""
    best = max(((sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    total, a, b = best[0], -best[1], best[2]
    if total <= 0:
        return []
    return segments_by_force(scores[:a]) + [total] + segments_by_force(scores[b:])


def toxicity_by_force(training, asked):
    labels = {}
    for text, toxic in training:
        labels[text or ""] = max(toxic, labels.get(text or "", 0))
    counts = [Counter(), Counter()]
    for text, toxic in labels.items():
        counts[toxic].update({f for word in features_of(text) for f in word})
    every = counts[0] + counts[1]
    n0, n1 = sum(counts[0].values()), sum(counts[1].values())
    prior = toxicity.PRIOR * (n0 + n1)
    least = math.sqrt(2 * math.log(max(sum(n > 1 for n in every.values()), 2)))
    model = {}
    for f, n in every.items():
        a = n / (n0 + n1) * prior
        odds = lambda y, total, a=a: math.log((y + a) / (total + prior - y - a))
        d, e = odds(counts[1][f], n1) - odds(counts[0][f], n0), math.sqrt(1 / (counts[1][f] + a) + 1 / (counts[0][f] + a))
        if abs(d / e) > least:
            model[f] = (abs(d / e), math.copysign(abs(d) - 2 * e, d))

    def word_scores(text):
        out = []
        for word in features_of(text):
            known = [model[f] for f in word if f in model]
            out.append((max(known, key=lambda m: m[0])[1] if known else 0.0) - toxicity.DRIFT)
        return out

    bins = Counter()
    for text, toxic in labels.items():
        if not toxic:
            bins.update(int(np.round(s / 0.25)) for s in word_scores(text))
    rate = toxicity._rate(dict(bins))
    found = {t: (word_scores(t), segments_by_force(word_scores(t))) for t in {*labels, *(a or "" for a in asked)}}
    calm = [t for t, y in labels.items() if not y and found[t][0]]
    mass = sum(len(found[t][0]) * math.exp(-rate * max(found[t][1], default=0.0)) for t in calm)
    scale = len(calm) / mass if mass else 1.0

    def statistic(text):
        scores, parts = found[text]
        total, best = 0.0, -60.0
        for r, s in enumerate(sorted(parts, reverse=True) if scores else [], 1):
            total += rate * s - math.log(scale * len(scores)) + math.log(r)
            best = max(best, total)
        return min(best, 240.0)

    placed = defaultdict(list)
    for t, y in labels.items():
        if found[t][0]:
            placed[float(np.round(statistic(t) / 0.5) * 0.5)].append(y)
    # Shares that never fall: the greatest lower mean over all stretches that reach up to a bin and beyond.
    at = sorted(placed)
    share = []
    for i in range(len(at)):
        means = []
        for a in range(i + 1):
            stretch = [[y for x in at[a : b + 1] for y in placed[x]] for b in range(i, len(at))]
            means.append(min((sum(s) / len(s)) for s in stretch))
        share.append(max(means))
    return {t: (statistic(t), share, at) for t in found}, share, at


def test_toxicity_by_force(spark):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(60)]
    bad = ["vile", "vilest", "scum", "scumbag", "rotten"]
    training = []
    for i in range(160):
        toxic = int(i % 3 == 0)
        text = rng.choices(plain, k=rng.randrange(3, 14))
        if toxic:
            text[rng.randrange(len(text)) :] = rng.choices(bad, k=rng.randrange(1, 4))
        elif i % 11 == 0:
            text.append(rng.choice(bad))
        training.append((" ".join(text).title() if i % 5 == 0 else " ".join(text), toxic))
    training += [training[0], (training[1][0], 1), (None, 0), ("", 0)]
    asked = [t for t, _ in training[:60]] + ["vile scum", "Word1 VILEST word2 scum word3", "nothing here", None]
    placed, share, at = toxicity_by_force(training, asked)
    model = toxicity.fit(spark.createDataFrame(training, "text string, toxic int"))
    found = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    pools = dict(zip(model.at.tolist(), model.probability.tolist(), strict=True))
    assert set(pools) <= set(at)  # pools start and end in bins that occur
    for x, p in zip(at, share, strict=True):
        if x in pools:  # the share of its pool, a little towards the middle
            assert abs(pools[x] - p) <= 0.21
    for r in found:
        statistic = placed[asked[r.doc_id] or ""][0]
        assert math.isclose(r.score, float(np.interp(statistic, model.at, model.probability)), abs_tol=1e-9)
    by_statistic = sorted((placed[asked[r.doc_id] or ""][0], r.score) for r in found)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(by_statistic, by_statistic[1:], strict=False))
    scores = {asked[r.doc_id]: r.score for r in found}
    assert scores["vile scum"] > 0.7 > scores["nothing here"]


# The pipeline: every stage over what its predecessor kept


def test_pipeline_stages_against_sql(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    five = oracles.NEAR_DEDUP.replace("len(w) - 3", "len(w) - 4").replace("w[i:i + 3]", "w[i:i + 4]")
    blank = r"regexp_matches(text, '[^\x20\x09-\x0D]')"
    expected = {
        "language_id": r"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\p{L}')",
        "line_dedup": f"SELECT doc_id, text FROM ({oracles.LINE_DEDUP}) WHERE n_removed = 0 OR {blank}",
        "minhash_near_dedup": f"SELECT doc_id, d.text FROM documents d JOIN ({five}) USING (doc_id) WHERE kept OR n_shingles = 0",
        "decontamination": f"SELECT doc_id, d.text FROM documents d JOIN ({oracles.DECONTAMINATION}) USING (doc_id) WHERE NOT contaminated",
    }
    for name, stage in corpus_pipeline.STAGES:
        place = f"{tmp_path}/{name}"
        docs.write.parquet(f"{place}/in")
        db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{place}/in/*.parquet'")
        docs = spark.read.parquet(f"{place}/in")
        stage(spark, docs, sf_dir).write.parquet(f"{place}/out")
        out = spark.read.parquet(f"{place}/out")
        if name in expected:
            assert sorted((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == sorted(db.sql(expected[name]).fetchall())
            assert out.columns[:5] == corpus_pipeline.COLUMNS
            docs = out
    # The mix of what is left: every source takes its target, no document more than three times its words.
    sizes = docs.groupBy("source").agg(F.sum(mixing.size_of()).alias("source_size"))
    targets = {r.source: r.target for r in mixing.targets(sizes).collect()}
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())
    assert out.filter("taken > 3 * size OR taken <= 0").count() == 0


@pytest.mark.parametrize("depth", [0, 2])
def test_shards_hold_the_mix(spark, sf_dir, depth):
    """Every place of a document is one row in its shard, rows of a shard stand in the order of their hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix_rows(docs, depth=depth).cache()
    rows = mixing.shard_rows(mixed)
    assert rows.count() == mixed.select(F.explode("places")).count() > 0
    assert rows.agg(F.sum("place.words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert rows.select("place.shard").distinct().count() == 2**depth
    placed = rows.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), "place.shard", "place.order").collect()
    of_shard = defaultdict(list)
    for r in sorted(placed, key=lambda r: r.at):
        of_shard[r.shard].append((r.task, r.order))
    for rows_ in of_shard.values():
        assert len({task for task, _ in rows_}) == 1 and [o for _, o in rows_] == sorted(o for _, o in rows_)
