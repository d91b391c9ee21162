"""Operators on documents against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.llm import decontamination, frames, language_id, line_dedup, lm_scoring, mixing, near_dedup, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def key(row):
    return tuple((x is not None, x) for x in row)


def same(found, expected):
    assert sorted(map(key, found)) == sorted(map(key, expected))


# Mixing


def test_mix_on_edges(edge_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    same([(r.doc_id, r.size) for r in rows], [(r[0], len(WORD.findall(r[1] or ""))) for r in edge_rows])
    assert all(0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.places) for r in rows)
    total = sum(r.size for r in rows)
    by_target = defaultdict(lambda: [0, 0])
    for r in rows:
        by_target[r.source_size, r.target][0] += r.taken
        by_target[r.source_size, r.target][1] += r.size
    # Copies that share the cut may each lose a word.
    assert all(abs(taken - target) <= 4 and size == source for (source, target), (taken, size) in by_target.items())
    assert abs(sum(t for _, t in by_target) - total) < 1e-6 * total
    again = mixing.mix(edge_docs.repartition(5)).collect()
    same([(r.doc_id, r.taken) for r in rows], [(r.doc_id, r.taken) for r in again])


def test_targets_against_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 5, "e": 4000, None: 300}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        each = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if each[s] >= 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else each
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: round(r.target, 6) for r in found} == {s: round(t, 6) for s, t in target.items()}


def test_hypergeometric_draws(spark):
    rows = spark.range(4000).select(
        F.lit(50).alias("population"), F.lit(20).alias("marked"), F.lit(10).alias("draws"), ((F.col("id") + 0.5) / 4000).alias("unit")
    )
    found = Counter(r.x for r in mixing.hypergeometric(rows, "x").collect())
    for x in range(11):
        p = math.comb(20, x) * math.comb(30, 10 - x) / math.comb(50, 10)
        assert abs(found[x] / 4000 - p) < 0.002


def test_shard_quotas_are_exact(spark):
    quotas = {1: 37, 2: 5, 3: 0, 4: 300}
    rows = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "sid int, quota long"), 3).collect()
    sums, sizes = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        sums[r.sid] += r.quota
        sizes[r.shard] += r.quota
    assert dict(sums) == quotas and max(sizes.values()) - min(sizes.values()) <= 3


# Language


def test_language_on_edges(edge_docs, edge_rows):
    rows = language_id.identify(edge_docs, edge_docs).collect()
    assert len(rows) == len(edge_rows)
    none = {i for i, (_, t, *_) in enumerate(edge_rows) if not any(c.isalpha() for c in t or "")}
    assert Counter(r.lang_pred == "und" for r in rows)[True] == len(none)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in rows)
    assert {r.lang_pred for r in language_id.identify(edge_docs, edge_docs.filter("lang = 'xx'")).collect()} == {"und"}


def test_keep_identified_without_labels(edge_docs, edge_rows):
    """Nothing teaches a language: every text with a letter stays."""
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    found = language_id.keep_identified(unlabelled)
    assert found.columns == unlabelled.columns
    same([(r.doc_id, r.text) for r in found.collect()], [r[:2] for r in edge_rows if any(c.isalpha() for c in r[1] or "")])
    same([(r.doc_id, r.text) for r in language_id.keep_identified(edge_docs).collect()], [r[:2] for r in edge_rows if any(c.isalpha() for c in r[1] or "")])


def test_language_held_out(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), language_id.held_out(4, 2)
    found = language_id.identify(docs.filter(out), docs.filter(~out)).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    assert docs.filter(out).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect())


# Near-duplicates


def components_by_force(rows, width, threshold):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[find(i)].append(row[0])
    out = []
    for i, row in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        name = min(ids) if ids else None
        out.append((row[0], len(sets[i]), name, row[0] is not None and row[0] == name))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_on_edges(edge_docs, edge_rows, width):
    found = near_dedup.near_duplicates(edge_docs, width, 80).collect()
    same([tuple(r) for r in found], components_by_force(edge_rows, width, 80))


def test_near_duplicates_in_a_group_of_edited_copies(spark):
    """Many copies of one text, each with its own edits: links, misses and chains around the threshold."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for j in range(i % 9):
            own[(i * 37 + j * 29) % 120] = f"e{(i * 7 + j) % 40}"
        rows.append((i, " ".join(own)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    same([tuple(r) for r in found], components_by_force(rows, 4, 80))


@pytest.mark.parametrize("width", [1, 5])
def test_short_near_duplicates_at_the_threshold(spark, width):
    """Pairs of short texts at exactly 0.8, and just below: too few registers are full for the bands to find them all."""
    rows = []
    for i in range(240):
        union = 5 * (1 + i % 11)  # texts of 4 to 59 words
        own = [f"t{i}w{k}" for k in range(union + width - 1)]
        cut = union // 5 + (i % 4 == 3)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: len(own) - cut]))]
    rows += [(1000 + i, "all of these texts share a line " + " ".join(f"s{i}w{k}" for k in range(i % 4))) for i in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, 80).collect()
    same(found, components_by_force(rows, width, 80))


def test_keep_one(edge_docs, edge_rows):
    kept = near_dedup.keep_one(edge_docs, 4)
    assert kept.columns == edge_docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    base = edge_rows[4][1]
    assert sum(n for (_, t), n in texts.items() if t in (base, edge_rows[6][1])) == 1 and texts[4, base] == 1
    # Texts without words are linked with nothing.
    assert texts[0, None] == 2 and texts[None, None] == 1 and texts[1, ""] == 1


# Lines and passages


def lines_by_force(rows, min_words):
    # Rows equal in doc_id and text are one document; null comes first.
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: d[:2])
    seen, out = set(), {}
    for known, doc_id, text in docs:
        lines = text.split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= min_words:
                    run = tuple(lines[a:b])
                    if run in seen:
                        gone |= set(range(a, b))
                    seen.add(run)
        out[doc_id if known else None, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("min_words", [1, 6, 12])
def test_line_dedup_on_edges(edge_docs, edge_rows, min_words):
    found = line_dedup.dedup_lines(edge_docs, min_words).collect()
    expected = lines_by_force(edge_rows, min_words)
    assert len(found) == len(edge_rows)
    originals = [(r[0], None if r[1] is None else expected[r[0], r[1]]) for r in edge_rows]
    same([(r.doc_id, r.text) for r in found], originals)
    assert all(r.row == 7 and r.size == "clash" for r in found)


def test_line_runs_of_all_lengths_in_small_plans(spark, plan):
    """Runs of 1, 2 to 3 and 4 to 6 lines are found by a join of their own each, which is done before the result is planned."""
    one, two, six = "a b c d e f", "g h i\nj k l", "m\nn\no\np\nq\nr"
    texts = [f"{one}\nx1\n{two}\nx2\n{six}", f"y1\n{six}\ny2\n{one}\ny3\n{two}\nm\nn", f"z\n{two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decided = line_dedup.repeated_runs(docs.select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_h"), "text"))
    assert {r._id: r.gone for r in decided.collect()} == {0: [], 1: [1, 2, 3, 4, 5, 6, 8, 10, 11], 2: [1, 2]}
    # Documents meet what is gone of them; the rounds have no join in here.
    assert sum("Join" in line and line.startswith("(") for line in plan(decided.select("*")).splitlines()) == 1


def test_passages_on_edges(edge_docs, edge_rows):
    found = {(r.doc_id, r.n_sentences): r for r in substring_dedup.dedup_passages(edge_docs).collect()}
    by_id = {k[0]: v for k, v in found.items()}
    assert len(found) >= 15 and by_id[0].text is None and by_id[1].text == "" and by_id[2].n_sentences == 0
    assert by_id[11].n_removed == 0 and by_id[3].n_removed == 0  # nothing of theirs is repeated
    # doc 5 repeats doc 4, whose copy with a null doc_id comes first of all.
    assert by_id[5].text == "" and by_id[4].text == "" and by_id[6].n_removed > 0
    # The passage stays where it stands first.
    assert by_id[7].n_repeated > 0 and by_id[7].text.count("owls") == 1
    assert "owls" not in by_id[8].text and by_id[8].text.startswith("Another one")


def test_passages_by_force(spark):
    """Runs of sentences against all pairs of positions, where every sentence ends with a mark."""
    text = [" ".join(f"{chr(97 + (i * j) % 26)}{(i + j) % 7}" for j in range(6)) + "." for i in range(60)]
    docs = [(d, " ".join(text[(d * 11 + k) % 60] for k in range(5 + d % 9))) for d in range(25)]
    seen, expected = set(), {}
    for doc_id, whole in docs:
        parts = [s + "." for s in whole.rstrip(".").split(". ")]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if sum(len(s.split()) for s in parts[a:b]) >= 16:
                    run = tuple(s.rstrip(".") for s in parts[a:b])
                    if run in seen:
                        gone |= set(range(a, b))
                    seen.add(run)
        expected[doc_id] = len(gone)
    found = substring_dedup.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == expected


def test_unmarked_passages_share_a_run():
    """Texts that share 51 words without marks, between other words, and whole texts of few words: each pair has a run in common."""
    draw = random.Random(5)
    common = lambda n: [f"w{int(1000 ** draw.random())}" for _ in range(n)]
    pairs = []
    for i in range(3000):
        passage = common(51)
        pairs.append([" ".join(common(draw.randrange(40)) + passage + common(draw.randrange(40))) for _ in range(2)])
    for i in range(200):
        few = [f"f{i}x{k}" for k in range(1 + i % 5)]
        pairs.append([" ".join(draw.choices(few, k=17 + i % 40))] * 2)
        sentence = " ".join(common(17)) + ". "
        pairs.append([f"Before it. {sentence}One end", f"Other words. {sentence}Another here"])
    texts = [text for pair in pairs for text in pair]
    batch = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_t": [0] * len(texts), "text": texts})
    spans = [set() for _ in texts]
    for out in substring_dedup._hash(16, 2)([batch]):
        for i, span in zip(out.column("_id").to_pylist(), out.column("span").to_pylist(), strict=True):
            spans[i].add(span)
    missed = [i for i in range(len(pairs)) if not spans[2 * i] & spans[2 * i + 1]]
    assert not missed, (len(missed), [pairs[i] for i in missed[:2]])


# Decontamination


def test_decontamination_on_edges(spark, edge_docs, edge_rows):
    passage = next(r[1] for r in edge_rows if r[0] == 9)
    items = [(1, passage), (1, passage), (2, "one"), (3, None), (4, " . "), (None, "hello world"), (5, "W0X w1x"), (6, passage + " More words.")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for item, text in items:
        w = cut(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])] |= {str(item)} if item is not None else set()
    expected = []
    for doc_id, text, *_ in edge_rows:
        w, hit, ids = cut(text), set(), set()
        for run, of in windows.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    ids |= of
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        expected.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    same([tuple(r) for r in decontamination.decontaminate(edge_docs, benchmark).collect()], expected)
    clean = decontamination.keep_clean(edge_docs, benchmark)
    assert clean.columns == edge_docs.columns and clean.count() == sum(not x[-1] for x in expected)
    assert decontamination.decontaminate(edge_docs, benchmark.filter("item_id = 3")).filter("n_hit > 0").count() == 0


# Toxicity


def near_by_force(docs, items, window, slop, misses):
    out = {}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for doc_id, text in docs:
        w = split(text)
        for item_id, item in items:
            words_ = split(item)
            for a in range(max(len(words_) - window, 0) + 1 if words_ else 0):
                win = words_[a : a + window]
                need = len(win) - misses * len(win) // window
                for start in range(-len(win) - slop, len(w) + slop + 1):
                    n = sum(x in w[max(start + i - slop, 0) : max(start + i + slop + 1, 0)] for i, x in enumerate(win))
                    if n >= need and item_id is not None:
                        out[doc_id, item_id, start] = max(n, out.get((doc_id, item_id, start), 0))
    return [(*k, n) for k, n in out.items()]


@pytest.mark.parametrize("window,slop,misses", [(13, 0, 0), (13, 1, 2), (5, 2, 1), (4, 1, 0)])
def test_proximity_by_force(spark, window, slop, misses):
    rng = random.Random(window)
    draw = lambda n: [rng.choice("abcdefghijklmnopqrstuvwx") + str(rng.randrange(4)) for _ in range(n)]
    items = [(f"i{k}", " ".join(draw(n))) for k, n in enumerate([30, 20, 13, 9, 4, 1])] + [(None, " ".join(draw(14))), ("null", None)]
    docs = []
    for k in range(30):
        w = draw(20)
        for _, item in items[:4]:
            part = item.split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = draw(rng.randrange(2))  # changed, put in or left out
            w[rng.randrange(20) : 0] = part
            w += part if rng.random() < 0.5 else []
        docs.append((k, " ".join(w)))
    docs += [(90, None), (91, ""), (0, docs[0][1]), (92, items[5][1])]
    found = decontamination.proximity_matches(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), window, slop, misses
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(near_by_force(docs, items, window, slop, misses))


def test_segments_against_all_cuts():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(1, 14)).astype(float)
        found = toxicity.segments(scores)
        best = max([0.0, *(scores[a:b].sum() for a, b in combinations(range(len(scores) + 1), 2))])
        assert max([0.0, *(s for _, _, s in found)]) == best
        assert all(scores[a:b].sum() == s > 0 for a, b, s in found)
        # Disjoint, and no positive word is left out.
        covered = [i for a, b, _ in found for i in range(a, b)]
        assert len(covered) == len(set(covered)) and {int(i) for i in np.flatnonzero(scores > 0)} <= set(covered)


def test_toxicity_learns_words(spark, edge_docs):
    rows = [(i, " ".join(f"n{zlib.crc32(b'%d %d' % (i, j)) % 50}" for j in range(60)) + (" vileword" * 2 if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs.filter("doc_id < 400"), labels))
    found = toxicity.score(docs.filter("doc_id >= 400"), model, True).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in found)
    # Passages are what chance hardly gives; in texts this small that is not every toxic one.
    assert all(not r.passages for r in found if r.doc_id % 5) and all(p.expected <= toxicity.SIGNIFICANT for r in found for p in r.passages)
    # Passages are what chance hardly gives; in texts this small that is not every toxic word.
    assert all(not r.passages for r in found if r.doc_id % 5) and all(p.expected <= toxicity.SIGNIFICANT for r in found for p in r.passages)
    edges = toxicity.score(edge_docs, model).collect()
    assert len(edges) == edge_docs.count() and all(0 <= r.score < 0.7 for r in edges)
    nothing = toxicity.fit(toxicity.labelled(docs, labels.filter("toxic = 0")))
    assert {r.score for r in toxicity.score(edge_docs, nothing).collect()} == {0.0}


# Language model


def test_lm_scores_against_plain_ppm(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAVY", 40)
    monkeypatch.setattr(lm_scoring, "NODES", 3000)
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    small = edge_docs.filter("text IS NULL OR length(text) < 5000")
    train = [r[1] or "" for r in rows if r[0] is not None and r[0] % 2 == 0]
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    low = [t.translate(LOW).encode() for t in train]
    order = lm_scoring.ORDER
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    total = 0
    for t in low:
        p = b"\xff" * order + t + b"\xff"
        for j in range(order, len(p)):
            total += 1
            for k in range(order + 1):
                trie[k][p[j - k : j]][p[j]] += 1
    trie = [{c: f for c, f in level.items() if sum(f.values()) * 3000 >= total} for level in trie]

    def log10(p, j):
        seen, out = set(), 0.0
        for k in range(order, -1, -1):
            found = {s: c for s, c in trie[k].get(p[j - k : j], {}).items() if s not in seen}
            if not found:
                continue
            t, d = sum(found.values()), len(found)
            if p[j] in found:
                return out + math.log10((2 * found[p[j]] - 1) / (2 * t))
            out += math.log10(d / (2 * t))
            seen |= set(found)
        return out - math.log10(256 - len(seen))

    expected = {}
    for doc_id, text, *_ in rows:
        tokens = [*words(text), None]
        p = b"\xff" * order + (text or "").translate(LOW).encode() + b"\xff"
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        known = sum(counts[w] > 0 for w in tokens)
        expected[doc_id, len(tokens)] = (known, n, base, sum(log10(p, j) for j in range(order, len(p))))
    found = lm_scoring.score(small, small.filter("doc_id % 2 = 0")).collect()
    assert len(found) == len(rows)
    for r in found:
        known, n_train, base, score = expected[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens) == (known, n_train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_lm_without_training(edge_docs, no_docs):
    found = lm_scoring.score(edge_docs.filter("doc_id < 5"), no_docs).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in found)


@pytest.mark.parametrize("nodes, merge", [(0, 50), (40, 1 << 20)])
def test_lm_keeps_rare_contexts(spark, monkeypatch, nodes, merge):
    """Scores are those of the whole trie, however few entries are looked up in tasks."""
    monkeypatch.setattr(lm_scoring, "NODES", nodes)
    monkeypatch.setattr(lm_scoring, "MERGE", merge)
    texts = ["seldom banana", "banal bandana " * 9, "", None, "a\xe9\u20acb", "BANANA split", "bananas", "zzz\x00q"]
    rows = [(i % 7, t) for i, t in enumerate(texts)]
    learned = [(t or "").translate(LOW).encode() for i, t in rows if i < 4]
    counts = defaultdict(Counter)
    for t in learned:
        p = b"\xff" * lm_scoring.ORDER + t + b"\xff"
        for j in range(lm_scoring.ORDER, len(p)):
            for k in range(lm_scoring.ORDER + 1):
                counts[p[j - k : j]][p[j]] += 1

    def log10(p, j):
        seen, out = set(), 0.0
        for k in range(lm_scoring.ORDER, -1, -1):
            found = {s: c for s, c in counts.get(p[j - k : j], {}).items() if s not in seen}
            if p[j] in found:
                return out + math.log10((2 * found[p[j]] - 1) / (2 * sum(found.values())))
            out += math.log10(len(found) / (2 * sum(found.values()))) if found else 0.0
            seen |= set(found)
        return out - math.log10(256 - len(seen))

    expected = []
    for i, t in rows:
        p = b"\xff" * lm_scoring.ORDER + (t or "").translate(LOW).encode() + b"\xff"
        expected.append((i, sum(log10(p, j) for j in range(lm_scoring.ORDER, len(p)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.score) for r in lm_scoring.score(docs, docs.filter("doc_id < 4")).collect())
    assert found == [(i, pytest.approx(s, rel=1e-9)) for i, s in sorted(expected)]


# Empty tables


def test_empty_tables(spark, no_docs, edge_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(edge_docs.filter("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0
    assert language_id.identify(no_docs, no_docs).count() == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert substring_dedup.dedup_passages(no_docs).count() == 0
    assert decontamination.decontaminate(no_docs, nothing).count() == 0
    assert toxicity.score(no_docs, toxicity.fit(toxicity.labelled(no_docs, labels))).count() == 0
    assert lm_scoring.score(no_docs, no_docs).count() == 0


def joins(text):
    return sum("Join" in line and line.startswith("(") for line in text.splitlines())


def test_stages_end_in_small_plans(spark, plan):
    """What a stage finds is written before its documents meet it: joins and groups that find it are in no plan with the texts."""
    passage = "the quick brown fox jumps over the lazy dog"
    rows = [(i, f"{passage} and then {i}" if i else None, "ab"[i % 2]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Places meet their windows, and documents their places.
    assert joins(plan(decontamination.keep_clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")))) == 2
    # Documents meet their source, block, cell and, in the cut cell, themselves.
    assert joins(plan(mixing.mix_rows(docs))) == 4
    # Each of the two halves of what is kept meets what is gone and what comes twice.
    assert joins(plan(near_dedup.keep_one(docs))) == 4


@pytest.mark.parametrize("used, at_once, collected", [(24, False, 0), (26, False, 1), (26, True, 1), (1, True, 1)])
def test_the_driver_collects_at_a_quarter_of_its_heap(used, at_once, collected):
    class Jvm:
        def __init__(self):
            self.java = self.lang = self.Runtime = self.System = self
            self.collected = 0

        def getRuntime(self):
            return self

        def totalMemory(self):
            return 50

        def freeMemory(self):
            return 50 - used

        def maxMemory(self):
            return 100

        def gc(self):
            self.collected += 1

    jvm = Jvm()
    frames.release(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)), at_once=at_once)
    assert jvm.collected == collected
