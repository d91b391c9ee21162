"""Vectors, archives and the pipeline."""

import base64
import hashlib
import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import neighbours, warc


def test_nearest_on_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows = [r for r in rows if r[0] != 150]
    rows += [(200 + i, [1.0] + [0.0] * 5) for i in range(40)] + [(150, [2.0] + [0.0] * 5), (50, rows[50][1])]
    bad = [(1000, None), (1050, [0.0] * 6), (1100, [nan] * 6), (1150, [inf] + [0.0] * 5), (1200, []), (1250, [None, 1.0]), (None, [1.0] * 6)]
    other = [(1300, [1.0, 2.0]), (1301, [2.0, 1.0])]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    found = {}
    for r in neighbours.nearest(df, every=50, k=5).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    real = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    expected = {}
    for q in (x for x in real if x % 50 == 0):
        scores = [(-float(np.dot(real[q], v) / np.sqrt(np.dot(real[q], real[q]) * np.dot(v, v))), i) for i, v in real.items() if i != q]
        expected[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:5]]
    assert {q: [r[k][0] for k in sorted(r)] for q, r in found.items() if q != 1300} == expected
    assert found[1300] == {1: (1301, pytest.approx(0.8))}
    assert neighbours.nearest(df.filter("vec_id >= 1000 AND vec_id < 1300")).count() == 0


def test_nearest_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = vectors.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(vectors, every=10).collect()}
    wanted = set()
    for i in np.flatnonzero(ids % 10 == 0):
        scores = np.where(ids == ids[i], -9, x @ x[i])
        wanted |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-scores)[:5]}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = neighbours._unit(rng.normal(size=(400, 8)))
    label = neighbours.balanced_parts(neighbours.neighbour_graph(x, 5), 8, rng)
    assert np.bincount(label, minlength=8).tolist() == [50] * 8


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (5, None, "<p>same</p>"), (2, "http://b/\r\nX: y", "ünï \x00 bytes"),
    (3, "u", None), (4, "u", ""), (None, "u", "<p>same</p>"), (None, "u", "alone"), (7, "u", "big" * 300000), (9, "http://a/9", "<p>same</p>"),
]


@pytest.mark.parametrize("min_bytes", [0, 5, 20])
def test_warc_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    expected = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        holders = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        holder = max(holders) if holders and len(payload) >= min_bytes else page_id
        revisit = holder != page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((page_id, len(payload), digest, "revisit" if revisit else "response", holder if revisit else None, None if revisit else payload))
    found = warc.round_trip(pages, min_bytes).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in found]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(expected)
    assert warc.round_trip(pages.filter("page_id < 0")).count() == 0


def test_reader_refuses_damage():
    record = warc.encode_record(1, "u", b"payload", warc.digest_of(b"payload"), "response", None)
    assert warc.decode_record(record)["payload"] == b"payload"
    for bad in (record[:-1], record.replace(b"payload", b"paylaod"), record.replace(b"WARC/1.1", b"WARC/0.9"), record.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.decode_record(bad)
    raw = b"some words " * 50
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    archive = warc.dictionary_frame(raw) + coder.compress(record) * 3
    assert len(list(warc.read_archive(io.BytesIO(archive)))) == 3
    assert len(list(warc.read_archive(io.BytesIO(zstandard.compress(record))))) == 1
    assert list(warc.read_archive(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(archive[:-5])))


def test_pipeline_on_edges(spark, edge_docs, tmp_path):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    passage = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before
    texts = [r.text for r in docs.collect()]
    assert all(any(c.isalpha() for c in t) for t in texts) and not any("owls" in t for t in texts)
    assert sum("w100x" in t for t in texts) <= 2 and "one" in texts
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and all(r.taken > 0 for r in mixed)
