"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has 64 bits; bit i is 1 if it is set in over half the XXH64 values (seed 42) of the
text's word shingles, repeats included.  Fingerprints are linked if they differ in at most
``bits`` of them.

Such a pair differs in at most ``bits`` of the eight bytes, so at least m = 8 - bits positional bytes
are shared: the guaranteed count.  The inverted index holds, for every set of m positions, a
posting list by the bytes there.  Lists of single bytes would hold 1/256 of all fingerprints
and be quadratic; with m = 5 a list is chosen by 40 bits, and each pair that reaches the count has one in common.

* Equal fingerprints are one class before the index, so copies (and all empty texts) are one posting.
* A short list is paired; shared bytes are tallied per pair, those below the count are dropped and the rest is verified.
* A list of more than ``SHORT`` fingerprints is never paired.  Its members differ in the 8 * bits other
  bits only, so they meet in codes: y and x differ in at most 3 bits exactly if some code is
  within 2 of y and within 1 of x.  All within 1 of a code are linked with each other, and with all that are within
  2, so links to the smallest of the former join everything.  A code has at most 301 members: linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import written

SHORT = 32  # fingerprints of a list that is paired
SEED = 42
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of one text, as an unsigned number; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and 0x20, 0x09-0x0D only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, k = np.concatenate([[0], ends[:-1]]), max(len(words) - width + 1, 1)
    last = ends[-k:] - 1
    total = np.zeros(64, np.int64)
    for at in range(0, k, _CHUNK):
        pairs = zip(starts[at : min(at + _CHUNK, k)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > k).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) per row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: int) -> list[int]:
    """The bytes of every posting: one mask for each set of 8 - bits positions."""
    return [sum(0xFF << (8 * i) for i in positions) for positions in combinations(range(8), 8 - bits)]


def _flips(spark, bits: int) -> DataFrame:
    """(list, flip, near): the changes of up to half the bits, rounded up, outside each mask; near if rounded down."""
    rows = []
    for at, mask in enumerate(_masks(bits)):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        for n in range((bits + 1) // 2 + 1):
            rows += [(at, _signed(sum(chosen)), n <= bits // 2) for chosen in combinations(free, n)]
    return spark.createDataFrame(rows, "list int, flip long, near boolean")


def links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` (distinct fp) within ``bits`` bits."""
    spark = fps.sparkSession
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _masks(bits)])
    postings = fps.select("fp", F.posexplode(masked).alias("list", "bytes"))
    # One shuffle and a sort: a list has at most 2 ** (8 * bits) distinct fingerprints, and they are only counted.
    length = F.count("*").over(Window.partitionBy("list", "bytes"))
    shared = written(postings.withColumn("n", length).filter("n > 1"), "postings")

    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = F.bit_count(apart) <= bits
    tally = sum((F.shiftrightunsigned(apart, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    short = shared.filter(F.col("n") <= SHORT).groupBy("list", "bytes").agg(F.collect_list("fp").alias("fps"))
    pairs = short.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
    paired = pairs.filter((tally >= 8 - bits) & near).distinct()

    coded = shared.filter(F.col("n") > SHORT).join(F.broadcast(_flips(spark, bits)), "list")
    coded = coded.select("list", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("code"), "near")
    hubs = coded.groupBy("list", "code").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.collect_list("fp").alias("fps"))
    met = hubs.filter("b IS NOT NULL AND size(fps) > 1").select("b", F.explode("fps").alias("a"))
    return paired.unionByName(met.filter((F.col("a") != F.col("b")) & near).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text).

    Words are runs without ASCII blanks, A-Z in lower case; a text with fewer words than ``width`` is one
    shingle; null, empty and blank texts have fingerprint zero, linked like any other.  bits is 0 to 4.
    component_id is the smallest doc_id reachable; a null doc_id links like any other but names no component
    unless its whole component is null.  Repeated rows appear as often as they are given.  Other columns are ignored.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    found = components(links(classes.select("fp"), bits)).withColumnRenamed("node", "fp")
    placed = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = written(placed.join(smallest, "component").select("fp", "component_id"), "fingerprint-components")
    return rows.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
