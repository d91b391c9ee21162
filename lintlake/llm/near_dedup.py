"""Near-duplicate documents by HyperMinHash.

Every document's set of word shingles becomes ``BUCKETS`` registers: a shingle's 64-bit hash
names a bucket, and the bucket keeps its smallest remainder as a count of leading zeros (6
bits) and the 26 bits after the first one.  Bands of registers are joined; candidates pass a
Jaccard estimate from the registers, corrected for chance collisions, and are confirmed on
the full sets.

Few shingles leave most registers empty, and the bands then fail together.  Sets of at most
``SPARSE`` shingles therefore meet by their rarest members instead (see _rare_members): no link between two of
them is lost.  A set keeps its bands if it may be linked to a larger one.

* Documents with equal sets become one class before any join, so copies are never paired.
* Members of one band are compared with its smallest, not with each other, and where that
  leaves several components, with one more.
* What is then still apart is compared across components if it shares a rare difference from
  the band's reference: a linked pair must (see _differences), so no link is lost, and sets that
  are alike only in what very many share are never paired.
* A band or member of very many classes is a plain equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .components import components
from .decontamination import small
from .frames import text_hash, written

_U = np.uint64
BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 26
ROWS = 8  # registers a band
BANDS = BUCKETS // ROWS
SPARSE = 256  # members of a set that is joined by its rarest ones
HOT = 1 << 18  # members that make up 1 / HOT of all in sparse sets are looked up in tasks
SURE = 6  # standard errors by which an estimate must miss the threshold to drop a candidate

_FACTORS = B.random_words(64, 3) | _U(1)
_BAND_SALT = B.random_words(BANDS, 5)
_START = (B.random_words(BUCKETS, 7) % _U(BUCKETS)).astype(np.int64)


def shingle_sets(content: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    with np.errstate(over="ignore"):
        starts, ends, first = B.words(content, bounds)
        hashes = B.span_hashes(content, starts, ends)
        n = len(hashes)
        rolled = np.zeros(max(n - width + 1, 0), _U)
        for i in range(width):
            rolled += hashes[i : n - width + 1 + i] * _FACTORS[i]
        rolled = B.splitmix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = (hashes[a:b] * _FACTORS[32 : 32 + b - a]).sum(dtype=_U) + _U(b - a)
                yield B.splitmix(np.array([short], _U))
            else:
                yield np.zeros(0, _U)


def registers(members: np.ndarray) -> np.ndarray:
    """One 32-bit register a bucket, 0 where the bucket is empty; ``members`` is sorted."""
    out = np.zeros(BUCKETS, np.uint32)
    bucket = (members >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (members[first] << _U(BUCKET_BITS)) >> _U(11)  # 53 bits: exact as a double
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest > 0, 53 - exponent, 63).astype(np.uint32)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).clip(0).astype(np.uint32)
    out[bucket[first]] = ((zeros + 1) << np.uint32(MANTISSA_BITS)) | mantissa  # + 1: never 0
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key a band and row of ``sketches``; empty registers borrow the next full one after a fixed random place."""
    with np.errstate(over="ignore"):
        filled = sketches > 0
        # Per row, the next full bucket at or after each bucket, going round.
        twice = np.concatenate([filled, filled], axis=1)
        place = np.where(twice, np.arange(2 * BUCKETS), 2 * BUCKETS)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS] % BUCKETS
        source = np.where(filled, np.arange(BUCKETS), following[:, _START])
        value = np.take_along_axis(sketches, source, axis=1).astype(_U) + (source.astype(_U) << _U(32))
        value = B.splitmix(value).reshape(len(sketches), BANDS, ROWS)
        return B.splitmix((value * _FACTORS[:ROWS]).sum(axis=2, dtype=_U) + _BAND_SALT)


def estimated_jaccard(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Jaccard similarity from registers, corrected for chance collisions, and its standard error.

    Two different minima of a bucket agree by chance when their leading zeros and their
    mantissas agree: 2**-26 times the sum of 4**-z over z, a third.
    """
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    if not n:
        return 0.0, 1.0
    chance = 2.0**-MANTISSA_BITS / 3
    share = float(((a == b) & either).sum()) / n
    j = min(max((share - chance) / (1 - chance), 0.0), 1.0)
    return j, max((j * (1 - j) / n) ** 0.5, 1 / n)


def _sketch_batches(width: int, threshold: int | None = None):
    """Sets and registers of classes, or, with a threshold, what classes and candidates are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                content, bounds = B.flat(piece.column("text"))
                sets = list(shingle_sets(B.lower(content), bounds, width))
                with np.errstate(over="ignore"):
                    sizes = np.array([len(s) for s in sets], np.int64)
                    if threshold is None:
                        columns = [
                            pa.array([s.tobytes() for s in sets], pa.binary()),
                            pa.array([registers(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays([piece.column("rep"), *columns], names=["rep", "members", "sketch"])
                        continue
                    one = np.array([B.splitmix(s).sum(dtype=_U) for s in sets], _U)
                    two = np.array([B.splitmix(s ^ _FACTORS[9]).sum(dtype=_U) for s in sets], _U)
                    # Linked sets have at least threshold / 100 of each other's size: below this, only sparse ones.
                    some = 100 * sizes > threshold * SPARSE
                    keys = np.zeros((len(sets), BANDS), _U)
                    if some.any():
                        keys[some] = band_keys(np.stack([registers(s) for s, banded in zip(sets, some, strict=True) if banded]))
                    sparse = [s if len(s) <= SPARSE else s[:0] for s in sets]
                where = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
                upto = np.concatenate([[0], np.cumsum([len(s) for s in sparse])])
                members = np.concatenate([np.zeros(0, _U), *sparse]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("_h"),
                        pa.array(sizes),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(members)),
                    ],
                    names=["doc_id", "_h", "n_shingles", "f1", "f2", "bands", "sparse"],
                )

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("sketch_a", "sketch_b", "members_a", "members_b")]
            for i in range(batch.num_rows):
                sa, sb, ma, mb = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, ("u4", "u4", "u8", "u8"), strict=True))
                if max(len(ma), len(mb)) > SPARSE:
                    j, error = estimated_jaccard(sa, sb)
                    if 100 * (j + SURE * error) < threshold:
                        keep.append(False)
                        continue
                both = len(np.intersect1d(ma, mb, assume_unique=True))
                keep.append(100 * both >= threshold * (len(ma) + len(mb) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, members, sketch) of the classes named in ``wanted``, from one text of each."""
    chosen = reps.join(wanted, "rep").select("rep", "_id", "_h")
    # One row a class: identical rows would only repeat it.
    texts = docs.join(small(chosen, F.lit(32)), ["_id", "_h"]).select("rep", "text")
    sets = texts.mapInArrow(_sketch_batches(width), "rep long, members binary, sketch binary")
    return written(sets.dropDuplicates(["rep"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of class names that hold on the full shingle sets."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("members").alias(f"members_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return written(joined.mapInArrow(_confirm(threshold), "a long, b long"), "confirmed")


def _rare_members(reps: DataFrame, threshold: int) -> DataFrame:
    """(rep, band): the rarest members of each sparse set that other sparse sets have as well.

    Linked sets share at least o = ceil(t * n) of the n members of either, so both have one
    among their first n - o + 1, in any order common to all.  Here the order is how many sets have a member, then
    the member; those of one set only come first and are never joined.
    """
    each = reps.select("rep", "n_shingles", F.explode("sparse").alias("member"))
    counts = written(each.groupBy("member").agg(F.count("*").alias("n")).filter("n > 1"), "shared-members")
    # No hot key in the join of the rest; at most HOT members are above the bound.
    hot = F.col("n") * HOT >= (counts.agg(F.sum("n")).first()[0] or 0)
    marked = each.join(F.broadcast(counts.filter(hot)), "member", "left")
    rest = marked.filter("n IS NULL").drop("n").join(small(counts.filter(~hot), F.lit(24)), "member")
    shared = marked.filter("n IS NOT NULL").unionByName(rest)
    ordered = shared.groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "member"))).alias("own"))
    first = F.expr(f"n_shingles - (n_shingles * {threshold} + 99) div 100 + 1")
    taken = F.greatest(first - (F.col("n_shingles") - F.size("own")), F.lit(0)).cast("int")
    return ordered.select("rep", F.explode(F.slice("own", F.lit(1), taken)).alias("m")).select("rep", F.col("m.member").alias("band"))


COUNTERS = 1 << 20


def _count_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for members in batch.column("members"):
            slots = (np.frombuffer(members.as_buffer(), "u8") % _U(COUNTERS)).astype(np.int64)
            total += np.bincount(slots, minlength=COUNTERS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def _differences(sets: DataFrame, led: DataFrame, threshold: int) -> DataFrame:
    """(ref, rep, n, d, at, member): the rarest members in which each set differs from its reference.

    ``led`` has (ref, rep).  Linked sets x and y differ in at most T = (1 - t) / (1 + t) *
    (n_x + n_y) members.  If one of them is not linked to their reference, and they differ from
    it in d_x and d_y members, more of these are common than (d_x + d_y - T) / 2 > 0, so x and
    y share one among the first (d_x - d_y + T) / 2 + 1 of x and (d_y - d_x + T) / 2 + 1 of y, in
    any order common to all.  What all have in common with the reference is no difference, and
    what all lack of it comes last, so a large group of similar sets meets in few places.
    Rarity comes from COUNTERS counters over all differences; it only orders.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for theirs, own in zip(batch.column("leader"), batch.column("members"), strict=True):
                own, theirs = np.frombuffer(own.as_buffer(), "u8"), np.frombuffer(theirs.as_buffer(), "u8")
                sizes.append(len(own))
                out.append(np.setxor1d(own, theirs, assume_unique=True).tobytes())
            columns = [batch.column("ref"), batch.column("rep"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ref", "rep", "n", "members"])

    own = sets.select("rep", "members")
    both = led.join(own, "rep").join(own.select(F.col("rep").alias("ref"), F.col("members").alias("leader")), "ref")
    whole = written(both.select("ref", "rep", "leader", "members").mapInArrow(differ, "ref long, rep long, n long, members binary"), "whole-differences")
    counts = whole.select("members").mapInArrow(_count_members, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rarity = np.zeros(COUNTERS, np.int64)
    for row in counts.toLocalIterator():  # at most COUNTERS rows
        rarity[row["slot"]] = row["n"]
    shared = sets.sparkSession.sparkContext.broadcast(rarity)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ref", "rep", "n")]
            for ref, rep, n, members in zip(*columns, batch.column("members"), strict=True):
                other = np.frombuffer(members.as_buffer(), "u8")
                order = np.lexsort((other, shared.value[(other % _U(COUNTERS)).astype(np.int64)]))
                chosen = other[order[: (100 - threshold) * n // threshold + 2]]
                k = len(chosen)
                out = [*(np.full(k, x, np.int64) for x in (ref, rep, n, len(other))), np.arange(1, k + 1), chosen.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["ref", "rep", "n", "d", "at", "member"])

    return whole.mapInArrow(first, "ref long, rep long, n long, d long, at long, member long")


def _split(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, rep, component, main): members of bands with several components; main is the largest of them."""
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = written(placed.select("band", "rep", "component"), "placed")
    counted = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    return written(placed.join(main.filter("parts > 1").drop("parts"), "band"), "split")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(doc_id, _id, _h, n_shingles, component, component_id) per row of ``docs``; component is null for an empty set."""
    docs = docs.select("doc_id", "text").withColumns({"_id": F.coalesce("doc_id", F.lit(-(2**63))), "_h": text_hash()})
    schema = "doc_id long, _h long, n_shingles long, f1 long, f2 long, bands array<long>, sparse array<long>"
    sketched = docs.select(F.col("doc_id").cast("long"), "_h", "text").mapInArrow(_sketch_batches(width, threshold), schema)
    rows = written(sketched.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))), "sketches")

    # Classes of equal sets, named by the smallest (doc_id, text) of theirs.
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("least"), F.min_by(F.struct("_id", "_h", "bands", "sparse"), F.struct("_id", "_h")).alias("of")
    )
    reps = written(
        classes.select("f1", "f2", "n_shingles", "least", "of._id", "of._h", "of.bands", "of.sparse").withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )

    keys = reps.select("rep", F.explode("bands").alias("band")).unionByName(_rare_members(reps, threshold)).distinct()
    keys = written(keys, "keys")
    shared = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).filter("n > 1")
    members = written(keys.join(shared, "band").select("band", "rep", "leader"), "members")
    pairs = written(members.filter("rep <> leader").select(*_pair("leader", "rep")).distinct(), "pairs")
    named = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = _sets(docs, reps, named, width)
    links = _links(pairs, sets, threshold)
    found = components(links)

    split = _split(members.drop("leader"), found)
    if not split.isEmpty():
        # Another leader in each band, a different one from band to band.
        first = split.groupBy("band").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("band", "rep")).alias("l"))
        more = split.join(first, "band").filter("component <> l.component").select(*_pair("rep", "l.rep")).distinct()
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        rest = split.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti")
        sets = sets.unionByName(_sets(docs, reps, rest, width))
        links = links.unionByName(_links(more, sets, threshold))
        found = components(links)
        pairs = pairs.unionByName(more)
        split = _split(members.drop("leader"), found)
    if not split.isEmpty():
        # What is still apart: every set with its band's reference, the smallest of the largest component, and every
        # pair of one band across components that shares a rare difference from it.
        inside = split.select("rep", "component").distinct()
        apart = split.filter("component <> main").select("rep").distinct().withColumn("apart", F.lit(True))
        led = written(split.select(F.col("main").alias("ref"), "rep").distinct().filter("ref <> rep"), "references")
        different = _differences(sets, led, threshold).join(inside, "rep").join(apart, "rep", "left")
        different = written(different, "differences")
        x = different.filter("apart").select("ref", "member", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "d", "at", "component")])
        most = (100 - threshold) / (100 + threshold) * (F.col("n") + F.col("x_n"))
        within = lambda at, d, e: 2 * (at - 1) <= d - e + most + 1e-6
        across = different.join(x, ["ref", "member"]).filter(
            (F.col("component") != F.col("x_component"))
            & within(F.col("at"), F.col("d"), F.col("x_d"))
            & within(F.col("x_at"), F.col("x_d"), F.col("d"))
        )
        across = across.select(*_pair("rep", "x_rep")).union(led.join(apart, "rep", "left_semi").select(*_pair("ref", "rep"))).distinct()
        across = written(across.join(pairs, ["a", "b"], "left_anti"), "across")
        found = components(links.unionByName(_links(across, sets, threshold)))

    named = reps.select("rep", "f1", "f2", "n_shingles", "least").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(smallest, "component").select("f1", "f2", "n_shingles", "component", "component_id")
    out = rows.select("doc_id", "_id", "_h", "n_shingles", "f1", "f2").join(answer, ["f1", "f2", "n_shingles"], "left")
    return out.drop("f1", "f2")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of ``width`` words, ASCII letters in lower
    case; with fewer words, the whole sequence; null and blank texts have an empty set and no
    link.  Two documents are linked if 100 * intersection >= threshold * union.  component_id
    is the smallest doc_id reachable; a null doc_id links like any other but names no
    component unless its whole component is null.  kept: doc_id equals component_id.
    Repeated rows appear as often as they are given.  Other columns are ignored.
    """
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = groups(docs, width, threshold).select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without all but one of each group of near-duplicates.

    Texts without words stay.  The smallest doc_id of a group stays; of rows equal in doc_id and text, one, and of a
    group of null doc_id only, the one with the smallest hash of its text.
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), text_hash().alias("_h"))
    found = written(groups(keyed.select("doc_id", "text"), width, threshold).filter("component IS NOT NULL"), "groups")
    of_group = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "_id", "_h")).alias("k"))
    gone = found.join(of_group, "component").filter((F.col("_id") != F.col("k._id")) | (F.col("_h") != F.col("k._h")))
    gone = written(gone.select("_id", "_h").distinct(), "gone")
    twice = found.groupBy("_id", "_h").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_h", F.lit(True).alias("twice"))
    twice = written(twice, "twice")
    kept = keyed.join(small(gone, F.lit(16)), ["_id", "_h"], "left_anti").join(small(twice, F.lit(24)), ["_id", "_h"], "left")
    once = kept.filter("twice IS NULL").select("row.*")
    return once.unionByName(kept.filter("twice").dropDuplicates(["_id", "_h"]).select("row.*"))
