"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find grouping.

SuperMinHash ranks the slots for every element by a random permutation and keeps, per slot, the smallest
(round, value). Values of one round are below all values of the next, so a document stops as soon as each
slot is filled: a few hundred shingles need one or two rounds, not one hash per slot and shingle.

Documents with one and the same set are one class (grouped by a 128-bit digest, partly aggregated before the
shuffle), so thousands of copies cost one row. Classes are banded; within a bucket, members are first compared
with one pivot and not with each other. Where that leaves a bucket in several components, the members outside the
largest one are residents of bounded blocks, and the others stream past them: all pairs that are still apart are
compared exactly, through an inverted index of the block, and only joining links are put out. A family of many blocks
goes another exact way: two linked sets share one of their rarest shingles (a prefix as long as the threshold needs),
so members meet by these and not all with all. No link between bucket mates is lost, and no table of all pairs is made.

Defined cases: null or empty text has an empty set and links with nothing; a text of fewer words than the
shingle width has one shingle; rows that repeat a doc_id count as one document by its smallest component and
largest set; a null doc_id is kept as a row of its own without links; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .bytesets import blocks, mix, shingle_sets
from .components import connected
from .storage import keep

_U = np.uint64


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set; an empty set has all slots open (all ones)."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(doc):
        return sig
    element = np.concatenate(sets)
    flat = sig.reshape(-1)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        draw = mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = j + (((draw & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        slot = to.copy()
        for i in range(j - 1, -1, -1):  # where the element's permutation has moved the slot found there
            np.copyto(slot, i, where=slot == swaps[i])
        value = (_U(j) << _U(56)) | (mix(draw + _U(0xD1B54A32D192ED03)) >> _U(8))
        np.minimum.at(flat, doc * slots + slot, value)
        swaps.append(to)
        short = (sig == np.iinfo(np.uint64).max).any(axis=1)[doc]
        if not short.any():
            break
        if not short.all():
            element, doc, swaps = element[short], doc[short], [s[short] for s in swaps]
    return sig


def band_digests(sig: np.ndarray, rows: int) -> np.ndarray:
    """One digest per band of `rows` slots, the band's number mixed in."""
    out = np.zeros((len(sig), sig.shape[1] // rows), dtype=np.uint64)
    for b in range(out.shape[1]):
        x = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            x = mix(x * _U(0x9FB21C651E98DF25) + sig[:, b * rows + r])
        out[:, b] = x
    return out


def _sign(width: int, slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                sets = shingle_sets(block, width)
                digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]).reshape(-1, 2)
                bands = band_digests(signatures(sets, slots), rows)
                size = pa.array([len(s) for s in sets], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), size, pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                sets = [s.tobytes() for s in shingle_sets(block, width)]
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), pa.array(sets, pa.binary())], ["cid", "elements"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = np.zeros(batch.num_rows, dtype=bool)
            last, left = None, None
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x is not last:
                    last, left = x, np.frombuffer(x, dtype=np.uint64)
                right = np.frombuffer(y, dtype=np.uint64)
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    continue
                both = np.sort(np.concatenate((left, right)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * common >= percent * (len(both) - common)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(good)], ["a", "b", "linked"])

    return run


def _stream(percent: int):
    """Residents (role 0) of a block come first; every later row (role 1) is compared with all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[tuple[int, int, np.ndarray]] = []
        index: tuple | None = None
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            found: list[tuple[int, int]] = []
            for pivot, salt, role, cid, component, packed in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if (pivot, salt) != at:
                    at, held, index, parent = (pivot, salt), [], None, {}
                elements = np.frombuffer(packed, dtype=np.uint64)
                if not role:
                    held.append((cid, component, elements))
                    continue
                if not held:
                    continue
                if index is None:
                    owner = np.repeat(np.arange(len(held)), [len(e) for _, _, e in held])
                    keys = np.concatenate([e for _, _, e in held])
                    order = np.argsort(keys, kind="stable")
                    index = keys[order], owner[order], np.array([len(e) for _, _, e in held])
                keys, owner, sizes = index
                low, high = np.searchsorted(keys, elements, "left"), np.searchsorted(keys, elements, "right")
                n = high - low
                ends = np.cumsum(n)
                hits = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + n, n)
                common = np.bincount(owner[hits], minlength=len(held))
                for k in np.flatnonzero(100 * common >= percent * (sizes + len(elements) - common)).tolist():
                    x, y = root(component), root(held[k][1])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        found.append((cid, held[k][0]))
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, block: int = 1024, most_blocks: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents tied by a chain of links of `percent` Jaccard or more.

    With 24 bands of 4 slots a pair at 0.8 shares a bucket with probability 1 - 3e-6.
    """
    signed = keep(docs.select("doc_id", "text").mapInArrow(_sign(width, bands * rows, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = keep(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid")), "classes")
    # A set of n differs from a linked one by one element at least, so 100 * n >= percent * (n + 1) must hold.
    fit = filled.where(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1) if percent < 100 else F.lit(False))
    heads = fit.join(classes.withColumnRenamed("cid", "doc_id"), ["d1", "d2", "doc_id"])
    entries = heads.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    mates = keep(entries.join(shared, "bucket"), "mates")
    if mates.isEmpty():
        links = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
        labels = connected(links).withColumnRenamed("node", "cid")
    else:
        labels = _link(docs, mates, width, percent, block, most_blocks)
    of_class = classes.join(labels, "cid", "left").select("d1", "d2", F.coalesce("component", "cid").alias("class_component"))
    named = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = named.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("class_component")).alias("component_id"))
    known = out.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return known.union(out.where("doc_id is null")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


_SALTS = 16


def _salted(members: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """`members` joined to `sizes` (one row per key), a large key's members spread over several tasks."""
    salt = F.pmod(F.xxhash64("cid"), F.lit(_SALTS)).cast("int")
    copies = sizes.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return members.withColumn("_spread", salt).join(copies, [key, "_spread"]).drop("_spread")


def _roles(members: DataFrame, resident: Column) -> DataFrame:
    """(pivot, salt, role, cid, component): each resident in one block (role 0), everybody once past every block (role 1).

    Those who pass a block are divided into `lanes`, each with a copy of the block's residents, so no task gets more
    than a block and a lane.
    """
    lane, block = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = lambda seed, of: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(of)).cast("int")
    salt = (F.col("block") * F.col("lanes") + F.col("lane")).cast("int").alias("salt")
    stay = members.where(resident).withColumn("block", own(1, "blocks")).withColumn("lane", lane).select("pivot", salt, F.lit(0).alias("role"), "cid", "component")
    return stay.union(members.withColumn("lane", own(2, "lanes")).withColumn("block", block).select("pivot", salt, F.lit(1).alias("role"), "cid", "component"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            e = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.int64)
            same = lambda k, n=len(e), i=i: pa.array(np.full(n, batch.column(k)[i].as_py(), dtype=np.int64))
            yield pa.record_batch([same(0), same(1), same(2), pa.array(np.full(len(e), len(e), dtype=np.int64)), pa.array(e)], ["pivot", "cid", "component", "n", "element"])


def _rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, component): the family's members by the rare shingles at which linked ones must meet; `pivot` names both.

    With shingles ordered by how many members have them, sets of n and m elements that share `percent` of their union
    have one in common among the first n - ceil(percent * n / 100) + 1 (and m likewise). Those of one member meet nobody.
    """
    held = members.join(sets, "cid").select("pivot", "cid", "component", "elements")
    each = keep(held.mapInArrow(_elements, "pivot long, cid long, component long, n long, element long"), "elements")
    shared = each.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("held_by"))
    place = F.row_number().over(Window.partitionBy("pivot", "cid").orderBy("held_by", "element"))
    ranked = each.join(shared, ["pivot", "element"]).withColumn("place", place)
    first = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1) & (F.col("held_by") > 1))
    return first.select(F.xxhash64("pivot", "element").alias("pivot"), "cid", "component").distinct()


def _link(docs: DataFrame, mates: DataFrame, width: int, percent: int, block: int, most_blocks: int) -> DataFrame:
    wanted = mates.select("cid").distinct()
    # Rows that repeat a doc_id may hold other texts: each set of such a document is compared.
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(wanted, "cid", "left_semi")
    sets = keep(texts.mapInArrow(_sets(width), "cid long, elements binary").distinct(), "sets")

    # Every member with its bucket's pivot.
    pivot = mates.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("p"))
    near = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    pairs = mates.join(pivot, "bucket").where((F.col("cid") != F.col("p.cid")) & near).select(F.col("p.cid").alias("a"), F.col("cid").alias("b")).distinct()
    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb")
    links = keep(joined.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), "links")
    labels = keep(connected(links).withColumnRenamed("node", "cid"), "labels")

    # Buckets that are still in several components; their pivot is now the member with most links, which
    # tends to be the same in all bands, so a member belongs to few families.
    degree = links.groupBy(F.col("b").alias("cid")).agg(F.count(F.lit(1)).alias("degree"))
    named = mates.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid")).join(degree, "cid", "left")
    hub = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("cid")).alias("c")))
    split = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), hub.alias("h")).where("low != high")
    family = keep(named.join(split.select("bucket", (-F.col("h.c")).alias("pivot")), "bucket").select("pivot", "cid", "component").distinct(), "families")
    if family.isEmpty():
        return labels
    sizes = family.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("k"))
    whole = sizes.groupBy("pivot").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("top"))
    whole = keep(whole.select("pivot", F.col("top.component").alias("largest"), F.ceil((F.col("all") - F.col("top.k")) / block).cast("int").alias("blocks"), F.ceil(F.col("all") / block).cast("int").alias("lanes")).where("blocks > 0"), "sizes")
    few = _salted(family, whole.where(F.col("blocks") <= most_blocks), "pivot")
    rows = _roles(few, F.col("component") != F.col("largest"))
    many = whole.where(F.col("blocks") > most_blocks)
    if not many.isEmpty():
        rare = keep(_rare_shingles(_salted(family, many, "pivot").select("pivot", "cid", "component"), sets, percent), "rare-shingles")
        meeting = rare.groupBy("pivot").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        meeting = meeting.select("pivot", *[F.ceil(F.col("k") / block).cast("int").alias(c) for c in ("blocks", "lanes")])
        rows = rows.union(_roles(_salted(rare, meeting, "pivot"), F.lit(True)))
    rows = rows.join(sets, "cid").select("pivot", "salt", "role", "cid", "component", "elements")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    more = keep(dealt.mapInArrow(_stream(percent), "a long, b long"), "more-links")
    if more.isEmpty():
        return labels
    joined = connected(links.union(more))
    return joined.withColumnRenamed("node", "cid")
