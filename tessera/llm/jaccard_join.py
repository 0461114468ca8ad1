"""N-gram Jaccard join (5): grouped prefix join over sets of word shingles.

Documents with one sequence of words are one class. Shingles have a global order, rare ones
first; the prefix of a set of n is its first n - ceil(t n) + 1 shingles, and two sets of
similarity t share a shingle of their prefixes. Classes with one prefix and size are one
group, and groups join on prefix shingles. Group pairs are filtered by size, by position, by
how many prefix shingles they share and by signatures; then their members are expanded and
verified on whole sets.

Links are found in two passes, so that a group of thousands of near copies costs no
quadratic number of pairs: first each group meets its neighbour in the list of each shingle,
and what is verified is contracted to components; then every pair of different components
that passes the filters is verified. No link between different components is missed, as the
second pass is the whole join less the pairs already connected.

64-bit hashes of shingles only propose candidates. Shingles of one document with equal hashes
are compared by their words and count as often as they differ, so the size of a set and the
length of its prefix are exact; classes are told apart by sha256 of their words; and a
candidate pair is verified on its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import sketch
from tessera.llm import textkernel as K
from tessera.llm.components import connected
from tessera.llm.exact_dedup import content_digest
from tessera.llm.storage import free_names, hot_split_join, materialise

SHINGLE = 5
PERCENT = 80
CHUNK_BYTES = 4 << 20
#: Cells of the table of frequent shingles.
SKETCH_BITS = 24
#: A shingle in so many prefixes moves towards the end of the order.
OFTEN = 3
#: A list of a shingle is split into segments of about this many rows; in the second pass segments meet pairwise.
SEGMENT_BITS = 13
#: Longs of a signature.
SIGNATURE = 4

_SIGNS = [f"s{k}" for k in range(SIGNATURE)]


class _Shingled:
    """The shingles of a list of texts: their words, and a 64-bit hash of each shingle in order of place."""

    def __init__(self, texts: list[bytes], width: int):
        self.width = width
        self.units = units = K.units_of(texts, lower=True)
        self.count = count = np.diff(units.first)
        full = K.window_hash(units.hash, width)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        bound = np.concatenate(([0], np.cumsum(n)))
        self.hash = out = np.zeros(bound[-1], np.uint64)
        self.lo, self.hi = bound[:-1], bound[1:]
        which = np.flatnonzero(count >= width)
        if len(which):
            spots = np.concatenate([np.arange(bound[i], bound[i + 1]) for i in which])
            out[spots] = full[np.repeat(units.first[which] - bound[which], n[which]) + spots]
        for i in np.flatnonzero((count > 0) & (count < width)):
            words = units.hash[units.first[i] : units.first[i + 1]]
            out[bound[i]] = K.mix(K.window_hash(words, len(words)) + np.uint64(len(words)))[0]

    def words(self, i: int) -> bytes:
        """The words of a text in lower case, joined by single spaces."""
        a, b = self.units.first[i], self.units.first[i + 1]
        return self.units.raw[self.units.start[a] : self.units.end[b - 1]] if b > a else b""

    def hashes(self, i: int) -> np.ndarray:
        """Distinct hashes of a text, sorted (for statistics: shingles with one hash are one here)."""
        return np.unique(self.hash[self.lo[i] : self.hi[i]])

    def sets(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the hash of each distinct shingle, sorted, and the unit at which that shingle starts."""
        sets, places, left, right, owner = [], [], [], [], []
        for i, (a, b) in enumerate(zip(self.lo.tolist(), self.hi.tolist(), strict=True)):
            order = np.argsort(self.hash[a:b])
            value = self.hash[a:b][order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            at = self.units.first[i] + order
            if not new.all():
                again = np.flatnonzero(~new)
                left.append(at[again - 1])
                right.append(at[again])
                owner.append(np.full(len(again), i))
            sets.append(value[new])
            places.append(at[new])
        if left:
            same = K.equal_windows(self.units, np.concatenate(left), np.concatenate(right), self.width)
            for i in np.unique(np.concatenate(owner)[~same]):  # equal hashes of different shingles: settle the text by its words
                sets[i], places[i] = self._settled(int(i))
        return sets, places

    def _settled(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        words, first = self.words(i).split(b" "), int(self.units.first[i])
        seen: dict[tuple[bytes, ...], int] = {}
        for k in range(int(self.hi[i] - self.lo[i])):
            seen.setdefault(tuple(words[k : k + self.width]), k)
        at = np.fromiter(seen.values(), np.int64, len(seen))
        value = self.hash[self.lo[i] + at]
        order = np.argsort(value, kind="stable")
        return value[order], first + at[order]


def _slots(h: np.ndarray) -> np.ndarray:
    """Cells of the table; hashes are mixed again, as prefixes prefer small ones."""
    return (K.mix(h) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _frequent(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            value, n = np.unique(_Shingled(K.as_bytes(table["text"]), width).hash, return_counts=True)
            often = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(_slots(value[often])), pa.array(n[often].astype(np.int64))], ["slot", "n"])

    return run


def _prefix_tokens(width: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            s = _Shingled(K.as_bytes(table["text"]), width)
            parts = [_prefix(s.hashes(i), frequent, percent)[0] for i in np.flatnonzero(s.hi > s.lo)]
            if parts:
                value, n = np.unique(K.mix(np.concatenate(parts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _prefix(u: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the global order, by frequency class and hash, and their classes."""
    cls = frequent[_slots(u)]
    first = np.argsort(cls, kind="stable")[: len(u) - _need(len(u), percent) + 1]
    return u[first], cls[first]


def _need(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _signature(u: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the shingles whose hash falls on k: sets differ in at least as many shingles as signatures in bits."""
    spot = (K.mix(u * K.STEP) >> np.uint64(64 - 6 - SIGNATURE.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=64 * SIGNATURE) & 1).view(np.int64)


_SETS = "n long, key binary, gkey binary, rare long, prefix array<long>, weight array<tinyint>, " + ", ".join(f"{c} long" for c in _SIGNS)


def _sets(width: int, percent: int, shared, keys: list[str]):
    """Per row: what is in ``keys``, size, class key, group key, how many shingles of the prefix are rare, the prefix with the frequency class of its shingles, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for table in K.text_chunks(batches, "text", CHUNK_BYTES):
            s = _Shingled(K.as_bytes(table["text"]), width)
            size, key, group, prefix, weight, lens, rare = [], [], [], [], [], [], []
            signs = np.zeros((len(s.lo), SIGNATURE), np.int64)
            for i, u in enumerate(s.sets()[0]):
                size.append(len(u))
                key.append(hashlib.sha256(s.words(i)).digest())
                if not len(u):
                    group.append(b"")
                    lens.append(0)
                    rare.append(0)
                    continue
                p, cls = _prefix(u, frequent, percent)
                group.append(hashlib.blake2b(np.append(p, np.uint64(len(u))).tobytes(), digest_size=16).digest())
                prefix.append(p)
                weight.append(cls)
                lens.append(len(p))
                rare.append(int((cls == 0).sum()))
                signs[i] = _signature(u)
            offsets = pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32))
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
            heavy = np.concatenate(weight).astype(np.int8) if weight else np.zeros(0, np.int8)
            yield pa.RecordBatch.from_arrays(
                [*[table[c].combine_chunks() for c in keys], pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(group, pa.binary()), pa.array(rare, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(heavy)), *[pa.array(np.ascontiguousarray(c)) for c in signs.T]],
                [*keys, "n", "key", "gkey", "rare", "prefix", "weight", *_SIGNS],
            )

    return run


def _wanted_texts(shared):
    """Documents whose slot is marked -> class key and words, once per chunk and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            some = batch.filter(pa.array(sketch.has_bit(bitmap, batch["slot"].to_numpy())))
            for table in K.text_chunks(iter([some]), "text", CHUNK_BYTES):
                units = K.units_of(K.as_bytes(table["text"]), lower=True)
                found: dict[bytes, bytes] = {}
                for a, b in zip(units.first[:-1].tolist(), units.first[1:].tolist(), strict=True):
                    if b > a:
                        words = units.raw[units.start[a] : units.end[b - 1]]
                        found.setdefault(hashlib.sha256(words).digest(), words)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "words"])

    return run


def _verify(width: int, percent: int):
    """Pairs of classes with their words -> those whose sets of shingles, compared by words, are similar."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        texts: dict[int, bytes] = dict(zip(table["a"].to_pylist(), table["wa"].to_pylist(), strict=True))
        texts |= dict(zip(table["b"].to_pylist(), table["wb"].to_pylist(), strict=True))
        place = {c: i for i, c in enumerate(texts)}
        s = _Shingled(list(texts.values()), width)
        sets, at = s.sets()
        ids = K.unit_ids(s.units)
        good = []
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            i, j = place[a], place[b]
            # Classes differ, so a text of fewer words than a shingle has is like no other.
            common = _common(sets[i], sets[j], at[i], at[j], ids, width) if min(s.count[i], s.count[j]) >= width else 0
            good.append(100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and common > 0)
        keep = pa.array(good, pa.bool_())
        out = table.select(["a", "b"]).filter(keep).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(out["a"].to_numpy(), pa.int64()), pa.array(out["b"].to_numpy(), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in K.text_chunks(iter([batch]), "wb", CHUNK_BYTES):
                yield settle(table)

    return run


def _common(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, ids: np.ndarray, width: int) -> int:
    """How many shingles two sets share: hashes propose, words decide."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = y[at] == x
    i, j = px[hit], py[at[hit]]
    equal = np.ones(len(i), bool)
    for k in range(width):
        equal &= ids[i + k] == ids[j + k]
    if equal.all() and (len(x) < 2 or (x[1:] != x[:-1]).all()) and (len(y) < 2 or (y[1:] != y[:-1]).all()):
        return len(i)
    shingles = lambda p: set(map(tuple, ids[p[:, None] + np.arange(width)].tolist()))
    return len(shingles(px) & shingles(py))


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def shingle(self, content: bool = False) -> DataFrame:
        """Sets in an order that knows which shingles are frequent.

        Repeats within chunks give a first order; in it, how many prefixes a shingle is in gives
        the final one. Any order is right, as long as all documents have the same. With
        ``content``, rows have a digest of their text too.
        """
        level = F.floor(F.log2(F.col("n").cast("double"))).alias("value")
        seen = self.docs.select("text").mapInArrow(_frequent(self.width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        table = sketch.dense_table(seen.select("slot", level), SKETCH_BITS, pack=False)
        shared = self.spark.sparkContext.broadcast(table)
        often = self.docs.select("text").mapInArrow(_prefix_tokens(self.width, self.percent, shared), "token long, n long")
        often = often.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
        table = np.maximum(table, sketch.dense_table(often.select(F.shiftrightunsigned("token", 64 - SKETCH_BITS).alias("slot"), level), SKETCH_BITS, pack=False))
        shared = self.spark.sparkContext.broadcast(table)
        docs, keys = (self.docs.withColumn("content", content_digest("text")), ["doc_id", "content"]) if content else (self.docs, ["doc_id"])
        schema = "doc_id long, " + ("content binary, " if content else "") + _SETS
        return materialise(docs.mapInArrow(_sets(self.width, self.percent, shared, keys), schema), "sets")

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose whole sets are similar enough, compared by words."""
        pairs = materialise(pairs, "pairs")
        need = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = materialise(need.join(classes.select("cid", "rep", "key"), "cid"), "wanted")
        bits = sketch.bits_for(wanted.count())
        slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
        bitmap = sketch.dense_table(wanted.select(slot("rep").alias("slot"), F.lit(1).alias("value")), bits, pack=True)
        shared = self.spark.sparkContext.broadcast(bitmap)
        found = self.docs.withColumn("slot", slot("doc_id")).mapInArrow(_wanted_texts(shared), "key binary, words binary")
        texts = found.join(wanted.select("cid", "key"), "key").dropDuplicates(["key", "cid"]).select("cid", "words")
        texts = materialise(texts, "whole")
        rows = pairs.join(texts.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b")
        return materialise(rows.select("a", "b", "wa", "wb").mapInArrow(_verify(self.width, self.percent), "a long, b long"), "links")

    def least_common(self, n: str, m: str) -> Column:
        """How many shingles of the prefixes sets of n and m shingles must share to reach the similarity."""
        both = self.overlap(n, m)
        rest = F.greatest(*[F.ceil(F.col(x) * self.percent / F.lit(100.0) - 1e-9) - 1 for x in (n, m)])
        return F.greatest(F.lit(1), both - rest)

    def overlap(self, n: str, m: str) -> Column:
        """How many shingles sets of n and m shingles must have in common."""
        return F.ceil((F.col(n) + F.col(m)) * self.percent / F.lit(100.0 + self.percent) - 1e-9)

    def may_be_near(self) -> Column:
        """Whether sets a and b can be similar, by size and signature (null where a signature does not hold)."""
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        differ = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in _SIGNS), F.lit(0))
        return near & (F.coalesce(differ, F.lit(0)) <= F.col("na") + F.col("nb") - 2 * self.overlap("na", "nb"))

    def grouped(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """classes (cid, key, n, rep, size, signature, gid, members), and the lists of shingles that the heads of groups are in.

        A class has the number of its row in a written table, so every reader sees the same one.
        """
        full = sets.filter("n > 0")
        same = [F.first(c).alias(c) for c in ("n", "gkey", "rare", "prefix", "weight", *_SIGNS)]
        rows = full.groupBy("key").agg(*same, F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        rows = materialise(rows.withColumn("cid", F.monotonically_increasing_id()), "rows")
        groups = rows.groupBy("gkey").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("members"))
        classes = hot_split_join(rows.select("cid", "key", "n", "gkey", "rep", "size", *_SIGNS), groups, ["gkey"], "members", rows.count())
        classes = materialise(classes.drop("gkey"), "classes")
        others = classes.filter("cid <> gid").select("cid")
        posts = rows.join(others, "cid", "left_anti").select("cid", "n", "rare", F.posexplode(F.arrays_zip("prefix", "weight")).alias("pos", "x"))
        weight = F.col("x.weight").cast("int")
        segments = F.when(weight > SEGMENT_BITS, F.pow(F.lit(2.0), weight - SEGMENT_BITS).cast("int")).otherwise(F.lit(1))
        posts = posts.select(F.col("x.prefix").alias("token"), F.pmod(F.xxhash64("cid"), segments).cast("int").alias("segment"), (segments > 1).alias("long"), F.col("cid").alias("gid"), "n", "pos", "rare")
        return classes, posts

    def components(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """classes with comp, and the verified links of both passes."""
        classes, posts = self.grouped(sets)
        # In a list, sets with few rare shingles come first: what others were copied from, or is closest to it.
        order = ["rare", "n", "gid"]
        by = Window.partitionBy("token", "segment").orderBy(*order)
        posts = posts.withColumn("prev", F.lag(F.struct("gid", "n")).over(by)).withColumn("next", F.lead("gid").over(by))
        posts = posts.withColumn("head", F.first(F.struct("gid", "n")).over(by))
        posts = materialise(posts.filter("prev is not null or next is not null or long"), "posts")
        # Neighbours in a list, the head of a list with all others, and heads of the segments of a long list.
        near = posts.filter("prev is not null").select(F.explode(F.array_distinct(F.array("prev", "head"))).alias("p"), "gid", "n")
        far = posts.filter("long and prev is null").withColumn("p", F.lag(F.struct("gid", "n")).over(Window.partitionBy("token").orderBy(*order)))
        near = near.union(far.filter("p is not null").select("p", "gid", "n")).select(F.col("p.gid").alias("a"), F.col("p.n").alias("na"), F.col("gid").alias("b"), F.col("n").alias("nb"))
        near = near.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (F.col("a") != F.col("b")))
        near = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        near = near.filter(F.col("c") * 4 >= self.least_common("na", "nb")).select("a", "b")
        inside = classes.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
        first = self.verified(near.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes)
        comps = connected(first)
        classes = materialise(classes.join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "components")
        second = self.verified(self.across(posts, classes), classes)
        links = first.union(second)
        final = connected(second.join(classes.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a").join(classes.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        classes = classes.join(final.select(F.col("v").alias("comp"), F.col("comp").alias("top")), "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top")
        return classes, links

    def meet(self, rows: DataFrame, lists: DataFrame, total: int, condition: Column) -> DataFrame:
        """Rows a and b of one token for which ``condition`` holds; every pair meets in one cell of a grid of segments.

        lists: token and length. A list of many rows is dealt into segments of about 2 **
        SEGMENT_BITS, and each pair of segments is a key of its own, so that no task has a list.
        """
        rows = hot_split_join(rows, lists, ["token"], "length", total).filter("length is not null")
        parts = F.ceil(F.col("length") / float(1 << SEGMENT_BITS)).cast("int")
        rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")).drop("length")
        rows = materialise(rows, "lists")
        value = [c for c in rows.columns if c not in ("token", "parts", "own")]
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        a = rows.select("token", F.col("own").alias("x"), every.alias("y"), *[F.col(c).alias(c + "a") for c in value])
        b = rows.select("token", every.alias("x"), F.col("own").alias("y"), *[F.col(c).alias(c + "b") for c in value])
        # Behind the first shingle that they share, both sets must still have room for the overlap.
        room = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= self.overlap("na", "nb")
        return a.join(b, ["token", "x", "y"]).filter(condition & room & self.may_be_near())

    def every(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """classes and all verified links, those inside a component too."""
        classes, posts = self.grouped(sets)
        posts = materialise(posts.select("token", "gid", "n", "pos"), "posts")
        alone = [F.min(F.when(F.col("members") == 1, F.col(c))).alias(c) for c in _SIGNS]
        rows = posts.join(classes.groupBy("gid").agg(*alone), "gid")
        lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
        pairs = self.meet(rows, lists, posts.count(), F.col("gida") < F.col("gidb")).select("gida", "gidb").distinct()
        left, right = (classes.select(F.col("gid").alias("gid" + x), F.col("cid").alias(x), F.col("n").alias("n" + x), *[F.col(c).alias(c + x) for c in _SIGNS]) for x in "ab")
        inside = left.join(right, F.col("gida") == F.col("gidb")).filter("a < b")
        out = pairs.join(left, "gida").join(right, "gidb")
        both = [f.filter(self.may_be_near()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for f in (out, inside)]
        return classes, self.verified(both[0].union(both[1]).distinct(), classes)

    def across(self, posts: DataFrame, classes: DataFrame) -> DataFrame:
        """All pairs of classes of different components that share enough prefix shingles, and all such pairs of a group."""
        alone = [F.min(F.when(F.col("members") == 1, F.col(c))).alias(c) for c in _SIGNS]
        members = classes.groupBy("gid", "comp").agg(*alone)
        rows = materialise(posts.select("token", "gid", "n", "pos").join(members, "gid"), "placed")
        mixed = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("length")).filter("x <> y").select("token", "length")
        pairs = self.meet(rows, mixed, rows.count(), F.col("compa") < F.col("compb")).select("gida", "compa", "gidb", "compb").distinct()
        split = members.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("gid")
        some = members.join(split, "gid", "left_semi")
        own = some.select(F.col("gid").alias("gida"), F.col("comp").alias("compa")).join(some.select("gid", F.col("comp").alias("compb")), F.col("gida") == F.col("gid")).filter("compa < compb")
        pairs = pairs.union(own.select("gida", "compa", F.col("gida").alias("gidb"), "compb")).distinct()
        left, right = (classes.select(F.col("gid").alias("gid" + x), F.col("comp").alias("comp" + x), F.col("cid").alias(x), F.col("n").alias("n" + x), *[F.col(c).alias(c + x) for c in _SIGNS]) for x in "ab")
        out = pairs.join(left, ["gida", "compa"]).join(right, ["gidb", "compb"]).filter(self.may_be_near())
        return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id, component_id.

    class_id is one for documents of one sequence of words: the hexadecimal sha256 of the words
    in lower case, joined by spaces (null without words). component_id is the smallest doc_id
    that links reach. Defined cases: a null or empty text has no shingles and is linked with
    nothing, not with another empty one; fewer than ``width`` words make one shingle; rows
    with a null id take part, and their component_id is the smallest id that links reach, or
    null; equal rows are one class, and each has its row; an empty table gives an empty table;
    other columns are not read.
    """
    out = _placed(docs, id_col, text_col, width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.lower(F.hex("key"))).alias("class_id"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, content: bool = False) -> DataFrame:
    """Per row: doc_id, content (a digest of the text, if asked for), n, key, size, component_id, comp (null, like component_id, where nothing is linked)."""
    join = _Join(docs, id_col, text_col, width, percent)
    sets = join.shingle(content)
    classes, _ = join.components(sets)
    classes = materialise(classes.select("key", "rep", "size", "comp"), "final")
    least = classes.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("together"))
    told = classes.join(least, "comp").filter("size > 1 or together > 1").select("key", "size", "component_id", "comp")
    rows = sets.select(*(["doc_id", "content"] if content else ["doc_id"]), "n", "key")
    total = rows.count()
    empty = rows.filter("n = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("size", "component_id", "comp")])
    return hot_split_join(rows.filter("n > 0"), told, ["key"], "size", total).select(*empty.columns).unionByName(empty)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes of documents (cid, n, rep, size, comp) and verified links (a, b) that connect each component."""
    join = _Join(docs, id_col, text_col, width, percent)
    classes, links = join.components(join.shingle())
    return classes.select("cid", "n", "rep", "size", "comp"), links


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Classes of documents (cid, n, rep, size) and every link (a, b) of two classes, a < b.

    The whole similarity join: unlike ``similar_classes``, pairs of one component are verified
    as well. Documents of one class have the same words and need no link. The number of links
    can grow with the square of a component's classes.
    """
    join = _Join(docs, id_col, text_col, width, percent)
    classes, links = join.every(join.shingle())
    return classes.select("cid", "n", "rep", "size"), links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id.

    Defined cases: a null id is the smallest; rows of one id and several texts are told apart
    by a digest of the text, whose smallest value stays, and of equal rows one stays, so no two
    rows of a component are left; rows without words are no copies of one another, and all
    stay; an empty table gives an empty table; columns may have any names.
    """
    id_, content, turn = free_names(docs.columns, "id", "content", "turn")
    rows = _placed(docs, id_col, text_col, width, percent, content=True).filter("n > 0")
    best = rows.groupBy(F.coalesce(F.col("comp").cast("string"), F.hex("key")).alias("comp")).agg(F.min(F.struct("doc_id", "content")).alias("best"))
    stay = best.select(F.col("best.doc_id").alias("k"), F.col("best.content").alias("c"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(some).withColumns({id_: F.col(id_col).cast("long"), content: content_digest(text)})
    kept = keyed.join(stay, F.col(id_).eqNullSafe(F.col("k")) & (F.col(content) == F.col("c")), "left_semi")
    kept = kept.withColumn(turn, F.row_number().over(Window.partitionBy(id_, content).orderBy(F.lit(1)))).filter(F.col(turn) == 1)
    return kept.drop(id_, content, turn).unionByName(docs.filter(~some))
