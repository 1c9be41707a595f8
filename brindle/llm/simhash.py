"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: two fingerprints that
differ in at most two bits have a segment that differs in at most one. Every
fingerprint is indexed under the 64 values of its segments with one bit wildcarded,
and equal keys are candidates. A bucket of up to ``held`` fingerprints is verified in its task,
which hands on one link for each member, to the smallest fingerprint that it reaches in
the bucket. A larger bucket is cut again by wildcards in the open bits, until equal keys
prove a link, and its members are linked to the smallest of them; so nothing is capped
and no bucket gives all its pairs.

Equal fingerprints are folded before, so copies cost one row each. Components are
found over distinct fingerprints.

Defined results: a null text counts as empty; texts without words share fingerprint
zero and link like any other. Rows with a null doc_id take part in links but name no
component unless all rows of it are null. Repeated rows stay rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, connected, fresh, keep, named, out_batches, scratch

SEED = 42


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all where they are fewer."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Majority of the bits of the shingles' XXH64, repeats included; as a signed 64-bit integer."""
    words = raw.lower().split()
    if not words:
        return 0
    h = _hashes(words, shingle)
    n = len(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (64 bits, signed) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, fp long")


_LOW, _HIGH = "(fp & 4294967295L)", "(shiftrightunsigned(fp, 32))"


def _variants(fps: DataFrame) -> DataFrame:
    """fp under 64 keys: segment, wildcarded bit and the segment's other bits, packed in one long."""
    one = "transform(sequence(0, 31), j -> (({seg} & ~shiftleft(1L, j)) | shiftleft(cast(j as bigint), 32) | shiftleft({which}L, 37)))"
    both = "concat(" + one.format(seg=_LOW, which=0) + ", " + one.format(seg=_HIGH, which=1) + ")"
    return fps.select("fp", F.explode(F.expr(both)).alias("key"))


#: Flips of one or two of 33 bits: those a bucket leaves open, as positions of the segment's wildcard (0) and of the other segment.
_ONE = np.array([1 << i for i in range(33)], np.uint64)
_FLIPS = np.concatenate([_ONE, np.array([(1 << i) | (1 << j) for i in range(33) for j in range(i)], np.uint64)])


def _roots(fps: np.ndarray, key: int) -> np.ndarray:
    """For the sorted fingerprints of a bucket the smallest of those linked to each, over any number of links within it."""
    n = len(fps)
    u = fps.view(np.uint64)
    if n <= 256:
        a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    else:
        which, bit = key >> 37, np.uint64((key >> 32) & 31)
        own, other = (np.uint64(0), np.uint64(32)) if which == 0 else (np.uint64(32), np.uint64(0))
        open_bits = ((u >> (own + bit)) & np.uint64(1)) | (((u >> other) & np.uint64(0xFFFFFFFF)) << np.uint64(1))
        order = np.argsort(open_bits)
        ordered = open_bits[order]
        ends = []
        for at in range(0, n, 1024):
            to = open_bits[at : at + 1024, None] ^ _FLIPS[None, :]
            i = np.minimum(np.searchsorted(ordered, to), n - 1)
            x, y = np.nonzero(ordered[i] == to)
            ends.append(np.stack([x + at, order[i[x, y]]]))
        a, b = np.concatenate(ends, axis=1)
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def links(fps: DataFrame, held: int = 8192) -> DataFrame:
    """(a, b): links of the distinct ``fps`` (fp) at two or fewer differing bits, enough to connect all that are linked.

    A bucket of up to ``held`` fingerprints is searched in its task, and each member linked to the smallest
    that it reaches there. Larger ones are cut by wildcards in the open bits, in Spark.
    """
    by_key = _variants(fps).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, found = None, [], []

        def solved() -> None:
            if len(part) > 1:
                u = np.sort(np.array(part, np.int64))
                root = _roots(u, key)
                at = np.flatnonzero(root != np.arange(len(u)))
                found.extend(zip(u[at].tolist(), u[root[at]].tolist(), [None] * len(at)))

        for b in batches:
            for k, fp, n in zip(*(b.column(c).to_pylist() for c in ("key", "fp", "n"))):
                if n > held:
                    found.append((fp, fp, k))
                    continue
                if k != key:
                    solved()
                    key, part = k, []
                part.append(fp)
            yield from out_batches(found, schema)
            found.clear()
        solved()
        yield from out_batches(found, schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
    solved = keep(by_key.mapInArrow(run, "a long, b long, key long"), "simhash-buckets")
    big = solved.where("key is not null").select(F.col("a").alias("fp"), "key")
    which, bit = "shiftrightunsigned(key, 37)", "(shiftrightunsigned(key, 32) & 31)"
    other = f"if({which} = 0, {_HIGH}, {_LOW})"
    own = f"if({which} = 0, {_LOW}, {_HIGH})"
    # the segment but for its wildcard and one wildcard in the other; or the whole segment and two wildcards in the other, under bit 0 only
    one = big.select("fp", "key", F.expr("-1L").alias("exact"), F.explode(F.expr(f"transform(sequence(0, 31), k -> ({other} & ~shiftleft(1L, k)) | shiftleft(cast(k as bigint), 32))")).alias("rest"))
    two = big.where(f"{bit} = 0").select(
        "fp", "key", F.expr(own).alias("exact"),
        F.explode(F.expr(f"flatten(transform(sequence(0, 30), k -> transform(sequence(k + 1, 31), l -> ({other} & ~shiftleft(1L, k) & ~shiftleft(1L, l)) | shiftleft(cast(k * 32 + l as bigint), 32))))")).alias("rest"),
    )
    cut = one.unionAll(two)
    stars = cut.join(cut.groupBy("key", "exact", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), ["key", "exact", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return solved.where("key is null").select("a", "b").unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id for each row of ``docs`` (doc_id, text)."""
    with scratch() as result:
        return result(_near_duplicates(docs, shingle), "near-duplicates")


def _near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    seen = keep(fingerprints(docs, shingle), "simhash")
    distinct = keep(seen.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected(links(distinct.select("fp")))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    comp = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return seen.join(comp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A sampled key covers ``words`` + KEY_SPAN words; one in KEY_EVERY shingles gives a key, and the KEY_LEAST of least hash do in any text.
KEY_SPAN, KEY_EVERY, KEY_LEAST = 3, 16, 6
#: Texts under a key that are paired each with each; 28 pairs at most.
ALL_PAIRS = 8
#: Texts of a larger group that each of it is paired with at first, and the size of the parts that it is cut into.
CENTERS, PART = 4, 6
_SIG = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sketch(raw: bytes, words: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Hash of the words, a 256-bit SimHash of their shingles, sampled keys, and the distinct shingles as 32-bit hashes."""
    w = raw.lower().split()
    h = _hashes(w, words)
    distinct = np.unique(h)  # the similarity to be met is one of sets
    signature = []
    for by in _SIG:
        ones = np.zeros(64, np.int64)
        mixed = _mix(distinct, by)
        for at in range(0, len(mixed), 1 << 16):
            ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        signature.append(int(np.packbits(2 * ones > len(mixed), bitorder="little").view(np.int64)[0]))
    ahead = h[KEY_SPAN:]
    rank = _mix(h[: len(ahead)], _SIG[2])
    least = np.partition(rank, KEY_LEAST - 1)[KEY_LEAST - 1] if len(rank) > KEY_LEAST else np.uint64((1 << 64) - 1)
    pick = np.flatnonzero((rank % np.uint64(KEY_EVERY) == 0) | (rank <= least))
    keys = np.unique(_mix(h[pick] + _SIG[0] * ahead[pick], _SIG[1])).view(np.int64)
    whole = xxhash.xxh64_intdigest(b" ".join(w), SEED)
    return _signed(whole), signature, keys, np.unique((distinct >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def similar_pairs(seen: DataFrame, nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b), and the crowd (node) whose pairs are not all among them. (a, b) are texts of ``seen`` (node, keys, shingles; a row for each copy) and ``nodes`` (node, s0 to s3) that share a sampled key and whose shingles' Jaccard similarity reaches ``similarity``.

    All texts under a key are paired where they are ``ALL_PAIRS`` or fewer. Where they are
    more, each is paired at first with CENTERS of them whose keys are shared most (the first of each class of a hash),
    mostly what copies were made from and those most like it, and with two others of a part that
    differs from key to key: that links most copies with few pairs, and the texts under such keys are the crowd that
    ``pairs_of_crowd`` finishes. A large key is counted and its centers are found by combining sums, and its
    rows are cut into parts of PART texts, so it is never in one task. Pairs are cut by the distance of their 256-bit
    signatures, and the rest verified by their shingles.
    """
    rows = seen.select("node", F.explode("keys").alias("key")).groupBy("key", "node").agg(F.lit(1).alias("one")).drop("one")
    rows = keep(rows, "simhash-rows")
    shared = keep(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "simhash-keys")
    among = shared.join(shared.groupBy("node").agg(F.sum("n").alias("share")), "node")
    large = F.col("n") > ALL_PAIRS
    parts = F.when(large, F.ceil(F.col("n") / PART)).otherwise(F.lit(1))
    among = among.withColumn("part", F.pmod(F.xxhash64("node", "key"), parts))
    centers = among.where(large).groupBy("key", F.pmod(F.xxhash64("node"), F.lit(CENTERS)).alias("c")).agg(F.max_by("node", F.struct("share", "node")).alias("to")).select("key", "to")
    mixed = Window.partitionBy("key", "part").orderBy(F.xxhash64("node", "key"), "node")
    leads = F.array(*[F.lead("node", i).over(mixed) for i in range(1, ALL_PAIRS)])
    ahead = among.select("node", "n", leads.alias("leads")).select("node", F.explode(F.when(large, F.slice("leads", 1, 2)).otherwise(F.col("leads"))).alias("to"))
    near = ahead.unionAll(shared.where(large).join(centers, "key").select("node", "to")).where("`to` is not null and node <> `to`")
    pairs = near.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    side = lambda n, *more: nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in more])
    sig = ("s0", "s1", "s2", "s3")
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in sig), F.lit(0))
    # at this similarity the share of differing bits is acos(2 J / (1 + J)) / pi; four deviations are allowed
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = math.ceil(256 * p + 4 * math.sqrt(256 * p * (1 - p)))
    close = keep(pairs.join(side("a", *sig), "a").join(side("b", *sig), "b").where(apart <= most).select("a", "b"), "simhash-close")
    wanted = close.select(F.col("a").alias("node")).unionAll(close.select("b")).distinct()
    held = keep(seen.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "simhash-shingles")
    return _verified(close, held, similarity), shared.where(F.col("n") > ALL_PAIRS).select("node").distinct()


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose Jaccard similarity by ``held`` (node, shingles) reaches ``similarity``."""
    sets = lambda n: held.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_shingles"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    total = F.size("a_shingles") + F.size("b_shingles") - common
    return both.where((total > 0) & (common >= F.lit(similarity) * total - 1e-9)).select("a", "b")


#: Bits that a text's shingles toggle, in longs of 64. Two texts' shingles differ in at least as many as their bits do.
PARITY = tuple(f"p{i}" for i in range(8))


def _with_parity(held: DataFrame) -> DataFrame:
    """``held`` (node, root, shingles) with the size of the shingles and the parity of those that fall on each of 512 bits."""
    bits = 64 * len(PARITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                lists = part.column("shingles")
                size = np.diff(lists.offsets.to_numpy())
                at = np.repeat(np.arange(part.num_rows), size) * bits + (lists.flatten().to_numpy() & (bits - 1))
                odd = (np.bincount(at, minlength=part.num_rows * bits) & 1).astype(np.uint8).reshape(-1, bits)
                longs = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
                arrays = [part.column("node"), part.column("root"), lists, pa.array(size, pa.int32()), *[pa.array(longs[:, i]) for i in range(len(PARITY))]]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "root", "shingles", "size", *PARITY])

    return held.select("node", "root", "shingles").mapInArrow(run, "node long, root long, shingles array<int>, size int, " + ", ".join(f"{c} long" for c in PARITY))


def pairs_of_crowd(seen: DataFrame, crowd: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of any two texts of ``crowd`` (node) that ``roots`` (node, root) leave apart and whose shingles' Jaccard similarity reaches ``similarity``.

    Nothing is sampled or capped: the shingles that such a pair has in common stand under
    more than one root, and are a share ``similarity`` of either text's at least. So texts with
    fewer of those go, and of the others the rarest of them, as many as can all be missing
    in the other text and one more, are equi-joined. A pair goes in the join if what is left behind the
    shingle that it shares is too little, or if more bits of its parities differ than shingles may; the rest is verified.
    Neither takes a pair that would pass.
    """
    held = seen.select("node", "shingles").join(crowd, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    held = keep(_with_parity(held.join(roots, "node", "left").select("node", "shingles", F.coalesce("root", "node").alias("root"))), "simhash-crowd")
    rows = held.select("node", "root", "size", F.explode("shingles").alias("s"))
    across = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s", "n")
    ranked = rows.join(across, "s").groupBy("node").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "s"))).alias("found"))
    least = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    ranked = ranked.withColumn("most", F.size("found") - least + 1).where("most > 0")
    first = ranked.select("node", "root", "size", F.size("found").alias("c"), F.posexplode(F.slice("found", 1, F.col("most"))).alias("at", "x"))
    first = keep(first.select("node", "root", "size", (F.col("c") - F.col("at")).alias("behind"), F.col("x.s").alias("s")), "simhash-rarest")
    # two texts of unlike roots are not both of the root that most texts under the shingle have
    by_root = first.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "main")
    names = ("node", "root", "size", "behind", *PARITY)
    first = first.join(held.select("node", *PARITY), "node")
    side = lambda df, p: df.select("s", *[F.col(c).alias(f"{p}_{c}") for c in names])
    few = side(first.join(by_root, "s").where("root <> main"), "x")
    needed = F.lit(similarity / (1 + similarity)) * (F.col("x_size") + F.col("y_size")) - 1e-9
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in PARITY), F.lit(0))
    close = apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("x_size") + F.col("y_size")) + 1e-6
    alike = few.join(side(first, "y").withColumnRenamed("s", "t"), (F.col("s") == F.col("t")) & (F.col("x_root") != F.col("y_root")) & (F.least("x_behind", "y_behind") >= needed) & close)
    pairs = keep(alike.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "simhash-apart")
    root = lambda n, to: held.select(F.col("node").alias(n), F.col("root").alias(to))
    return _verified(pairs, held, similarity).join(root("a", "x"), "a").join(root("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_duplicates_by_similarity(docs: DataFrame, *, shingle: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of each row of ``docs`` (doc_id, text): texts are linked by fingerprints at two or fewer differing bits, and by a Jaccard similarity of shingles of ``words`` words.

    The second kind of link reaches copies whose fingerprints are too far apart for the
    signatures. Texts of the same words are one node.
    """
    with scratch() as result:
        seen, grouped = _by_similarity(docs, shingle, words, similarity)
        comp = grouped.join(grouped.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.doc_id").alias("component_id")), "root").select("node", "component_id")
        return result(seen.select("doc_id", "node").join(comp, "node").select("doc_id", "component_id"), "near-duplicates")


def one_of_each(docs: DataFrame, *, shingle: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) without all but one of each component of ``near_duplicates_by_similarity``.

    That with the smallest doc_id stays, one without a doc_id only where none has any; of unlike texts under that doc_id the one
    of the smallest hash stays, and of rows alike in both any one. All columns stay, whatever their names.
    """
    with scratch() as result:
        _, grouped = _by_similarity(docs, shingle, words, similarity)
        kept = result(grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"), "near-duplicates")
    (key,) = fresh(docs, "_key")
    of = lambda doc, text: F.concat_ws(":", F.hex(text), F.when(F.col(doc).isNull(), "").otherwise(F.concat(F.lit("="), F.col(doc).cast("string"))))
    rows = docs.withColumn(key, of("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    return rows.join(kept.select(of("doc_id", "text_hash").alias(key)), key, "left_semi").dropDuplicates([key]).select(named(docs.columns))


def _by_similarity(docs: DataFrame, shingle: int, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and node, first (no doc_id, doc_id, hash of the text: of its first row) and root of all nodes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                cols: list[list] = [[] for _ in range(9)]
                for t in as_bytes(part.column("text")):
                    node, signature, keys, shingles = _sketch(t or b"", words)
                    for col, x in zip(cols, (node, fingerprint(t or b"", shingle), *signature, _signed(xxhash.xxh64_intdigest(t or b"", SEED)), keys, shingles)):
                        col.append(x)
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.list_(pa.int64())), pa.array(cols[8], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "node", "fp", "s0", "s1", "s2", "s3", "text_hash", "keys", "shingles"])

    seen = keep(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, fp long, s0 long, s1 long, s2 long, s3 long, text_hash long, keys array<long>, shingles array<int>"), "simhash-sketches")
    least = keep(seen.groupBy("node").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first"), F.min("fp").alias("fp"), *[F.first(s).alias(s) for s in ("s0", "s1", "s2", "s3")]), "simhash-nodes")
    one = least.groupBy("fp").agg(F.min("node").alias("node"))
    by_fp = links(one.select("fp"))
    rep = lambda n, to: one.select(F.col("fp").alias(n), F.col("node").alias(to))
    edges = by_fp.join(rep("a", "x"), "a").join(rep("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = edges.unionAll(least.join(rep("fp", "y"), "fp").where("node <> y").select(F.col("node").alias("a"), F.col("y").alias("b")))
    close, crowd = similar_pairs(seen, least, similarity)
    roots = connected(edges.unionAll(close))
    joined = connected(pairs_of_crowd(seen, crowd, roots, similarity)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    grouped = least.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    return seen, keep(grouped.join(joined, "root", "left").select("node", "first", F.coalesce("to", "root").alias("root")), "simhash-grouped")
