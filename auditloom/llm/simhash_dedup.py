"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits; two texts are linked when their fingerprints differ in `MAX_BITS` bits or
fewer, and a component is what links reach.

Candidates. Fingerprints are cut into three segments in a ring. If two of them differ in at most 2
bits, there is a segment from which the differences of each chain of consecutive segments stay in
proportion: none in the first segment, at most 1 in the first two (floor(2/3), floor(4/3)), at most
2 in all three. So a pair needs an equal segment followed by a segment with at most one differing
bit. One side is stored under (start, segment, next segment), the other asks under the next segment
and each of its one-bit changes; only pairs that meet there have their full distance counted.

Stored groups with more than `GROUP_CAP` members are not paired up. For them, all fingerprints with
the same first segment are put under each value within one bit of their remaining bits: any two
that meet differ in 2 bits or fewer, and any two that differ in 2 bits or fewer meet; linking each
to the smallest one there gives the same components with rows in proportion to the members.

`keep_one` also links texts whose sets of shingles have a Jaccard similarity of `SIMILARITY` or more,
which is far beyond 2 bits. Candidates share one of `BANDS` bands of `BAND_ROWS` minimum hashes (a pair
of similarity 0.8 shares none with probability (1 - 0.8^5)^32 = 3e-6) and are verified on their whole
sets. Each bucket's members are first compared with its hub, the member that meets most others, so
that rows grow with the members and not with their pairs. Buckets of which some members aren't linked
to the hub go, in blocks of bounded size, to tasks that compare those with all others and return only
links that join what isn't joined. So no pair of a bucket stays undecided.

Copies have one fingerprint and count once. Components come from alternating large-star and
small-star steps, each written to the checkpoint folder.

Defined results: null and blank texts have fingerprint zero and are linked like any other; a null
doc_id never names a component unless all its members are null; repeated rows stay; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import at_most, bounded_batches, broadcast_if_small, materialize, stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: First bit and number of bits of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GROUP_CAP = 8
#: Shingles hashed at a time: bounds memory for very long texts.
BLOCK = 65_536
#: Jaccard similarity from which keep_one takes texts for near-duplicates; bands of minimum hashes that find them.
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
#: Shingles (8 bytes each) of a block; a task compares two blocks at a time.
BLOCK_SHINGLES = 500_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def _shingle_hashes(text: str | None, shingle_words: int):
    """Hashes of the text's shingles in parts; no part for texts without words."""
    # Lower case and splitting of bytes concern A-Z and the six ASCII white-space characters alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[k:] for k in range(shingle_words)])))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        yield np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))


def _majority(parts) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number."""
    return _majority(_shingle_hashes(text, shingle_words))


def shingle_set(text: str | None, shingle_words: int) -> tuple[int, np.ndarray, bytes]:
    """The fingerprint, the distinct shingles' hashes in order, and the digest that names this set."""
    parts = list(_shingle_hashes(text, shingle_words))
    own = np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype="<u8")
    return _majority(parts), own, xxhash.xxh3_128_digest(own.tobytes())


def bands(own: np.ndarray) -> list[int]:
    """A hash of each band of minimum hashes of a set; none for the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, k: int) -> Column:
    first, bits = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(value: Column, bits) -> Column:
    """The value and all that differ from it in one of these bits."""
    masks = [(1 << b) if b < 63 else -(1 << 63) for b in bits]
    return F.array(value, *[value.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def links(fps: DataFrame, group_cap: int = GROUP_CAP) -> DataFrame:
    """Edges (a, b), some of them repeated, between distinct fingerprints whose components are those of all links. fps: fp, distinct."""
    starts = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _segment(F.col("fp"), i).alias("seg"), _segment(F.col("fp"), i + 1).alias("nxt")) for i in range(3)])).alias("s")).select("fp", "s.*")
    sizes = materialize(starts.groupBy("i", "seg", "nxt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_cap))
    crowded = sizes.select("i", "seg").distinct()
    stored = starts.join(sizes, ["i", "seg", "nxt"], "left_anti")
    near = [F.when(F.col("i") == i, _ball(F.col("nxt"), range(SEGMENTS[(i + 1) % 3][1]))) for i in range(3)]
    asked = starts.select(F.col("fp").alias("other"), "i", "seg", F.explode(F.coalesce(*near)).alias("nxt"))
    pairs = (
        asked.join(stored, ["i", "seg", "nxt"])
        .where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    members = starts.join(crowded, ["i", "seg"], "left_semi")
    rest = [F.when(F.col("i") == i, _ball(F.col("fp"), [b for b in range(64) if not SEGMENTS[i][0] <= b < sum(SEGMENTS[i])])) for i in range(3)]
    around = members.select("i", "fp", F.explode(F.coalesce(*rest)).alias("z"))
    smallest = around.groupBy("i", "z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("i", "z", "a")
    stars = around.join(smallest, ["i", "z"]).where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges (a, b); large-star and small-star in turn.

    Done when the edges are stars: every greater end has one edge and none is a lesser end. Raises beyond `max_rounds`.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    for _ in range(max_rounds):
        ends = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.lit(0).alias("is_hi")), F.struct(F.col("hi").alias("u"), F.lit(1).alias("is_hi")))).alias("e")).select("e.*")
        ends = ends.groupBy("u").agg(F.sum("is_hi").alias("above"), F.min("is_hi").alias("least"))
        if ends.where("above > 1 OR (above = 1 AND least = 0)").isEmpty():
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v > m").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        first, second = F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = large.join(least, "hi").select(F.explode(F.when(F.col("lo") > F.col("m"), F.array(first, second)).otherwise(F.array(first))).alias("e"))
        edges = materialize(small.select("e.*").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _named(rows: DataFrame, edges) -> DataFrame:
    """doc_id, fp, component_id of every row; edges: from the table of distinct fingerprints to the links between them."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(edges(distinct.select("fp")))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(by_fp, rows["fp"] == by_fp["__fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, group_cap: int = GROUP_CAP) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the row's component) of every row."""
    rows = materialize(fingerprints(docs, shingle_words))
    return _named(rows, lambda fps: links(fps, group_cap))


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, fp, key (the digest of the set of shingles), n (their number), bands of every row."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t, shingle_words) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array([f for f, _, _ in found], dtype=np.uint64).view(np.int64))
            keys, marks = pa.array([k for _, _, k in found], pa.binary()), pa.array([bands(own) for _, own, _ in found], pa.list_(pa.int64()))
            sizes = pa.array([len(own) for _, own, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, keys, sizes, marks], names=["doc_id", "fp", "key", "n", "bands"])

    bounded_batches(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, key binary, n long, bands array<long>")


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """key, own (the distinct shingles' hashes, in order) of every row."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t, shingle_words) for t in batch.column("text").to_pylist()]
            own = pa.array([h.view(np.int64) for _, h, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k for _, _, k in found], pa.binary()), own], names=["key", "own"])

    bounded_batches(docs)
    return docs.select("text").mapInArrow(run, "key binary, own array<long>")


def spanning(sets: list[np.ndarray], roots: list[int], similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets of different roots: enough of them that whatever roots similar sets join, these join.

    Each set whose root is not the most frequent one is compared with all others through the list of
    who has which shingle. A root that has come to the most frequent one by then needs no more
    comparing: what it is similar to has come there too, or makes the comparison itself.
    """
    parent = {r: r for r in roots}

    def find(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    most = max(parent, key=Counter(roots).__getitem__)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    labels = np.array(roots)
    found = []
    for i, own in enumerate(sets):
        if find(roots[i]) == find(most):
            continue
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((shared / (sizes + len(own) - shared) >= similarity) & (labels != roots[i])).tolist():
            if find(roots[i]) != find(roots[j]):
                parent[find(roots[i])] = find(roots[j])
                found.append((i, j))
    return found


def _block_links(similarity: float):
    """Function over rows (band, i, j, fp, root, own) that arrive by (band, i, j): edges between similar sets of other roots."""

    def run(batches):
        group, fps, roots, sets = None, [], [], []

        def edges():
            at = spanning(sets, roots, similarity) if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([fps[x] for x, _ in at], pa.int64()), pa.array([fps[y] for _, y in at], pa.int64())], names=["a", "b"])

        for batch in batches:
            own = batch.column("own")
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy()
            cols = [batch.column(c).to_pylist() for c in ("band", "i", "j", "fp", "root")]
            for k, (*name, fp, root) in enumerate(zip(*cols)):
                if name != group:
                    yield edges()
                    group, fps, roots, sets = name, [], [], []
                fps.append(fp)
                roots.append(root)
                sets.append(flat[ends[k] : ends[k + 1]].copy())
        yield edges()

    return run


def similar_links(docs: DataFrame, rows: DataFrame, known: DataFrame, shingle_words: int, similarity: float = SIMILARITY, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """`known` and edges (a, b) between fingerprints, whose components are also those of texts of this similarity.

    rows: the docs' sketches, written. known: links that hold already.
    """
    whole = rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    whole = materialize(whole.withColumn("id", F.monotonically_increasing_id()))  # equal keys have equal bands; written once, so ids stay
    same = rows.join(whole.select("key", F.col("fp").alias("a")), "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    marks = whole.select("id", "fp", "n", F.explode("bands").alias("band"))
    sizes = marks.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = marks.join(sizes, "band").groupBy("id", "fp", "n").agg(F.collect_list(F.struct("band", "members")).alias("own"))  # at most BANDS of a set
    met = materialize(met.withColumn("weight", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["members"])))
    buckets = met.select("id", "fp", "n", "weight", F.inline("own"))
    texts = broadcast_if_small(materialize(whole.join(met.select("id"), "id", "left_semi").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"))))
    id_ = docs["doc_id"].cast("long")
    wanted = docs.where(id_.isNull()).select("text").unionByName(docs.join(texts, id_ == F.col("__id"), "left_semi").select("text"))
    own = _sets(wanted, shingle_words).dropDuplicates(["key"]).join(whole.select("key", "id", "fp"), "key")
    own = stored(own.join(met.select("id"), "id", "left_semi").select("id", "fp", "own"))

    # Each bucket's hub is compared with all other members whose sizes allow the similarity. Many pairs have the same hub, which is joined last.
    hub = F.struct(F.col("id").alias("x"), F.col("n").alias("n_x"))
    hubs = buckets.groupBy("band").agg(F.max_by(hub, F.struct("weight", "id")).alias("h")).select("band", "h.*")
    members = materialize(buckets.join(hubs, "band"))
    fits = F.least("n", "n_x") >= similarity * F.greatest("n", "n_x") - 1e-6
    pairs = members.where((F.col("id") != F.col("x")) & fits).select("x", F.col("id").alias("y")).distinct()
    one, two = own.select(F.col("id").alias("x"), F.col("fp").alias("a"), F.col("own").alias("p")), own.select(F.col("id").alias("y"), F.col("fp").alias("b"), F.col("own").alias("q"))
    shared = F.size(F.array_intersect("p", "q"))
    near = pairs.join(two, "y").join(one, "x").where(shared / (F.size("p") + F.size("q") - shared) >= similarity)
    near = materialize(near.select("x", "y", "a", "b"))
    # Members that their hub links have its name, any other its own. Buckets of three or more with several names go on to the blocks.
    linked = members.where("members > 2").join(near.select("x", F.col("y").alias("id"), F.lit(True).alias("near")), ["x", "id"], "left")
    named = linked.select("band", "id", "fp", "n", F.when(F.coalesce("near", F.lit(False)), F.col("x")).otherwise(F.col("id")).alias("root"))
    dealt = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    rest = named.join(dealt.where("lo < hi").select("band", "blocks"), "band").join(own.select("id", "own"), "id")
    rest = rest.select("band", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("i"), "fp", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rest = rest.select("band", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp", "root", "own")
    found = rest.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_block_links(similarity), "a long, b long")
    return known.unionByName(same).unionByName(near.select("a", "b")).unionByName(found).where("a <> b")


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = SIMILARITY, group_cap: int = GROUP_CAP, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all columns of `docs`.

    Links are those of `near_duplicates` and those of texts whose sets of shingles have this Jaccard
    similarity or more. Rows that share a doc_id are one document, of which the row of the smallest
    text hash stays; rows without a doc_id can't be told apart and stay.
    """
    rows = materialize(sketches(docs, shingle_words))
    named = _named(rows.select("doc_id", "fp"), lambda fps: similar_links(docs, rows, links(fps, group_cap), shingle_words, similarity, block_shingles))
    found = materialize(named.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), "component_id"))
    gone = materialize(found.where(F.col("__id") != F.col("component_id")).select("__id").distinct())
    left = docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = materialize(found.groupBy("__id").count().where("count > 1").select("__id"))
    if at_most(repeated, 0):
        return left
    row, order = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    once = left.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, order).alias("r"))
    once = once.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return left.join(repeated, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(once)


def op7_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
