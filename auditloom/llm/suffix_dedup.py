"""Removal of repeated byte strings by difference-cover suffix arrays.

A byte goes when it lies in a string of `LENGTH` bytes that also starts earlier: in a document of
smaller doc_id, or before in the same document. Strings are judged on the input.

Distribution. Suffixes of one corpus can't be sorted by all tasks at once without moving every
suffix; here the text is dealt out so that equal strings of `LENGTH` bytes meet in one task, which
then sorts suffixes of what it has. In each string the position whose `GRAM`-byte gram has the least
hash is its anchor. Equal strings have equal anchors, so

1. grams of anchors are counted over the corpus; a string whose anchor's gram occurs once can't be
   repeated, and nothing of it moves any further. Tasks tell the repeated grams by a Bloom filter of
   bounded size; a gram that it takes for repeated brings a block that meets no other and loses nothing;
2. neighbouring strings with the same anchor form a block. Equal blocks of a batch are merged before
   the shuffle and keep their first place; all other places of a block are repeats as a whole;
3. blocks that differ but share a gram meet by the gram. Their bytes are put one after another and
   their suffix array is built by the difference-cover algorithm modulo 3: sort the triples at
   positions 1 and 2 modulo 3, name them, recurse on the names, sort the rest by byte and rank,
   merge. Neighbours in the array whose first `LENGTH` bytes agree are equal strings, and all of them
   but the earliest are repeats;
4. repeats come back to their documents as ranges.

A gram that more than `CROWD` blocks bring along would be too much for one task: its blocks are cut
into parts of 8 strings whose anchors lie at like places, and these meet by the 93 bytes that all
strings of a part share; parts that are still too many are cut into single strings. Parts go the same
way as blocks, through the suffix arrays.

Defined results: a null text is empty; texts shorter than `LENGTH` lose nothing; whole texts of any
length are read; rows that repeat a doc_id are one document at the same places, so none of them is
earlier than another, and ties in place don't arise; a null doc_id comes before all others; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import at_most, bounded_batches, spark_broadcast, stored

LENGTH = 100
GRAM = 36
CROWD = 5_000
#: Bytes whose suffix array is built at a time; three names fit in 63 bits up to 2 million.
CHUNK = 1_000_000
#: Bytes whose anchors are looked for at a time.
TILE = 1 << 16
#: Strings in parts of the blocks of crowded grams, at most, step by step.
WIDTHS = (8, 1)
#: Bytes of a document whose removed runs one task merges.
STRETCH = 1 << 20
#: The filter of repeated grams has 8 to 16 bits for each, in slices of SLICE bits; repeated grams beyond what FILTER_BYTES hold are joined instead.
SLICE = 1 << 19
FILTER_BYTES = 64 << 20
FILTER_GRAMS = FILTER_BYTES
#: Crowded grams are broadcast up to this number, and joined beyond.
BROADCAST_CROWDED = 1_000_000
NO_ID = -(1 << 63)

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each position (bytes as an array)."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = words[:n] * _MIX[0]
    part = np.empty(n, dtype=np.uint64)
    for k, at in enumerate((8, 16, 24, GRAM - 8), 1):
        np.multiply(words[at : at + n], _MIX[k], out=part)
        h ^= part
    np.right_shift(h, np.uint64(32), out=part)
    h ^= part
    h *= _MIX[1]
    np.right_shift(h, np.uint64(29), out=part)
    h ^= part
    return h


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the string at each position, and its gram's hash; the leftmost of equal ones."""
    h = gram_hashes(data)
    least = h & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(h), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return anchor, h


def blocks(texts: list[bytes]):
    """Runs of strings with one anchor: (text number, first start in the text, strings, gram), and the joined bytes with each run's place."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    total = len(data) - LENGTH + 1
    if total < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), data, np.zeros(0, np.int64))
    begins = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - begins >= LENGTH)
    usable = np.zeros(total + 1, dtype=np.int8)  # at most one text begins and one ends at a place
    usable[begins[long]] += 1
    usable[ends[long] - LENGTH + 1] -= 1
    usable = np.cumsum(usable[:-1], dtype=np.int8).astype(bool)
    starts, grams, last = [], [], -1
    for at in range(0, total, TILE):  # tiles that fit the processor's cache; strings reach past their tile's end
        anchor, h = _anchors(data[at : at + TILE + LENGTH - 1])
        fresh = np.empty(len(anchor), dtype=bool)
        fresh[0] = anchor[0] + at != last
        np.not_equal(anchor[1:], anchor[:-1], out=fresh[1:])
        inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(anchor))] - at
        fresh[inside] = True
        found = np.flatnonzero(fresh)
        starts.append(found + at)
        grams.append(h[anchor[found]])
        last = int(anchor[-1]) + at
    start, gram = np.concatenate(starts), np.concatenate(grams)
    stop = np.append(start[1:], total)
    keep = usable[start]
    start, stop, gram = start[keep], stop[keep], gram[keep]
    owner = np.searchsorted(ends, start, side="right")
    stop = np.minimum(stop, ends[owner] - LENGTH + 1)
    return owner, start - begins[owner], stop - start, gram, data, start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (whole numbers from 1, fewer than 2**21 of them) by difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(4, dtype=np.int64)]).astype(np.int64)
    first = np.arange(1, n + (n % 3 == 1), 3)  # one place past the end keeps position 0's successor in the sample
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    _, names = np.unique((t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2], return_inverse=True)
    if names.max() + 1 < len(sample):
        order = suffix_array(names + 1)
    else:
        order = np.empty(len(sample), dtype=np.int64)
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << 22) | rank[rest + 1], kind="stable")]
    # Where the rest falls among the sampled suffixes of each residue, by keys that compare as the suffixes do.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    short = lambda i: (t[i] << 22) | rank[i + 1]
    long = lambda i: (t[i] << 42) | (t[i + 1] << 21) | rank[i + 2]
    before = np.searchsorted(short(ones), short(rest)) + np.searchsorted(long(twos), long(rest))
    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = sampled
    return out


def repeats(parts: list[bytes], order: list) -> list[np.ndarray]:
    """For each block which of its strings also start in a block that comes earlier by `order`."""
    data = np.frombuffer(b"\0".join(parts) + b"\0" * 8, dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    usable = np.zeros(len(data), dtype=bool)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(owner)) - begins[owner]
    usable[: len(owner)] = offset + LENGTH <= sizes[owner]
    sa = suffix_array(data[: len(owner)].astype(np.int64) + 1)
    sa = sa[usable[sa]]
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    same = np.ones(max(len(sa) - 1, 0), dtype=bool)
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = words[sa + at]
        same &= w[1:] == w[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
    turn = np.empty(len(parts), dtype=np.int64)
    turn[sorted(range(len(parts)), key=order.__getitem__)] = np.arange(len(parts))
    mine = turn[owner[sa]] * (LENGTH + 1) + offset[sa]  # blocks come in order, and within a block no string repeats
    earliest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(earliest, group, mine)
    gone = np.zeros(len(owner), dtype=bool)
    gone[sa] = mine > earliest[group]
    return [gone[b : b + max(0, s - LENGTH + 1)] for b, s in zip(begins, sizes)]


def _texts(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _repeated_grams(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            grams, n = np.unique(blocks(_texts(batch))[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def _bits(gram: np.ndarray, slices: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Slice of the filter that each gram falls in, and its three bits in there. slices: a power of two."""
    h = gram.view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX[2]  # least hashes have small high halves
    slice_ = (((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)
    h = (h ^ (h >> np.uint64(29))) * _MIX[3]
    mask = np.uint64(SLICE - 1)
    return slice_, [((h >> np.uint64(k)) & mask).astype(np.int64) for k in (45, 26, 7)]


def _filter(grams: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of n grams, built slice by slice in tasks; a row of bytes for each slice. It lets more through beyond FILTER_GRAMS."""
    slices = 1
    while slices * SLICE < 8 * min(n, FILTER_GRAMS):
        slices *= 2

    def deal(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_bits(gram, slices)[0]), pa.array(gram)], names=["slice", "gram"])

    def fill(batches):
        row = lambda k, bits: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])
        current, bits = None, None
        for batch in batches:
            slice_, places = _bits(batch.column("gram").to_numpy(), slices)
            for k in np.unique(slice_).tolist():  # rows arrive by slice
                if k != current:
                    if current is not None:
                        yield row(current, bits)
                    current, bits = k, np.zeros(SLICE // 8, dtype=np.uint8)
                for place in places:
                    own = place[slice_ == k]
                    np.bitwise_or.at(bits, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        if current is not None:
            yield row(current, bits)

    dealt = grams.mapInArrow(deal, "slice long, gram long").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((slices, SLICE // 8), dtype=np.uint8)
    found = dealt.mapInArrow(fill, "slice long, bits binary").toArrow()  # FILTER_BYTES at most
    for k, bits in zip(found.column("slice").to_pylist(), found.column("bits")):
        out[k] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    return out


def _held(known: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which grams the filter holds: all that were put in, and few others."""
    slice_, places = _bits(gram, len(known))
    keep = np.ones(len(gram), dtype=bool)
    for place in places:
        keep &= (known[slice_, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return keep


def _occurrences(docs: DataFrame, known) -> DataFrame:
    """Blocks in documents: gram, b1 and b2 (the block's 128-bit hash), doc_id, start, strings, block.

    The block's bytes are there in one row of
    each batch only, its earliest, so that copies cost a few numbers. known: the filter of grams whose
    blocks count; None: docs has `starts`, the first starts of the blocks that count in each document.
    """
    schema = "gram long, b1 long, b2 long, doc_id long, start int, strings int, block binary"

    def run(batches):
        for batch in batches:
            owner, first, n, gram, data, start = blocks(_texts(batch))
            if known is None:
                starts = batch.column("starts")
                listed = (np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy()) << 32) | starts.flatten().to_numpy()
                keep = np.isin((owner << 32) | first, listed)
            else:
                keep = _held(known.value, gram)
            owner, first, n, gram, start = owner[keep], first[keep], n[keep], gram[keep], start[keep]
            ids = batch.column("doc_id").to_numpy()[owner]
            order = np.lexsort((first, ids))
            ids, first, n, gram, start = ids[order], first[order], n[order], gram[order], start[order]
            whole = data.tobytes()
            parts = [whole[s : s + k] for s, k in zip(start.tolist(), (n + LENGTH - 1).tolist())]
            seen: set[bytes] = set()
            lead = [None if part in seen or seen.add(part) else part for part in parts]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(ids), pa.array(first.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(lead, pa.binary())],
                names=["gram", "b1", "b2", "doc_id", "start", "strings", "block"],
            )

    return docs.mapInArrow(run, schema)


def _ranges(mask: np.ndarray) -> bytes:
    """First and end of each run of true values, as 16-bit numbers (a block has at most 65 strings)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.astype("<u2").tobytes()


def _judged(frames):
    """b1, b2, first_doc, first_start, gone (what the first occurrence loses, null for nothing) of each block; rows arrive by gram."""
    groups: list[dict] = []  # of grams: (b1, b2) -> [block, doc_id, start]
    size, current = 0, None

    def work():
        several = [(key, *row) for own in groups if len(own) > 1 for key, row in own.items()]
        masks = iter(repeats([r[1] for r in several], [r[2:] for r in several]) if several else ())
        rows = [(*key, *row[1:], _ranges(next(masks)) or None if len(own) > 1 else None) for own in groups for key, row in own.items()]
        return pd.DataFrame(rows, columns=["b1", "b2", "first_doc", "first_start", "gone"])

    for frame in frames:
        for gram, block, b1, b2, doc_id, start in frame.itertuples(index=False, name=None):
            if gram != current:
                if size > CHUNK:
                    yield work()
                    groups, size = [], 0
                groups.append({})
                current = gram
            fresh = [block, doc_id, start]
            row = groups[-1].setdefault((b1, b2), fresh)
            if row is fresh:
                size += len(block) + 1
            elif (doc_id, start) < (row[1], row[2]):
                row[1:] = [doc_id, start]
    if groups:
        yield work()


def _split(width: int):
    """Function over first occurrences of blocks: their parts of `width` strings at most, keyed by what all strings of the part must share.

    The place of its anchor belongs to a string, so equal strings are in parts of the same number; all
    strings of a part hold the LENGTH - width + 1 bytes around the anchor that make the part's gram.
    """

    def run(frames):
        names = ["b1", "b2", "first_doc", "first_start", "at", "n", "gram", "block", "c1", "c2"]
        for frame in frames:
            rows = []
            for b1, b2, doc_id, start, block in zip(*[frame[c] for c in ("b1", "b2", "first_doc", "first_start", "block")]):
                n = len(block) - LENGTH + 1
                place = int(_anchors(np.frombuffer(block, dtype=np.uint8))[0][0])
                stop = n
                while stop > 0:  # from the last string, which is nearest to the anchor
                    number = (place - stop + 1) // width
                    begin = max(0, place - number * width - width + 1)
                    shared = place - number * width
                    gram = xxhash.xxh64_intdigest(block[shared : shared + LENGTH - width + 1], number) - (1 << 63)
                    part = block[begin : stop + LENGTH - 1]
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(part), dtype="<i8").tolist()
                    rows.append((b1, b2, doc_id, start, begin, stop - begin, gram, part, c1, c2))
                    stop = begin
            yield pd.DataFrame(rows, columns=names)

    return run


def _composed(frames):
    """b1, b2, first_doc, first_start, gone of blocks from what was found for their parts."""
    for frame in frames:
        gone = []
        for parts in frame["parts"]:
            mask = np.zeros(LENGTH, dtype=bool)
            for part in parts:
                if part["whole"]:
                    mask[part["at"] : part["at"] + part["n"]] = True
                elif part["gone"] is not None:
                    edge = np.frombuffer(part["gone"], dtype="<u2").astype(np.int64) + part["at"]
                    for first, end in zip(edge[0::2], edge[1::2]):
                        mask[first:end] = True
            gone.append(_ranges(mask) or None)
        yield pd.DataFrame({**{c: frame[c] for c in ("b1", "b2", "first_doc", "first_start")}, "gone": gone})


def _firsts(meeting: DataFrame, crowd: int, widths=WIDTHS) -> DataFrame:
    """b1, b2, first_doc, first_start, gone of every block. meeting: gram, block, b1, b2, doc_id, start, with each block's first occurrence.

    Grams that more than `crowd` rows bring along are resolved by parts of their blocks, which meet by
    longer grams; parts of single strings that still meet are equal, so the last step needs no bound.
    """
    schema = "b1 long, b2 long, first_doc long, first_start int, gone binary"
    judged = lambda rows: rows.repartition("gram").sortWithinPartitions("gram").mapInPandas(_judged, schema)
    if not widths:
        return judged(meeting)
    crowded = stored(meeting.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("gram"))
    if at_most(crowded, 0):
        return judged(meeting)
    place = F.struct("doc_id", "start")
    hard = meeting.join(F.broadcast(crowded) if at_most(crowded, BROADCAST_CROWDED) else crowded, "gram", "left_semi")
    hard = hard.groupBy("b1", "b2").agg(F.min(place).alias("p"), F.min("block").alias("block"))  # equal blocks
    hard = hard.select("b1", "b2", F.col("p.doc_id").alias("first_doc"), F.col("p.start").alias("first_start"), "block")
    parts = "b1 long, b2 long, first_doc long, first_start int, at int, n int, gram long, block binary, c1 long, c2 long"
    parts = stored(hard.mapInPandas(_split(widths[0]), parts))
    below = parts.select("gram", "block", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("first_doc").alias("doc_id"), (F.col("first_start") + F.col("at")).alias("start"))
    found = _firsts(below, crowd, widths[1:]).select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("first_doc").alias("d0"), F.col("first_start").alias("s0"), "gone")
    whole = (F.col("first_doc") != F.col("d0")) | (F.col("first_start") + F.col("at") != F.col("s0"))
    own = parts.drop("block", "gram").join(found, ["c1", "c2"]).groupBy("b1", "b2", "first_doc", "first_start").agg(F.collect_list(F.struct("at", "n", whole.alias("whole"), "gone")).alias("parts"))
    return judged(meeting.join(crowded, "gram", "left_anti")).unionByName(own.mapInPandas(_composed, schema))


def _with_starts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Documents with the first starts of their blocks of these grams; for more grams than the filter bears."""

    def run(batches):
        for batch in batches:
            owner, first, _, gram, _, _ = blocks(_texts(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), batch.column("doc_id").take(pa.array(owner)), pa.array(first)], names=["gram", "id", "start"]
            )

    found = docs.mapInArrow(run, "gram long, id long, start long").join(grams, "gram", "left_semi")
    starts = found.groupBy("id").agg(F.collect_list("start").alias("starts"))  # of one document
    return docs.join(starts, F.col("doc_id") == F.col("id")).select("doc_id", "text", "starts")


def repeat_ranges(docs: DataFrame, crowd: int = CROWD, filter_grams: int = FILTER_GRAMS) -> DataFrame:
    """doc_id, ranges (first and end of the removed runs of bytes, as 64-bit numbers, in one piece for each stretch) of each doc_id that loses bytes."""
    grams = stored(_repeated_grams(docs))
    n = grams.count()
    if n <= filter_grams:
        occurrences = _occurrences(docs, spark_broadcast(docs, _filter(grams, n)))
    else:
        occurrences = _occurrences(_with_starts(docs, grams), None)
    occurrences = stored(occurrences)
    meeting = occurrences.where("block IS NOT NULL").select("gram", "block", "b1", "b2", "doc_id", "start")
    firsts = _firsts(meeting, crowd)
    places = occurrences.select("b1", "b2", "doc_id", "start", "strings")
    joined = places.join(firsts, ["b1", "b2"]).withColumn("whole", (F.col("doc_id") != F.col("first_doc")) | (F.col("start") > F.col("first_start")))
    lost = joined.where("whole OR gone IS NOT NULL").select("doc_id", "start", "strings", F.when(~F.col("whole"), F.col("gone")).alias("gone"))

    lost = lost.withColumn("stretch", F.expr(f"start div {STRETCH}").cast("int"))  # a long document is merged by several tasks
    dealt = lost.repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch")
    merged = dealt.mapInArrow(_stretches, "doc_id long, ranges binary")
    return merged.groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges"))  # one for each stretch of the document


def _stretches(batches):
    """doc_id, ranges of each stretch, the runs merged; rows arrive by doc_id and stretch."""

    def runs(doc, stretch, begin, end):
        order = np.lexsort((begin, stretch, doc))
        doc, stretch, begin, end = doc[order], stretch[order], begin[order], end[order]
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1]))
        shift = np.cumsum(fresh) << 40  # so that the largest end so far starts anew with each stretch
        reach = np.maximum.accumulate(end + shift)
        first = np.flatnonzero(np.append(True, (begin + shift)[1:] > reach[:-1]))
        last = np.append(first[1:], len(begin)) - 1
        pairs = np.stack([begin[first], (reach - shift)[last]], axis=1).astype("<i8")
        heads = np.flatnonzero(fresh[first])
        offsets = np.append(heads, len(first)).astype(np.int32) * 16
        ranges = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(doc[first[heads]]), ranges], names=["doc_id", "ranges"])

    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        doc, stretch, start, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "stretch", "start", "strings"))
        gone, part = batch.column("gone"), np.flatnonzero(batch.column("gone").is_valid().to_numpy(zero_copy_only=False))
        own = [[doc, stretch, start, start + n - 1 + LENGTH]]
        if len(part):
            keep = np.ones(len(doc), dtype=bool)
            keep[part] = False
            own = [[x[keep] for x in own[0]]]
            edges = [np.frombuffer(gone[int(k)].as_py(), dtype="<u2").astype(np.int64) for k in part]
            times, edges = np.array([len(e) // 2 for e in edges]), np.concatenate(edges)
            at = np.repeat(start[part], times)
            own.append([np.repeat(doc[part], times), np.repeat(stretch[part], times), at + edges[0::2], at + edges[1::2] - 1 + LENGTH])
        held = [np.concatenate(x) for x in zip(held, *own)]
        if not len(doc):
            continue
        now = (held[0] == doc[-1]) & (held[1] == stretch[-1])  # may go on in the next batch
        if not now.all():
            yield runs(*[x[~now] for x in held])
            held = [x[now] for x in held]
    if len(held[0]):
        yield runs(*held)


def _merged(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(zip(begins, ends)):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept (the bytes that stay) of every row.

    Only texts of documents that lose bytes, as told by a filter, are shuffled to meet their ranges.
    """
    bounded_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = own.withColumn("__own", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = stored(repeat_ranges(keyed.select("doc_id", "text")))
    losing = spark_broadcast(docs, _filter(found.select(F.col("doc_id").alias("gram")), found.count()))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept": pa.binary()} if keep_bytes else {})}

    def cut(batch, lost):
        """lost: for each row the pieces of its ranges."""
        cols = {k: [] for k in kinds}
        for data, ranges in zip(_texts(batch), lost):
            kept, at, n_spans = [], 0, 0
            edges = np.frombuffer(b"".join(ranges or ()), dtype="<i8").reshape(-1, 2)
            for b, e in _merged(edges[:, 0].tolist(), edges[:, 1].tolist()):
                kept.append(data[at:b])
                at, n_spans = e, n_spans + 1
            kept = b"".join([*kept, data[at:]])
            for k, x in zip(cols, (len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                cols[k].append(x)
        return pa.RecordBatch.from_arrays([batch.column("__own"), *[pa.array(cols[k], kind) for k, kind in kinds.items()]], names=["doc_id", *kinds])

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(_held(losing.value, batch.column("doc_id").to_numpy())))

    def untouched(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_held(losing.value, batch.column("doc_id").to_numpy())))
            yield cut(batch, [None] * batch.num_rows)

    def shortened(batches):
        for batch in batches:
            yield cut(batch, batch.column("ranges").to_pylist())

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    met = keyed.mapInArrow(touched, keyed.schema).join(found.hint("merge"), "doc_id", "left")
    return met.select("__own", "text", "ranges").mapInArrow(shortened, schema).unionByName(keyed.mapInArrow(untouched, schema))


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
