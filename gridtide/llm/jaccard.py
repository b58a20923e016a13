"""Near-duplicate documents: an exact n-gram Jaccard join.

Method: parity-sketch join.  A document is the set of its word shingles.  The
shingles' hashes are XORed into a sketch of segments; every shingle that only
one of two documents has changes at most one segment, so the number of segments
in which two sketches differ is a lower bound for their symmetric difference.

Two sets of sizes a <= b with a Jaccard similarity of at least s differ in at
most d = (a + b)(1 - s)/(1 + s) shingles, and b <= a/s.  Sizes are cut into
bands; in the band of a, sketches have one segment more than the greatest d
there.  By the pigeonhole principle two linked documents agree in a segment:
equal segments are found by a join, whatever the number of documents.

The agreeing segment may be an empty one.  Empty segments are no join key; in
the bands of small sets a document with an empty segment also puts out its
prefix (the least hashes, of which two linked sets must share one), so no link
is lost.  In bands beyond ``SMALL`` shingles, where a sketch has more than
eighty segments, all agreeing segments of two linked sets are empty with a
probability below 1e-20, less than that of two equal 64-bit hashes.

Candidates are verified twice: by bit sketches (two bits a shingle), whose
Hamming distance is a lower bound of the symmetric difference too, and then on
the whole shingle sets.  Verification goes in three rounds, and linked documents
become components after each.  First the members of a segment's group are
compared with one of them only, then those still in different components with a
few others whose sketches are nearest, and at last every two members in different components that agree in
some segment, where that may be more.  So a group of many copies costs a few comparisons each, not all
pairs, and yet every pair that could join two components is tested.

Before the second round groups are gathered: equal ones are one, and those of
which one component holds the most become one for that component.  A large
group of near copies shares many segments and would else meet in each of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import ROWS, components, filled, relabelled, stored, stored_by
from gridtide.llm.words import SPACED, Words, forget_others, give_back, mix, shingles, text_chunks

SHINGLE = 5
#: Least Jaccard similarity of linked documents, in percent.
SIMILARITY = 75
#: Growth of the size bands.
BAND = 4 / 3
#: Bands of sets up to this size are safe against empty segments by prefixes.
SMALL = 256
#: Members of one segment in one part of the input from which they are spread over tasks.
HOT = 64
#: Segments put out at once; a part of the input with more gives several rows a bucket.
FLUSH = 1 << 19
#: Others of a meeting, the nearest by their sketches, that a member is compared with in the second round.
NEAREST = 3
#: Members of a meeting that are compared in one group; more are cut into pieces, compared two by two.
PIECE = 4000
#: Rows with a sketch, and rows with a text or a shingle set, that fill a task.
SKETCHES = 1 << 13
SETS = 1 << 10
#: Meetings that a document has, about, before they are counted.
MET = 16

_XOR = np.uint64(0xD6E8FEB86659FD93)


class Bands:
    """Size bands and their numbers of segments, for one similarity in percent."""

    def __init__(self, percent: int, longest: int) -> None:
        self.percent = percent
        first = [1]
        while first[-1] <= longest:
            first.append(max(first[-1] + 1, int(first[-1] * BAND)))
        self.first = np.array(first)
        last = self.first[1:] - 1
        partner = last * 100 // percent  # the largest set that a set of the band can be linked with
        self.partner = partner
        self.segments = (last + partner) * (100 - percent) // (100 + percent) + 1
        self.last = last

    def of(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(band, places of the sizes that take part in it)."""
        for k in range(len(self.segments)):
            held = np.flatnonzero((sizes >= self.first[k]) & (sizes <= max(self.last[k], self.partner[k])))
            if len(held):
                yield k, held


@functools.cache
def bands(percent: int, octave: int) -> Bands:
    return Bands(percent, 2**octave)


def signatures(first: np.ndarray, value: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all non-empty segments, and prefixes where they are needed.

    Set i has the sorted hashes value[first[i]:first[i + 1]].
    """
    sizes = np.diff(first)
    out_set, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if not len(sizes) or not sizes.max():
        return out_set[0], out_sig[0]
    scattered = mix(value ^ _XOR)
    high = value >> np.uint64(32)
    cut = bands(percent, int(sizes.max()).bit_length())
    for k, held in cut.of(sizes):
        n = sizes[held]
        many = np.uint64(cut.segments[k])
        owner = np.repeat(held, n)
        at = np.repeat(first[held] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        segment = (high[at] * many) >> np.uint64(32)  # ascending in each set, as the hashes are
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])))
        begin = np.flatnonzero(new)
        xor = np.bitwise_xor.reduceat(scattered[at], begin)
        tag = np.uint64((2 * k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)
        out_set.append(owner[begin])
        out_sig.append(mix(xor ^ mix(segment[begin] + tag)))
        if cut.last[k] <= SMALL:
            filled = np.bincount(np.searchsorted(held, owner[begin]), minlength=len(held))
            holey = np.flatnonzero(filled < int(many))
            need = n[holey] - -(-n[holey] * percent // 100) + 1
            own = np.repeat(held[holey], need)
            place = np.repeat(first[held[holey]] - np.concatenate(([0], np.cumsum(need)[:-1])), need) + np.arange(need.sum())
            out_set.append(own)
            out_sig.append(mix(value[place.astype(np.int64)] + tag + np.uint64(1)))
    return np.concatenate(out_set), np.concatenate(out_sig)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First places and sorted hashes of the shingle sets of some texts."""
    words = Words(column, SPACED)
    text, value = shingles(words, SHINGLE)
    return np.searchsorted(text, np.arange(len(column) + 1)), value


def _set_keys(first: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that are equal for equal sets."""
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + _XOR))))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x8BB84B93962EACC9)))))
    return (a[first[1:]] - a[first[:-1]]).view(np.int64), (b[first[1:]] - b[first[:-1]]).view(np.int64)


def bit_sketch(values: np.ndarray) -> bytes:
    """Parity sketch of a set: each hash flips one of at least two bits a member."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    flips = np.bincount((mix(values + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> int:
    """The sketch with ``size`` bytes that the same set would have had."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half]) ^ int.from_bytes(sketch[half:])).to_bytes(half)
    return int.from_bytes(sketch)


def may_link(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes, percent: int) -> bool:
    """False only if the sizes or the sketches rule the similarity out."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    size = min(len(sketch_a), len(sketch_b))
    unlike = (_folded(sketch_a, size) ^ _folded(sketch_b, size)).bit_count()
    return unlike * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _described(docs: DataFrame) -> DataFrame:
    """(id, n, k1, k2, sketch) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                first, value = _sets(batch["text"].slice(a, b - a))
                k1, k2 = _set_keys(first, value)
                sketch = [bit_sketch(value[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(k1), pa.array(k2), pa.array(sketch, pa.binary())], names=["id", "n", "k1", "k2", "sketch"]
                )
            give_back()

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, sketch binary")


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight together, which packs well when the high ones are zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _bucketed(docs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(bucket, hot, gaps, places, ids): signatures dealt to buckets, those of one part of the input sorted and packed.

    Sets that occur more than once in the part count once.  A signature with
    many members there is hot: it goes to its bucket with one of them, and with
    all of them to another bucket that depends on the part.
    """

    def packed(sets: list, sigs: list, ids: list) -> Iterator[pa.RecordBatch]:
        id_of = np.concatenate(ids)
        member, sig = np.concatenate(sets), np.concatenate(sigs)
        sets.clear()
        sigs.clear()
        if not len(sig):
            return
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(sig)  # ascending signatures are ascending buckets
        member, sig, bucket = member[order], sig[order], bucket[order]
        begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        many = np.diff(np.append(begin, len(sig)))
        warm = np.repeat(many > HOT, many)
        hot = np.zeros(len(sig), dtype=bool)
        if warm.any():
            lead = begin[many > HOT]
            salt = int(id_of[0]) * 2654435761 % buckets
            moved = (bucket[warm] + 1 + salt) % buckets
            bucket = np.concatenate((bucket[~warm], bucket[lead], moved))
            member = np.concatenate((member[~warm], member[lead], member[warm]))
            sig = np.concatenate((sig[~warm], sig[lead], sig[warm]))
            hot = np.arange(len(sig)) >= (~warm).sum()
            order = np.lexsort((sig, hot, bucket))
            member, sig, bucket, hot = member[order], sig[order], bucket[order], hot[order]
        edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1]))))
        rows: dict[str, list] = {"bucket": [], "hot": [], "gaps": [], "places": [], "ids": []}
        for x, y in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
            used, place = np.unique(member[x:y], return_inverse=True)
            gaps = np.concatenate((sig[x : x + 1], np.diff(sig[x:y])))
            rows["bucket"].append(int(bucket[x]))
            rows["hot"].append(bool(hot[x]))
            rows["gaps"].append(_planes(gaps))
            rows["places"].append(_planes(place.astype(np.uint32)))
            rows["ids"].append(_planes(id_of[used]))
        kinds = [("bucket", pa.int32()), ("hot", pa.bool_()), ("gaps", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())]
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list = []
        sigs: list = []
        ids: list = []
        held = total = 0
        forget_others()
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                first, value = _sets(batch["text"].slice(a, b - a))
                own = batch["id"].slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                k1, k2 = _set_keys(first, value)
                order = np.lexsort((own, k2, k1))
                same = np.concatenate(([False], (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])))
                single = np.zeros(len(own), dtype=bool)
                single[order[~same]] = True
                member, sig = signatures(first, value, percent)
                keep = single[member]
                sets.append(member[keep] + total)
                sigs.append(sig[keep])
                ids.append(own)
                total += len(own)
                held += int(keep.sum())
                if held >= FLUSH:
                    del first, value, k1, k2, order, same, single, member, sig, keep
                    yield from packed(sets, sigs, ids)
                    sets, sigs, ids, held, total = [], [], [], 0, 0
                    give_back()
        if ids:
            yield from packed(sets, sigs, ids)
        give_back()

    return docs.mapInArrow(run, "bucket int, hot boolean, gaps binary, places binary, ids binary")


def _meetings(bucketed: DataFrame) -> DataFrame:
    """(hot, meeting, id, lead): documents that share a signature, and the least of them in their bucket.

    All documents that share a signature are in one meeting.  The meeting of a
    signature that is hot nowhere is that of its least document, so documents
    that share many signatures meet once; a hot signature, whose documents are
    in several buckets, is a meeting of its own.
    """

    def run(rows: pa.Table) -> pa.Table:
        sigs, ids, flags = [], [], []
        for hot, gaps, places, own in zip(*(rows[c] for c in ("hot", "gaps", "places", "ids")), strict=True):
            sigs.append(np.cumsum(_unplaned(gaps.as_py(), np.uint64)))
            ids.append(_unplaned(own.as_py(), np.int64)[_unplaned(places.as_py(), np.uint32)])
            flags.append(np.full(len(sigs[-1]), hot.as_py()))
        sig, own, hot = np.concatenate(sigs), np.concatenate(ids), np.concatenate(flags)
        sigs.clear()
        ids.clear()
        order = np.argsort(sig)
        sig, own, hot = sig[order], own[order], hot[order]
        kept = hot.copy()  # of a hot signature there are more documents elsewhere
        equal = sig[1:] == sig[:-1]
        kept[1:] |= equal
        kept[:-1] |= equal
        sig, own, hot = sig[kept], own[kept], hot[kept]
        order = np.lexsort((own, sig))
        sig, own, hot = sig[order], own[order], hot[order]
        first = np.ones(len(sig), dtype=bool)
        first[1:] = sig[1:] != sig[:-1]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(sig)))
        lead = np.repeat(own[begin], size)
        hot = np.repeat(np.logical_or.reduceat(hot, begin) if len(begin) else hot, size)
        meeting = np.where(hot, sig.view(np.int64), lead)
        out = pa.table({"hot": hot, "meeting": meeting, "id": own, "lead": lead}).group_by(["hot", "meeting", "id", "lead"]).aggregate([])
        del sig, own, hot, order, kept, equal, first, begin, size, lead, meeting
        give_back()
        return out

    schema = "hot boolean, meeting long, id long, lead long"
    return bucketed.groupBy("bucket").applyInArrow(run, schema).distinct()


def _plausible(pairs: DataFrame, described: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b), about ``rows``, that sizes and bit sketches do not rule out."""
    side = lambda c: described.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    joined = filled(pairs.join(side("a"), "a"), rows, SKETCHES).join(side("b"), "b").select("a", "n_a", "sketch_a", "b", "n_b", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b")]
            keep = pa.array([may_link(*x, percent) for x in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return filled(joined, rows, SKETCHES).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity; ``pairs`` is stored."""
    rows = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                first, value = _sets(batch["text"].slice(a, b - a))
                sets = [_planes(np.concatenate((value[x : x + 1], np.diff(value[x:y])))) for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(sets, pa.binary())], names=["id", "hashes"])
            give_back()

    sets = filled(docs.join(ids, "id", "left_semi"), 2 * rows, SETS).mapInArrow(pack, "id long, hashes binary")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    joined = filled(pairs.join(side("b"), "b"), rows, SETS).join(side("a"), "a").select("a", "b", "hashes_a", "hashes_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["hashes_a"].to_pylist(), batch["hashes_b"].to_pylist(), strict=True):
                x, y = np.cumsum(_unplaned(a, np.uint64)), np.cumsum(_unplaned(b, np.uint64))
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[place] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return filled(joined, rows, SETS).mapInArrow(run, "a long, b long")


def _unlike_pairs(n: np.ndarray, bits: np.ndarray, component: np.ndarray, piece: np.ndarray | None, percent: int, most: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places j) of members, in order of size, that sizes and sketches do not rule out and that are in different components.

    Members of the largest component are only compared with the others.  With
    ``most`` only so many j with the least distance are given for each i.
    """
    names, sizes = np.unique(component, return_counts=True)
    inside = component == names[sizes.argmax()]
    low = np.searchsorted(n, -(-n * percent // 100), "left")
    high = np.searchsorted(n, n * 100 // percent, "right")
    for i in np.flatnonzero(~inside):
        j = np.arange(low[i], high[i])
        other = component[j] != component[i]
        if most is None:  # each pair once
            other &= inside[j] | (j > i)
        if piece is not None:
            other &= piece[j] != piece[i]
        j = j[other]
        if len(j):
            unlike = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            possible = unlike * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
            j, unlike = j[possible], unlike[possible]
            if most is not None and len(j) > most:
                j = j[np.argpartition(unlike, most)[:most]]
            if len(j):
                yield i, j


def _across(rows: DataFrame, percent: int, buckets: int, most: int | None = None) -> DataFrame:
    """(id, others) of members of a meeting that are in different components and that the sketches do not rule out.

    ``rows`` has ``members``, the number of its meeting's members.  ``most`` keeps
    for each member the nearest others of a meeting only; rows without id then
    name the meetings in which there may be more.
    """

    def run(table: pa.Table) -> pa.Table:
        hot = table["hot"].to_numpy(zero_copy_only=False)
        meeting, a, b = (table[c].to_numpy() for c in ("meeting", "first", "second"))
        n, own, component, piece = (table[c].to_numpy() for c in ("n", "id", "component", "piece"))
        order = np.lexsort((own, n, b, a, meeting, hot))
        new = np.ones(len(order), dtype=bool)
        key = [x[order] for x in (hot, meeting, a, b)]
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        edge = np.append(np.flatnonzero(new), len(order))
        sketches = table["sketch"].to_pylist()
        found: dict[int, list[np.ndarray]] = {}
        more: set[tuple[bool, int]] = set()
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            at = order[x:y]
            width = min(len(sketches[k]) for k in at)
            bits = np.frombuffer(b"".join(_folded(sketches[k], width).to_bytes(width) for k in at), dtype=np.uint64).reshape(len(at), -1)
            pieces = piece[at] if a[at[0]] != b[at[0]] else None
            for i, j in _unlike_pairs(n[at], bits, component[at], pieces, percent, most):
                found.setdefault(int(own[at[i]]), []).append(own[at[j]])
                if most is not None and len(j) == most:
                    more.add((bool(hot[at[0]]), int(meeting[at[0]])))
        lists = [(k, np.unique(np.concatenate(x)), None, None) for k, x in found.items()]
        lists += [(None, None, h, m) for h, m in sorted(more)]
        kinds = {"id": pa.int64(), "others": pa.list_(pa.int64()), "hot": pa.bool_(), "meeting": pa.int64()}
        return pa.table({c: pa.array([x[k] for x in lists], kind) for k, (c, kind) in enumerate(kinds.items())})

    pieces = F.ceil(F.col("members") / PIECE).cast("int")
    cut = rows.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("with"))
    dealt = dealt.select(
        "hot", "meeting", "id", "component", "n", "sketch", "piece", F.least("piece", "with").alias("first"), F.greatest("piece", "with").alias("second")
    )
    bucket = F.pmod(F.xxhash64("hot", "meeting", "first", "second"), F.lit(buckets)).alias("bucket")
    return dealt.groupBy(bucket).applyInArrow(run, "id long, others array<long>, hot boolean, meeting long")


def _pairs(lists: DataFrame, rows: int) -> DataFrame:
    """(a, b) of documents and their candidates, in ``rows`` lists; what they met more than once is dropped before it becomes rows."""
    once = lists.filter("id is not null").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    pairs = filled(once, rows, SETS).select("id", F.explode("others").alias("other"))
    return filled(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), rows, SETS)


def _by_meeting(placed: DataFrame, buckets: int) -> DataFrame:
    """Distinct rows (hot, meeting, id, component), stored by meeting: what follows finds a meeting's rows in place.

    A hot and a cold meeting with one number, which only chance makes, are one.
    """
    rows = placed.groupBy("meeting", "id", "component").agg(F.max("hot").alias("hot")).repartition(buckets, "meeting")
    return stored_by(rows.select("hot", "meeting", "id", "component"), "placed", "meeting", buckets)


def _hot_gathered(shared: DataFrame, many: int = ROWS) -> DataFrame:
    """(hot, meeting, id) of the hot meetings, those of like members as one; every pair of members is still together.

    A large group of near copies meets in every signature that no edit touched.
    Of meetings with the same members, told by their number and two sums of
    hashes, one stays; those with the same member of least hash become one,
    which is as likely as their members are alike.  ``shared`` has about ``many`` rows.
    """
    rows = filled(shared.filter("hot").select("meeting", "id").distinct(), many)
    found = rows.groupBy("meeting").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.min(F.xxhash64("id", F.lit(2))).alias("name"),
    )
    kept = filled(filled(found, many).groupBy("members", "x", "y", "name").agg(F.min("meeting").alias("meeting")), many)
    named = filled(filled(rows.join(kept.select("meeting", "name"), "meeting"), many).select("name", "id").distinct(), many)
    return named.select(F.lit(True).alias("hot"), F.col("name").alias("meeting"), "id")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (hot, meeting, id, component) of meetings with several components, and their number of members."""
    sizes = placed.groupBy("meeting").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    return placed.join(sizes.filter("low < high").drop("low", "high"), "meeting")


def _gathered(placed: DataFrame) -> DataFrame:
    """Meetings with several components, gathered: (hot, meeting, id, component), every pair of members still together.

    Of meetings with the same members one stays.  Meetings of which one
    component holds at least half of the members become one for each such
    component: its members and all the others.  That is a hot meeting, with the
    component's hash in the place of a signature.
    """
    # Members are compared by their number and two sums of hashes.
    parts = placed.groupBy("meeting", "component").agg(
        F.count("*").alias("part"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    found = parts.groupBy("meeting").agg(
        F.sum("part").alias("members"), F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        F.max(F.struct("part", (-F.col("component")).alias("c"))).alias("most"),
    ).filter("n > 1")
    largest = F.when(2 * F.col("most.part") >= F.col("members"), -F.col("most.c"))
    kept = found.groupBy("members", "x", "y").agg(F.min("meeting").alias("meeting"), F.min_by(largest, "meeting").alias("largest"))
    rows = placed.join(kept.select("meeting", "largest"), "meeting")
    alone = F.col("largest").isNull()
    return rows.select(
        (F.col("hot") | ~alone).alias("hot"), F.when(alone, F.col("meeting")).otherwise(F.xxhash64("largest")).alias("meeting"), "id", "component"
    )


def near_duplicates(df: DataFrame, document: str = "doc_id", column: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """(document, n_shingles, component_id) of every row of ``df``.

    A row's set are the distinct shingles of five words of its whole text,
    lower-cased in A-Z; a text of fewer words is one shingle.  Two rows are
    linked if 100 * common >= ``percent`` * all of their shingles.
    ``component_id`` is the least id that can be reached by links, the row's own
    included.  Null and empty texts have no shingles and are linked with
    nothing.  Ids have to be long; a row without id gets a null component and
    links nothing.  Repeated rows each get their result.  Rows with one id and
    different texts are one document that has the links of all of its texts.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = df.select(F.col(document).cast("long").alias("id"), F.col(column).alias("text"))
    docs = every.filter("id is not null")
    described = stored(_described(every), "described")
    many = described.count()
    # Equal sets are one node: the least id that has them.
    with_set = described.filter("n > 0 and id is not null")
    copies = with_set.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    nodes = stored(filled(with_set.join(copies, ["n", "k1", "k2"]).select("id", "rep", "n", "sketch"), many, SKETCHES), "nodes")
    reps = filled(nodes.select(F.col("id").alias("own"), "rep").distinct(), many)
    heads = filled(nodes.filter("id = rep").distinct().select("id", "n", "sketch"), many, SKETCHES)
    shared = stored(filled(_meetings(_bucketed(docs, percent, buckets)), MET * many), "meetings")
    met = shared.count()
    # First round: each member of a signature with the least one.
    stars = filled(shared.filter("id <> lead").select("id", "lead").distinct(), met)
    stars = filled(stars.join(reps, F.col("id") == F.col("own")).select(F.col("rep").alias("x"), "lead"), met)
    stars = filled(stars.join(reps, F.col("lead") == F.col("own")).select("x", F.col("rep").alias("y")), met)
    pairs = filled(stars.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), met)
    links = stored(_verified(stored(_plausible(pairs, heads, percent, met), "pairs"), docs, percent), "links")
    # The sets of an id with several texts belong together.
    several = reps.groupBy("own").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).filter("b < high")
    several = filled(several.join(reps, "own").select(F.col("rep").alias("u"), F.col("b").alias("v")), many)
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(several), many)
    # Meetings whose least documents are in one component by now become one, so that no two documents
    # meet over and over.
    places = stored(filled(relabelled(reps.withColumn("component", F.col("rep")), "component", joined), many), "places")
    there = places.select(F.col("own").alias("meeting"), F.col("component").alias("there"))
    cold = filled(shared.filter("not hot").select("meeting", "id").join(there, "meeting"), met)
    cold = filled(cold.select(F.lit(False).alias("hot"), F.col("there").alias("meeting"), "id").distinct(), met)
    placed = cold.unionByName(_hot_gathered(shared, met))
    placed = filled(placed.join(places, F.col("id") == F.col("own")).select("hot", "meeting", F.col("rep").alias("id"), "component"), met)
    placed = _by_meeting(_gathered(_by_meeting(placed, buckets // 8)), buckets // 8)

    def with_sketch(rows: DataFrame) -> DataFrame:
        return rows.join(heads, "id").select("hot", "meeting", "members", "id", "component", "n", "sketch")

    def joined_by(links: DataFrame) -> DataFrame:
        """Labels of the components that some links join; those of the round before are the nodes."""
        rows = links.count()
        of = filled(places.select(F.col("rep").alias("id"), "component").distinct(), many)
        sides = filled(links.join(of.select(F.col("id").alias("a"), F.col("component").alias("u")), "a"), rows)
        sides = filled(sides.join(of.select(F.col("id").alias("b"), F.col("component").alias("v")), "b"), rows)
        return components(sides.select("u", "v"), rows)

    # Second round: members with the likeliest others of their meeting in other components.
    near = stored(filled(_across(with_sketch(_mixed(placed)), percent, buckets, NEAREST), met, SKETCHES), "nearest")
    joined = joined_by(stored(_verified(stored(_pairs(near, near.count()), "pairs"), docs, percent), "links"))
    # Third round: all members of different components, where a meeting had more of them than were compared.
    unfinished = near.filter("id is null").select("meeting").distinct()
    placed = _mixed(_by_meeting(relabelled(placed.join(unfinished, "meeting", "left_semi"), "component", joined), buckets // 8))
    places = stored(filled(relabelled(places, "component", joined), many), "places")
    more = stored(_pairs(_across(with_sketch(placed), percent, buckets), met), "pairs")
    joined = joined_by(stored(_verified(more, docs, percent), "links"))
    final = relabelled(places, "component", joined).select(F.col("own").alias("id"), "component").distinct()
    found = filled(described.select("id", "n").join(final, "id", "left"), many)
    return found.select(F.col("id").alias(document), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
