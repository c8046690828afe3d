"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, exact intersection.

1. Frequencies of shingles, summed into a table of fixed size, give one global order: rare first, then by hash.
2. Two sets with ``100 * common >= percent * union`` share one of the first ``n - ceil(percent * n / 100) + 1``
   shingles of that order (prefix filter). The sets that hold such a shingle, sorted by size, are cut into bands
   wherever a size can't link with the one before; a band of several sets names a *tile* after its first set,
   and a set joins each of its tiles once. Tiles of over ``tile_rows`` sets are cut into blocks, and each
   pair of blocks is a tile of its own, so no task ever holds an unbounded group.
3. A share of 1 / SAMPLE of the shingles, as 32 bits each, bounds the overlap: ``common <= common of the shares +
   min(|x| - |share of x|, |y| - |share of y|)``. A set stays in a tile if this lets it link with another there.
4. In what is left of a tile, sets sorted by size are compared with those in their reach. ``common <= bits(x & y) + min(|x| -
   bits(x), |y| - bits(y))`` bounds the overlap from above; all that passes is verified by intersecting the sorted arrays, each
   pair in the least tile of both. What leaves the task: for each set the number of rows it links with there, and a spanning forest.
5. Components of the forests are the classes. No link between different texts is lost or counted twice; no pair of copies is expanded.

What is shuffled: prefix shingles of distinct sets, shares of sets that have a tile, and texts of those that stay. Sets are told apart by
a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import prepare, slices, stage, text_offsets
from .words import shingle_sets, word_hashes

BITS = 24
CHUNK = 1 << 17
SAMPLE = 8
HOT = 0.001


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def _sets(batches, n: int, column: str = "text"):
    for batch in batches:
        for part in slices(batch, column):
            raw, offs = text_offsets(part.column(column))
            yield part, shingle_sets(*word_hashes(raw, offs), n)


def _chunks(totals) -> pa.RecordBatch:
    rows = [(k, x.tobytes()) for k, x in totals if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])


def _count(n: int):
    def run(batches):
        total = np.zeros(1 << BITS, np.uint8)
        for _, sets in _sets(batches, n):
            at = np.sort(_buckets(np.concatenate(sets)).astype(np.int32)) if sets else np.zeros(0, np.int32)
            first = np.flatnonzero(np.append(np.ones(min(1, len(at)), bool), at[1:] != at[:-1]))
            at, counts = at[first], np.diff(np.append(first, len(at)))
            total[at] = np.minimum(total[at] + counts, 255)
        yield _chunks((k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(len(total) // CHUNK))

    return run


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = np.frombuffer(counts.as_py(), np.uint8)
            total[k] = np.minimum(total.get(k, np.zeros(CHUNK, np.uint32)) + got, 1 << 24)
    # small counts as they are, large ones by magnitude: 8 bits each, in the same order
    yield _chunks((k, np.where(v < 128, v, np.minimum(255, 100 + 4 * np.log2(np.maximum(v, 1)))).astype(np.uint8)) for k, v in total.items())


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Of all texts' shingles, by bucket of their hash: 2**BITS ranks of 8 bits, whatever the size of the corpus."""
    kind = "chunk int, counts binary"
    out = np.zeros(1 << BITS, np.uint8)
    for r in docs.select("text").mapInArrow(_count(n), kind).repartition("chunk").mapInArrow(_add, kind).collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return out


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _keys(n: int, percent: int, freq):
    """(rid, doc_id, row, n_shingles, set_id, keys, share): keys are the prefix in the global order; only the first of a task's equal sets has these two."""

    def run(batches):
        counts, seen = freq.value, set()
        for part, sets in _sets(batches, n):
            sizes, ids, keys, shares = [], [], [], []
            for s in sets:
                sizes.append(len(s))
                ids.append(set_hash(s) if len(s) else None)
                most = len(s) - -(-percent * len(s) // 100) + 1 if len(s) and ids[-1] not in seen else 0
                shares.append((s[s % np.uint64(SAMPLE) == 0] >> np.uint64(32)).astype("<u4").tobytes() if most else None)
                seen.add(ids[-1])
                if most < len(s):
                    s = s[np.lexsort((s, counts[_buckets(s)]))[:most]]
                keys.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(shares, pa.binary())],
                ["rid", "doc_id", "row", "n_shingles", "set_id", "keys", "share"],
            )

    return run


def _bands(percent: int):
    """Rows (key, n, set_id) sorted by all three -> (center, set_id) of each band of several sets."""

    def run(batches):
        held: list[np.ndarray] = []  # the band that goes on: its center, its last row
        for batch in batches:
            key, size, ids = (batch.column(k).to_numpy() for k in ("key", "n", "set_id"))
            if not len(key):
                continue
            if held:  # one row stands for the band so far
                key, size, ids = (np.append(h, x) for h, x in zip(held[:3], (key, size, ids), strict=True))
            fresh = np.append(True, (key[1:] != key[:-1]) | (size[1:] * percent > 100 * size[:-1]))
            start = np.flatnonzero(fresh)
            center = ids[np.repeat(start, np.diff(np.append(start, len(key))))]
            if held:
                center[: start[1] if len(start) > 1 else len(center)] = held[3]
            again = np.append(False, (ids[1:] == ids[:-1]) & ~fresh[1:])
            out = (center != ids) & ~again
            if held:
                out[0] = False
            first = np.unique(center[out])
            held = [key[-1:], size[-1:], ids[-1:], center[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(center[out], first)), pa.array(np.append(ids[out], first))], ["center", "set_id"])

    return run


def _wanted(bits: np.ndarray):
    """Keeps rows whose bit is set: all that are wanted, and some others."""

    def run(batches):
        for batch in batches:
            at = batch.column("bit").to_numpy().astype(np.int64)
            on = (bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(on == 1))

    return run


def only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """A superset of the rows of texts whose rid is in wanted, by a bit for each hash value: 2**26 bits (8 MB) at most."""
    power = max(16, min(26, (10 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("rid"), F.lit(1 << power))
    bits = np.zeros(1 << (power - 6), np.int64)
    for r in wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("on")).toLocalIterator():
        bits[r["word"]] = r["on"]
    shared = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    return texts.withColumn("bit", bit).mapInArrow(_wanted(shared), "rid long, text string, bit long").select("rid", "text")


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A row of ``width`` bits (a power of two, 64 at least) for each set: bit ``hash mod width`` of each shingle."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = np.concatenate(sets) & np.uint64(width - 1)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def commons(a: np.ndarray, others: list[np.ndarray], most: int = 1 << 18) -> np.ndarray:
    """Sizes of the intersections of a sorted array of distinct values with others, worked on in pieces of about ``most`` values."""
    ends = np.cumsum([0, *map(len, others)])
    out = np.zeros(len(others), np.int64)
    at = 0
    while len(a) and at < len(others):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        flat = np.concatenate(others[at:to])
        hits = np.append(0, np.cumsum(a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat))
        out[at:to] = hits[ends[at + 1 : to + 1] - ends[at]] - hits[ends[at:to] - ends[at]]
        at = to
    return out


def may_link(sizes: list[int], shares: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Whether each set may link with another of the tile (given sides: of the other side), by what shares of the sets allow."""
    order = np.argsort(sizes, kind="stable")
    size, shares = np.array(sizes, np.int64)[order], [shares[i] for i in order]
    side = None if side is None else side[order]
    part = np.array([len(s) for s in shares], np.int64)
    out = np.zeros(len(size), bool)
    for at in range(0, len(size), 128):
        to = min(len(size), at + 128)
        end = int(np.searchsorted(size, size[to - 1] * 100 // percent, side="right"))
        maps = bitmaps(shares[at:end], 1 << max(6, min(15, int(8 * part[at:end].max() + 1).bit_length())))
        bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        for i in range(at, to):
            k, stop = i - at, int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
            if stop <= i + 1:
                continue
            j, m = slice(i + 1, stop), slice(k + 1, stop - at)
            most = np.bitwise_count(maps[k] & maps[m]).sum(axis=1, dtype=np.int64) + np.minimum(part[i] - bits[k], part[j] - bits[m])
            most += np.minimum(size[i] - part[i], size[j] - part[j])
            may = (100 + percent) * most >= percent * (size[i] + size[j])
            if side is not None:
                may &= side[j] != side[i]
            out[j] |= may
            out[i] |= may.any()
    back = np.empty(len(out), bool)
    back[order] = out
    return back


def tile_counts(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, copies: np.ndarray | None = None, earlier: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of the links among sets: a spanning forest, as index pairs, and for each set the copies of those it links with.

    side: given, only pairs of two blocks count; those within a block are met elsewhere. earlier: other tiles of each set; a pair with one in common counts there.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sets = size[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    copies = np.ones(len(sets), np.int64) if copies is None else copies[order]
    earlier = None if earlier is None else [earlier[i] for i in order]
    label, out, links = np.arange(len(sets)), [], np.zeros(len(sets), np.int64)
    step = 128
    for at in range(0, len(sets), step):
        to = min(len(sets), at + step)
        end = int(np.searchsorted(size, size[to - 1] * 100 // percent, side="right"))  # the band of sizes that can link
        width = 1 << max(6, min(15, int(8 * size[end - 1] - 1).bit_length()))
        maps = bitmaps(sets[at:end], width)
        bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        for i in range(at, to):
            k = i - at
            stop = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
            if stop <= i + 1:
                continue
            both = np.bitwise_count(maps[k] & maps[k + 1 : stop - at]).sum(axis=1, dtype=np.int64)
            most = both + np.minimum(size[i] - bits[k], size[i + 1 : stop] - bits[k + 1 : stop - at])
            may = (100 + percent) * most >= percent * (size[i] + size[i + 1 : stop])
            if side is not None:
                may &= side[i + 1 : stop] != side[i]
            found = np.flatnonzero(may) + i + 1
            if earlier is not None and len(earlier[i]):
                found = found[commons(earlier[i], [earlier[j] for j in found]) == 0]
            found = found[(100 + percent) * commons(sets[i], [sets[j] for j in found]) >= percent * (size[i] + size[found])]
            links[i] += copies[found].sum()
            links[found] += copies[i]
            other = found[label[found] != label[i]]
            near, first = np.unique(label[other], return_index=True)
            out += [(int(order[i]), int(order[j])) for j in other[first]]
            label[np.isin(label, near)] = label[i]
    back = np.empty(len(links), np.int64)
    back[order] = links
    return out, back


def tile_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, as index pairs; see tile_counts."""
    return tile_counts(sets, percent, side)[0]


def _by_tile(batches, value):
    """Rows sorted by tile (center, x, y) and set -> (tile, sets' ids, blocks, value(row number, part) of each), one bounded tile at a time."""
    tile, ids, blocks, values = None, [], [], []
    for part, get in batches:
        heads = zip(*(part.column(c).to_pylist() for c in ("center", "x", "y")), strict=True)
        for k, (head, i, block) in enumerate(zip(heads, part.column("set_id").to_pylist(), part.column("block").to_pylist(), strict=True)):
            if head != tile:
                if len(ids) > 1:
                    yield tile, ids, blocks, values
                tile, ids, blocks, values = head, [], [], []
            if (not ids or ids[-1] != i) and (x := value(get, k, i)) is not None:
                ids.append(i)
                blocks.append(block)
                values.append(x)
    if len(ids) > 1:
        yield tile, ids, blocks, values


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _prune(percent: int):
    """(center, set_id) of sets that may link within a tile."""

    def value(part, k, _):
        return part.column("n")[k].as_py(), np.frombuffer(part.column("share")[k].as_py(), "<u4").astype(np.uint64)

    def run(batches):
        for tile, ids, blocks, values in _by_tile(((b, b) for b in batches), value):
            stays = may_link([v[0] for v in values], [v[1] for v in values], percent, np.array(blocks) if tile[1] != tile[2] else None)
            yield _columns([(tile[0], i) for i, x in zip(ids, stays, strict=True) if x], ["center", "set_id"])

    return run


def _tiles(n: int, percent: int):
    """(a, b, n_links): a spanning forest of verified links within tiles, without n_links; without b, the rows that a set links with in a tile."""

    def value(got, k, i):  # a rid may have other texts too
        part, arrays = got
        if not len(arrays[k]) or set_hash(arrays[k]) != i:
            return None
        return arrays[k], part.column("copies")[k].as_py(), np.array(part.column("earlier")[k].as_py(), np.int64)

    def run(batches):
        for tile, ids, blocks, values in _by_tile(((part, (part, sets)) for part, sets in _sets(batches, n)), value):
            sets, copies, earlier = zip(*values, strict=True)
            forest, links = tile_counts(list(sets), percent, np.array(blocks) if tile[1] != tile[2] else None, np.array(copies, np.int64), list(earlier))
            yield _columns([(ids[i], ids[j], None) for i, j in forest] + [(i, None, int(x)) for i, x in zip(ids, links, strict=True) if x], ["a", "b", "n_links"])

    return run


def _placed(members: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """members (center, set_id, n, ...) -> with block, x, y: tiles of bounded size, in which any two members of a center meet."""
    cuts = members.groupBy("center").agg(F.count("*").alias("rows"), F.sum("n").alias("all")).where("rows > 1")
    cuts = cuts.select("center", F.greatest(F.ceil(F.col("rows") / tile_rows), F.ceil(F.col("all") / tile_shingles)).cast("int").alias("cut"))
    out = members.join(cuts, "center").withColumn("block", F.pmod(F.xxhash64("set_id", "center"), F.col("cut")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return out.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("cut", "other")


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("center", "x", "y").sortWithinPartitions("center", "x", "y", "set_id")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, tile_rows: int = 1500, tile_shingles: int = 4_000_000) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, set_id, component_id, n_links, class_id, row), one row for each row of docs.

    A text's set holds its distinct n-word shingles; with fewer words, the whole sequence as one. Two texts
    link when ``100 * common >= percent * union``; component_id is the least doc_id that links reach, n_links the
    number of other rows that the row links with, copies too; class_id: the least set_id that links reach; row: see row_hash. Null or wordless text: an empty set (n_shingles 0, set_id and class_id null), linked with nothing, component_id its own doc_id. Null doc_id:
    takes part, and is never the least of others (null if all of a component are). Repeated rows each get a
    row. Other columns are ignored; an empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    prepare(spark)
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(doc_id, F.xxhash64("text")).alias("rid"), doc_id.alias("doc_id"), row_hash(docs).alias("row"), "text")
    freq = spark.sparkContext.broadcast(frequencies(texts, n))
    rows = stage(texts.mapInArrow(_keys(n, percent, freq), "rid long, doc_id long, row long, n_shingles long, set_id long, keys array<long>, share binary"), "keys")
    full = rows.where("set_id is not null")
    keys = full.select(F.explode("keys").alias("key"), F.col("n_shingles").alias("n"), "set_id").repartition("key").sortWithinPartitions("key", "n", "set_id")
    members = stage(keys.mapInArrow(_bands(percent), "center long, set_id long").distinct(), "members")

    one = full.groupBy("set_id").agg(F.min("rid").alias("rid"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    shares = full.where("share is not null").groupBy("set_id").agg(F.max("n_shingles").alias("n"), F.first("share").alias("share"))
    trial = _dealt(_placed(members.join(shares, "set_id"), tile_rows, tile_shingles)).select("center", "x", "y", "block", "set_id", "n", "share")
    stays = stage(trial.mapInArrow(_prune(percent), "center long, set_id long").distinct(), "stays")
    own = stays.groupBy("set_id").agg(F.array_sort(F.collect_list("center")).alias("centers")).join(one, "set_id")
    staying = stage(stays.join(own, "set_id").withColumn("earlier", F.expr("filter(centers, c -> c < center)")).drop("centers"), "staying")
    held = only(texts.select("rid", "text"), staying.select("rid").distinct())
    tiles = _dealt(_placed(staying, tile_rows, tile_shingles).join(held, "rid").select("center", "x", "y", "block", "set_id", "copies", "earlier", "text"))
    links = stage(tiles.mapInArrow(_tiles(n, percent), "a long, b long, n_links long"), "links")

    roots = components(links.where("b is not null").select("a", "b"))
    linked = links.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n_links").alias("n_links"))
    least = full.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    joined = least.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id")
    shared = joined.select("set_id", "root").join(joined.groupBy("root").agg(F.min("least").alias("of_all")), "root").select("set_id", "root", "of_all")
    known = least.join(shared, "set_id", "left").join(linked, "set_id", "left")
    known = known.select("set_id", "copies", F.coalesce("of_all", "least").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "set_id").alias("class_id"))
    known = stage(known, "classes")
    # sets of over HOT of the rows are at most 1 / HOT: their rows find them in a broadcast; rows without a set need none
    hot = known.where(F.col("copies") > F.lit(HOT * full.count())).drop("copies")
    narrow = rows.select("doc_id", "row", "n_shingles", "set_id")
    some = narrow.where("set_id is not null")
    often = some.join(F.broadcast(hot), "set_id")
    rarely = some.join(F.broadcast(hot.select("set_id")), "set_id", "left_anti").join(known.drop("copies"), "set_id")
    none = narrow.where("set_id is null").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "class_id": F.lit(None).cast("long")})
    order = ["doc_id", "n_shingles", "set_id", "component_id", "n_links", "class_id", "row"]
    return often.select(order).unionByName(rarely.select(order)).unionByName(none.select(order))


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())
