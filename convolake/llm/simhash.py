"""SimHash near-dedup by bit-sliced comparison.

Fingerprints come from word shingles. Distinct fingerprints meet in buckets that agree on
two of four 16-bit blocks (with at most two differing bits two blocks always agree), and a
bucket compares its members bit-sliced: bit planes lie vertically, one word holds one bit of
64 distances, carry-save counters add the planes, and blocks of words leave the loop once
all their distances exceed the radius.

Defined results: a null or blank text has fingerprint zero, linked like any other; repeated
rows come back as often as given; a null id gets its group's component (null where the group
has no id); columns besides id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, components, cut, drop, in_table, slices

#: Rows of one comparison tile; larger buckets are cut into tiles of two chunks.
TILE = 2048


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles: a bit is 1 if set in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest, pairs = xxhash.xxh64_intdigest, zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
    return _majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long, fingerprint 16 hex digits), one row per document."""
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            signed = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([b.column("id"), signed, pa.array([f"{x:016x}" for x in fps])], names=["id", "fp", "fingerprint"])

    return frame.mapInArrow(run, "id long, fp long, fingerprint string")


def beyond(plane, words: int, radius: int, n_planes: int = 64) -> np.ndarray:
    """Bit masks (uint64 words) of the distances above radius; plane(b, active) gives difference plane b.

    Carry-save counters of as many bits as radius + 1 needs, with a sticky overflow word; every
    eight planes the words whose 64 distances all exceed the radius are abandoned.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(words, full)
    active = np.arange(words)
    bits = (radius + 1).bit_length()
    count = np.zeros((bits, words), dtype=np.uint64)
    over = np.zeros(words, dtype=np.uint64)
    for b in range(n_planes):
        carry = plane(b, active)
        for k in range(bits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7:
            greater, equal = over.copy(), np.full(len(active), full)
            for k in reversed(range(bits)):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    greater |= equal & count[k]
                    equal &= ~count[k]
            live = greater != full
            out[active] = greater
            if b < n_planes - 1 and not live.all():
                active, count, over = active[live], count[:, live], over[live]
                if not len(active):
                    break
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of rows of uint64 words, least first: one column a bit."""
    words = np.ascontiguousarray(values, dtype="<u8").reshape(len(values), -1)
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints, each packed to ceil(n / 64) words."""
    bits = _bits(values)
    padded = np.zeros((-(-len(bits) // 64) * 64, bits.shape[1]), dtype=np.uint8)
    padded[: len(bits)] = bits
    packed = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little"))
    return packed.view("<u8").reshape(bits.shape[1], -1)


def _hits(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits((~mask).view(np.uint8), bitorder="little")[:n])


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Indices i at which left[i] and right[i] differ in at most radius bits."""
    if not len(left):
        return np.zeros(0, dtype=np.int64)
    planes = _planes(left ^ right)
    return _hits(beyond(lambda b, a: planes[b][a], planes.shape[1], radius, len(planes)), len(left))


def near_rows(queries: np.ndarray, planes: np.ndarray, n: int, radius: int):
    """(query, row) pairs within radius, the rows given as bit planes."""
    words = planes.shape[1]
    flip = np.where(_bits(queries).T == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    mask = beyond(lambda b, a: planes[b][a % words] ^ flip[b][a // words], words * len(queries), radius, len(planes))
    q, r = np.nonzero(np.unpackbits((~mask).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n])
    return q, r


def local_forest(n: int, pairs: list) -> np.ndarray:
    """For each of n members the smallest member linked to it through pairs [(a, b) arrays]."""
    label = np.arange(n)
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else a
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _tile_pairs(fp: np.ndarray, bounds: np.ndarray, radius: int):
    """Arrays (a, b) of the rows within radius inside each run bounds[i]:bounds[i + 1], block by block."""
    sizes = np.diff(bounds)
    small = sizes <= 64
    # small buckets: their pairs side by side in one sliced comparison
    for d in range(1, int(sizes[small].max(initial=1))):
        some = small & (sizes > d)
        first = np.concatenate([np.arange(s, e - d) for s, e in zip(bounds[:-1][some], bounds[1:][some])] or [np.zeros(0, dtype=np.int64)])
        for i in range(0, len(first), 1 << 16):
            part = first[i : i + (1 << 16)]
            hit = part[near_pairs(fp[part], fp[part + d], radius)]
            yield hit, hit + d
    for s, e in zip(bounds[:-1][~small], bounds[1:][~small]):
        part, planes = fp[s:e], _planes(fp[s:e])
        for i in range(0, e - s, 256):
            q, r = near_rows(part[i : i + 256], planes, e - s, radius)
            keep = r < q + i
            yield q[keep] + i + s, r[keep] + s


def _spanning(n: int, pairs) -> np.ndarray:
    """local_forest of pairs that come block by block, with at most some millions held."""
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p[0])
        if size > 1 << 21:
            held, size = [(np.arange(n), local_forest(n, held))], n
    return local_forest(n, held)


def _tile_edges(fp: np.ndarray, rep: np.ndarray, bounds: np.ndarray, radius: int):
    """Spanning edges of the links inside each run of rows bounds[i]:bounds[i + 1]."""
    label = _spanning(len(fp), _tile_pairs(fp, bounds, radius))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return rep[own], rep[label[own]]


def runs(batches, columns: list[str], key: list[str], at_least: int = 1 << 14):
    """Numpy columns of sorted Arrow batches, cut only between different keys, with the run bounds."""
    held, rows, step = [], 0, at_least

    def cols(table):
        return {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns}

    def bounds(c):
        change = np.zeros(len(c[key[0]]) - 1, dtype=bool)
        for k in key:
            change |= c[k][1:] != c[k][:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1, [len(c[key[0]])]))

    for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
        held.append(b)
        rows += b.num_rows
        if rows >= at_least:
            table = pa.Table.from_batches(held)
            c = cols(table)
            at = bounds(c)
            if len(at) > 2:
                yield {k: x[: at[-2]] for k, x in c.items()}, at[:-1]
                rest = table.slice(int(at[-2])).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
            else:
                at_least = rows * 2
    if rows:
        c = cols(pa.Table.from_batches(held))
        yield c, bounds(c)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between representatives of distinct fingerprints (fp, rep) within radius (2 or less).

    Every pair within the radius agrees on two of four blocks, so it meets in one of six buckets.
    Buckets over TILE rows are cut by a hash of the fingerprint; each two chunks meet in a tile,
    so no bucket is gathered whole and no pair is lost. A tile gives a spanning forest, not pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find distances up to 2")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(4), 2))]
    rows = distinct.where("rep is not null").select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    # written first: a join over the aggregation's own exchange could not be split where one key is common
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
    rows = rows.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "rep")
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches):
        for c, at in runs(batches, ["key", "i", "j", "fp", "rep"], ["key", "i", "j"]):
            u, v = _tile_edges(c["fp"].view(np.uint64), c["rep"], at, radius)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: id, fingerprint, component_id (smallest id reachable over links)."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(distinct, radius))
    where = distinct.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(where, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), "fingerprint", "component_id")


# Documents that share most of their word shingles: common rare shingles find the pairs, the shingle sets decide.

#: Least bits of a parity bitmap, and most of one that travels; bits for each shingle where sets are compared.
LEAST_BITS, MOST_BITS, FINE = 512, 1 << 18, 8
#: Shingles of a chunk of a family.
SHINGLES = 1 << 22
#: Documents whose shingles are counted for the order of shingles, and shingles of which the count is kept.
#: Any order gives the same pairs; with common shingles last fewer documents meet.
SAMPLE, COMMON = 4096, 1 << 17


def _shingles(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _hashes(shingles: set[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)


def _width(n: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> int:
    """Bits of the bitmap of n shingles: a power of two."""
    return min(most, max(least, 1 << max(n - 1, 1).bit_length()))


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Words of a bitmap, each bit the parity of the hashes that fall on it: sets that differ in n shingles differ in at most n bits.

    A bitmap of half the bits is the halves of this one, added without carry.
    """
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(words: np.ndarray, count: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, count), axis=0)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most common shingles of some SAMPLE texts."""
    share = min(1.0, SAMPLE / max(1, texts.count()))

    def run(batches):
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                yield pa.record_batch([pa.array(_hashes(_shingles(t, shingle)).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    top = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(hashes: np.ndarray, common: tuple, similarity: float) -> np.ndarray:
    """The rarest of a document's shingles, so many that it shares one of them with each document of the similarity."""
    n = len(hashes)
    if not n:
        return hashes
    known, counts = common
    rank = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n - math.ceil(similarity * n - 1e-6) + 1]]


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, size, rep) of rows (rep, keys): each key that another document has as well; size of them have it.

    Keys are counted first; those of one document alone, nearly all of them, then stay behind where a bit table of the
    others lacks them. Of keys that just the same documents have one is enough: a digest of 128 bits of its
    documents tells them.
    """
    counted = keyed.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    table = keyed.sparkSession.sparkContext.broadcast(bit_table(counted.where("n > 1")))

    def repeated(batches):
        for b in batches:
            keys = b.column("keys")
            rep = np.repeat(b.column("rep").to_numpy(), keys.value_lengths().to_numpy())
            flat = keys.flatten().to_numpy()
            some = in_table(table.value, flat)
            yield pa.record_batch([pa.array(flat[some]), pa.array(rep[some])], names=["key", "rep"])

    found = cut(keyed.select("rep", "keys").mapInArrow(repeated, "key long, rep long"))
    who = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")]
    sets = found.groupBy("key").agg(F.count("*").alias("size"), *who).where("size > 1")
    # written first: a join over the aggregation's own exchange could not be split where one key is common
    sizes = cut(sets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"))
    out = cut(found.join(sizes, "key"))
    drop(found)
    drop(sizes)
    return out


def _may_be_similar(fp: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float):
    """Which pairs of rows can have the similarity by their sizes and parity bitmaps, and how many bits of a thousandth these differ in."""
    ham = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=-1, dtype=np.int64)
    both, low, high = n[a] + n[b], np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    may = (ham * (1 + similarity) <= both * (1 - similarity) + 1e-6) & (low + 1e-6 >= similarity * high)
    return may, ham * 1000 // np.maximum(both, 1)


def _run_pairs(fp: np.ndarray, n: np.ndarray, bounds: np.ndarray, similarity: float):
    """Arrays (a, b, d) of the rows inside each run bounds[i]:bounds[i + 1] that may be similar, block by block."""
    sizes, block = np.diff(bounds), max(256, (1 << 21) // fp.shape[1])
    small = sizes <= 64
    for d in range(1, int(sizes[small].max(initial=1))):
        some = small & (sizes > d)
        ends = np.cumsum(sizes[some] - d)
        first = np.repeat(bounds[:-1][some] - ends + sizes[some] - d, sizes[some] - d) + np.arange(ends[-1] if len(ends) else 0)
        for i in range(0, len(first), block):
            part = first[i : i + block]
            may, far = _may_be_similar(fp, n, part, part + d, similarity)
            yield part[may], part[may] + d, far[may]
    for s, e in zip(bounds[:-1][~small], bounds[1:][~small]):
        step = int(min(64, max(1, block * 4 // (e - s))))
        for i in range(s, e, step):
            a, b = np.arange(i, min(i + step, e))[:, None], np.arange(s, min(i + step, e))[None, :]
            may, far = _may_be_similar(fp, n, a, b, similarity)
            q, r = np.nonzero(may & (b < a))
            yield q + i, r + s, far[q, r]


def _candidates(maps: list[np.ndarray], n: np.ndarray, bounds: np.ndarray, similarity: float):
    """_run_pairs() of rows with bitmaps of several widths: pairs are compared at the smaller width of the two.

    Sizes of similar documents differ by less than a half, so their widths are the same or neighbours.
    """
    width, run = np.array([len(m) for m in maps]), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        fp = np.stack([_folded(maps[r], w) for r in rows])
        at = np.concatenate(([0], np.cumsum(np.bincount(run[rows], minlength=len(bounds) - 1))))
        for a, b, d in _run_pairs(fp, n[rows], at, similarity):
            own = (width[rows[a]] == w) | (width[rows[b]] == w)
            yield rows[a[own]], rows[b[own]], d[own]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a[i], b[i]), best ones first, join different labels without a circle."""
    n, chosen = len(label), [np.zeros(0, dtype=np.int64)]
    open_ = np.flatnonzero(label[a] != label[b])
    while len(open_):
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[open_]], open_)
        np.minimum.at(best, label[b[open_]], open_)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        label = local_forest(n, [(np.arange(n), label), (a[pick], b[pick])])
        open_ = open_[label[a[open_]] != label[b[open_]]]
    return np.concatenate(chosen)


def _spanning_pairs(rows: DataFrame, similarity: float, radius: int = 2) -> DataFrame:
    """(u, v) of rows (key, size, rep, n, bits, fp): pairs that may be similar, so many that with the links of fingerprints they span all that may be.

    Rows of a large run whose fingerprints are within the radius, which links() joins, count as joined here. A run of
    tiles gives no more pairs than members.
    """
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "n", "bits", "fp")
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for c, at in runs(batches, ["key", "i", "j", "rep", "n", "bits", "fp"], ["key", "i", "j"], 1 << 13):
            node, where = np.unique(c["rep"], return_inverse=True)
            run = np.repeat(np.arange(len(at) - 1), np.diff(at))
            # of small runs the sizes and bitmaps are compared as quickly; runs that fingerprints join whole need no other comparison
            large = np.flatnonzero((np.diff(at) > 64)[run])
            ends = np.concatenate(([0], np.flatnonzero(np.diff(run[large])) + 1, [len(large)] if len(large) else []))
            near = _spanning(len(node), ((where[large[a]], where[large[b]]) for a, b in _tile_pairs(c["fp"][large].view(np.uint64), ends.astype(np.int64), radius)))
            group = near[where]
            rows = np.flatnonzero((np.minimum.reduceat(group, at[:-1]) < np.maximum.reduceat(group, at[:-1]))[run])
            part, n = where[rows], c["n"][rows]
            at = np.concatenate(([0], np.cumsum(np.bincount(run[rows], minlength=len(at) - 1))))
            held, size = [], 0

            def spanned():
                a, b, d = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*held) if held else ([], [], [])))
                order = np.argsort(d, kind="stable")
                keep = order[_forest(near, a[order], b[order])]
                return a[keep], b[keep], d[keep]

            for a, b, d in _candidates([np.frombuffer(x, "<u8") for x in c["bits"][rows]], n, at, similarity):
                held.append((part[a], part[b], d))
                size += len(a)
                if size > 1 << 20:
                    held = [spanned()]
                    size = len(held[0][0])
            a, b, _ = spanned()
            yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long").where("u <> v")


def _similar_in(sets: list[np.ndarray], bounds: np.ndarray, similarity: float):
    """Links (a, b) that span the rows of each run whose shingle sets (sorted hashes) have the similarity.

    Pairs come by the distance of their bitmaps, which are so wide here that few others than similar ones pass; a
    pair whose rows are linked already isn't looked at.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    maps = [_parity(s, _width(FINE * len(s), most=1 << 30)) for s in sets]
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found, held, size = [], [], 0

    def apart(a, b):
        label = root.copy()
        while (label != label[label]).any():
            label = label[label]
        return np.flatnonzero(label[a] != label[b])

    def decide():
        a, b, d = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*held) if held else ([], [], [])))
        for i in np.argsort(d, kind="stable").tolist():
            x, y = find(a[i]), find(b[i])
            if x != y:
                left, right = sets[a[i]], sets[b[i]]
                shared = len(left) + len(right) - len(np.union1d(left, right))
                if shared >= similarity * (len(left) + len(right) - shared):
                    root[max(x, y)] = min(x, y)
                    found.append((a[i], b[i]))

    for a, b, d in _candidates(maps, n, bounds, similarity):
        some = apart(a, b)
        held.append((a[some], b[some], d[some]))
        size += len(some)
        if size > 1 << 20:
            decide()
            held, size = [], 0
    decide()
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of rows (comp, chunks, rep, hashes): links that span the similar documents of each comp, every pair of which is considered."""
    chunks = F.col("chunks")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = rows.select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "hashes")
    tiles = tiles.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def run(batches):
        for c, at in runs(batches, ["comp", "i", "j", "rep", "hashes"], ["comp", "i", "j"], 256):
            links = _similar_in([np.frombuffer(x, "<u8") for x in c["hashes"]], at, similarity)
            yield pa.record_batch([pa.array(c["rep"][links[:, 0]]), pa.array(c["rep"][links[:, 1]])], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per document: id, component_id (smallest id reachable over pairs of at least the similarity), th, stands, times.

    th is the MD5 of the text; stands marks the rows that stand for their group (of its smallest id, the
    smallest th); times is the number of rows that share id and text.

    Copies (equal words) are one document. Distinct ones are linked by their SimHash fingerprints first, as near_dedup()
    links them (links(), bit-sliced). For what these miss, documents meet where they share one of their rarest
    shingles (of n all but ceil(similarity * n) - 1, which pairs of the similarity always do). Sizes and parity
    bitmaps leave out pairs that cannot be similar; what is left falls with the
    fingerprints' links into families, given by spanning pairs, and no
    similar pair lies across two of them. Only a family's documents are read again: their shingle sets meet in the
    tiles of the family, where the closest pairs are decided first, by their sets, and a pair whose documents are
    linked already needs no decision. No pair is lost and none is written but links.
    """
    text = F.col(text_col).cast("string")
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text).alias("th"), text.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(frame, shingle))

    def marked(batches):
        for b in slices(batches):
            digests, maps, sizes, keys, fps = [], [], [], [], []
            for t in b.column("text").to_pylist():
                digests.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())))
                h = _hashes(_shingles(t, shingle))
                maps.append(_parity(h, _width(len(h))).tobytes())
                sizes.append(len(h))
                keys.append(_prefix(h, common.value, similarity).view(np.int64))
                fps.append(_majority(h))
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([b.column("id"), b.column("th"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), fps], names=["id", "th", "copy", "n", "bits", "keys", "fp"])

    wide = cut(frame.mapInArrow(marked, "id long, th string, copy binary, n long, bits binary, keys array<long>, fp long"))
    keyed = cut(wide.groupBy("copy").agg(F.min("id").alias("rep"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th"))).alias("one"), *[F.any_value(c).alias(c) for c in ("n", "bits", "keys", "fp")]))
    # the prefixes are the largest part of both tables
    rows = cut(wide.select("id", "th", "copy"))
    drop(wide)
    # ids of several texts: all but one of the texts are nodes by their digest
    own = cut(keyed.groupBy(F.col("rep").alias("_rep")).agg(F.min("copy").alias("_copy"), F.count("*").alias("texts")).where("texts > 1"), F.count("*").alias("n"))
    named = keyed
    if own.saw["n"]:
        node = F.when(F.col("_rep").isNotNull() & (F.col("copy") != F.col("_copy")), F.xxhash64("copy")).otherwise(F.col("rep"))
        named = keyed.join(own, F.col("rep") == F.col("_rep"), "left").withColumn("rep", node).drop("_rep", "_copy", "texts")
    distinct = cut(named.select("copy", "rep", "one", "n", "bits", "fp"))
    prints = cut(distinct.where("rep is not null").groupBy("fp").agg(F.min("rep").alias("rep"), F.count("*").alias("texts")))
    equal = distinct.select("fp", F.col("rep").alias("u")).join(prints.where("texts > 1").select("fp", F.col("rep").alias("v")), "fp").where("u <> v").select("u", "v")
    near = cut(links(prints).unionByName(equal))
    drop(prints)
    met = _shared(named.where("rep is not null").select("rep", "keys"))
    drop(keyed)
    pairs = cut(_spanning_pairs(met.join(distinct.where("rep is not null").select("rep", "n", "bits", "fp"), "rep"), similarity).unionByName(near))
    drop(met)
    drop(near)
    family = cut(components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("comp")))
    drop(pairs)
    times = cut(rows.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("times")).where("times > 1"), F.count("*").alias("n"))
    stood = distinct.where("rep is not null").select("rep", "n", F.col("one.id").alias("_id"), F.col("one.th").alias("_th"))
    family_of = cut(stood.join(family, "rep").join(times.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "times"), (F.col("_id") == F.col("_i")) & F.col("_th").eqNullSafe(F.col("_t")), "left"))
    # written first, for the same reason as the sizes of keys
    sizes = cut(family_of.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("chunks")))
    members = cut(family_of.join(sizes, "comp").select("rep", "comp", "chunks", "_id", "_th", F.col("times").isNotNull().alias("repeated")))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(members.select(F.xxhash64("_id", "_th").alias("h"))))

    def hashed(batches):
        for b in slices(batches):
            b = b.filter(pa.array(in_table(table.value, b.column("h").to_numpy())))
            sets = [np.sort(_hashes(_shingles(t, shingle))).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("id"), b.column("th"), pa.array(sets, pa.binary())], names=["id", "th", "hashes"])

    # only families' documents leave the scan, and as hashes
    sets = frame.where("id is not null").select(F.xxhash64("id", "th").alias("h"), "id", "th", "text").mapInArrow(hashed, "id long, th string, hashes binary")
    same = (F.col("id") == F.col("_id")) & F.col("th").eqNullSafe(F.col("_th"))
    of = lambda some: sets.join(members.where(some), same).select("comp", "chunks", "rep", "hashes")
    sets = of("not repeated").unionByName(of("repeated").dropDuplicates(["rep"])) if times.saw["n"] else of("not repeated")
    found = cut(_linked(sets, similarity).where("u <> v"))
    comp = cut(components(found))
    where = distinct.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("copy").alias("_copy"), F.coalesce("component", "rep").alias("_comp"), "one")
    first = where.groupBy("_comp").agg(F.min("one").alias("first"))
    where = cut(where.join(first.withColumnRenamed("_comp", "_c"), F.col("_comp") == F.col("_c"), "left").select("_copy", "first"))
    for table in (own, family, family_of, sizes, members, found, comp, distinct):
        drop(table)
    out = rows.join(where, F.col("copy") == F.col("_copy")).join(times, F.col("id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left")
    stands = F.coalesce((F.col("id") == F.col("first.id")) & F.col("th").eqNullSafe(F.col("first.th")), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"), "th", stands.alias("stands"), F.coalesce("times", F.lit(1)).alias("times"))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that stand for their group, rows alike in id and text once. Rows without id stay: nothing names them."""
    names = ["_id_of_group", "_th_of_group"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    i, h = names
    same = (F.col(id_col).cast("long") == F.col(i)) & F.md5(F.col(text_col).cast("string")).eqNullSafe(F.col(h))
    stand = cut(groups.where("stands").select(F.col(id_col).alias(i), F.col("th").alias(h), (F.col("times") == 1).alias("single")).distinct())
    once = docs.join(stand.where("single"), same, "left_semi")
    more = docs.join(stand.where("not single"), same, "left_semi").dropDuplicates([id_col])
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))
