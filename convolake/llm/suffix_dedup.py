"""Removal of long repeated byte strings by common-prefix interval trees of suffix arrays.

A string of SPAN bytes belongs to its anchor: the last of the least GRAM-byte hashes in it. Equal
strings have equal anchors at equal places, so each occurrence meets its copies in the group of
their anchor's hash, and nowhere else. An anchor's segment is the run of all strings that belong to it.

* Segments that are alike as a whole are repeats; they are settled by counting.
* Groups with different segments are compared by an enhanced suffix array of one copy of each: its
  longest-common-prefix intervals are scanned with a stack, intervals whose occurrences differ in
  the byte before them (or reach their segment's start) are maximal repeats, and all their
  occurrences are covered.
* Groups of more than GROUP different segments are never gathered: their strings are counted
  one by one by digest, which is exact as well.

Passages of PASSAGE words or more that another document shares may be shorter than SPAN; they are only
counted, by windows of words: windows meet at the least of their word GRAMS, runs of windows that are
alike as a whole are shared, of others each window is compared.

Defined results: null texts are empty; texts under SPAN bytes lose nothing; texts are taken whole;
rows alike in id and text are documents of their own and repeat each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .simhash import runs
from .vocab import chunks_of
from .winnow import Words

SPAN, GRAM, GROUP = 400, 64, 4096
#: Words of a shared passage ("over 50"), and of the grams at which its windows meet.
PASSAGE, GRAMS = 51, 8
#: Segments compared at once, where their groups are smaller.
ROWS = 2048
#: A longer text is anchored in pieces of so many strings each.
PIECE = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
_VALUE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_M = 0x9E3779B97F4A7C15
_tables: dict = {}


def _powers(n: int):
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["up"][:n], _tables["down"][:n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[:-1], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(pieces: list[bytes]):
    """Anchors of all strings of SPAN bytes in pieces: (piece, hash, place, first and last string), as arrays, and the bytes."""
    raw = b"".join(pieces)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.cumsum(size) - size
    if len(raw) < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, raw
    data = np.frombuffer(raw, dtype=np.uint8)
    h = _gram_hashes(data)
    low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width, done = SPAN - GRAM + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[: len(data) - SPAN + 1], low[width - done : width - done + len(data) - SPAN + 1])
    piece = np.repeat(np.arange(len(pieces)), np.maximum(size - SPAN + 1, 0))
    start = np.concatenate([np.arange(f, f + s - SPAN + 1) for f, s in zip(first, size) if s >= SPAN] or [np.zeros(0, dtype=np.int64)])
    place = (_PLACE - (low[start] & _PLACE)).astype(np.int64)
    change = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])))) if len(start) else np.zeros(0, dtype=np.int64)
    last = np.append(change[1:] - 1, len(start) - 1) if len(change) else change
    p = place[change]
    return piece[change], h[p].view(np.int64), p, start[change], start[last], raw


def suffix_ranks(data: np.ndarray, most: int):
    """(length, ranks of all suffixes by their first `length` bytes) for 8, 24, 72, ... bytes, up to at least most (zeros follow the end)."""
    n = len(data)
    word = np.zeros(n + 8, dtype=np.uint64)
    word[:n] = data
    for shift in (1, 2, 4):
        word = (word << np.uint64(8 * shift)) | np.append(word[shift:], np.zeros(shift, dtype=np.uint64))
    rank = np.unique(word[:n], return_inverse=True)[1].astype(np.int64)
    out, length = [(8, rank)], 8
    times = 3 if (n + 1) ** 3 < 1 << 63 else 2  # so many ranks make one number
    while length < most:
        key = rank
        for k in range(1, times):
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - k * length, 0)] = rank[k * length :] + 1
            key = key * (n + 1) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        length *= times
        out.append((length, rank))
    return out


def common_prefixes(ranks: list, data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], up to most[i]."""
    out = np.zeros(len(a), dtype=np.int64)
    n = len(data)
    # one length fits fewer than three times into the next
    steps = [x for x in ranks[::-1] for _ in range(2)] + [(1, data)] * 7
    for length, rank in steps:
        at, bt = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        same = (rank[at] == rank[bt]) & (out < most)
        out += same * length
    return np.minimum(out, most)


def maximal_repeats(data: np.ndarray, starts: np.ndarray, room: np.ndarray, before: np.ndarray, span: int):
    """Maximal repeats of at least span bytes among the suffixes at starts.

    room[i]: bytes to the end of suffix i's text; before[i]: the byte before it, or a number of its own
    where its text begins. Returns the sorted suffixes (indices into starts) and intervals (first, last,
    length) in their order: all occurrences of a repeat are the suffixes first..last.
    """
    ranks = suffix_ranks(data, int(room.max(initial=0)))
    order = np.argsort(ranks[-1][1][starts], kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    lcp = common_prefixes(ranks, data, a, b, np.minimum(room[order[:-1]], room[order[1:]]))
    left = before[order]
    differs = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))  # diverse: differs between first and last
    firsts, lasts, sizes = [], [], []
    high = lcp >= span
    edge = np.flatnonzero(np.diff(np.concatenate(([False], high, [False])).view(np.int8)))
    run_starts, run_ends = edge[::2], edge[1::2]
    lone = run_ends - run_starts == 1  # two suffixes: their interval needs no stack
    firsts.append(run_starts[lone])
    lasts.append(run_starts[lone] + 1)
    sizes.append(lcp[run_starts[lone]])
    f, e, z = [], [], []
    for s, t in zip(run_starts[~lone].tolist(), run_ends[~lone].tolist()):
        stack = []  # (length, first suffix) of the open intervals, shortest below
        for i, length in enumerate(lcp[s:t].tolist() + [0], s):
            first = i
            while stack and stack[-1][0] > length:
                size, first = stack.pop()
                f.append(first)
                e.append(i)
                z.append(size)
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, first))
    firsts, lasts, sizes = (np.concatenate([*x, np.array(y, dtype=np.int64)]) for x, y in ((firsts, f), (lasts, e), (sizes, z)))
    diverse = differs[lasts] > differs[firsts]
    return order, firsts[diverse], lasts[diverse], sizes[diverse]


def covered(order: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each suffix the length of the longest repeat of which it is an occurrence, else 0."""
    out = np.zeros(len(order), dtype=np.int64)
    pairs = lasts == firsts + 1
    wide = np.flatnonzero(~pairs)
    for i in wide[np.argsort(sizes[wide], kind="stable")].tolist():  # shorter ones first: longer ones lie inside them
        out[order[firsts[i] : lasts[i] + 1]] = sizes[i]
    for at in (firsts[pairs], lasts[pairs]):
        np.maximum.at(out, order[at], sizes[pairs])
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist()))


def _anchor_rows(batches):
    """(id, th, h, seg, pos, lo, hi): an anchor, digest of its segment, its place, and its first and last string relative to it."""
    for b in slices(batches):
        ids, ths, texts = b.column("id"), b.column("th"), b.column("text").to_pylist()
        part, about, size = [], [], 0

        def rows(part, about):
            piece, h, p, first, last, raw = anchors([x for x in part])
            begin = np.cumsum([0] + [len(x) for x in part])
            seg = [xxhash.xxh3_128_digest(raw[s : t + SPAN], seed=q - s) for s, t, q in zip(first.tolist(), last.tolist(), p.tolist())]
            doc = np.array([d for d, _ in about], dtype=np.int64)[piece]
            pos = p - begin[piece] + np.array([o for _, o in about], dtype=np.int64)[piece]
            return pa.record_batch([ids.take(pa.array(doc)), ths.take(pa.array(doc)), pa.array(h), pa.array(seg, pa.binary()), pa.array(pos), pa.array((first - p).astype(np.int32)), pa.array((last - p).astype(np.int32))], names=["id", "th", "h", "seg", "pos", "lo", "hi"])

        for n, text in enumerate(texts):
            raw = (text or "").encode()
            for at in range(0, len(raw), PIECE):
                if len(x := raw[at : at + PIECE + SPAN - 1]) >= SPAN:
                    part.append(x)
                    about.append((n, at))
                    size += len(x)
                    if size > PIECE // 4:
                        yield rows(part, about)
                        part, about, size = [], [], 0
        if part:
            yield rows(part, about)


def _segments(batches):
    """Bytes of wanted segments (one row a document) as rows (h, seg, lo, hi, data)."""
    for b in slices(batches):
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            raw = (text or "").encode()
            data = [raw[w["pos"] + w["lo"] : w["pos"] + w["hi"] + SPAN] for w in wanted]
            cols = {"h": pa.int64(), "seg": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "n": pa.int64()}
            yield pa.record_batch([*[pa.array([w[c] for w in wanted], k) for c, k in cols.items()], pa.array(data, pa.binary())], names=[*cols, "data"])


def _compare(batches):
    """Covered ranges (relative to the anchor) of each segment, all groups of a run of rows in one suffix array."""
    for c, at in runs(batches, ["h", "seg", "lo", "data"], ["h"], ROWS):
        rows = len(c["h"])
        texts = c["data"].tolist()
        size = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(size + 1) - size - 1
        data = np.frombuffer(b"\xff".join(texts), dtype=np.uint8)  # no byte of UTF-8: a segment's end differs from what goes on
        many = size - SPAN + 1
        seg = np.repeat(np.arange(rows), many)
        place = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
        starts = begin[seg] + place
        room = size[seg] - place
        before = np.where(place > 0, data[np.maximum(starts - 1, 0)].astype(np.int64), 256 + np.arange(len(seg)))
        length = covered(*maximal_repeats(data, starts, room, before, SPAN))
        hit = np.flatnonzero(length)
        out = {"h": [], "seg": [], "start": [], "end": []}
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(seg[hit])) + 1, [len(hit)])) if len(hit) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            k = seg[hit[i]]
            for s, e in _merged(place[hit[i:j]], place[hit[i:j]] + length[hit[i:j]]):
                for name, x in (("h", c["h"][k]), ("seg", c["seg"][k]), ("start", s + c["lo"][k]), ("end", e + c["lo"][k])):
                    out[name].append(x)
        yield pa.record_batch([pa.array(out["h"], pa.int64()), pa.array(out["seg"], pa.binary()), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32())], names=list(out))


def _strings(batches):
    """Every string of a segment by its digest: the way of groups that are too large to gather."""
    for b in slices(batches):
        for r in b.to_pylist():
            d = r["data"]
            said = [xxhash.xxh3_128_digest(d[i : i + SPAN]) for i in range(len(d) - SPAN + 1)]
            n = len(said)
            yield pa.record_batch([pa.array([r["h"]] * n, pa.int64()), pa.array([r["seg"]] * n, pa.binary()), pa.array(np.arange(r["lo"], r["lo"] + n, dtype=np.int32)), pa.array(said, pa.binary())], names=["h", "seg", "start", "said"])


def _removed(batches):
    for b in slices(batches):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw = (text or "").encode()
            flat = np.array(spans or [], dtype=np.int64).reshape(-1, 2)
            gone, kept, at = _merged(flat[:, 0], flat[:, 1]), [], 0
            for s, e in gone:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            for name, x in (("n_bytes", len(raw)), ("n_removed", sum(e - s for s, e in gone)), ("n_spans", len(gone)), ("kept", b"".join(kept))):
                out[name].append(x)
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())
        yield pa.record_batch([b.column("id"), b.column("th"), *[pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], sha, pa.array(out["kept"], pa.binary())], names=["id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


class _Spaced(Words):
    """Words between white space, as they are written."""

    folded = np.arange(256, dtype=np.uint8)
    inside = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _window_runs(batches):
    """(th, h, seg, first, n): runs of n windows from word `first` on that meet at the gram h, and a hash of the run's words."""
    for b in slices(batches):
        done = 0
        for part in chunks_of(b.column("text").to_pylist(), 1 << 19):
            th = b.column("th").slice(done, len(part))
            done += len(part)
            words = _Spaced(part)
            place, whole, h = words.anchors(GRAMS, PASSAGE)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate(([True], (place[at][1:] != place[at][:-1]) | (words.text[at][1:] != words.text[at][:-1]))))
            first, last = at[new], at[np.append(new[1:] - 1, len(at) - 1)]
            up, down = _powers(len(words.hash) + 1)
            total = np.zeros(len(words.hash) + 1, dtype=np.uint64)
            np.cumsum(words.hash * up[:-1], out=total[1:])
            seg = (total[last + PASSAGE] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(_M) + (place[first] - first).astype(np.uint64)
            text = words.text[first]
            cols = [h[place[first]].view(np.int64), seg.view(np.int64), first - words.bound[text], last - first + 1]
            yield pa.record_batch([th.take(pa.array(text)), *map(pa.array, cols)], names=["th", "h", "seg", "first", "n"])


def _windows(batches):
    """(th, window, settled): hashes of the windows of wanted runs."""
    for b in slices(batches):
        done = 0
        for part in chunks_of(b.column("text").to_pylist(), 1 << 19):
            here = b.slice(done, len(part))
            done += len(part)
            words = _Spaced(part)
            h, _ = words.grams(PASSAGE)
            wanted = here.column("wanted")
            runs_ = wanted.flatten()
            first, n, settled = (runs_.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            text = np.repeat(np.arange(len(part)), wanted.value_lengths().to_numpy())
            begin = words.bound[text] + first
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            th = here.column("th").to_numpy()[text]
            yield pa.record_batch([pa.array(np.repeat(th, n)), pa.array(h[at].view(np.int64)), pa.array(np.repeat(settled, n).astype(bool))], names=["th", "window", "settled"])


def shared_windows(frame: DataFrame) -> DataFrame:
    """(th, n) for the texts of frame (th, text) that share windows of PASSAGE words with another document: how many windows do so."""
    texts = frame.where("text is not null").select("th", "text")
    copies = cut(texts.groupBy("th").agg(F.count("*").alias("times")).where("times > 1"))
    found = cut(texts.mapInArrow(_window_runs, "th long, h long, seg long, first long, n long"))
    kinds = found.groupBy("h", "seg").agg(F.min("th").alias("a"), F.max("th").alias("b"))
    gram = kinds.groupBy(F.col("h").alias("_h")).agg(F.min("a").alias("low"), F.max("b").alias("high"), F.bool_or(F.col("a") == F.col("b")).alias("mixed")).where("low <> high")
    # written first: a join over the aggregation's own exchange could not be split where one gram is common
    kinds = cut(kinds.join(gram, F.col("h") == F.col("_h")).select(F.col("h").alias("_h"), F.col("seg").alias("_seg"), (F.col("a") != F.col("b")).alias("settled"), F.when(F.col("mixed"), F.col("a")).alias("one")))
    met = cut(found.join(kinds, (F.col("h") == F.col("_h")) & (F.col("seg") == F.col("_seg"))).select("th", "first", "n", "settled", (F.col("settled") & (F.col("th") == F.col("one"))).alias("model")))
    # runs that no other document has as a whole, and one of each shared run that they may have windows of
    wanted = met.where("not settled or model").groupBy(F.col("th").alias("_th")).agg(F.collect_list(F.struct("first", "n", "settled")).alias("wanted"))
    single = cut(texts.join(wanted, F.col("th") == F.col("_th")).dropDuplicates(["th"]).select("th", "text", "wanted").mapInArrow(_windows, "th long, window long, settled boolean"))
    twice = cut(single.groupBy(F.col("window").alias("_window")).agg(F.min("th").alias("a"), F.max("th").alias("b"), F.bool_or("settled").alias("settled")).where("a <> b or settled").select("_window"))
    within = met.where("settled").select("th", "n").unionByName(single.where("not settled").join(twice, F.col("window") == F.col("_window"), "left_semi").select("th", F.lit(1).cast("long").alias("n")))
    # texts that occur more than once share all their windows
    whole = found.join(copies, "th").groupBy("th", "times").agg(F.sum("n").alias("n")).select("th", F.expr("n div times").alias("n"))
    return within.join(copies.select("th"), "th", "left_anti").groupBy("th").agg(F.sum("n").alias("n")).unionByName(whole)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, passages: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; if asked for the kept bytes, and n_shared.

    n_shared counts the windows of PASSAGE words that another document has as well.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a document is known by its id and a hash of its text; rows alike in both share their spans
    frame = frame.withColumn("th", F.xxhash64("text"))
    kind = frame.schema["id"].dataType.simpleString()
    found = cut(frame.mapInArrow(_anchor_rows, f"id {kind}, th long, h long, seg binary, pos long, lo int, hi int"))

    code = F.xxhash64("seg")
    groups = found.groupBy("h").agg(F.count("*").alias("n"), F.min(code).alias("a"), F.max(code).alias("b")).where("n > 1").select(F.col("h").alias("_h"), (F.col("a") == F.col("b")).alias("alike"))
    # written first: a join over the aggregation's own exchange could not be split where one hash is very common
    repeated = cut(found.join(cut(groups), F.col("h") == F.col("_h")).drop("_h"))
    whole = F.struct((F.col("pos") + F.col("lo")).alias("s"), (F.col("pos") + F.col("hi") + SPAN).alias("e"))
    alike = repeated.where("alike").select("id", "th", whole.alias("span"))

    mixed = repeated.where("not alike")
    kinds = mixed.groupBy("h", "seg").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "pos", "lo", "hi")).alias("one"))
    kinds = cut(kinds.select("h", "seg", "times", "one.*"))
    sizes = cut(kinds.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n")))
    one = kinds.join(sizes, F.col("h") == F.col("_h"))
    wanted = one.groupBy("id", "th").agg(F.collect_list(F.struct("h", "seg", "pos", "lo", "hi", "n")).alias("wanted"))
    texts = frame.join(wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "wanted"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).dropDuplicates(["id", "th"])
    segments = cut(texts.select("text", "wanted").mapInArrow(_segments, "h long, seg binary, lo int, hi int, n long, data binary"))

    usual = segments.where(F.col("n") <= GROUP).repartition("h").sortWithinPartitions("h").mapInArrow(_compare, "h long, seg binary, start int, end int")
    single = segments.where(F.col("n") > GROUP).mapInArrow(_strings, "h long, seg binary, start int, said binary")
    twice = single.groupBy("h", "start", "said").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    large = single.join(twice, ["h", "start", "said"]).select("h", "seg", "start", (F.col("start") + SPAN).cast("int").alias("end"))
    covers = usual.unionByName(large).groupBy(F.col("h").alias("_h"), F.col("seg").alias("_seg")).agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    covers = cut(covers)
    copies = kinds.where("times > 1").select(F.col("h").alias("_h"), F.col("seg").alias("_seg"))
    in_mixed = mixed.join(covers, (F.col("h") == F.col("_h")) & (F.col("seg") == F.col("_seg"))).select("id", "th", F.explode(F.transform("covers", lambda c: F.struct((F.col("pos") + c["start"]).alias("s"), (F.col("pos") + c["end"]).alias("e")))).alias("span"))
    as_whole = mixed.join(copies, (F.col("h") == F.col("_h")) & (F.col("seg") == F.col("_seg"))).select("id", "th", whole.alias("span"))

    spans = alike.unionByName(in_mixed).unionByName(as_whole)
    spans = cut(spans.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.flatten(F.collect_list(F.array("span.s", "span.e"))).alias("spans")))
    last = frame.join(spans, F.col("id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left").select("id", "th", "text", "spans")
    out = last.mapInArrow(_removed, f"id {kind}, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if passages:
        shared = cut(shared_windows(frame).select(F.col("th").alias("_th"), "n"))
        out = out.select("id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes).join(shared, F.col("th") == F.col("_th"), "left")
    count = [F.coalesce("n", F.lit(0)).cast("long").alias("n_shared")] if passages else []
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes, *count)
