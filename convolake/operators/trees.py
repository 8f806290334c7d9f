"""Message trees in the order of reading: parents before their children, children by time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.tables import cut, drop

#: Share of a session's messages that its trees must reach, or the rest is appended.
REACHED = 0.9
#: Messages up to which a session's tour is ranked inside a task; longer ones are ranked by joins, with the same result.
INSIDE = 1 << 16


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """One row for each (session_id, node): the last one's values at the first one's place (seq)."""
    values = [c for c in rows.columns if c not in ("session_id", "node", "seq")]
    one = rows.groupBy("session_id", "node").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*values), "seq").alias("_v"))
    return one.select("session_id", "node", "seq", *[F.col("_v")[c].alias(c) for c in values])


def _links(nodes: DataFrame) -> DataFrame:
    """(session_id, n, up, child, next, hidden, root): each node with its parent, its first child and its next sibling."""
    parents = nodes.select("session_id", F.col("node").alias("parent"), F.col("n").alias("up"))
    at = nodes.join(parents, ["session_id", "parent"], "left")
    brothers = Window.partitionBy("session_id", F.coalesce("up", F.lit(-1)), F.col("parent").isNull()).orderBy("ts", "seq")
    at = at.select("session_id", "n", "up", "hidden", F.col("parent").isNull().alias("root"), F.lead("n").over(brothers).alias("next"), F.row_number().over(brothers).alias("place"))
    first = at.where("place = 1 and up is not null").select(F.col("up").alias("_n"), F.col("n").alias("child"))
    return at.join(first, F.col("n") == F.col("_n"), "left").select("session_id", "n", "up", "child", "next", "hidden", "root")


def _tour(at: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: (e, to, enters, below, ended); entering node n is 2n, leaving it 2n + 1.

    Entering leads to the first child or to leaving; leaving leads to the next sibling or to the parent's leaving;
    leaving a session's last root ends the tour. What hangs on a missing parent leads to no end (to is null).
    """
    sign = F.when(F.col("hidden"), 1).otherwise(0)
    enter = at.select((F.col("n") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("n") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("enters"), sign.cast("long").alias("below"), F.lit(False).alias("ended"))
    known = F.col("root") | F.col("up").isNotNull()
    to = F.when(known, F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1))
    leave = at.select((F.col("n") * 2 + 1).alias("e"), to.alias("to"), F.lit(0).cast("long").alias("enters"), (-sign).cast("long").alias("below"), (F.col("root") & F.col("next").isNull()).alias("ended"))
    return enter.unionByName(leave)


def _rank_part(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, enters, below) of the nodes in trees of whole sessions, by doubling along the tour that _tour() describes."""
    order = np.argsort(c["n"])
    c = {k: v[order] for k, v in c.items()}
    n, size = c["n"], len(c["n"])
    place = {k: np.searchsorted(n, c[k]) for k in ("up", "child", "next")}  # -1 where there is none
    at = np.arange(size)
    last, off = (c["next"] < 0) & (c["up"] < 0), 2 * size
    to = np.concatenate([np.where(c["child"] >= 0, place["child"], at + size), np.where(c["next"] >= 0, place["next"], np.where(c["up"] >= 0, place["up"] + size, off))])
    to[size:][~c["root"] & (c["up"] < 0)] = off
    to = np.append(to, off)
    sign = c["hidden"].astype(np.int64)
    enters, below = np.concatenate([np.ones(size, np.int64), np.zeros(size + 1, np.int64)]), np.concatenate([sign, -sign, [0]])
    ended = np.concatenate([np.zeros(size, bool), c["root"] & last, [False]])
    for _ in range((2 * size).bit_length() + 1):
        if (to == off).all():
            break
        enters, below, ended, to = enters + enters[to], below + below[to], ended | ended[to], to[to]
        if (done := to[to] == to).all() and (to[done] == off).all():
            break
    some = ended[:size] & (to[:size] == off)
    return n[some], enters[:size][some], below[:size][some]


def _ranked_inside(at: DataFrame) -> DataFrame:
    """(_n, enters, below) of _links() of sessions of at most INSIDE nodes: their tours are ranked where the session's rows lie together."""
    columns = ["n", "up", "child", "next"]
    dealt = at.select("session_id", "n", *[F.coalesce(c, F.lit(-1)).alias(c) for c in columns[1:]], "hidden", "root").repartition("session_id").sortWithinPartitions("session_id")

    def run(batches):
        held, rows = [], 0

        def ranked(table):
            c = {k: table.column(k).to_numpy() for k in columns} | {k: table.column(k).to_pandas().to_numpy(dtype=bool) for k in ("hidden", "root")}
            return pa.record_batch([pa.array(x) for x in _rank_part(c)], names=["_n", "enters", "below"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < INSIDE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.column("session_id").slice(rows - 1)[0].as_py()
            own = pc.equal(table.column("session_id"), pa.scalar(last, table.schema.field("session_id").type)) if last is not None else pc.is_null(table.column("session_id"))
            whole = rows - pc.sum(pc.cast(pc.fill_null(own, False), pa.int64())).as_py()  # the last session may go on
            if whole:
                yield ranked(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield ranked(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "_n long, enters long, below long")


def _ranked(tour: DataFrame) -> DataFrame:
    """Of the elements that reach the end: how many nodes are entered, and how many hidden ones more entered than left, from there on.

    List ranking by doubling: each round an element adds what the element it points at has, and points where that one
    points, so that a tour of n elements takes log2(n) rounds. Cycles never reach an end and are left out.
    """
    now = cut(tour.withColumn("done", F.col("ended") | F.col("to").isNull()), F.count("*").alias("n"))
    for _ in range(now.saw["n"].bit_length() + 1):
        if now.where("not done").isEmpty():
            break
        other = now.select(F.col("e").alias("to"), F.col("to").alias("_to"), F.col("enters").alias("_enters"), F.col("below").alias("_below"), F.col("ended").alias("_ended"), F.col("done").alias("_done"))
        far = now.where("not done").join(other, "to")
        far = far.select("e", F.col("_to").alias("to"), F.try_add("enters", "_enters").alias("enters"), F.try_add("below", "_below").alias("below"), F.col("_ended").alias("ended"), F.col("_done").alias("done"))
        last, now = now, cut(far.unionByName(now.where("done")))
        drop(last)
    return now.where("ended").select("e", "enters", "below")


def reading_order(rows: DataFrame) -> DataFrame:
    """session_id, node, place (from 0) of the messages of each session that are shown, in order.

    rows: session_id, node, parent, ts, seq (order of arrival), hidden. Of rows with one id the last counts, at the
    first one's place. Roots and children come by time (no time first), then by arrival; what lies below a hidden
    message isn't shown; members of a cycle and messages whose parent is missing are in no tree. Where the trees show less
    than nine tenths of a session, those are appended by time. A session without a root comes by arrival.
    """
    nodes = distinct_nodes(rows.select("session_id", "node", "parent", "ts", "seq", F.coalesce("hidden", F.lit(False)).alias("hidden")))
    nodes = cut(nodes.withColumn("n", F.monotonically_increasing_id()))
    large = cut(nodes.groupBy(F.col("session_id").alias("_s")).agg(F.count("*").alias("_n")).where(F.col("_n") > INSIDE).select("_s"), F.count("*").alias("n"))
    here = F.col("session_id").eqNullSafe(F.col("_s"))
    ranked = _ranked_inside(_links(nodes.join(large, here, "left_anti") if large.saw["n"] else nodes))
    if large.saw["n"]:
        far = _ranked(_tour(_links(nodes.join(large, here, "left_semi"))))
        ranked = ranked.unionByName(far.where("e % 2 = 0").select(F.shiftright("e", 1).alias("_n"), "enters", "below"))
    else:
        drop(large)
    at = nodes.join(ranked, F.col("n") == F.col("_n"), "left")
    # the signs of a whole tour add up to none: what is left open before a message is the negative of what follows from it
    in_tree = F.col("enters").isNotNull()
    shown = in_tree & (F.col("below") >= 0)
    at = at.withColumn("in_tree", in_tree).withColumn("shown", shown)
    sums = at.groupBy(F.col("session_id").alias("_s")).agg(F.count("*").alias("all"), F.count(F.when(F.col("shown"), 1)).alias("kept"), F.bool_or(F.col("parent").isNull()).alias("rooted"))
    at = at.join(sums, F.col("session_id").eqNullSafe(F.col("_s")))
    extra = ~F.col("in_tree") & (F.col("kept") < F.col("all") * REACHED)
    part = F.when(~F.col("rooted"), 0).when(F.col("shown"), 1).when(extra, 2)
    at = at.withColumn("part", part).where("part is not null")
    w = Window.partitionBy("session_id").orderBy("part", F.when(F.col("part") == 1, -F.col("enters")), F.when(F.col("part") == 2, F.col("ts")), "seq")
    return at.select("session_id", "node", (F.row_number().over(w) - 1).cast("long").alias("place"))
