"""Ordered operators over chat turns and chat event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FOLD_DEPTH = 4


# rows per position block when a conversation's turns are numbered (hot-key split)
POS_BLOCK = 4096


def _role_positions(turns: DataFrame, key: str, pos: str) -> DataFrame:
    """Position of each turn among the turns of its role (1-based), blocked by ``pos``."""
    from .history import blocked_position
    return blocked_position(turns, [key, "role"], [pos], F.floor(F.col(pos) / POS_BLOCK), name="_rpos")


def insert_at_fold(turns: DataFrame, key: str, pos: str, content: Column | str,
                   fold_depth: int = FOLD_DEPTH) -> DataFrame:
    """Prefix ``content`` to one turn per conversation: the ``fold_depth``-th user
    turn counted from the start, or the last turn when there are fewer user turns.

    ``turns(key, pos, role, content)``; ``pos`` orders the turns.  The target is a
    grouped aggregate per conversation (partial aggregation, then a join that AQE
    can split for a hot conversation); no window is keyed by the conversation.
    """
    text = F.lit(content) if isinstance(content, str) else content
    ranked = _role_positions(turns, key, pos)
    target = ranked.groupBy(key).agg(
        F.min(F.when((F.col("role") == "user") & (F.col("_rpos") == fold_depth), F.col(pos))).alias("_fold"),
        F.max(pos).alias("_last"))
    tgt = F.least(F.coalesce(F.col("_fold"), F.col("_last")), F.col("_last"))
    return (turns.join(target, key)
            .withColumn("content", F.when(F.col(pos) == tgt, F.concat(text, F.col("content"))).otherwise(F.col("content")))
            .drop("_fold", "_last"))


def split_by_role(history: DataFrame, key: str, pos: str, new_input: DataFrame | None = None, legacy_order: bool = False) -> DataFrame:
    """``(key, role, n, content)``: contents per role, newest first (n = 0 newest).

    ``new_input(key, content)`` is the user's input that the chat is about to answer: the newest user text, so
    n = 0 and those before move up by one; with ``legacy_order`` it comes after all of them.  A chat
    without history has its input only.
    """
    ranked = _role_positions(history, key, pos)
    counts = history.groupBy(key, "role").agg(F.count(F.lit(1)).alias("_cnt"))
    n = (F.col("_cnt") - F.col("_rpos")).cast("int")
    if new_input is None:
        return ranked.join(counts, [key, "role"]).select(key, "role", n.alias("n"), "content")
    asked = new_input.select(F.col(key), F.lit("user").alias("role"), F.col("content").alias("_input"))
    old = ranked.join(counts, [key, "role"]).join(asked, [key, "role"], "left")
    shift = F.when(F.col("_input").isNotNull() & F.lit(not legacy_order), 1).otherwise(0)
    last = F.coalesce("_cnt", F.lit(0)).cast("int") if legacy_order else F.lit(0)
    new = asked.join(counts, [key, "role"], "left").select(key, "role", last.alias("n"), F.col("_input").alias("content"))
    return old.select(key, "role", (n + shift).alias("n"), "content").unionByName(new)


def undo_last_pair(history: DataFrame, key: str, pos: str) -> DataFrame:
    """Drop the last two turns of every conversation holding at least two
    (``pos`` is the 1-based position within the conversation)."""
    n = history.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (history.join(n, key).filter((F.col("_n") < 2) | (F.col(pos) <= F.col("_n") - 2)).drop("_n"))


def number_turns(events: DataFrame, session: str = "session", order: list[str] | None = None) -> DataFrame:
    """Sequence and branch numbers of accepted (user, assistant) pairs.

    ``events(session, ..., action)`` with actions ``user``, ``assistant`` (accepts a
    pair: sequence_no advances by 2), ``back`` (always a new branch, pops a pair),
    ``retry`` (a new branch and a pop only when a pair is left, else an ordinary
    input) and ``new`` (resets everything).  Exact without per-row state:

    * segment = running count of ``new``;
    * S = running sum of +1 (assistant) / -1 (back, retry); pairs left
      h = S - least(0, running min S);
    * branch = running count of back, or retry with a pair left before it.

    Output: one row per accepted pair ``(session, event_id, sequence_no, branch)``.
    All windows are per (session, segment).
    """
    order = order or ["ts", "event_id"]
    a = F.col("action")
    by_session = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    g = events.withColumn("seg", F.sum(F.when(a == "new", 1).otherwise(0)).over(by_session)).withColumn(
        "step", F.when(a == "assistant", 1).when(a.isin("back", "retry"), -1).otherwise(0))
    seg_run = Window.partitionBy(session, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seg_ord = Window.partitionBy(session, "seg").orderBy(*order)
    s = g.withColumn("S", F.sum("step").over(seg_run))
    s = s.withColumn("h", F.col("S") - F.least(F.lit(0), F.min("S").over(seg_run)))
    s = s.withColumn("hb", F.coalesce(F.lag("h").over(seg_ord), F.lit(0)))
    accepted = F.sum(F.when(a == "assistant", 1).otherwise(0)).over(seg_run)
    branches = F.sum(F.when((a == "back") | ((a == "retry") & (F.col("hb") >= 1)), 1).otherwise(0)).over(seg_run)
    out = s.select(session, "event_id", "action", (2 * accepted - 2).alias("sequence_no"), branches.alias("branch"))
    return out.filter(a == "assistant").drop("action")


# events per block of a hot session (sessions below this stay one block)
BLOCK_ROWS = 200_000


def _session_blocks(events: DataFrame, session: str, block_rows: int, ts: str, block_seconds: int | None) -> DataFrame | None:
    """``(session, event_id, action, _ts, block)``, a hot session cut into blocks of event time; None if no session is hot.

    A session of at most ``block_rows`` events is one block, a larger one is cut into equal-width blocks of about
    so many events; ``block_seconds`` forces fixed-width blocks for every session.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    if block_seconds is not None:
        block, base = F.floor(us / (block_seconds * 1_000_000)), events
    else:
        stats = events.groupBy(session).agg(F.count(F.lit(1)).alias("_cnt"), F.min(us).alias("_lo"), F.max(us).alias("_hi"))
        if (stats.agg(F.max("_cnt")).first()[0] or 0) <= block_rows:
            return None
        base = events.join(stats, session)
        n_blocks = F.ceil(F.col("_cnt") / block_rows)
        width = F.greatest((F.col("_hi") - F.col("_lo") + 1) / n_blocks, F.lit(1.0))
        block = F.when(F.col("_cnt") <= block_rows, F.lit(0)).otherwise(F.floor((us - F.col("_lo")) / width))
    return base.select(session, "event_id", "action", F.col(ts).alias("_ts"), block.cast("long").alias("block"))


def _blocked_heights(ev: DataFrame, session: str) -> DataFrame:
    """``ev`` of ``_session_blocks`` with the pairs left before every event (``hb``), the accepted pairs and
    new branches (``acc_run``, ``branch``) up to it since the last ``new``, and the number of that (``seg``)."""
    a, blk, order = F.col("action"), [session, "block"], [F.col("_ts"), F.col("event_id")]
    run_b = Window.partitionBy(*blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("lseg", F.sum(F.when(a == "new", 1).otherwise(0)).over(run_b)).withColumn(
        "step", F.when(a == "assistant", 1).when(a.isin("back", "retry"), -1).otherwise(0)).withColumn(
        "acc", F.when(a == "assistant", 1).otherwise(0))
    seg_w = Window.partitionBy(*blk, "lseg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = (ev.withColumn("s_loc", F.sum("step").over(seg_w))
            .withColumn("min_loc", F.min("s_loc").over(seg_w))
            .withColumn("acc_loc", F.sum("acc").over(seg_w)))

    # block summaries in one aggregate: whole-block values (used when the block has
    # no 'new') and tail values (after the block's last 'new'); the last event is
    # always in the tail, and min(struct(-segment, s)) is the minimum of the last segment
    last = F.struct(*order)
    bs = ev.groupBy(*blk).agg(
        F.sum(F.when(a == "new", 1).otherwise(0)).alias("n_new"), F.sum("step").alias("tot"),
        F.sum("acc").alias("tot_acc"), F.min(F.when(F.col("lseg") == 0, F.col("s_loc"))).alias("relmin"),
        F.max_by("s_loc", last).alias("tail_s"), F.max_by("acc_loc", last).alias("tail_acc"),
        F.min(F.struct((-F.col("lseg")).alias("k"), F.col("s_loc").alias("v")))["v"].alias("tail_min"))
    before = Window.partitionBy(session).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    segs = bs.select(*blk, F.coalesce(F.sum("n_new").over(before), F.lit(0)).alias("seg_in"))

    ev = ev.join(_block_entry(bs, session), blk).join(segs, blk)
    first = F.col("lseg") == 0
    s = F.when(first & F.col("has_in"), F.col("s_in") + F.col("s_loc")).otherwise(F.col("s_loc"))
    mn = F.when(first & F.col("has_in"), F.least(F.col("min_in"), F.col("s_in") + F.col("min_loc"))) \
        .otherwise(F.col("min_loc"))
    ev = ev.withColumn("S", s).withColumn("h", F.col("S") - F.least(F.lit(0), mn)).withColumn(
        "acc_run", F.when(first, F.col("acc_in")).otherwise(0) + F.col("acc_loc"))
    h_in = F.when(F.col("has_in"), F.col("s_in") - F.least(F.lit(0), F.col("min_in"))).otherwise(F.lit(0))
    lag_w = Window.partitionBy(*blk, "lseg").orderBy(*order)
    ev = ev.withColumn("hb", F.coalesce(F.lag("h").over(lag_w), F.when(first, h_in).otherwise(F.lit(0))))
    ev = ev.withColumn("inc", F.when((a == "back") | ((a == "retry") & (F.col("hb") >= 1)), 1).otherwise(0))
    ev = ev.withColumn("br_loc", F.sum("inc").over(seg_w))

    # second carry: branch increments per block, same reset structure
    inc_sum = ev.groupBy(*blk).agg(
        F.sum(F.when(F.col("lseg") == 0, F.col("inc")).otherwise(0)).alias("tot_inc"),
        F.sum(F.when(a == "new", 1).otherwise(0)).alias("n_new"),
        F.max_by("br_loc", F.struct(*order)).alias("tail_inc"))
    ev = ev.join(_branch_entry(inc_sum, session), blk)
    return ev.select(session, "event_id", "action", "_ts", "block", (F.col("seg_in") + F.col("lseg")).alias("seg"), "hb", "acc_run",
                     (F.when(first, F.col("br_in")).otherwise(0) + F.col("br_loc")).alias("branch"))


def number_turns_blocked(events: DataFrame, session: str = "session", block_rows: int = BLOCK_ROWS,
                         ts: str = "ts", block_seconds: int | None = None) -> DataFrame:
    """``number_turns`` for sessions of any size: a segmented parallel scan.

    A grouped count per session (partial aggregation, so a hot session costs
    nothing special) decides the plan: when no session holds more than
    ``block_rows`` events the plain per-session windows run (each session fits a
    task); otherwise hot sessions are cut into blocks.
    Every window runs per (session, block), so one session holding a third of all
    events is spread over many tasks.  A block summary table (one row per block)
    carries the running state (S, running min of S, accepted pairs, branches)
    from block to block with windows over blocks, restarting after the last
    ``new`` of a block.  Same result as ``number_turns``.
    """
    ev = _session_blocks(events, session, block_rows, ts, block_seconds)
    if ev is None:
        return number_turns(events.withColumnRenamed(ts, "ts") if ts != "ts" else events, session)
    return _blocked_heights(ev, session).filter(F.col("action") == "assistant").select(
        session, "event_id", (2 * F.col("acc_run") - 2).alias("sequence_no"), "branch")


def rewound_turns(events: DataFrame, session: str = "session", block_rows: int = BLOCK_ROWS, ts: str = "ts",
                  block_seconds: int | None = None) -> DataFrame:
    """``number_turns`` where going back lowers the sequence number too, so that an answer replaces the one that was taken back.

    A pair gets the number of those left before it (``sequence_no`` = 2 * height); ``undone_by`` is the back or retry that
    takes it back (null: it is in the final history), its matching bracket: at one height of a segment
    pairs and pops alternate, so the k-th pair there goes with the k-th pop.  Both are numbered per block and shifted by the
    counts of the blocks before (one row per height and block), then joined, so no hot session lands in one task.
    """
    ev = _session_blocks(events, session, block_rows, ts, block_seconds)
    if ev is None:  # every session fits a task: one block each
        ev = events.select(session, "event_id", "action", F.col(ts).alias("_ts"), F.lit(0).cast("long").alias("block"))
    a, hb = F.col("action"), F.col("hb")
    marks = materialize(_blocked_heights(ev, session).select(
        session, "event_id", "_ts", "block", "seg", "branch", (a == "assistant").alias("push"),
        F.when(a == "assistant", hb + 1).when(a.isin("back", "retry"), hb).alias("height")).where("height >= 1"))
    level = [session, "seg", "height", "push"]
    before = Window.partitionBy(*level).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = marks.groupBy(*level, "block").agg(F.count(F.lit(1)).alias("n")).select(
        *level, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    local = Window.partitionBy(*level, "block").orderBy("_ts", "event_id")
    placed = marks.withColumn("i", F.row_number().over(local)).join(shift, [*level, "block"]).withColumn("k", F.col("shift") + F.col("i"))
    key = [session, "seg", "height", "k"]
    pairs = placed.where("push").select(*key, "event_id", "branch")
    pops = placed.where("NOT push").select(*key, F.col("event_id").alias("undone_by"))
    return pairs.join(pops, key, "left").select(session, "event_id", (2 * F.col("height") - 2).cast("long").alias("sequence_no"),
                                                F.col("branch").cast("long").alias("branch"), "undone_by")


def _block_entry(bs: DataFrame, session: str) -> DataFrame:
    """State entering each block: (has_in, s_in, min_in, acc_in).

    grp = number of reset blocks up to the previous block; within a group the
    state is the reset block's tail followed by whole no-reset blocks.  Windows run
    over the block table (one row per block).
    """
    ob = Window.partitionBy(session).orderBy("block")
    prev = ob.rowsBetween(Window.unboundedPreceding, -1)
    reset = (F.col("n_new") > 0).cast("int")
    bs = bs.withColumn("grp", F.coalesce(F.sum(reset).over(prev), F.lit(0)))
    # base = sum of whole-block step totals of the no-reset blocks since the group start
    bs = bs.withColumn("base", F.col("tot") * (1 - reset))
    g = Window.partitionBy(session, "grp").orderBy("block")
    gprev = g.rowsBetween(Window.unboundedPreceding, -1)
    # the group's opening tail: for grp > 0 it is the tail of the reset block that
    # ends the previous group; carry it as columns looked up with last(...)
    bs = bs.withColumn("open_s", F.last(F.when(F.col("n_new") > 0, F.col("tail_s")), True).over(prev))
    bs = bs.withColumn("open_min", F.last(F.when(F.col("n_new") > 0, F.col("tail_min")), True).over(prev))
    bs = bs.withColumn("open_acc", F.last(F.when(F.col("n_new") > 0, F.col("tail_acc")), True).over(prev))
    # blocks of this group before the current one have no reset (a reset closes the group)
    sum_prev = F.coalesce(F.sum("tot").over(gprev), F.lit(0))
    acc_prev = F.coalesce(F.sum("tot_acc").over(gprev), F.lit(0))
    n_prev = F.coalesce(F.count(F.lit(1)).over(gprev), F.lit(0))
    # running minimum over the previous blocks of the group of (S before block + relmin)
    bs = bs.withColumn("s_before_rel", F.coalesce(F.sum("tot").over(gprev), F.lit(0)))
    bs = bs.withColumn("cand", F.col("s_before_rel") + F.col("relmin"))
    min_prev = F.min("cand").over(gprev)
    open_s = F.coalesce(F.col("open_s"), F.lit(0))
    s_in = open_s + sum_prev
    min_parts = F.least(F.col("open_min"), open_s + min_prev)
    has_in = F.col("open_s").isNotNull() | (n_prev > 0)
    return bs.select(session, "block", has_in.alias("has_in"), s_in.alias("s_in"),
                     min_parts.alias("min_in"),
                     (F.coalesce(F.col("open_acc"), F.lit(0)) + acc_prev).alias("acc_in"))


def _branch_entry(bi: DataFrame, session: str) -> DataFrame:
    ob = Window.partitionBy(session).orderBy("block")
    prev = ob.rowsBetween(Window.unboundedPreceding, -1)
    reset = (F.col("n_new") > 0).cast("int")
    bi = bi.withColumn("grp", F.coalesce(F.sum(reset).over(prev), F.lit(0)))
    bi = bi.withColumn("open_inc", F.last(F.when(F.col("n_new") > 0, F.col("tail_inc")), True).over(prev))
    g = Window.partitionBy(session, "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    br_in = F.coalesce(F.col("open_inc"), F.lit(0)) + F.coalesce(F.sum("tot_inc").over(g), F.lit(0))
    return bi.select(session, "block", br_in.alias("br_in"))
