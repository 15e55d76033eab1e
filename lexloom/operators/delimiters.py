"""Delimiter links, depths and enclosing blocks of any tokens, by windows.

One stack serves all three kinds of brackets; a closer that does not fit its top is
ignored and removes nothing.  Where every closer of a file fits, its opener is the
last one on its level, so links are windows over (file, level).  Only files that
hold a closer that does not fit are folded, bracket by bracket, to find which are
ignored; without those, the windows hold for them, too.

Where a row holds all lexemes of a file, ``linked_lexemes`` links them in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MOST_DEPTH, TOKENS

_OPENERS, _CLOSERS = ("(", "{", "["), (")", "}", "]")
_KINDS = {"curly": ("{", "}"), "round": ("(", ")"), "bracket": ("[", "]")}


def _up_to():
    return Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _opener_of(kind: Column) -> Column:
    return F.translate(kind, ")}]", "({[")


def _leveled(brackets: DataFrame) -> DataFrame:
    """``brackets`` (file, pos, kind) with ``level``, which an opener and its closer share, and ``partner`` if they fit."""
    step = F.when(F.col("kind").isin(*_OPENERS), 1).otherwise(-1)
    rows = brackets.withColumn("opens", F.col("kind").isin(*_OPENERS))
    rows = rows.withColumn("level", F.sum(step).over(_up_to()) + F.when(F.col("opens"), 0).otherwise(1))
    same = Window.partitionBy("file", "level").orderBy("pos")
    one = F.struct("kind", "pos", "opens")
    rows = rows.withColumn("_before", F.lag(one).over(same)).withColumn("_behind", F.lead(one).over(same))
    closes = ~F.col("opens") & F.col("_before.opens") & (F.col("_before.kind") == _opener_of(F.col("kind")))
    closed = F.col("opens") & ~F.col("_behind.opens") & (F.col("kind") == _opener_of(F.col("_behind.kind")))
    partner = F.when(closes, F.col("_before.pos")).when(closed, F.col("_behind.pos"))
    return rows.withColumn("partner", partner).drop("_before", "_behind")


def _ignored(kinds: Column) -> Column:
    """Positions of the closers that a stack ignores, of an array of (pos, kind) in order."""
    first = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<int>").alias("ignored"))

    def step(state: Column, bracket: Column) -> Column:
        stack, kind = state["stack"], bracket["kind"]
        size = F.size(stack)
        fits = (size > 0) & F.coalesce(F.try_element_at(stack, size) == _opener_of(kind), F.lit(False))
        after = F.when(kind.isin(*_OPENERS), F.array_append(stack, kind)).when(fits, F.slice(stack, F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(stack)
        passed = F.when(kind.isin(*_OPENERS) | fits, state["ignored"]).otherwise(F.array_append(state["ignored"], bracket["pos"]))
        return F.struct(after.alias("stack"), passed.alias("ignored"))

    return F.aggregate(kinds, first, step)["ignored"]


def links(tokens: DataFrame) -> DataFrame:
    """(file, pos, kind, partner) of every bracket in ``tokens`` (file, pos, node_kind) that has a partner."""
    brackets = tokens.filter(F.col("node_kind").isin(*_OPENERS, *_CLOSERS)).select("file", "pos", F.col("node_kind").alias("kind"))
    whole = Window.partitionBy("file")
    rows = _leveled(brackets).withColumn("_misfits", F.max(~F.col("opens") & F.col("partner").isNull()).over(whole))
    clean = rows.filter("not _misfits").select("file", "pos", "kind", "partner")
    # A file is the unit of work: its brackets are one array.
    odd = rows.filter("_misfits").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("all"))
    odd = odd.withColumn("ignored", _ignored(F.col("all"))).select("file", F.explode(F.filter("all", lambda b: ~F.array_contains("ignored", b["pos"]))).alias("b"))
    mended = _leveled(odd.select("file", "b.pos", "b.kind")).select("file", "pos", "kind", "partner")
    return clean.unionAll(mended).filter("partner is not null")


def _events(tokens: DataFrame) -> DataFrame:
    """(file, pos, jmp, path) of brackets with partners; ``path`` of a block's opener is that of the tokens around it."""
    found = links(tokens)
    step = F.when(F.col("kind") == "{", 1).otherwise(-1)
    braces = found.filter("kind in ('{', '}')").withColumn("level", F.sum(step).over(_up_to()) - 1).filter("kind = '{'")
    # An opener answers those behind it at its own level, and asks at the levels above it.
    asked = braces.select("file", "pos", F.col("level").alias("own"), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    asks = F.col("level") < F.col("own")
    before = Window.partitionBy("file", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~asks, F.col("pos")), ignorenulls=True).over(before)
    around = asked.withColumn("around", F.when(asks, F.struct("level", last.alias("at")))).groupBy("file", "pos")
    paths = around.agg(F.array_sort(F.collect_list("around")).alias("all"))
    path = F.concat(F.array(F.lit(-1)), F.transform("all", lambda x: x["at"].cast("int")))
    paths = paths.select("file", "pos", path.alias("path"))
    return found.join(paths, ["file", "pos"], "left").select("file", "pos", F.col("partner").cast("int").alias("jmp"), "path")


def with_blocks(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their three depths, ``jmp`` and ``block_path``, in place of those that they have.

    Needs file, pos and node_kind.  Depths count brackets of one kind, whichever
    others stand between; partners and blocks are those of one stack for all.
    Brackets are linked by themselves and come back as rows before their tokens,
    so that all tokens move once.
    """
    kept = [c for c in tokens.columns if c not in ("jmp", "block_path", *(f"{k}_depth" for k in _KINDS))]
    rows = tokens.select(*kept, F.lit(1).alias("_real")).unionByName(_events(tokens).withColumn("_real", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("file").orderBy("pos", "_real")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.lag(F.struct("pos", "_real", "jmp", "path")).over(order)
    rows = rows.withColumn("_event", event)
    own = (F.col("_real") == 1) & (F.col("_event._real") == 0) & (F.col("_event.pos") == F.col("pos"))
    rows = rows.withColumns({"jmp": F.when(own, F.col("_event.jmp")), "path": F.when(own, F.col("_event.path"))}).drop("_event")
    kind = F.col("node_kind")
    steps = {name: F.when(kind == opener, 1).when(kind == closer, -1).otherwise(0) for name, (opener, closer) in _KINDS.items()}
    rows = rows.withColumns({f"_{name}": F.sum(step).over(up_to) for name, step in steps.items()})
    # Behind a token: the height over the lowest so far, if that is below zero.  A closer stands on the depth before it.
    rows = rows.withColumns({f"_{name}": F.col(f"_{name}") - F.least(F.min(f"_{name}").over(up_to), F.lit(0)) for name in _KINDS})
    before = {name: F.coalesce(F.lag(f"_{name}").over(order), F.lit(0)) for name in _KINDS}
    depths = {f"{name}_depth": F.when(kind == closer, before[name]).otherwise(F.col(f"_{name}")) for name, (_, closer) in _KINDS.items()}
    rows = rows.withColumns({name: F.least(depth, F.lit(MOST_DEPTH)).cast("int") for name, depth in depths.items()})
    # Blocks are matched braces, which nest: around a token stands the last opener of its level.
    opens, closes = ((kind == b) & F.col("jmp").isNotNull() for b in "{}")
    rows = rows.withColumn("_level", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(up_to))
    same = Window.partitionBy("file", "_level").orderBy("pos", "_real").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.last(F.when(opens, F.concat("path", F.array(F.col("pos").cast("int")))), ignorenulls=True).over(same)
    path = F.when(opens, F.col("path")).when(F.col("_level") > 0, inside).otherwise(F.array(F.lit(-1)))
    named = [f.name for f in TOKENS if f.name in (*kept, "jmp", "block_path", *depths)]
    return rows.withColumn("block_path", path).filter("_real = 1").select(*named, *(c for c in kept if c not in named))


#: What linking adds to lexemes, and the elements of token rows and paths that are sent on together.
LINKED, _SENT = ("curly_depth", "round_depth", "bracket_depth", "jmp", "block_path"), 262_144


def _fold(at: list[int], kind: list[int], starts: list[int]) -> tuple[list, list[list[int]], list[list[int]], list[tuple[int, int, int]]]:
    """Brackets of files one after another, through one stack each.

    ``at`` are places, ``kind`` numbers of "({[)}]", and -1 where a file begins;
    ``starts`` is the place of its first lexeme.  Returns partners, the depths of
    each bracket and of what is behind it (with the block), and blocks: the one
    around, the position of the opener, and the length of the path.
    """
    partner: list[int | None] = [None] * len(at)
    stack: list[int] = []
    for k, b in enumerate(kind):
        if b < 0:
            stack = []
        elif b < 3:
            stack.append(k)
        elif stack and kind[stack[-1]] == b - 3:
            partner[k] = stack.pop()
            partner[partner[k]] = k
    own, behind, blocks = [], [], [(-1, -1, 1)]
    depth, block = [0, 0, 0], 0
    for k, b in enumerate(kind):
        before = depth
        if b < 0:
            depth, block = [0, 0, 0], 0
        else:
            depth = depth.copy()
            depth[b % 3] = depth[b] + 1 if b < 3 else max(depth[b - 3] - 1, 0)
        around = block
        if b == 1 and partner[k] is not None:
            blocks.append((block, at[k] - starts[k], blocks[block][2] + 1))
            block = len(blocks) - 1
        elif b == 4 and partner[k] is not None:
            around = block = blocks[block][0]
        own.append([*(before if b >= 3 else depth), around])
        behind.append([*depth, block])
    return partner, own, behind, blocks


def _linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The lexemes of files (their array last), linked."""
    raw = batch.columns[-1]
    sizes = pc.fill_null(pc.list_value_length(raw), 0).to_numpy(zero_copy_only=False)
    file, values = np.repeat(np.arange(len(raw)), sizes), raw.flatten()
    first = np.cumsum(sizes) - sizes
    kind = pc.fill_null(pc.index_in(values, value_set=pa.array(list("({[)}]"), values.type)), -1).to_numpy(zero_copy_only=False)
    brackets, begins = np.flatnonzero(kind >= 0), first[sizes > 0]
    at = np.concatenate([begins, brackets])
    order = np.argsort(at, kind="stable")  # a file begins before its first bracket
    at, what = at[order], np.concatenate([np.full(len(begins), -1), kind[brackets]])[order]
    partner, own, behind, blocks = _fold(at.tolist(), what.tolist(), first[file[at]].tolist())
    last = np.searchsorted(at, np.arange(len(values)), side="right") - 1
    state, whole = np.array(behind, np.int64).reshape(-1, 4)[last], np.array(own, np.int64).reshape(-1, 4)
    real = what >= 0
    state[at[real]] = whole[real]
    pos, jmp = np.arange(len(values)) - first[file], np.full(len(values), -1)
    paired = np.flatnonzero([p is not None for p in partner])
    other = np.array([partner[k] for k in paired.tolist()], np.int64)
    jmp[at[paired]] = pos[at[other]]
    length = np.array([b[2] for b in blocks])[state[:, 3]]
    part = np.cumsum(length + 8) // _SENT
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(values)]
    for a, z in zip(cuts, cuts[1:]) if len(values) else ():
        inside, path = np.unique(state[a:z, 3], return_inverse=True)
        paths = []
        for block in inside.tolist():
            found = []
            while block >= 0:
                block, place, _ = blocks[block]
                found.append(place)
            paths.append(found[::-1])
        rows = batch.select(batch.schema.names[:-1]).take(pa.array(file[a:z]))
        depths = np.minimum(state[a:z, :3], MOST_DEPTH).astype(np.int32)
        # In the order of _KINDS.
        found = [pa.array(depths[:, k]) for k in (1, 0, 2)]
        found += [pa.array(jmp[a:z].astype(np.int32), mask=jmp[a:z] < 0), pa.array(paths, pa.list_(pa.int32())).take(pa.array(path))]
        yield pa.record_batch([*rows.columns, pa.array(pos[a:z].astype(np.int32)), values.slice(a, z - a), *found], names=[*rows.schema.names, "pos", "_raw", *LINKED])


def linked_lexemes(files: DataFrame) -> DataFrame:
    """pos and _raw of the lexemes of ``files``, whose array is their last column, with depths, jmp and block_path as ``with_blocks`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Paths and states of some files at a time.
            size = np.cumsum(pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False)) // _SENT
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                yield from _linked(batch.slice(a, z - a))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema[:-1])
    return files.mapInArrow(run, f"{kept}, pos int, _raw string, curly_depth int, round_depth int, bracket_depth int, jmp int, block_path array<int>")
