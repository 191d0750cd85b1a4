"""Conversation structure repair: the cheapest edits that give roles ``(system? (user assistant)+)?``.

Nodes are (rows read, state of the role grammar); arcs are edits: Delete, Insert, Keep, Rerole.  A cost DP gives each node's
distance to the end, and the arcs on cheapest paths remain.  No node has two such arcs of one letter, so a prefix of an
audit leads to one node.  Prefix doubling ranks the nodes by their least audits of length 1, 2, 4, ...: the rank for
twice the length is that of the pair (own rank, rank of the node that the doubled pointer leads to).  Where a node
has several arcs, the least (letter, rank of its target) is taken; the doubled pointers then list the path.

A conversation may be of any length.  Rows are sorted by range over the whole table and cut into blocks of BLOCK rows, each of
which is solved in one task: an edge conversation sends its block's cost matrix (min-plus product of its rows); these give the
distances at the block borders; then the blocks' state maps under the least paths give the states at the
borders.  Borders are at most two rows a block.

Defined results: null roles and texts are one space; rows of equal turn follow role and the SHA-256 of role and text; a role that
doesn't begin with s, u or a can't be kept; null conversation ids form one conversation.  Only the four columns are
read, so others of any name change nothing.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import runs_of, stored

BLOCK_BITS = 16
SPACE = " \t\n\x0b\x0c\r"
SPEECH_ENDS = (".", "!", "?")
FAULTS = ("blank", "duplicate", "truncated")

# States: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ADDED = np.array([USER, USER, ASSISTANT, USER])  # the state after a row of the role that must come next
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
TRUNCATED = 1
LETTERS = np.array(["", "D", "I", "K", "R"])
FAR = 1 << 29
CLOSED = np.array([[0, FAR, 2, 4], [FAR, 0, 2, 4], [FAR, FAR, 0, 2], [FAR, FAR, 2, 0]])  # cheapest inserts from state to state
AT_END = np.array([0, 4, 2, 0])


def key_of(conv_id: str = "conv_id") -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("-"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by the checksum of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    times = F.when(way == 0, F.array().cast("array<int>")).when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(text("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(times).alias("again")).drop("again")


def in_order(rows: DataFrame) -> DataFrame:
    """Written table of (conv, turn, role, text, digest, place); ``place`` grows with conversation and turn."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    by = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    rows = rows.select(key_of().alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.unhex(digest).alias("digest"))
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(laid.withColumn("place", F.monotonically_increasing_id()), "conversation-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, place, initial, fault) of ``in_order`` rows; the first of FAULTS that a row has, or null."""
    said = F.rtrim("text", F.lit(SPACE))
    first = rows.groupBy("conv", "digest").agg(F.min("place").alias("first")).select("first")
    found = rows.select("conv", "turn", "place", F.left("role", F.lit(1)).alias("initial"), (said == "").alias("blank"),
                        (~F.right(said, F.lit(1)).isin(*SPEECH_ENDS)).alias("cut"))
    found = found.join(first, F.col("place") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return stored(found.select("conv", "turn", "place", "initial", fault.alias("fault")), "conversation-faults")


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of 4 x 4 cost matrices."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return np.minimum(out, FAR)


class Block:
    """Rows of one block, cut into conversations."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.conv, self.place, n = rows["conv"].combine_chunks(), rows["place"].to_numpy(), rows.num_rows
        codes = self.conv.dictionary_encode().indices.to_numpy()
        self.first = np.concatenate([[0], (codes[1:] != codes[:-1]).nonzero()[0] + 1])
        self.last = np.concatenate([self.first[1:], [n]]) - 1
        self.segment = np.repeat(np.arange(len(self.first)), self.last - self.first + 1)
        fault = np.array(rows["fault"].fill_null("").to_pylist(), object)
        self.dead = (fault == "blank") | (fault == "duplicate")
        self.cut = (fault == "truncated").astype(np.int64)
        self.initial = np.array(rows["initial"].to_pylist(), object)
        n_segments = len(self.first)
        self.kept = np.full((n, 4), -1)
        for letter, targets in NEXT.items():
            own = (self.initial == letter) & ~self.dead
            for state, target in enumerate(targets):
                if target is not None:
                    self.kept[own, state] = target
        self.exits = np.tile(AT_END, (n_segments, 1))
        self.open = np.zeros(n_segments, bool)
        self.entry = np.zeros(n_segments, np.int64)

    def border(self, messages: pa.Table) -> None:
        """Distances behind the block and the state before it, for conversations that other blocks share."""
        edges = {self.conv[int(self.first[g])].as_py(): g for g in {0, len(self.first) - 1}}
        for m in messages.to_pylist():
            g = edges[m["conv"]]
            self.exits[g], self.open[g], self.entry[g] = m["exits"], m["open"], m["entry"] or 0

    def matrices(self) -> np.ndarray:
        """Cost matrix from before each row to the end of its conversation in the block."""
        n, states = len(self.place), np.arange(4)
        step = np.full((n, 4, 4), FAR)
        step[:, states, states] = DELETE
        for s in range(4):
            alive = ~self.dead
            step[alive, s, ADDED[s]] = np.minimum(step[alive, s, ADDED[s]], REROLE + self.cut[alive])
            keep = (self.kept[:, s] >= 0).nonzero()[0]
            step[keep, s, self.kept[keep, s]] = np.minimum(step[keep, s, self.kept[keep, s]], KEEP + self.cut[keep])
        step = min_plus(np.broadcast_to(CLOSED, step.shape), step)
        behind, width = self.last[self.segment] - np.arange(n), 1
        while (more := (behind >= width).nonzero()[0]).size:
            step[more] = min_plus(step[more], step[more + width])
            width *= 2
        return step

    def ranked_arcs(self) -> None:
        """Nodes, their cheapest arcs, ranks and doubled pointers."""
        n, groups = len(self.place), len(self.first)
        border = np.arange(n) + self.segment  # a conversation of r rows has r + 1 borders
        ends = self.last + 1 + np.arange(groups)
        dist = np.empty((n + groups, 4), np.int64)
        dist[border] = np.min(self.matrices() + self.exits[self.segment][:, None, :], axis=2)
        dist[ends] = self.exits
        nodes = np.arange(4 * (n + groups))
        label = np.zeros((len(nodes), 4), np.int64)  # 0: no such arc
        target = np.tile(nodes[:, None], (1, 4))
        cost = np.array([DELETE, INSERT, KEEP, REROLE])
        grid = nodes.reshape(-1, 4)

        def arcs(k: int, where: np.ndarray, to: np.ndarray, extra: np.ndarray) -> None:
            flat = dist.ravel()
            tight = flat[where] == cost[k] + extra + flat[to]
            label[where[tight], k], target[where[tight], k] = k + 1, to[tight]

        every = np.ones(n + groups, bool)
        every[ends[self.open]] = False  # inserts at a shared border belong to the block behind it
        here = every.nonzero()[0]
        for s in range(4):
            arcs(0, grid[border, s], grid[border + 1, s], np.zeros(n, np.int64))
            arcs(1, grid[here, s], grid[here, ADDED[s]], np.zeros(len(here), np.int64))
            keep = (self.kept[:, s] >= 0).nonzero()[0]
            arcs(2, grid[border[keep], s], grid[border[keep] + 1, self.kept[keep, s]], self.cut[keep])
            alive = (~self.dead).nonzero()[0]
            arcs(3, grid[border[alive], s], grid[border[alive] + 1, ADDED[s]], self.cut[alive])
        final = np.zeros(len(nodes), bool)
        final[grid[ends[self.open]].ravel()] = True
        label[final] = 0
        none = np.where(label > 0, label, 9)
        pick = none.argmin(axis=1)
        self.final = none[nodes, pick] == 9
        rank = np.where(self.final, 0, none[nodes, pick])
        jump = np.where(self.final, nodes, target[nodes, pick])
        while not self.final[jump].all():
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            jump = jump[jump]
        pick = np.where(label > 0, label * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max).argmin(axis=1)
        self.label = np.where(self.final, 0, label[nodes, pick])
        self.jumps = [np.where(self.final, nodes, target[nodes, pick])]
        while not self.final[self.jumps[-1]].all():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def state_maps(self) -> np.ndarray:
        """State behind each conversation's rows in the block, for each state before them."""
        starts = 4 * (self.first + np.arange(len(self.first)))[:, None] + np.arange(4)
        return self.jumps[-1][starts] % 4

    def edits(self) -> dict[str, pa.Array]:
        """The least paths' arcs in order."""
        groups = np.arange(len(self.first))
        node, at, group = 4 * (self.first + groups) + self.entry, np.zeros(len(groups), np.int64), groups
        alive = ~self.final[node]
        node, at, group = node[alive], at[alive], group[alive]
        for k in range(len(self.jumps) - 1, -1, -1):
            far = self.jumps[k][node]
            go = ~self.final[far]
            node, at, group = (np.concatenate([x, y[go]]) for x, y in ((node, far), (at, at + (1 << k)), (group, group)))
        order = np.lexsort((at, group))
        node, at, group = node[order], at[order], group[order]
        row = np.minimum(node // 4 - group, self.last[group])
        label, after = self.label[node], self.jumps[0][node] % 4
        stays = (label == 3) | (label == 4)
        cost = np.array([0, DELETE, INSERT, KEEP, REROLE])[label] + np.where(stays, self.cut[row], 0)
        new = (label == 2) | (label == 4)
        role = pa.array(np.where(after == USER, "user", "assistant"), pa.string(), mask=~new) if len(node) else pa.array([], pa.string())
        return {"conv": self.conv.take(pa.array(row, pa.int64())), "place": pa.array(self.place[row], pa.int64()), "step": pa.array(at, pa.int64()),
                "edit": pa.array(LETTERS[label].tolist(), pa.string()), "new_role": role, "cost": pa.array(cost, pa.int64())}


def _swept(rows: DataFrame, messages: DataFrame | None, use, schema: str) -> DataFrame:
    """Apply ``use`` (rows, messages of a block -> columns) block by block; messages come before the rows of their block."""
    rows = rows.select("conv", "place", "initial", "fault", F.shiftright("place", BLOCK_BITS).alias("block"))
    if messages is not None:
        first = messages.withColumn("place", F.lit(-1).cast("long"))
        rows = rows.unionByName(first, allowMissingColumns=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ("block",)):
            told = int((t["place"].to_numpy() == -1).sum())
            block = Block(t.slice(told))
            if told:
                block.border(t.slice(0, told))
            yield pa.RecordBatch.from_pydict(use(block, t["block"][0].as_py()))

    return rows.repartition("block").sortWithinPartitions("block", "place").mapInArrow(each, schema)


def _segments(block: Block, number: int) -> dict[str, pa.Array]:
    """Per conversation in the block: role initials at its ends, pairs inside that aren't legal, cost matrix at the block's edges."""
    pair = np.array([a + b for a, b in zip(block.initial[:-1], block.initial[1:])], object)
    same = block.segment[1:] == block.segment[:-1]
    bad = (same & ~np.isin(pair, ["su", "ua", "au"])).nonzero()[0] if len(pair) else np.empty(0, np.int64)
    illegal = np.bincount(block.segment[bad], minlength=len(block.first))
    ends = block.matrices()[block.first].reshape(-1, 16)
    edge = {0, len(block.first) - 1}
    matrices = [ends[g].tolist() if g in edge else None for g in range(len(ends))]
    take = lambda i: block.conv.take(pa.array(i, pa.int64()))
    return {"conv": take(block.first), "block": pa.array([number] * len(block.first), pa.int64()), "illegal": pa.array(illegal, pa.int64()),
            "head": pa.array(block.initial[block.first].tolist(), pa.string()), "tail": pa.array(block.initial[block.last].tolist(), pa.string()),
            "matrix": pa.array(matrices, pa.list_(pa.int64()))}


def _behind(t: pa.Table) -> pa.Table:
    """Distances behind each block of one conversation, from the matrices of the blocks that follow."""
    t = t.sort_by("block")
    exits, far = [], AT_END
    for m in reversed(t["matrix"].to_pylist()):
        exits.append(far.tolist())
        far = np.min(np.array(m).reshape(4, 4) + far[None, :], axis=1)
    n = t.num_rows
    return pa.table({"conv": t["conv"], "block": t["block"], "exits": pa.array(exits[::-1], pa.list_(pa.int64())),
                     "open": pa.array([k < n - 1 for k in range(n)]), "entry": pa.nulls(n, pa.int64())})


def _before(t: pa.Table) -> pa.Table:
    """State before each block of one conversation, from the state maps of the blocks before."""
    t = t.sort_by("block")
    entries, state = [], START
    for m in t["map"].to_pylist():
        entries.append(state)
        state = m[state]
    return pa.table({"conv": t["conv"], "block": t["block"], "entry": pa.array(entries, pa.int64())})


def solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, segments) of ``with_faults`` rows.

    Edits: (conv, place, step, edit, new_role, cost); (place, step) is their order, an insert carries the place of a neighbour.
    Segments: one row per conversation and block, see _segments.
    """
    segments = stored(_swept(rows, None, _segments, "conv string, block long, illegal long, head string, tail string, matrix array<long>"), "repair-segments")
    edges = segments.where(F.col("matrix").isNotNull()).select("conv", "block", "matrix")
    borders = "conv string, block long, exits array<long>, open boolean, entry long"
    behind = stored(edges.groupBy("conv").applyInArrow(_behind, borders), "repair-behind")

    def maps(block: Block, number: int) -> dict[str, pa.Array]:
        block.ranked_arcs()
        g = sorted({0, len(block.first) - 1})
        return {"conv": block.conv.take(pa.array(block.first[g], pa.int64())), "block": pa.array([number] * len(g), pa.int64()),
                "map": pa.array(block.state_maps()[g].tolist(), pa.list_(pa.int64()))}

    found = _swept(rows, behind, maps, "conv string, block long, map array<long>")
    before = found.groupBy("conv").applyInArrow(_before, "conv string, block long, entry long")
    known = stored(behind.drop("entry").join(before, ["conv", "block"]), "repair-borders")

    def edits(block: Block, number: int) -> dict[str, pa.Array]:
        block.ranked_arcs()
        return block.edits()

    schema = "conv string, place long, step long, edit string, new_role string, cost long"
    return stored(_swept(rows, known, edits, schema), "repair-edits"), segments


def illegal_pairs(segments: DataFrame) -> DataFrame:
    """(conv, illegal): adjacent role initials other than su, ua, au, inside blocks and across their borders."""
    before = F.lag("tail").over(Window.partitionBy("conv").orderBy("block"))
    across = ~F.concat(before, F.col("head")).isin("su", "ua", "au")
    rows = segments.select("conv", (F.col("illegal") + F.coalesce(across, F.lit(False)).cast("long")).alias("illegal"))
    return rows.groupBy("conv").agg(F.sum("illegal").alias("illegal"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the turn that remains: (conv, place, step, edit, cost, role, text); deleted rows have neither role nor text."""
    texts = rows.select("place", "role", "text")
    stays, new = F.col("edit").isin("K", "R"), F.col("edit") == "I"
    all_edits = edits.withColumn("at", F.when(stays, F.col("place")))
    joined = all_edits.join(texts.withColumnRenamed("place", "at"), "at", "left")
    return joined.select("conv", "place", "step", "edit", "cost", F.coalesce("new_role", "role").alias("role"),
                         F.when(new, "").otherwise(F.col("text")).alias("text"))


def digested(turns: DataFrame) -> DataFrame:
    """(conv, audit, cost, repaired_sha256): letters in order and the hash of ``role:text`` lines.

    A hash has to see a conversation's turns in order, so one task reads them; it holds one batch of them and the letters.
    """
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, letters, cost, sha, lines = None, [], 0, hashlib.sha256(), 0
        done: list[tuple] = []
        for batch in batches:
            for c, e, k, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "edit", "cost", "role", "text"))):
                if c != conv:
                    if conv is not None:
                        done.append((conv, "".join(letters), cost, sha.hexdigest()))
                    conv, letters, cost, sha, lines = c, [], 0, hashlib.sha256(), 0
                letters.append(e)
                cost += k
                if e != "D":
                    sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            yield _summaries(done)
            done = []
        if conv is not None:
            yield _summaries([(conv, "".join(letters), cost, sha.hexdigest())])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "place", "step")
    return ordered.mapInArrow(streamed, "conv string, audit string, cost long, repaired_sha256 string")


def _summaries(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)],
                                      names=["conv", "audit", "cost", "repaired_sha256"])


def report(conversations: DataFrame, damage=damaged) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults, cost, audit and hash of the repair of its rows after ``damage``."""
    given = conversations.select("conv_id", "turn", "role", "text")
    rows = in_order(damage(given))
    faults = with_faults(rows)
    edits, segments = solved(faults)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    sums = faults.groupBy("conv").agg(turns.alias("gaps"), *map(count, FAULTS))
    found = given.select("conv_id").distinct().withColumn("conv", key_of())
    for part in (sums, illegal_pairs(segments), digested(repaired(rows, edits))):
        found = found.join(part, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("conv_id", *map(zero, ("gaps", *FAULTS, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
