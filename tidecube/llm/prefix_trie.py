"""Conversation prefix tries: which conversations begin alike, for how long, and what storing each beginning once saves.

The trie of all conversations is cut below its heavy upper levels. What is below is dealt out by prefix and built in tasks
as succinct tries in level order (LOUDS): one bit a child and one a node, and arrays of labels beside them. Totals of
subtrees come from adding up those arrays from the last node to the first. Heavy levels are merged by Spark: every node
below or in them adds to its ancestors along the path of its smallest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecube.llm.common import written

#: A prefix with more turns of distinct conversations at and below it is an upper level.
SHARD_TURNS = 512
#: Shards are put together to tries of so many turns, which bounds a task's memory.
TRIE_TURNS = 200_000
#: Ids are joined to texts of so many at most before they meet.
IDS = 1024
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, u1 long, u2 long"
TRIES = "n_nodes long, louds binary, labels binary, n_convs binary, depth binary"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_labels(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a, b, n_bytes: each turn's place in its conversation, its role and text as 128 bits of hash, and
    the UTF-8 bytes of its text.

    Turns are in order of turn (null first), then role, then text; null roles and texts are empty; repeated rows are turns
    of their own; rows with a null conv_id are none. Texts themselves are only ordered where turns tie.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    labelled = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role"), "n_bytes": F.octet_length("text").cast("long")})
    turns = written(labelled.drop("role", "text"), "turns")
    label = F.struct("a", "b")
    tied = written(turns.groupBy("conv_id", "turn").agg(F.min(label).alias("x"), F.max(label).alias("y")).where("x <> y").select("conv_id", "turn"), "tied")
    if tied.isEmpty():
        placed = turns.withColumn("place", F.lit(0))
    else:
        t = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
        many = labelled.join(t, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).select("conv_id", "turn", "role", "text", "a", "b").distinct()
        places = many.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("place"))
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
        placed = turns.join(places, same, "left").drop("c", "t", "a2", "b2")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "place", "a", "b")).cast("long")
    return placed.select("conv_id", pos.alias("pos"), "a", "b", "n_bytes")


def with_prefixes(labels: DataFrame) -> DataFrame:
    """labels with depth, length (of the conversation), k1 and k2 (128 bits of hash of the turns so far), p1 and p2 (of those
    before). A prefix is the set of its turns with their depths, so running xors of hashes tell it."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    rows = labels.withColumn("depth", F.row_number().over(w).cast("long"))
    rows = rows.withColumns({"h1": F.xxhash64("depth", "a", "b"), "h2": F.xxhash64(F.lit(1), "b", "a", "depth")})
    rows = rows.withColumns({"k1": F.bit_xor("h1").over(w), "k2": F.bit_xor("h2").over(w), "length": F.count("*").over(Window.partitionBy("conv_id"))})
    back = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}
    return rows.withColumns(back).select("conv_id", "depth", "length", "a", "b", "n_bytes", "k1", "k2", "p1", "p2")


def same_conversations(ends: DataFrame) -> DataFrame:
    """Of ends(k1, k2, conv_id): k1, k2, conv_id (the smallest), copies, digest (SHA-256 of the ids in order, comma-joined).

    Ids meet as texts of at most IDS each. Where there are more of one key, they are digested as they stream past.
    """
    parts = ends.groupBy("k1", "k2", F.expr(f"conv_id div {IDS}").alias("part")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    parts = written(parts.select("k1", "k2", "part", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "ends")
    found = parts.groupBy("k1", "k2").agg(F.min("least").alias("conv_id"), F.sum("n").alias("copies"), F.count("*").alias("parts"), F.first("ids").alias("ids"))
    single = found.where("parts = 1").select("k1", "k2", "conv_id", "copies", F.sha2("ids", 256).alias("digest"))
    many = written(found.where("parts > 1").select("k1", "k2", "conv_id", "copies"), "shared-ends")

    def digested(batches):
        key = state = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["k1"], r["k2"]) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (r["k1"], r["k2"]), hashlib.sha256(r["ids"].encode())
                else:
                    state.update(b"," + r["ids"].encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "digest"), x)) for x in out], DIGESTS)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "digest"), (*key, state.hexdigest())))], DIGESTS)

    long = parts.join(many.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "part", "ids")
    long = long.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInArrow(digested, "k1 long, k2 long, digest string")
    return single.unionByName(many.join(long, ["k1", "k2"]))


DIGESTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())])


class Trie:
    """A forest in level order. `bits` has a 1 for each child and then a 0, for a root above all trees and then for each node."""

    def __init__(self, bits: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[int]):
        self.bits, self.a, self.b = bits, a, b
        #: levels[d] is the first node of depth d, counting from 0
        self.levels = levels

    @classmethod
    def built(cls, parents: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> Trie:
        """From each level's nodes: their parents' numbers plus one (0 is the root above all) in rising order, their labels."""
        n = sum(map(len, parents))
        degree = np.bincount(np.concatenate(parents), minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degree + 1) - 1] = False
        return cls(bits, np.concatenate(a), np.concatenate(b), np.cumsum([0, *map(len, parents)]).tolist())

    def parents(self) -> np.ndarray:
        """Of each node; -1 for a tree's root. The zeros before a node's 1 are the nodes whose children are done."""
        return (np.cumsum(~self.bits)[self.bits] - 1).astype(np.int64)

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1)[1:] - 1

    def children(self, node: int) -> range:
        """Of a node, of -1 the trees' roots."""
        zeros = np.flatnonzero(~self.bits)
        first = zeros[node] + 1 if node >= 0 else 0
        done = int(np.count_nonzero(self.bits[:first]))
        return range(done, done + int(zeros[node + 1] - first))

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level to the first."""
        total, up = values.astype(np.int64), self.parents()
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1]):
            np.add.at(total, up[lo:hi], total[lo:hi])
        return total


def built_trie(rows: dict[str, np.ndarray]) -> tuple[Trie, dict[str, np.ndarray]]:
    """The trie of rows in order of shard, conversation and depth, each conversation from its shard's top on; and for each node
    n (conversations), least, size (bytes of its turn), depth, end (its row where a conversation ends, else -1), shard's first row."""
    new_shard = np.r_[True, (rows["s1"][1:] != rows["s1"][:-1]) | (rows["s2"][1:] != rows["s2"][:-1])]
    starts = np.flatnonzero(new_shard | np.r_[True, rows["conv_id"][1:] != rows["conv_id"][:-1]])
    length = np.diff(starts, append=len(new_shard))
    at = np.cumsum(new_shard)[starts] - 1  # at first, trees in place of nodes
    parents, labels_a, labels_b, found, first_node = [], [], [], [], 0
    active = np.arange(len(starts))
    for level in range(int(length.max())):
        active = active[length[active] > level]
        row = starts[active] + level
        group, a, b = at[active], rows["a"][row], rows["b"][row]
        order = np.lexsort((b, a, group))
        g, x, y = group[order], a[order], b[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = row[order[new]]
        n = len(one)
        node = {"n": np.zeros(n, np.int64), "least": np.full(n, np.iinfo(np.int64).max), "size": rows["n_bytes"][one], "depth": rows["depth"][one], "end": np.full(n, -1), "row": one}
        np.add.at(node["n"], number, rows["copies"][row])
        np.minimum.at(node["least"], number, rows["conv_id"][row])
        ends = length[active] == level + 1
        node["end"][number[ends]] = row[ends]
        parents.append(np.zeros(n, np.int64) if level == 0 else g[new] + 1)
        labels_a.append(x[new])
        labels_b.append(y[new])
        found.append(node)
        at[active] = number + first_node
        first_node += n
    trie = Trie.built(parents, labels_a, labels_b)
    return trie, {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def trie_chunks(batches, most: int) -> Iterator[tuple[dict[str, np.ndarray], pa.Table]]:
    """Whole shards, put together until there are `most` turns."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        s1, s2 = table.column("s1").to_numpy(), table.column("s2").to_numpy()
        cut = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
        if not len(cut):
            continue
        cut = int(cut[-1]) + 1
        yield arrays(table.slice(0, cut)), table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield arrays(table), table


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in ("s1", "s2", "conv_id", "depth", "a", "b", "n_bytes", "copies")}


def shard_nodes(batches) -> Iterator[pa.RecordBatch]:
    for rows, table in trie_chunks(batches, TRIE_TURNS):
        trie, node = built_trie(rows)
        up, degree = trie.parents(), trie.degrees()
        leaves, saved = trie.below(degree == 0), trie.below((node["n"] - 1) * node["size"])
        digest = table.column("digest").combine_chunks().take(pa.array(np.where(node["end"] < 0, 0, node["end"])))
        digest = pc.if_else(pa.array(node["end"] >= 0), digest, EMPTY)
        top = up < 0
        parent = pa.array(node["least"][np.where(top, 0, up)], mask=top)
        keys = [table.column(c).combine_chunks().take(pa.array(node["row"])) for c in ("u1", "u2")]
        out = [node["least"], node["depth"], parent, node["n"], degree.astype(np.int64), leaves, saved, digest, top, *keys]
        batch = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], [c.split()[0] for c in NODES.split(", ")])
        for lo in range(0, batch.num_rows, 10_000):
            yield batch.slice(lo, 10_000)


def shard_tries(batches) -> Iterator[pa.RecordBatch]:
    for rows, _ in trie_chunks(batches, TRIE_TURNS):
        trie, node = built_trie(rows)
        labels = np.stack([trie.a, trie.b], axis=1).astype("<i8").tobytes()
        values = [len(trie.a), np.packbits(trie.bits, bitorder="little").tobytes(), labels, node["n"].astype("<i8").tobytes(), node["depth"].astype("<i8").tobytes()]
        yield pa.RecordBatch.from_pylist([dict(zip(("n_nodes", "louds", "labels", "n_convs", "depth"), values))])


class Cut:
    """Conversations dealt out: `upper` are the heavy prefixes' nodes, `above` the turns in them, `below` all other turns
    with their shard (s1, s2) and what it hangs from (u1, u2)."""

    def __init__(self, labels: DataFrame, ids: DataFrame, shard_turns: int):
        paths = written(with_prefixes(labels), "paths")
        ends = paths.where("depth = length").select("k1", "k2", "conv_id")
        turnless = ids.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
        kinds = written(same_conversations(ends.unionByName(turnless)), "kinds")
        self.at_root = kinds.where("k1 = 0 and k2 = 0").select("digest")
        kept = paths.join(kinds.select("conv_id", "copies", "digest"), "conv_id").withColumn("digest", F.when(F.col("depth") == F.col("length"), F.col("digest")))
        kept = written(kept, "kinds-of-paths")
        node = [F.min("conv_id").alias("least"), F.sum("copies").alias("n_convs"), F.max("digest").alias("digest")]
        node += [F.first(c).alias(c) for c in ("depth", "p1", "p2", "n_bytes")]
        heavy = kept.groupBy("k1", "k2").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), *node)
        self.upper = written(heavy.where(F.col("weight") > shard_turns).drop("weight"), "upper")
        told = kept.join(self.upper.select("k1", "k2", F.lit(True).alias("heavy")), ["k1", "k2"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        light = F.when(~F.col("heavy"), F.struct("k1", "k2", "p1", "p2"))
        first = F.first(light, ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        told = written(told.withColumn("x", first), "dealt")
        self.above = told.where("heavy").select("conv_id", "depth", "k1", "k2")
        cols = ["conv_id", "depth", "a", "b", "n_bytes", "copies", "digest"]
        below = told.where("not heavy").select(F.col("x.k1").alias("s1"), F.col("x.k2").alias("s2"), F.col("x.p1").alias("u1"), F.col("x.p2").alias("u2"), *cols)
        self.below = below.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id", "depth")


def packed_tries(labels: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The tries below the upper levels themselves: n_nodes, louds (bits, eight a byte, lowest first), labels (two signed 64-bit
    little-endian numbers a node), n_convs and depth (one each). Trie navigates them."""
    return Cut(labels, labels.select("conv_id").distinct(), shard_turns).below.mapInArrow(shard_tries, TRIES)


def prefix_trie(labels: DataFrame, ids: DataFrame | None = None, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each distinct beginning of the conversations in labels(conv_id, pos, a, b, n_bytes).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless
    nodes in the subtree), saved_tokens (bytes that all members but one hold in vain, over the subtree), ends_sha256 (of the
    ids of the conversations that end here). ids(conv_id): all conversations, those without turns too, which end at the root;
    unset, those in labels. Beginnings are told apart by 128 bits of hash. Null ids are left out, repeated ids are one
    conversation, other columns are left alone; without any conversation there is no root and no row.
    """
    ids = written((labels if ids is None else ids).select("conv_id").where("conv_id is not null").distinct(), "conversations")
    cut = Cut(labels, ids, shard_turns)
    nodes = written(cut.below.mapInArrow(shard_nodes, NODES), "nodes")
    tops = nodes.where("top")
    key = lambda a, b: [F.col(a).alias("k1"), F.col(b).alias("k2")]
    children = cut.upper.select(*key("p1", "p2")).unionByName(tops.select(*key("u1", "u2"))).groupBy("k1", "k2").agg(F.count("*").alias("n_children"))
    upper = cut.upper.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    #: what each upper node and each shard adds, at a depth of the path of its smallest conversation
    own = upper.select(F.col("least").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    hung = tops.where("depth > 1").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    adds = own.unionByName(hung).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    sums = cut.above.join(adds, ["conv_id", "depth"], "left").select("k1", "k2", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens"))
    sums = sums.groupBy("k1", "k2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = written(upper.join(sums, ["k1", "k2"]), "merged")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    all_ids = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    firsts = [F.col(c) for c in ("n_leaves", "saved_tokens")]
    firsts = upper.where("depth = 1").select(*firsts).unionByName(tops.where("depth = 1").select(*firsts))
    sums = firsts.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = all_ids.join(sums).join(cut.at_root.agg(F.coalesce(F.max("digest"), F.lit(EMPTY)).alias("ends_sha256")))
    root = root.withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")}).select(*out)
    known = upper.select(*key("k1", "k2"), F.col("least").alias("parent_conv_id"))
    known = known.unionByName(all_ids.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("conv_id").alias("parent_conv_id")))
    named = upper.select(F.col("least").alias("conv_id"), "depth", *key("p1", "p2"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))
    named = named.unionByName(tops.select("conv_id", "depth", *key("u1", "u2"), *out[3:])).join(known, ["k1", "k2"]).select(*out)
    return root.unionByName(named).unionByName(nodes.where("not top").select(*out))
