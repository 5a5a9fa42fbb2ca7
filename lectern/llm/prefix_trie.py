"""Prefix trie of conversations.

A conversation is its sequence of turn ids (128 bits of role and text). Sorted
conversations are dealt into range shards. In a shard, matrices of turn ids, padded to the
longest of their rows and cut into panels of columns, are put in order by lexsort; the
OR-accumulated changes of columns between neighbouring rows mark where a node
starts, and reduceat sums every depth over the rows of each node, from the deepest up.

Only nodes on the paths of a shard's first and last row can go on in another shard.
They leave it as two rows of partial sums, one for either path, which are combined in
groups of neighbouring shards by the same steps, and again, until one group is left.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise, only
from lectern.llm.importance import CRC_SQL, crc_sql

#: Turns of a shard, or so; a conversation of any length is in one.
SHARD_TURNS = 200_000
#: Columns of a matrix.
PANEL = 32
#: Shards whose boundaries one task combines.
GROUP = 256
#: Conversation ids in a piece of a list that goes on in other shards.
PIECE_IDS = 8_192
#: Conversations that share their first turns, and how many turns that can be.
FAMILY, SHARED = 20, 4

_NONE = np.iinfo(np.int64).max
_PAD = np.iinfo(np.int64).min
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "kind string, shard long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string"
BLOBS = ["path", "count", "least", "kids", "leaves", "saved", "words"]
ROW = NODE + ", side int, part long, " + ", ".join(f"{b} binary" for b in BLOBS)
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in ROW.split(", ")])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation with the first turns of its family's first in place of its own.

    ``path`` has two longs for each turn, ``words`` the number of words of its text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    half = lambda *c: F.greatest(F.xxhash64(*c), F.lit(_PAD + 1))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), half(role, text).alias("hi"), half(F.lit(7), text, role).alias("lo"), words.alias("words"))
    kept = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    own = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own")).withColumn("own", F.transform("own", lambda t: F.struct(t["hi"], t["lo"], t["words"])))
    own = materialise(own, "turns")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("own", 1, SHARED - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    j = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "family", "left").withColumn("h", h)
    shared = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    turns = F.concat(shared, F.slice("own", F.col("h") + 1, F.size("own")))
    out = j.select("conv_id", turns.alias("turns"))
    out = materialise(out.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"]))).alias("path"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words")), "rebuilt")
    drop_table(own)
    return out


class Rows:
    """Rows in order: turn ids (n, 2) and their bounds; for every depth from 0 of each row its partial sums, ``words`` included."""

    def __init__(self, path: np.ndarray, length: np.ndarray, cells: dict[str, np.ndarray]):
        self.path, self.length, self.cells = path, length, cells
        self.turn_at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self.cell_at = self.turn_at[:-1] + np.arange(len(length))

    def panel(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Turn ids of PANEL turns from ``start`` on, a row of the padded matrix for each of ``rows``."""
        width = min(PANEL, int(self.length[rows].max()) - start)
        at = self.turn_at[rows][:, None] + start + np.arange(width)
        inside = start + np.arange(width) < self.length[rows][:, None]
        out = np.full((len(rows), width, 2), _PAD, np.int64)
        out[inside] = self.path[at[inside]]
        return out.reshape(len(rows), width * 2)


def sorted_order(path: np.ndarray, length: np.ndarray, conv_id: np.ndarray) -> np.ndarray:
    """The order of rows by path, a prefix first, then conv_id: panel by panel, each within the groups that the last left equal."""
    rows = Rows(path, length, {})
    place = np.zeros(len(length), np.int64)  # where a row's group of equal rows begins
    order = np.lexsort((conv_id,))
    start, active = 0, order
    while len(active := active[length[active] > start]):
        m = rows.panel(active, start)
        by = np.lexsort((*m.T[::-1], place[active]))  # stable: conv_id breaks ties
        m, active = m[by], active[by]
        group = place[active]
        ended = np.bincount(place[length <= start], minlength=len(length))  # they come first
        first = np.concatenate([[True], group[1:] != group[:-1]])
        new = first | np.concatenate([[True], (m[1:] != m[:-1]).any(axis=1)])
        at = np.arange(len(active))
        begins = at[first][np.cumsum(first) - 1]
        inner = at[new][np.cumsum(new) - 1] - begins
        place[active] = group + ended[group] + inner
        start += PANEL
    return np.lexsort((conv_id, place))


def shared_turns(rows: Rows) -> np.ndarray:
    """Of each row, the turns that it begins with like the row before; -1 for the first row."""
    n = len(rows.length)
    shared = np.full(n, -1, np.int64)
    shared[1:] = 0
    start, active = 0, np.arange(1, n)
    while len(active := active[(shared[active] == start) & (np.minimum(rows.length[active], rows.length[active - 1]) > start)]):
        both, at = np.unique(np.concatenate([active, active - 1]), return_inverse=True)
        m = rows.panel(both, start).reshape(len(both), -1, 2)
        change = (m[at[: len(active)]] != m[at[len(active) :]]).any(axis=2)
        np.logical_or.accumulate(change, axis=1, out=change)
        same = np.minimum((~change).sum(axis=1), np.minimum(rows.length[active], rows.length[active - 1]) - start)
        shared[active] += same
        start += PANEL
    return shared


def _keys(turns: np.ndarray) -> list[str]:
    """Keys of a path's prefixes, the empty one first."""
    h, out = xxhash.xxh3_128(), []
    out.append(h.hexdigest())
    for turn in turns:
        h.update(turn.tobytes())
        out.append(h.hexdigest())
    return out


def aggregate(rows: Rows, shared: np.ndarray, whole: bool):
    """(nodes, bounds, edge, keys): columns of the nodes that are complete, two rows of partial sums for those that may go on elsewhere.

    ``edge`` has for each row the depth down to which it lies on the first or last row's path; with ``whole`` nothing goes on.
    """
    n, length, at, cells = len(rows.length), rows.length, rows.cell_at, rows.cells
    like_first = np.minimum.accumulate(np.concatenate([length[:1], shared[1:]]))
    like_last = np.minimum.accumulate(np.concatenate([shared[1:], length[-1:]])[::-1])[::-1]
    on_last = like_last > like_first
    edge = np.full(n, -1, np.int64) if whole else np.maximum(like_first, like_last)
    keys = [] if whole else [_keys(rows.path[rows.turn_at[r] : rows.turn_at[r + 1]]) for r in (0, n - 1)]
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out, waiting = [], None
    deepest = np.argsort(-length, kind="stable")
    until = np.searchsorted(-length[deepest], -np.arange(int(length.max()) + 1), "right")
    for depth in range(int(length.max()), -1, -1):
        live = np.sort(deepest[: until[depth]])
        cell = at[live] + depth
        begins = np.flatnonzero(shared[live] < depth)
        top = live[begins]
        count = np.add.reduceat(cells["count"][cell], begins)
        least = np.minimum.reduceat(cells["least"][cell], begins)
        child = (length[live] > depth) & (shared[live] <= depth)
        kids = np.add.reduceat(child + cells["kids"][cell], begins)
        open_ = edge[top] >= depth
        inner = edge[live] < depth
        leaves[live] += np.where(inner, cells["leaves"][cell], 0)
        saved[live] += np.where(inner, cells["saved"][cell], 0)
        leaves[top] += np.where(open_, 0, kids == 0)
        saved[top] += np.where(open_, 0, (count - 1) * cells["words"][cell[begins]])
        if waiting is not None:  # nodes one deeper learn their parent
            rows_, cols = waiting
            p = np.searchsorted(top, rows_, "right") - 1
            cols["parent_conv_id"] = np.where(open_[p], _NONE, least[p])
            out.append(cols)
        done = np.flatnonzero(~open_)
        all_leaves, all_saved = np.add.reduceat(leaves[live], begins), np.add.reduceat(saved[live], begins)
        waiting = top[done], {
            "row": top[done], "depth": np.full(len(done), depth), "conv_id": least[done], "n_convs": count[done], "n_children": kids[done],
            "n_leaves": all_leaves[done], "saved_tokens": all_saved[done],
        }
    waiting[1]["parent_conv_id"] = np.full(len(waiting[0]), _NONE)
    out.append(waiting[1])
    nodes = {c: np.concatenate([x[c] for x in out]) for c in out[0]}
    r, d = nodes["row"], nodes["depth"]
    if whole:
        nodes["parent_key"] = [None] * len(r)
        return nodes, [], edge, keys
    hangs = d == edge[r] + 1
    nodes["parent_key"] = [keys[int(s)][int(e)] if x else None for x, s, e in zip(hangs, on_last[r], edge[r])]
    bounds = []
    for side, (row, like) in enumerate(((0, like_first), (n - 1, like_last))):
        size = int(length[row]) + 1
        part = {c: np.zeros(size, np.int64) for c in BLOBS[1:]}
        part["least"][:] = _NONE
        part["words"] = cells["words"][at[row] : at[row] + size]
        mine = np.flatnonzero(on_last == bool(side))  # a row's depths that both paths hold go to the first
        x = np.stack([mine, like_first[mine] + 1, like_last[mine]] if side else [np.arange(n), np.zeros(n, np.int64), like_first], axis=1)
        span = x[:, 2] - x[:, 1] + 1
        which = np.repeat(np.arange(len(x)), span)
        depth = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + x[which, 1]
        cell = at[x[which, 0]] + depth
        for c in ("count", "kids", "leaves", "saved"):
            np.add.at(part[c], depth, cells[c][cell])
        np.minimum.at(part["least"], depth, cells["least"][cell])
        np.add.at(part["leaves"], edge[mine], leaves[mine])
        np.add.at(part["saved"], edge[mine], saved[mine])
        grow = mine[(length[mine] > edge[mine]) & (shared[mine] <= edge[mine])]
        np.add.at(part["kids"], edge[grow], 1)
        bounds.append({"side": side, "path": rows.path[rows.turn_at[row] : rows.turn_at[row + 1]].tobytes()} | {c: v.tobytes() for c, v in part.items()})
    return nodes, bounds, edge, keys


def _batch(kind: str, shard: int, columns: dict, n: int) -> pa.RecordBatch:
    cols = [columns.get(f.name) for f in _SCHEMA]
    fixed = {"kind": kind, "shard": shard}
    return pa.RecordBatch.from_arrays([pa.array([fixed[f.name]] * n, f.type) if f.name in fixed else pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _node_batch(shard: int, nodes: dict, ends: list, keys: list | None) -> pa.RecordBatch:
    parent = nodes["parent_conv_id"]
    cols = {c: nodes[c] for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_key")}
    return _batch("node", shard, cols | {"parent_conv_id": pa.array(parent, mask=parent == _NONE), "ends_sha256": ends, "key": keys}, len(parent))


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _shard(piece_ids: int, batches):
    """Nodes, bounds and open lists of the rows of one range shard."""
    from pyspark import TaskContext

    only("trie")
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got).combine_chunks()
    del got
    conv_id, path, words = t.column("conv_id").to_numpy(), t.column("path").combine_chunks(), t.column("words").combine_chunks()
    length = words.value_lengths().to_numpy().astype(np.int64)
    turns, words = path.flatten().to_numpy().reshape(-1, 2), words.flatten().to_numpy()
    order = sorted_order(turns, length, conv_id)
    old_at = np.concatenate([[0], np.cumsum(length)])[:-1][order]
    length, conv_id = length[order], conv_id[order]
    of_row = np.repeat(np.arange(len(length)), length)
    take = np.repeat(old_at - (np.cumsum(length) - length), length) + np.arange(len(of_row))
    at = np.cumsum(length + 1) - (length + 1)
    n = int((length + 1).sum())
    zero = np.zeros(n, np.int64)
    of_words = np.zeros(n, np.int64)
    of_words[np.arange(len(of_row)) + of_row + 1] = words[take]
    del t, path
    rows = Rows(turns[take], length, {"count": np.ones(n, np.int64), "least": np.repeat(conv_id, length + 1), "kids": zero, "leaves": zero, "saved": zero, "words": of_words})
    shared, shard = shared_turns(rows), TaskContext.get().partitionId()
    nodes, bounds, edge, keys = aggregate(rows, shared, False)
    # rows that end at a node are the first of its rows, in order of conv_id
    run = np.concatenate([np.flatnonzero((shared < length) | np.concatenate([[True], length[1:] != length[:-1]])), [len(length)]])
    stop = np.zeros(len(length), np.int64)
    stop[run[:-1]] = run[1:]
    ends = [_digest(conv_id[r : stop[r]]) if length[r] == d else _EMPTY for r, d in zip(nodes["row"].tolist(), nodes["depth"].tolist())]
    for a in range(0, len(ends), 50_000):
        part = {c: v[a : a + 50_000] for c, v in nodes.items()}
        yield _node_batch(shard, part, ends[a : a + 50_000], None)
    yield _batch("bound", shard, {c: [b[c] for b in bounds] for c in bounds[0]}, len(bounds))
    first = np.minimum.accumulate(np.concatenate([length[:1], shared[1:]]))
    for r in run[:-1][edge[run[:-1]] == length[run[:-1]]].tolist():
        key = keys[0 if first[r] == length[r] else 1][int(length[r])]
        for k, a in enumerate(range(r, int(stop[r]), piece_ids)):
            text = ",".join(map(str, conv_id[a : min(a + piece_ids, int(stop[r]))].tolist()))
            yield _batch("ends", shard, {"key": [key], "part": [k], "path": [text.encode()]}, 1)


def _combine(whole: bool, fan: int):
    def run(table: pa.Table) -> pa.Table:
        """The bounds of neighbouring shards, as rows in their order, to nodes and the bounds of the group."""
        t = table.sort_by([("shard", "ascending"), ("side", "ascending")])
        numbers = lambda c: [np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]
        path = [x.reshape(-1, 2) for x in numbers("path")]
        length = np.array([len(x) for x in path], np.int64)
        rows = Rows(np.concatenate(path), length, {c: np.concatenate(numbers(c)) for c in BLOBS[1:]})
        shard = int(t.column("shard")[0].as_py()) // fan
        nodes, bounds, _, _ = aggregate(rows, shared_turns(rows), whole)
        of = {r: _keys(path[r]) for r in set(nodes["row"].tolist())}
        keys = [of[r][d] for r, d in zip(nodes["row"].tolist(), nodes["depth"].tolist())]
        out = [_node_batch(shard, nodes, [None] * len(keys), keys)]
        if bounds:
            out.append(_batch("bound", shard, {c: [b[c] for b in bounds] for c in bounds[0]}, len(bounds)))
        return pa.Table.from_batches(out)

    return run


def _joined(batches):
    """SHA-256 of each key's pieces, which come in order; a key's rows are in one task, its text passes in pieces."""
    key, h = None, None
    names = ["key", "ends_sha256"]
    for b in batches:
        out = []
        for k, piece in zip(b.column("key").to_pylist(), b.column("path").to_pylist()):
            if k != key:
                if h:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece)
            else:
                h.update(b"," + piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=names)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is a distinct sequence of
    the first ``depth`` turns (role, text), known by its smallest conversation.

    Null roles and texts are empty ones. Turns are taken by number, null first; of equal
    numbers by role, then by a hash of role and text, so their result does not depend on the order of rows.
    Repeated rows are turns each. Rows with a null conv_id are left out. A
    conversation's turns (their ids, not texts) are one row; texts of any length are hashed where they are read. Other
    columns are not read. No conversations, no nodes.
    """
    paths = rebuilt(conversations)
    n, turns = paths.agg(F.count("*"), F.sum(F.size("words") + 1)).first()
    shards = max(1, -(-(turns or 0) // SHARD_TURNS))
    dealt = paths.repartitionByRange(shards, "path", "conv_id")
    level = materialise(dealt.mapInArrow(partial(_shard, PIECE_IDS), ROW), "trie")
    ends = level.where("kind = 'ends'").select("key", "shard", "part", "path")
    node = level.where("kind = 'node'").withColumn("level", F.lit(0))
    bounds, upper, depth, last = level.where("kind = 'bound'"), node.limit(0), 0, not n
    while not last:
        last = bounds.select(F.max("shard")).first()[0] < GROUP
        group = F.floor(F.col("shard") / GROUP).alias("g")
        level = materialise(bounds.groupBy(group).applyInArrow(_combine(last, GROUP), ROW), "trie")
        depth += 1
        upper = upper.unionByName(level.where("kind = 'node'").withColumn("level", F.lit(depth)))
        bounds = level.where("kind = 'bound'")
    hashed = ends.repartition("key").sortWithinPartitions("key", "shard", "part").select("key", "path").mapInArrow(_joined, "key string, ends_sha256 string")
    hashed = materialise(hashed.select("key", F.col("ends_sha256").alias("__ends")), "ends")
    # parents in a bound: once a shard, so no key has more rows than there are shards
    named = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    lone, hanging = node.where("parent_key is null"), node.where("parent_key is not null")
    asked = hanging.union(upper).where("parent_key is not null").select("level", "shard", "parent_key").distinct()
    told = materialise(asked.join(named, "parent_key"), "parents")
    at, nothing = ["level", "shard", "parent_key"], F.lit(None).cast("string").alias("__ends")

    def result(rows: DataFrame) -> DataFrame:
        ends_of = F.coalesce("ends_sha256", "__ends", F.lit(_EMPTY)).alias("ends_sha256")
        parent = F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id")
        return rows.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", ends_of)

    out = result(lone.select("*", nothing, F.lit(None).cast("long").alias("__parent")))
    out = out.union(result(hanging.join(told, at).select("*", nothing)))
    return out.union(result(upper.join(told, at, "left").join(hashed, "key", "left")))


SQL = (
    "WITH "
    + CRC_SQL.strip()
    + r""",
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS family, hex(encode(conv_id::VARCHAR)) AS hx FROM (SELECT DISTINCT conv_id FROM t)),
hs AS (SELECT conv_id, family, """
    + crc_sql("hx")
    + r""" % 4 AS h FROM c, crc),
turns AS (
  SELECT hs.conv_id, t.i AS k, t.id, t.words FROM hs JOIN t ON t.conv_id = hs.family AND t.i <= h
  UNION ALL SELECT hs.conv_id, 1000000 + t.i, t.id, t.words FROM hs JOIN t ON t.conv_id = hs.conv_id AND t.i > h),
s AS (SELECT hs.conv_id, coalesce(list(id ORDER BY k) FILTER (k IS NOT NULL), []) AS ids, coalesce(list(words ORDER BY k) FILTER (k IS NOT NULL), []) AS ws FROM hs LEFT JOIN turns USING (conv_id) GROUP BY hs.conv_id),
p AS (
  SELECT conv_id, d AS depth, len(ids) AS l, md5(array_to_string(ids[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], ',')) END AS parent,
    CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words
  FROM s, unnest(range(0, len(ids) + 1)) u(d)),
n AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
up AS (
  SELECT a.depth, a.node, b.n_children, (b.n_convs - 1) * b.words AS saved
  FROM m b JOIN p bp ON bp.conv_id = b.conv_id AND bp.depth <= b.depth JOIN m a ON a.depth = bp.depth AND a.node = bp.node),
sums AS (SELECT depth, node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (depth, node) LEFT JOIN m q ON q.depth = m.depth - 1 AND q.node = m.parent
"""
)
