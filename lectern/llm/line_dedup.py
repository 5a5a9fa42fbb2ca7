"""Line dedup: one occurrence stays of each connected group of near-equal lines.

Lines are normalised (lower case, ASCII punctuation to spaces, runs of spaces to
one) and fingerprinted by SimHash over their word pairs. Lines whose 64-bit
SimHashes are within three bits are a fifth of the near ones at best: a word
changed in ten turns more. So pigeonhole blocks are not cut from that one value.
The fingerprint has BLOCKS blocks, each of them a hash of a sample of the word
pairs, on which an edit elsewhere has no effect; lines that differ in all but
one of the blocks still meet. Pairs that meet, have SimHashes nearer than chance
has them and lengths that allow it are verified by edit similarity.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import FILTER_BITS, drop_table, held, materialise, membership, mixed, only, portions
from lectern.operators.components import connected_components

#: Blocks of a fingerprint.
BLOCKS = 8
#: Bits in which SimHashes of near lines may differ (chance gives 32), and the allowance for a line of few characters.
NEAR_BITS, SHORT_BITS = 19, 200
#: Lines of a list's cell: a longer list is dealt into cells, and each pair of cells is one row of work. No pair depends on it.
LONG_LIST = 64
#: Characters up to which distances are taken for many pairs at once, and the pairs; fewer than FEW go one by one.
SHORT_LINE, TOGETHER, FEW = 2048, 1024, 24
#: Pairs that a task gathers, and their characters, so that those of like length are taken together.
GATHERED, GATHERED_CHARS = 1 << 14, 1 << 24
#: Words that a script which proves similarity may delete and insert; a longer one costs more than the distance.
SCRIPT_WORDS = 24
#: Lines are near-equal from this edit similarity, 1 - distance / longer length.
SIMILARITY = 0.8

_SPACES = bytes(b if not (b < 128 and not chr(b).isalnum()) else 32 for b in range(256))


def normalised_lines(text: bytes | None) -> list[list[bytes]]:
    """The words of each line, normalised; [] for a line without any."""
    if not text:
        return []
    low = text.decode("utf-8", "replace").lower().encode()
    return [line.translate(_SPACES).split() for line in low.split(b"\n")]


class Lines:
    """The lines with a word of some texts, taken apart at once: ``text`` and ``no`` of each, its normalised bytes, and the hashes of its words.

    A word's hash is a polynomial of its bytes modulo 2**64, a difference of two prefix sums; it is mixed before use.
    """

    def __init__(self, texts: list[bytes | None]):
        low = [(t or b"").decode("utf-8", "replace").lower().encode() for t in texts]
        raw = np.frombuffer(b"\n".join(low).translate(_KEEP_LINES) + b"\n", np.uint8)
        breaks = np.flatnonzero(raw == 10)
        inside = (raw != 32) & (raw != 10)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.insert(edge, 0, 0)
        starts, ends = edge[::2], edge[1::2]
        line = np.searchsorted(breaks, starts)
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
        self.sizes = np.diff(np.append(first, len(line)))
        # one space after each word but the last of its line
        kept, last = inside.copy(), np.append(first[1:], len(line)) - 1 if len(line) else first
        kept[np.delete(ends, last)] = True
        self.bytes = np.where(inside, raw, np.uint8(32))[kept].tobytes()
        place = np.append(np.int32(0), np.cumsum(kept, dtype=np.int32))
        self.from_, self.to = place[starts[first]], place[ends[last]]
        lead = np.append(np.int32(0), np.cumsum((raw & 0xC0 != 0x80) & kept, dtype=np.int32))
        self.chars = lead[ends[last]] - lead[starts[first]]
        self.text = np.repeat(np.arange(len(low)), [x.count(b"\n") + 1 for x in low])[line[first]]
        top = np.cumsum([0] + [x.count(b"\n") + 1 for x in low])
        self.no = line[first] - top[self.text]
        self._places = raw, starts, ends

    @cached_property
    def words(self) -> np.ndarray:
        raw, starts, ends = self._places
        words = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # some words at a time, as places count from the first one
            lo, to = starts[at], max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, "right")))
            s, e = starts[at:to] - lo, ends[at:to] - lo
            total = np.append(np.uint64(0), np.cumsum(raw[lo : ends[to - 1]] * _powers(int(e[-1]), _BASE)))
            words[at:to] = mixed((total[e] - total[s]) * _powers(int(e[-1]), _INVERSE)[s])
            at = to
        return words

    def __getitem__(self, i: int) -> bytes:
        return self.bytes[self.from_[i] : self.to[i]]

    def __len__(self) -> int:
        return len(self.sizes)

    def keys(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(self.bytes[i:j]) for i, j in zip(self.from_.tolist(), self.to.tolist())), np.uint64, len(self)).view(np.int64)

    def pair_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pairs of words in a row of each line, its ends being words too, and where each line's begin."""
        ends = np.cumsum(self.sizes)
        h = np.insert(self.words, np.concatenate([[0], ends]), np.uint64(1))
        return mixed(h[:-1] * _MUL + h[1:]), ends - self.sizes + np.arange(len(self))


_KEEP_LINES = bytes(10 if b == 10 else x for b, x in enumerate(_SPACES))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_held: dict[int, np.ndarray] = {}
#: Bytes of a text whose words are hashed at once.
_SEGMENT = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64; those of a segment are kept."""
    if base in _held and n <= _SEGMENT:
        return _held[base][:n]
    out = np.full(max(n, _SEGMENT), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    _held[base] = out[:_SEGMENT].copy()
    return out[:n]


def pair_hashes(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines given as words."""
    return Lines([b"\n".join(map(b" ".join, lines))]).pair_hashes()


def simhashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each line: bit i is set if most hashes from its start to the next have it."""
    bits = np.zeros((len(starts), 64), bool)
    ends = np.append(starts[1:], len(h))
    half = ((ends - starts) // 2)[:, None]
    at = 0
    while at < len(starts):  # some lines at a time, so the bit matrix stays small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        if ends[to - 1] - starts[at] <= _STEP:
            n = np.add.reduceat(_bits(h[starts[at] : ends[to - 1]]), starts[at:to] - starts[at], axis=0, dtype=np.uint8)
            bits[at:to] = n > half[at:to]
        at = to
    for i in np.flatnonzero(ends - starts > min(255, _STEP)):  # more than a byte counts, or a part of its own
        n = sum(_bits(h[lo : min(lo + _STEP, ends[i])]).sum(0, dtype=np.int64) for lo in range(starts[i], ends[i], _STEP))
        bits[i] = n > half[i]
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


_STEP = 1 << 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = mixed(np.arange(1, BLOCKS + 1, dtype=np.uint64) * _MUL) | np.uint64(1)


def blocks(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each line, of BLOCKS hashes: each of two word pairs, the first and the last in an order of its own, so one frequent pair never fills a block alone."""
    out = np.empty((len(starts), BLOCKS), np.uint64)
    for t, y in enumerate(_ORDERS):
        v = h * y
        out[:, t] = mixed(mixed(np.minimum.reduceat(v, starts) ^ y) * _MUL + np.maximum.reduceat(v, starts))
    return out


_BLOCKS = [f"b{i}" for i in range(BLOCKS)]
#: ``cells`` has the keys and the blocks of all lines of a portion, packed, in the row of its first line.
_LINES = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("line_no", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("cells", pa.binary())])
_LINES_DDL = "doc_id long, t int, line_no int, place int, key long, cells binary"
#: ``cells`` has a line's blocks, packed.
_TEXTS = pa.schema([("key", pa.int64()), ("line", pa.string()), ("chars", pa.int32()), ("sim", pa.int64()), ("cells", pa.binary())])
_TEXTS_DDL = "key long, line string, chars int, sim long, cells binary"
#: Bytes of text taken apart at once: the arrays of a larger portion leave the processor's cache.
_PORTION = 1 << 18


def _columns(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _places(docs: np.ndarray, ts: np.ndarray, nos: np.ndarray) -> np.ndarray:
    """A bit of a membership bitmap for each line of a document, by its number."""
    h = mixed(docs.astype(np.int64).view(np.uint64) * _MUL + ts.astype(np.int64).view(np.uint64))
    return (mixed(h * _MUL + nos.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int32)


def _fingerprints(batches):
    only("words")
    for b in portions(batches, _PORTION):
        lines = Lines(b.column("text").to_pylist())
        if len(lines):
            docs, ts = (b.column(c).to_numpy()[lines.text] for c in ("doc_id", "t"))
            keys = lines.keys()
            cells = np.vstack([keys, blocks(*lines.pair_hashes()).view(np.int64).T]).tobytes()
            yield _columns([docs, ts, lines.no, _places(docs, ts, lines.no), keys, [cells] + [None] * (len(lines) - 1)], _LINES)


def _line_texts(bits, batches):
    """Key, text and fingerprint of the lines whose place the bitmap has; the other lines are not taken apart again."""
    for b in portions(batches, 4 * _PORTION):
        texts = [(t or b"").split(b"\n") for t in b.column("text").to_pylist()]
        sizes = np.array([len(t) for t in texts])
        docs, ts = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("doc_id", "t"))
        nos = np.arange(len(docs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        every = list(chain.from_iterable(texts))
        lines = Lines([b"\n".join([every[i] for i in np.flatnonzero(held(bits.value, _places(docs, ts, nos))).tolist()])])
        if len(lines):
            h, starts = lines.pair_hashes()
            texts = [lines[i].decode("utf-8", "replace") for i in range(len(lines))]
            yield _columns([lines.keys(), texts, lines.chars, simhashes(h, starts).view(np.int64), _packed(blocks(h, starts))], _TEXTS)


def _packed(cells: np.ndarray) -> pa.Array:
    """A row of blocks as one value."""
    ends = pa.py_buffer(np.arange(len(cells) + 1, dtype=np.int32) * cells.itemsize * BLOCKS)
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, ends, pa.py_buffer(np.ascontiguousarray(cells))])


def _blocks_of(fields: dict[str, pa.Array]) -> np.ndarray:
    """The blocks of rows, a row for each, from ``cells`` or from a column of each block."""
    if "cells" not in fields:
        return np.stack([fields[b].to_numpy() for b in _BLOCKS], 1)
    return np.frombuffer(b"".join(fields["cells"].to_pylist()), np.int64).reshape(-1, BLOCKS)


def _portions_cells(batches) -> Iterator[pa.RecordBatch]:
    """(key, block, ...) of the lines of each portion."""
    for b in batches:
        for cells in b.column("cells"):
            columns = np.frombuffer(cells.as_buffer(), np.int64).reshape(1 + BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", *_BLOCKS])


#: Lines whose cells are sorted at once, cells of a part, and lines from which a cell is known to be a crowd's.
_SORTED, _PART, _CROWD = 1 << 17, 1 << 18, 1000
_CELLS_DDL = "part int, sure boolean, g binary, ids binary"


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(g)))


def _cells(parts: int, batches):
    """The cells of the lines, (block, key), dealt into parts by block as packed numbers.

    A crowd's block is known to be shared: three of its cells tell the block's part so, the
    others are ``sure`` and go anywhere, so that no task gets a crowd as a whole.
    """

    def dealt(some):
        keys = np.concatenate([b.column("key").to_numpy() for b in some])
        keys, first = np.unique(keys, return_index=True)
        g = np.stack([np.concatenate([b.column(c).to_numpy() for b in some])[first] for c in _BLOCKS], 1).ravel().view(np.uint64)
        order = np.argsort(g)
        g, ids = g[order], keys[order // BLOCKS]
        starts, sizes = _runs(g)
        sure = np.repeat(sizes > _CROWD, sizes) & (np.arange(len(g)) - np.repeat(starts, sizes) >= 3)
        rows = []
        for lo in range(0, int(sure.sum()), _CROWD):
            x, y = g[sure][lo : lo + _CROWD], ids[sure][lo : lo + _CROWD]
            rows.append((int(y[0] % parts), True, x.tobytes(), y.tobytes()))
        g, ids = g[~sure], ids[~sure]
        part = ((g >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts, sizes = _runs(part)
        rows += [(int(part[i]), False, g[i : i + n].tobytes(), ids[i : i + n].tobytes()) for i, n in zip(starts.tolist(), sizes.tolist())]
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "sure", "g", "ids"])

    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= _SORTED:
            yield dealt(some)
            some, n = [], 0
    if n:
        yield dealt(some)


def _shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, id, other) of the blocks of a part that lines of different keys have; ``other`` is the other line's key, if there are just two."""

    def rows(g, ids, other=None, two=None):
        for lo in range(0, len(g), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            others = pa.nulls(len(g[some]), pa.int64()) if two is None else pa.array(other[some], mask=~two[some])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[some].view(np.int64)) for x in (g, ids)), others], names=["g", "id", "other"])

    gs, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in batches:
        for sure, x, y in zip(*(b.column(c).to_pylist() for c in ("sure", "g", "ids"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
            if sure:
                yield from rows(x, y)
            else:
                gs.append(x)
                ids.append(y)
    g, ids = np.concatenate(gs), np.concatenate(ids)
    order = np.argsort(g)
    g, ids = g[order], ids[order]
    for again in (True, False):
        sizes = _runs(g)[1]
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if again:  # a line that several tasks had is one
            at = at[np.lexsort((ids[at], g[at]))]
            at = at[np.append(True, (g[at][1:] != g[at][:-1]) | (ids[at][1:] != ids[at][:-1]))] if len(at) else at
        g, ids = g[at], ids[at]
    sizes = _runs(g)[1]
    two, first = np.repeat(sizes == 2, sizes), np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes) == 0
    yield from rows(g, ids, np.where(first, np.roll(ids, -1), np.roll(ids, 1)), two)


def _common(x, y, end: bool) -> int:
    """Length of the common beginning (or end) of two sequences, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        same = x[len(x) - mid :] == y[len(y) - mid :] if end else x[:mid] == y[:mid]
        lo, hi = (mid, hi) if same else (lo, mid - 1)
    return lo


def words_bound(a: list[str], b: list[str], most: int) -> int | None:
    """An upper bound of the edit distance of two lines, from a shortest script of at most ``most`` words deleted and inserted; None if there is none.

    Furthest reaching paths by diagonal; what lies between two common runs of words costs its longer side at most.
    """
    reach, trail = {1: 0}, []
    for d in range(most + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            i = reach[k + 1] if down else reach[k - 1] + 1
            j = i - k
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i += 1
                j += 1
            reach[k] = i
            if i >= len(a) and j >= len(b):
                return _script_cost(a, b, trail)
    return None


def _script_cost(a: list[str], b: list[str], trail: list[dict[int, int]]) -> int:
    """Sum over the gaps of a script, given the paths before each of its steps, backwards."""
    i, j, total, out, into = len(a), len(b), 0, 0, 0
    for d in range(len(trail) - 1, 0, -1):
        before, k = trail[d], i - j
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        at = before[k + 1 if down else k - 1]
        if i > (at if down else at + 1):  # common words part two gaps
            total, out, into = total + max(out, into), 0, 0
        i, j = (at, at - k - 1) if down else (at, at - k + 1)
        if down:
            into += len(b[j]) + 1
        else:
            out += len(a[i]) + 1
    return total + max(out, into)


def anchored_bound(a: list[str], b: list[str]) -> int:
    """An upper bound of the edit distance of two lines, however many words differ: word pairs that each line has once stay, in the longest order common to both; a gap costs its longer side at most."""
    once = []
    for words in (a, b):
        pairs = list(zip(words, words[1:]))
        counts = Counter(pairs)
        once.append({p: i for i, p in enumerate(pairs) if counts[p] == 1})
    tops, ends = [], []
    for pair, i in once[0].items():
        j = once[1].get(pair)
        if j is not None:
            k = bisect_left(tops, j)
            tops[k : k + 1], ends[k : k + 1] = [j], [(i, j, ends[k - 1] if k else None)]
    chars = [list(accumulate((len(w) + 1 for w in words), initial=0)) for words in (a, b)]
    total, i, j, at = 0, len(a), len(b), ends[-1] if ends else None
    while at:
        p, q, at = at
        both = 2 if p + 2 <= i and q + 2 <= j else 1  # the second word, if the next pair leaves it
        total += max(chars[0][i] - chars[0][p + both], chars[1][j] - chars[1][q + both])
        i, j = p, q
    return total + max(chars[0][i], chars[1][j])


def edit_distance(a: str, b: str, most: int | None = None) -> int | None:
    """Levenshtein distance, a column of differences at a time in the bits of two integers (Hyyro's form of Myers 1999).

    None as soon as no path can end at ``most`` or less. Then the integers hold only rows of diagonals on which
    a path of ``most`` edits can lie, moved on every few columns; the others are taken for too high.
    """
    n, m = len(a), len(b)
    if most is not None and abs(n - m) > most:
        return None
    edits = n + m if most is None else most
    above, below = (edits + m - n) // 2, (edits + n - m) // 2
    where: dict[str, int] = {}
    up = down = top = low = high = at = 0
    step, check = max(64, (above + below) // 4), max(32, m // 16)
    due = check
    while at < m:
        to = min(m, at + step)
        if gone := min(max(0, at - above), n) - low:
            passed = (1 << gone) - 1
            top += (up & passed).bit_count() - (down & passed).bit_count()
            up, down, low = up >> gone, down >> gone, low + gone
            where = {c: rest for c, bits in where.items() if (rest := bits >> gone)}
        for i in range(high, min(n, to + below)):
            where[a[i]] = where.get(a[i], 0) | 1 << (i - low)
            up |= 1 << (i - low)
            high = i + 1
        ones = (1 << (high - low)) - 1
        for c in b[at:to]:
            eq = where.get(c, 0)
            zero = ((((eq & up) + up) ^ up) | eq | down) & ones
            plus = (down | (ones ^ (zero | up))) << 1 | 1
            up, down = ((zero & up) << 1 | ~(zero | plus)) & ones, plus & zero
        top, at = top + to - at, to
        if most is not None and due <= at < m:
            bits = (np.unpackbits(np.frombuffer(x.to_bytes(-(-(high - low) // 8), "little"), np.uint8), bitorder="little")[: high - low].astype(np.int32) for x in (up, down))
            column = np.append(top, top + np.cumsum(next(bits) - next(bits)))
            rest = np.abs(n - low - np.arange(len(column)) - (m - at))
            if (column + rest).min() > most:
                return None
            due = at + check
    distance = top + up.bit_count() - down.bit_count()
    return distance if most is None or distance <= most else None


def edit_similar(x: str, y: str, similarity: float = SIMILARITY) -> bool:
    """1 - distance / longer length reaches ``similarity``.

    Common ends are cut off. A script of whole words proves similarity if it is
    short enough, and so do word pairs that stay; too unlike counts of characters disprove it; else the distance decides.
    """
    most = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    n = _common(x, y, False)
    x, y = x[n:], y[n:]
    n = _common(x, y, True)
    x, y = x[: len(x) - n], y[: len(y) - n]
    if not x or not y or max(len(x), len(y)) <= most:
        return max(len(x), len(y)) <= most
    a, b = x.split(" "), y.split(" ")
    bound = words_bound(a, b, min(most // 3 + 1, SCRIPT_WORDS))
    if bound is not None and bound <= most or anchored_bound(a, b) <= most:
        return True
    counts = Counter(x)
    counts.subtract(y)
    if max(sum(v for v in counts.values() if v > 0), -sum(v for v in counts.values() if v < 0)) > most:
        return False
    return edit_distance(x, y, most) is not None


def _within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair of code arrays: is the edit distance ``most`` or less (which is at least the difference of the lengths).

    The recurrence of ``edit_distance`` for many pairs at once, in words of 64 rows, and only in those of
    diagonals on which a path of ``most`` edits can lie; the others are taken for too high. Now and then
    the pairs that no path of ``most`` edits can end any more are left out.
    """
    order = np.argsort([-len(y) for y in ys], kind="stable")
    xs, ys, most = [xs[i] for i in order], [ys[i] for i in order], most[order]
    m, n = (np.array([len(z) for z in zs]) for zs in (xs, ys))
    pairs, every, wide = len(xs), np.arange(len(xs)), (int(m.max()) + 63) // 64
    a, b = np.concatenate(xs), np.concatenate(ys)
    of_a, of_b = np.repeat(every, m), np.repeat(every, n)
    at_a = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
    # symbols: the rank of a character among those of its pair's first line, 0 if it is not there
    seen = np.zeros(int(max(a.max(), b.max())) + 1, bool)
    seen[a] = seen[b] = True
    letter = np.cumsum(seen) - 1
    there = np.zeros((pairs, int(seen.sum())), bool)
    there[of_a, letter[a]] = True
    symbol = np.cumsum(there, 1) * there
    kinds = int(symbol.max()) + 1
    masks = np.zeros(pairs * kinds * wide, np.uint64)
    np.bitwise_or.at(masks, (of_a * kinds + symbol[of_a, letter[a]]) * wide + (at_a >> 6), np.uint64(1) << (at_a & 63).astype(np.uint64))
    column = np.zeros((int(n[0]), pairs), np.int64)
    column[np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n), of_b] = (of_b * kinds + symbol[of_b, letter[b]]) * wide
    above, below = int(((most + n - m) // 2).max()), int(((most + m - n) // 2).max())
    up, down = np.full((wide, pairs), ~np.uint64(0)), np.zeros((wide, pairs), np.uint64)
    top, first, distance = np.zeros(pairs, np.int64), 0, np.full(pairs, int(most.max()) + 1, np.int64)
    one, last, limit = np.uint64(1), np.uint64(63), most
    alive, step = pairs, max(32, int(n[0]) // 8)
    for j in range(1, int(n[0]) + 1):
        low, high = max(0, j - above - 1) >> 6, min(wide - 1, (j + below - 1) >> 6)
        while first < low:  # rows that no path reaches any more: the value below them is carried on
            top += np.bitwise_count(up[first]).astype(np.int64) - np.bitwise_count(down[first])
            first += 1
        top += 1
        plus_in, minus_in = one, np.uint64(0)
        at = column[j - 1, :alive]
        for w in range(low, high + 1):
            eq, u, d = masks[at + w], up[w, :alive], down[w, :alive]
            vertical = eq | d
            eq |= minus_in
            zero = (((eq & u) + u) ^ u) | eq
            plus, minus = d | ~(zero | u), u & zero
            plus_out, minus_out = plus >> last, minus >> last
            plus, minus = (plus << one) | plus_in, (minus << one) | minus_in
            up[w, :alive], down[w, :alive] = minus | ~(vertical | plus), plus & vertical
            plus_in, minus_in = plus_out, minus_out
        while alive and n[alive - 1] == j:
            i = alive = alive - 1
            rest = [(1 << int(min(64, max(0, m[i] - 64 * w)))) - 1 for w in range(low, high + 1)]
            distance[every[i]] = top[i] + sum((int(up[w, i]) & r).bit_count() - (int(down[w, i]) & r).bit_count() for w, r in zip(range(low, high + 1), rest))
        if j % step == 0 and alive >= FEW:
            open_ = _open(up[low : high + 1, :alive], down[low : high + 1, :alive], top[:alive], 64 * low, m[:alive], n[:alive] - j, limit[:alive])
            if open_.sum() < 0.9 * alive:
                at = np.flatnonzero(open_)
                up, down, column, top, m, n, limit, every = up[:, at], down[:, at], column[:, at], top[at], m[at], n[at], limit[at], every[at]
                alive = len(at)
        if not alive:
            break
    out = np.empty(pairs, bool)
    out[order] = distance <= most
    return out


def _open(up: np.ndarray, down: np.ndarray, top: np.ndarray, row: int, m: np.ndarray, left: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Can a path from some row of a column (words from ``row`` on, of value ``top``) end at ``most`` or less, ``left`` columns further on."""
    bits = (np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8) for x in (up, down))
    column = np.cumsum(next(bits) - next(bits), axis=1, dtype=np.int16)
    ahead = (m - left - row)[:, None] - np.arange(1, column.shape[1] + 1)
    least = np.where(ahead + left[:, None] >= 0, column + np.abs(ahead), np.int64(1) << 40).min(1)
    return top + np.minimum(least, np.abs(m - left - row)) <= most


def _word_by_word(x: str, y: str) -> int | None:
    """An upper bound of the edit distance of lines with as many words, each put for the other's."""
    a, b = x.split(" "), y.split(" ")
    return sum([max(len(p), len(q)) for p, q in zip(a, b) if p != q]) if len(a) == len(b) else None


def similar(xs: list[str], ys: list[str], similarity: float = SIMILARITY, script: int = 0) -> np.ndarray:
    """``edit_similar`` of each pair; the distances of lines of usual length are taken together.

    Where most pairs are links, words in their places and scripts of up to ``script`` words are cheaper and are tried first.
    """
    out, open_ = np.zeros(len(xs), bool), []
    for i, (x, y) in enumerate(zip(xs, ys)):
        most = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
        if abs(len(x) - len(y)) > most:
            continue
        if script and (bound := _word_by_word(x, y)) is not None and bound <= most:
            out[i] = True
            continue
        if max(len(x), len(y)) > SHORT_LINE:
            out[i] = edit_similar(x, y, similarity)
            continue
        n = _common(x, y, False)
        x, y = x[n:], y[n:]
        n = _common(x, y, True)
        x, y = x[: len(x) - n], y[: len(y) - n]
        if not x or not y or max(len(x), len(y)) <= most:
            out[i] = max(len(x), len(y)) <= most
            continue
        bound = words_bound(x.split(" "), y.split(" "), min(most // 3 + 1, script)) if script else None
        if bound is not None and bound <= most:
            out[i] = True
        else:
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            open_.append((len(y), most, i, x, y))
    open_.sort(key=lambda p: p[:3])
    lo = 0
    while lo < len(open_):
        longest, hi = max(open_[lo][0] * 1.25, open_[lo][0] + 64), lo + 1
        while hi < min(len(open_), lo + TOGETHER) and open_[hi][0] <= longest:
            hi += 1
        if hi - lo < max(FEW, open_[lo][1] // 2):  # of long lines more pairs are few
            for _, most, i, x, y in open_[lo:hi]:
                out[i] = edit_distance(x, y, most) is not None
        else:
            _, most, at, a, b = zip(*open_[lo:hi])
            codes = ([np.frombuffer(z.encode("utf-32-le", "surrogatepass"), np.uint32) for z in zs] for zs in (a, b))
            out[list(at)] = _within(*codes, np.array(most))
        lo = hi
    return out


def _similar_pairs(similarity: float, batches):
    for b in _gathered(batches):
        keep = pa.array(similar(b.column("x").to_pylist(), b.column("y").to_pylist(), similarity, SCRIPT_WORDS), pa.bool_())
        for part in pa.Table.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"]).to_batches():
            yield part


def _gathered(batches) -> Iterator[pa.Table]:
    """Batches of pairs put together."""
    some, n, chars = [], 0, 0
    for b in batches:
        some.append(b)
        n, chars = n + b.num_rows, chars + b.nbytes
        if n >= GATHERED or chars >= GATHERED_CHARS:
            yield pa.Table.from_batches(some)
            some, n, chars = [], 0, 0
    if some:
        yield pa.Table.from_batches(some)


_ROW_DDL = "far boolean, id long, component long, sim long, chars int, cells binary"
#: Pairs of lines looked at in one piece.
_PIECE = 1 << 18


def _met(g: np.ndarray, cross: np.ndarray, sizes: np.ndarray, row: dict[str, np.ndarray], similarity: float):
    """Rows (i, j) of each work that meet the bounds, in pieces; lines that share several blocks meet in the list of the first."""
    ends = np.cumsum(sizes)
    end, work = np.repeat(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
    later = end - np.arange(len(end)) - 1
    upto, at = np.cumsum(later), 0
    cells = row["cells"]
    while at < len(later):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PIECE, "right")))
        n = later[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        ok = (row["component"][i] != row["component"][j]) & (~cross[work[i]] | (row["far"][i] != row["far"][j]))
        i, j = i[ok], j[ok]
        longer = np.maximum(row["chars"][i], row["chars"][j])
        ok = np.minimum(row["chars"][i], row["chars"][j]) >= longer * similarity - 1e-6
        ok &= np.bitwise_count((row["sim"][i] ^ row["sim"][j]).view(np.uint64)) <= NEAR_BITS + SHORT_BITS / longer
        i, j = i[ok], j[ok]
        same = cells[i] == cells[j]
        first = same.argmax(1)
        ok = same.any(1) & (cells[i, first] == g[work[i]])
        yield i[ok], j[ok]


def _unpacked(b: pa.RecordBatch):
    """Lists, whether two cells meet, sizes and rows of the works in a batch."""
    rows = b.column("rows")
    row = rows.flatten()
    fields = {f.name: row.field(f.name) for f in row.type}
    lo, hi = (b.column(c).to_numpy() for c in ("lo", "hi"))
    sizes = np.diff(rows.offsets.to_numpy())
    row = {k: fields[k].to_numpy(zero_copy_only=False) for k in ("far", "id", "component", "sim", "chars")} | {"cells": _blocks_of(fields)}
    return b.column("g").to_numpy(), lo != hi, sizes, row, fields


def _with_partner(similarity: float, batches):
    """The lines of each work that meet the bounds with another one."""
    for b in batches:
        g, cross, sizes, row, fields = _unpacked(b)
        some = np.zeros(len(row["id"]), bool)
        for i, j in _met(g, cross, sizes, row, similarity):
            some[i] = some[j] = True
        at, work = np.flatnonzero(some), np.repeat(np.arange(len(sizes)), sizes)
        of = pa.array(work[at])
        names = [k for k in fields]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("g", "lo", "hi")), *(fields[k].take(pa.array(at)) for k in names)], names=["g", "lo", "hi", *names])


def _links(similarity: float, batches):
    """The components that links within the works bring together, as a forest: a task has fewer rows than components.

    A pair that earlier links of the task have brought together is passed over.
    """
    up: dict[int, int] = {}

    def find(c: int) -> int:
        while (over := up.get(c, c)) != c:
            up[c] = c = up.get(over, over)
        return c

    def settled(pairs):
        pairs.sort(key=lambda p: max(len(p[2]), len(p[3])))
        found = []
        for lo in range(0, len(pairs), TOGETHER):
            open_ = [p for p in pairs[lo : lo + TOGETHER] if find(p[0]) != find(p[1])]
            if open_:
                a, b, x, y = zip(*open_)
                for i in np.flatnonzero(similar(x, y, similarity)).tolist():
                    p, q = find(a[i]), find(b[i])
                    if p != q:  # else links of these pairs have brought them together
                        up[p] = q
                        found.append((min(a[i], b[i]), max(a[i], b[i])))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    pairs, chars = [], 0
    for b in batches:
        g, cross, sizes, row, fields = _unpacked(b)
        comps, lines = row["component"].tolist(), fields["line"]
        for i, j in _met(g, cross, sizes, row, similarity):
            for lo in range(0, len(i), GATHERED):
                open_ = [(x, y) for x, y in zip(i[lo : lo + GATHERED].tolist(), j[lo : lo + GATHERED].tolist()) if find(comps[x]) != find(comps[y])]
                at = sorted({x for p in open_ for x in p})
                text = dict(zip(at, lines.take(pa.array(at, pa.int64())).to_pylist()))
                for x, y in open_:
                    pairs.append((comps[x], comps[y], text[x], text[y]))
                    chars += len(text[x]) + len(text[y])
                if len(pairs) >= GATHERED or chars >= GATHERED_CHARS:
                    yield settled(pairs)
                    pairs, chars = [], 0
    if pairs:
        yield settled(pairs)


def _lists(lines: DataFrame, n: int) -> DataFrame:
    """(g, id, other) of the lines that share a block with another one, as in ``_shared``; ``lines`` are ``n`` rows of a written table."""
    parts = max(1, n * BLOCKS // _PART)
    cells = lines.where("cells is not null").select("cells").mapInArrow(lambda batches: _cells(parts, _portions_cells(batches)), _CELLS_DDL)
    return cells.groupBy("part").applyInArrow(_shared, "g long, id long, other long")


def _works(named: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(g, lo, hi, far, id, ...): the lines of lists of several components, dealt so that any two of different components and near lengths are in one (g, lo, hi).

    ``named``: (g, id, component). Lines are in cells by their list, whether they
    are of its largest component, their length in steps of ``similarity``, and a
    hash, LONG_LIST to a cell. Two cells meet (lo, hi) unless both are of the
    largest component or no two lengths of theirs are near; ``far`` marks lines of hi.
    """
    sizes = named.groupBy("g", "component").agg(F.count("*").alias("c"))
    # in a list of two lines the hub has been tried with the other one
    open_ = sizes.groupBy("g").agg(F.sum("c").alias("m"), F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("most")).where("k > 1 and m > 2")
    rows = named.join(open_.select("g", "m", F.col("most.component").alias("largest")), "g").join(nodes, "id")
    long = F.col("m") > LONG_LIST
    # a little wider than the ratio, so rounding puts no two near lengths two bands apart
    band = F.floor(F.log(F.greatest("chars", F.lit(1)).cast("double")) / (1.001 * max(-np.log(similarity), 1e-3))).cast("long")
    rows = materialise(rows.withColumn("kind", band * 2 + (F.col("component") != F.col("largest")).cast("long")).drop("largest"), "mixed")
    parts = rows.where(long).groupBy("g", "kind").agg(F.ceil(F.count("*") / LONG_LIST).alias("many"))
    kinds = parts.groupBy("g").agg(F.collect_list(F.struct("kind", "many")).alias("kinds"))
    attributes = ("component", "sim", "chars", "cells")
    zero = F.lit(0).cast("long")
    short = rows.where(~long).select("g", zero.alias("lo"), zero.alias("hi"), F.lit(False).alias("far"), "id", *attributes)
    met = rows.where(long).join(kinds, "g").join(parts, ["g", "kind"])
    own = F.shiftleft("kind", 32) + F.pmod(F.xxhash64("id"), "many")
    near = F.filter("kinds", lambda x: (F.abs(F.shiftright(x["kind"], 1) - F.shiftright("kind", 1)) <= 1) & ((x["kind"] % 2 == 1) | (F.col("kind") % 2 == 1)))
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["many"] - 1), lambda i: F.shiftleft(x["kind"], 32) + i)))
    met = met.select("g", own.alias("own"), F.explode(others).alias("other"), "id", *attributes)
    return short.union(met.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("far"), "id", *attributes))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, lines): the numbers, from 0, of the lines of each document that an earlier near-equal line makes superfluous.

    A document is a doc_id and its text, of which ``t`` is a hash, so rows that
    repeat a doc_id with another text are documents of their own, and equal rows
    are one. Earlier is the smaller (doc_id, t, line number). Lines without a
    letter, digit or non-ASCII character belong to no group and stay. Rows with
    a null doc_id or text have no lines.
    """
    rows = _rows(docs).where("doc_id is not null")
    lines = materialise(rows.mapInArrow(_fingerprints, _LINES_DDL), "lines")
    nodes = materialise(lines.groupBy("key").agg(F.min("place").alias("home"), F.count("*").alias("n")), "nodes")
    met = materialise(_lists(lines, lines.count()), "met")
    # the line of most lists is a list's hub: of near copies, the one they come from
    weight = met.groupBy("id").agg((-F.count("*")).alias("rank"))
    keys = materialise(weight.join(nodes.select(F.col("key").alias("id"), "home"), "id"), "keys")
    found = rows.mapInArrow(partial(_line_texts, membership(keys, "home", uniform=True)), _TEXTS_DDL)
    texts = materialise(found.join(keys.select(F.col("id").alias("key")), "key", "left_semi").dropDuplicates(["key"]), "texts")
    prints = texts.select(F.col("key").alias("id"), "chars", "sim", "cells")
    # a list of two lines is their pair; the others have hubs
    two = met.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    lists = materialise(met.where("other is null").select("g", "id").join(keys.select("id", "rank").join(prints.select("id", "sim", "chars"), "id"), "id"), "lists")

    def bound(x, y):
        # the distance is at least the difference of the lengths
        long_enough = F.least(f"{x}.chars", f"{y}.chars") >= F.greatest(f"{x}.chars", f"{y}.chars") * similarity - 1e-6
        most = NEAR_BITS + SHORT_BITS / F.greatest(f"{x}.chars", f"{y}.chars")
        return long_enough & (F.bit_count(F.col(f"{x}.sim").bitwiseXOR(F.col(f"{y}.sim"))) <= most)

    def verify(pairs):
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("line").alias("y")), "b")
        # dealt anew, as long lines cost more than many short ones
        return both.repartition(F.col("a"), F.col("b")).mapInArrow(partial(_similar_pairs, similarity), "a long, b long")

    # first each line is tried with its list's hub; then what is left of lists of several components, all pairs of these
    hubs = lists.groupBy("g").agg(F.min(F.struct("rank", "id", "sim", "chars")).alias("h")).select("g", "h.*")
    pairs = lists.alias("y").join(hubs.alias("x"), F.col("x.g") == F.col("y.g")).where((F.col("x.id") != F.col("y.id")) & bound("x", "y"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    ends = prints.select("id", "sim", "chars")
    two = two.join(ends.alias("x"), F.col("a") == F.col("x.id")).join(ends.alias("y"), F.col("b") == F.col("y.id")).where(bound("x", "y")).select("a", "b")
    pairs = materialise(pairs.union(two).distinct(), "star")
    near = materialise(verify(pairs), "links")
    comp = materialise(connected_components(near), "comp")
    named = materialise(lists.select("g", "id").join(comp, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component")), "named")

    def works(rows):
        return rows.groupBy("g", "lo", "hi").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in ("g", "lo", "hi")))).alias("rows"))

    some = works(_works(named, prints, similarity)).mapInArrow(partial(_with_partner, similarity), "g long, lo long, hi long, " + _ROW_DDL)
    some = materialise(some, "works")
    more = works(some.join(texts.select(F.col("key").alias("id"), "line"), "id")).mapInArrow(partial(_links, similarity), "a long, b long")
    more = materialise(more, "links")
    # these links are of components, so only they are components' components
    over = materialise(connected_components(more).toDF("first", "over"), "comp")
    # lines with a near one, and lines that occur again; a component's name is its smallest key
    alone = nodes.where("n > 1").select("key", F.col("key").alias("first")).union(over.select("first", "first"))
    first = alone.union(comp.toDF("key", "first")).groupBy("key").agg(F.min("first").alias("first"))
    grouped = first.join(over, "first", "left").select("key", F.coalesce("over", "first").alias("component"))
    members = materialise(lines.select("doc_id", "t", "line_no", "key").join(grouped, "key"), "members")
    for table in (lines, nodes, met, keys, lists, texts, pairs, near, comp, named, some, more, over):
        drop_table(table)
    place = F.struct("doc_id", "t", "line_no")
    kept = members.groupBy("component").agg(F.min(place).alias("kept"))
    gone = members.join(kept, "component").where(place != F.col("kept"))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select("doc_id", text.alias("text"), F.hash(text).alias("t"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the texts that are left, same columns, plus __n_removed (lines taken out of the row; a caller's column of that name is replaced).

    A null text stays null, an empty one empty. Texts of any length are taken whole; an empty table gives an empty one.
    """
    gone = repeated_lines(docs, similarity)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.hash(F.col("text").cast("binary")).alias("t"))
    # the numbers of lines are few beside the texts, which need no sorting then
    joined = whole.join(gone.hint("shuffle_hash"), (F.col("row.doc_id") == gone["doc_id"]) & (whole["t"] == gone["t"]), "left").select("row", "lines")
    parts = joined.withColumn("parts", F.when(F.col("lines").isNotNull(), F.split("row.text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("lines"))
    text = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    cut = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(text)
    named = [cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "__n_removed"]
    return parts.select(*named, F.coalesce(F.size("lines"), F.lit(0)).alias("__n_removed"))
