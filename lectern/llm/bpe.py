"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one encoding, and so one last token. The last token
of a prefix is the vocabulary token t that ends there and whose predecessor, the
last token of the prefix before t, may stand next to it. Tokens that end at a
place come from a suffix automaton of the vocabulary: its state after the
place is the longest suffix found in any token, and the chain of suffix links
holds all tokens that end there. Following the last tokens back gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Memo, only, portions, remembers, text_rows

#: Chunks and pieces that a worker remembers, and pairs of tokens that it has tried.
MEMO_PIECES, MEMO_PAIRS = 700_000, 400_000
#: The public pre-tokenisation pattern of byte-level BPE, and the code points that its \s means.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
#: Only a space may begin a piece that holds more than white space, so cutting before it and within runs of
#: white space as PATTERN does leaves chunks whose pieces do not depend on their neighbours.
CHUNKS = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def byte_symbols() -> dict[str, int]:
    """Printable symbol of each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of strings: ``next`` transitions, ``link`` suffix links, ``ends`` the string that a state spells, if it is one."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[int] = []
        last_of = [(self._insert(w), t) for w, t in words]
        self.ends = [-1] * len(self.next)
        for state, token in last_of:
            self.ends[state] = token
        # the tokens that end where a state is reached, longest first, with their lengths
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = ((self.ends[s], self.length[s]),) if self.ends[s] >= 0 else ()
            self.tokens[s] = own + self.tokens[self.link[s]]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's string and c alone: its transition's target, cloned if that also spells longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _insert(self, word: bytes) -> int:
        last = 0
        for c in word:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new
        return last


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_symbols()
        text_of = {t: bytes(of[c] for c in s) for s, t in model["vocab"].items() if all(c in of for c in s)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = text_of | {t: s.encode() for s, t in self.special.items()}
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.byte_token = {text_of[t]: t for t in text_of if len(text_of[t]) == 1}
        reachable = [(text_of[t], t) for t in [*self.byte_token.values(), *self.parts] if t in text_of and t not in self.special.values()]
        self.automaton = SuffixAutomaton(reachable)
        self.size = {t: len(b) for b, t in reachable}
        self.of_text = dict(reachable)
        self.right = Memo(partial(self._spine, 1), 20_000)
        self.left = Memo(partial(self._spine, 0), 20_000)
        self.whole = Memo(lambda t: self.merged(self.bytes_of[t]) == [t], 1 << 20)
        self.adjacent = Memo(self._adjacent, MEMO_PAIRS)
        self.memo = Memo(self._chunk, MEMO_PIECES)
        self.chunks = re.compile(CHUNKS).findall
        self.pieces = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost first; used for single tokens only."""
        ids = [self.byte_token[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            r, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[i : i + 2] = [self.of_text[self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]]]]
        return ids

    def _spine(self, side: int, token: int) -> list[tuple[int, int]]:
        """The token's outermost part at one side, from the token down to a byte, each with the rank that absorbs it."""
        out, absorbed = [], 1 << 60
        while True:
            out.append((token, absorbed))
            if token not in self.parts:
                return out
            a, b, absorbed = self.parts[token]
            token = b if side else a

    def _adjacent(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the border between two tokens open.

        At any time the border lies between a part x of the left token and a
        part y of the right one, until a rank absorbs either. The border closes
        if (x, y) is a merge that comes first: before y's absorption or with it
        (the merge is further left), and before x's.
        """
        xs, ys = self.right[pair[0]], self.left[pair[1]]
        i, j = len(xs) - 1, len(ys) - 1
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_end and r <= y_end:
                return False
            if i == 0 and j == 0:
                return True
            if x_end <= y_end:
                i -= 1
            else:
                j -= 1

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix but the empty one."""
        nxt, link, length, tokens = (getattr(self.automaton, k) for k in ("next", "link", "length", "tokens"))
        adjacent, whole = self.adjacent, self.whole
        last, state, have, at = [-1], 0, 0, 0
        for c in data:
            row = nxt[state]
            while c not in row:
                state = link[state]
                row, have = nxt[state], length[state]
            state = row[c]
            have += 1
            at += 1
            for t, size in tokens[state]:
                if size <= have:
                    before = last[at - size]
                    if adjacent[before, t] if before >= 0 else whole[t]:
                        break
            last.append(t)
        return last[1:]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        last, at, out = self.last_tokens(data), len(data), []
        while at:
            t = last[at - 1]
            out.append(t)
            at -= self.size[t]
        out.reverse()
        return array("I", out).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        parts = self.split(text) if self.split else [text]
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += map(self.memo.__getitem__, self.chunks(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> PrefixBpe:
    return PrefixBpe(path)


remembers("bpe", tokenizer.cache_clear)


def _encode(path: str, digest: bool, memo: int, batches):
    only("bpe")
    bpe = tokenizer(path)
    bpe.memo.limit, bpe.adjacent.limit = memo, min(memo, MEMO_PAIRS)
    hexed = lambda x: hashlib.sha256(x).hexdigest()
    for b in portions(batches):
        ns, ids_, back = [], [], []
        for text in b.column("text").to_pylist():
            ids = bpe.encode((text or b"").decode("utf-8", "replace"))
            text = bpe.decode(ids.tolist()).encode()
            ns.append(len(ids))
            ids_.append(hexed(ids.tobytes()) if digest else ids.tobytes())
            back.append(hexed(text) if digest else text)
        kind = pa.string() if digest else pa.binary()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(ids_, kind), pa.array(back, kind)], names=["doc_id", "n_tokens", "ids", "decoded"]
        )


def encode_decode(docs: DataFrame, tokenizer_path: str, digest: bool = False, memo: int = MEMO_PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row: ids little-endian unsigned 32-bit and the text they decode to, as binary.

    ``digest`` gives their lowercase hex SHA-256 instead; ``memo`` bounds the pieces that a worker remembers. A null text is empty:
    no ids, empty decoded text. Rows are independent, so repeats and null
    doc_ids pass through, and there is no shuffle. Texts of any length are cut into chunks and encoded whole; other columns
    are not read; an empty table gives an empty one.
    """
    kind = "string" if digest else "binary"
    return text_rows(docs).mapInArrow(partial(_encode, tokenizer_path, digest, memo), f"doc_id long, n_tokens long, ids {kind}, decoded {kind}")


def digests(docs: DataFrame, tokenizer_path: str, memo: int = MEMO_PIECES) -> DataFrame:
    out = encode_decode(docs, tokenizer_path, digest=True, memo=memo)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
