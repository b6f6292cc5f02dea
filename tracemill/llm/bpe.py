"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Encoding. After any prefix of a piece its BPE encoding has one last token, and two neighbouring tokens may stand side
by side exactly if no merge of lower rank crosses their border. Reading a byte moves all tokens that are still open,
closes the one that fits its left neighbour, and opens a new position. What the ways back from all open positions agree
on is emitted: the lookahead is as long as the tokens still open.

Decoding. A token is a chunk of bytes; the UTF-8 machine's step over a whole token is compiled when first needed.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows each get a row; other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import col, sliced

#: Transitions kept before the lazy automaton is dropped and begun anew; remembered chunks likewise.
MAX_TRANSITIONS = 400_000
MAX_CHUNKS = 80_000
MAX_PAIRS = 600_000
#: Bits of the table of neighbours; pieces of up to so many bytes are encoded together.
TABLE_BITS, LONGEST_TOGETHER = 21, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Which tokens merging can reach, how each was last merged, and whether two may be neighbours."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int] | None = None):
        """``pairs``: merged token of each allowed pair; where None, any two whose bytes make a token merge."""
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs = pairs
        self.split: dict[int, tuple[int, int] | None] = {}
        order = sorted(ranks.items(), key=lambda x: x[1])
        for token, rank in order:
            if len(token) == 1:
                self.split[rank] = None
        for token, rank in order:
            if len(token) > 1 and all(bytes((b,)) in ranks for b in token):
                parts = self.merged([ranks[bytes((b,))] for b in token], rank)
                if len(parts) == 2 and self.merge(*parts) == rank:
                    self.split[rank] = (parts[0], parts[1])
        self.known_fits: dict[int, bool] = {}
        self.answers: tuple[np.ndarray, np.ndarray] | None = None
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})

    def merge(self, a: int, b: int) -> int | None:
        if self.pairs is not None:
            return self.pairs.get((a, b))
        return self.ranks.get(self.bytes_of[a] + self.bytes_of[b])

    def merged(self, parts: list[int], below: int) -> list[int]:
        """Plain BPE: merge the leftmost pair of least rank under ``below`` until there is none."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                m = self.merge(parts[i], parts[i + 1])
                if m is not None and m < best:
                    best, at = m, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens ``a`` and ``b`` side by side.

        The parts of ``a`` along its right edge and of ``b`` along its left edge vanish in the order of the ranks they
        are merged into; a merge over the border happens if it comes before either part vanishes.
        """
        right, left = self.edge(a, 1), self.edge(b, 0)
        i, j, ok = len(right) - 1, len(left) - 1, True
        while True:
            end_i = right[i - 1] if i else sys.maxsize
            end_j = left[j - 1] if j else sys.maxsize
            cross = self.merge(right[i], left[j])
            if cross is not None and cross < end_i and cross <= end_j:
                ok = False
                break
            if not i and not j:
                break
            if end_i <= end_j:
                i -= 1
            else:
                j -= 1
        if len(self.known_fits) > MAX_PAIRS:
            self.known_fits.clear()
        self.known_fits[a << 20 | b] = ok
        return ok

    def fits_many(self, keys: np.ndarray) -> np.ndarray:
        """``fits`` for keys ``a << 20 | b``, by a table of answers with a place for each key's hash."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        if self.answers is None:
            self.answers = (np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, bool))
        held, said = self.answers
        ok = said[at]
        for i in np.flatnonzero(held[at] != keys).tolist():
            key = int(keys[i])
            known = self.known_fits.get(key)
            if known is None:
                known = self.fits(key >> 20, key & 0xFFFFF)
            ok[i] = known
            held[at[i]], said[at[i]] = key, known
        return ok

    def edge(self, token: int, side: int) -> list[int]:
        """A token and its parts along one edge, down to a byte."""
        out = self.edges[side].get(token)
        if out is None:
            out, parts = [token], self.split[token]
            while parts:
                out.append(parts[side])
                parts = self.split[parts[side]]
            self.edges[side][token] = out
        return out


class Transducer:
    """Bytes of a piece to its token ids, a byte at a time.

    The automaton's states are sets of trie nodes, one for each position at which an open token may have begun; they
    are made when first reached, as in a lazy DFA, and there are at most as many as trie nodes. A state says which
    tokens may close here; the one that fits the last token before it does. The register beside the state, the last
    token of each prefix, need only reach back as far as the longest open token: what lies before the point where the
    ways from all open positions meet is settled and is emitted.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        for rank in merges.split:
            node = 0
            for b in merges.bytes_of[rank]:
                step = self.trie[node].get(b)
                if step is None:
                    step = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = step
            self.token[node] = rank
        self.length = {rank: len(merges.bytes_of[rank]) for rank in merges.split}
        self.lengths = np.zeros(max(self.length, default=0) + 1, np.int64)
        for rank, n in self.length.items():
            self.lengths[rank] = n
        self.reset()

    def reset(self) -> None:
        self.states, self.ids, self.steps = [(0,)], {(0,): 0}, {}
        self.table = np.full(256 * 256, -1, np.int64)
        self.closing_token, self.closing_length = np.full((256, 4), -1, np.int64), np.zeros((256, 4), np.int64)

    def step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and the tokens that may close there with their lengths, longest first."""
        moved = tuple(child for child in (self.trie[node].get(byte) for node in self.states[state]) if child is not None) + (0,)
        at = self.ids.get(moved)
        if at is None:
            at = self.ids[moved] = len(self.states)
            self.states.append(moved)
        closing = tuple((self.depth[n], self.token[n]) for n in moved if self.token[n] >= 0)
        if at >= len(self.closing_token):
            more = len(self.closing_token)
            self.table = np.concatenate([self.table, np.full(more * 256, -1, np.int64)])
            self.closing_token = np.pad(self.closing_token, ((0, more), (0, 0)), constant_values=-1)
            self.closing_length = np.pad(self.closing_length, ((0, more), (0, 0)))
        if (more := len(closing) - self.closing_token.shape[1]) > 0:
            self.closing_token = np.pad(self.closing_token, ((0, 0), (0, more)), constant_values=-1)
            self.closing_length = np.pad(self.closing_length, ((0, 0), (0, more)))
        for k, (length, token) in enumerate(closing):
            self.closing_token[at, k], self.closing_length[at, k] = token, length
        self.table[state << 8 | byte] = at
        hit = self.steps[state << 8 | byte] = (at, closing)
        return hit

    def encode(self, piece: bytes) -> list[int]:
        if len(self.steps) > MAX_TRANSITIONS:
            self.reset()
        steps, step, known, fits = self.steps, self.step, self.merges.known_fits, self.merges.fits
        state, last, done, out, at = 0, [-1], 0, [], 0
        for byte in piece:
            at += 1
            hit = steps.get(state << 8 | byte)
            state, closing = hit if hit is not None else step(state, byte)
            for length, token in closing:
                before = last[at - length]
                if before < 0:
                    break
                ok = known.get(before << 20 | token)
                if ok or ok is None and fits(before, token):
                    break
            else:
                raise ValueError(f"byte {byte} has no token")
            last.append(token)
            if at - done >= 1024:
                settled = self.settled(last, state, at)
                tail = self.back(last, settled)
                out += tail
                if tail:  # the register begins anew at the last settled token
                    last, at = [tail[-1], *last[settled + 1 :]], at - settled
                done = at
        tail = self.back(last, at)
        return out + tail if out else tail

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """As ``encode`` for many short pieces, all moved together: the ids of each as 32-bit words."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONGEST_TOGETHER).tolist():
            out[i] = np.array(self.encode(pieces[i]), np.uint32).tobytes()
        order = np.flatnonzero((sizes > 0) & (sizes <= LONGEST_TOGETHER))
        order = order[np.argsort(-sizes[order], kind="stable")]
        for first in range(0, len(order), 50_000):
            self._together(pieces, order[first : first + 50_000], sizes, out)
        return out

    def _together(self, pieces: list[bytes], order: np.ndarray, sizes: np.ndarray, out: list[bytes]) -> None:
        listed, size = order.tolist(), sizes[order]
        n, width = len(listed), int(size[0])
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in listed]), np.uint8).reshape(n, width).astype(np.int64)
        state, last = np.zeros(n, np.int64), np.full((n, width + 1), -1, np.int64)
        if len(self.states) > MAX_TRANSITIONS:
            self.reset()
        for t in range(width):
            live = int(np.searchsorted(-size, -t, side="left"))  # those longer than t come first
            key = state[:live] << 8 | raw[:live, t]
            for lacking in np.unique(key[self.table[key] < 0]).tolist() if (self.table[key] < 0).any() else ():
                self.step(lacking >> 8, lacking & 255)
            state[:live] = now = self.table[key]
            rows = np.arange(live)
            for k in range(self.closing_token.shape[1]):
                token, length = self.closing_token[now, k], self.closing_length[now, k]
                before = last[rows, t + 1 - length]
                ok = (before < 0) & (token >= 0)
                ask = np.flatnonzero((before >= 0) & (token >= 0))
                ok[ask] = self.merges.fits_many(before[ask] << 20 | token[ask])
                last[rows[ok], t + 1] = token[ok]
                rows, now = rows[~ok], now[~ok]
                if not len(rows):
                    break
            else:
                raise ValueError("a byte has no token")
        at, found = size.copy(), np.full((n, width), -1, np.int64)
        rows, k = np.arange(n), width
        while len(rows):  # back from the ends
            k -= 1
            token = last[rows, at[rows]]
            found[rows, k] = token
            at[rows] -= self.lengths[token]
            rows = rows[at[rows] > 0]
        counts = (found >= 0).sum(axis=1)
        flat = found[found >= 0].astype(np.uint32).tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        start = 0
        for i, end in zip(listed, ends, strict=True):
            out[i] = flat[start:end]
            start = end

    def back(self, last: list[int], at: int) -> list[int]:
        """The tokens up to a position, from the last tokens of prefixes."""
        out, length = [], self.length
        while at > 0:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def settled(self, last: list[int], state: int, at: int) -> int:
        """The last position through which the ways back from all open positions go."""
        ends = {at - self.depth[node] for node in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.length[last[far]])
        return max(ends.pop(), 0)


class Utf8Machine:
    """Incremental UTF-8. A state is what has been read of a character: the bytes still due, the least and the greatest
    next byte, the bytes so far; state 0 is between characters. Steps over whole tokens are made when first needed."""

    #: Lead bytes from, to; bytes that follow; the first of these from, to (RFC 3629).
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
    BETWEEN = (0, 0, 0, b"")

    def __init__(self, tokens: Callable[[int], bytes]):
        self.tokens = tokens
        self.states, self.ids = [self.BETWEEN], {self.BETWEEN: 0}
        self.steps: list[dict[int, tuple[int, bytes]]] = [{}]

    def byte(self, state: tuple, b: int) -> tuple[tuple, bytes]:
        """The state after a byte, and the bytes that are complete with it. What is not UTF-8 passes unchanged."""
        due, low, high, seen = state
        if due:
            if low <= b <= high:
                seen += bytes((b,))
                return ((due - 1, 0x80, 0xBF, seen), b"") if due > 1 else (self.BETWEEN, seen)
            after, out = self.byte(self.BETWEEN, b)
            return after, seen + out
        for first, last, n, low, high in self.LEADS:
            if first <= b <= last:
                return (n, low, high, bytes((b,))), b""
        return self.BETWEEN, bytes((b,))

    def step(self, state: int, token: int) -> tuple[int, bytes]:
        """The state after a token, and the bytes that are complete with it."""
        hit = self.steps[state].get(token)
        if hit is None:
            now, out = self.states[state], b""
            for b in self.tokens(token):
                now, done = self.byte(now, b)
                out += done
            at = self.ids.get(now)
            if at is None:
                at = self.ids[now] = len(self.states)
                self.states.append(now)
                self.steps.append({})
            hit = self.steps[state][token] = (at, out)
        return hit

    def rest(self, state: int) -> bytes:
        return self.states[state][3]


class Codec:
    """Texts to ids and back, with chunks between spaces remembered.

    A space before something that is no white space always begins a piece, so texts may be cut there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: dict[tuple[int, int], int] | None = None, whole_pieces: bool = True):
        self.merges = Merges(ranks, pairs)
        self.machine = Transducer(self.merges)
        self.find = regex.compile(pattern).findall
        self.whole = ranks if whole_pieces else {}
        self.utf8 = Utf8Machine(self.merges.bytes_of.__getitem__)
        self.clean = {r: t for r, t in self.merges.bytes_of.items() if _is_utf8(t)}
        # two generations of each: what is used again is carried over, the rest goes with the older one
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.digits = {r: str(r) for r in ranks.values()}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't remembered."""
        if len(self.pieces) > MAX_CHUNKS:
            self.older_pieces, self.pieces = self.pieces, {}
        todo = []
        for p in pieces.difference(self.pieces):
            ids = self.older_pieces.get(p)
            if ids is None:
                todo.append(p)
            else:
                self.pieces[p] = ids
        raw = [p.encode() for p in todo]
        for p, r, ids in zip(todo, raw, self.machine.encode_many([b"" if r in self.whole else r for r in raw]), strict=True):
            self.pieces[p] = ids or np.uint32(self.whole[r]).tobytes()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split, lacking, odd = [], set(), {}
        if len(self.chunks) > MAX_CHUNKS:
            self.older_chunks, self.chunks = self.chunks, {}
        known, older = self.chunks, self.older_chunks
        for n, text in enumerate(texts):
            head, *rest = text.split(" ")
            new = [p for p in rest if p not in known]
            if "" in new or any(map(str.isspace, [p[0] for p in new])):
                odd[n] = self.segments(head, rest)
                split.append(None)
                continue
            lacking.update(new)
            split.append((head, rest))
        for p in lacking:
            ids = older.get(p)
            if ids is not None:
                known[p] = ids
        lacking = list(lacking.difference(known))
        found = self.find(" " + " ".join(lacking)) if lacking else []  # each chunk's first piece begins with its space
        heads = {n: self.find(s[0]) for n, s in enumerate(split) if s and s[0]}
        odd = {n: [p for s in segments for p in self.find(s)] for n, segments in odd.items()}
        self.learn(set(found).union(*heads.values(), *odd.values()))
        mine = self.pieces
        at = [i for i, p in enumerate(found) if p[0] == " "]
        ids = list(map(mine.__getitem__, found))
        for p, start, end in zip(lacking, at, [*at[1:], len(found)][: len(at)], strict=True):
            known[p] = ids[start] if end == start + 1 else b"".join(ids[start:end])
        out = []
        for n, s in enumerate(split):
            if s is None:
                raw = b"".join(map(mine.__getitem__, odd[n]))
            else:
                raw = b"".join(map(mine.__getitem__, heads.get(n, ()))) + b"".join(map(known.__getitem__, s[1]))
            out.append(np.frombuffer(raw, dtype=np.uint32))
        return out

    @staticmethod
    def segments(head: str, rest: list[str]) -> list[str]:
        """For texts with runs of white space: only a space before something else begins a segment."""
        segments = [[head]]
        for p in rest:
            if p and not p[0].isspace():
                segments.append([" " + p])
            else:
                segments[-1].append(" " + p)
        return ["".join(s) for s in segments if any(s)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def said(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. Tokens of whole characters go straight through; at others the machine takes over until
        it is between characters again."""
        listed = ids.tolist()
        found = list(map(self.clean.get, listed))
        try:
            at = found.index(None)
            while True:
                state = 0
                while True:
                    state, found[at] = self.utf8.step(state, listed[at])
                    at += 1
                    if not state or at == len(listed):
                        break
                if state:
                    found.append(self.utf8.rest(state))
                    break
                at = found.index(None, at)
        except ValueError:
            pass
        return b"".join(found)


def _is_utf8(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, made once in each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes for each row, with the ids themselves if asked for.

    No shuffle: one pass of the two columns. ``ranks_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in sliced(batches):
            counts, id_shas, text_shas, listed = [], [], [], []
            for ids in c.encode_many([text or "" for text in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                id_shas.append(hashlib.sha256(c.said(ids).encode()).hexdigest())
                text_shas.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    listed.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(text_shas, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(listed, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    key = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)
