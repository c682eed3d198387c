"""Byte-level BPE as a lazily determinised transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when every adjacent pair is
the encoding of the pair's own bytes, so each prefix of a piece has one encoding and its
last token is found from shorter prefixes. Reading bytes from left to right, a token of the
final encoding may still reach over the present end only if it starts at a boundary from
which the bytes read are a prefix of some token; the encodings of the text up to those
boundaries share a first part, which no later byte can change. That part is emitted.

A state is therefore (last emitted token, bytes not yet emitted); the bytes are few, being
bounded by the longest token. States and transitions are made when first met and shared by
all pieces; when ``max_states`` are held, the table is dropped and built anew, inside a piece
too, from the state the piece is in.

Decoding is a stream too: tokens may end inside a character, so a small UTF-8 machine holds
back the bytes of an unfinished character until the rest arrives.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqscore.llm.common import slices


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """BPE by its definition: join the lowest-ranked adjacent pair, leftmost first, while there
    are more than ``until`` parts."""
    parts, most = [piece[i:i + 1] for i in range(len(piece))], len(ranks)
    while len(parts) > until:
        found = [ranks.get(a + b, most) for a, b in zip(parts, parts[1:])]
        rank = min(found)
        if rank == most:
            break
        at = found.index(rank)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Bytes in, token ids out, one piece at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.single = [bytes((b,)) for b in range(256)]
        # what a run of bytes can be: (token or None, whether a longer token starts with it)
        self.known: dict[bytes, tuple[int | None, bool]] = {t[:i]: (ranks.get(t[:i]), True) for t in ranks for i in range(1, len(t))}
        for t, r in ranks.items():
            self.known.setdefault(t, (r, False))
        self.edges: dict[tuple[int, int], list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}  # of state and byte
        if len(self.pairs) > 4 * self.max_states:
            self.pairs.clear()
        self._state(-1, b"", ((0, ()),))

    def _anew(self, k: int) -> int:
        """Drops the table but for the state that a piece is in."""
        held = self.state[k]
        self._reset()
        return self._state(*held)

    def _state(self, prev: int, tail: bytes, open_at: tuple[tuple[int, tuple[int, ...]], ...]) -> int:
        """prev: last emitted token, -1 if none; tail: bytes not emitted; open_at: the
        boundaries in tail from which a token may still reach on, each with the encoding of
        the bytes before it; the last is the end of tail."""
        k = self.ids.get((prev, tail))
        if k is None:
            k = self.ids[prev, tail] = len(self.state)
            self.state.append((prev, tail, open_at))
        return k

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens at the left (side 0) or right (-1) end of ``token`` while it is merged,
        each with the rank of the merge that uses it up. Empty if merging doesn't give it."""
        if (token, side) not in self.edges:
            part, used, out = self.bytes_of[token], math.inf, []
            if merge(part, self.ranks) == [part]:
                while True:
                    out.append((part, used))
                    if len(part) == 1:
                        break
                    used, part = self.ranks[part], merge(part, self.ranks, 2)[side]
            self.edges[token, side] = out
        return self.edges[token, side]

    def _follows(self, a: int, b: int) -> bool:
        """True if merging the bytes of both tokens gives these two, that is, no merge across
        their border has its turn before one that uses up the part on either side."""
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.pairs[a, b] = self._apart(a, b)
        return ok

    def _apart(self, a: int, b: int) -> bool:
        right = self.edges.get((b, 0))
        if right is None:
            right = self._edge(b, 0)
        if not right:
            return False
        if a < 0:
            return True
        left = self.edges.get((a, -1))
        if left is None:
            left = self._edge(a, -1)
        known, rank, first = self.known, self.ranks.get, right[-1][0]  # all parts on the right begin with the last, one byte
        for x, x_used in left:
            if x + first in known:
                for y, y_used in right:
                    r = rank(x + y)
                    if r is not None and r < x_used and r <= y_used:
                        return False
        return True

    def _grow(self, k: int, byte: int) -> tuple[int, tuple[int, ...]]:
        prev, tail, open_at = self.state[k]
        tail += self.single[byte]
        kept, whole, known, pairs = [], None, self.known.get, self.pairs
        for boundary in open_at:
            start, before = boundary
            found = known(tail[start:] if start else tail)
            if found is not None:
                token, longer = found
                if token is not None and whole is None:
                    pair = (before[-1] if before else prev, token)
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self._apart(*pair)
                    if ok:
                        whole = (*before, token)
                if longer:
                    kept.append(boundary)
        kept.append((len(tail), whole))
        emitted: tuple[int, ...] = ()
        first = kept[0][1]
        if kept[0][0] and first:
            same = len(first)
            for _, other in kept[1:]:
                if other[:same] != first[:same]:
                    i, end = 0, min(same, len(other))
                    while i < end and other[i] == first[i]:
                        i += 1
                    same = i
            if same:
                emitted, prev = first[:same], first[same - 1]
                cut = sum([self.size[t] for t in emitted])
                tail, kept = tail[cut:], [(j - cut, x[same:]) for j, x in kept]
        step = self.steps[k << 8 | byte] = (self._state(prev, tail, tuple(kept)), emitted)
        return step

    def _finish(self, k: int, byte: int) -> tuple[int, ...]:
        """What is still to be emitted if the piece ends with ``byte``. Pieces are remembered
        whole, so their last steps make no states."""
        prev, tail, open_at = self.state[k]
        tail += self.single[byte]
        rank, pairs = self.ranks.get, self.pairs
        for start, before in open_at:
            token = rank(tail[start:] if start else tail)
            if token is not None:
                pair = (before[-1] if before else prev, token)
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = self._apart(*pair)
                if ok:
                    return (*before, token)
        raise ValueError("the ranks lack a single byte")

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        k, out, known = 0, [], self.steps.get
        for at in range(0, len(piece) - 1, 64):
            if len(self.state) > self.max_states:
                k, known = self._anew(k), self.steps.get
            for byte in piece[at:min(at + 64, len(piece) - 1)]:
                step = known(k << 8 | byte) or self._grow(k, byte)
                k = step[0]
                if step[1]:
                    out += step[1]
        out += self._finish(k, piece[-1])
        return out


class PieceCache(dict):
    """piece -> its ids as bytes, for short pieces. When ``most`` are held they become the old
    half; an old piece that is met again moves back, the others go when the next half is full."""

    def __init__(self, transducer: Transducer, most: int = 400_000):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Machine:
    """Which bytes of a stream are whole characters. State: bytes still due for the character
    that is open, and the range the next byte must be in (RFC 3629)."""

    def __init__(self):
        self.held, self.due, self.range = b"", 0, (0x80, 0xBF)

    def _next(self, byte: int) -> bool:
        """False if the byte can't continue or start a character."""
        if self.due:
            ok = self.range[0] <= byte <= self.range[1]
            self.due, self.range = (self.due - 1 if ok else 0), (0x80, 0xBF)
            return ok
        self.due = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        self.range = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
        return byte < 0x80 or self.due > 0

    def feed(self, data: bytes) -> str:
        """The characters completed by ``data``; the bytes of an open one are held back. Only
        the last bytes can be open, so the machine runs from the last start of a character."""
        data = self.held + data
        at = max(0, len(data) - 4)
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        start, self.due = len(data), 0
        for i in range(at, len(data)):
            if not self.due:
                start = i
            self._next(data[i])
        if not self.due:
            start = len(data)
        self.held = data[start:]
        return data[:start].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held, self.due = self.held.decode("utf-8", "replace"), b"", 0
        return out


class TokenBytes:
    """The bytes of all tokens in one array, to look up many ids at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        n = max(bytes_of, default=-1) + 1
        self.size = np.array([len(bytes_of.get(i, b"")) for i in range(n)], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.raw = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def __call__(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        end = np.cumsum(size, dtype=np.int32)
        place = np.arange(end[-1] if len(end) else 0, dtype=np.int32)
        place += np.repeat(self.start[ids] - (end - size), size)
        return self.raw[place].tobytes()


def decode_stream(chunks: Iterator[np.ndarray | list[int]], token_bytes: TokenBytes | dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of id lists, each part as soon as its characters are whole."""
    look_up = token_bytes if isinstance(token_bytes, TokenBytes) else TokenBytes(token_bytes)
    machine = Utf8Machine()
    for ids in chunks:
        yield machine.feed(look_up(ids))
    yield machine.close()


_LOADED: dict = {}


def _coder(path: str, pattern: str):
    """The worker's transducer; it outlives a task, its size is bounded."""
    if (path, pattern) not in _LOADED:
        import regex
        _LOADED.clear()
        transducer = Transducer(read_ranks(path))
        _LOADED[path, pattern] = regex.compile(pattern), PieceCache(transducer), TokenBytes(transducer.bytes_of)
    return _LOADED[path, pattern]


@contextlib.contextmanager
def _no_collection():
    """States and tokens hold no circles, so looking for such after every few hundred new ones
    finds nothing and costs more than making them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """Token ids of a text, each match of ``pattern`` encoded separately."""
    split, cache, _ = _coder(path, pattern)
    return np.frombuffer(b"".join(map(cache.__getitem__, split.findall(text))), "<u4")


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", digest: bool = False,
                     chunk: int = 1 << 16) -> DataFrame:
    """doc_id, ids (array of int) for each row of ``docs``; null text counts as empty and
    gives no ids. With ``digest`` the ids and the text decoded from them are hashed in place:
    doc_id, n_tokens, ids_sha256, decoded_sha256. Rows are independent, nothing is shuffled;
    repeated rows give repeated rows. Other columns are not read."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] if digest \
        else [pa.field("ids", pa.list_(pa.int32()))]
    ddl = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = _coder(path, pattern)[2]
        for batch in slices(batches, "text"):
            found: list[list] = [[] for _ in fields]
            with _no_collection():
                for raw in batch.column(1).cast(pa.binary()):
                    body = (raw.as_py() or b"").decode("utf-8", "replace")
                    ids = encode_text(body, path, pattern)
                    if not digest:
                        found[0].append(ids.astype(np.int32))
                        continue
                    decoded = hashlib.sha256()
                    for part in decode_stream((ids[i:i + chunk] for i in range(0, len(ids), chunk)), token_bytes):
                        decoded.update(part.encode())
                    for column, value in zip(found, (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), decoded.hexdigest())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(found, fields))],
                                             schema=pa.schema([pa.field("doc_id", pa.int64()), *fields]))

    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, ddl)
