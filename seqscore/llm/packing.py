"""Packing of tokenized documents into sequences.

Documents are dealt at random to groups, and each group is packed on its own. A document
longer than a sequence fills whole ones; what is left of it is an item. Items go by falling
length into the first sequence with room (first-fit decreasing); a tournament tree over the
room of the sequences finds it in logarithmic time. Then the emptiest sequences are taken
apart to fill the gaps of the others, and the one that remains is cut at powers of two.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import slices


class RoomTree:
    """Tournament tree: every node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with room for ``need``."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        most, at = self.most, bin_ + self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            a, b = most[2 * at], most[2 * at + 1]
            most[at] = a if a > b else b


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (their places in ``sizes``, each from 1 to ``capacity``) of every bin."""
    tree, bins = RoomTree(max(1, len(sizes)), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first_with(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
        tree.take(at, sizes[item])
    return bins


def pack(lengths: list[int], capacity: int = 2048, least_gap: int = 8) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents of
    ``lengths`` once. Gaps under ``least_gap`` tokens are left to padding rather than cut a
    document for them."""
    full, items = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            items.append((doc, whole, n - whole))
    bins = [[items[i] for i in b] for b in first_fit_decreasing([n for _, _, n in items], capacity)]
    fill = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])  # the fullest are filled first, the emptiest give
    low, high = 0, len(order) - 1
    while low < high:
        taker, giver = order[low], order[high]
        gap = capacity - fill[taker]
        if gap < least_gap:
            low += 1
            continue
        doc, start, n = bins[giver].pop()
        part = min(gap, n)
        if part < n:
            bins[giver].append((doc, start, n - part))
        bins[taker].append((doc, start + n - part, part))
        fill[taker] += part
        fill[giver] -= part
        if not fill[giver]:
            high -= 1
    out = full + [b for b, f in zip(bins, fill) if f and f + least_gap > capacity]
    for b, f in zip(bins, fill):
        if f and f + least_gap <= capacity:
            out += _powers(b, f)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences whose lengths are powers of two."""
    out, left = [], list(pieces)[::-1]
    for power in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        sequence = []
        while power:
            doc, start, n = left.pop()
            part = min(n, power)
            sequence.append((doc, start, part))
            if part < n:
                left.append((doc, start + part, n - part))
            power -= part
        out.append(sequence)
    return out


#: ASCII punctuation, which the tokenizer file splits from letters before it.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


#: How byte-level vocabularies write a byte as a letter: visible Latin-1 as itself, the others
#: as the letters from 256 on, in order.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _SEEN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


LONGEST_KEPT = 64


class WordIds(dict):
    """Token ids of words, for a tokenizer file that drops white space and lowers letters.

    A word is looked up whole; a new one is cut into letters and the marks after them, where
    the file's own splitting does the same (tried once on loading), so "Word", "word," and
    "word." are encoded once. ASCII letters go to the file's merges directly, everything else
    through the whole tokenizer. Tables of ``most`` entries are kept, the older half apart; words
    of over ``LONGEST_KEPT`` bytes are not, so the tables are bounded in bytes too."""

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # each access would make a new wrapper
        self.most = most
        self.old, self.parts = {}, {}
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        tried = ["Abc", "hello", "ZZxqjv", "of", "Étré", "straße", "Ñandú", "привет", "ΟΔΟΣ", "日本", "e\u0301t"]
        self.plain = all(self._merged(x.encode()) == array("I", ids(x)).tobytes() for x in tried if self._letters(x.encode())) \
            and all(ids(x + m) == ids(x) + ids(m) for x in tried for m in (",", ".", "...", "!?", ")\"", "&&&"))

    @staticmethod
    def _letters(part: bytes) -> bool:
        """Letters that stay letters when composed and lowered; marks may join what follows."""
        return part.isalpha() or unicodedata.normalize("NFC", part.decode("utf-8", "replace")).lower().isalpha()

    def _merged(self, part: bytes) -> bytes:
        if part.isalpha():  # ASCII
            part = part.lower()
        else:
            part = "".join([c.lower() for c in unicodedata.normalize("NFC", part.decode("utf-8", "replace"))]).encode()
        return array("I", [t.id for t in self.model.tokenize(part.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()

    def _part(self, part: bytes) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if self.plain and self._letters(part):
                ids = self._merged(part)
            else:
                ids = array("I", self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            if len(part) <= LONGEST_KEPT:
                if len(self.parts) > self.most:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            head = word.rstrip(MARKS) if self.plain else b""
            if head.isalpha():  # ASCII
                ids = self._part(head.lower())
            elif head and self._letters(head):
                ids = self._part(head)
            else:
                head, ids = word, self._part(word)
            if len(head) < len(word):
                ids += self._part(word[len(head):])
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_TOKENIZERS: dict[str, WordIds] = {}


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of each text as unsigned 32-bit numbers: words between ASCII white space are
    encoded once and remembered."""
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = WordIds(path)
    ids = _TOKENIZERS[path].__getitem__
    return [b"".join(map(ids, t.split())) for t in texts]


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, text: str = "text",
                   group_bytes: int = 16 << 20, seed: int = 3) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; a null text counts as empty. Groups hold about
    ``group_bytes`` of text and are drawn by a hash of id and text, so rows that repeat are
    packed as often as they occur; ids without text and null ids are packed like others. An
    empty table gives no pieces. Sequences are numbered within their group's range of ids.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(body) + F.lit(16)), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", body), F.lit(groups)).alias("group"), body.alias("text"))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = token_ids([t.as_py() for t in batch.column(2).cast(pa.binary())], path)
            # two bytes an id travel where ids are small enough, four else; the length tells
            small = [_small(i) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(small, pa.binary())],
                                             ["doc_id", "group", "n", "ids"])

    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def packed(table: pa.Table) -> pa.Table:
        end = np.array([end_id], "<u4").tobytes()
        docs_ = sorted(zip(table.column("ids").to_pylist(), table.column("n").to_pylist(), table.column("doc_id").to_pylist()), key=lambda d: (d[2] is None, d[2] or 0, d[0]))
        group = table.column("group")[0].as_py()
        ids = [(np.frombuffer(b, "<u2").astype("<u4").tobytes() if len(b) == 2 * n else b) + end for b, n, _ in docs_]
        out = []
        for k, sequence in enumerate(pack([len(i) // 4 for i in ids], capacity)):
            offset = 0
            for doc, start, n in sequence:
                out.append((docs_[doc][2], start, n, zlib.crc32(ids[doc][4 * start:4 * (start + n)]), len(ids[doc]) // 4, group << 32 | k, offset))
                offset += n
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return (rows.mapInArrow(tokenized, "doc_id long, group long, n long, ids binary").groupBy("group")
            .applyInArrow(packed, ", ".join(f"{n} long" for n in schema.names)))


def _small(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else ids
