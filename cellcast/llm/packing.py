"""Cost-balanced packing of tokenised documents into training sequences.

A document costs ``LINEAR * n + QUADRATIC * n**2`` for its ``n`` tokens (projections and
attention).  Documents are cut at the sequence length, the pieces sorted by falling cost, and
each goes to the cheapest sequence whose remaining capacity holds it whole.  A piece is cut only
where none does; then the cheapest sequence with any room takes its head, and its rest queues again.
So every sequence is filled.

The work is a narrow map over the partitions: a block of about ``BLOCK_TOKENS`` tokens is packed
at a time, no row is shuffled, and a task that is run again over the same rows gives the same
sequences.  What does not fill a sequence goes on to the next block; at the end of a partition the
rest goes to sequences whose lengths are the powers of two that add up to it, at most one of each,
so nothing is padded.  Sequence ids combine the partition's number with a running one.

Defined results: a null text is empty, an empty text is the single end id; repeated rows are
packed once each; a null ``doc_id`` stays null; an empty table gives no sequences; a text of any
length is packed whole, in as many pieces as it needs.  Of the table only ``doc_id`` and ``text``
are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cellcast.llm.common import return_freed_memory, sliced, tune

SEQUENCE = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
BLOCK_TOKENS = 1 << 21
#: Runs, and pieces of runs, whose ids a worker remembers in each of two generations.
CACHE_PIECES = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Kept(dict):
    """What ``make`` gives for a key, remembered in two generations.

    When the young one is full it becomes the old one, and what is asked for again moves back, so
    frequent keys stay and memory is bounded.
    """

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of whole texts, equal to the tokenizer's.

    The vocabulary's splitter drops white space and cuts what is between into runs of letters,
    single digits, runs of other characters and a few contractions; each piece is encoded by
    itself, so the ids of a run without white space are remembered, and those of its pieces.  Texts
    of ASCII and Latin letters, where the splitter needs no Unicode tables, are cut here; any other
    text, and any that is not in normal form C, goes through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.foreign = re.compile(r"[^\t\n\r -~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E]").search
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        self.pieces = _Kept(self._piece)
        self.runs = _Kept(self._run)

    def _piece(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        tokens = self.model.tokenize(seen)
        return array("I", [t.id for t in tokens]).tobytes()

    def _run(self, run: str) -> bytes:
        return self._piece(run) if run.isalpha() else b"".join(map(self.pieces.__getitem__, self.split(run)))

    def forget(self) -> None:
        for kept in (self.pieces, self.runs):
            kept.clear()
            kept.old = {}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.foreign(text) or any(s in text for s in self.special) or not unicodedata.is_normalized("NFC", text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.runs.__getitem__, text.lower().split()))


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Rooms:
    """Sequences by remaining capacity: the cheapest of all with at least some room, in log time.

    A tree over the capacities holds the cheapest sequence of each range of them.
    """

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()  # a leaf for each capacity from 0 to size
        self.leaves: list[list[tuple[float, int]]] = [[] for _ in range(self.base)]
        self.tree: list[tuple[float, int]] = [(math.inf, -1)] * (2 * self.base)

    def _renew(self, room: int) -> None:
        at, leaf, tree = self.base + room, self.leaves[room], self.tree
        tree[at] = leaf[0] if leaf else (math.inf, -1)
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                break
            tree[at] = least

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.leaves[room], (cost, sequence))
        self._renew(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest with room for ``least`` tokens, which leaves."""
        tree, a, b = self.tree, self.base + least, 2 * self.base
        best, at = (math.inf, -1), 0
        while a < b:
            if a & 1:
                if tree[a] < best:
                    best, at = tree[a], a
                a += 1
            if b & 1:
                b -= 1
                if tree[b] < best:
                    best, at = tree[b], b
            a >>= 1
            b >>= 1
        if not at:
            return None
        while at < self.base:
            at = 2 * at if tree[2 * at] == best else 2 * at + 1
        room = at - self.base
        heapq.heappop(self.leaves[room])
        self._renew(room)
        return (*best, room)


def assign(pieces: list[tuple[int, int, int]], rooms: list[int], size: int = SEQUENCE) -> tuple[list, list]:
    """Places (document, start, length, sequence, offset) of the pieces, and the pieces left over.

    ``pieces`` are (document, start, length); ``rooms`` the capacities of the sequences, which are
    all filled if there are tokens enough.
    """
    found, over = [], []
    queue = [(-min(size, n - at), d, start + at) for d, start, n in pieces for at in range(0, n, size)]
    heapq.heapify(queue)  # longest first, as cost rises with length
    open_ = Rooms(size)
    for s, room in enumerate(rooms):
        open_.put(room, 0.0, s)
    while queue:
        neg, d, start = heapq.heappop(queue)
        n = -neg
        place = open_.take(n) or open_.take(1)
        if place is None:
            over.append((d, start, n))
            continue
        spent, s, room = place
        put = min(n, room)
        found.append((d, start, put, s, rooms[s] - room))
        if put < room:
            open_.put(room - put, spent + cost(put), s)
        if put < n:
            heapq.heappush(queue, (put - n, d, start + put))
    return found, over


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def packer(tokenizer_path: str, size: int, block_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        docs: list[tuple[int | None, bytes]] = []  # of the pieces that wait
        pieces: list[tuple[int, int, int]] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal docs, pieces, held, base
            rooms = [size] * (held // size) + (powers_of_two(held % size) if last else [])
            rows, over = assign(pieces, rooms, size)
            out = [(docs[d][0], start, n, zlib.crc32(memoryview(docs[d][1])[4 * start : 4 * (start + n)]), len(docs[d][1]) // 4, base + s, offset) for d, start, n, s, offset in rows]
            base += len(rooms)
            kept = sorted({d for d, *_ in over})
            place = {d: i for i, d in enumerate(kept)}
            docs, pieces, held = [docs[d] for d in kept], [(place[d], start, n) for d, start, n in over], sum(n for *_, n in over)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in sliced(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                blob = words.ids(text) + end
                pieces.append((len(docs), 0, len(blob) // 4))
                docs.append((doc, blob))
                held += len(blob) // 4
                if held >= block_tokens:
                    yield flush(False)
        if held:
            yield flush(True)
        words.forget()
        return_freed_memory()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of the documents' ids: where it lies in which sequence."""
    tune(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(packer(tokenizer_path, size, block_tokens), SCHEMA)
