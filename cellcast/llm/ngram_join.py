"""Jaccard self-join on word n-gram sets by a blocked sparse matrix product.

Rows of the incidence matrix are documents with equal n-gram sets taken together; columns are
hashed n-grams.  Two rows link when their overlap reaches the threshold of their union.  The
product is computed only where a bound leaves it open:

* prefix bound: under one global order of n-grams, linked rows share one among each row's first
  ``n - ceil(threshold * n) + 1``.  The order takes frequent n-grams last (a bitmap of fixed size
  marks them; any marking is exact, a good one keeps unrelated rows apart), then goes by hash.
* size bound: the smaller set has at least ``threshold`` times the larger one's size.
* parity bound: a bitmap of the set, where each n-gram flips one bit, differs in at most as many
  bits as the sets differ in n-grams.  It never rules out a link, and takes about a tenth of the set's room.

Columns that rows share become blocks.  A first sweep multiplies each row only with a few pivots
of its blocks, nearest first; rows that are then in one component need no further product, so a
block of near copies costs a few products for each row.  The second sweep covers all pairs of a
block that lie in different components, in square tiles of at most ``TILE`` rows.  What the bounds
leave goes through the exact product, where overlap counts are accumulated from the two rows'
n-grams.  Thus no link between different texts is lost, and none is reported unverified.

Defined results: null and empty texts, and texts of white space, have no n-grams and link with
nothing; a text with fewer than n words is one n-gram; texts are lower-cased in A-Z only; rows
that repeat a ``doc_id`` are one document with all their texts (``n_shingles`` is each row's own);
a null ``doc_id`` links with nothing and has a null component; an empty table gives an empty
table.  A text of any length has all its n-grams counted.  Of ``docs`` only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.common import SharedTables, Words, bits_at, mix, ngram_hashes, return_freed_memory, sliced, tune
from cellcast.llm.components import connected_components
from cellcast.schemas import free_name

N = 5
THRESHOLD = 75  # percent of the union
SLOT_BITS = 26  # bitmaps of n-grams and of documents: 8 MB each, whatever the input
FREQUENT = 16
MOST_FREQUENT = 1 << 22  # marked n-grams, so that the bitmap stays sparse
TILE = 512
ROUNDS = 2
PARITY = 4  # least bits for each n-gram in a parity bitmap
COARSE = 1024  # bits of the parity bitmap that tiles compare

PREFIXES = "doc_id long, n long, rare array<long>, often array<long>"
_GROUP = 1 << 15
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Distinct hashed n-grams of each text, ascending."""
    words = Words(texts, lower=True)
    grams = ngram_hashes(words.hash, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = grams[a : b - n + 1] if b - a >= n else ngram_hashes(words.hash[a:b], b - a) if b > a else grams[:0]
        own = np.sort(own)
        if len(own) > 1:
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        out.append(own)
    return out


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - (threshold * n + 99) // 100 + 1


def ordered(own: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, int]:
    """The set in global order, and how many come before the frequent ones."""
    if marks is None:
        return own, len(own)
    often = bits_at(marks, own, SLOT_BITS)
    return np.concatenate((own[~often], own[often])), int((~often).sum())


def parity_bits(n: int) -> int:
    return min(1 << 18, max(64, 1 << (PARITY * n - 1).bit_length()))


def parity_bitmap(own: np.ndarray, width: int = 0) -> bytes:
    """One bit flipped for each n-gram; a wider bitmap folds to a narrower one by exclusive or."""
    width = width or parity_bits(len(own))
    bit = (mix(own) & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_keys(n: int):
    """Arrow map from (doc_id, text) to each set's size and a 128-bit hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(batch.column("text"), n)
            size = np.array([len(own) for own in sets])
            some = np.flatnonzero(size)
            keys = np.zeros((2, len(sets)), np.uint64)
            if len(some):
                flat, starts = np.concatenate(sets), np.cumsum(size[some]) - size[some]
                with np.errstate(over="ignore"):
                    keys[0, some] = np.add.reduceat(mix(flat + _SALT), starts)
                    keys[1, some] = np.add.reduceat(mix(flat * _SALT), starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(_signed(keys[0])), pa.array(_signed(keys[1]))], names=["doc_id", "n", "h1", "h2"])

    return run


def marked_rows(batch: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
    slot = mix(batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))
    return batch.filter(pa.array(bits_at(marks, slot, SLOT_BITS)))


def prefixes(wanted, frequent, threshold: int, n: int):
    """Prefix of each wanted document's set, in two lists: the frequent n-grams apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, np.uint8)
        often = np.frombuffer(frequent.value, np.uint8) if frequent is not None else None
        kind = pa.list_(pa.int64())
        for batch in sliced(batches, "text"):
            batch = marked_rows(batch, marks)
            lists, size = ([], []), []
            for own in shingle_sets(batch.column("text"), n):
                line, split = ordered(own, often)
                cut = prefix_length(len(own), threshold) if len(own) else 0
                lists[0].append(_signed(line[: min(cut, split)]))
                lists[1].append(_signed(line[min(cut, split) : cut]))
                size.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), *(pa.array(x, kind) for x in lists)], names=["doc_id", "n", "rare", "often"])

    return run


def bitmap_of(rows: DataFrame, column) -> bytearray:
    """Fixed-size bitmap of the slots of a 64-bit column, built by the executors."""
    slot = column.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    # bit numbers inside a bitmap of the SQL function run from 0 to 32767 for inputs 1 to 32768
    found = rows.select((F.shiftright(slot, 15)).alias("part"), F.bitmap_bit_position(slot.bitwiseAND(F.lit(_GROUP - 1)) + 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << (SLOT_BITS - 3))
    for row in found.collect():  # at most 2048 bitmaps of 4 KB; an iterator would run a job for each partition
        out[row["part"] * (_GROUP // 8) : (row["part"] + 1) * (_GROUP // 8)] = row["bits"]
    return out


def parities(wanted, n: int):
    """Parity bitmaps of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, np.uint8)
        for batch in sliced(batches, "text"):
            batch = marked_rows(batch, marks)
            sets = shingle_sets(batch.column("text"), n)
            maps = [pa.array([parity_bitmap(s, width) for s in sets], pa.binary()) for width in (COARSE, 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *maps], names=["doc_id", "coarse", "parity"])

    return run


def incidence(wanted, n: int):
    """Rows of the matrix: the n-grams of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, np.uint8)
        for batch in sliced(batches, "text"):
            batch = marked_rows(batch, marks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_signed(s) for s in shingle_sets(batch.column("text"), n)], pa.list_(pa.int64()))], names=["doc_id", "grams"])

    return run


def doc_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_signed(mix(batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))))], names=["slot"])


def fold(bitmap: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``width`` words."""
    return np.bitwise_xor.reduce(bitmap.reshape(len(bitmap), -1, width), axis=1) if bitmap.shape[1] > width else bitmap


def most_apart(na, nb, threshold: int):
    """Largest number of n-grams in which linked sets of these sizes can differ."""
    least = -(-threshold * (na + nb) // (100 + threshold))  # overlap that the threshold asks for
    return na + nb - 2 * least


def parity_filter(threshold: int):
    """Pairs (a, b, na, nb, pa, pb) that the parity bound leaves open, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "pa", "pb"))):
                x, y = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
                width = min(x.shape[1], y.shape[1])
                apart = int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum())
                if apart <= most_apart(na, nb, threshold):
                    rows.append((a, b, apart))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "apart"])

    return run


def _pairs_of(size: int, left: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Index pairs of a tile with itself (left = 0), or of its first ``left`` rows with the rest."""
    if left:
        i, j = np.divmod(np.arange(left * (size - left)), size - left)
        return i, j + left
    if size not in known:
        known[size] = np.triu_indices(size, 1)
    return known[size]


def tile_product(groups: list[tuple[int, int, int]], rows: dict[str, np.ndarray], threshold: int) -> list[tuple[int, int, int, int]]:
    """Pairs of rows in one tile pair that lie in different components and no bound rules out.

    ``groups`` are (first row, number of rows, rows of side 0 or 0 for one tile).  A pair counts
    only in the block with the smallest n-gram of all blocks that both of its rows are in.
    """
    parts = [_pairs_of(size, left) for _, size, left in groups]
    shift = np.repeat([g[0] for g in groups], [len(p[0]) for p in parts])
    i, j = np.concatenate([p[0] for p in parts]) + shift, np.concatenate([p[1] for p in parts]) + shift
    n, c, word, blocks, starts = (rows[k] for k in ("n", "component", "word", "blocks", "starts"))
    found = []
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        np_, nq = n[p], n[q]
        most = most_apart(np_, nq, threshold)
        # cheapest bounds first: components, sizes, the bitmap folded to one word, the bitmap
        able = np.flatnonzero((c[p] != c[q]) & (100 * np.minimum(np_, nq) >= threshold * np.maximum(np_, nq)) & (np.bitwise_count(word[p] ^ word[q]) <= most))
        p, q, most = p[able], q[able], most[able]
        apart = np.bitwise_count(rows["coarse"][p] ^ rows["coarse"][q]).sum(axis=1)
        for m in np.flatnonzero(apart <= most):
            u, v = int(p[m]), int(q[m])
            common = np.intersect1d(blocks[starts[u] : starts[u + 1]], blocks[starts[v] : starts[v + 1]])
            if common[0] == rows["gram"][u]:
                found.append((int(rows["doc_id"][u]), int(rows["doc_id"][v]), int(n[u]), int(n[v])))
    return found


def tiles(threshold: int):
    """Arrow map over rows sorted by (gram, i, j, side): the open pairs of every tile pair.

    Only the rows of one tile pair (at most two tiles) are held beyond an Arrow batch.
    """

    def solve(batch: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = {c: batch.column(c).to_numpy() for c in ("gram", "side", "doc_id", "n", "component")}
        rows["coarse"] = np.frombuffer(b"".join(batch.column("coarse").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        rows["word"] = np.bitwise_xor.reduce(rows["coarse"], axis=1)
        lists = batch.column("grams").combine_chunks()
        rows["blocks"] = lists.flatten().to_numpy(zero_copy_only=False)
        rows["starts"] = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.append(starts[1:], batch.num_rows)
        zeros = np.concatenate(([0], np.cumsum(rows["side"] == 0)))
        groups = []
        found: list = []
        pending = 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            left = int(zeros[b] - zeros[a])
            left = 0 if left == b - a else left
            groups.append((a, b - a, left))
            pending += (b - a) ** 2
            if pending > 1 << 19:
                found += tile_product(groups, rows, threshold)
                groups, pending = [], 0
        if groups:
            found += tile_product(groups, rows, threshold)
        pairs = [(a, b, na, nb) if a < b else (b, a, nb, na) for a, b, na, nb in found]
        return pa.RecordBatch.from_arrays([pa.array([p[at] for p in pairs], pa.int64()) for at in range(4)], names=["a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            keys = [table.column(c).to_numpy() for c in ("gram", "i", "j")]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield solve(table.slice(0, starts[-1]).combine_chunks(), starts[:-1])
            rest = table.slice(starts[-1]).combine_chunks().to_batches()
        if rest:
            yield solve(pa.Table.from_batches(rest).combine_chunks(), np.zeros(1, np.int64))
        return_freed_memory()

    return run


def product(threshold: int):
    """Exact product: overlap counts of the pairs (a, b, ga, gb), and the links among them.

    The entries of a batch's left and right rows are sorted together by row and column; equal
    neighbours are the products that add up to the overlap of that row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, sizes = [], []
                for c in ("ga", "gb"):
                    column = part.column(c)
                    size = np.diff(column.offsets.to_numpy())
                    row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
                    with np.errstate(over="ignore"):
                        keys.append(mix(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64((1 << 56) - 1) | row << np.uint64(56))
                    sizes.append(size)
                entries = np.sort(np.concatenate(keys))
                equal = entries[1:][entries[1:] == entries[:-1]]
                overlap = np.bincount((equal >> np.uint64(56)).astype(np.int64), minlength=part.num_rows)
                linked = 100 * overlap >= threshold * (sizes[0] + sizes[1] - overlap)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


class JaccardJoin:
    """The join over ``docs`` (``doc_id``, ``text``); see the module's text for the method."""

    def __init__(self, docs: DataFrame, threshold: int = THRESHOLD, n: int = N):
        self.spark = tune(docs.sparkSession)
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
        self.known = self.docs.where("doc_id is not null")
        self.threshold, self.n = threshold, n
        self.shared = SharedTables(self.spark, "ngram-join")

    def marks(self, ids: DataFrame):
        """Broadcast bitmap of document slots; a slot that others share only costs work."""
        slots = ids.select("doc_id").distinct().mapInArrow(doc_slots, "slot long")
        return self.spark.sparkContext.broadcast(bytes(bitmap_of(slots, F.col("slot"))))

    def frequent(self, reps):
        """Bitmap of n-grams that many prefixes hold."""
        grams = self.known.mapInArrow(prefixes(reps, None, self.threshold, self.n), PREFIXES).select(F.explode("rare").alias("gram"))
        often = self.shared.write(grams.groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") >= FREQUENT), "frequent")
        limits = [FREQUENT << (2 * i) for i in range(16)]
        counts = often.agg(*[F.count(F.when(F.col("times") >= x, 1)).alias(str(x)) for x in limits]).first()
        least = next((x for x in limits if counts[str(x)] <= MOST_FREQUENT), limits[-1])
        marks = bitmap_of(often.where(F.col("times") >= least), F.col("gram"))
        self.shared.drop("frequent")
        return self.spark.sparkContext.broadcast(bytes(marks))

    def classes(self, sets: DataFrame) -> DataFrame:
        """Every row's doc_id and the smallest doc_id with an equal set."""
        ids = sets.where("doc_id is not null and n > 0")
        first = ids.groupBy(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2")).agg(F.min("doc_id").alias("rep"))
        return ids.join(first, (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))).select("doc_id", "rep")

    def blocks(self, reps, often) -> DataFrame:
        """``gram``, ``doc_id``, ``n``: the columns that prefixes share, equal ones once.

        Neighbouring n-grams of a passage are mostly shared by the same rows; a block is known by
        its number of rows and two sums of their hashes, and one of each kind is kept.
        """
        rows = self.known.mapInArrow(prefixes(reps, often, self.threshold, self.n), PREFIXES)
        rare = rows.select(F.explode("rare").alias("gram"), "doc_id", "n").withColumn("times", F.count("*").over(Window.partitionBy("gram"))).where("times > 1")
        entries = self.shared.write(rare.select("gram", "doc_id", "n").unionByName(rows.select(F.explode("often").alias("gram"), "doc_id", "n")), "entries")
        decimal = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id", "n").cast("decimal(20,0)"))
        kinds = entries.groupBy("gram").agg(F.count("*").alias("rows"), decimal(1).alias("s1"), decimal(2).alias("s2")).where("rows > 1")
        kept = kinds.groupBy("rows", "s1", "s2").agg(F.min("gram").alias("gram")).select("gram")
        blocks = self.shared.write(entries.join(kept, "gram"), "blocks")
        self.shared.drop("entries")
        return blocks

    def open_pairs(self, pairs: DataFrame, parity: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b, na, nb) that the parity bound leaves open."""
        at = lambda side: parity.select(F.col("doc_id").alias(side), F.col("parity").alias(f"p{side}"))
        full = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
        return self.shared.write(full.mapInArrow(parity_filter(self.threshold), "a long, b long, apart long"), name)

    def verified(self, pairs: DataFrame, grams: DataFrame, name: str) -> DataFrame:
        """The pairs that link, by the exact product."""
        a = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
        b = grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
        full = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ga", "gb")
        return self.shared.write(full.mapInArrow(product(self.threshold), "a long, b long, linked boolean").where("linked").select("a", "b"), name)

    def settle(self, pairs: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Verify candidate pairs until none joins two components; (edges, components).

        Each round takes every row's nearest open pair; what a round has joined needs no product
        any more.  The last round takes all that is left.
        """
        grams = done = None
        for turn in range(ROUNDS + 1):
            component = connected_components(edges, self.shared, f"{name}-{turn}")
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            at = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))  # noqa: B023, E731
            pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "apart")
            pairs = self.shared.write(pairs, f"{name}-open-{turn}")
            if pairs.isEmpty():
                return edges, component
            if grams is None:
                ends = self.marks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
                grams = self.shared.write(self.known.mapInArrow(incidence(ends, self.n), "doc_id long, grams array<long>"), f"{name}-matrix")
            done = pairs
            if turn < ROUNDS:
                nearest = [pairs.groupBy(x).agg(F.min(F.struct("apart", y)).alias("best")).select(F.col(x).alias("x"), F.col(f"best.{y}").alias("y")) for x, y in (("a", "b"), ("b", "a"))]
                done = self.shared.write(nearest[0].unionByName(nearest[1]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-chosen-{turn}")
            edges = self.shared.write(edges.unionByName(self.verified(done, grams, f"{name}-links-{turn}")), f"{name}-edges-{turn}")
        self.shared.drop(f"{name}-matrix")
        return edges, connected_components(edges, self.shared, f"{name}-end")

    def run(self) -> DataFrame:
        """Every row's ``doc_id``, ``n_shingles`` and ``component_id``."""
        shared = self.shared
        sets = shared.write(self.docs.mapInArrow(set_keys(self.n), "doc_id long, n long, h1 long, h2 long"), "sets")
        classes = shared.write(self.classes(sets), "classes")
        reps = self.marks(classes.where("doc_id = rep"))
        blocks = self.blocks(reps, self.frequent(reps))
        held = self.marks(blocks)
        parity = shared.write(self.known.mapInArrow(parities(held, self.n), "doc_id long, coarse binary, parity binary"), "parity")
        # rows that repeat an id tie their classes together
        twice = classes.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
        edges = shared.write(classes.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ties")
        # first sweep: each row with the pivots of its blocks; second: the rest, across components
        edges, component = self.settle(self.pivot_pairs(blocks, parity), edges, "pivots")
        edges, component = self.settle(self.tile_pairs(blocks, parity, component), edges, "tiles")
        own = classes.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
        own = shared.write(own.groupBy("doc_id").agg(F.min("component").alias("component")), "components")
        shared.keep("sets", "components")
        return sets.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def pivot_pairs(self, blocks: DataFrame, parity: DataFrame) -> DataFrame:
        """Pairs of each row with its blocks' smallest, largest and a hashed row, by the bounds."""
        chosen = F.min(F.struct(F.xxhash64("doc_id", "gram"), "doc_id", "n"))
        pivots = blocks.groupBy("gram").agg(F.min(F.struct("doc_id", "n")).alias("p0"), F.max(F.struct("doc_id", "n")).alias("p1"), chosen.alias("p2"))
        each = pivots.select("gram", F.explode(F.array(*[F.struct(F.col(f"p{i}.doc_id").alias("p"), F.col(f"p{i}.n").alias("pn")) for i in range(3)])).alias("q")).select("gram", "q.p", "q.pn")
        size = (100 * F.least("n", "pn") >= self.threshold * F.greatest("n", "pn")) & (F.col("doc_id") != F.col("p"))
        low = F.col("doc_id") < F.col("p")
        pairs = blocks.join(each, "gram").where(size).select(F.when(low, F.col("doc_id")).otherwise(F.col("p")).alias("a"), F.when(low, F.col("p")).otherwise(F.col("doc_id")).alias("b"), F.when(low, F.col("n")).otherwise(F.col("pn")).alias("na"), F.when(low, F.col("pn")).otherwise(F.col("n")).alias("nb"))
        return self.open_pairs(pairs.distinct(), parity, "pivot-pairs")

    def tile_pairs(self, blocks: DataFrame, parity: DataFrame, component: DataFrame) -> DataFrame:
        """Open pairs of all blocks that hold more than one component, tile by tile."""
        placed = blocks.join(component.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("gram", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
        placed = self.shared.write(placed, "placed")
        # blocks of two rows had their only pair in the first sweep
        mixed = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).where("low <> high and rows > 2")
        mixed = mixed.select("gram", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
        rows = self.shared.write(placed.join(mixed, "gram"), "mixed")
        grams = rows.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))  # at most a prefix each
        rows = rows.join(grams.join(parity.select("doc_id", "coarse"), "doc_id"), "doc_id")
        own = F.pmod(F.xxhash64("doc_id"), F.col("tiles").cast("long")).cast("int")
        # a row goes to the tile pairs of its own tile: as side 0 up to its own number, as side 1 after
        spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        keyed = spread.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "n", "component", "coarse", "grams")
        dealt = keyed.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "side")
        found = self.shared.write(dealt.mapInArrow(tiles(self.threshold), "a long, b long, na long, nb long"), "tile-found")
        for name in ("placed", "mixed"):
            self.shared.drop(name)
        return self.open_pairs(found.distinct(), parity, "tile-pairs")


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, n: int = N) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``."""
    return JaccardJoin(docs, threshold, n).run()


def representatives(docs: DataFrame, threshold: int = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of ``docs``, with all their columns, less those that link to a smaller doc_id.

    Rows with a null ``doc_id`` stay; of rows that repeat a ``doc_id`` one stays.  A bitmap of
    fixed size holds the documents to drop; only the few rows whose slot it marks are joined.
    Columns of ``docs`` may have any name.
    """
    spark = docs.sparkSession
    components = jaccard_components(docs, threshold, n).where("doc_id is not null")
    shared = SharedTables(spark, "representatives")
    counted = components.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    at, own, linked, turn = (free_name(x, docs.columns) for x in ("slot", "gone", "linked", "turn"))
    gone = counted.where("component_id < doc_id or rows > 1").select(F.col("doc_id").alias(own), (F.col("component_id") < F.col("doc_id")).alias(linked))
    gone = shared.write(gone, "gone")
    marks = spark.sparkContext.broadcast(bytes(bitmap_of(gone, F.xxhash64(own))))
    placed = docs.withColumn(at, F.xxhash64(docs["doc_id"].cast("long")))
    schema = docs.schema

    def chosen(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                hit = bits_at(bits, batch.column(at).to_numpy().view(np.uint64), SLOT_BITS)
                hit &= ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == want)).drop_columns([at])

        return run

    listed = placed.mapInArrow(chosen(True), schema).join(gone, F.col("doc_id").cast("long") == F.col(own), "left").where(F.col(own).isNull() | ~F.col(linked))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = listed.withColumn(turn, F.when(F.col(own).isNull(), F.lit(1)).otherwise(order)).where(F.col(turn) == 1)
    return placed.mapInArrow(chosen(False), schema).unionByName(one.select(*docs.columns))
