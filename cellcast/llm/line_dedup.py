"""Line deduplication by a deletion-neighbourhood join.

A line is its words, lower-cased in A-Z.  A line that equals an earlier one is dropped, and so is
one that lies within the edit bound of an earlier one: a word replaced, inserted or removed, where
both lines have enough words that one edit leaves them ``similarity`` percent alike (4 words for
75).  Earlier means a smaller (doc_id, line number).  Whether the earlier line is itself dropped
does not matter, so the result does not depend on any order of work.  Parameters are the fewest
words that a line must have to be compared at all (default 1: every line with a word), the edits
(1, or 0 for equality only) and the similarity.

The neighbourhood of a line is the line and all variants with one word removed, as hashed keys.
Two lines are one replacement apart when they share a variant with the removed word at the same
place, and one insertion apart when a variant of the longer equals the shorter; so each group of
equal keys needs only its earliest line, never its pairs.  Every proposal is verified by the edit
distance of the words themselves.  Variants are emitted for every line that can have a partner:
an edit leaves the first or the last half of a line as it was, so lines that share neither half
with another line have none.  Hot lines are counted by partial aggregation, and their verdicts are
broadcast after a count of them, so that no task gets all places of one line.

Defined results: a null text stays null and has no lines; an empty text has one empty line; lines
without words are never dropped; a row with a null ``doc_id`` is returned as it is and never makes
another line a duplicate; rows that repeat a ``doc_id`` are copies of one document at one place, so
equal lines at an equal line number are the same line; an empty table gives an empty table.  Lines
and texts of any length are compared whole.  Columns of ``docs`` may have any name; ``n_lines`` and
``n_dropped`` take the place of columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellcast.llm.common import _INV, _POW, SharedTables, Words, _powers, bits_at, mix, sliced, tune
from cellcast.llm.ngram_join import SLOT_BITS, bitmap_of
from cellcast.schemas import free_name

MIN_WORDS = 1
EDITS = 1
SIMILARITY = 75
HOT_LINES = 20_000  # rows of 33 bytes that are broadcast
HOT_TIMES = 256

_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


class Lines:
    """Lines of a batch of texts with hashes of their words.

    ``text``/``number`` say which line it is, ``words`` which words it has (start, end), ``h`` and
    ``g`` are two independent 64-bit hashes.  Lines without words are left out.
    """

    def __init__(self, texts: pa.Array):
        self.all = words = Words(texts, lower=True)
        breaks = np.flatnonzero(words.data == 10)
        before = np.searchsorted(breaks, words.start)  # line breaks before each word, in the batch
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        base = np.searchsorted(breaks, words.offsets[:-1])
        new = np.ones(len(words), bool)
        new[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.start, self.end = first, np.append(first[1:], len(words))
        self.text = text[first]
        self.number = before[first] - base[self.text]
        self.size = self.end - self.start
        place = np.arange(len(words)) - np.repeat(first, self.size)
        longest = int(self.size.max(initial=1))
        self.p, self.q = _powers(_POW, longest + 1), _powers(_INV, longest + 1)
        with np.errstate(over="ignore"):
            weighted = words.hash * self.p[place]
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
            total = self.sums[self.end] - self.sums[self.start]
            self.h = mix(total + self.size.astype(np.uint64) * _SALT)
            other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words.hash ^ _SALT) * self.p[place])))
            self.g = mix(other[self.end] - other[self.start])
        self.n_lines = np.diff(np.searchsorted(breaks, words.offsets)) + 1

    def halves(self, at: np.ndarray) -> np.ndarray:
        """Four keys a line: its first and last (n-1)//2 and n//2 words."""
        start, end, n = self.start[at], self.end[at], self.size[at]
        out = []
        with np.errstate(over="ignore"):
            for k in ((n - 1) // 2, n // 2):
                tag = k.astype(np.uint64) * _SALT
                left = self.sums[start + k] - self.sums[start]
                right = (self.sums[end] - self.sums[end - k]) * self.q[n - k]
                out += [mix(left + tag), mix(right + tag + np.uint64(1))]
        return np.column_stack(out)

    def variants(self, i: int) -> np.ndarray:
        """Hash of the whole line, then of the line without its word 0, 1, ..."""
        a, b, n = self.start[i], self.end[i], int(self.size[i])
        with np.errstate(over="ignore"):
            sums = self.sums[a : b + 1] - self.sums[a]
            left = sums[:-1] + (sums[-1] - sums[1:]) * self.q[1]
            return mix(np.concatenate((sums[-1:] + np.uint64(n) * _SALT, left + np.uint64(n - 1) * _SALT)))

    def string(self, i: int) -> str:
        a, b = self.all.start[self.start[i]], self.all.end[self.end[i] - 1]
        return b" ".join(self.all.data[a:b].tobytes().split()).decode("utf-8", "replace")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def edit_words(edits: int, similarity: int) -> int:
    """Fewest words of lines that an edit leaves alike enough; equality alone needs none."""
    if edits not in (0, 1):
        raise ValueError("the neighbourhood is of one removed word: edits must be 0 or 1")
    if not 0 <= similarity < 100:
        raise ValueError("similarity must be a percentage below 100")
    return -(-100 // (100 - similarity)) if edits else 1 << 62


def occurrences(min_words: int, edit_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            lines = Lines(batch.column("text"))
            keep = np.flatnonzero(lines.size >= min_words)
            ids = batch.column("doc_id").to_numpy()[lines.text[keep]]
            halves = lines.halves(keep)
            near = lines.size[keep] >= edit_from
            offsets = np.concatenate(([0], np.cumsum(4 * near))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(halves[near].reshape(-1).copy())))
            columns = [pa.array(ids), pa.array(lines.number[keep]), pa.array(_signed(lines.h[keep])), pa.array(_signed(lines.g[keep])), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "h", "g", "halves"])

    return run


def place_slot(doc: np.ndarray, line: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.int64).view(np.uint64) + _SALT) + line.astype(np.uint64)) ^ h


def marked(marks: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return bits_at(marks, slot, SLOT_BITS)


def place_slots(partnered):
    """Places of lines with a marked half, with their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(partnered.value, np.uint8)
        for batch in batches:
            column = batch.column("halves")
            hit = marked(marks, column.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            some = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))]) > 0
            slot = place_slot(batch.column("doc_id").to_numpy(), batch.column("line").to_numpy(), batch.column("h").to_numpy().view(np.uint64))
            own = batch.select(["h", "g", "doc_id", "line"]).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(_signed(slot[some]))], names=["h", "g", "doc_id", "line", "slot"])

    return run


def neighbourhoods(places, edit_from: int):
    """Variant keys and words of the lines whose place is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(places.value, np.uint8)
        kind = pa.list_(pa.int64())
        for batch in sliced(batches, "text", 1 << 20):
            lines = Lines(batch.column("text"))
            able = np.flatnonzero(lines.size >= edit_from)
            ids = batch.column("doc_id").to_numpy()
            able = able[marked(marks, place_slot(ids[lines.text[able]], lines.number[able], lines.h[able]))]
            if len(able):
                columns = [pa.array(_signed(lines.h[able])), pa.array(_signed(lines.g[able])), pa.array(ids[lines.text[able]]), pa.array(lines.number[able]), pa.array([_signed(lines.variants(i)) for i in able], kind), pa.array([lines.string(i) for i in able])]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc_id", "line", "keys", "words"])

    return run


def marked_keys(shared_keys):
    """The keys of each line whose slot is marked, with their position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared_keys.value, np.uint8)
        for batch in batches:
            column = batch.column("keys")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(marked(marks, flat.view(np.uint64)))
            own = batch.select(["h", "g", "doc_id", "line"]).take(pa.array(row[hit]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pos[hit].astype(np.int32)), pa.array(flat[hit])], names=["h", "g", "doc_id", "line", "pos", "key"])

    return run


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word lists is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [within_one(x.split(" "), y.split(" ")) for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist())]
        yield batch.select(["h", "g"]).filter(pa.array(same, pa.bool_()))


def rebuild(list_name: str):
    """Drop the listed lines; a listed line must have the listed hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            column = batch.column("text")
            lines = Lines(column)
            spans = np.searchsorted(lines.text, np.arange(batch.num_rows + 1))
            texts, dropped = [], []
            for row, (text, drops) in enumerate(zip(column.to_pylist(), batch.column(list_name).to_pylist())):
                a, b = spans[row], spans[row + 1]
                own = dict(zip(lines.number[a:b].tolist(), _signed(lines.h[a:b]).tolist()))
                gone = {d["line"] for d in drops or () if own.get(d["line"]) == d["h"]}
                texts.append("\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone) if gone else text)
                dropped.append(len(gone))
            rest = {c: batch.column(c) for c in batch.schema.names if c not in ("text", list_name)}
            made = {"text": pa.array(texts, pa.string()), "n_lines": _counts(lines, column), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(rest | made)

    return run


def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        words = Words(batch.column("text"))
        breaks = np.searchsorted(np.flatnonzero(words.data == 10), words.offsets)
        n = pa.array(np.where(batch.column("text").is_null().to_numpy(zero_copy_only=False), 0, np.diff(breaks) + 1))
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"n_lines": n, "n_dropped": pa.array(np.zeros(batch.num_rows, np.int64))})


def _counts(lines: Lines, column: pa.Array) -> pa.Array:
    return pa.array(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lines.n_lines))


def places_of(verdict: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences (of ``found``) of the lines that have a verdict, with it.

    Lines that occur most are few, as their places add up to those in the table: the limit from
    which a line is hot rises until ``HOT_LINES`` are left, which are then broadcast.
    """
    limits = [HOT_TIMES << (3 * i) for i in range(16)]
    sizes = verdict.agg(*[F.count(F.when(F.col("times") >= x, 1)).alias(str(x)) for x in limits]).first()
    least = next(x for x in limits if sizes[str(x)] <= HOT_LINES or x == limits[-1])
    rare = found.join(verdict.where(F.col("times") < least), ["h", "g"])
    if not sizes[str(least)]:
        return rare
    hot = F.broadcast(verdict.where(F.col("times") >= least))
    rest = found.join(F.broadcast(verdict.where(F.col("times") >= least).select("h", "g")), ["h", "g"], "left_anti")
    return rest.join(verdict.where(F.col("times") < least), ["h", "g"]).unionByName(found.join(hot, ["h", "g"]))


def duplicate_lines(docs: DataFrame, shared: SharedTables, min_words: int = MIN_WORDS, edits: int = EDITS, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id``, ``line``, ``h`` of every line occurrence to drop (a table in the shared folder)."""
    known = docs.where("doc_id is not null and text is not null")
    edit_from = edit_words(edits, similarity)
    found = shared.write(known.mapInArrow(occurrences(min_words, edit_from), "doc_id long, line long, h long, g long, halves array<long>"), "lines")
    # the earliest place of every distinct line
    distinct = found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line")).alias("place"), F.count("*").alias("times"), F.first("halves").alias("halves"))
    distinct = shared.write(distinct, "distinct")
    verdict = distinct.select("h", "g", "place", "times").withColumn("near", F.lit(False))
    if edits:
        near = near_lines(known, distinct, shared, max(edit_from, min_words))
        verdict = distinct.select("h", "g", "place", "times").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    verdict = shared.write(verdict.where("times > 1 or near"), "verdict")
    places = places_of(verdict, found.select("doc_id", "line", "h", "g"))
    drops = places.where(F.col("near") | (F.struct("doc_id", "line") != F.col("place"))).select("doc_id", "line", "h")
    drops = shared.write(drops.distinct(), "drops")
    shared.keep("drops")
    return drops


def near_lines(known: DataFrame, distinct: DataFrame, shared: SharedTables, edit_from: int) -> DataFrame:
    """``h``, ``g`` of the lines within the edit bound of an earlier one."""
    spark = known.sparkSession
    # lines that share a half with another line, at their earliest place; a slot of the first
    # bitmap that unlike halves share only adds lines to the join
    halves = distinct.select(F.explode("halves").alias("half"), "h")
    common = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    partnered = spark.sparkContext.broadcast(bytes(bitmap_of(common, F.col("half"))))
    places = distinct.select("h", "g", "place.doc_id", "place.line", "halves").mapInArrow(place_slots(partnered), "h long, g long, doc_id long, line long, slot long")
    places = shared.write(places, "places")
    marks = bitmap_of(places, F.col("slot"))
    lines = known.mapInArrow(neighbourhoods(spark.sparkContext.broadcast(bytes(marks)), edit_from), "h long, g long, doc_id long, line long, keys array<long>, words string")
    # later copies share slots with marked places; only the earliest place may stand for a line
    lines = shared.write(lines.join(places.drop("slot"), ["h", "g", "doc_id", "line"], "left_semi"), "neighbourhoods")
    # join equal variants, of which most have no equal: each group needs only its earliest member
    repeated = lines.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    shared_keys = spark.sparkContext.broadcast(bytes(bitmap_of(repeated, F.col("key"))))
    keys = lines.select("h", "g", "doc_id", "line", "keys").mapInArrow(marked_keys(shared_keys), "h long, g long, doc_id long, line long, pos int, key long")
    keys = shared.write(keys, "keys").select("h", "g", F.struct("doc_id", "line", "h", "g").alias("place"), "pos", "key")
    whole = keys.where("pos = 0").groupBy("key").agg(F.min("place").alias("shorter"))
    replaced = keys.where("pos > 0").groupBy("key", "pos").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    first_longer = keys.where("pos > 0").groupBy("key").agg(F.min("place").alias("longer"))
    proposals = (
        keys.where("pos > 0").join(replaced.select("key", "pos", "first"), ["key", "pos"]).where("first < place").select("h", "g", F.col("first").alias("other"))
        .unionByName(keys.where("pos > 0").join(whole, "key").where("shorter < place").select("h", "g", F.col("shorter").alias("other")))
        .unionByName(keys.where("pos = 0").join(first_longer, "key").where("longer < place").select("h", "g", F.col("longer").alias("other")))
    ).select("h", "g", F.col("other.h").alias("oh"), F.col("other.g").alias("og")).where("h <> oh or g <> og").distinct()
    words = lines.select("h", "g", "words").groupBy("h", "g").agg(F.first("words").alias("words"))
    other = words.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("words").alias("other"))
    pairs = proposals.join(words, ["h", "g"]).join(other, ["oh", "og"]).select("h", "g", "words", "other")
    return pairs.mapInArrow(verify, "h long, g long").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, edits: int = EDITS, similarity: int = SIMILARITY) -> DataFrame:
    """The columns of ``docs``, with ``text`` less its dropped lines, and ``n_lines``, ``n_dropped``.

    Documents that lose nothing are read and returned without a shuffle.
    """
    spark = tune(docs.sparkSession)
    shared = SharedTables(spark, "line-dedup")
    docs = docs.drop("n_lines", "n_dropped").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    at, doc, gone = (free_name(x, docs.columns) for x in ("slot", "doc", "gone"))
    drops = duplicate_lines(docs.select("doc_id", "text"), shared, min_words, edits, similarity)
    marks = spark.sparkContext.broadcast(bytes(bitmap_of(drops.select("doc_id").distinct(), F.xxhash64("doc_id"))))
    listed = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("line", "h")).alias(gone))

    def chosen(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                own = marked(bits, batch.column(at).to_numpy().view(np.uint64)) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(own == want)).drop_columns([at])

        return run

    placed = docs.withColumn(at, F.xxhash64("doc_id"))
    other = [f for f in docs.schema.fields if f.name != "text"]
    counted = [StructField(c, LongType()) for c in ("n_lines", "n_dropped")]
    order = [*docs.columns, "n_lines", "n_dropped"]
    joined = placed.mapInArrow(chosen(True), docs.schema).join(listed, F.col("doc_id") == F.col(doc), "left").drop(doc)
    hit = joined.mapInArrow(rebuild(gone), StructType([*other, docs.schema["text"], *counted]))
    pick = chosen(False)
    rest = placed.mapInArrow(lambda batches: untouched(pick(batches)), StructType([*docs.schema.fields, *counted]))  # one Python worker a task
    return hit.select(*order).unionByName(rest.select(*order))


def rows_without_duplicates(docs: DataFrame, min_words: int = MIN_WORDS, edits: int = EDITS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` less dropped lines; documents whose words are all dropped go, ``n_chars`` follows."""
    kept = dedup_lines(docs, min_words, edits, similarity).where("n_dropped = 0 or text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else kept
