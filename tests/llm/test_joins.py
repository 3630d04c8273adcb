"""Line deduplication, n-gram join, vector search, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellcast.llm import line_dedup, ngram_join, queries, vector_topk
from cellcast.llm.common import SharedTables
from cellcast.llm.components import connected_components

PLAIN = [f"plain{i}" for i in range(300)]
VILE = [f"vile{i}" for i in range(12)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOC)


def words(text):
    return (text or "").encode().lower().split()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def near_copies(rng, n, base, edits):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"b{i}" for i in range(60)]
    texts = near_copies(rng, 120, base, 7) + near_copies(rng, 30, base[:12], 2)
    texts += [passage + " " + " ".join(f"u{i}{k}" for k in range(rng.randint(0, 60))) for i in range(60)]
    texts += ["one two", "ONE  two", "one two three", "", None, " \n ", "a b c d e", "A b C d E\t", "a b c d f"] + [texts[0]] * 20
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    u = Union()
    flat = [(i, s) for i, each in sets.items() for s in each if s]
    for x, (i, a) in enumerate(flat):
        u.find(i)
        for j, b in flat[:x]:
            if 100 * len(a & b) >= 75 * len(a | b):
                u.join(i, j)
    return u


@pytest.mark.parametrize("seed, tile", [(1, 512), (2, 16)])
def test_ngram_components(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = corpus(seed)
    got = ngram_join.jaccard_components(table(spark, rows)).collect()
    u = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == u.find(r.doc_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    texts = dict(rows)
    for i, n in sizes.items():
        w = words(texts[i])
        assert n == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)


def test_blocks_of_equal_short_hash(spark):
    short = spark.range(300_000).select(F.xxhash64("id").alias("id")).withColumn("h", F.hash("id"))
    twin = short.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").orderBy("h").first()
    both = short.where(F.col("h") > twin.h).agg(F.max("id")).first()[0]  # a block that rows 1 and 2 are both in
    blocks = [(g, d, 8) for g, docs in ((twin.x, (1, 3, 4)), (twin.y, (2, 5, 6)), (both, (1, 2, 7))) for d in docs]
    own = np.arange(8, dtype=np.uint64)
    parity = [(d, ngram_join.parity_bitmap(own, ngram_join.COARSE), ngram_join.parity_bitmap(own)) for d in range(1, 8)]
    join = ngram_join.JaccardJoin(table(spark, []))
    got = join.tile_pairs(
        spark.createDataFrame(blocks, "gram long, doc_id long, n long"), spark.createDataFrame(parity, "doc_id long, coarse binary, parity binary"), spark.createDataFrame([], "node long, component long")
    )
    assert {(r.a, r.b) for r in got.collect()} == {(1, 3), (1, 4), (3, 4), (2, 5), (2, 6), (5, 6), (1, 2), (1, 7), (2, 7)}


def test_ngram_join_of_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(table(spark, rows)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0
    kept = ngram_join.representatives(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    for one_task in (1 << 20, 40, 0):  # by one task, by rounds over the cluster first, by rounds alone
        got = connected_components(spark.createDataFrame(edges, "a long, b long"), SharedTables(spark, "t"), "t", one_task).collect()
        assert {r.node: r.component for r in got} == {n: u.find(n) for n in u.up}


def test_toxicity_stage_keeps_what_the_query_predicts_clean(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(VILE if i % 7 == 0 and rng.random() < 0.4 else PLAIN) for _ in range(rng.randint(5, 90))) for i in range(700)]
    texts += [None, "", texts[0], texts[1]]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 700) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, p in predicted.items() if not p)
    assert {r.doc_id: r.text for r in kept} == {i: texts[i] for i, p in predicted.items() if not p}
    assert sum(predicted[i] == (i % 7 == 0) for i in range(700)) > 660


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, min_words=1, edits=1, similarity=75):
    lines = [((i, k), words(t)) for i, text in rows if text is not None and i is not None for k, t in enumerate(text.split("\n"))]
    drop = set()
    for place, w in lines:
        if len(w) < min_words:
            continue
        for other, v in lines:
            near = edits and min(len(w), len(v)) >= max(line_dedup.edit_words(edits, similarity), min_words) and distance(w, v) <= 1
            if other < place and (w == v or near):
                drop.add(place)
    return drop


def test_lines(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(10)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = base[: rng.randint(3, 10)]
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + [f"x{rng.randrange(4)}"] + w[k:], w[:k] + [f"x{rng.randrange(4)}"] + w[k + 1 :], w))
            lines.append((" " if rng.random() < 0.2 else "") + rng.choice((" ", "  ")).join(w).upper())
        texts.append("\n".join(lines))
    rows = list(enumerate(texts)) + [(100, ""), (101, None), (102, "\n\n"), (None, texts[0]), (103, " ".join(f"v{i}" for i in range(40_000)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    drop = brute_lines(rows[:-1])
    assert drop and len(got) == len(rows)
    for i, text in rows:
        kept = text if text is None or i is None else "\n".join(t for k, t in enumerate(text.split("\n")) if (i, k) not in drop)
        assert got[i].text == kept and got[i].n_lines == (0 if text is None else len(text.split("\n")))
        assert got[i].n_dropped == sum(d == i for d, _ in drop)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_repeated_document_rows_keep_their_lines(spark):
    same = "one two three four five six seven eight nine"
    got = line_dedup.dedup_lines(table(spark, [(1, same), (1, same), (2, same)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (1, 0), (2, 1)]
    assert [r.doc_id for r in line_dedup.rows_without_duplicates(table(spark, [(1, same), (2, same), (3, "")])).orderBy("doc_id").collect()] == [1, 3]


@pytest.mark.parametrize("options", [{"min_words": 5, "similarity": 87}, {"edits": 0}, {"min_words": 2, "similarity": 50}])
def test_line_parameters(spark, options):
    rng = random.Random(11)
    rows = []
    for i in range(80):
        lines = [[f"w{k}" for k in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        for w in lines:
            w[rng.randrange(len(w))] = f"x{rng.randrange(3)}"
        rows.append((i, "\n".join(map(" ".join, lines))))
    drop = brute_lines(rows, **options)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows), **options).collect()}
    assert drop and got == {i: sum(d == i for d, _ in drop) for i, _ in rows}
    with pytest.raises(ValueError):
        line_dedup.edit_words(2, 75)


def test_hot_lines_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_TIMES", 4)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    rows = [(i, "\n".join(["menu", f"own {i % 40}", "all rights are reserved here" if i % 2 else f"line {i}"])) for i in range(200)]
    drop = brute_lines(rows)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == {i: sum(d == i for d, _ in drop) for i, _ in rows}


def test_later_copies_in_a_marked_slot(spark):
    ids = np.arange(60_000)
    slot = line_dedup.place_slot(ids, np.zeros(len(ids), np.int64), np.uint64(0)) & np.uint64((1 << line_dedup.SLOT_BITS) - 1)
    order = np.argsort(slot, kind="stable")
    pairs = [sorted(ids[order[k : k + 2]].tolist()) for k in np.flatnonzero(slot[order][1:] == slot[order][:-1])]
    pairs = [(a, b) for a, b in pairs if b - a > 1][:8]  # places of two copies of one line in one slot
    assert len(pairs) == 8
    rows = []
    for n, (a, b) in enumerate(pairs):
        line = [f"l{n}x{k}" for k in range(10)]
        apart = line[:5] + [f"o{n}x{k}" for k in range(5)]  # shares a half, is not near
        near = [*line[:9], f"near{n}"]
        rows += [(a, " ".join(line)), (b, " ".join(line)), (100_000 + n, " ".join(apart))]
        if n % 2:  # between the two copies
            rows.append((next(i for i in range(a + 1, b) if i not in {r[0] for r in rows}), " ".join(near)))
    assert len({i for i, _ in rows}) == len(rows)
    drop = brute_lines(rows)
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == {i: int((i, 0) in drop) for i, _ in rows}


def test_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, size=(400, 6)) / 8 + rng.choice([0, 0.001], size=(400, 6))
    vectors[rng.random(vectors.shape) < 0.4] = 0  # ties, zeros
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(400, None, 0), (450, [1.0, None], 0), (500, [float("nan")] * 6, 0), (550, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (601, [1.0, 1.0], 0)]
    for name, size in (("CANDIDATE_CHUNK", 16), ("QUERY_BLOCK", 3), ("CANDIDATE_BLOCK", 90)):  # a grid of several cells
        monkeypatch.setattr(vector_topk, name, size)
    got = vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    known = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in known if i % 50 == 0]:
        scores = sorted((-int(sum(a * b for a, b in zip(known[q], v))), i) for i, v in known.items() if i != q)[:5]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(-s, i) for s, i in scores]
    assert {r.query_id for r in got} == {i for i in known if i % 50 == 0}
    assert vector_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = vector_topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 256 * 128)]


def test_vectors_beyond_64_bits(spark):
    """Huge finite components: exact ranks, scores cut to a long, and no other row disturbed."""
    huge = [[1e30, 1e30], [-1e30, 5.0], [1.5e300, 1e308], [3e15, 3e15], [2.0**62, 1.0], [0.25, -0.5], [1.0, 2.0], [1e30, 1e30 * (1 + 2**-50)]]
    rows = [(i * 25, v) for i, v in enumerate(huge)] + [(i * 25 + 1, v) for i, v in enumerate(huge)] + [(7, [1.0, 2.0]), (8, [1.0, 2.0])]
    got = vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).collect()
    terms = {i: [vector_topk.whole(x, 256) for x in v] for i, v in rows}
    assert terms[0] == [int(1e30) * 256] * 2 and terms[125] == [64, -128]
    for q in [i for i in terms if i % 50 == 0]:
        expected = sorted((-sum(a * b for a, b in zip(terms[q], v)), i) for i, v in terms.items() if i != q)[:6]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.score, r.vec_id) for r in own] == [(max(-(1 << 63), min((1 << 63) - 1, -s)), i) for s, i in expected]


def test_vectors_repeat(spark):
    rows = [(0, [1.0, 1.0]), (0, [0.0, 1.0])] + [(5, [1.0, 0.5])] * 7 + [(3, [1.0, 0.5])]
    got = vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((0, k + 1, 3 if k == 0 else 5, s) for s in (256 * 384, 256 * 128) for k in range(5))


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(40)) + ("\nshared line of some eight words in a row" if i % 3 == 0 else "")) for i in range(200)]
    rows = [(i, t + (" vile dreg vile" if i % 9 == 0 else "")) for i, t in rows]
    rows += [(1000 + i, rows[i][1].replace("\n", " \n")) for i in range(20)] + [(2000, None), (2001, "")]
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert {r.doc_id for r in clean.collect()} >= {i for i, t in rows if not (t and "vile" in t)} and clean.where(F.col("text").contains("vile dreg vile")).count() <= 2
    lined = stages["line dedup"](spark, clean, str(tmp_path)).cache()
    drop = brute_lines([(r.doc_id, r.text) for r in clean.collect()])
    expected = {}
    for r in clean.collect():
        text = r.text if r.text is None else "\n".join(t for k, t in enumerate(r.text.split("\n")) if (r.doc_id, k) not in drop)
        if not (any(i == r.doc_id for i, _ in drop) and not words(text)):
            expected[r.doc_id] = text
    assert {r.doc_id: r.text for r in lined.collect()} == expected and lined.columns == docs.columns
    one = stages["n-gram Jaccard join"](spark, lined, str(tmp_path)).cache()
    u = brute_components([(r.doc_id, r.text) for r in lined.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i in expected if u.find(i) == i)
    mixed = stages["source mixing"](spark, one, str(tmp_path)).cache()
    assert mixed.columns == docs.columns and abs(mixed.count() - one.count()) < 60
    pieces = stages["packing"](spark, mixed, str(tmp_path))
    assert pieces.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_keep_extra_columns(spark, tmp_path):
    rows = [(i, f"word{i} and some other words that make up a line {i}") for i in range(30)] + [(40, None), (None, "x"), (41, "")]
    docs = table(spark, rows)
    used = "linked drops n_lines label fold mix_copy component_id slot score gone turn doc of parts law times place held_out passages h g rows rep"
    for name in [n for u in used.split() for n in (u, f"_{u}", f"_mix_{u}")]:
        docs = docs.withColumn(name, F.lit("own"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert set(got.columns) == set(docs.columns), name
        if name != "source mixing":
            assert got.where("doc_id = 41 or doc_id is null").count() == 2, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
