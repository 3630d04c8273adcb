"""URL filter: rules by host and path, and a logistic regression for the rest.

The classifier sees hashed character n-grams of host and path and learns from a small labelled
table of URL patterns kept here.  Rules come first; where none fits, the classifier decides.

Host, path and rule are column expressions; only the classifier runs in Python.

Defined results: host and path of a null URL, or one without ``://``, are empty and are judged
like any other (no rule fits an empty host); rows are judged one by one, so ties and repeated
rows repeat; a null ``page_id`` stays null; an empty table gives an empty table.  No url content
is dropped: whole hosts and paths are hashed whatever their length.  Of the table only ``page_id``
and ``url`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import sliced, tune

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
GRAMS = (3, 4, 5)
SLOTS = 1 << 14
EPOCHS, RATE, L2 = 1_000, 20.0, 2e-6

#: The labelled table is made from these words.  Unwanted hosts name a trade or a trick, alone or
#: beside a lure; wanted hosts are common words, compounds of them, and names that mean nothing,
#: which are spelled by rule (``invented``).  Paths are written like those of common web software.
TRADES = "ads adserver adclick track tracker banner casino poker bets betting slots jackpot xxx porn adult sex escort pills pharma viagra loans payday crack warez torrent spam malware phish farm linkfarm doorway popup coupon replica".split()
LURES = "cheap free best win online hot fast easy top real super instant bonus lucky mega x vip".split()
PLAIN = "www blog news docs wiki library museum journal school science health recipes travel weather sports history archive research community forum help support city mobile open data daily local world green river stone garden".split()
SUFFIXES = "com org net info io edu gov co.uk de fr es".split()
BLOCKED_PATHS = "/ads/banner /adclick /track/pixel /casino/bonus /poker/free /xxx/video /porn/gallery /escort/list /pills/cheap /loans/fast /warez/crack /torrent/download /popup /redirect/affiliate /tag/spam /download.exe".split()
PLAIN_PATHS = "/ /{w} /{w}/ /{w}/{n} /{w}/{w}.html /{w}/{n}.html /{n} /{n}/{w} /{y}/{w} /{y}/{n}/{w}.php /index.php /{w}/page/{n} /~{w}/{w}.htm /{w}_{n}.pdf".split()
CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiou"

_PARTS = "://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _UPPER.lower()), F.regexp_extract(url, _PARTS, 2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does.

    ``rules`` are a list for people to keep: one expression that stops at the first that fits.
    """
    rule = verdict = None
    for kept, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = path.startswith(p) & ((host == h) | host.endswith(f".{h}"))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kept) if verdict is None else verdict.when(fits, kept)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def invented(seed: str) -> str:
    """A name that means nothing: syllables of one or two consonants and a vowel."""
    draw = zlib.crc32(seed.encode())
    out = ""
    for _ in range(2 + draw % 3):
        draw = (draw * 1_103_515_245 + 12_345) % (1 << 31)
        a, b, c = (draw >> 3) % 21, (draw >> 9) % 42, (draw >> 16) % 5
        out += CONSONANTS[a] + (CONSONANTS[b] if b < 10 else "") + VOWELS[c]
    return out + (CONSONANTS[draw % 21] if draw % 2 else "")


@functools.cache
def training_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): the small labelled table, some two thousand rows."""
    pick = lambda key, words: words[zlib.crc32(key.encode()) % len(words)]

    def plain_path(i: int) -> str:
        word = invented(f"path {i}") if i % 2 else pick(f"word {i}", PLAIN)
        return PLAIN_PATHS[i % len(PLAIN_PATHS)].format(w=word, n=zlib.crc32(f"number {i}".encode()) % 10 ** (1 + i % 6), y=1995 + i % 30)

    hosts = [(trade, 1) for trade in TRADES]
    hosts += [(f"{lure}-{trade}" if i % 2 else f"{trade}-{lure}", 1) for i, trade in enumerate(TRADES) for lure in LURES]
    hosts += [(f"{a}-{b}", 1) for i, a in enumerate(TRADES) for b in (TRADES[(i + 3) % len(TRADES)], pick(a, PLAIN))]
    hosts += [(f"{a}-{b}", 0) for i, a in enumerate(PLAIN) for b in PLAIN[:8] if a != b]
    hosts += [(word, 0) for word in PLAIN] + [(invented(f"host {i}"), 0) for i in range(900)]
    rows = []
    for i, (host, label) in enumerate(hosts):
        front = ("", "www.", "m.", "blog.", f"{invented(f'front {i}')}.")[i % 5]
        rows.append((f"{front}{host}.{SUFFIXES[i % len(SUFFIXES)]}", plain_path(i), label))
    for i in range(900):  # plain hosts, with unwanted paths now and then
        unwanted = i % 3 == 0
        host = f"{('www.', 'm.', 'blog.', '')[i % 4]}{invented(f'plain {i}')}.{SUFFIXES[i % len(SUFFIXES)]}"
        rows.append((host, pick(f"path {i}", BLOCKED_PATHS) if unwanted else plain_path(i + 1), int(unwanted)))
    return rows


def slots(host: str, path: str) -> np.ndarray:
    """Hashed n-grams; host and path have their own, each marked at its ends."""
    out = []
    for mark, text in ((b"h", host), (b"p", path)):
        data = np.frombuffer(b"\x02" + text.lower().encode("utf-8", "replace") + b"\x03", np.uint8).astype(np.uint64)
        seed = np.uint64(zlib.crc32(mark))
        with np.errstate(over="ignore"):
            for n in GRAMS:
                if len(data) >= n:
                    acc = np.full(len(data) - n + 1, seed + np.uint64(n), np.uint64)
                    for k in range(n):
                        acc = (acc ^ data[k : k + len(acc)]) * np.uint64(0x100000001B3)
                    out.append((acc ^ (acc >> np.uint64(29))) % np.uint64(SLOTS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


@functools.cache
def weights() -> np.ndarray:
    """Logistic regression by full-batch gradient descent; the last entry is the intercept."""
    rows = training_table()
    features = [slots(h, p) for h, p, _ in rows]
    label = np.array([y for *_, y in rows], float)
    index, row = np.concatenate(features), np.repeat(np.arange(len(rows)), [len(f) for f in features])
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(rows)))
    w = np.zeros(SLOTS + 1)
    for _ in range(EPOCHS):
        z = np.bincount(row, w[index], len(rows)) * scale + w[-1]
        error = 1 / (1 + np.exp(-z)) - label
        grad = np.bincount(index, (error * scale)[row], SLOTS) / len(rows)
        w[:-1] -= RATE * (grad + L2 * w[:-1])
        w[-1] -= error.mean()
    return w


def score(host: str, path: str, w: np.ndarray) -> float:
    at = slots(host, path)
    z = float(w[at].sum() / np.sqrt(max(len(at), 1)) + w[-1])
    return 1 / (1 + np.exp(-z))


def scorer(w: np.ndarray):
    """Arrow map that adds the classifier's score to rows with ``host`` and ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "path"):
            scores = [score(h, p, w) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row of ``pages``.

    A narrow map, nothing shuffled.  The weights (``SLOTS`` + 1 numbers) are trained on the driver
    and travel with the task.
    """
    tune(pages.sparkSession)
    host, path = url_parts(pages["url"].cast("string"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    scored = rows.mapInArrow(scorer(weights()), "page_id long, host string, path string, rule string, verdict string, score double")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
