"""Frames of awkward rows, and brute-force versions of the operators."""

import collections
import hashlib
import math
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as further columns of the input.
CLASHING = ("row", "key", "n", "digest", "text_hash", "group", "label", "size", "place", "items")

LONG = "alpha beta gamma " * 30_000
WALL = "x" * 200_000
PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards vex a bold judge and "
    "nobody near the old harbour minds the noise of their quarrel at all"
)


def awkward(spark):
    rows = [
        (1, PROSE, "en", "a"),
        (1, PROSE, "en", "a"),
        (2, PROSE.upper() + " end", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b ", "en", "b"),
        (6, LONG, "en", "b"),
        (7, WALL, "en", "a"),
        (None, PROSE, "en", None),
        (None, None, None, None),
        (8, "one", "de", "c"),
        (9, "123 456 !!!", "de", "c"),
        (10, "Ünïcode \U0001f600 ß Σας ﬁ", "de", "c"),
        (11, PROSE, None, "a"),
        (11, LONG, "fr", "b"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(rows, number=80, of=100):
    """Per row the smallest id reachable, by comparing all pairs of different sets."""
    sets = collections.defaultdict(list)
    for at, (_, text) in enumerate(rows):
        sets[frozenset(shingle_set(text))].append(at)
    keys = [k for k in sets if k]
    root = {k: k for k in keys}

    def find(k):
        while root[k] is not k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if min(len(a), len(b)) * of >= max(len(a), len(b)) * number:
                both = len(a & b)
                if of * both >= number * (len(a) + len(b) - both):
                    root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k in keys:
        least[find(k)] += [rows[at][0] for at in sets[k] if rows[at][0] is not None]
    out = []
    for doc_id, text in rows:
        key = frozenset(shingle_set(text))
        if key:
            group = least[find(next(k for k in keys if k == key))]
            out.append((doc_id, len(key), min(group) if group else None))
        else:
            out.append((doc_id, 0, doc_id))
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bench_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def contamination(rows, items, window=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows[tuple(words[i : i + size])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                which = windows.get(tuple(words[i : i + size]))
                if which:
                    hit |= set(range(i, i + size))
                    found |= which
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out.append((doc_id, len(words), len(hit), len(found), digest, bad))
    return out


def bm25(rows, queries, top):
    docs = [
        (i, collections.Counter((t or "").encode().lower().split())) for i, t in rows
    ]
    held = collections.Counter(w for _, c in docs for w in c)
    mean = max(1, sum(sum(c.values()) for _, c in docs)) / len(docs)
    out = []
    for query, text in queries:
        scored = []
        for doc_id, counts in docs:
            length, score = sum(counts.values()), 0.0
            for w in set((text or "").encode().lower().split()):
                if w in counts:
                    idf = math.log1p((len(docs) - held[w] + 0.5) / (held[w] + 0.5))
                    norm = 1.2 * (0.25 + 0.75 * length / mean)
                    score += idf * counts[w] * 2.2 / (counts[w] + norm)
            if score > 0:
                scored.append((-round(score, 6), doc_id is None, doc_id))
        for s, _, doc_id in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]:
            out.append((query, doc_id, -s))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
