"""Small tables of odd documents, and brute-force versions that the operators are held against."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def frame(spark, rows):
    """(doc_id, text) or (doc_id, text, source) rows as documents."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)


def clashing(df):
    """df with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["__id", "__th", "__no", "__key", "__exact", "__near", "__text", "__score", "__predicted", "__bucket", "__order", "__at", "__rank", "__place", "__shard", "__source", "_key", "n_exact", "n_near"]
    names += ["score", "predicted", "fp", "component_id", "n_lines", "h1", "line", "id", "node", "bucket", "shard", "slot", "length", "rank", "failed", "words", "size", "part", "key"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t \n"),
    (4, "one"),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (6, "same line here for all\nsame line here for all\nother line"),
    (6, "same line here for all\nsame line here for all\nother line"),
    (None, "a document without an id but with several words in it"),
    (7, "w" * 5000 + " " + "long word"),
    (8, "many words " * 3000),
    (9, "Ünïcödé ß İ Σας \U0001f600 é \x00 \x01 \x1c \x85 \xa0 <|endoftext|>"),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def best_fit_decreasing(lengths, capacity):
    """Sequences that best fit, longest first, needs."""
    import bisect

    rooms, made = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms.pop(k)
        else:
            room, made = capacity, made + 1
        if room - n:
            bisect.insort(rooms, room - n)
    return made


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def dedup_brute(docs, least=16):
    """{doc index: (n_exact, n_near, text)} by comparing every line with all others."""
    places = {}
    key = lambda d: (d[0] is not None, d[0] or 0)
    for d in docs:
        for k, line in enumerate((d[1] or "").split("\n")):
            if WORD.search(line):
                places.setdefault(line, []).append((key(d), d[1], k))
    order = {x: i for i, x in enumerate(sorted({p for v in places.values() for p in v}, key=lambda p: (p[0], _th(p[1]), p[2])))}
    first = {line: min(v, key=lambda p: order[p]) for line, v in places.items()}
    lines = sorted(first, key=lambda x: order[first[x]])
    near = {x for i, x in enumerate(lines) if len(x) >= least and any(len(y) >= least and edit_within_one(x, y) for y in lines[:i])}
    out = []
    for d in docs:
        if d[1] is None:
            out.append((0, 0, None))
            continue
        kept, exact, close = [], 0, 0
        for k, line in enumerate(d[1].split("\n")):
            if not WORD.search(line):
                kept.append(line)
            elif (key(d), d[1], k) != first[line]:
                exact += 1
            elif line in near:
                close += 1
            else:
                kept.append(line)
        out.append((exact, close, "\n".join(kept)))
    return out


def _th(text):
    import xxhash

    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >= 1 << 63 else v


def simhash_brute(text, shingle=4):
    import xxhash

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(fps))]


def measures_brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
