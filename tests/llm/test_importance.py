import hashlib
import math
import random
import re
import zlib
from collections import Counter

from made_words import words
from tripmill.llm import importance

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def expected(rows, target):
    s = Counter(b for _, text, *_ in rows for b in features(text)[1])
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        w, buckets = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in buckets]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(buckets), weight, score, None, len(w)])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(long[: 25 * len(long) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def got(frame, target):
    spark = frame.sparkSession
    goal = spark.createDataFrame([(k, text, "x") for k, text in enumerate(target)], "item_id long, text string, key string")
    return sorted(map(tuple, importance.resample(frame, goal).collect()), key=repr)


def test_equals_brute_force(documents):
    rng = random.Random(9)
    common = [" ".join(words(8, k)) for k in range(40)]
    rows = []
    for i in range(400):
        parts = [rng.choice(common) if rng.random() < 0.6 else " ".join(words(rng.randint(1, 9), 100 + i)) for _ in range(rng.randint(1, 9))]
        rows.append((i, rng.choice(("\n", "\r\n", "\n\n", " \n- ")).join(parts).title()))
    rows += [(1000 + i, "Menu | Home\n" + " ".join(words(25, i))) for i in range(300)]
    target = [" ".join(words(60, k)) + "\nMenu home" for k in range(20)]
    assert got(documents(rows), target) == expected(rows, target)


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(8, "É é\n\n\nÀ 1a-2b\nA"), (9, "one"), (10, "\n\none\n")]
    assert got(documents(rows), ["one two", None, ""]) == expected(rows, ["one two", "", ""])
    assert got(documents([]), ["one two"]) == []
    assert got(documents(rows), []) == expected(rows, [])


def test_lines_are_hashed_once(documents):
    rows = [(i, "the same line of words\nand another one") for i in range(500)]
    kept = importance.distinct_lines(documents(rows)).collect()
    assert sorted((len(row.key), row.n, len(row.buckets)) for row in kept) == [(2, 500, 2), (16, 500, 2 * 5), (16, 500, 2 * 9)]
