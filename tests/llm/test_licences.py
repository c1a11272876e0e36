import math
import random
import re

from tripmill.llm import licences

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def expected(rows):
    out = []
    for i, text, *_ in rows:
        text = (text or "").translate(UPPER)
        tokens = WORD.findall(text)
        starts, base = [], set()
        for phrase, label in licences.PHRASES.items():
            wanted = phrase.split()
            here = [k for k in range(len(tokens)) if tokens[k : k + len(wanted)] == wanted]
            starts += here
            base |= {label} if here else set()
        found, most = set(), 0.0
        for label, template in licences.TEMPLATES.items():
            wanted, n = set(template.split()), len(template.split())
            length = n + max(2, math.ceil(n / 4))
            shared = max((len(set(tokens[k : k + length]) & wanted) for k in range(len(tokens))), default=0)
            if shared >= math.ceil(licences.THRESHOLD * len(wanted) - 1e-9):
                found.add(label)
                most = max(most, shared / len(wanted))
        out.append((
            i, len(tokens), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if starts else most,
        ))
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, licences.scan(frame).collect()), key=repr)


def test_equals_brute_force(documents):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            tokens = rng.choice(list(licences.TEMPLATES.values()) + ["all rights reserved", "cc by"]).split()
            tokens = [t if rng.random() < rng.choice((1, 0.85, 0.6)) else "zz" for t in tokens]
            lines.append(rng.choice((" ", ", ", "-")).join(tokens).title())
        rows.append((i, "\n".join(lines)))
    rows += [
        (900, "CC-BY cc.by ccby cc\nby cc é by ccc by cc bye"),
        (901, "général public license; GENERAL  PUBLIC\tLICENSE"),
        (902, "all rights all rights reserved reserved all rights reserveds"),
        (903, "Kall rights reserved"),
    ]
    assert got(documents(rows)) == expected(rows)


def labels_of(documents, *texts):
    found = licences.scan(documents(list(enumerate(texts)))).collect()
    return [row.labels for row in sorted(found, key=lambda row: row.doc_id)]


def test_notices_that_wrap_are_found(documents):
    assert labels_of(
        documents,
        "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software",
        "# Licensed under the\n# Apache License,\n#  Version 2.0 (the License)",
        "/*\n * This work is licensed\n * under the GNU\n *\n * General Public License\n * version 3\n */",
    ) == ["mit-text", "apache-2.0", "gpl,gpl-3.0"]


def test_words_of_a_notice_spread_over_a_text_are_none(documents):
    rng = random.Random(2)
    filler = [f"w{rng.randint(0, 400)}" for _ in range(1500)]
    for place, word in enumerate(licences.TEMPLATES["unlicense"].split()):
        filler.insert(place * 130, word)
    close = " ".join(licences.TEMPLATES["unlicense"].split() + filler)
    assert labels_of(documents, " ".join(filler), close) == ["", "unlicense"]


def test_equals_brute_force_in_long_texts(documents):
    rng = random.Random(8)
    tokens = sorted({t for template in licences.TEMPLATES.values() for t in template.split()})
    rows = []
    for i in range(40):
        words = rng.choices(tokens + ["zz"] * 30, k=rng.choice((30, 200, 1500)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at:at] = [t for t in rng.choice(list(licences.TEMPLATES.values())).split() if rng.random() < 0.9]
        rows.append((i, "".join(w + rng.choice((" ", " ", "\n", ".")) for w in words)))
    assert got(documents(rows)) == expected(rows)


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(8, "released under the MIT license"), (8, "released under the MIT license"), (8, "none")]
    assert got(documents(rows)) == expected(rows)
    assert got(documents([])) == []


def test_no_python_on_the_executors(documents, monkeypatch):
    frame = documents([(1, "x")])
    texts = licences.parsed(licences.TEMPLATES, licences.THRESHOLD)
    plan = licences.scan(frame)._jdf.queryExecution().toString()
    seen = []
    monkeypatch.setattr(licences.common, "cut", lambda each: seen.append(each) or each)
    licences.read(frame, texts)
    plan += seen[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
