"""Small documents with every awkward case, and brute-force versions of the operators."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, size long, score double, sid long, word string"


def frame(spark, rows):
    """Rows (doc_id, text[, source]) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 7, "x", 3, 0.5, 9, "w") for r in rows], SCHEMA)


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choices("ba ke lo mi nu ra se ti vo za pe du".split(), k=r.randint(1, 4))) for _ in range(n))


def awkward():
    base = prose(1, 300)
    line = "This very common line number {} stands in all the documents of it."
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base.replace("ba", "BA", 3), "b"), (4, None, None), (5, "", "b"), (6, " \t\n", None), (None, base, "a"),
        (7, prose(2, 3), "c"), (8, "x", "c"), (9, "a" * 3000, "a"), (10, prose(3, 40_000), "a"), (11, prose(4, 80) + "\n" + base[100:400] + "\n" + prose(5, 60), "b"),
        *((20 + i, prose(100 + i, 30) + "\n" + line.format(i) + "\n" + prose(200 + i, 30), "d") for i in range(12)),
        (50, "é 你好 ﬁne x . , 12,5 don't\r\nEND\n\n", "é"),
    ]


def repeats(docs, length=50):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda x: x[0]):
        for p in range(len(text) - length + 1):
            first.setdefault(text[p : p + length], i)
    for i, text in docs:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def jaccard_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {}
    for i, s in sets:
        root.setdefault(i, i)
    links = {i: {i} for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i].add(j)
    changed = True
    while changed:
        changed = False
        for i in root:
            low = min(root[j] for j in links[i])
            if low < root[i]:
                root[i], changed = low, True
    return {i: (len(dict(sets)[i]), root[i]) for i in root}
