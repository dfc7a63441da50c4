"""Plain versions of the operators' results, for small inputs, and rows with odd cases."""

import re
from collections import Counter, defaultdict

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", " \t\n ", "one", "one two", "Ünïcode stays one word", "a" * 5000, "x y " * 400, "x y " * 400, "\x1c\x85 odd spaces", None, None]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, unit string, spans string, print string, fingerprint string"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["z"] * 6) for i, t in pairs], SCHEMA)


def documents(spark, n=80, odd=True):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()]
    if odd:
        rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [rows[3], rows[3], (None, "a null id"), (5, "again id five")]
    return rows


def unite(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def repeated_words(pairs, length):
    docs = [SPLIT.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(pairs, items, length=13):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(fold(t or ""))
        if item is not None and w:
            for i in range(max(1, len(w) - length + 1)):
                windows[tuple(w[i : i + length])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for _, t in pairs:
        w, hit, found = WORD.findall(fold(t or "")), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out
