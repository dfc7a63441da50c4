import difflib
import random
import time

from msgspark.llm import licenses as L

from .brute import documents, frame


def brute(text, template, least):
    """Best coverage of a template in a text, by trying all windows with difflib."""
    words, want = [w.lower() for w in L.WORD.findall(text or "")], [w.lower() for w in L.WORD.findall(template)]
    best = 0
    for i in range(len(words)):
        blocks = difflib.SequenceMatcher(None, want, words[i : i + len(want) + 2], autojunk=False).get_matching_blocks()
        best = max(best, sum(b.size for b in blocks) / len(want))
    return best >= least


def test_against_brute_force(spark):
    rows = documents(spark, 100)
    apache, mit = L.TEMPLATES["apache-2.0-notice"].split(), L.TEMPLATES["mit"].split()
    rows += [(50_000, "x " * 30 + " ".join(apache)), (50_001, " ".join(mit[:20] + ["new", "words"] + mit[21:50] + mit[53:])), (50_002, " ".join(mit[:30])), (50_003, L.TEMPLATES["mit-short"].upper() + "! twice: " + L.TEMPLATES["mit-short"]), (50_004, "Licensed under CC BY-NC 4.0, " * 3)]
    got = L.scan_licenses(frame(spark, rows)).collect()
    texts = dict(rows)
    found = {(r.doc_id, r.template) for r in got}
    short = {n: t for n, t in L.TEMPLATES.items() if len(t.split()) < 14}
    want = {(i, n) for i, t in rows for n, x in short.items() if (t and ("icens" in t or "LICENS" in t)) and brute(t, x, 0.8)}
    assert {x for x in found if x[1] in short} == want
    assert {(50_000, "apache-2.0-notice"), (50_001, "mit"), (50_003, "mit-short")} <= found and (50_002, "mit") not in found
    assert sum(r.doc_id == 50_003 for r in got) == 2 and sum(r.doc_id == 50_004 and r.template == "cc-by-nc-short" for r in got) == 3
    whole = next(r for r in got if (r.doc_id, r.template) == (50_000, "apache-2.0-notice"))
    assert whole.coverage == 1.0 and texts[50_000][whole.start : whole.end] == " ".join(apache)[: whole.end - whole.start]


def plain_align(template, words, shift, band):
    """One cell at a time: the specification of align."""
    m, width, low = len(template), 2 * band + 1, (-(10**9), 0)
    row = [((0, 0), -1, -1)] * width
    for i in range(m):
        new = []
        for k in range(width):
            j = i + shift + k - band
            valid = 0 <= j < len(words)
            options = []
            if valid:
                (s, n), f, e = row[k]
                same = words[j] == template[i]
                options.append(((s + 2, n + 1), j if f < 0 else f, j) if same else ((s - 1, n), f, e))
            if k + 1 < width:
                (s, n), f, e = row[k + 1]
                options.append(((s - 1, n), f, e))
            if valid and k:
                (s, n), f, e = new[k - 1]
                options.append(((s - 1, n), f, e))
            new.append(max(options, key=lambda x: x[0]) if options else (low, -1, -1))
        row = new
    best = max(sorted(range(width), key=lambda k: (abs(k - band), k)), key=lambda k: row[k][0])
    (_, n), f, e = row[best]
    return (n, f, e + 1) if n else (0, 0, 0)


def plain_scan(text, templates, least):
    """Every diagonal on which a winnowed fingerprint stands, aligned by plain_align."""
    (index,) = L.build_indexes(templates)
    places = [x.span() for x in L.WORD.finditer(text)]
    words = [text[s:e].lower() for s, e in places]
    out = []
    for t, name in enumerate(index.names):
        want = L.WORD.findall(templates[name].lower())
        k = min(L.GRAM, len(want))
        keys = {int(p) for row in index.posting[k].T.tolist() if row[1] == t for p in [row[2]]}
        shifts = {a - p for p in keys for a in range(len(words) - k + 1) if words[a : a + k] == want[p : p + k]}
        found = {plain_align(want, words, s, 2 + len(want) // 8) for s in shifts}
        taken = []
        for n, f, e in sorted(found, key=lambda x: (-x[0], x[1], -x[2])):
            if n and n / len(want) >= least and all(e <= a or f >= b for a, b in taken):
                taken.append((f, e))
                out.append((name, n / len(want), n, places[f][0], places[e - 1][1]))
    return sorted(out, key=lambda x: (x[3], x[0]))


def test_coverage_and_spans_against_plain_alignment():
    rnd = random.Random(4)
    templates = {f"t{i}": " ".join(rnd.choice("abcdefgh") for _ in range(n)) for i, n in enumerate((1, 2, 3, 5, 9, 14, 20, 40))}
    texts = []
    for _ in range(120):
        words = [rnd.choice("abcdefghxyz") for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            copy = rnd.choice(list(templates.values())).split()
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.randint(0, 2)] = [rnd.choice("abcxyz") for _ in range(rnd.randint(0, 2))]
            at = rnd.randint(0, len(words))
            words[at:at] = copy
        texts.append("".join(w + rnd.choice([" ", ", ", " é "]) for w in words))
    (index,) = L.build_indexes(templates)
    for least in (0.5, 0.8):
        got = L.scan_texts([None, "", *texts], index, least)
        assert got[:2] == [[], []] and got[2:] == [plain_scan(t, templates, least) for t in texts]
    assert sum(map(len, got)) > 200


def test_repetitive_and_very_long_texts():
    (index,) = L.build_indexes(L.TEMPLATES)
    mit = L.TEMPLATES["mit"]
    texts = ["software without restriction " * 6000, "word " * 500_000 + mit + " word" * 500_000, (L.TEMPLATES["mit-short"] + ". ") * 3000]
    a, b, c = L.scan_texts(texts, index, 0.8)
    assert a == [] and [(x[0], x[1], texts[1][x[3] : x[4]]) for x in b] == [("mit", 1.0, mit.rstrip("."))]
    assert [x[0] for x in c] == ["mit-short"] * 3000


def test_many_templates_make_more_indexes(spark, monkeypatch):
    docs = documents(spark, 100)
    want = sorted(map(tuple, L.scan_licenses(frame(spark, docs)).collect()), key=str)
    monkeypatch.setattr(L, "INDEX_WORDS", 30)
    assert len(L.build_indexes(L.TEMPLATES)) > 5
    assert sorted(map(tuple, L.scan_licenses(frame(spark, docs)).collect()), key=str) == want


def test_own_templates_and_empty(spark):
    docs = frame(spark, [(1, "Alpha beta"), (2, None), (3, "")])
    assert [(r.doc_id, r.template) for r in L.scan_licenses(docs, {"t": "alpha Beta", "none": "", "gone": None}).collect()] == [(1, "t")]
    assert L.scan_licenses(docs, {}).collect() == [] and L.scan_licenses(docs.where("false")).collect() == []


def test_many_alike_templates():
    """Each of 400 variants of a notice by itself, and all at once in a fraction of a second."""
    rnd, mit = random.Random(6), L.TEMPLATES["mit"].split()
    variants = {}
    for i in range(400):
        words = list(mit)
        for _ in range(3):
            at = rnd.randrange(len(words))
            words[at : at + 1] = [rnd.choice(mit)] * rnd.randint(0, 2)
        variants[f"v{i}"] = " ".join(words)
    text = "before it " + " ".join(mit) + " after it"
    (index,) = L.build_indexes(variants)
    took = []
    for _ in range(3):
        began = time.perf_counter()
        (found,) = L.scan_texts([text], index, 0.8)
        took.append(time.perf_counter() - began)
    assert {x[0] for x in found} == set(variants) and min(took) < 1.0
    print(f"{min(took):.2f} s for 400 alike templates")
    for name in list(variants)[:40]:
        (own,) = L.build_indexes({name: variants[name]})
        assert L.scan_texts([text], own, 0.8)[0] == [x for x in found if x[0] == name]


def test_whole_licence_texts(spark):
    every = L.all_templates()
    assert len(every) == len(L.TEMPLATES) + 14
    gpl, bsd = every["gpl-2.0-full"], every["bsd-ucb-full"]
    changed = bsd.replace("HOLDERS", "OWNERS").replace("1.", "a)")
    docs = frame(spark, [(1, "x " * 50 + gpl + " y" * 50), (2, changed), (3, gpl[: len(gpl) // 2]), (4, "words of no licence " * 500)])
    found = {(r.doc_id, r.template): r for r in L.scan_licenses(docs).collect()}
    assert found[1, "gpl-2.0-full"].coverage == 1.0 and found[2, "bsd-ucb-full"].coverage > 0.9
    assert not [k for k in found if k[1].endswith("-full") and k not in ((1, "gpl-2.0-full"), (2, "bsd-ucb-full"))]
    assert not [k for k in found if k[0] == 4]
