import math
import unicodedata
import zlib

import numpy as np
from quadrat.llm import langid


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, source string, score double")


def test_edges(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 _ !", "de"), (1003, "der der der und", None), (None, "the mat", "en"), (1004, "katzen hunde", "xx"), (1005, "the " * 50_000, None), (5, "the cat", "en"), (1006, "Ψ", None)]
    got = {(r.id, r.lang_pred): r for r in langid.language(docs(spark, rows)).collect()}
    pred = {k[0]: k[1] for k in got}
    assert pred[1000] == pred[1001] == pred[1002] == "und"
    assert pred[1003] == pred[1004] == "de" and pred[1005] == pred[None] == "en"
    assert all(0 <= r.score <= 1 and r.held_out == held(r.id) for r in got.values())
    assert got[(1000, "und")].score == 0


def test_nothing_to_learn(spark):
    rows = [(1, "a b", None), (2, "c", None)]
    assert {r.lang_pred for r in langid.language(docs(spark, rows)).collect()} == {"und"}
    assert langid.language(docs(spark, [])).collect() == []


def plain_counts(rows):
    """rows: (lang, text) -> for words and each n-gram length: {key: {lang: n}}, counted by plain loops."""
    tables = [{} for _ in range(langid.LONGEST + 1)]
    for lang, text in rows:
        word = ""
        for c in (text or "").lower() + " ":
            letter = unicodedata.category(c)[0] == "L"
            if letter or word and unicodedata.category(c)[0] == "M":
                word += c
                continue
            if word:
                for k in range(langid.LONGEST + 1):
                    marked = f" {word} "
                    for g in [word] if k == 0 else [marked[i : i + k] for i in range(len(marked) - k + 1)]:
                        tables[k].setdefault(g, {}).setdefault(lang, 0)
                        tables[k][g][lang] += 1
            word = ""
    return tables


def plain_scores(rows, text):
    """The share of each language for a text, straight from the counts of the rows learned from."""
    tables, langs = plain_counts(rows), sorted({x for x, t in rows if any(unicodedata.category(c)[0] == "L" for c in t or "")})
    own = plain_counts([("?", text)])[0]
    if not own or not langs:
        return langid.UNKNOWN, 0.0

    def log(k, g, lang):
        total = sum(c.get(lang, 0) for c in tables[k].values())
        return math.log(tables[k][g].get(lang, 0) + langid.SMOOTH) - math.log(total + langid.SMOOTH * (len(tables[k]) + 1))

    total = dict.fromkeys(langs, 0.0)
    for word, counted in own.items():
        if word in tables[0]:
            used = [(0, word)]
        else:
            marked, used = f" {word} ", []
            left = [True] * len(marked)
            for k in range(langid.LONGEST, 0, -1):
                hits = [i for i in range(len(marked) - k + 1) if any(left[i : i + k]) and marked[i : i + k] in tables[k]]
                used += [(k, marked[i : i + k]) for i in hits]
                for i in hits:
                    left[i : i + k] = [False] * k
        for lang in langs:
            total[lang] += counted["?"] * sum(log(k, g, lang) for k, g in used) / max(1, len(used))
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(max(-700, v - total[best])) for v in total.values())


TEXTS = [("en", "the nation of the station"), ("en", "A cat's relation, the 12 cats"), ("de", "die Zeitung der Leitung"), ("de", "Straße und Bäume ½"), ("hi", "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e"), ("xx", "Cafe\u0301 the"), ("nl", "")]


def test_whole_texts_equal_plain_counting(spark):
    rows = [(i, TEXTS[i % len(TEXTS)][1], TEXTS[i % len(TEXTS)][0]) for i in range(40)]
    asked = ["relation heizung the the qqq", "unbekannt zzz", "Straßenbahn cafe\u0301", "\u0939\u093f\u0928\u094d\u0926", "½ ²", "①", "Ⅷ", "12 \u0301", "the die", "Ψ the " * 30]
    rows += [(1000 + i, t, None) for i, t in enumerate(asked)]
    learned = [(x, t) for i, t, x in rows if x and not held(i)]
    for r in langid.language(docs(spark, rows)).collect():
        want, score = plain_scores(learned, dict((i, t) for i, t, _ in rows)[r.id])
        assert r.lang_pred == want and abs(r.score - score) < 1e-9, (r, want, score)


def test_every_language_is_learned(spark):
    """More languages than any bound of a table: each has a word of its own and is predicted by it."""
    names = [f"l{i:03d}" for i in range(400)]
    name = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    rows = [(10 * i + k, f"{name(i)} {name(i)} {name(i)}", x) for i, x in enumerate(names) for k in range(5)]
    got = {r.id: r for r in langid.language(docs(spark, rows)).collect()}
    assert all(got[10 * i + k].lang_pred == x for i, x in enumerate(names) for k in range(5))


def test_kept_words_do_not_change_scores(monkeypatch):
    seen = [(0, "the", 0, 3), (0, "der", 1, 3), (0, "cat", 0, 1), (1, "t", 0, 2), (1, "d", 1, 2), (2, "he", 0, 2)]
    arrays = [np.array(c) for c in zip(*((k, langid.key(g), x, n) for k, g, x, n in seen))]
    model = langid.build(["de", "en"], *arrays)
    texts = [f"w{'abc'[i % 3]}{'xyz'[i // 3 % 3]}q the" for i in range(9)]
    want = langid.Scorer(model)(texts)
    monkeypatch.setattr(langid, "CACHE", 4)
    monkeypatch.setattr(langid, "TEXTS", 2)
    assert langid.Scorer(model)(texts) == want


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = [r for r in langid.language(table).collect() if r.held_out]
    assert sum(r.lang_pred == want[r.id] for r in got) / len(got) > 0.97
