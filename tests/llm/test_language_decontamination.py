from __future__ import annotations

import math
import random
import unicodedata
import zlib
from collections import Counter

import pytest
from tests.llm.cases import documents, frame

from tidemark.llm import decontamination as d
from tidemark.llm import language_id as m


def plain_model(rows: list[tuple]):
    """A scorer by the definition, in plain Python: rows are (text, lang) of the training rows."""
    langs = sorted({lang for text, lang in rows if text is not None and lang is not None})
    counts = [Counter() for _ in range(6)]
    letter = lambda c: unicodedata.category(c)[0] == "L"
    mark = lambda c: unicodedata.category(c)[0] == "M"

    def words(text: str) -> list[str]:
        out, run = [], ""
        for c in text.lower() + " ":
            if letter(c) or (run and mark(c)):
                run += c
            elif run:
                out, run = [*out, run], ""
        return out

    def grams(word: str, size: int) -> list[str]:
        shown = f" {word} " if size > 1 else word
        return [shown[i : i + size] for i in range(len(shown) - size + 1)]

    for text, lang in rows:
        for w in words(text) if text is not None and lang is not None else ():
            counts[0][lang, w] += 1
            for size in range(1, 6):
                for g in grams(w, size):
                    counts[size][lang, g] += 1
    known = [{k for _, k in c} for c in counts]
    totals = [{lang: sum(n for (x, _), n in c.items() if x == lang) for lang in langs} for c in counts]

    def log_frequency(size: int, key: str) -> list[float]:
        return [math.log((counts[size][lang, key] + 0.5) / (totals[size][lang] + 0.5 * len(known[size]))) for lang in langs]

    def score(text: str | None) -> tuple[str, float, float]:
        every = words(text or "")
        if not every or not langs:
            return "und", 0.0, 0.0
        total, told = [0.0] * len(langs), 0
        for w in every:
            told += w in known[0] or any(g in known[size] for size in (4, 5) for g in grams(w, size))
            of = [log_frequency(0, w)] if w in known[0] else []
            for size in range(5, 0, -1):
                of = of or [log_frequency(size, g) for g in grams(w, size) if g in known[size]]
            total = [t + (sum(x[i] for x in of) / len(of) if of else 0) for i, t in enumerate(total)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        return langs[best], 1 / sum(math.exp(x - total[best]) for x in total), told / len(every)

    return score


def test_language_equals_plain_scorer(spark):
    rows = documents(150)
    rows += [(900, "\u00b2\u00bd \u2460 12", None, "a", 1, *"ccc"), (901, "\u0939\u093f\u0928\u094d\u0926\u0940 alphas", "zz", "a", 1, *"ccc"), (902, "alphagammabetadelta" * 9, "xx", "a", 1, *"ccc"), (903, "unoz detl \u0939\u093f", None, "a", 1, *"ccc")]
    docs = frame(spark, rows)
    model = m.fit(m.training_rows(docs))
    taught = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    score = plain_model([(r[1], r[2]) for r in taught])
    got = sorted(((r.id, r.lang_pred, round(r.score, 5), round(r.known, 9)) for r in m.predict(docs, model).collect()), key=str)
    assert got == sorted(((r[0], score(r[1])[0], round(score(r[1])[1], 5), round(score(r[1])[2], 9)) for r in rows), key=str)
    assert {r[0] for r in got if r[1] == "und"} == {150, 151, 152, 153, 900}


def test_language(spark):
    docs = frame(spark, documents(400))
    model = m.fit(m.training_rows(docs))
    assert model.langs == ["xx", "yy"]
    got = m.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    want = {r[0]: r[2] for r in documents(400)[:400]}
    apart = [r for r in got if r.id in want and zlib.crc32(str(r.id).encode()) % 4 == 2]
    assert len(apart) > 50 and sum(r.lang_pred == want[r.id] for r in apart) > 0.97 * len(apart)  # held-out rows alone
    kept = m.accepted(docs, model)
    assert kept.columns == docs.columns
    gone = {r.id for r in got} - {r.doc_id for r in kept.select(kept.columns[0]).collect()}
    assert {400, 401, 402, 403} <= gone <= {400, 401, 402, 403, 404, 405, None}  # 404 and 405 have no word of the languages
    nothing = m.fit(docs.limit(0))
    assert {r.lang_pred for r in m.predict(docs, nothing).collect()} == {"und"}
    assert m.predict(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="labels"):
        m.fit(spark.range(m.MOST_LANGS + 1).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang"))


def test_backoff_goes_from_words_to_shorter_grams(spark):
    rows = [(i, "alphabet alphabet", "xx") for i in range(8)] + [(i, "beteigeuze beteigeuze", "yy") for i in range(8, 16)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.hashes(["alphabet"])[0] in model.keys[0]
    assert [x[0] for x in model.predict(["alphabets", "geuze", "zq", None, "alphabet" * 20_000])] == ["xx", "yy", "yy", "und", "xx"]
    assert model.scored(["\u0436"])[0].tolist() == [[0.0, 0.0]]
    assert [x[2] for x in model.predict(["xqz wkv jjq", "alphabet xqz"])] == [0, 0.5]


def corpus(seed: int = 5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.choice([1, 2, 2, 3])))
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 50)))) for i in range(70)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(draw.randrange(0, 400))]
        for _, t in draw.sample(items, draw.choice([0, 0, 1, 2])):
            words[draw.randrange(len(words) + 1) : 0] = t.upper().replace(" ", ", ").split()
        docs.append((i, " ".join(words)))
    return docs, items


def test_wand_finds_all_above_the_bound():
    docs, items = corpus()
    index = d.Index.build(items)
    for _, text in docs[:80]:
        terms = sorted({index.terms[w] for w in d.words_of(text)[:118] if w in index.terms})
        scores = {}
        for t in terms:
            for at, x in zip(*index.postings[t]):
                scores[at] = scores.get(at, 0) + x
        for least in (0.3, 0.5, 0.9):
            assert [i for i, _ in index.search(terms, least)] == sorted(i for i, s in scores.items() if s >= least - 1e-9)


def test_contaminations_match_brute_force(spark):
    docs, items = corpus()
    docs += [(None, items[3][1]), (900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (903, "x " * 60_000 + items[5][1])]
    items += [(None, "some words"), (500, None), (501, "!!")]
    got = d.contaminations(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, text in docs:
        held = d.words_of(text)
        for j, item in items:
            w = d.words_of(item)
            if j is not None and w and any(held[k : k + len(w)] == w for k in range(len(held) - len(w) + 1)):
                want.append((i, j))
    found = [(r.id, r.item_id) for r in got]
    key = lambda x: (x[0] is None, x)
    assert [x for x in sorted(set(want), key=key) if x not in found] == []
    assert found.count((902, items[3][0])) == 2
    assert all(r.overlap >= 0.8 and 0.5 <= r.score <= 1 for r in got)


def test_clean_and_empty(spark):
    docs, items = corpus()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    dirty = {r.id for r in d.contaminations(a, b).collect()}
    assert {r.doc_id for r in d.clean(a, b).collect()} == {i for i, _ in docs} - dirty
    assert d.contaminations(a, b.limit(0)).count() == 0 and d.contaminations(a.limit(0), b).count() == 0


def plain_hits(docs, items):
    """(document, item, score, overlap) by the definition alone: each passage against each item."""
    items = [(i, d.words_of(t)) for i, t in items if i is not None and d.words_of(t)]
    mean = sum(len(w) for _, w in items) / len(items)
    held_by = Counter(t for _, w in items for t in set(w))
    weight = {}
    for i, w in items:
        for t, n in Counter(w).items():
            idf = math.log(1 + (len(items) - held_by[t] + 0.5) / (held_by[t] + 0.5))
            weight[i, t] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
    window = max(5, *(len(w) for _, w in items))

    def share(part, passage):
        size = min(5, len(part))
        runs = lambda x: {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}
        return len(runs(part) & runs(passage)) / len(runs(part))

    best: dict = {}
    for i, text in docs:
        words = d.words_of(text)
        for at in range(0, len(words), window):
            passage = words[at : at + 2 * window]
            for j, w in items:
                score = sum(weight[j, t] for t in set(passage) & set(w)) / sum(weight[j, t] for t in set(w))
                half = (len(w) + 1) // 2
                parts = [share(x, passage) for x in (w, w[:half], w[half:] or w)]
                if score >= 0.5 - 1e-9 and parts[0] >= 0.8 - 1e-9 and min(parts[1:]) >= 0.5:
                    best[i, j] = max(best.get((i, j), (0, 0)), (round(min(score, 1.0), 6), round(parts[0], 6)))
    return {(i, j, *x) for (i, j), x in best.items()}


def test_whole_definition_by_brute_force(spark):
    draw = random.Random(12)
    docs, items = corpus(7)
    docs, items = docs[:60], items[:40]
    for n in range(60):  # items with words changed, halves alone, and words out of order
        words = d.words_of(draw.choice(items)[1])
        for _ in range(draw.choice([1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(["zz", "yy", words[0]])
        kind = n % 4
        words = words[: len(words) // 2] if kind == 1 else draw.sample(words, len(words)) if kind == 2 else words
        docs.append((1000 + n, " ".join(d.words_of(docs[n][1])[:40] + words)))
    a, b = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, score string").repartition(3), spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, id string")
    got = [(r.id, r.item_id, round(r.score, 6), round(r.overlap, 6)) for r in d.contaminations(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_hits(docs, items)


def test_bound_on_items(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_WORDS", 50)
    docs, items = corpus()
    with pytest.raises(ValueError, match="words"):
        d.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
