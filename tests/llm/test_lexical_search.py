from __future__ import annotations

import math
import re
from collections import Counter

from tests.llm.cases import documents, frame

from tidemark.llm import lexical_search as m

FOLD = str.maketrans(m.UPPER, m.LOWER)
ITEMS = [(1, "alpha betas THE la"), (2, "unos dos dos É"), (3, None), (4, "... !"), (5, "nowhere"), (None, "alpha gammas"), (1, "cuatro"), (6, "word word more 1234"), (7, "the the the")]


def words(text: str | None) -> list[str]:
    return re.findall(m.TERM, (text or "").translate(FOLD))


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(r[0], Counter(words(r[1]))) for r in docs if words(r[1])]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, times in asked.items():
        scores = []
        for doc, tf in held:
            own = 25 + 75 * sum(tf.values()) * n_docs // length
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * own)) for t, n in times.items() if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("item", "rank", "id", "score").collect()), key=str)


def test_matches_plain_version_in_any_number_of_parts(spark, monkeypatch):
    docs = documents()
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, Text string, item string")
    index = m.postings(frame(spark, docs))
    for k, entries in ((10, m.ENTRIES), (3, 4), (200, 2)):
        monkeypatch.setattr(m, "ENTRIES", entries)
        assert rows(m.search(index, items, k)) == plain(docs, ITEMS, k)


def test_index_counts_every_term(spark):
    docs = documents()
    got = Counter()
    for r in m.postings(frame(spark, docs)).collect():
        got[(r["id"], r["n"], r["term"], r["tf"])] += 1
    assert got == Counter((r[0], len(words(r[1])), t, n) for r in docs for t, n in Counter(words(r[1])).items())


def test_empty_tables(spark):
    docs, items = frame(spark, documents(5)), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert m.search(m.postings(docs.limit(0)), items).count() == 0
    assert m.search(m.postings(docs), items.where("item_id = 4")).count() == 0
    assert m.search(m.postings(docs), items.limit(0)).columns == ["item", "rank", "id", "score"]


def test_sums_need_no_exchange(spark):
    found = m.search(m.postings(frame(spark, documents())), spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(item" in plan
