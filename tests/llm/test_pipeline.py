"""The whole pipeline against plain versions of its stages, on odd rows: nulls, repeats, copies and clashing columns."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import pytest
from tests.llm.cases import documents, frame
from tests.llm.test_language_decontamination import plain_hits, plain_model
from tests.llm.test_mixing_sharding import place
from tests.llm.test_simhash import roots
from tests.llm.test_similarity import alike

from tidemark.llm import decontamination, language_id, mixing


def corpus() -> tuple[list[tuple], list[tuple]]:
    draw = random.Random(11)
    rest = documents(3)[0][2:]
    rows = [r for r in documents(90) if r[0] is not None and r[0] < 95]
    rows += [(300, "zqx wvk jjp qqz xxv kkw", None, *rest[1:]), (None, rows[3][1], *rest), (None, "alphas betaer gammas " + rows[5][1], *rest)]
    long = [r for r in rows if r[1] and 20 < len(r[1].split()) < 100]
    for i, r in enumerate(draw.sample(long, 6)):  # near copies
        words = r[1].split()
        words[0] = "delta"
        rows.append((400 + i, " ".join(words), *r[2:]))
    items = [(i, " ".join(draw.choice(["uno", "dos", "tres", "alpha", "beta", "cuatro"]) + draw.choice(["s", "", "er"]) for _ in range(12))) for i in range(4)]
    for i, r in enumerate(draw.sample(long, 3)):
        rows.append((500 + i, r[1] + " " + items[i][1] + " " + r[1], *r[2:]))
    return rows, items


def plain(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    """(id, text, source, shard, slot) by the definitions of the five stages."""
    taught = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    score = plain_model([(r[1], r[2]) for r in taught])
    said = [score(r[1]) for r in rows]
    rows = [r for r, (lang, p, known) in zip(rows, said) if lang != "und" and p >= language_id.LEAST_SCORE and known >= language_id.LEAST_KNOWN]
    root, groups = roots(list(range(len(rows))), lambda a, b: alike(rows[a][1], rows[b][1])), {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i], []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    dirty = {h[0] for h in plain_hits([(i, r[1]) for i, r in enumerate(rows)], items)}
    rows = [r for i, r in enumerate(rows) if i not in dirty]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, s or ""))
    of = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0)) for s in sources]
    weights = [len(x) ** mixing.ALPHA for x in of]
    period = mixing.period_for([len(x) for x in of], weights, mixing.BLOCK)
    q = mixing.parts(weights, period)
    mix, done, t = [], [0] * len(of), 0
    while any(k * mixing.BLOCK < len(x) for k, x in zip(done, of)):
        ready = [i for i in range(len(of)) if done[i] * period // q[i] <= t]
        i = min(ready, key=lambda i: (-(-(done[i] + 1) * period // q[i]), i))
        mix += [of[i][(done[i] * mixing.BLOCK + k) % len(of[i])] for k in range(mixing.BLOCK)]
        done[i], t = done[i] + 1, t + 1
    where = [place(i, len(mix)) for i in range(len(mix))]
    return [(r[0], r[1], r[3], p % 24, p // 24) for r, p in zip(mix, where)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r[:5], "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot string, id string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(got.columns)
    want = plain(rows, items)
    assert sorted(((r.doc_id, r.text, r.source, r.shard, r.slot) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = {r[0] for r in want}
    assert 300 not in kept and not kept & {400, 401, 402, 403, 404, 405} and not kept & {500, 501, 502} and len(kept) > 50


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, documents(3)).limit(0)
    docs = docs.toDF(*[f"{c}2" if c in ("TEXT", "slot", "id") else c for c in docs.columns])
    if name == "sharding":
        docs = docs.selectExpr("*", "cast(null AS long) AS mix_pos")
    assert stage(spark, docs, str(tmp_path)).count() == 0


def test_decontamination_is_that_of_the_operator():
    rows, items = corpus()
    index = decontamination.Index.build(items)
    assert {i for i, t, *_ in rows if i and i >= 500 and index.hits(t)} == {500, 501, 502}
