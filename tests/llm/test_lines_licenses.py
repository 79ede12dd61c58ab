from __future__ import annotations

import re

from tests.llm.cases import documents, frame

from tidemark.llm import license_scan, line_dedup


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nshared by all \n\n  \tshared by all\nhalf {i % 2}\nsite line", None, f"s{i % 7}", 0, "", "", "") for i in range(40)]
    rows += [(50, None, None, "s1", 0, "", "", ""), (51, "", None, None, 0, "", "", ""), (None, "shared by all\nx", None, None, 0, "", "", ""), rows[0], (60, "many sites\n", None, "s0", 0, "", "", "")]
    got = {}
    for r in line_dedup.remove_boilerplate(frame(spark, rows), min_sites=5).collect():
        got.setdefault(r.id, []).append(r)
    sites: dict = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            sites.setdefault(x.strip(" \t"), set()).add(r[3])
    for r in rows:
        parts = (r[1] or "").split("\n")
        gone = [i for i, x in enumerate(parts) if x.strip(" \t") and len(sites[x.strip(" \t")]) >= 5]
        out = got[r[0]][0]
        assert out.removed == gone and out.n_lines == (0 if r[1] is None else len(parts))
        assert out.text == (None if r[1] is None else "\n".join(x for i, x in enumerate(parts) if i not in gone))
    assert len(got[0]) == 2
    assert line_dedup.remove_boilerplate(frame(spark, rows).limit(0)).count() == 0


def test_line_on_all_rows_of_few_sites(spark):
    rows = [(i, f"menu\nown {i}\nfoot {i % 3}", None, f"s{i % 12}", 0, "", "", "") for i in range(900)]
    got = line_dedup.remove_boilerplate(frame(spark, rows), min_sites=10).collect()
    assert len(got) == 900 and all(r.removed == [0] and r.text == f"own {r.id}\nfoot {r.id % 3}" for r in got)


def test_spread_counts_near_lines_exactly(spark):
    lines = [(s, f"l{n}", n) for n in (5, 9, 10, 11, 300) for s in range(n)]
    df = spark.createDataFrame([(f"s{s}", n, n) for s, _, n in lines], "site string, h1 long, h2 long")
    got = {r.h1: (r.sites, r.exact) for r in line_dedup.spread(df, 10).collect()}
    assert set(got) == {10, 11, 300}
    assert got[10] == (10, True) and got[11] == (11, True) and not got[300][1] and abs(got[300][0] - 300) < 40


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(at)


def test_base_places(spark):
    rows = documents()
    texts = ["Under the MIT License, under the mit-license! cc BY-nc cc by nc cc_by_nc", "cc by nc cc by nc", "apache license, version 2.0 apache license version 2", "munder the mit license", "é under the mit license"]
    rows += [(500 + i, t, *rows[0][2:]) for i, t in enumerate([*texts, "x " * 30_000 + "under the mit license " * 500])]
    got = {r.id: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    for r in rows:
        n, at = plain_base(r[1])
        out = got[r[0]]
        assert (out.n_words, out.n_base) == (n, len(at))
        assert (out.first_word, out.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert out.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, out.base_labels.split(","))) <= set(out.labels.split(","))
        assert 0 <= out.score <= 1
    assert license_scan.license_scan(frame(spark, rows).limit(0)).count() == 0


def labels(text):
    return sorted({d[2] for d in license_scan.scan(text).detections})


def test_rules_and_suppression():
    assert len(license_scan.RULES) > 200
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3-or-later"] and labels("SPDX-License-Identifier: GPL-3.0") == ["gpl-3"]
    assert labels("Licensed under the GNU General Public License, version 3") == ["gpl-3"]
    assert labels("licensed under the Creative Commons Attribution-NonCommercial 4.0") == ["cc-by-nc"]
    assert labels("https://www.apache.org/licenses/LICENSE-2.0") == ["apache-2"]
    assert labels("Das ist mit uns, the free software of the city") == []
    assert labels("mit license and bsd-3-clause license") == ["bsd-3-clause", "mit"]


def test_suppression_matches_brute_force():
    import random

    draw = random.Random(8)
    for _ in range(200):
        found = [(draw.randrange(3), a := draw.randrange(30), a + draw.randrange(1, 8), "x", 1.0) for _ in range(draw.randrange(25))]
        kept: list = []
        for f in sorted(found, key=lambda f: (f[0], f[1], -f[2])):
            if not any(a <= f[1] and f[2] <= b for a, b in kept):
                kept.append((f[1], f[2]))
        assert sorted(kept) == sorted(k[:2] for k in license_scan.suppressed(found))
