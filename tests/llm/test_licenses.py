import random
import re

from pyspark.sql import functions as F

from plexgraph.llm import licenses


def brute(rows, templates=licenses.TEMPLATES):
    known = {}
    for name, text in templates.items():
        w = re.findall("[a-z0-9]+", text.lower())
        if len(w) >= 5:
            known[name] = (len(w), {" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    out = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        g = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)]
        for name, (n, kinds) in known.items():
            for s in range(0, len(w), n):
                hit = len(set(g[s : s + licenses.window_words(n) - 4]) & kinds)
                if hit >= 0.8 * len(kinds) - 1e-9 and (-hit, s) < out.get((i, name), (0, 0, 0))[1:] or (i, name) not in out and hit >= 0.8 * len(kinds) - 1e-9:
                    out[i, name] = (len(kinds), -hit, s)
    return sorted((i, name, k, -h, s) for (i, name), (k, h, s) in out.items())


def rows():
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice("stone river light under the license of version".split()) for _ in range(n))
    out = []
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 6):
        w = text.split()
        for _ in range(rng.choice([0, 0, 1, len(w) // 40])):
            w[rng.randrange(len(w))] = "changed"
        out.append((i, fill(rng.randrange(0, 300)) + " " + " ".join(w).upper() + "\n" + fill(rng.randrange(0, 90))))
    return out + [(900, None), (901, ""), (902, "MIT"), (903, fill(4000))]


def test_equals_index_of_all_shingles(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("_band", F.lit("x"))
    got = sorted((r.doc_id, r.license, r.template_shingles, r.matched, r.first_word) for r in licenses.scan(df).collect())
    assert got == brute(data) and len({g[1] for g in got}) == len(licenses.TEMPLATES)


def test_templates_in_several_passes(spark, monkeypatch):
    data = rows()[:40]
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(licenses, "PASS_WORDS", 400)
    assert sorted(map(tuple, licenses.scan(df).select("doc_id", "license", "template_shingles", "matched", "first_word").collect())) == brute(data)


def test_notices_in_awkward_rows(spark):
    """Notices in repeated rows, shared and null ids, a very long text, and beside columns with clashing names."""
    notice, filler = licenses.TEMPLATES["mit"], "stone river light under seven walks " * 12_000
    data = [(1, notice), (1, notice), (2, "x " + notice), (2, "no notice here"), (None, notice), (None, notice), (3, filler + notice + filler), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "n", 1, ["w"]) for r in data], "doc_id long, text string, name string, n int, _words array<string>").repartition(3)
    got = sorted(((r.doc_id or 0), r.license, r.matched == r.template_shingles) for r in licenses.scan(df, {"mit": notice}).collect())
    assert got == [(0, "mit", True), (1, "mit", True), (2, "mit", True), (3, "mit", True)]


def test_awkward_table_and_no_rows(awkward, no_docs, spark):
    assert licenses.scan(awkward).count() == 0 and licenses.scan(no_docs).count() == 0
    repeated = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license) for r in licenses.scan(repeated).collect()) == [(0, "mit-line"), (1, "mit-line")]


def test_every_match_holds_a_needle():
    """No choice of shingles that is enough for a match avoids all needles: those without one are too few."""
    words = {name: re.findall("[a-z0-9]+", text.lower()) for name, text in licenses.TEMPLATES.items()}
    for share in (0.5, 0.8, 1.0):
        found = set(licenses.needles(words, share))
        for w in words.values():
            kinds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            assert sum(not found & set(g) for g in kinds) < share * len(kinds) - 1e-9


def test_bands_miss_seldom():
    for n, kinds in ((5, 1), (7, 3), (60, 56), (300, 250)):
        hit = -(-8 * kinds // 10)
        alike = hit / (licenses.window_words(n) - 4 + kinds - hit)
        assert (1 - alike) ** licenses.bands_needed(n, kinds) <= 1e-6


def test_plan_is_native(no_docs):
    plan = licenses.scan(no_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_templates_of_few_words(spark):
    rng = random.Random(4)
    templates = {"rights": "All rights reserved.", "one": "Copyleft", "two": "No warranty", "four": "May not be sold", "empty": "©", "mit-line": licenses.TEMPLATES["mit-line"]}
    kinds = "all rights reserved no warranty copyleft may not be sold unreserved hall \U0001f642 é".split()
    data = [(i, "".join(rng.choice(kinds) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    data += [(900, None), (901, ""), (902, "ALL -- RIGHTS\nRESERVED"), (903, "x All rights reserved. Released under the MIT License."), (904, "\U0001f642 é " * 9 + "a all rights reserved"), (905, "hall rights reserved, all rights reserved1"), (906, "they may, not be SOLD may not be sold")]
    want = []
    for i, t in data:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for name, text in templates.items():
            q = re.findall("[a-z0-9]+", text.lower())
            n = len(q)
            starts = [s for s in range(0, len(w), n or 1) if any(w[p : p + n] == q for p in range(s, s + licenses.window_words(n) - n + 1))] if n else []
            want += [(i, name, 1, 1, starts[0])] if starts else []
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.license, r.template_shingles, r.matched, r.first_word) for r in licenses.scan(df, templates).collect())
    assert got == sorted(want) and {g[1] for g in got} == set(templates) - {"empty"}
    shared = spark.createDataFrame([(None, "x y z x y z x y all rights reserved"), (None, "All rights reserved."), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(shared, licenses.SHORT_TEMPLATES).collect()] == [(None, "all-rights-reserved", 1, 1, 0)]


def test_bands_follow_the_share_asked_for(no_docs, monkeypatch):
    real, asked = licenses.bands_needed, []
    monkeypatch.setattr(licenses, "bands_needed", lambda n, kinds, *share: asked.append(share) or real(n, kinds, *share))
    licenses.scan(no_docs, contained=0.5)
    assert set(asked) == {(0.5,)}
