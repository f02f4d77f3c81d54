import math
import re
from collections import Counter, defaultdict

import pytest

from compare import same, tables
from lodestar.llm import license_scan as L
from lodestar.llm.queries import op12_license_scan, oracle_sql

FOLD = str.maketrans(L.UPPER, L.LOWER_)


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def starts(w, phrase):
    return [i for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == phrase]


def scanned(rows, templates):
    """The method over plain lists: (doc_id, n_words, n_base, first, last, base labels, labels, score)."""
    index = L.Index(templates)
    texts = [words(r["text"]) for r in rows]
    df = Counter(w for t in texts for w in set(t))
    postings = defaultdict(list)
    for t, w, i in index.postings():
        postings[t].append((w, i))
    order = {t: sorted({w for w, _ in p}, key=lambda w: (df[w], w)) for t, p in postings.items()}
    idf = lambda w: math.log(1 + len(rows) / max(df[w], 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        base = [(p, label) for phrase, label in L.BASE.items() for p in starts(w, phrase.split())]
        own, more, best = {label for _, label in base}, set(), 0.0
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for t, template in enumerate(templates):
            picked = [x for x in order[t] if x in at][: L.RARE]
            windows = defaultdict(set)
            for x, i in postings[t]:
                if x in picked:
                    for p in at[x]:
                        for g in ((p - i) // L.SLACK, (p - i) // L.SLACK + 1):
                            windows[g].add(x)
            keys = defaultdict(set)
            for k, (phrase, number, place) in enumerate(index.phrases):
                if number == t:
                    for p in starts(w, phrase):
                        for g in ((p - place) // L.SLACK, (p - place) // L.SLACK + 1):
                            keys[g].add(k)
            total = sum(map(idf, order[t][: L.RARE]))
            for g, found in windows.items():
                coverage = min(round(sum(map(idf, found)) / total, L.DIGITS), 1.0)
                if len(keys[g]) == len(template.keys) and coverage >= L.LEAST:
                    more.add(template.label)
                    best = max(best, coverage)
        places = [p for p, _ in base]
        out.append((r["doc_id"], len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), best))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def close(got, want):
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all(abs(a[-1] - b[-1]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_query_equals_sql(spark, sf):
    same(op12_license_scan(spark, sf), tables(sf), oracle_sql()["op12_license_scan"])


def test_larger_table_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = scanned([r.asDict() for r in df.collect()], L.TEMPLATES)
    close(rows(op12_license_scan(spark, sf)), want)
    assert {"mit", "apache", "gpl", "cc-by-nc"} <= {label for r in want for label in r[6].split(",")}
    same(op12_license_scan(spark, sf), tables(sf), oracle_sql()["op12_license_scan"])


@pytest.fixture(scope="module")
def notices(spark):
    """Every template whole, edited, broken up and without its key phrases, among other words."""
    out = []
    for n, t in enumerate(L.TEMPLATES):
        w = t.text.split()
        half = len(w) // 2
        edited = [*w[:half], "Example", "Corp", *w[half:]]
        out += [
            (10 * n, f"intro words before {t.text} and after"), (10 * n + 1, " ".join(edited)), (10 * n + 2, " lorem ".join(w)), (10 * n + 3, " ".join(reversed(w))),
            (10 * n + 4, f"{t.text}\n{t.text.upper()}"), (10 * n + 5, re.sub("(?i)license|permission|free|software|public", "thing", t.text)),
        ]
    out += [(900, "software license " * 3000), (901, "the mit license, an Apache License and the General Public License; mit license"), (902, "mit-license MIT.LICENSE mitlicense"), (903, None), (904, ""), (None, "MIT License"), (905, "KMIT License Ü"), (906, "cc xx nc 4 0 licensed under cc by"), (906, "cc xx nc 4 0 licensed under cc by")]
    return spark.createDataFrame(out, "doc_id long, text string")


def test_notices_equal_plain_python(notices):
    close(rows(L.license_scan(notices)), scanned([r.asDict() for r in notices.collect()], L.TEMPLATES))


def test_whole_notices_are_found_and_others_are_not(notices):
    got = {r["doc_id"]: r for r in L.license_scan(notices).collect()}
    for n, t in enumerate(L.TEMPLATES):
        assert t.label in got[10 * n]["labels"].split(",") and got[10 * n]["score"] == 1.0
        assert t.label in got[10 * n + 4]["labels"].split(",")
        assert got[10 * n + 3]["labels"] == got[10 * n + 3]["base_labels"]
    assert got[901]["base_labels"] == "apache,gpl,mit" and got[901]["n_base"] == 4 and (got[901]["first_word"], got[901]["last_word"]) == (1, 11)
    assert got[900]["n_base"] == 0 and got[906]["labels"] == "" and got[905]["n_base"] == 0
    assert (got[902]["n_base"], got[903]["n_words"], got[904]["n_words"], got[None]["base_labels"]) == (2, 0, 0, "mit")


def test_odd_rows_and_empty_table(odd, empty):
    close(rows(L.license_scan(odd)), scanned([r.asDict() for r in odd.collect()], L.TEMPLATES))
    assert L.license_scan(empty).count() == 0


def test_templates_of_ones_own(spark):
    df = spark.createDataFrame([(1, "granted by House Rules alone; copies welcome"), (2, "house of rules")], "doc_id long, text string")
    mine = [L.Template("house", "granted by house rules alone", ("house rules",))]
    assert [(r["doc_id"], r["labels"], r["score"]) for r in L.license_scan(df, mine).orderBy("doc_id").collect()] == [(1, "house", 1.0), (2, "", 0.0)]
    with pytest.raises(ValueError):
        L.Index([L.Template("x", "some words here", ("other words",))]).phrases


def test_plan_has_no_python(docs):
    plan = L.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
