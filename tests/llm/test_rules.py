"""Operators 1, 3 and 9 against brute force."""

import math
import random
import re
import textwrap
from collections import Counter

import pytest
from conftest import DATA

from llm.llm_edges import EDGES
from tessera.llm import license_scan, quality_rules, url_filters
from tessera.llm.queries import ALLOW_RULES, BLOCK_RULES, LISTED_BLOCK

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = lambda r: (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/"):])
    found = sorted(filter(fits, BLOCK_RULES + ALLOW_RULES), key=len)
    rule = found[-1] if found else None
    verdict = ("block" if rule in BLOCK_RULES else "allow") if rule else "block" if any(map(fits, LISTED_BLOCK)) else "allow"
    return host, path, rule, verdict


@pytest.mark.parametrize("bound", [(url_filters.PART_KEYS, url_filters.PASS_PARTS), (4, 3)])
def test_urls(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filters, "PART_KEYS", bound[0])  # the second bounds take four parts in two passes
    monkeypatch.setattr(url_filters, "PASS_PARTS", bound[1])
    r = random.Random(2)
    urls = [None, "", "x", "://", "a://COM/en/", "http://notcom/en/", "http://com?/en/", "http://x.Example.com/en/7/8", "ftp://a\nb.com/en/#x", "http://.com/en/", "a://b://com/en/", "http://" + "a." * 5000 + "com/en/"]
    urls += [f"http{r.choice(['', 's'])}://{r.choice(['', 'a.', 'b.c.', 'spam-farm.', 'm.spam-farm.', 'free-bets.'])}{r.choice(['example.com', 'example.net', 'example.org', 'Com', 'net'])}/{r.choice(['en', 'de', 'es'])}/{r.randint(0, 900)}{r.choice(['', '?x', '#y'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.judged(df, BLOCK_RULES, ALLOW_RULES, LISTED_BLOCK).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    table = spark.createDataFrame([(r,) for r in LISTED_BLOCK] + [(None,)], "rule string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filters.judged(df.unionByName(df), BLOCK_RULES, ALLOW_RULES, table).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filters.judged(df.limit(0), BLOCK_RULES, ALLOW_RULES).count() == 0
    assert {x.verdict for x in url_filters.judged(df, [], []).collect()} == {"allow"}


@pytest.mark.parametrize("parts", [1, 5])
def test_cascade_is_exact_over_its_universe(spark, parts):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS h1", "xxhash64(id, 9) AS h2", "id % 7 = 0 AS x", "id % 3 = 0 AS y").cache()
    pdf = keys.toPandas()
    h1, h2, part = pdf.h1.to_numpy(), pdf.h2.to_numpy(), url_filters.part_of(pdf.h2.to_numpy(), parts)
    for chosen in (range(0, 1), range(1, parts)):
        cascades = url_filters.build_cascades(keys, ["x", "y"], parts, chosen)
        for i, name in enumerate(["x", "y"]):
            for p in chosen:
                own, here = cascades[i * parts + p], part == p
                assert len(own.levels) > 2 and (own.listed(h1[here], h2[here]) == pdf[name].to_numpy()[here]).all()


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    held = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held)


def test_measures_and_base(spark, docs):
    r = random.Random(3)
    rows = [*EDGES, *((100 + i, "".join(r.choice(["a ", "b ", "c ", "a b c ", "#", "\n", "\x0b", "é", "|"]) for _ in range(r.randint(0, 120)))) for i in range(200))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs(rows), labels).collect()
    want = []
    for k, t in rows:
        m = brute_rules(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((k, *m, failed, not failed))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert quality_rules.judged(docs([]), labels).count() == 0


def test_binomial_tail(spark):
    for k, n, p in ((0, 1000, 0.005), (3, 2000, 0.005), (40, 20_000, 0.005)):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        got = spark.sql(f"SELECT {quality_rules.lower_tail('k', 'n', f'{p}D')} FROM (SELECT {k}L AS k, {n}L AS n)").first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def brute_kept(rows, grades):
    """kept by doc_id, from (doc_id, text, lang) rows and the best grade of each labelled document."""
    measured, held = {}, {}
    for k, text, lang in rows:
        n, chars, symbols, dup, repeat = brute_rules(text)
        lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        shares = [symbols / chars if chars else None, dup / lines if lines else None, repeat / n if n else None, chars / n if n else None]
        steps = [next((4 * j + rule for j, cut in enumerate(cuts) if share is not None and share > cut), 99) for rule, (share, cuts) in enumerate(zip(shares, quality_rules.CUTOFFS.values(), strict=True))]
        measured[k] = (lang or "", n < 50 or 100 * repeat > 50 * n, min(steps))
        if k in grades and not measured[k][1]:
            held.setdefault(lang or "", []).append((grades[k], min(steps)))
    cut, tested = {}, sum(0.98 ** sum(g for g, _ in own) <= 0.05 for own in held.values())
    for lang, own in held.items():
        n, gains = sum(g for g, _ in own), []
        for step in range(40):
            good, bad = sum(g and s <= step for g, s in own), sum(not g and s <= step for g, s in own)
            tail = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(good + 1))
            if good >= 0.02 * n or tail > 0.05 / max(1, tested):
                break
            gains.append((bad - 10 * good, -step))
        if gains and max(gains)[0] > 0:
            cut[lang] = -max(gains)[1]
    return {k: not failed and step > cut.get(lang, -1) for k, (lang, failed, step) in measured.items()}, cut


def test_kept_is_brute_force_on_given_documents(spark):
    path = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    want, cut = brute_kept([(x.doc_id, x.text, x.lang) for x in docs.collect()], {x.doc_id: x.quality > 0 for x in labels.collect()})
    assert cut  # at least one stratum has labels enough
    assert {x.doc_id: x.kept for x in quality_rules.judged(docs, labels).collect()} == want


def test_cutoffs_reject_junk_only(spark, docs):
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    good = [" ".join(r.sample(words, 60)) for _ in range(500)]
    bad = [" ".join(w + "###" for w in r.sample(words, 60)) for _ in range(100)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(good + bad)]  # a null stratum, labels that contradict and null ones
    labels = [(i, int(i < 500), 0, "x") for i in range(600)] + [(None, 1, 0, "x"), (5, None, None, "x"), (7, 0, 0, "x"), (5, 1, 0, "x")]
    kept = {x.doc_id: x.kept for x in quality_rules.judged(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")).collect()}
    assert all(kept[i] for i in range(500)) and not any(kept[i] for i in range(500, 600))
    few = spark.createDataFrame(labels[:290:2], "doc_id long, quality int, toxic int, lang string")  # too few labels: no cutoff
    assert all(x.kept for x in quality_rules.judged(docs(rows), few).collect())


def test_licenses(docs):
    lines = ["Released under the MIT License.", "released UNDER the mit-license", "Apache License, Version 2.0 and Apache license version 2", "cc by nc cc by nc", "This work is licensed under the GNU General Public License, version 3.", "the license is under the", "K cc BY-NC"]
    rows = [*EDGES, *((50 + i, f"some words\n{x}\nmore") for i, x in enumerate(lines))]
    got = {str(x.doc_id): x for x in license_scan.scanned(docs(rows)).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for k, t in rows:
        w, at, labels = words(t), [], set()
        for p, label in license_scan.PHRASES.items():
            own = p.split()
            found = [i for i in range(len(w)) if w[i : i + len(own)] == own]
            at += found
            labels |= {label} if found else set()
        x = got[str(k)]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    assert got["54"].labels == "gpl-3" and got["55"].labels == "" and 0 <= got["54"].score <= 1
    assert license_scan.scanned(docs([])).count() == 0


def test_all_notices_of_a_block_and_wrapped_ones(docs):
    notice = dict(license_scan.TEMPLATES)
    wrap = lambda t, width: "\n".join(textwrap.wrap(f"Some text before it. {t} Some text after it.", width))
    cases = [(f"{notice['cc-by-sa']} {notice['gpl-3']}", "cc-by-sa,gpl-3"), (f"{notice['gpl-3']} {notice['lgpl-3']}", "gpl-3,lgpl-3"), (f"{notice['cc-by-nc']} x {notice['cc-by-sa']}", "cc-by-nc,cc-by-sa")]
    cases += [(notice[k], k) for k in notice] + [(wrap(notice[k], width), k) for k in notice for width in (72, 40, 14)]
    cases += [("Redistribution and use\nin source and\n\nsome quite different prose", "")]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    found = [(x.doc_id, x.labels) for x in license_scan.scanned(docs(rows + rows[:9])).collect()]
    got = dict(found)
    assert len(found) == len(rows) + 9 and len(set(found)) == len(rows)  # repeated rows are scanned alike
    assert [(t, set(filter(None, got[i].split(",")))) for i, (t, _) in enumerate(cases)] == [(t, set(filter(None, x.split(",")))) for t, x in cases]


def brute_labels(text):
    """Labels of the method by comparing every block with every template."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)) if w]
    sets = [(label, set(words(t))) for label, t in license_scan.TEMPLATES]
    least = [math.ceil(round(0.8 * len(s), 9)) for _, s in sets]
    known = set().union(*[s for _, s in sets])
    between = math.ceil(round(max(len(words(t)) for _, t in license_scan.TEMPLATES) / 0.8, 9))
    lines = [(len(w), set(w) & known) for w in map(words, text.split("\n")) if w]
    blocks = [set(words(x)) & known for x in re.split(r"\n|[.;!?]\s", text)]
    for i in range(len(lines)):
        run, inner = set(), 0
        for j in range(i, len(lines)):
            run = run | lines[j][1]
            if lines[i][1] and lines[j][1]:
                blocks.append(run)
            inner += lines[j][0] if j > i else 0
            if inner > between:
                break
    found = set()
    for b in map(frozenset, set(map(frozenset, blocks))):
        met = {t: len(b & s) / len(s) for t, (_, s) in enumerate(sets) if len(b & s) >= least[t]}
        for t, c in met.items():
            own = sets[t][1]
            rivals = [(v, d) for v, d in met.items() if v != t]
            if not any((len(own & sets[v][1]) >= least[t] and d > c) or (own < sets[v][1] and d >= c) for v, d in rivals):
                found.add(sets[t][0])
    return found


def test_labels_are_brute_force(docs):
    r = random.Random(7)
    texts = []
    for _ in range(60):
        _, notice = r.choice(license_scan.TEMPLATES)
        w = [x for x in notice.split() if r.random() > r.choice([0.0, 0.1, 0.2, 0.3])]
        w = [y for x in w for y in ([x, r.choice(["new", "license", "word"])] if r.random() < 0.1 else [x])]
        other = r.choice(license_scan.TEMPLATES)[1] if r.random() < 0.4 else "some prose"
        texts.append("\n".join(textwrap.wrap(" ".join(["Before."] + w + [other]), r.choice([20, 50, 80, 2000]))))
    got = {x.doc_id: set(filter(None, x.labels.split(","))) for x in license_scan.scanned(docs(list(enumerate(texts)))).collect()}
    base = lambda t: {label for p, label in license_scan.PHRASES.items() if re.search(rf"(^|[^a-z0-9]){'[^a-z0-9]+'.join(p.split())}($|[^a-z0-9])", t.lower())}
    assert got == {i: brute_labels(t) | base(t) for i, t in enumerate(texts)}
