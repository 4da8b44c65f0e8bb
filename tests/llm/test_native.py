import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontamination, license_scan, line_dedup, quality_rules, registry, url_filters
from tests.compare import rows, sql_rows
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, n_words string, host string, h string, line string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def table(spark, data):
    """(doc_id, text, source) with clashing extra columns."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y", "z", "q", "r") for d, t, s in data], DOCS)


def edge_rows():
    rnd = random.Random(3)
    sentence = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rnd.randint(0, 99)) for _ in range(n))
    data = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (None, sentence(30), None), (4, LONG, None), (5, "one\n\none\n one \ntwo", "b"), (6, "#*$%&|<> é#", "b")]
    data += [(10 + i, sentence(40), "bad" if i % 5 else None) for i in range(10)] + [(40 + i, sentence(4), "bad") for i in range(30)]
    again = sentence(12)
    data += [(80, f"{again} {sentence(3)} {again}", "c"), (80, f"{again} {sentence(3)} {again}", "c"), (81, again + "\n" + again, "c")]
    data += [(100 + i, f"menu home\n{sentence(25)}\n\nfooter 2024", "site") for i in range(15)]
    return data


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert rows(registry.queries()[name](spark, sf)) == sql_rows(registry.oracle_sql()[name], sf)


def _frame(data):
    return pd.DataFrame({"doc_id": pd.array([d for d, _, _ in data], "Int64"), "text": [t for _, t, _ in data], "source": [s for _, _, s in data]})


def test_quality_rules_edges(spark):
    data = edge_rows()
    got = quality_rules.judge(table(spark, data))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"]
    assert rows(got.select(*cols)) == sql_rows(quality_rules.SQL, tables={"documents": _frame(data)})
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[11]["host_rejected"] and not by_id[11]["kept"] and by_id[10]["kept"] and by_id[None]["kept"]
    for d, t, _ in data:
        assert by_id[d]["n_repeat_words"] == brute.repeated_words(brute.WORD.findall(t or "")), d
    kept = quality_rules.keep_good(table(spark, data))
    assert kept.columns == table(spark, data).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got.where("kept").collect())


def test_quality_rules_one_host_and_empty(spark):
    assert quality_rules.judge(table(spark, [])).count() == 0 and quality_rules.keep_good(table(spark, [])).count() == 0
    assert quality_rules.judge(table(spark, [(1, LONG, "a"), (2, None, None)])).count() == 2


def test_prior_takes_noise_off():
    rnd = random.Random(6)

    def fitted(hosts):
        return quality_rules.prior(len(hosts), sum(n for n, _ in hosts), sum(n * n for n, _ in hosts), sum(k for _, k in hosts), sum(k * k / n for n, k in hosts))

    equal = [(n, sum(rnd.random() < 0.3 for _ in range(n))) for n in (rnd.randint(1, 6) for _ in range(3000))]
    apart = [(n, sum(rnd.random() < p for _ in range(n))) for n, p in ((rnd.randint(1, 6), rnd.betavariate(3, 7)) for _ in range(20000))]
    assert fitted(equal)[1] > 50  # the hosts are alike, however much their rates of few documents differ
    assert fitted(apart)[0] == pytest.approx(0.3, abs=0.02) and 7 < fitted(apart)[1] < 14
    assert quality_rules.prior(0, None, None, None, None) == (0.0, quality_rules.FLAT_PRIOR) and fitted([(5, 5)])[0] == 1
    assert fitted([(50, 50), (50, 0)])[1] == 1.0


@pytest.mark.parametrize("bound", [0, 1000])
def test_line_dedup_edges(spark, bound):  # 0: found lines are joined
    data = edge_rows()
    out = line_dedup.drop_boilerplate(table(spark, data), broadcast_lines=bound)
    expected = {(r[0], r[3]) for r in sql_rows(line_dedup.SQL, tables={"documents": _frame(data)})[1]}
    assert sql_rows(line_dedup.SQL, tables={"documents": _frame(data)})[0] == ["doc_id", "n_dropped", "n_lines", "text"]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == expected and out.count() == len(data)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert not texts[100].startswith("menu") and "\n\n" not in texts[100].strip("\n") and texts[5] == "one\n\none\n one \ntwo" and texts[1] is None
    small = [(i, f"menu {i % 2}\nown {i}", "tiny") for i in range(8)] + [(20 + i, "same text", "pair") for i in range(3)]
    assert {r["text"] for r in line_dedup.drop_boilerplate(table(spark, small)).collect()} == {f"own {i}" for i in range(8)} | {"same text"}
    few = [(i, f"line {i % 3}\nown {i}", "small") for i in range(12)]
    assert line_dedup.drop_boilerplate(table(spark, few)).where("text <> __was").count() == 0
    clean = line_dedup.dedup_lines(table(spark, data))
    assert clean.columns == table(spark, data).columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.collect())
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_masks_lose_nothing():
    width, need = decontamination.WINDOW, decontamination.WINDOW_MATCHES
    import itertools

    for wrong in itertools.combinations(range(width), width - need):
        assert any(not {o + k for k in m} & set(wrong) for m in decontamination.MASKS for o in range(width - m[-1])), wrong
    assert any(m[-1] < decontamination.MIN_ITEM_TOKENS for m in decontamination.MASKS)


@pytest.mark.parametrize("bound", [0, 1000])
def test_overlaps(spark, bound):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 8, 12, 13, 20, 40])))) for i in range(12)] + [(90, None), (91, "")]
    items.append((92, items[4][1]))
    docs = [(1, None), (2, ""), (None, items[4][1]), (3, LONG + " " + items[5][1])]
    for d in range(10, 50):
        w = (items[rnd.randrange(12)][1]).split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        docs.append((d, " ".join([*[word() for _ in range(rnd.randint(0, 9))], *w, *[word() for _ in range(9)]]).upper()))
    docs.append(docs[-1])
    df = table(spark, [(d, t, "s") for d, t in docs])
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, pos string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(df, bench, broadcast_seeds=bound).collect()}
    assert got == brute.overlaps(docs, items) and (None, 92) in got
    left = decontamination.drop_contaminated(df, bench)
    assert left.columns == df.columns
    leaks = {d for d, _ in got}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in leaks)
    assert decontamination.find_overlaps(table(spark, []), bench).count() == 0
    assert decontamination.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def _pagerank(seeds, edges, damping=0.85, steps=200):
    rank = dict(seeds)
    out = {}
    for (a, b), w in edges.items():
        out.setdefault(a, {})[b] = w
    for _ in range(steps):
        new = {}
        for a, r in rank.items():
            for b, w in out.get(a, {}).items():
                new[b] = new.get(b, 0) + damping * r * w / sum(out[a].values())
        loose = sum(r for a, r in rank.items() if a not in out)
        for a, s in seeds.items():
            new[a] = new.get(a, 0) + (1 - damping + damping * loose) * s
        rank = new
    return rank


def test_url_filters(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "HTTP://Shop.Example.COM/en/99?q#f", link("a.org", "b.org")), (2, "https://www.example.com/en/7x", ""), (3, "http://site.net/de/1", link("b.org", "C.org", "c.org")),
        (4, "x://example.net/de/8", link("d.org")), (5, "https://a.org/fr/", link("c.org")), (6, "https://b.org", '<img SRC=//shop.example.com/i.png><a href="/rel">'), (7, "https://c.org/es/1", None),
        (8, None, link("a.org")), (9, "nothing", ""), (10, "https://d.org?es/", link("example.net")), (11, "https://e.org/q", ""), (1, "https://notcom/en/", ""),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = {(r["page_id"], r["url_host"]): (r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(df).withColumnRenamed("host", "url_host").collect()}
    assert got[(1, "shop.example.com")] == ("/en/99", "com/en/", "block") and got[(2, "www.example.com")] == ("/en/7x", "example.com/en/7", "allow")
    assert got[(3, "site.net")][1:] == ("net/de/", "allow") and got[(4, "example.net")][1:] == ("example.net/de/8", "block")
    assert got[(8, "")] == ("", None, "allow") and got[(9, "")] == ("", None, "allow") and got[(1, "notcom")][1] is None and got[(7, "c.org")][1:] == ("org/es/", "block")
    edges = {(r["src"], r["dst"]): r["weight"] for r in url_filters.host_edges(df).collect()}
    assert edges[("b.org", "shop.example.com")] == 1 and edges[("site.net", "c.org")] == 1
    trusted, blocked = {"www.example.com": 0.5, "site.net": 0.5}, {h: 1 / 3 for h in ("shop.example.com", "example.net", "c.org")}
    trust, distrust = _pagerank(trusted, edges), _pagerank(blocked, {(b, a): w for (a, b), w in edges.items()})
    scores = {r["host"]: r for r in url_filters.host_scores(df).collect()}
    for h, r in scores.items():
        assert r["trust"] == pytest.approx(trust.get(h, 0), abs=1e-9) and r["distrust"] == pytest.approx(distrust.get(h, 0), abs=1e-9), h
        bad = distrust.get(h, 0) > 0.5 * (distrust.get(h, 0) + trust.get(h, 0))
        assert r["host_verdict"] == ("block" if bad else "allow")
    assert got[(11, "e.org")][2] == "allow" and got[(6, "b.org")][2] == scores["b.org"]["host_verdict"]
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_urls_of_a_link_graph(spark, tmp_path):
    rnd = random.Random(12)
    tops = ("com", "net", "org", "info")
    hosts = [f"h{k}.{tops[k % 4]}" for k in range(60)]
    pages = []
    for k in range(400):
        here = rnd.choice(hosts)
        links = "".join(f'<a href="http://{rnd.choice(hosts)}/{rnd.randint(0, 9)}">' for _ in range(rnd.randint(0, 3)))
        pages.append((k, rnd.choice([None, "x", f"https://{here}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{k}"]) if k % 9 == 0 else f"https://{here}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{k}", links))
    pages += [(900, "https://h1.net/fr/1", LONG * 20 + '<a href="//h2.org/">'), pages[5], pages[5], (901, "https://even.com/en/", ""), (902, "https://even.com.net/de/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["op5_url_filters"](spark, str(tmp_path)).collect()

    def split(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        path = rest[end:]
        return rest[:end].lower(), path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]

    def rule(host, path):
        fits = [(len(h + p), h + p, a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    seen, edges = {}, {}
    for _, url, html in pages:
        host, path = split(url)
        if host:
            own = seen.setdefault(host, [0, 0])
            action = rule(host, path)[1]
            own[0] += action == "allow"
            own[1] += action == "block"
            for other in {x.lower() for x in re.findall(r'href="(?:http:)?//([^/"]+)', html or "")} - {host}:
                edges[host, other] = edges.get((host, other), 0) + 1
    good, bad = [h for h, (a, b) in seen.items() if a > b], [h for h, (a, b) in seen.items() if b > a]
    assert good and bad
    trust = _pagerank({h: 1 / len(good) for h in good}, edges)
    distrust = _pagerank({h: 1 / len(bad) for h in bad}, {(b, a): w for (a, b), w in edges.items()})
    want = []
    for page, url, _ in pages:
        host, path = split(url)
        name, action = rule(host, path)
        worse = host in seen and distrust.get(host, 0) > 0.5 * (trust.get(host, 0) + distrust.get(host, 0))
        want.append((page, host, path, name, action or ("block" if worse else "allow")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {w[4] for w in want if w[3] is None and w[1]} == {"allow", "block"}


def test_licenses(spark):
    rnd = random.Random(2)
    plain = lambda: " ".join(rnd.choice("the of and license work free river under version public car tree house".split()) for _ in range(25))
    data = [(i, plain() + "\n" + plain(), "s") for i in range(40)] + [(50, None, "s"), (51, "", "s"), (52, "License", "s"), (53, LONG, "s")]
    notices = {60: ("MIT", "Released under the MIT License."), 61: ("GPL", "This work is licensed under the GNU General Public License, version 3."), 62: ("CC-BY-NC", "licensed under cc by-nc 4.0"), 63: ("Apache-2.0", "Some words first. Licensed under the Apache License, Version 2.0.")}
    data += [(d, f"{plain()}\n{t}\n{plain()}", "s") for d, (_, t) in notices.items()]
    data += [data[-1], (None, "Released under the MIT License.", None)]
    df = table(spark, data)
    model = license_scan.fit(spark, df)
    got = license_scan.scan(spark, df, model).where("confirmed").collect()
    assert {r["doc_id"]: r["family"] for r in got} == {**{d: f for d, (f, _) in notices.items()}, None: "MIT"} and len(got) == len(notices) + 1
    assert all(r["paragraph"] == 1 and 0.5 <= r["probability"] <= 1 for r in got if r["doc_id"])
    assert license_scan.scan(spark, table(spark, []), model).count() == 0
    assert license_scan.fit(spark, table(spark, []))["classes"] == model["classes"]


def grams(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return [tuple(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1)]


def test_licence_scores_against_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = license_scan.fit(spark, docs)
    texts, owner = model["texts"], [f for f in model["classes"][:-1] for _ in license_scan.TEMPLATES[f]]
    names = sorted({g for t in texts for g in grams(t)})
    made = spark.createDataFrame([(k, *g, None)[:4] for k, g in enumerate(names)], "k int, a string, b string, c string")
    h = [F.xxhash64(F.col(c)) for c in "abc"]
    hashed = made.select("k", F.when(F.col("c").isNull(), F.xxhash64(h[0], h[1])).otherwise(F.xxhash64(*h)).alias("h")).collect()
    weights = {names[r["k"]]: dict((x["gram"], x["w"]) for x in model["weights"])[r["h"]] for r in hashed}
    got = {(r["doc_id"], r["paragraph"]): r for r in registry.queries()["op10_license_scan"](spark, sf).collect()}
    want, classes = {}, model["classes"]
    for d, text in [tuple(r) for r in docs.collect()]:
        for p, line in enumerate((text or "").split("\n")):
            own = grams(line)
            there = {g for g in own if g in weights}
            if not there:
                continue
            z = [b + s * (1 - len(there) / len(own)) + sum(weights[g][k] for g in there) for k, (b, s) in enumerate(zip(model["bias"], model["strange"]))]
            best = max(range(len(z)), key=lambda k: (z[k], -k))
            probability = 1 / sum(math.exp(v - z[best]) for v in z)
            if classes[best] == license_scan.UNKNOWN or probability < license_scan.MIN_PROBABILITY:
                continue
            like = [(min(1.0, len(set(grams(t)) & there) / min(len(set(grams(t))), len(own))), -k) for k, (t, f) in enumerate(zip(texts, owner)) if f == classes[best]]
            want[d, p] = (classes[best], probability, max(like)[0])
    assert len(want) >= 3 and set(got) == set(want)
    for key, (family, probability, likeness) in want.items():
        r = got[key]
        assert r["family"] == family and r["probability"] == pytest.approx(probability, abs=1e-4) and r["similarity"] == pytest.approx(likeness), key
        assert r["confirmed"] == (likeness >= license_scan.MIN_SIMILARITY)
    print("licences on held-back wording:", model["temperature"], model["held_back"])
    assert model["held_back"]["right"] > 0.5


def test_licence_sample_and_ties(spark):
    data = [(i, f"line {i % 40} of text\nother {i}", "s") for i in range(300)]
    assert len(license_scan.sample_lines(table(spark, data), 20)) == 20
    model = license_scan.fit(spark, table(spark, data))
    twin = {**model, "weights": [{**r, "w": [5.0, 5.0, *[0.0] * (len(model["classes"]) - 2)]} for r in model["weights"]], "bias": [0.0] * len(model["classes"]), "strange": [0.0] * len(model["classes"])}
    got = license_scan.scan(spark, table(spark, [(1, "Released under the MIT License.", "s"), (2, LONG + " Released under the MIT License.", "s")]), twin, min_probability=0.1).collect()
    assert {r["family"] for r in got} == {model["classes"][0]} and {r["doc_id"] for r in got} == {1, 2}


def test_native_plans_have_no_python(spark, sf):
    for name in ("op1_quality_rules", "op3_line_dedup", "op4_benchmark_decontamination", "op10_license_scan"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
