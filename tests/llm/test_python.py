import hashlib
import random
import zlib
from array import array

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.llm import bpe, language_id, lattice_lm, registry, simhash_dedup, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, gram int, held_out int, word string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def table(spark, data):
    """(doc_id, text) or (doc_id, text, lang) with clashing extra columns."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1, "f", 2, 3, "w") for r in data], DOCS)


def texts(sf):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()


# Language identification


def test_chain_is_exact():
    rng = np.random.default_rng(0)
    emissions, lengths = rng.normal(size=(2, 4, 3)), np.array([4, 2])
    start, trans = rng.normal(size=3), rng.normal(size=(3, 3))
    chain = language_id.Chain(emissions, lengths, start, trans)
    pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        marginal, z, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(start[path[0]] + sum(emissions[c, t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            z += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        pairs += own / z
        assert np.allclose(chain.post[c, :n], marginal / z)
    assert np.allclose(chain.pairs(), pairs)


def test_language_accuracy_and_switching(spark, sf):
    rows = {r["doc_id"]: r for r in registry.queries()["op2_language_id"](spark, sf).collect()}
    truth = texts(sf)
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    held = [(rows[d]["lang_pred"], lang) for d, _, lang in truth if rows[d]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    lines = [(line, lang) for d, t, lang in truth if not rows[d]["held_out"] for line in t.split("\n")]
    model = language_id.fit(lines, rounds=30)
    de, en = "der die und ist von mit".split(), "the and of with that from".split()
    post = language_id.label_lines(model, [en + de, []])
    assert len(post[1]) == 0
    best = [model["langs"][k] for k in post[0].argmax(axis=1)]
    assert best[0] == "en" and best[-1] == "de"


def _plain_language(model, text):
    """(lang_pred, score) by sums over all paths, word by word, from the fitted weights."""
    langs, n = model["langs"], len(model["langs"])
    add = lambda xs: max(xs) + np.log(sum(np.exp(x - max(xs)) for x in xs))
    total = np.zeros(n)
    for line in (text or "").split("\n"):
        words = [w for w in brute.WORD.findall(line)]
        if not words:
            continue
        rows, counted = [], []
        for w in words:
            s = language_id.letters_of(w)
            counted.append(any(map(str.isalpha, s)))
            own = [model["w"][model["features"][f]] for f in language_id.features_of(s) if f in model["features"]] if counted[-1] else []
            rows.append(sum(own, np.zeros(n)))
        forward, backward = [model["s"] + rows[0]], [np.zeros(n)]
        for row in rows[1:]:
            forward.append(np.array([add([forward[-1][a] + model["t"][a, b] for a in range(n)]) + row[b] for b in range(n)]))
        for row in rows[:0:-1]:
            backward.append(np.array([add([model["t"][a, b] + row[b] + backward[-1][b] for b in range(n)]) for a in range(n)]))
        for f, b, c in zip(forward, backward[::-1], counted):
            if c:
                total += np.exp(f + b - add(list(f + b)))
    if total.sum() == 0:
        return "und", 0.0
    return langs[int(total.argmax())], float(total.max() / total.sum())


def test_language_against_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(language_id.training_lines(docs))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in registry.queries()["op2_language_id"](spark, sf).collect()}
    for d, t, _ in [r for r in texts(sf) if len(r[1] or "") < 6000]:
        lang, score = _plain_language(model, t)
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-9), d


def test_feature_kinds_are_apart():
    kinds = lambda w: {f[0] for f in language_id.features_of(w)}
    assert kinds("prose") == set("ps23w")
    own = language_id.features_of("aprobewas")
    assert len(set(own)) == len(own) and not set(language_id.features_of("pro")) & {f[1:] for f in own}


def test_language_switches_within_a_line(sf):
    own = {}
    for _, t, lang in texts(sf):
        own.setdefault(lang, []).extend(x for x in (t or "").split("\n") if len(x.split()) >= 8)
    lines = [(x, lang) for lang, xs in own.items() for x in xs[: len(xs) // 2][:200]]
    model, rnd, hits, n = language_id.fit(lines), random.Random(5), 0, 0
    for _ in range(200):
        a, b = rnd.sample(sorted(own), 2)
        left, right = (rnd.choice(own[x][len(own[x]) // 2 :]).split() for x in (a, b))
        post = language_id.label_lines(model, [left + right])[0]
        best = [model["langs"][k] for k in post.argmax(axis=1)]
        hits += sum(x == y for x, y in zip(best, [a] * len(left) + [b] * len(right)))
        n += len(best)
    print("words of switched lines labelled right:", hits / n)
    assert hits >= 0.9 * n and (model["t"].diagonal() > model["t"].mean()).all()


def test_sample_is_bounded_and_has_every_language(spark):
    data = [(i, f"w{i} a\nb c {i}\n\nd", f"l{i % 70:02}") for i in range(4000)]
    lines = language_id.training_lines(table(spark, data), train_docs=3, train_lines=5)
    counts = {}
    for _, lang in lines:
        counts[lang] = counts.get(lang, 0) + 1
    assert set(counts.values()) == {5} and len(counts) == 70


def test_language_edges(spark):
    data = [(i, f"der die und nicht {i} ung lich", "de") for i in range(30)] + [(100 + i, f"the and of with {i} ing tion", "en") for i in range(30)]
    data += [(200, None, "en"), (201, "", "en"), (202, "123 !! 45", None), (None, "the of and", "en"), (203, "the of and", None), (204, LONG.replace("w", "the "), "en"), (205, "\n\n the\x0b\n", "en")]
    data.append(data[-1])
    df = table(spark, data)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(df, language_id.fit(language_id.training_lines(df))).collect()]
    by_id = {d: (p, s) for d, p, s in got}
    assert len(got) == len(data)
    assert by_id[200] == by_id[201] == by_id[202] == ("und", 0.0)
    assert by_id[None][0] == by_id[203][0] == by_id[204][0] == by_id[205][0] == "en" and by_id[0][0] == "de"
    nothing = language_id.fit(language_id.training_lines(table(spark, [])))
    assert [r["lang_pred"] for r in language_id.predict(df.limit(1), nothing).collect()] == ["und"]
    assert language_id.predict(table(spark, []), nothing).count() == 0


# Suffix arrays


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(200):
        a = np.array([rnd.randint(1, rnd.choice([1, 2, 9])) for _ in range(rnd.randint(1, 50))])
        assert suffix_dedup.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_equal_strings_share_their_anchor():
    rnd = random.Random(1)
    shared = bytes(rnd.randrange(97, 100) for _ in range(140))
    parts = [bytes(rnd.randrange(97, 123) for _ in range(k)) + shared for k in (0, 3, 70_000)]
    owner, first, n, gram, data, start = suffix_dedup.blocks(parts)
    assert n.sum() == sum(len(p) - suffix_dedup.LENGTH + 1 for p in parts) and n.max() <= 65
    of = {}
    for o, f, k, g in zip(owner, first, n, gram):
        for s in range(f, f + k):
            of.setdefault(parts[o][s : s + 100], set()).add(int(g))
    assert all(len(g) == 1 for g in of.values())


def test_filter_of_grams(spark):
    rnd = np.random.default_rng(3)
    grams = rnd.integers(0, 1 << 63, 400_000, dtype=np.int64)
    grams[::2] >>= 20  # hashes that are least of their window
    known = suffix_dedup._filter(spark.createDataFrame(pd.DataFrame({"gram": grams[:200_000]})), 200_000)
    assert len(known) == 4
    assert suffix_dedup._held(known, grams[:200_000].view(np.uint64)).all()
    assert suffix_dedup._held(known, grams[200_000:].view(np.uint64)).mean() < 0.03
    empty = suffix_dedup._filter(spark.createDataFrame([], "gram long"), 0)
    assert not suffix_dedup._held(empty, grams.view(np.uint64)).any()


@pytest.mark.parametrize("crowd, grams", [(5000, 1000), (1, 1000), (5000, 0)])
def test_repeats_edges(spark, crowd, grams, monkeypatch):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdé \n") for _ in range(400))
    data = [
        (i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) + base[rnd.randint(0, 200) : rnd.randint(200, 400)] + rnd.choice(["", "x" * 250, "ab" * 200, base]))
        for i in range(50)
    ]
    data += [(3, data[3][1]), (70, None), (None, base), (71, ""), (None, base), (72, "ü" * 49 + "a"), (73, "ü" * 49 + "a"), (74, "ü" * 50), (75, "ü" * 50), (76, LONG)]
    ranges = suffix_dedup.repeat_ranges
    monkeypatch.setattr(suffix_dedup, "repeat_ranges", lambda d: ranges(d, crowd=crowd, filter_grams=grams))
    got = suffix_dedup.remove_repeats(table(spark, data))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = got.collect()
    assert sorted([tuple(r[c] for c in cols) for r in rows], key=str) == sorted(brute.repeats(data), key=str)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in rows)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("widths", [(8, 1), (8,), (1,), (30, 3)])
def test_parts_of_crowded_blocks(spark, widths, monkeypatch):
    rnd = random.Random(7)
    core = "".join(rnd.choice("abcdefgh") for _ in range(60))
    data = [(i, "".join(rnd.choice("xy") for _ in range(rnd.randint(0, 90))) + core + "".join(rnd.choice("uv") for _ in range(rnd.randint(0, 9))) + "z" * 50) for i in range(150)]
    ranges, firsts = suffix_dedup.repeat_ranges, suffix_dedup._firsts
    monkeypatch.setattr(suffix_dedup, "_firsts", lambda m, c, w=widths: firsts(m, c, w))
    monkeypatch.setattr(suffix_dedup, "repeat_ranges", lambda d: ranges(d, crowd=3))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = sorted(tuple(r[c] for c in cols) for r in suffix_dedup.remove_repeats(table(spark, data)).collect())
    assert got == brute.repeats(data)


def test_repeats_of_the_query(spark, sf):
    got = [tuple(r) for r in registry.queries()["op6_suffix_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(brute.repeats([r[:2] for r in texts(sf)]))


# SimHash


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO", "a b c", "a b c d e f g", "É é Ü", LONG, "x\x0by\x0cz"):
        assert simhash_dedup.fingerprint(t) == brute.fingerprint(t), t


@pytest.mark.parametrize("cap", [2, 8, 1000])
def test_links_between_crowded_fingerprints(spark, cap):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(100)} | {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(2):
        centre = rnd.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.links(df, cap)).collect()}
    groups, expected = {}, {}
    for k, (x, c) in enumerate(zip(signed, brute.components(fps))):
        groups.setdefault(found.get(x, x), set()).add(k)
        expected.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_query_and_edges(spark, sf):
    def expected(data):
        fps = [brute.fingerprint(t) for _, t in data]
        least = {}
        for (d, _), c in zip(data, brute.components(fps)):
            least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
        return sorted([(d, f"{fp:016x}", least[c]) for (d, _), fp, c in zip(data, fps, brute.components(fps))], key=str)

    got = registry.queries()["op7_simhash_near_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == expected([r[:2] for r in texts(sf)])
    data = [(5, None), (4, ""), (9, " \t"), (1, "hello"), (2, "HELLO"), (None, "hello"), (None, "alone here"), (3, LONG), (8, LONG), (8, LONG), (7, "a b c")]
    found = simhash_dedup.near_duplicates(table(spark, data))
    rows = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    assert sorted(map(tuple, rows), key=str) == expected(data)
    assert simhash_dedup.near_duplicates(table(spark, [])).count() == 0
    kept = simhash_dedup.keep_one(table(spark, data), shingle_words=3)
    assert kept.columns == table(spark, data).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [4, 1, None, None, 3, 7]))


# BPE


def test_bpe_against_library(sf):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, codec = Tokenizer.from_file(path), bpe.Codec(bpe.load(path))
    rnd = random.Random(1)
    pool = "aAbBzZ09 .,'’!#\t\n\r\x0b\x0c\x1c\x85\xa0éÉßẞΣσςİıñ́̀中日本🎉👩‍ǅﬁ½²Ⅷ　<|>_-$Å­"
    data = [t for _, t, _ in texts(sf)] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    data += ["a<|endoftext|>b", "<|startoftext|>", " <|endoftext|><|startoftext|> y's WE'LL", "ΑΣ ΌΣΟΣ", "", LONG]
    for t in data:
        ids = library.encode(t, add_special_tokens=False).ids
        assert array("I", codec.encode(t)).tolist() == ids, t[:60]
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False), t[:60]


def test_bpe_memory_is_bounded():
    spec = bpe.load(bpe.default_path())
    small, large = bpe.Words(spec, limit=3), bpe.Words(spec)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)] * 2
    assert [small[w] for w in words] == [large[w] for w in words] and len(small) + len(small.old) <= 6


def test_bpe_edges(spark):
    data = [(1, None), (2, ""), (None, "the cat"), (3, LONG), (3, LONG), (4, " \x85 ")]
    got = bpe.encode_documents(table(spark, data), bpe.default_path(), keep_ids=True, keep_decoded=True).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(data) and by_id[1]["n_tokens"] == 0 and by_id[1]["decoded"] == "" and by_id[4]["n_tokens"] == 0
    assert by_id[1]["ids_sha256"] == by_id[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    for r in got:
        assert hashlib.sha256(array("I", r["ids"]).tobytes()).hexdigest() == r["ids_sha256"] and len(r["ids"]) == r["n_tokens"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.encode_documents(table(spark, []), bpe.default_path()).count() == 0


# Lattice


def _all_paths(lattice, word):
    text = lattice.mark + word

    def paths(i, uses, p):
        if i == len(text):
            yield uses, p
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in lattice.ids:
                k = lattice.ids[text[i:j]]
                yield from paths(j, [*uses, k], p * np.exp(lattice.weights[k]))
        if text[i] not in lattice.ids:
            own = [lattice.bytes[b] for b in text[i].encode()]
            yield from paths(i + 1, [*uses, *own], p * np.exp(sum(lattice.weights[k] for k in own)))

    return list(paths(0, [], 1.0))


def test_lattice_sums_all_paths():
    spec, prior = lattice_lm.load_vocabulary(lattice_lm.default_path())
    assert np.exp(prior).sum() == pytest.approx(1)
    lattice = lattice_lm.Lattice(spec, prior)
    words = ["the", "thntioning", "été", "🎉x", "x", "zu"]
    into, expected = np.zeros(len(prior)), np.zeros(len(prior))
    logs = lattice_lm._batched(lattice, words, np.arange(1.0, 7.0), into)
    for k, w in enumerate(words):
        found = _all_paths(lattice, w)
        z = sum(p for _, p in found)
        assert logs[k] == pytest.approx(np.log(z)) and lattice.log_prob(w) == pytest.approx(np.log(z))
        for uses, p in found:
            np.add.at(expected, uses, (k + 1) * p / z)
    assert np.allclose(into, expected)


def test_lattice_of_a_very_long_word():
    spec, prior = lattice_lm.load_vocabulary(lattice_lm.default_path())
    lattice = lattice_lm.Lattice(spec, prior)
    word = "".join(random.Random(1).choice("abtheingo🎉é") for _ in range(300))
    text, alpha = lattice.mark + word, [0.0]  # the whole table
    for j in range(1, len(text) + 1):
        alpha.append(lattice._sum([alpha[i] + w for i, _, w in lattice._arriving(text, j)]))
    assert lattice.log_prob(word) == pytest.approx(alpha[-1])
    import tracemalloc

    tracemalloc.start()
    assert np.isfinite(lattice.log_prob("ab" * 500_000))
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("shipped", [0, 3, 10_000])
def test_lattice_scores(spark, shipped):
    data = [(i, " ".join(random.Random(i).choice(["The", "cat", "sat", "on", "été", "🎉"]) for _ in range(i % 9))) for i in range(40)]
    data += [(50, None), (51, ""), (None, "the dog"), (52, "rare words here"), (52, "rare words here"), (53, "THE\x0bcat"), (54, "q" * 60)]
    got = lattice_lm.score_documents(table(spark, data), lattice_lm.default_path(), shipped_words=shipped).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    own = lambda t: [*(t or "").translate(brute.UPPER).split(), ""]
    counts = {}
    for d, t in data:
        if not held(d):
            for w in own(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    spec, prior = lattice_lm.load_vocabulary(lattice_lm.default_path())
    uses = np.exp(prior) * lattice_lm.PRIOR_MASS
    first = lattice_lm.Lattice(spec, prior)
    for w, c in counts.items():
        first.expect(w, c, uses) if w else np.add.at(uses, spec["end"], c)
    model = lattice_lm.Lattice(spec, np.log(uses[: len(prior)] / uses.sum(), where=uses > 0, out=np.full(len(prior), -np.inf)))
    score = lambda w: (model.log_prob(w) if w else model.weights[spec["end"]]) / np.log(10)
    want = []
    for d, t in data:
        ws = own(t)
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in ws)
        want.append((str(d), held(d), len(ws), sum(w in counts for w in ws), total, round(base, 6), round(sum(map(score, ws)), 6)))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)) == sorted(want)
    assert all(r["score"] < 0 for r in got)


def test_lattice_empty(spark):
    assert lattice_lm.score_documents(table(spark, []), lattice_lm.default_path()).count() == 0
