"""Language identification by a linear-chain conditional random field over words.

Every line of a text is a chain; every word gets a language label. A word's score for a language is
a sum of learned weights of its prefixes, suffixes, character n-grams and, where it is in the
training lexicon, the word itself; learned transitions tie neighbouring words, so that a switch of
language inside a text costs but is possible. Forward-backward gives each word's probability of each
language, and the text's score of a language is the mean over its words that have a letter.

Training takes lines of documents that have a language and are not held out: for each language, and
every language there is, at most `TRAIN_DOCS` documents, and of these at most `TRAIN_LINES` lines,
both chosen by hash and so the same in each run. This bounded sample is fitted on the driver;
everything else covers all rows. Beside the lines themselves, `MIXED` times as many chains are made of
the first and last halves of two lines of different languages, so that transitions learn switches.

Defined results: a null text and one without a letter give `und` and score 0; words without a letter
take part in no score; ties go to the language that sorts first; with nothing to learn from, every
text is `und`; a null doc_id is not held out; repeated rows give repeated results; whole texts of any
length are read; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import bounded_batches

HELD_OUT_OF, HELD_OUT = 3, 1
TRAIN_DOCS = 300
TRAIN_LINES = 600
#: Chains of two languages for each sampled line.
MIXED = 0.25
LEXICON_USES = 3
#: Words a worker remembers, and words whose chains are worked out at a time.
CACHE_WORDS = 1_000_000
BATCH_WORDS = 100_000
UNKNOWN = "und"

_word = re.compile(r"[^\x20\x09-\x0D]+")
_edge = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def letters_of(word: str) -> str:
    """The word in lower case from its first to its last letter; empty if it has none."""
    return word.lower() if word.isalpha() else _edge.sub("", word).lower()


def features_of(s: str) -> list[str]:
    """Names of the word's features; the first character tells prefixes, suffixes, n-grams and the word itself apart."""
    b = f"^{s}$"
    n = len(b)
    return [
        *[f"p{s[:k]}" for k in (1, 2, 3)], *[f"s{s[-k:]}" for k in (1, 2, 3, 4)],
        *[f"2{b[i : i + 2]}" for i in range(n - 1)], *[f"3{b[i : i + 3]}" for i in range(n - 2)], f"w{s}",
    ]


def chains(lengths: np.ndarray, most: int = BATCH_WORDS):
    """Blocks of chain numbers, longest first, whose padded words are no more than `most` where they are several."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        size = max(1, most // int(lengths[order[at]]))
        yield order[at : at + size]
        at += size


class Chain:
    """Forward-backward over a block of chains, longest first. rows: emission rows (log) by padded position."""

    def __init__(self, emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray):
        n, t_max, _ = emissions.shape
        self.active = [int(np.count_nonzero(lengths > t)) for t in range(t_max)]
        self.x = np.exp(emissions - emissions.max(axis=2, keepdims=True))
        self.trans = np.exp(trans - trans.max())
        alpha, beta = np.zeros_like(self.x), np.ones_like(self.x)
        a = np.exp(start - start.max()) * self.x[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, t_max):
            k = self.active[t]
            a = (alpha[:k, t - 1] @ self.trans) * self.x[:k, t]
            alpha[:k, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(t_max - 2, -1, -1):
            k = self.active[t + 1]
            b = (self.x[:k, t + 1] * beta[:k, t + 1]) @ self.trans.T
            beta[:k, t] = b / b.sum(axis=1, keepdims=True)
        self.alpha, self.beta = alpha, beta
        post = alpha * beta
        self.post = post / np.maximum(post.sum(axis=2, keepdims=True), 1e-300)

    def pairs(self) -> np.ndarray:
        """Expected uses of each transition."""
        total = np.zeros_like(self.trans)
        for t in range(1, self.x.shape[1]):
            k = self.active[t]
            right = self.x[:k, t] * self.beta[:k, t]
            z = np.einsum("bi,ij,bj->b", self.alpha[:k, t - 1], self.trans, right)
            total += self.trans * (self.alpha[:k, t - 1].T @ (right / z[:, None]))
        return total


def fit(lines: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-3, seed: int = 7, mixed: float = MIXED) -> dict:
    """Learn from (text of a line, language). Full-batch gradient steps with per-weight scaling (Adam)."""
    langs = sorted({lang for _, lang in lines})
    code = {lang: k for k, lang in enumerate(langs)}
    vocabulary, chains_, gold = {}, [], []
    uses = Counter()
    for text, lang in lines:
        words = [s for w in _word.findall(text) if (s := letters_of(w))]
        if words:
            chains_.append(np.array([vocabulary.setdefault(s, len(vocabulary)) for s in words]))
            gold.append(np.full(len(words), code[lang]))
            uses.update(words)
    if len(langs) > 1:
        drawn = np.random.default_rng(seed).integers(0, len(chains_), size=(int(mixed * len(chains_)), 2))
        for i, j in drawn[[gold[i][0] != gold[j][0] for i, j in drawn]]:
            first_half, last_half = slice(None, (len(chains_[i]) + 1) // 2), slice(len(chains_[j]) // 2, None)
            chains_.append(np.concatenate([chains_[i][first_half], chains_[j][last_half]]))
            gold.append(np.concatenate([gold[i][first_half], gold[j][last_half]]))
    types = list(vocabulary)
    seen = Counter(f for s in types for f in features_of(s))
    keep = {f: k for k, f in enumerate(f for f, n in seen.items() if (uses[f[1:]] >= LEXICON_USES if f[0] == "w" else n >= 2))}
    flat, owner = [], []
    for k, s in enumerate(types):
        own = [keep[f] for f in features_of(s) if f in keep]
        flat += own
        owner += [k] * len(own)
    flat, owner = np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)
    n_langs, n_types = len(langs), len(types)
    params = {"w": np.zeros((len(keep), n_langs)), "t": np.zeros((n_langs, n_langs)), "s": np.zeros(n_langs)}
    first, second = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    n_words = sum(map(len, chains_))
    lengths = np.array([len(c) for c in chains_], dtype=np.int64)
    for step in range(1, (rounds if n_langs > 1 else 0) + 1):
        by_type = np.stack([np.bincount(owner, weights=params["w"][flat, k], minlength=n_types) for k in range(n_langs)], axis=1)
        grad_type, grad = np.zeros((n_types, n_langs)), {k: np.zeros_like(v) for k, v in params.items()}
        for block in chains(lengths):
            t_max = lengths[block[0]]
            ids, true = np.zeros((len(block), t_max), dtype=np.int64), np.zeros((len(block), t_max), dtype=np.int64)
            for r, c in enumerate(block):
                ids[r, : lengths[c]], true[r, : lengths[c]] = chains_[c], gold[c]
            own = lengths[block]
            chain = Chain(by_type[ids], own, params["s"], params["t"])
            error = -chain.post
            error[np.arange(len(block))[:, None], np.arange(t_max)[None, :], true] += 1
            error[np.arange(t_max)[None, :] >= own[:, None]] = 0
            for k in range(n_langs):
                grad_type[:, k] += np.bincount(ids.ravel(), weights=error[:, :, k].ravel(), minlength=n_types)
            grad["s"] += error[:, 0].sum(axis=0)
            grad["t"] -= chain.pairs()
            inside = np.arange(1, t_max)[None, :] < own[:, None]
            np.add.at(grad["t"], (true[:, :-1][inside], true[:, 1:][inside]), 1.0)
        for k in range(n_langs):
            grad["w"][:, k] = np.bincount(flat, weights=grad_type[owner, k], minlength=len(keep))
        for k, v in params.items():
            g = grad[k] / n_words - decay * v / max(1, n_langs)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            v += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    key = hashlib.sha256(repr((langs, len(keep))).encode() + params["w"].tobytes()).hexdigest()
    return {"key": key, "langs": langs, "features": keep, "w": params["w"], "t": params["t"], "s": params["s"]}


class Words(dict):
    """Word, as text or UTF-8 -> emission row; row 0 is for words without a letter.

    The rows of new words are worked out together, when `settled` asks for them.
    """

    def __init__(self, model: dict):
        super().__init__()
        self.get_feature, self.w = model["features"].get, model["w"]
        self.rows = np.zeros((1, len(model["langs"])))
        self.n, self.flat, self.begins = 1, [], []

    def __missing__(self, word: str | bytes) -> int:
        s = letters_of(word if isinstance(word, str) else word.decode("utf-8", "surrogatepass"))
        if not s or not any(map(str.isalpha, s)):
            self[word] = 0
            return 0
        self.begins.append(len(self.flat))
        self.flat += [k for f in features_of(s) if (k := self.get_feature(f)) is not None]
        row = self[word] = self.n
        self.n += 1
        return row

    def settled(self) -> np.ndarray:
        """The rows of all words so far."""
        if self.n > len(self.rows):
            grown = np.zeros((max(self.n, 2 * len(self.rows)), self.rows.shape[1]))
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        if self.begins:
            owner = np.repeat(np.arange(len(self.begins)), np.diff([*self.begins, len(self.flat)]))
            first = self.n - len(self.begins)
            flat = np.array(self.flat, dtype=np.int64)
            for k in range(self.rows.shape[1]):
                self.rows[first : self.n, k] = np.bincount(owner, weights=self.w[flat, k], minlength=len(self.begins))
            self.flat, self.begins = [], []
        return self.rows


_memory: dict[str, Words] = {}


def remembered(model: dict) -> Words:
    """This worker's words of the model, forgotten when they are too many."""
    words = _memory.get(model["key"])
    if words is None or len(words) > CACHE_WORDS:
        _memory.clear()
        words = _memory[model["key"]] = Words(model)
    return words


def label_lines(model: dict, lines: list[list[str]], words: Words | None = None) -> list[np.ndarray]:
    """For each line (a list of words) the words' probabilities of the languages."""
    words = Words(model) if words is None else words
    ids = [np.array([words[w] for w in line], dtype=np.int64) for line in lines]
    out = [np.zeros((0, len(model["langs"])))] * len(lines)
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    for block in chains(lengths):
        padded = np.zeros((len(block), lengths[block[0]]), dtype=np.int64)
        for r, c in enumerate(block):
            padded[r, : lengths[c]] = ids[c]
        chain = Chain(words.settled()[padded], lengths[block], model["s"], model["t"])
        for r, c in enumerate(block):
            out[c] = chain.post[r, : lengths[c]]
    return out


def _text_scores(model: dict, words: Words, texts: list[str | None]) -> np.ndarray:
    """Summed probabilities of each text's words with a letter; a text may span several batches."""
    total = np.zeros((len(texts), len(model["langs"])))
    ids, owner, held = [], [], 0

    def flush():
        rows = words.settled()
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        for block in chains(lengths):
            t_max = lengths[block[0]]
            padded = np.zeros((len(block), t_max), dtype=np.int64)
            for r, c in enumerate(block):
                padded[r, : lengths[c]] = ids[c]
            chain = Chain(rows[padded], lengths[block], model["s"], model["t"])
            post = chain.post * (padded > 0)[:, :, None]  # padding is row 0, as are words without a letter
            np.add.at(total, np.array(owner)[block], post.sum(axis=1))

    for k, text in enumerate(texts):
        # Splitting of bytes concerns the six ASCII white-space characters alone.
        for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
            found = line.split()
            if found:
                ids.append(list(map(words.__getitem__, found)))
                owner.append(k)
                held += len(found)
        if held >= BATCH_WORDS:
            flush()
            ids, owner, held = [], [], 0
    if ids:
        flush()
    return total


def _chosen(rows: DataFrame, sizes: dict[str, int], most: int, *key: str) -> list:
    """The `most` rows of each language with the least hash of the key. sizes: rows by language.

    Each task hands on what lies below a bound of the hash that twice as many rows are expected under;
    these come to the driver, which cuts them to the number.
    """
    at = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)
    bounds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2.0 * most + 50) / n))])
    found = rows.withColumn("__at", at).where(F.col("__at") <= bounds[F.col("lang")]).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["__at"], *[r[k] for k in key])):
        by_lang.setdefault(r["lang"], []).append(r)
    return [r for own in by_lang.values() for r in own[:most]]


def training_lines(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> list[tuple[str, str]]:
    """The bounded sample: (line, language)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))
    usable = docs.where(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = lambda rows: {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # noqa: E731 - a row for each language
    there = sizes(usable)
    if not there:
        return []
    few = sorted({r["doc_id"] for r in _chosen(usable.select("doc_id", "lang"), there, train_docs, "doc_id")})  # at most train_docs for each language
    few = docs.sparkSession.createDataFrame([(x,) for x in few], "__id long")
    lines = usable.join(F.broadcast(few), F.col("doc_id") == F.col("__id"), "left_semi")
    lines = lines.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where(F.col("line") != "")
    there = sizes(lines)
    return sorted((r["line"], r["lang"]) for r in _chosen(lines, there, train_lines, "doc_id", "pos")) if there else []


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, probabilities (array, in the order of the model's languages) of every row."""
    langs = model["langs"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if langs:
                total = _text_scores(model, remembered(model), texts)
            else:
                total = np.zeros((len(texts), 1))
            mass = total.sum(axis=1)
            share = total / np.where(mass > 0, mass, 1)[:, None]
            best = share.argmax(axis=1)
            pred = [langs[k] if m > 0 else UNKNOWN for k, m in zip(best, mass)]
            score = np.clip(share.max(axis=1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(list(share), pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "probabilities"],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))
    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, probabilities array<double>"
    )


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(training_lines(docs))).select("doc_id", "held_out", "lang_pred", "score")
