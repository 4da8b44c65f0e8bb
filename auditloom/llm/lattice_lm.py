"""Language-model scores: marginal probability over all segmentations of a subword lattice.

Model. A text is a sequence of words, each written with the vocabulary's word-start mark, and one
end piece. Every way to cut a word into vocabulary pieces is a path through its lattice; the weight
of a path is the product of its pieces' unigram probabilities, and the word's probability is the sum
over all paths, by a forward recursion in log space. A character that is no piece of its own is
spelled by the vocabulary's byte pieces. Pieces never cross words, so the text's log probability is
the sum over its words and the end.

Weights. The vocabulary is an existing one and is not changed; its scores, which rank the pieces,
give the prior 1 / (rank + 1). The prior weights the lattices of the training words once; expected
piece counts, by forward and backward recursion, times the words' training counts, plus the prior
with `PRIOR_MASS` pseudo-counts, give the probabilities that score.

Plan. Each task counts its words and the counts meet by word, so that the shuffle carries a row for
each distinct word and task. Each distinct word is scored once. The most frequent words, at most
`SHIPPED_WORDS` of them and `SHIPPED_BYTES`, travel to the tasks that read the texts; every other
word of a document is joined to its score by word, and sums come back by document. Texts are never
shuffled.

Defined results: a null or blank text has the end only; a null doc_id is never held out; repeated
rows count each; with no training documents all counts are 0; a word of any length is scored whole,
in memory for two numbers a character; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import bounded_batches, spark_broadcast, stored

HELD_OUT_OF, HELD_OUT = 7, 2
#: The end's key among the words; no word is empty.
END = ""
_END = END.encode()
PRIOR_MASS = 10_000.0
#: Bounds of what travels to every task: words, and bytes of them all.
SHIPPED_WORDS = 500_000
SHIPPED_BYTES = 16_000_000
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 400_000
#: Longest word, with the mark, whose lattice is worked out together with others of its length.
BATCH_CHARS = 32
BATCH_WORDS = 4096
#: Words, and characters of them, that a task takes up before it works them out.
GATHERED_WORDS = 50_000
GATHERED_CHARS = 2_000_000

_LOG10 = math.log(10)
#: How a piece's hash grows, and where it is kept.
_GROW = np.uint64(0x9E3779B97F4A7C15)
_PLACE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BITS = 20
_SHIFT = np.uint64(64 - _BITS)


def words_of_text(text: str | None) -> list[bytes]:
    """The words in UTF-8. Lower case and splitting of bytes concern A-Z and the six ASCII white-space characters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Lattice:
    """Pieces with natural-log weights. spec: mark, end, pieces (piece -> id), bytes (id of each byte piece)."""

    def __init__(self, spec: dict, weights):
        self.mark, self.ids, self.bytes, self.end = spec["mark"], spec["pieces"], spec["bytes"], spec["end"]
        self.weights = [float(x) for x in weights]
        self.longest = max(map(len, self.ids), default=1)
        self.table = None

    def find(self, letters: np.ndarray, pairs: dict[tuple[int, int], int]) -> np.ndarray:
        """For texts of one length (a row of code points each) the piece ids of letters [i, j), in the row pairs[i, j]; no piece: the number of weights.

        Pieces are told by a 64-bit hash that grows letter by letter, kept in two tables: those whose
        place is taken in the first are in the second.
        """
        if self.table is None:
            self.table = self._tables()
        (hash_1, id_1), (hash_2, id_2) = self.table
        none = np.int32(len(self.weights))
        codes = letters.T.astype(np.uint64) + np.uint64(1)
        out = np.empty((len(pairs), letters.shape[0]), dtype=np.int32)
        for i in range(len(codes)):
            h = np.zeros(letters.shape[0], dtype=np.uint64)
            for j in range(i + 1, min(len(codes), i + self.longest) + 1):
                h = h * _GROW + codes[j - 1]
                one, two = (h * _PLACE[0]) >> _SHIFT, (h * _PLACE[1]) >> _SHIFT
                out[pairs[i, j]] = np.where(hash_1[one] == h, id_1[one], np.where(hash_2[two] == h, id_2[two], none))
        return out

    def _tables(self):
        none = len(self.weights)
        tables = [(np.zeros(1 << _BITS, dtype=np.uint64), np.full(1 << _BITS, none, dtype=np.int32)) for _ in _PLACE]
        for piece, k in self.ids.items():
            h = 0
            for c in piece:
                h = (h * int(_GROW) + ord(c) + 1) % (1 << 64)
            for (hashes, ids), factor in zip(tables, _PLACE):
                at = (h * int(factor) % (1 << 64)) >> (64 - _BITS)
                if ids[at] == none:
                    hashes[at], ids[at] = h, k
                    break
            else:
                raise ValueError("pieces of this vocabulary share places in both tables")
        return tables

    def _arriving(self, text: str, j: int):
        """Edges that end before position j: start, piece ids, log weight; found anew each time, so none are kept."""
        ids, weights = self.ids, self.weights
        for i in range(max(0, j - self.longest), j):
            k = ids.get(text[i:j])
            if k is not None:
                yield i, (k,), weights[k]
        if text[j - 1] not in ids:
            spelled = tuple(self.bytes[b] for b in text[j - 1].encode("utf-8", "surrogatepass"))
            yield j - 1, spelled, sum(weights[k] for k in spelled)

    @staticmethod
    def _sum(logs: list[float]) -> float:
        if len(logs) <= 1:
            return logs[0] if logs else -math.inf
        top = max(logs)
        return top + math.log(sum([math.exp(x - top) for x in logs])) if top > -math.inf else top

    def log_prob(self, word: str) -> float:
        """Forward recursion over a ring of the last positions that a piece can reach back to."""
        text, size = self.mark + word, self.longest + 1
        ring = [0.0] * size
        for j in range(1, len(text) + 1):
            ring[j % size] = self._sum([ring[i % size] + w for i, _, w in self._arriving(text, j)])
        return ring[len(text) % size]

    def expect(self, word: str, count: float, into: np.ndarray) -> None:
        """Add the expected uses of each piece in `count` copies of the word; two numbers for each position are held."""
        text = self.mark + word
        n = len(text)
        alpha, beta = array("d", [0.0]), array("d", [-math.inf]) * (n + 1)
        for j in range(1, n + 1):
            alpha.append(self._sum([alpha[i] + w for i, _, w in self._arriving(text, j)]))
        beta[n] = 0.0
        for j in range(n, 0, -1):
            for i, pieces, w in self._arriving(text, j):
                x = w + beta[j]
                beta[i] = self._sum([beta[i], x])
                share = math.exp(alpha[i] + x - alpha[n]) * count
                for k in pieces:
                    into[k] += share


def _batched(lattice: Lattice, words: list[str], counts=None, into: np.ndarray | None = None) -> np.ndarray:
    """Natural-log probability of each word; with counts, expected piece uses are added to `into`.

    Words of a length share the shape of their lattices, so the recursions run over all of them at
    once. Long words and words with spelled characters go one by one.
    """
    logs = np.full(len(words), -np.inf)
    weights, none = np.append(lattice.weights, -np.inf), len(lattice.weights)
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_length.setdefault(len(word) + len(lattice.mark), []).append(k)
    for n, members in by_length.items():
        if n > BATCH_CHARS:
            continue
        pairs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - lattice.longest), j)]
        starts, ends = np.array(pairs).T
        place = {pair: k for k, pair in enumerate(pairs)}
        for at in range(0, len(members), BATCH_WORDS):
            own = np.array(members[at : at + BATCH_WORDS])
            texts = [lattice.mark + words[k] for k in own]
            ids = lattice.find(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(own), n), place)
            w = weights[ids]
            alpha = np.full((n + 1, len(own)), -np.inf)
            alpha[0] = 0.0
            for j in range(1, n + 1):
                edges = np.flatnonzero(ends == j)
                alpha[j] = np.logaddexp.reduce(alpha[starts[edges]] + w[edges], axis=0)
            logs[own] = alpha[n]
            if counts is None:
                continue
            beta = np.full((n + 1, len(own)), -np.inf)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                edges = np.flatnonzero(starts == i)
                beta[i] = np.logaddexp.reduce(beta[ends[edges]] + w[edges], axis=0)
            sure = np.isfinite(alpha[n])
            share = np.exp(alpha[starts][:, sure] + w[:, sure] + beta[ends][:, sure] - alpha[n][sure]) * counts[own][sure]
            into += np.bincount(ids[:, sure].ravel(), weights=share.ravel(), minlength=none + 1)[:none]
    for k in np.flatnonzero(~np.isfinite(logs)):
        logs[k] = lattice.log_prob(words[k])
        if counts is not None:
            lattice.expect(words[k], float(counts[k]), into)
    return logs


def load_vocabulary(path: str) -> tuple[dict, np.ndarray]:
    """The pieces of a sentencepiece model and the prior (natural log) that their scores give."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    usable = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    byte_ids = {model.id_to_piece(k): k for k in usable if model.is_byte(k)}
    own = [k for k in usable if not model.is_byte(k) and model.get_score(k) > -1e8]
    rank = np.full(n, np.inf)
    rank[own] = [-model.get_score(k) for k in own]
    rank[list(byte_ids.values())] = n
    rank[model.eos_id()] = n
    prior = 1.0 / (rank + 1.0)
    spec = {
        "mark": "▁", "end": model.eos_id(), "pieces": {model.id_to_piece(k): k for k in own},
        "bytes": [byte_ids[f"<0x{b:02X}>"] for b in range(256)],
    }
    with np.errstate(divide="ignore"):
        return spec, np.log(prior / prior.sum())


def _task_counts(docs: DataFrame) -> DataFrame:
    """word, n (uses in training documents), uses (in all), counted within tasks; the end included."""

    def rows(train: Counter, other: Counter):
        words = list(train.keys() | other.keys())
        n = np.fromiter((train[w] for w in words), dtype=np.int64, count=len(words))
        return pd.DataFrame({"word": [w.decode() for w in words], "n": n, "uses": n + np.fromiter((other[w] for w in words), dtype=np.int64, count=len(words))})

    def run(frames):
        train, other = Counter(), Counter()
        for frame in frames:
            for text, held_out in zip(frame["text"], frame["held_out"]):
                (other if held_out else train).update([*words_of_text(text), _END])
                if len(train) + len(other) > TASK_WORDS:
                    yield rows(train, other)
                    train, other = Counter(), Counter()
        if train or other:
            yield rows(train, other)

    return docs.select("text", "held_out").mapInPandas(run, "word string, n long, uses long")


def _gathered(frames):
    """Frames of more words, so that many of a length are worked out together; bounded in words and characters."""
    held, rows, letters = [], 0, 0
    for frame in frames:
        held.append(frame)
        rows, letters = rows + len(frame), letters + int(frame["word"].str.len().sum())
        if rows >= GATHERED_WORDS or letters >= GATHERED_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, rows, letters = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _frequent(table: DataFrame, most: int, size: int) -> DataFrame:
    """The words used at least so often, by a quarter of a power of two, that they are no more than `most` and `size` bytes."""
    level = F.floor(4 * F.log2(F.col("uses").cast("double"))).cast("int")
    levels = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes"))
    n, used, least = 0, 0, 256
    for row in sorted(levels.collect(), key=lambda r: -r["level"]):  # at most 256 rows
        n, used = n + row["n"], used + row["bytes"]
        if n > most or used > size:
            break
        least = row["level"]
    return table.where(level >= least)


def score_documents(docs: DataFrame, path: str, prior_mass: float = PRIOR_MASS, shipped_words: int = SHIPPED_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) of every row."""
    bounded_batches(docs)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False)))
    counts = stored(_task_counts(docs).groupBy("word").agg(F.sum("n").alias("c"), F.sum("uses").alias("uses")))
    total, distinct = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = total or 0, distinct or 0
    spec, prior = load_vocabulary(path)
    size = len(prior)

    def expected(frames):
        lattice, into = Lattice(spec, prior), np.zeros(size)
        for frame in _gathered(frames):
            ends = (frame["word"] == END).to_numpy()
            into[spec["end"]] += frame["c"].to_numpy()[ends].sum()
            words = frame[~ends]
            _batched(lattice, words["word"].tolist(), words["c"].to_numpy(dtype=float), into)
        used = np.flatnonzero(into)
        yield pd.DataFrame({"piece": used, "uses": into[used]})

    pieces = counts.where(F.col("c") > 0).select("word", "c").mapInPandas(expected, "piece long, uses double")
    learned = np.exp(prior) * prior_mass
    for row in pieces.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # at most the vocabulary's pieces
        learned[row["piece"]] += row["uses"]
    with np.errstate(divide="ignore"):
        weights = np.log(learned / learned.sum())
    end_log = float(weights[spec["end"]]) / _LOG10

    def scored(frames):
        lattice = Lattice(spec, weights)
        for frame in _gathered(frames):
            lp = _batched(lattice, frame["word"].tolist()) / _LOG10
            lp[(frame["word"] == END).to_numpy()] = end_log
            base = np.log10((frame["c"].to_numpy() + 1) / (total + distinct + 1))
            yield pd.DataFrame({"word": frame["word"], "known": (frame["c"] > 0).astype("int64"), "base": base, "lp": lp, "uses": frame["uses"]})

    table = stored(counts.mapInPandas(scored, "word string, known long, base double, lp double, uses long"))
    near = _frequent(table, shipped_words, SHIPPED_BYTES).select("word", "known", "base", "lp").toArrow()  # at most `shipped_words` rows
    shipped = spark_broadcast(docs, (near.column("word").to_pylist(), *[near.column(c).to_numpy() for c in ("known", "base", "lp")]))

    def partial(frames):
        """A row for each document with what the shipped words give (`word` starts with a space, as no word does), and one for each other word it has."""
        words, known, base, lp = shipped.value
        at = {w.encode(): k for k, w in enumerate(words)}
        known, base, lp = np.append(known, 0), np.append(base, 0.0), np.append(lp, 0.0)
        none, find = len(words), at.get
        for frame in frames:
            out = {k: [] for k in ("doc_id", "text_hash", "held_out", "word", "n", "n_known", "base", "lp")}

            def put(*row, out=out):
                for k, x in zip(out, row):
                    out[k].append(x)

            for doc_id, text, held_out in zip(frame["doc_id"], frame["text"], frame["held_out"]):
                own = [*words_of_text(text), _END]
                k = np.array(list(map(find, own, repeat(none))))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                text_hash = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                put(doc_id, text_hash, held_out, f" {text_hash}", len(own), int(known[k].sum()), float(base[k].sum()), float(lp[k].sum()))
                for w, n in Counter(own[i] for i in np.flatnonzero(k == none)).items():
                    put(doc_id, text_hash, held_out, w.decode(), n, 0, 0.0, 0.0)
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    parts = docs.mapInPandas(partial, "doc_id long, text_hash long, held_out boolean, word string, n long, n_known long, base double, lp double")
    scores = table.select("word", F.col("known").alias("w_known"), F.col("base").alias("w_base"), F.col("lp").alias("w_lp"))
    whole = F.col("word").startswith(" ")
    # A document's own row joins nothing; its key spreads those rows. Rows that repeat a document add up together, and `rows` divides them again.
    sums = (
        parts.join(scores, "word", "left")
        .groupBy("doc_id", "text_hash", "held_out")
        .agg(
            F.count_if(whole).alias("rows"),
            F.sum(F.when(whole, F.col("n"))).alias("n"),
            F.sum(F.coalesce(F.col("n") * F.col("w_known"), F.col("n_known"))).alias("known"),
            F.sum(F.coalesce(F.col("n") * F.col("w_base"), F.col("base"))).alias("base"),
            F.sum(F.coalesce(F.col("n") * F.col("w_lp"), F.col("lp"))).alias("lp"),
        )
    )
    each = lambda c: (F.col(c) / F.col("rows"))
    return sums.select(
        "doc_id", "held_out", each("n").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("lp").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__copy"),
    ).drop("__copy")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_lattice_lm(spark, sf_dir):
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
