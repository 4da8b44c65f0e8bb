"""BPE encoding and decoding with a word-end vocabulary.

Text is cut at the added tokens, normalised (NFC, white-space runs to one space, lower case) and
split into letter runs, single digits, symbol runs and English contractions; each piece's UTF-8
bytes become the vocabulary's byte characters, the last one with the word-end mark. Merging keeps
the symbols in a doubly linked list and the possible merges in a priority queue by rank, then
position; queue entries whose symbols have changed since are skipped. Decoding concatenates the
vocabulary strings of the ids, with a space between, as a vocabulary without a decoder asks for.

Words are merged once and remembered per Python worker, in two generations of bounded size, so that
memory doesn't grow with the corpus. Whole texts are encoded. The vocabulary file is a parameter;
the driver reads it once and its tables travel with the task.

Defined results: null counts as an empty text; an empty text has no ids and decodes to an empty
text; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditloom.llm.common import bounded_batches

#: Words kept in each of the two generations of a worker's memory.
CACHE_WORDS = 150_000


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding needs from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"],
        "pattern": split["pattern"]["Regex"],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers; merges what it doesn't know."""

    def __init__(self, spec: dict, limit: int = CACHE_WORDS):
        super().__init__()
        vocab, suffix = spec["vocab"], spec["suffix"]
        self.limit, self.old = limit, {}
        chars = _byte_chars()
        self.inner = [vocab.get(c) for c in chars]
        self.last = [vocab.get(c + suffix) for c in chars]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("I", self.merge(word.encode("utf-8"))).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def merge(self, data: bytes) -> list[int]:
        inner = self.inner
        ids = [inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        n, merges, push, pop = len(ids), self.merges, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for k in range(n - 1):
            found = merges.get((ids[k], ids[k + 1]))
            if found:
                queue.append((found[0], k, ids[k], ids[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, left, right, new = pop(queue)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour was merged meanwhile
            ids[k], ids[j] = new, -1
            nxt = after[k] = after[j]
            if nxt < n:
                before[nxt] = k
                found = merges.get((new, ids[nxt]))
                if found:
                    push(queue, (found[0], k, new, ids[nxt], found[1]))
            prev = before[k]
            if prev >= 0:
                found = merges.get((ids[prev], new))
                if found:
                    push(queue, (found[0], prev, ids[prev], new, found[1]))
        return [i for i in ids if i >= 0]


class Codec:
    def __init__(self, spec: dict):
        self.words = Words(spec)
        self.find = regex.compile(spec["pattern"].replace(r"\s", r"\p{White_Space}")).findall
        self.space = regex.compile(r"\p{White_Space}+")
        self.added = spec["added"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.strings = [""] * (max([*spec["vocab"].values(), *self.added.values()]) + 1)
        for s, i in [*spec["vocab"].items(), *self.added.items()]:
            self.strings[i] = s

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by character, no final sigma
        text = self.space.sub(" ", text).lower()
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<" not in text or not self.cut.search(text):
            return self._plain(text)
        return b"".join(
            self.added[part].to_bytes(4, "little") if part in self.added else self._plain(part) for part in self.cut.split(text) if part
        )

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, array("I", ids)))


_codecs: dict = {}


def codec_for(spec: dict) -> Codec:
    """One codec for each vocabulary and worker."""
    key = (len(spec["vocab"]), len(spec["merges"]), hash(tuple(spec["merges"][-50:])), spec["pattern"])
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text; on demand ids (array of int) and the decoded text too."""
    spec = load(path)
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {"ids": "array<int>"} if keep_ids else {}
    kinds |= {"decoded": "string"} if keep_decoded else {}

    def run(batches):
        codec = codec_for(spec)
        for batch in batches:
            encoded = [codec.encode(text or "") for text in batch.column("text").to_pylist()]
            lengths = [len(ids) // 4 for ids in encoded]
            digests, plain = [], []
            for ids in encoded:
                decoded = codec.decode(ids)
                digests.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep_decoded:
                    plain.append(decoded)
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()), pa.array(digests, pa.string())]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"))))
            if keep_decoded:
                columns.append(pa.array(plain, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *kinds])

    bounded_batches(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{k} {v}" for k, v in kinds.items()]]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), keep_ids=False)
