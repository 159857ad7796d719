"""Encoding with a public byte-level BPE vocabulary through a minimal acyclic transducer of frequent words.

The corpus is counted once; its most frequent words are compiled, with their token ids as outputs, into a minimal
acyclic transducer (a numbered shared-suffix automaton whose edges carry additive outputs), stored as flat arrays in
the shared folder and memory-mapped by every worker. Words it doesn't hold are merged exactly by the vocabulary's
ranks, so the ids are those of the tokenizer for every text, whatever the lexicon.

Defined results: null and empty texts have no ids (an empty list); strings of special tokens are ordinary text; texts
of any length are encoded whole; rows are encoded one by one, so repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch, spread, stored

#: Where the public tokenizer files lie, and the one used here.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words the transducer holds, and the longest of them in bytes.
LEXICON_WORDS = 100_000
LEXICON_BYTES = 48
#: The vocabulary's rule for cutting texts into words (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_WORDS = regex.compile(PATTERN)


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _merger(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})._core_bpe


def merge(word: bytes, path: str) -> list[int]:
    """Ids of one word by exact merging of its bytes along the vocabulary's ranks."""
    r = _ranks(path).get(word)
    return [r] if r is not None else _merger(path).encode_single_piece(word)


def words(text: str) -> list[str]:
    return _WORDS.findall(text)


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer of sorted unique words: incremental construction with a register of states.

    ``keys`` are ``state << 8 | byte`` in order, ``target`` and ``add`` the state reached and the additive output of
    each edge, ``final`` the states in which a word ends; the sum of a word's outputs is its number, under which
    ``start`` and ``ids`` hold its token ids.
    """
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    path: list[int] = [0]
    last = b""

    def freeze(keep: int) -> None:
        for depth in range(len(path) - 1, keep, -1):
            state, parent, byte = path[depth], path[depth - 1], last[depth - 1]
            same = register.setdefault((final[state], *sorted(edges[state].items())), state)
            edges[parent][byte] = same
            path.pop()

    for word, _ in entries:
        common = os.path.commonprefix([word, last])
        freeze(len(common))
        for byte in word[len(common) :]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)
    count: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in edges[s].values() if t not in count]
        if todo:
            stack += todo
            continue
        stack.pop()
        count[s] = final[s] + sum(count[t] for t in edges[s].values())
    number = {s: i for i, s in enumerate(sorted(count, key=lambda x: x != 0))}
    rows = []
    for s, i in number.items():
        before = int(final[s])
        for byte in sorted(edges[s]):
            rows.append((i << 8 | byte, number[edges[s][byte]], before))
            before += count[edges[s][byte]]
    rows.sort()
    keys, target, add = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    ends = np.zeros(len(number), np.int8)
    for s, i in number.items():
        ends[i] = final[s]
    sizes = np.array([len(ids) for _, ids in entries], np.int64)
    return {
        "keys": keys, "target": target.astype(np.int32), "add": add.astype(np.int32), "final": ends,
        "start": np.concatenate([[0], np.cumsum(sizes)]), "ids": np.array([x for _, ids in entries for x in ids], np.int32),
    }


class Lexicon:
    """The compiled transducer, memory-mapped from one file of concatenated arrays."""

    NAMES = ("keys", "target", "add", "final", "start", "ids")

    def __init__(self, data: str | bytes):
        if isinstance(data, str):
            data = np.memmap(data, np.uint8, "r")
        n = int.from_bytes(bytes(data[:8]), "little")
        base = 8 + n
        for name, part in zip(self.NAMES, bytes(data[8:base]).decode().split(";"), strict=True):
            dtype, count, at = part.split(",")
            setattr(self, name, np.frombuffer(data, dtype, int(count), base + int(at)) if int(count) else np.empty(0, dtype))

    @classmethod
    def pack(cls, arrays: dict[str, np.ndarray]) -> bytes:
        head, body = [], b""
        for name in cls.NAMES:
            a = np.ascontiguousarray(arrays[name])
            head.append(f"{a.dtype.str},{a.size},{len(body)}")
            body += a.tobytes() + b"\0" * (-a.nbytes % 8)
        text = ";".join(head).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + body

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, or -1: all words walk the transducer together, a byte at a time."""
        out = np.full(len(found), -1, np.int64)
        if not found or not len(self.keys):
            return out
        size = np.array([len(w) for w in found])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        data = np.frombuffer(b"".join(found), np.uint8)
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        state, total = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for d in range(LEXICON_BYTES):
            if not len(live):
                break
            key = state[live] << 8 | data[at[live] + d]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            live, edge = live[ok], edge[ok]
            total[live] += self.add[edge]
            state[live] = self.target[edge]
            done = size[live] == d + 1
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = total[ended]
            live = live[~done]
        return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for b in batches:
        for t in b["text"].dropna():
            seen.update(words(t))
        if len(seen) > 300_000:
            yield _counted(seen)
            seen.clear()
    yield _counted(seen)


def _counted(seen: Counter) -> pd.DataFrame:
    rows = [(w, n) for w, n in seen.items() if len(w.encode("utf-8", "replace")) <= LEXICON_BYTES]
    return pd.DataFrame(rows, columns=["word", "n"]).astype({"word": object, "n": "int64"})


def build_lexicon(texts: DataFrame, vocabulary: str | None = None, size: int = LEXICON_WORDS) -> str:
    """Count the words of all texts, compile the ``size`` most frequent and store the transducer; returns its path."""
    spark = texts.sparkSession
    vocabulary = vocabulary or f"{TOKENIZERS}/{VOCABULARY}"
    counts = stored(spark, spread(texts.select("text")).mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    # the count that leaves at most ``size`` words, from a histogram of eighths of powers of two: no sort, and no more
    # than the lexicon itself reaches the driver
    step = F.floor(F.log2("n") * 8)
    left, least = size, None
    for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("words")).orderBy(F.desc("b")).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["b"]
    top = [] if least is None else counts.where(step >= least).select("word").toPandas()["word"]
    entries = sorted({w.encode(): merge(w.encode(), vocabulary) for w in top}.items())
    path = scratch(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file)
    out.write(bytearray(Lexicon.pack(compile_lexicon(entries))))
    out.close()
    return path


_OPEN: dict[str, Lexicon] = {}


def _lexicon(path: str, data: bytes | None) -> Lexicon:
    """The worker's view of the lexicon: a memory map of the shared file, or the bytes sent where the shared folder is
    no file system of the machine."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Lexicon(path if data is None else data)
    return _OPEN[path]


class Encoder:
    """Encodes batches of texts: each distinct word of a batch goes through the transducer once."""

    def __init__(self, lexicon: Lexicon, vocabulary: str):
        self.lexicon, self.vocabulary = lexicon, vocabulary

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the texts, as of a list array."""
        known: dict[str, int] = {}
        spots, sizes = [], []
        for t in texts:
            found = words(t) if t else []
            sizes.append(len(found))
            spots += [known.setdefault(w, len(known)) for w in found]
        each = [w.encode("utf-8", "replace") for w in known]
        number = self.lexicon.numbers(each)
        missing = np.flatnonzero(number < 0)
        merged = [merge(each[i], self.vocabulary) for i in missing]
        start, length = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
        held = number >= 0
        start[held] = self.lexicon.start[number[held]]
        length[held] = self.lexicon.start[number[held] + 1] - start[held]
        sizes_m = np.array([len(m) for m in merged], np.int64)
        base = len(self.lexicon.ids)
        start[missing] = base + np.concatenate([[0], np.cumsum(sizes_m)[:-1]]) if len(missing) else 0
        length[missing] = sizes_m
        pool = np.concatenate([self.lexicon.ids, np.array([x for m in merged for x in m], np.int32)])
        spot = np.array(spots, np.int64)
        n = length[spot]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(start[spot] - (ends - n), n) + np.arange(total)]
        at = np.concatenate([[0], ends])
        return at[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)], ids


def _encoder(spark: SparkSession, lexicon: str, vocabulary: str):
    local = lexicon.removeprefix("file://") if lexicon.startswith(("file://", "/")) else None
    if local:
        return lambda: Encoder(_lexicon(local, None), vocabulary)
    data = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(lexicon).head()["content"]))
    return lambda: Encoder(_lexicon(lexicon, data.value), vocabulary)


#: Characters that are encoded at a time, so that a task's memory doesn't depend on the size of its batches.
CHUNK_CHARS = 1_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def encode(documents: DataFrame, lexicon: str, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, ids)``."""
    make = _encoder(documents.sparkSession, lexicon, vocabulary or f"{TOKENIZERS}/{VOCABULARY}")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _chunks(texts):
                at, ids = enc.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(step, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, lexicon: str, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, tokens)``."""
    make = _encoder(documents.sparkSession, lexicon, vocabulary or f"{TOKENIZERS}/{VOCABULARY}")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _chunks(texts):
                at, _ = enc.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(np.diff(at), pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(step, "doc_id long, tokens long")
