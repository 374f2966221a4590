"""Encoding a whole corpus with a public byte-level BPE by merge replay.

Each task takes the texts of its partition in blocks of about
``BLOCK_CHARS`` code points, whatever their number. It cuts a block into words
by the vocabulary's pattern, keeps each different word once, and replays the merges on all
those words together: an inverted index maps each pair of neighbouring tokens to
the positions where it stands, the pairs present leave a heap in rank order, and
a merge touches only its positions and their two neighbours. No text crosses the
network and nothing is shuffled, so the plan is one scan at any size (an input
of fewer splits than cores is dealt out first), and a a third of the rows is only more blocks.

Words that later blocks bring again come from a cache of bounded size (clearing
it costs time, not results).

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; other columns are carried along unread.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.plans.parallel import deal_out

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that cuts text before the merges. White space is Unicode's White_Space, so the controls 1c to 1f are not part of it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+".replace("WS", SPACE)
BLOCK_CHARS = 2_000_000
CACHE_WORDS = 400_000


class Vocabulary:
    """Merges and ids of a byte-level BPE file."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids, merges = model["vocab"], model["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.bytes = [ids[signs[b]] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: (left id, right id) as one number -> rank; the rank's id.
        self.rank = {ids[a] << 20 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.result = [ids[a + b] for a, b in pairs]
        self.pair = [ids[a] << 20 | ids[b] for a, b in pairs]
        self.find = regex.compile(PATTERN).findall


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """The vocabulary that was shipped with the job under this name."""
    return Vocabulary(SparkFiles.get(name))


def ship(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary file along with the job, once for each context; its name on the workers."""
    context = spark.sparkContext
    sent = getattr(context, "claimlens_files", {})
    if path not in sent:
        if Path(path).name in map(os.path.basename, sent):
            raise ValueError(f"another vocabulary is called {Path(path).name}")
        context.addFile(path)
        context.claimlens_files = sent | {path: Path(path).name}
    return Path(path).name


def replay(words: list[str], vocab: Vocabulary) -> list[list[int]]:
    """Token ids of each word, all merges replayed over all words at once.

    Positions of all words lie in one list with a gap of -1 between words, so
    neighbours are found by two link lists and no pair spans two words.
    """
    token: list[int] = []
    starts = []
    of_byte = vocab.bytes
    for word in words:
        starts.append(len(token))
        token += [of_byte[b] for b in word.encode("utf-8")]
        token.append(-1)
    size = len(token)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    index: dict[int, list[int]] = {}
    rank = vocab.rank
    flat = np.array(token, dtype=np.int64)
    keys = (flat[:-1] << 20) | flat[1:]
    inner = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
    order = inner[np.argsort(keys[inner], kind="stable")]
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        if (r := rank.get(int(keys[part[0]]))) is not None:
            index[r] = part.tolist()
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        new, key = vocab.result[r], vocab.pair[r]
        left, right = key >> 20, key & 0xFFFFF
        places = index.pop(r)
        places.sort()
        for i in places:
            if token[i] != left:
                continue
            j = after[i]
            if token[j] != right:
                continue
            # merge j into i; only the neighbours' pairs change
            token[i], token[j] = new, -2
            k = after[i] = after[j]
            before[k] = i
            if token[k] >= 0 and (x := rank.get(new << 20 | token[k])) is not None:
                if x in index:
                    index[x].append(i)
                else:
                    index[x] = [i]
                    heapq.heappush(heap, x)
            h = before[i]
            if h >= 0 and token[h] >= 0 and (x := rank.get(token[h] << 20 | new)) is not None:
                if x in index:
                    index[x].append(h)
                else:
                    index[x] = [h]
                    heapq.heappush(heap, x)
    ends = [*starts[1:], size]
    return [[t for t in token[a:b] if t >= 0] for a, b in zip(starts, ends, strict=True)]


def encode_texts(texts: list[str | None], vocab: Vocabulary, cache: dict[str, list[int]]) -> list[list[int]]:
    """Ids of each text of one block."""
    cut = [vocab.find(x) if x else [] for x in texts]
    fresh = list({w for words in cut for w in words if w not in cache})
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = list({w for words in cut for w in words})
    cache.update(zip(fresh, replay(fresh, vocab), strict=True))
    return [[i for w in words for i in cache[w]] for words in cut]


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about ``most`` code points each."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def list_array(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY, sizes_only: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the token ids of ``text``, or with their number."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    carried = [f"c{i}" for i in range(len(kept))]
    kinds = [docs.schema[c].dataType.simpleString() for c in kept]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, carried, strict=True)], F.col(f"`{text}`").alias("the_text"))

    name = ship(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = vocabulary(name), {}
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            for start, end in blocks(texts):
                ids = encode_texts(texts[start:end], vocab, cache)
                made = pa.array([len(x) for x in ids], pa.int64()) if sizes_only else list_array(ids)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(len(carried))), made], names=[*carried, "the_ids"])

    schema = ", ".join(f"{n} {k}" for n, k in zip(carried, kinds, strict=True)) + (", " if carried else "") + ("the_ids long" if sizes_only else "the_ids array<int>")
    done = deal_out(rows).mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for c, n in zip(kept, carried, strict=True)], F.col("the_ids").alias(out))
