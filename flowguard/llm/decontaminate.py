"""Benchmark decontamination: test phrases are searched in an FM-index of every shard of the training documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import carried
from flowguard.llm.fmindex import FMIndex

WINDOW = 13
#: Bytes of benchmark text that are searched at once; a larger benchmark is searched in as many blocks as it needs.
BLOCK_BYTES = 4 << 20
#: Symbols of one shard's index. A single document may exceed it.
SHARD_SYMBOLS = 1 << 20
#: A-Z in lower case; other ASCII bytes that belong to no word become spaces.
_WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS_ONLY).split()


@dataclass
class Phrases:
    """Windows of one block of the benchmark: codes of words, windows by length, and the items of each window."""
    codes: dict[bytes, int]
    windows: list[np.ndarray]
    owners: list[list[list[str]]]
    shortest: int


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """Every run of `window` words of an item; the whole item where it is shorter but not empty."""
    codes: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for name, text in items:
        words = [codes.setdefault(w, len(codes) + 1) for w in words_of(text)]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(words[i:i + n]), set()).add(name)
    lengths = sorted(found)
    return Phrases(codes, [np.array(list(found[n]), np.int64).reshape(-1, n) for n in lengths],
                   [[sorted(o) for o in found[n].values()] for n in lengths], lengths[0] if lengths else 0)


def _kept_runs(codes: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of words known to the benchmark that are long enough to hold a phrase; no occurrence lies elsewhere."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


class Shard:
    """Collects documents and answers, for each, the words hit and the items found."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.owner, self.start, self.symbols = phrases, [], [], [], 0

    def add(self, doc: int, words: list[bytes]) -> None:
        known = self.phrases.codes.get
        codes = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        for start, end in _kept_runs(codes, self.phrases.shortest):
            self.parts += [codes[start:end], np.zeros(1, np.int64)]
            self.owner.append(doc)
            self.start.append(start)
            self.symbols += end - start + 1

    def search(self) -> tuple[dict[int, list[np.ndarray]], dict[int, set[str]]]:
        """Per document with an occurrence: word intervals, and names of items."""
        spans: dict[int, list[np.ndarray]] = {}
        items: dict[int, set[str]] = {}
        if not self.parts:
            return spans, items
        text = np.concatenate(self.parts)
        begins = np.concatenate(([0], np.cumsum([len(p) for p in self.parts])[1::2]))[:-1]
        index = FMIndex(text)
        for windows, owners in zip(self.phrases.windows, self.phrases.owners, strict=True):
            which, low, high = index.search(windows)
            if not len(which):
                continue
            many = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            place, phrase = index.locate(rows), np.repeat(which, many)
            run = np.searchsorted(begins, place, side="right") - 1
            at = place - begins[run] + np.array(self.start)[run]
            doc = np.array(self.owner)[run]
            for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
                items.setdefault(d, set()).update(owners[p])
            order = np.argsort(doc, kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                spans.setdefault(int(doc[piece[0]]), []).append(np.stack([at[piece], at[piece] + windows.shape[1]], 1))
        return spans, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open intervals."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack([spans[fresh, 0], reach[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(spans) - 1]))]], 1)


def _search_batch(phrases: Phrases, words: list[list[bytes]], spans: list, items: list) -> None:
    shard = Shard(phrases)
    for i, found in enumerate(words):
        shard.add(i, found)
        if shard.symbols >= SHARD_SYMBOLS or i == len(words) - 1:
            for d, pieces in (answer := shard.search())[0].items():
                spans[d] = merged(np.concatenate([np.array(spans[d], np.int64).reshape(-1, 2), *pieces])).tolist()
                items[d] = sorted({*items[d], *answer[1][d]})
            shard = Shard(phrases)


def _offsets(text: str, spans: list) -> list[dict]:
    """Code points of word intervals."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))] if spans else []
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in spans]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`carry` columns with `n_words`, `n_hit`, `items` (sorted names) and `spans` (code points, merged) for every row.

    A word is hit where any window of any item occurs around it. Every Arrow batch of documents is one or more shards:
    its words are coded by the benchmark's vocabulary, unknown words end a run, and an FM-index over the runs long
    enough to hold a phrase answers all phrases by backward search; occurrences are located by sampled suffix positions.
    No row leaves its partition. The benchmark is read in blocks of a measured size, which are broadcast one by one.

    Null texts have no words. A null item id is named `null`; items of one id count once. Items without a word are
    ignored. Repeated rows get equal answers; an empty table, or an empty benchmark, gives no hits.
    """
    made = ["n_words", "n_hit", "items", "spans"]
    rows, at, carry, head = carried(docs, text, carry, made)
    questions = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("words"))
    total = questions.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found, width, state = rows, len(carry), ["__hits array<array<bigint>>", "__items array<string>"]
    kept_text = [] if text in carry else ["__text string"]
    for block in range(blocks):
        chosen = questions.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(phrases_of(list(zip(chosen["item"].to_pylist(), chosen["words"].to_pylist(), strict=True)), window))
        last = block == blocks - 1

        def search(batches: Iterator[pa.RecordBatch], shared=shared, block=block, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                words = [words_of(t) for t in texts]
                hits = batch.column("__hits").to_pylist() if block else [[] for _ in texts]
                items = batch.column("__items").to_pylist() if block else [[] for _ in texts]
                if shared.value.windows:
                    _search_batch(shared.value, words, hits, items)
                kept, names = [batch.column(i) for i in range(width)], list(carry)
                if last:
                    counts = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(b - a for a, b in h) for h in hits], pa.int64()),
                              pa.array(items, pa.list_(pa.string())),
                              pa.array([_offsets(t or "", h) for t, h in zip(texts, hits, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                    yield pa.RecordBatch.from_arrays([*kept, *counts], names=[*names, *made])
                else:
                    kept += [batch.column(at)] * len(kept_text)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                                                     names=[*names, *["__text"] * len(kept_text), "__hits", "__items"])
        tail = ["n_words bigint", "n_hit bigint", "items array<string>", "spans array<struct<start:int,end:int>>"] if last else [*kept_text, *state]
        found = found.mapInArrow(search, ", ".join([*head, *tail]))
    return found


def contaminated(n_words, n_hit):
    """At least one word hit, and at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
