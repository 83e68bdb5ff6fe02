"""Removal of repeated passages: lines, sentences and sampled runs of words are hashed, and all but the earliest occurrence is cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import cut_lineage

#: Repeated units are removed where so many words of them follow each other, or where they fill a line of so many words.
RUN_WORDS, LINE_WORDS = 25, 8
#: Words of an anchor, and neighbouring starts of which one at least is an anchor: any 50 words in a row hold a whole anchor.
ANCHOR_WORDS, ANCHOR_WINDOW = 25, 26
#: Anchors are numbered by their first word, above all numbers of units.
ANCHORS_FROM = 1 << 30
_STOP = re.compile(r"[.!?]+\s+")
_WORD = re.compile(r"\w+")


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(line, start, end, normalised) of every sentence of every line; one without a word is left out.

    Sentences end at line breaks and after stops followed by white space. Normalised: lower case, words only, one space.
    """
    found, at = [], 0
    for number, line in enumerate(text.split("\n")):
        start = 0
        for end in [*(m.end() for m in _STOP.finditer(line)), len(line)]:
            words = _WORD.findall(line[start:end].lower())
            if words:
                piece = line[start:end]
                left = len(piece) - len(piece.lstrip())
                found.append((number, at + start + left, at + start + len(piece.rstrip()), " ".join(words)))
            start = end
        at += len(line) + 1
    return found


def removals(found: list[tuple[int, int, int, str]], repeated: set[int], run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> list[tuple[int, int]]:
    """Spans to cut (code points, end exclusive) from a text of these units, given the numbers of those that occur earlier elsewhere."""
    words = [u[3].count(" ") + 1 for u in found]
    whole: dict[int, list[int]] = {}
    for i, u in enumerate(found):
        whole.setdefault(u[0], []).append(i)
    cut: set[int] = set()
    for members in whole.values():
        if all(i in repeated for i in members) and sum(words[i] for i in members) >= line_words:
            cut.update(members)
    run: list[int] = []
    for i in range(len(found) + 1):
        if i in repeated:
            run.append(i)
            continue
        if sum(words[j] for j in run) >= run_words:
            cut.update(run)
        run = []
    spans: list[tuple[int, int]] = []
    last = -2
    for i in sorted(cut):
        if i == last + 1:
            spans[-1] = (spans[-1][0], found[i][2])
        else:
            spans.append((found[i][1], found[i][2]))
        last = i
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and the white space after each."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        rest = text[end:]
        at = end + len(rest) - len(rest.lstrip())
    return "".join([*kept, text[at:]]) if spans else text


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is part of a word, whether it is white space, and a random number that ignores case."""
    every = "".join(map(chr, range(0x110000)))
    word, space = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for m in re.finditer(r"\w+", every):
        word[m.start():m.end()] = True
    for m in re.finditer(r"\s+", every):
        space[m.start():m.end()] = True
    lower = np.arange(0x110000, dtype=np.uint64)
    for at in np.flatnonzero(word):
        small = chr(at).lower()
        if len(small) == 1:
            lower[at] = ord(small)
    return word, space, _mixed(lower + np.uint64(1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span, the same wherever the span stands."""
    powers = np.full(len(values) + 1, _STEP, np.uint64)
    back = np.full(len(values) + 1, _BACK, np.uint64)
    powers[0] = back[0] = 1
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.cumprod(powers)[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts] + (ends - starts).astype(np.uint64))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (code points) and hash (64 bits, case ignored) of every word, and the code points of the text."""
    word, _, numbers = _letters()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = word[codes]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, ends, _span_hashes(numbers[codes], starts, ends), codes


def anchors(hashes: np.ndarray, size: int = ANCHOR_WORDS, window: int = ANCHOR_WINDOW) -> list[int]:
    """First words of the anchors of a text: of every `window` neighbouring runs of `size` words, one of the least hash.

    Which hash is the least depends on these words only, so texts that share size + window - 1 words share an anchor.
    """
    n = len(hashes) - size + 1
    if n < 1:
        return []
    starts = np.arange(n)
    runs = _span_hashes(hashes, starts, starts + size)
    window = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(runs, window)
    last = np.arange(n - window + 1) + window - 1 - view[:, ::-1].argmin(axis=1)
    found = np.unique(last)
    near = (np.diff(found) < window) & (runs[found[1:]] == runs[found[:-1]])
    if not near.any():
        return found.tolist()
    kept = [int(last[0])]  # a text that repeats itself: an anchor serves as long as it lies in the window and is the least
    for i, at in enumerate(last.tolist()):
        if kept[-1] < i or runs[at] != runs[kept[-1]]:
            kept.append(at)
    return kept


def surroundings(hashes: np.ndarray, at: int, size: int = ANCHOR_WORDS, window: int = ANCHOR_WINDOW) -> tuple[bytes, bytes]:
    """Hashes (32 bits) of the words before an anchor, nearest first, and after it, as far as no other anchor need lie between."""
    low = hashes.astype(np.uint32)
    return low[max(0, at - window):at][::-1].tobytes(), low[at + size:at + size + window].tobytes()


def _common(a: bytes, b: bytes) -> int:
    """Words in which two surroundings agree from the anchor on."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n))
    return int(differ[0]) if len(differ) else n


def passages(text: str, marks: list[tuple[int, bytes, bytes]], size: int = ANCHOR_WORDS) -> list[tuple[int, int]]:
    """Spans to cut for repeated anchors, given by first word and the surroundings of their earliest occurrence.

    Each reaches as far as its words agree with the earliest occurrence, and over the punctuation that follows the last.
    """
    starts, ends, hashes, codes = words_of(text)
    word, space, _ = _letters()
    spans: list[tuple[int, int]] = []
    reached = -1
    for at, before, after in sorted(marks):
        mine = surroundings(hashes, at, size)
        first, last = at - _common(mine[0], before), at + size - 1 + _common(mine[1], after)
        end = int(ends[last])
        while end < len(codes) and not word[codes[end]] and not space[codes[end]]:
            end += 1
        if spans and first <= reached + 1:
            spans[-1] = (min(spans[-1][0], int(starts[first])), max(spans[-1][1], end))
        else:
            spans.append((int(starts[first]), end))
        reached = max(reached, last)
    return spans


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that cover what either covers."""
    spans: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    return spans


def _digests(docs: DataFrame, text: str, identity: str, anchored: bool) -> DataFrame:
    """`id`, `body` (hash of the text), `unit` (number) and `digest` (128 bits) of every unit, and of every anchor if `anchored`."""
    rows = docs.select(F.col(identity).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).where("text is not null")
    kind = docs.schema[identity].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, value = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                found = [xxhash.xxh3_128_digest(u[3]) for u in units(t)]
                owner += [i] * len(found)
                number += range(len(found))
                value += found
                if anchored:
                    hashes = words_of(t)[2]
                    places = anchors(hashes)
                    owner += [i] * len(places)
                    number += [ANCHORS_FROM + p for p in places]
                    value += [xxhash.xxh3_128_digest(hashes[p:p + ANCHOR_WORDS].tobytes()) for p in places]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(value, pa.binary())],
                                             names=["id", "body", "unit", "digest"])
    return rows.mapInArrow(digest, f"id {kind}, body bigint, unit int, digest binary")


def _surroundings(docs: DataFrame, text: str, identity: str, firsts: DataFrame) -> DataFrame:
    """`digest`, `before` and `after` of the earliest occurrences of anchors."""
    wanted = firsts.where(F.col("first.unit") >= ANCHORS_FROM).groupBy(F.col("first.id").alias("__id"), F.col("first.body").alias("__body")).agg(
        F.collect_list(F.struct((F.col("first.unit") - ANCHORS_FROM).alias("at"), "digest")).alias("places"))
    rows = docs.select(F.col(identity).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).where("text is not null")
    held = rows.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body"))).select("text", "places")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = words_of(t)[2]
                out += [(p["digest"], *surroundings(hashes, p["at"])) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in range(3)], names=["digest", "before", "after"])
    # Rows that agree in identity and text are one document, and tell the same.
    return held.mapInArrow(look, "digest binary, before binary, after binary").dropDuplicates(["digest"])


def remove_repeats(docs: DataFrame, text: str = "text", identity: str = "doc_id", run_words: int = RUN_WORDS, line_words: int = LINE_WORDS,
                   anchored: bool = False) -> DataFrame:
    """Every row of `docs` with its text cut, and `n_units`, `n_repeated`, `n_removed_chars` and `removed` (spans in the original text).

    Units are ranked by identity (nulls last), then by their place. The digest of a unit is counted over all documents;
    where it occurs more than once, all occurrences but the earliest are repeats. Repeats are cut where they fill a line
    of at least `line_words` words, or where at least `run_words` words of them follow each other, so that a short
    sentence that two writers share by chance stays.

    With `anchored`, passages are found by their words alone too, wherever their ends lie: sampled runs of 25 words (the
    anchors) are ranked and counted like units, every repeated one is cut, and each cut is extended to the true ends of
    what agrees with the earliest occurrence. Any 50 words in a row hold an anchor, so no 50 words that stand earlier stay
    whole. A word is only cut where the same words stand earlier, so the earliest occurrence always stays.

    A digest is first reduced to its count and earliest place, so a line that a third of all documents share is one row
    before anything is joined; only repeated digests are joined back, by a join whose hot keys Spark splits. Null texts
    stay null and have no units. Rows that agree in identity and text are one document. Empty tables give empty results;
    columns of the added names are replaced.
    """
    docs = docs.drop("n_units", "n_repeated", "n_removed_chars", "removed")
    found = _digests(docs, text, identity, anchored)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "body", "unit")
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a digest is hot.
    firsts = cut_lineage(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    extra = [F.lit(None).cast("binary").alias(c) for c in ("before", "after")]
    if anchored:
        firsts = cut_lineage(firsts.join(_surroundings(docs, text, identity, firsts), "digest", "left"))
        extra = [F.col("before"), F.col("after")]
    later = found.join(firsts, "digest").where(~place.eqNullSafe(F.col("first")))
    unit = F.struct(F.col("unit"), *extra)
    marked = later.groupBy("id", "body").agg(F.collect_set(unit).alias("__units")).withColumnsRenamed({"id": "__id", "body": "__body"})
    rows = docs.withColumn("__hash", F.xxhash64(F.col(text)))
    same = F.col(identity).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body"))
    joined = rows.join(marked, same, "left").select(*docs.columns, "__units")
    at, last = docs.columns.index(text), len(docs.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + ["n_units int, n_repeated int, n_removed_chars int, removed array<struct<start:int,end:int>>"])
    names = [*docs.columns, "n_units", "n_repeated", "n_removed_chars", "removed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_marks = batch.column(at).to_pylist(), batch.column(last).to_pylist()
            found = [units(t) if t else [] for t in texts]
            marks = [{m["unit"] for m in all_of or () if m["unit"] < ANCHORS_FROM} for all_of in all_marks]
            runs = [[(m["unit"] - ANCHORS_FROM, m["before"], m["after"]) for m in all_of or () if m["unit"] >= ANCHORS_FROM] for all_of in all_marks]
            spans = [removals(u, m, run_words, line_words) if m else [] for u, m in zip(found, marks, strict=True)]
            spans = [union(s, passages(t, r)) if r else s for t, s, r in zip(texts, spans, runs, strict=True)]
            left = [t if t is None else without(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = [batch.column(i) for i in range(last)]
            columns[at] = pa.array(left, pa.string())
            columns += [pa.array([len(u) for u in found], pa.int32()), pa.array(list(map(len, marks)), pa.int32()),
                        pa.array([0 if t is None else len(t) - len(x) for t, x in zip(texts, left, strict=True)], pa.int32()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return joined.mapInArrow(cut, schema)
