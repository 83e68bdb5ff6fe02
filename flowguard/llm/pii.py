"""Personal data: four plain kinds by pattern, and the terms that give them away by what the corpus tells about them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Documents in which an entity and a term must meet to be weighed as they are; fewer are made up by documents without the entity.
SUPPORT = 2
#: Share of an entity's information that a term may reveal before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Slots of the filter that spares counting words which stand near no entity. A fixed size; joins decide, not the filter.
FILTER_SLOTS = 1 << 20
#: Most frequent terms, and entities, whose counts each task knows; pairs that these show to be far from telling are not written.
FREQUENT = 1 << 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
#: What every text with an entity contains, as a pattern that Spark runs: an email's @, an address's dots, 16 digits of a card, a phone's +.
MAY_HOLD = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){15}|\+[0-9]"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part is the whole run before an @, so each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        elif start < at:
            free = start
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost non-overlapping matches of each kind, failing ones dropped."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def _entity(text: str, kind: str, start: int, end: int) -> str:
    """One name for all spellings of a value."""
    value = text[start:end]
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def _words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside the spans."""
    inside = sorted((a, b) for _, a, b in spans)
    words, k = [], 0
    for m in _WORD.finditer(text):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and m.start() < b for a, b in inside[k:k + 4]):
            words.append((m[0].lower(), m.start(), m.end()))
    return words


def contexts(text: str, near: int | None = None) -> list[tuple[str, str]]:
    """Distinct (entity, term) for the words of the text, or `near` words on either side of each entity; words inside an entity are none."""
    spans = base_spans(text)
    if not spans:
        return []
    words = _words(text, spans)
    if near is None:
        terms = dict.fromkeys(w[0] for w in words)
        return [(name, term) for name in dict.fromkeys(_entity(text, *s) for s in spans) for term in terms]
    starts = [w[1] for w in words]
    found: dict[tuple[str, str], None] = {}
    for kind, a, b in spans:
        at = int(np.searchsorted(starts, a))
        name = _entity(text, kind, a, b)
        found.update(dict.fromkeys((name, w[0]) for w in words[max(0, at - near):at + near]))
    return list(found)


def _occurrences(docs: DataFrame, text: str, identity: str, near: int | None, rare: tuple[DataFrame, DataFrame, float] | None = None) -> DataFrame:
    """`id`, `body`, `entity` and `term`: the pairs that meet in a document.

    With `rare` (counts of entities and of terms, threshold), pairs whose share must be lower are left out. A share of s
    needs n_te / n_t >= (n_e / n)^(1 - s), and n_te is n_e at most: no term in more than n_e^s n^(1 - s) documents can
    reach it. Counts of the most frequent of both are known to each task; what is not among them is not left out.
    """
    kind = docs.schema[identity].dataType.simpleString()
    rows = docs.select(F.col(identity).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).where("text is not null")
    known, share, n = None, 0.0, 0
    if rare:
        tops = [dict(map(tuple, c.orderBy(F.desc(f"n_{k}"), k).limit(FREQUENT).collect())) for c, k in zip(rare[:2], ("entity", "term"), strict=True)]
        known, share, n = docs.sparkSession.sparkContext.broadcast(tops), rare[2], docs.count()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, terms = known.value if known else ({}, {})
        unlisted = min(entities.values()) if len(entities) >= FREQUENT else 1
        for batch in batches:
            owner, out = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                met = contexts(t, near)
                if known:
                    most = {e: entities.get(e, unlisted) ** share * n ** (1 - share) * (1 + 1e-9) for e in {e for e, _ in met}}
                    met = [(e, w) for e, w in met if terms.get(w, 0) <= most[e]]
                out += met
                owner += [i] * len(met)
            at = pa.array(owner, pa.int64())
            columns = [pa.array([o[i] for o in out], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["id", "body", "entity", "term"])
    return rows.mapInArrow(look, f"id {kind}, body bigint, entity string, term string")


def _entity_counts(docs: DataFrame, text: str) -> DataFrame:
    """`entity` and `n_entity`, the documents that hold it."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update({_entity(t, *s) for s in base_spans(t)})
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["entity", "n"])
    return docs.select(text).mapInArrow(look, "entity string, n bigint").groupBy("entity").agg(F.sum("n").alias("n_entity"))


def _slot(term: str) -> int:
    return xxhash.xxh32_intdigest(term) % FILTER_SLOTS


def _term_counts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """`term` and `n_term`, the documents that hold it, for all wanted terms (and those that share a filter slot)."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = sorted({_slot(t) for t in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32())], names=["slot"])
    used = wanted.select("term").mapInArrow(number, "slot int").distinct().toArrow()  # at most FILTER_SLOTS numbers
    bits = np.zeros(FILTER_SLOTS, bool)
    bits[used["slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value)
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(set(_WORD.findall(t.lower())))
            kept = [(w, n) for w, n in counts.items() if keep[_slot(w)]]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["term", "n"])
    return docs.select(text).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def _terms_of_holders(docs: DataFrame, text: str) -> DataFrame:
    """`term`: the words of documents that hold an entity, each at least once."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for t in batch.column(0).to_pylist():
                if t and base_spans(t):
                    found.update(_WORD.findall(t.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["term"])
    return docs.select(text).mapInArrow(look, "term string")


def disclosures(docs: DataFrame, occurrences: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE,
                counts: tuple[DataFrame, DataFrame] | None = None, smooth: bool = False) -> DataFrame:
    """`entity`, `term` and `share` for the terms that reveal too much.

    With n documents, an entity in n_e of them has log2(n / n_e) bits; a term in n_t documents, with the entity in n_te,
    reveals log2(n n_te / (n_t n_e)) of them. Their quotient is the share. Counts cover all documents. Pairs that meet
    in fewer than `support` documents say nothing; with `smooth`, they count as if the term also stood in as many
    documents without the entity as they lack, so that an entity of a single document has terms too.
    """
    pairs = occurrences.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    pairs = cut_lineage(pairs if smooth else pairs.where(F.col("n_pair") >= support))
    n = F.lit(float(docs.count()))
    # Written, so that both sides of the joins are plain exchanges, which Spark can split where an entity or a term is hot.
    entities, terms = counts or (cut_lineage(_entity_counts(docs, text)), cut_lineage(_term_counts(docs, text, pairs)))
    counted = pairs.join(entities, "entity").join(terms, "term")
    bits = F.log2(n / F.col("n_entity"))
    lacking = F.greatest(F.lit(support) - F.col("n_pair"), F.lit(0))
    share = F.when(bits > 0, F.log2(n * F.col("n_pair") / ((F.col("n_term") + lacking) * F.col("n_entity"))) / bits)
    return counted.select("entity", "term", F.least(share, F.lit(1.0)).alias("share")).where(F.col("share") >= threshold)


def detect(docs: DataFrame, text: str = "text", identity: str = "doc_id", near: int | None = None, support: int = SUPPORT,
           threshold: float = GENERALISE) -> DataFrame:
    """Every row of `docs` with `base` and `added`: arrays of (kind, start, end, share) in code points.

    `base` lists emails, addresses, cards and phones by pattern; `added` every occurrence of the terms (kind `term`) that
    reveal at least `threshold` of the information of an entity of the document, with the share. Terms of whole documents
    are weighed, or those within `near` words. Whole texts are read; null and empty texts have no spans. Terms are joined
    by entity and term, never gathered per entity, so a value that a third of all documents hold is no hot group. Texts
    that cannot hold an entity have no terms and stay where they lie; only the others are moved to meet theirs. Rows
    that agree in identity and text get equal spans; empty tables give empty results; columns named `base` or `added` are
    replaced.
    """
    docs = docs.drop("base", "added")
    counts = cut_lineage(_entity_counts(docs, text)), cut_lineage(_term_counts(docs, text, _terms_of_holders(docs, text)))
    met = cut_lineage(_occurrences(docs, text, identity, near, (*counts, threshold) if 0 <= threshold <= 1 else None))
    telling = cut_lineage(disclosures(docs, met, text, support, threshold, counts, smooth=True))
    added = (met.join(telling, ["entity", "term"]).groupBy("id", "body", "term").agg(F.max("share").alias("share"))
             .groupBy("id", "body").agg(F.collect_list(F.struct("term", "share")).alias("__terms")).withColumnsRenamed({"id": "__id", "body": "__body"}))
    may = F.coalesce(F.col(text).rlike(MAY_HOLD), F.lit(False))
    rows = docs.where(may).withColumn("__hash", F.xxhash64(F.col(text)))
    same = F.col(identity).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__body"))
    joined = rows.join(added, same, "left").select(*docs.columns, "__terms")
    joined = joined.unionByName(docs.where(~may).withColumn("__terms", F.lit(None).cast(added.schema["__terms"].dataType)))
    at, last, names = docs.columns.index(text), len(docs.columns), [*docs.columns, "base", "added"]
    spans = "array<struct<kind:string,start:int,end:int,share:double>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"base {spans}", f"added {spans}"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
        for batch in batches:
            base, more = [], []
            for t, given in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                found = base_spans(t)
                shares = {g["term"]: g["share"] for g in given or ()}
                base.append([{"kind": k, "start": a, "end": b, "share": 1.0} for k, a, b in found])
                more.append([{"kind": "term", "start": a, "end": b, "share": shares[w]} for w, a, b in _words(t, found) if w in shares] if shares else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.array(base, kind), pa.array(more, kind)], names=names)
    return joined.mapInArrow(match, schema)


def sanitise(found: DataFrame, text: str = "text", remove: float = REMOVE) -> DataFrame:
    """Adds `clean` to the rows of `detect`: entities become their kind in brackets, telling terms a word class or nothing.

    Terms that reveal at least `remove` of an entity are removed, others generalised to `[number]` or `[word]`. Of
    overlapping spans the first, and of those the longest, holds.
    """
    a, b, c = (found.columns.index(x) for x in (text, "base", "added"))
    names = [*found.columns, "clean"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields] + ["clean string"])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (a, b, c)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_masked(*r, remove) for r in rows], pa.string())], names=names)
    return found.mapInArrow(mask, schema)


def _masked(text: str | None, base: list[dict], added: list[dict], remove: float) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in sorted([*base, *added], key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            continue
        word = text[s["start"]:s["end"]]
        mark = f"[{s['kind']}]" if s["kind"] != "term" else "" if s["share"] >= remove else "[number]" if word.isdigit() else "[word]"
        out += [text[at:s["start"]], mark]
        at = s["end"]
    return "".join([*out, text[at:]])
