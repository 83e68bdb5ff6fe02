"""One large JSON document read by many tasks (SRC-09, SRC-10): its entries, whatever the line breaks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What can change the state of a scan: quotes, escaped characters, brackets and the sign behind a name.
_TOKEN = re.compile(r'\\.|["{}\[\]:]')


class Scan:
    """Where a scan of a document stands: inside a string or not, how deep, and the last name seen at each depth."""

    def __init__(self, inside: bool = False, depth: int = 0, names: dict[int, str] | None = None):
        self.inside, self.depth, self.names = inside, depth, dict(names or {})
        self.said, self.word = "", ""

    def read(self, piece: str) -> Iterator[tuple[int, int]]:
        """Scans text between two commas; gives (place, depth) after every bracket outside strings."""
        start = 0
        for m in _TOKEN.finditer(piece):
            sign = m.group()
            if self.inside:
                if sign == '"':
                    self.word, self.inside = self.said + piece[start:m.start()], False
            elif sign == '"':
                self.inside, self.said, start = True, "", m.end()
            elif sign == ":":
                self.names[self.depth] = self.word
            elif sign in "{[":
                self.depth += 1
                yield m.end(), self.depth
            elif sign in "}]":
                self.depth -= 1
                yield m.end(), self.depth
        if self.inside:
            self.said += piece[start:] + ","


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Pieces of text between commas by (file, block), in order."""
    held: tuple[str, int] | None = None
    pieces: list[str] = []
    for batch in batches:
        for file, start, piece in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (file, start) != held:
                if held is not None:
                    yield held, pieces
                held, pieces = (file, start), []
            pieces.append(piece)
    if held is not None:
        yield held, pieces


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block does to a scan, both if it begins inside a string and if not."""
    for (file, start), pieces in _blocks(batches):
        for inside in (False, True):
            scan = Scan(inside)
            for piece in pieces:
                for _ in scan.read(piece):
                    pass
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "inside": [inside], "ends_inside": [scan.inside], "deeper": [scan.depth], "names": [json.dumps(scan.names)]})


def _entries(states: dict[tuple[str, int], tuple[bool, int, dict[int, str]]]):
    """Entries of the document's members; the pieces of one that crosses blocks are numbered by the block it began in."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), pieces in _blocks(batches):
            scan = Scan(*states[file, start])
            out: list[tuple[str | None, str, bool, bool]] = []
            text, begun = "", scan.depth < 2 or (scan.depth == 2 and not scan.inside)  # whether the entry being read began in this block

            def finish(member: str | None) -> None:
                nonlocal text, begun
                if text.strip() or not begun:
                    out.append((member, text, not begun, False))
                text, begun = "", True

            for piece in pieces:
                at = 0
                for place, depth in scan.read(piece):
                    if depth == 1 and piece[place - 1] in "}]":
                        text += piece[at:place - 1]
                        finish(scan.names.get(1))
                        at = place
                    elif depth < 2 or (depth == 2 and piece[place - 1] in "{["):  # nothing before the bracket that opens a member
                        at = place
                if scan.depth >= 2:
                    text += piece[at:]
                    if scan.depth == 2 and not scan.inside:
                        finish(scan.names.get(1))
                    else:
                        text += ","
            if scan.depth >= 2 and (text or not begun):
                out.append((scan.names.get(1), text, not begun, True))
            if out:
                yield pa.RecordBatch.from_pydict({"file": [file] * len(out), "start": [start] * len(out), "number": list(range(len(out))), "member": [o[0] for o in out],
                                                  "text": [o[1] for o in out], "goes_on": [o[2] for o in out], "open": [o[3] for o in out]})
    return cut


def _stitch(rows: pa.Table) -> pa.Table:
    """Pieces of one file's entries that cross blocks, at most two per block, joined in order."""
    parts = sorted(rows.to_pylist(), key=lambda r: (r["start"], r["number"]))
    found: list[list] = []
    for r in parts:
        if r["goes_on"] and found:
            found[-1][1] += r["text"]
            found[-1][0] = found[-1][0] or r["member"]
        else:
            found.append([r["member"], r["text"]])
    kept = [(m, t) for m, t in found if t.strip()]
    return pa.table({"member": pa.array([m for m, _ in kept], pa.string()), "text": pa.array([t for _, t in kept], pa.string())})


def entries(spark: SparkSession, path: str) -> DataFrame:
    """`member` and `text` of every entry of the arrays and objects that are members of a JSON document, or of one per file.

    The text of an array's entry is its value, of an object's its name, a colon and the value. The document is cut at commas
    by Spark's reader, range by range. A first job finds what each range does to a scan, whether it begins inside a string
    or not; the ranges' few summaries in turn tell each range where it begins, and a second job cuts out the entries. Only the
    pieces of entries that cross ranges meet, per file.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    pieces = spark.read.option("lineSep", ",").text(path).select(*meta, "value")
    told = pieces.mapInArrow(_summaries, "file string, start bigint, inside boolean, ends_inside boolean, deeper bigint, names string").collect()  # two rows per range
    states: dict[tuple[str, int], tuple[bool, int, dict[int, str]]] = {}
    for file in sorted({r["file"] for r in told}):
        inside, depth, names = False, 0, {}
        by_start = {(r["start"], r["inside"]): r for r in told if r["file"] == file}
        for start in sorted({s for s, _ in by_start}):
            states[file, start] = (inside, depth, dict(names))
            r = by_start[start, inside]
            names |= {depth + int(k): v for k, v in json.loads(r["names"]).items()}
            inside, depth = r["ends_inside"], depth + r["deeper"]
    found = pieces.mapInArrow(_entries(states), "file string, start bigint, number bigint, member string, text string, goes_on boolean, open boolean")
    crossing = F.col("goes_on") | F.col("open")
    joined = found.where(crossing).groupBy("file").applyInArrow(_stitch, "member string, text string")
    return found.where(~crossing).select("member", "text").unionByName(joined)
