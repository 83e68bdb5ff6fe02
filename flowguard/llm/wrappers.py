"""Main text of pages through union-free wrappers that are inferred per host by aligning its pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import plain_names, small_join
from flowguard.llm.markup import ARTICLE_WORDS, ASIDE_NAMES, ASIDE_WORDS, Element, parse
from flowguard.llm.urls import host_and_path
from flowguard.session import cut_lineage

#: Elements that are the article by name.
ARTICLE_NAMES = frozenset({"article"})
#: Elements that hold the page or the article; a word of their classes (has-sidebar, comments-open) makes them no aside.
FRAME_NAMES = frozenset("html body main article".split())
#: Elements of running text, which are parts of an article and never the whole of it.
PART_NAMES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr td th blockquote pre figure figcaption address hr".split())
#: Wrappers that one task aligns at once.
FAN = 64
#: Pairs of nodes that an alignment weighs; what lies between the common ends of longer ones becomes optional unweighed.
MOST_PAIRS = 1 << 18
MARKS = ("+", "?", "*")

# A wrapper is nested lists: ["#"] a text slot; ["e", signature, [..]] an element; ["+", [..]] a repeated, ["?", [..]] an optional
# and ["*", [..]] an optional repeated group.


def is_aside(element: Element, nested: bool = False) -> bool:
    """By name or by a word of its labels; a frame by such a word only if `nested` in an article, as reader comments are."""
    if element.name in ASIDE_NAMES:
        return True
    return (nested or element.name not in FRAME_NAMES) and not ASIDE_WORDS.isdisjoint(element.labels)


def _key(node: list) -> str:
    """What a node must share with another to be aligned with it."""
    return node[0] if node[0] == "#" else f"e{node[1]}" if node[0] == "e" else _key(node[1][0]) if len(node[1]) == 1 else "(" + "|".join(map(_key, node[1])) + ")"


def _bare(node: list) -> list[list]:
    return node[1] if node[0] in MARKS else [node]


def _mark(many: bool, optional: bool) -> str:
    return ("*" if optional else "+") if many else "?"


def _optional(node: list) -> list:
    return [_mark(node[0] != "?", True), node[1]] if node[0] in MARKS else ["?", [node]]


def fold(nodes: list[list], longest: int = 4) -> list[list]:
    """Replace neighbouring groups of up to `longest` nodes that align with each other by one repeated group."""
    span = 1
    while span <= longest:
        out: list[list] = []
        i = 0
        while i < len(nodes):
            group = nodes[i:i + span]
            keys = [_key(n) for n in group]
            j, many = i + span, group
            while len(group) == span and [_key(n) for n in nodes[j:j + span]] == keys and "#" not in keys[:1]:
                many = [align_one(a, b) for a, b in zip(many, nodes[j:j + span], strict=True)]
                j += span
            if j > i + span:
                out.append([_mark(True, all(n[0] in "?*" for n in many)), [b for n in many for b in _bare(n)]])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        span += 1
    return nodes


def shape(element: Element) -> list[list]:
    """The children of an element as wrapper nodes, repeated ones folded."""
    nodes: list[list] = []
    for child in element.children:
        if isinstance(child, Element):
            nodes.append(["e", child.signature, shape(child)])
        elif child.strip():
            nodes.append(["#"])
    return fold(nodes)


def align_one(a: list, b: list) -> list:
    """Generalisation of two nodes of one key: repeated or optional if either is, contents aligned."""
    if a[0] in MARKS or b[0] in MARKS:
        return [_mark(a[0] in "+*" or b[0] in "+*", a[0] in "?*" or b[0] in "?*"), align(_bare(a), _bare(b))]
    return a if a[0] == "#" else ["e", a[1], align(a[2], b[2])]


def align(a: list[list], b: list[list]) -> list[list]:
    """Match two token streams by a longest common subsequence of keys; what only one has becomes an optional group."""
    if a == b:
        return a
    ka, kb = [_key(n) for n in a], [_key(n) for n in b]
    head = 0
    while head < min(len(a), len(b)) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    out = [align_one(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    out += _align_middle(a[head:len(a) - tail], b[head:len(b) - tail])
    out += [align_one(x, y) for x, y in zip(a[len(a) - tail:], b[len(b) - tail:], strict=True)]
    return fold(out)


def _align_middle(a: list[list], b: list[list]) -> list[list]:
    if not a or not b or len(a) * len(b) > MOST_PAIRS:
        return [_optional(n) for n in [*a, *b]]
    ka, kb = [_key(n) for n in a], [_key(n) for n in b]
    lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            lengths[i][j] = lengths[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(lengths[i + 1][j], lengths[i][j + 1])
    out: list[list] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(align_one(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= len(b) or i < len(a) and lengths[i + 1][j] >= lengths[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return out


def expression(nodes: list[list]) -> str:
    """The wrapper as a union-free regular expression over tags and text slots (#)."""
    parts = []
    for n in nodes:
        if n[0] == "#":
            parts.append("#")
        elif n[0] == "e":
            parts.append(f"<{n[1]}>{expression(n[2])}</{n[1].split('.')[0]}>")
        else:
            parts.append(f"({expression(n[1])}){n[0]}")
    return "".join(parts)


def _paths(nodes: list[list], above: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """Paths of signatures of all elements of a wrapper."""
    for n in nodes:
        if n[0] == "e":
            yield (*above, n[1])
            yield from _paths(n[2], (*above, n[1]))
        elif n[0] != "#":
            yield from _paths(n[1], above)


def _element(signature: str) -> Element:
    name, *labels = signature.split(".")
    return Element(name, tuple(labels))


def _clear(nodes: list[list]) -> list[tuple[tuple[str, ...], Element]]:
    """Paths that lead through no aside, with their last elements."""
    found = []
    for path in _paths(nodes):
        elements = [_element(s) for s in path]
        if not any(is_aside(e, any(above.name in ARTICLE_NAMES for above in elements[:i])) for i, e in enumerate(elements)):
            found.append((path, elements[-1]))
    return found


def _named(clear: list[tuple[tuple[str, ...], Element]]) -> list[list[str]]:
    """Paths of the elements named `article`, then `main`, then those whose id or class says so; outermost only."""
    tiers = []
    for fits in (lambda e: e.name in ARTICLE_NAMES, lambda e: e.name == "main" or "main" in e.labels, lambda e: not ARTICLE_WORDS.isdisjoint(e.labels)):
        found = {path for path, e in clear if fits(e)}
        outer = sorted(">".join(p) for p in found if not any(p[:k] in found for k in range(1, len(p))))
        if outer:
            tiers.append(outer)
    return tiers


def article_tiers(nodes: list[list], masses: dict[str, int]) -> list[list[str]]:
    """Paths of the elements that hold the article, joined by `>`, none inside an aside; a page takes the first tier that gives it a text.

    Elements that name or label marks come first. For pages without such marks follows the deepest container that holds
    at least three fifths of the text outside asides, over all such pages of the host (`masses`), and the whole page last.
    """
    clear = _clear(nodes)
    tiers = _named(clear)
    names = {">".join(path) for path, _ in clear}
    inside = {">".join(path): 0 for path, e in clear if e.name not in PART_NAMES and not any(_element(s).name in PART_NAMES for s in path)}
    for name in inside:
        inside[name] = sum(m for p, m in masses.items() if (p == name or p.startswith(name + ">")) and p in names)
    everything = sum(m for p, m in masses.items() if p in names or p == "")
    rich = [name for name, m in inside.items() if m and 5 * m >= 3 * everything]
    return [*tiers, *([[max(rich, key=lambda p: (p.count(">"), p))]] if rich else []), [""]]


def article_paths(nodes: list[list], masses: dict[str, int]) -> list[str]:
    """The first tier."""
    return article_tiers(nodes, masses)[0]


def _masses(element: Element, above: str = "", found: dict[str, int] | None = None) -> dict[str, int]:
    """Characters of text directly in each path."""
    found = {} if found is None else found
    for child in element.children:
        if isinstance(child, Element):
            _masses(child, f"{above}>{child.signature}" if above else child.signature, found)
        elif child.strip():
            found[above] = found.get(above, 0) + len(child.strip())
    return found


def blocks(element: Element, inside: bool, paths: frozenset[str], above: str = "", nested: bool = False, weighed: int = 0) -> Iterator[str]:
    """Texts of the blocks of the article in page order, asides left out. With `weighed`, the text of the page, an element
    that holds more than half of it is no aside."""
    for child in element.children:
        if isinstance(child, Element):
            if not is_aside(child, nested) or (weighed and (child.name == "form" or child.name not in ASIDE_NAMES) and 2 * _mass(child) > weighed):
                path = f"{above}>{child.signature}" if above else child.signature
                yield from blocks(child, inside or path in paths, paths, path, nested or child.name in ARTICLE_NAMES, weighed)
        elif inside:
            piece = " ".join(child.split())
            if piece:
                yield piece


def extract(page: str | None, tiers: list[list[str]] | None) -> str:
    """Main text of one page: blocks joined by two line breaks, from the first tier of paths that gives any."""
    if not page:
        return ""
    tree = parse(page)
    for paths in tiers or [[""]]:
        text = "\n\n".join(blocks(tree, "" in paths, frozenset(paths)))
        if text:
            return text
    # No rule may empty a page: what holds most of the text outside named asides is none, whatever its classes say.
    everything = _mass(tree)
    if not everything:
        return ""
    return "\n\n".join(blocks(tree, True, frozenset(), weighed=everything))


def _mass(element: Element) -> int:
    """Characters of text outside asides by name; a form counts, as whole pages stand in one."""
    return sum(len(c.strip()) if isinstance(c, str) else 0 if c.name in ASIDE_NAMES and c.name != "form" else _mass(c) for c in element.children)


def infer(pages: DataFrame, host: str = "host", page: str = "html", fan: int = FAN) -> DataFrame:
    """One wrapper per host: `host`, `pages`, `wrapper` (nodes as JSON), `expression`, `paths` of the article and `tiers` of such paths.

    Every page takes part. Pages of equal shape are counted first, so a host with a third of all pages is a few rows;
    different shapes are aligned `fan` at a time, level by level, until one wrapper per host is left.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], list] = {}
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not p:
                    continue
                tree = parse(p)
                nodes = shape(tree)
                key = h, json.dumps(nodes, separators=(",", ":"))
                if key not in counts:
                    counts[key] = [0, {}, bool(_named(_clear(nodes)))]
                entry = counts[key]
                entry[0] += 1
                if entry[2]:  # a template that names its article; the others of its host are weighed without it
                    continue
                for path, n in _masses(tree).items():
                    entry[1][path] = entry[1].get(path, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()),
                 pa.array([list(v[1].items()) for v in counts.values()], pa.map_(pa.string(), pa.int64()))], names=["host", "wrapper", "pages", "masses"])

    found = cut_lineage(pages.select(host, page).mapInArrow(look, "host string, wrapper string, pages bigint, masses map<string,bigint>"))
    masses = found.select("host", F.explode("masses").alias("path", "n")).groupBy("host", "path").agg(F.sum("n").alias("n"))
    shapes = found.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"))
    shapes = cut_lineage(shapes.withColumn("node", F.xxhash64("wrapper")))

    def join(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        rows = sorted((row for batch in batches for row in zip(batch["wrapper"].to_pylist(), batch["pages"].to_pylist(), strict=True)), key=lambda r: (-r[1], r[0]))
        merged = json.loads(rows[0][0])
        for text, _ in rows[1:]:
            merged = align(merged, json.loads(text))
        return json.dumps(merged, separators=(",", ":")), sum(n for _, n in rows)

    def reduce(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, n = join(group)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([text], pa.string()), pa.array([n], pa.int64())], names=["host", "wrapper", "pages"])

    most = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        nodes = max(1, -(-most // fan))
        shapes = shapes.withColumn("node", F.pmod(F.xxhash64("wrapper"), F.lit(nodes)))
        shapes = cut_lineage(shapes.groupBy("host", "node").applyInArrow(reduce, "host string, wrapper string, pages bigint"))
        most = 1 if nodes == 1 else shapes.groupBy("host").count().agg(F.max("count")).first()[0]
    listed = masses.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("masses"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = [json.loads(w) for w in batch["wrapper"].to_pylist()]
            tiers = [article_tiers(w, dict(m or ())) for w, m in zip(wrappers, batch["masses"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["pages"], batch["wrapper"], pa.array(list(map(expression, wrappers)), pa.string()),
                                              pa.array([t[0] for t in tiers], pa.list_(pa.string())), pa.array(tiers, pa.list_(pa.list_(pa.string())))],
                                             names=["host", "pages", "wrapper", "expression", "paths", "tiers"])
    both = shapes.select("host", "pages", "wrapper").join(listed, "host", "left")
    return both.mapInArrow(finish, "host string, pages bigint, wrapper string, expression string, paths array<string>, tiers array<array<string>>")


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Every row of `pages` with `text` (main text) and `n_chars` (its code points), replacing columns of those names.

    The wrapper of a page's host names the elements that hold the article, in tiers: a page of another template, which
    has none of the first tier, takes the next one that gives it a text. Menus, headers, footers, sidebars, notices,
    adverts, forms and reader comments inside it are left out, as are scripts, styles and markup. Character references
    are decoded, white space in a block becomes one space, blocks are joined by two line breaks, nothing else is cut.
    Null and empty pages give an empty text; null urls and urls without a host share one wrapper. Equal rows get equal
    texts; an empty table gives an empty result.
    """
    pages, names, of = plain_names(pages, ["text", "n_chars"])
    url, page = of[url], of[page]
    hosted = pages.withColumn("__host", host_and_path(F.col(url))[0])
    wrappers = infer(hosted.select(F.col("__host").alias("host"), F.col(page).alias("html"))).select(
        F.col("host").alias("__host"), F.to_json("tiers").alias("__tiers"))
    joined = small_join(hosted, wrappers, ["__host"], [url]).select(*pages.columns, "__tiers")
    at, last, made = pages.columns.index(page), len(pages.columns), [*pages.columns, "text", "n_chars"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields] + ["text string, n_chars bigint"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, json.loads(w) if w else None) for p, w in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=made)
    return joined.mapInArrow(read, schema).toDF(*names, "text", "n_chars")
