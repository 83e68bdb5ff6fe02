"""Repeated lines and passages, by paragraphs cut where their words say."""

import random
import re

import numpy as np
import pytest

from flowguard.llm import paragraphs


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def brute(texts, line_words=paragraphs.LINE_WORDS, run_words=paragraphs.RUN_WORDS):
    """One text after the other, one unit after the other, by the words of the units themselves."""
    seen, out = set(), []
    for t in texts:
        units = paragraphs.Units(t or "")
        every = words(t)
        spoken = [tuple(every[a:b]) for a, b in zip(units.first, units.last)]
        repeated = []
        for s in spoken:
            repeated.append(s in seen)
            seen.add(s)
        cut = set()
        for line in set(units.line.tolist()):
            mine = [i for i in range(len(units)) if units.line[i] == line]
            if all(repeated[i] for i in mine) and sum(len(spoken[i]) for i in mine) >= line_words:
                cut.update(mine)
        run = []
        for i in range(len(units) + 1):
            if i < len(units) and repeated[i]:
                run.append(i)
                continue
            if sum(len(spoken[j]) for j in run) >= run_words:
                cut.update(run)
            run = []
        out.append((len(units), sum(repeated), [w for i, s in enumerate(spoken) if i not in cut for w in s]))
    return out


def prose(rng, n):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    return "".join(word() + rng.choice([" "] * 12 + [". ", ", ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force_and_no_fifty_words_stay(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, n).strip(" .,\n") for n in (51, 60, 81, 200, 51, 90)]
    texts = [f"{prose(rng, rng.randint(3, 90))}opening{i} {s} closing{i} {prose(rng, rng.randint(3, 90))}" for i, s in enumerate(shared * 4)]
    texts += [texts[0], texts[3].upper(), "again " * 400, "again " * 300, prose(rng, 60) * 3, None, "", "\n\n", "one two three four five six seven eight\nx", "Es. Les.\nshort",
              "unique\nOne, two  three four five six seven eight!", "Es. Les.\nother", "\u00c9t\u00e9 " * 30]
    found = sorted(paragraphs.remove_repeats(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_units, r.n_repeated, words(r.text)) for r in found] == brute(texts)
    earlier = set()
    for i, (r, t) in enumerate(zip(found, texts)):
        runs = lambda some: {" ".join(some[k:k + 50]) for k in range(len(some) - 49)}
        assert not runs(words(r.text)) & earlier, i
        earlier |= runs(words(t))
        assert (r.text is None) == (t is None)
        if t is not None:
            kept, at = [], 0
            for s in r.removed:
                assert at <= s.start < s.end <= len(t)
                kept.append(t[at:s.start])
                at = s.end
            kept.append(t[at:])
            assert words(" ".join(kept)) == words(r.text) and r.n_removed_chars == len(t) - len(r.text)
        if i < len(shared):
            assert r.text == t  # the earliest stays
    assert found[32].text == texts[32] and found[35].text == texts[35]


def test_cuts_depend_on_the_words_alone():
    rng = random.Random(5)
    passage = prose(rng, 60).replace("\n", " ")
    seen = []
    for _ in range(6):
        before = prose(rng, rng.randint(1, 40)).replace("\n", " ")
        units = paragraphs.Units(before + " " + passage + " " + prose(rng, 9))
        start = len(words(before))
        # From the first cut that the words make on; a cut looks one word further to the right.
        inside = {int(f) - start for f in units.first if start + 16 <= f < start + len(words(passage)) - paragraphs.REACH - 1}
        seen.append(inside)
        assert (units.last - units.first).max() <= paragraphs.MOST_WORDS and units.first[0] == 0
        assert (units.first[1:] == units.last[:-1]).all()
    assert all(s == seen[0] for s in seen) and len(seen[0]) > 2


def test_equal_identities_clashing_names_and_empty_tables(spark):
    line = "a b c d e f g h i j"
    schema = "doc_id long, text string, low long, `a.b` string, __units int, removed int, hash int, unit int, c0 string"
    rows = [(None, line, 1, "x", 1, 1, 1, 1, "k"), (2, line, 1, "y", 1, 1, 1, 1, "k"), (2, line, 1, "y", 1, 1, 1, 1, "k"), (1, line + "\nz", 1, "w", 1, 1, 1, 1, "k"), (None, None, 1, "n", 1, 1, 1, 1, "k")]
    found = paragraphs.remove_repeats(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "text", "low", "a.b", "__units", "hash", "unit", "c0", "n_units", "n_repeated", "n_removed_chars", "removed"]
    assert sorted(((r.doc_id or 0, r["a.b"], r.text) for r in found.collect()), key=str) == [(0, "n", None), (0, "x", ""), (1, "w", line + "\nz"), (2, "y", ""), (2, "y", "")]
    assert paragraphs.remove_repeats(spark.createDataFrame([], schema)).collect() == []


def test_a_very_long_line(spark):
    text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    found = paragraphs.remove_repeats(frame(spark, [text, text, "own " + text])).orderBy("doc_id").collect()
    assert found[0].text == text and found[1].text == "" and len(words(found[2].text)) < 20
    assert np.sum(paragraphs.Units(text).last - paragraphs.Units(text).first) == 60_000
