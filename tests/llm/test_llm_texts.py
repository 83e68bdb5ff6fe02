"""Operators on whole texts, against plain re-statements of what they compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flowguard.llm import components, decontaminate, fmindex, language, passages, pii, quality, simhash

LONG = "word " * 60_000


def frame(spark, texts, kind="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), kind)


# --- decontamination

@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.integers(1, 5), min_size=1, max_size=4), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_index_finds_every_occurrence(runs, phrase, sample):
    text = np.concatenate([np.array([*r, 0]) for r in runs]).astype(np.int64)
    index = fmindex.FMIndex(text, sample)
    which, low, high = index.search(np.array([phrase], np.int64))
    want = [i for i in range(len(text)) if text[i:i + len(phrase)].tolist() == phrase]
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
    assert found == want


def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, names = set(), set()
    for name, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_hits_equal_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "GAMMA", "d4", "é", "ß", "zeta"]
    draw = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(1, draw(20)), (2, draw(3)), (10, draw(13)), (10, draw(14)), (3, ""), (4, None), (5, "Unique Phrase"), (6, draw(40))]
    texts = [draw(30), items[0][1] + " x " + draw(5), "unique-phrase", draw(10) + items[7][1][5:120], "", None, "!!!", "beta", " ".join([items[6][1]] * 50)]
    texts += [draw(rng.randint(1, 40)) for _ in range(20)] + [texts[1]] * 3
    found = decontaminate.find(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_words, r.n_hit, r.items) == brute_hits(texts[r.doc_id], items), texts[r.doc_id]
        covered = [w for s in r.spans for w in decontaminate.words_of(texts[r.doc_id][s.start:s.end])]
        assert len(covered) == r.n_hit


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(frame(spark, ["a b"]), none).collect()] == [(2, 0, [])]
    assert decontaminate.find(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    null_item = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    carried = spark.createDataFrame([(1, "a b", 7, "k")], "doc_id long, text string, n_hit int, k string")
    row = decontaminate.find(carried, null_item, carry=("doc_id", "text", "n_hit", "k")).first()
    assert (row.n_hit, row["items"], row.k, row.text) == (2, ["null"], "k", "a b")


# --- SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(st.sampled_from("aB é\n\tß"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("bucket", [2, 24, 10_000])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    rng = random.Random(9)
    marks = {0, 1, 3, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        marks |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(30)}
    crowd = rng.getrandbits(64)  # many within two bits of each other
    marks |= {crowd ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(64)}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), bucket).collect()
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    assert roots_of([(r.u, r.v) for r in found], signed) == roots_of(pairs, signed)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    order = list(range(150))
    rng.shuffle(order)
    pairs = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots_of(pairs, {x for p in pairs for x in p})
    assert found == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_groups_of_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base, base.upper(), base.replace("w7 ", "x "), "else " * 5, None, "", " \n", None]
    found = {r.doc_id: r for r in simhash.group(frame(spark, texts)).collect()}
    marks = [brute_fingerprint(t) for t in texts]
    near = roots_of([(i, j) for i in range(9) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2], range(9))
    assert {i: r.component_id for i, r in found.items()} == near
    assert found[0].component_id == found[1].component_id == found[2].component_id == 0
    assert found[5].component_id == found[8].component_id == 5 and found[5].fp == 0
    rows = [(None, "only null"), (None, "only null"), (4, base), (4, base), (3, base), (9, "other text here")]
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")
    kept = simhash.one_of_each(extra)
    assert kept.columns == extra.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "only null"), (3, base), (9, "other text here")], key=str)
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- quality

def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    earlier, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


@given(st.text(st.sampled_from("ab# \n\té\x0b\x1f\xa0"), max_size=120))
@settings(max_examples=300, deadline=None)
def test_quality_counts(text):
    assert quality.measure(text) == brute_measure(text)


def test_quality_counts_of_repeats():
    for text in ("a b c d e f g h " * 3, "x " * 40, "a b c d e f g h i a b c d e f g h", None, "", LONG):
        assert quality.measure(text) == (brute_measure(text) if text != LONG else (60_000, 240_000, 0, 0, 60_000))


def test_quality_model_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(30, 90)))
    junk = lambda: " ".join(word() + rng.choice(["$$$", "###", "!!"]) for _ in range(rng.randint(30, 90)))
    texts = [clean() if i % 3 else junk() for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5000, 1), (None, 0), (3, None)], "doc_id long, quality int")
    docs = frame(spark, [*texts, None, "", "too short", texts[1]])
    model = quality.train(docs, labels, per_label=80)
    found = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    held = range(300, 400)
    assert sum(found[i].kept != (i % 3 > 0) for i in held) <= 1
    assert [found[i].kept for i in (400, 401, 402)] == [False] * 3 and found[400].base_failed and found[400].good is None
    assert found[403][1:] == found[1][1:]
    assert np.array_equal(model.weights, quality.train(docs, labels, per_label=80).weights)


def test_quality_without_labels_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), False, "x")], "doc_id long, text string, kept boolean, good string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    row = quality.judge(docs, model, carry=("doc_id", "text", "kept", "good")).first()
    assert row.kept is True and row.good == pytest.approx(1.0)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


# --- language

def test_language_held_out_and_rejection(spark):
    rng = random.Random(6)
    parts = {"xx": ["the", "and", "ing", "th", "er", "of"], "yy": ["der", "sch", "ein", "ung", "ü", "ß"], "zz": ["que", "ñ", "ción", "los", "ar", "de"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, rng.randint(5, 40)), lang if i % 5 else None) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 400"), per_label=100)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    scored = [(found[i].lang_pred, lang) for i, _, lang in rows if i >= 400 and lang]
    assert sum(a == b for a, b in scored) / len(scored) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \u00b2"), (4, "the " * 30_000), (5, "ü")], "doc_id long, text string")
    answers = {r.doc_id: (r.lang_pred, r.score > 0, r.accepted) for r in language.identify(odd, model).collect()}
    assert answers[1] == answers[2] == answers[3] == ("und", False, False)
    assert answers[4][0] == "xx" and answers[5][0] in parts


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert [tuple(r) for r in language.identify(docs, model).collect()] == [(1, "und", 0.0, False)]
    clash = spark.createDataFrame([(1, "abc", "s", 2)], "doc_id long, text string, score string, extra int")
    assert language.identify(clash, model, carry=("doc_id", "score", "extra")).columns == ["doc_id", "extra", "lang_pred", "score", "accepted"]


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@given(st.text(st.sampled_from("ab1@._ -\n"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_emails_are_leftmost_matches(text):
    assert [s[1:] for s in pii.base_spans(text) if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)]


@given(st.text(st.sampled_from("0129.. "), max_size=40))
@settings(max_examples=400, deadline=None)
def test_addresses_are_leftmost_matches(text):
    want = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [s[1:] for s in pii.base_spans(text) if s[0] == "ip"] == want


def test_cards_and_phones():
    text = "4111 1111 1111 1111 x 4111-1111-1111-1112 y 1.2.3.4444 +1 (23) 456-789 +1 23"
    phone = text.index("+1")
    assert pii.base_spans(text) == [("card", 0, 19), ("phone", phone, phone + len("+1 (23) 456-789"))]
    # A greedy run of too many digits is dropped and not tried again, though it begins with a card.
    assert pii.base_spans("5500 0000 0000 0004 4222222222222") == []
    assert pii.base_spans("4111111111111111 22222") == []
    assert pii.base_spans("1" * 200_000 + "a@" + "b" * 200_000) == []
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_terms_that_give_an_entity_away(spark):
    texts = ["ask Zorro at zed@mail.com please number"] * 3 + ["please ask about the number"] * 40 + [None, "", "nothing"]
    docs = frame(spark, [*texts, texts[0]])
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i in (0, 1, 2, 46):
        terms = {texts[i % 46][s.start:s.end].lower() for s in found[i].added}
        assert terms == {"zorro", "at"}  # both stand nowhere else
        assert all(s.share == 1.0 for s in found[i].added)
        assert [(s.kind, s.start) for s in found[i].base] == [("email", 13)]
    assert not found[10].added and found[43].base == [] == found[43].added
    clean = {r.doc_id: r.clean for r in pii.sanitise(pii.detect(docs)).collect()}
    assert clean[0] == "ask   [email] please number"
    assert clean[43] is None and clean[45] == "nothing"


def test_disclosure_shares_equal_their_definition(spark):
    rng = random.Random(3)
    words = ["ann", "bob", "cat", "dog", "elk"]
    texts = [" ".join(rng.choice(words) for _ in range(4)) + (f" {rng.choice('xy')}@h.com" if rng.random() < 0.5 else "") for _ in range(80)]
    docs = frame(spark, texts)
    met = pii._occurrences(docs, "text", "doc_id", 8)
    found = {(r.entity, r.term): r.share for r in pii.disclosures(docs, met, threshold=-9.0).collect()}
    df, pair, ent = Counter(), Counter(), Counter()
    for t in texts:
        terms = {w for w in re.findall(r"\w+", t.split(" x@")[0].split(" y@")[0])}
        whole = set(re.findall(r"\w+", t))
        df.update(whole)
        for e in re.findall(r"[xy]@h\.com", t):
            ent[f"email:{e}"] += 1
            pair.update((f"email:{e}", w) for w in terms)
    want = {(e, w): min(1.0, np.log2(len(texts) * k / (df[w] * ent[e])) / np.log2(len(texts) / ent[e])) for (e, w), k in pair.items() if k >= 2}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_terms_of_whole_documents_and_of_single_ones(spark):
    filler = " ".join(f"common{i}" for i in range(30))
    texts = [filler] * 200 + [f"Quill {filler} write to lone@mail.com {filler} quill"]  # one document only, far from the entity
    texts += [f"zed@mail.com {filler} number Marlow {filler} marlow"] * 3 + [f"{filler} marlow"]
    found = {r.doc_id: r for r in pii.detect(frame(spark, texts)).collect()}
    terms = lambda i: [texts[i][s.start:s.end] for s in found[i].added]
    assert terms(200) == ["Quill", "write", "to", "quill"]
    assert all(s.share == pytest.approx(1 - 1 / np.log2(len(texts))) for s in found[200].added)
    assert terms(201) == terms(203) == ["number", "Marlow", "marlow"] and not found[0].added and not found[204].added
    assert found[201].added[1].share == pytest.approx(np.log2(len(texts) / 4) / np.log2(len(texts) / 3))


def test_personal_data_of_nothing_and_clashing_columns(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a@b.co x", 5, "t"), (None, "a@b.co x", 5, "t")], "doc_id long, text string, base int, term string")
    assert [(len(r.base), r.term) for r in pii.detect(docs).collect()] == [(1, "t")] * 2


# --- repeated passages

def brute_repeats(texts):
    firsts, marked = {}, defaultdict(set)
    for i, t in enumerate(texts):
        for k, u in enumerate(passages.units(t or "")):
            if u[3] in firsts:
                marked[i].add(k)
            else:
                firsts[u[3]] = (i, k)
    return marked


def test_repeats_are_cut_but_for_the_earliest(spark):
    sentence = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n)) + ". "
    passage = "".join(sentence(t, 7) for t in "pqrstuvw")
    texts = ["Own start here. " + passage, "Other words\n" + passage.upper() + "\nend of it", "tail only " + passage, "Es. Les.\nshort line",
             "Es. Les.\nshort line", None, "", "\n\n", "one two three four five six seven eight\nx", "unique\nOne, two  three four five six seven eight!"]
    docs = frame(spark, texts)
    found = {r.doc_id: r for r in passages.remove_repeats(docs).collect()}
    marked = brute_repeats(texts)
    for i, t in enumerate(texts):
        spans = passages.removals(passages.units(t or ""), marked[i])
        assert [(s.start, s.end) for s in found[i].removed] == spans
        assert found[i].text == (t if t is None else passages.without(t, spans))
        assert found[i].n_repeated == len(marked[i])
    assert found[0].text == texts[0] and found[1].text == "Other words\nend of it"
    assert found[2].text.startswith("tail only p0") and "q0" not in found[2].text  # the sentence that the passage begins in is another one
    assert found[4].text == texts[4]  # short repeats stay
    assert found[9].text == "unique\n"


def test_no_fifty_words_that_stand_earlier_stay(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    prose = lambda n: "".join(word() + rng.choice([" "] * 12 + [". ", ", ", "\n"]) for _ in range(n))
    shared = [prose(n).strip(" .,\n") for n in (51, 60, 81, 200)] + [" ".join(word() for _ in range(n)) for n in (51, 90)]
    texts = [f"{prose(rng.randint(3, 90))}opening{i} {s} closing{i} {prose(rng.randint(3, 90))}" for i, s in enumerate(shared * 4)]
    texts += [texts[0], texts[3].upper().replace(" ", "\n"), "again " * 400, prose(60) * 3, None, ""]
    found = {r.doc_id: r for r in passages.remove_repeats(frame(spark, texts), anchored=True).collect()}
    runs = lambda words: {" ".join(words[i:i + 50]) for i in range(len(words) - 49)}
    earlier = set()
    for i, t in enumerate(texts):
        left = re.findall(r"\w+", (found[i].text or "").lower())
        assert not runs(left) & earlier, i
        earlier |= runs(re.findall(r"\w+", (t or "").lower()))
        if i < len(shared):
            assert found[i].text == t and found[i].removed == []  # the earliest stays
        elif i < 4 * len(shared):  # cut to the true ends, not a word more
            assert [re.findall(r"\w+", t[s.start:s.end]) for s in found[i].removed] == [re.findall(r"\w+", shared[i % len(shared)])]
            assert f"opening{i} closing{i}" in found[i].text
    assert found[24].text == "" and found[25].text == "" and found[28].text is None and found[29].text == ""
    assert 0 < found[26].text.count("again") < 50 and len(found[27].text) >= len(texts[27]) // 3 - 2


def test_repeats_of_nothing_nulls_and_clashing_columns(spark):
    assert passages.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    line = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, line, "x", 1), (2, line, "y", 1), (2, line, "y", 1), (1, line + "\nz", "w", 1)], "doc_id long, text string, digest string, removed int")
    found = sorted(((r.doc_id or 0, r.digest, r.text) for r in passages.remove_repeats(docs).collect()))
    assert found == [(0, "x", ""), (1, "w", line + "\nz"), (2, "y", ""), (2, "y", "")]


@given(st.text(st.sampled_from("aB. !\n?é"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_units_cover_all_words_in_order(text):
    found = passages.units(text)
    assert " ".join(u[3] for u in found) == " ".join(re.findall(r"\w+", text.lower()))
    assert all(text[u[1]:u[2]].strip() == text[u[1]:u[2]] for u in found)
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_very_long_texts(spark):
    docs = frame(spark, [LONG, LONG, LONG + "end"])
    assert [r.n_words for r in decontaminate.find(docs, spark.createDataFrame([(1, "word word")], "item_id long, text string")).orderBy("doc_id").collect()] == [60_000, 60_000, 60_001]
    assert simhash.group(docs).count() == 3
    assert [len(r.text) for r in passages.remove_repeats(docs).orderBy("doc_id").collect()][:2] == [len(LONG), 0]
    assert hashlib.sha256(pii.detect(docs).first().text.encode()).hexdigest() == hashlib.sha256(LONG.encode()).hexdigest()


def test_texts_that_hold_no_entity_are_not_moved(spark):
    """The pattern lets no entity pass, and only texts it finds meet the terms."""
    rng, plain = random.Random(8), re.compile(pii.MAY_HOLD)
    parts = ["a", "@", ".", "-", " ", "1", "4111111111111111", "10.0.0.1", "+", "(", ")", "é", "\n", "b.c", "999", "٣"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(20_000)]
    held = [t for t in texts if pii.base_spans(t)]
    assert len(held) > 1000 and all(plain.search(t) for t in held)
    docs = spark.createDataFrame(list(enumerate([*held[:40], "no such thing", "", None])), "doc_id long, text string")
    found = pii.detect(docs)
    assert {r.doc_id: len(r.base) for r in found.collect()} == {i: len(pii.base_spans(t)) for i, t in enumerate([*held[:40], "no such thing", "", None])}
    moved = docs.where(docs.text.rlike(pii.MAY_HOLD))
    assert moved.count() == 40 and "Union" in found._jdf.queryExecution().optimizedPlan().toString()
