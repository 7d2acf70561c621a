from __future__ import annotations

import os
import random

import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import contamination, mixing, queries, repetition, tokens
from keyfold.llm.text import visible_words

WORDS = [f"w{i}" for i in range(400)]
needs_files = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabulary files here")

# --- visible words ---


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("", ""), ("A b-c, d3\n\ne", "a b c d3 e"), ("x<!-- hidden\nwords --> y", "x y"), ("a<ref name=\"q 1\" /> b<ref>c</ref>", "a b c"), ("un<b>do</b>ne one<br/>two", "undone one two"),
        ("[[Page name|the label]]s and [[Other]] [http://x.org/a?b=c shown]", "the labels and other shown"), ("a&nbsp;b&#44; c&amp;d &#8203;e&shy;f", "a b c d ef"), ("Ｆｕｌｌ ｗｉｄｔｈ１", "full width1"),
        ("zero​width so­ft ﻿bom", "zerowidth soft bom"), ("{{quote|text=Some words|by=Me}}", "some words me"), ("{|\n|-\n! Head !! More\n| cell || next\n|}", "head more cell next"), ("''it's'' '''bold'''", "it s bold"),
        ("<!-- never closed", ""), ("1 < 2 and 3 > 2", "1 2 and 3 2"), ("İstanbul STRASSE straße", "i stanbul strasse strasse"), ("a_b", "a b"), ("* one\n# two\n:three", "one two three"),
    ],
)
def test_visible_words(text, want):
    assert " ".join(visible_words(text)) == want


@given(st.text(max_size=80))
def test_no_text_crashes(text):
    assert all(w.isalnum() for w in visible_words(text))


# --- leaks ---


def _run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_leaks_like_brute_force(spark):
    r = random.Random(1)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(5, 40)))) for i in range(12)] + [(99, None), (98, ""), (None, " ".join(WORDS[:20]))]
    docs = []
    for d in range(60):
        words = r.choices(WORDS, k=30)
        for _ in range(r.randint(0, 2)):
            p = r.choice(items[:12])[1].split()
            at = r.randint(0, len(p) - 1)
            words += p[at : at + r.randint(8, 20)]
        docs.append((d, " ".join(words + r.choices(WORDS, k=5)), 1))
    docs += [(1000, None, 1), (1001, "", 1), (1002, "short", 1), (0, docs[0][1], 1)]
    want = {(d, i) for d, t, _ in docs for i, p in items if t and p and i is not None and _run(t.split(), p.split()) >= 12}
    c, e = spark.createDataFrame(docs, "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, passage string")
    for chars in (10**6, 400):
        got = contamination.leaks(c, e, block_chars=chars).collect()
        assert {(x.doc_id, x.item_id) for x in got if x.run >= 12} == want
        assert len(got) == len({(x.doc_id, x.item_id) for x in got})
    assert contamination.leaks(c.limit(0), e).count() == contamination.leaks(c, e.limit(0)).count() == 0


def test_one_or_two_substituted_words_are_no_escape():
    passage = WORDS[:12]
    index = contamination.TestIndex.build([(7, " ".join(passage))])
    for a in range(1, 11):
        for b in range(a, 11):
            text = ["x", *("changed" if i in (a, b) else w for i, w in enumerate(passage)), "y"]
            ((*hit, replaced),) = index.compared([text])
            assert hit[:2] == [0, 0] and replaced == len({a, b})


@pytest.mark.parametrize(("every", "recall"), [(4, 0.9), (5, 0.95), (6, 0.98), (8, 0.98)])
def test_recall_of_passages_with_many_substitutions(every, recall):
    r = random.Random(every)
    found = 0
    for _ in range(200):
        p = [f"w{r.randint(0, 10**6)}" for _ in range(40)]
        text = [*p[:3], *(w if r.random() > 1 / every else "other" for w in p[3:37]), *p[37:]]
        found += bool(contamination.TestIndex.build([(7, " ".join(p))]).compared([text]))
    assert found >= recall * 200
    long = WORDS[:40]
    text = long[:15] + ["other"] + long[16:33] + ["end"]
    index = contamination.TestIndex.build([(7, " ".join(long))])
    assert index.overlaps([text]) == [(0, 0, 17, 33, 1)]


def test_query_keeps_every_pair_with_two_words_replaced(spark, tmp_path):
    p = WORDS[:12]
    docs = [(hole, " ".join(["x", *p[:hole], "changed", *p[hole + 1 :], "y"])) for hole in range(1, 11)]
    docs += [(20, " ".join(p)), (21, " ".join([*p[:3], "no", "no", *p[5:]])), (22, " ".join(["no", *p[1:]])), (23, " ".join([*p[:3], "no", p[4], "no", p[6], "no", *p[8:]]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(p))], "item_id long, passage string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {x.doc_id for x in queries.p6_overlaps(spark, str(tmp_path)).collect()} == {*range(1, 11), 20, 21}


def test_run_and_overlap_are_the_best_of_all_lines(spark):
    p = WORDS[:60]
    one, two = p[:13], [*p[20:30], "changed", *p[31:41], "changed", *p[42:52]]
    text = [*one, *["x"] * 30, *two]
    index = contamination.TestIndex.build([(7, " ".join(p))])
    assert index.compared([text]) == [(0, 0, 13, 32, 2, 0)]


def test_windows_do_not_cross_texts():
    index = contamination.TestIndex.build([(1, " ".join(WORDS[:12]))])
    assert index.overlaps([WORDS[:6], WORDS[6:12]]) == []
    assert index.overlaps([[], WORDS[:12], []]) == [(1, 0, 12, 12, 0)]


def test_shared_passages_and_repeats_in_a_text():
    p = WORDS[:14]
    index = contamination.TestIndex.build([(1, " ".join(p)), (2, " ".join(["zz", *p, "yy"]))])
    assert {(i, run) for _, i, run, *_ in index.overlaps([p * 50])} == {(0, 14), (1, 14)}


# --- mixing ---


def _naive(seats, weights, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        q = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps, strict=True)) if w > 0 and g < c]
        if not q:
            break
        got[min(q)[1]] += 1
    return got


@given(st.integers(0, 300), st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.2, 1.0, 3.0, 7.5]), st.integers(0, 200)), max_size=7))
def test_apportionment_by_highest_quotients(seats, parties):
    w, c = [p[0] for p in parties], [p[1] for p in parties]
    assert mixing.apportion(seats, w, c) == _naive(seats, w, c)


def test_apportionment_of_very_many_seats():
    got = mixing.apportion(10**12, [0.5, 0.3, 0.2], [10**13] * 3)
    assert sum(got) == 10**12 and got == [5 * 10**11, 3 * 10**11, 2 * 10**11]


def _counted(spark, data):
    return spark.createDataFrame([(i, s, n, 5, "x") for i, (s, n) in enumerate(data)], "doc_id long, source string, n long, shard int, total string")


T = "mix_id int, source string, weight double, max_repeats int, copies int"


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 40_000)
    r = random.Random(2)
    data = [("big", r.randint(50, 900)) for _ in range(1500)] + [("mid", r.randint(50, 900)) for _ in range(300)] + [("small", r.randint(50, 900)) for _ in range(60)] + [("big", 0), ("none", 10), (None, 10)]
    t = spark.createDataFrame([(1, "big", 6.0, 1, 0), (1, "mid", 2.0, 2, 0), (1, "small", 2.0, 4, 0), (1, "absent", 1.0, 4, 0), (1, None, 1.0, 1, 0), (2, "big", 0.5, None, 0), (2, "mid", 0.5, 1, 0), (2, "small", 0.0, 9, 0), (2, "none", None, 1, 0)], T)
    c = _counted(spark, data)
    m = mixing.mix(c, t, seed=3).cache()
    got = m.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(c.repartition(7), t, seed=3).collect()))
    caps = {(1, "big"): 1, (1, "mid"): 2, (1, "small"): 4, (2, "big"): 1, (2, "mid"): 1}
    assert {(x.mix_id, x.source) for x in got} == set(caps)
    assert all(1 <= x.copies <= caps[x.mix_id, x.source] for x in got)
    assert len({(x.mix_id, x.doc_id) for x in got}) == len(got) and all(data[x.doc_id] == (x.source, x.n) for x in got)
    s = {(x.mix_id, x.source): x for x in mixing.shares(m, t).collect()}
    for k, want in {(1, "big"): 0.6, (1, "mid"): 0.2, (1, "small"): 0.2, (2, "big"): 0.5, (2, "mid"): 0.5}.items():
        assert s[k].reached_share == pytest.approx(want, abs=0.01)
    assert s[1, "mid"].due_share == pytest.approx(0.2) and s[1, "absent"].due_share == 0 and s[1, "absent"].deviation is None
    assert all(abs(x.deviation) < 0.05 for x in s.values() if x.deviation is not None)
    assert s[1, "absent"].reached_share == 0 and s[1, "absent"].target_share == pytest.approx(1 / 11) and s[2, "none"].target_share == 0
    # All there is of the source that limits the mix is used.
    assert s[1, "small"].tokens > 0.97 * 4 * sum(n for x, n in data if x == "small")
    over = mixing.shares(mixing.mix(c, t, total=10**9), t).where("mix_id = 2 and source = 'mid'").first()
    assert over.most_uses == 1 and over.documents == 300


def test_mixes_do_not_depend_on_each_other(spark):
    r = random.Random(5)
    c = _counted(spark, [(r.choice(["a", "b", "b", "b"]), r.randint(1, 900)) for _ in range(900)])
    one = [(1, "a", 1.0, 1, 0), (1, "b", 1.0, 1, 0)]
    alone = mixing.mix(c, spark.createDataFrame(one, T))
    beside = mixing.mix(c, spark.createDataFrame([*one, (2, "a", 0.001, 1, 0), (2, "b", 1.0, 3, 0)], T)).where("mix_id = 1")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, beside.collect()))


@given(st.lists(st.tuples(st.sampled_from([0.5, 1.0, 3.0]), st.integers(1, 4), st.lists(st.integers(1, 5000), min_size=1, max_size=4)), min_size=1, max_size=4), st.sampled_from([None, 3000, 10**6]))
def test_every_block_finds_a_place(sources, total):
    targets = [{"mix_id": 1, "source": str(i), "weight": w, "max_repeats": m} for i, (w, m, _) in enumerate(sources)]
    plan = mixing._plan(targets, {str(i): list(enumerate(ns)) for i, (*_, ns) in enumerate(sources)}, total)
    got = {(s, shard): (n, k, rounds * k + extra) for _, s, shard, n, k, rounds, extra in plan}
    assert all(0 < seats <= k * sources[int(s)][1] and sources[int(s)][2][shard] == n for (s, shard), (n, k, seats) in got.items())
    if total is None:  # seats as by highest quotients, as no source runs out
        seats = [sum(x for (s, _), (*_, x) in got.items() if s == str(i)) for i in range(len(sources))]
        assert seats == _naive(sum(seats), [w for w, *_ in sources], [10**9] * len(sources))


def test_nothing_to_mix(spark):
    t, c = spark.createDataFrame([(1, "a", 1.0, 1, 0)], T), _counted(spark, [("a", 5)])
    assert mixing.mix(c.limit(0), t).count() == mixing.mix(c, t.limit(0)).count() == 0
    assert mixing.mix(_counted(spark, [("a", 0), (None, 4)]), t).count() == 0
    assert [r[2:4] for r in mixing.shares(mixing.mix(c.limit(0), t), t).collect()] == [(1.0, 0.0)]


@needs_files
def test_token_counts(spark):
    texts = ["Hello, world!", None, "", "x" * 30_000, "<|endoftext|>", "é" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("s"))
    enc = tokens.byte_bpe()
    assert [r.n for r in mixing.count_tokens(df).orderBy("doc_id").collect()] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert enc.decode(enc.encode_ordinary("Hello, wörld!")) == "Hello, wörld!"


# --- repetition ---


def _brute(words, run=8):
    seen, cover = set(), [0] * len(words)
    for i in range(len(words) - run + 1):
        k = tuple(words[i : i + run])
        if k in seen:
            cover[i : i + run] = [1] * run
        seen.add(k)
    return sum(cover)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_repeated_words(texts):
    lens = np.array([len(t) for t in texts], np.int64)
    ids = np.array([w for t in texts for w in t], np.int64)
    assert repetition.repeated_words(ids, lens).tolist() == [_brute(t) for t in texts]


TEXTS = [
    None, "", "123 456 !!", "one two three", "the cat sat on the mat with a hat " * 5, "Die Katze saß " * 20, "a b c d e f g h " * 2, "a b c d e f g h " + "q r s t u v w x y z " * 2, "İi" * 3 + " ΑΒΓ αβγ " * 10,
    "Это кот. " * 12, "unrelated words that never come twice in any line of this text at all", "x" * 200_000, "word " * 30_000,
]


@needs_files
def test_repetition_like_brute_force(spark):
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id int, text string, words string, share int")
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    split = regex.compile(r"\p{L}+")
    found = set()
    for i, t in enumerate([*TEXTS, TEXTS[4]]):
        words = [w.lower() for w in split.findall(t or "")]
        n = _brute(words)
        assert (got[i].words, got[i].repeated) == (len(words), n) and got[i].share == pytest.approx(n / max(1, len(words)))
        if words and 10 * n >= 3 * len(words):
            found.add(i)
            assert not got[i].above_band
        assert (got[i].entropy is None) == (not words)
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == found
    assert repetition.repetition(df.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["alpha", "beta", "Καλημέρα", "кот", "zzzzqx", "i"]), min_size=1, max_size=60), st.sampled_from([0.1, 0.3, 0.6, 1.0]))
@needs_files
def test_no_text_of_the_wanted_share_is_above_the_band(words, share):
    f = repetition.Fertility(tokens.TOKENIZERS)
    ids, lens = f.number([words]), np.array([len(words)])
    m = f.measure(ids, lens)
    above = m["entropy"] > repetition._band(m["tokens"], lens, share)
    if _brute(words) >= share * len(words) - 1e-9 and _brute(words):
        assert not above[0]


@needs_files
def test_fertility_measures():
    f = repetition.Fertility(tokens.TOKENIZERS)
    sp, is_byte = tokens.pieces()
    texts = [["hello", "hello", "world"], ["日本"], [], ["кот"] * 4]
    m = f.measure(f.number(texts), np.array([3, 1, 0, 4]))
    for k, ws in enumerate(texts):
        t = [x for w in ws for x in sp.encode(w)]
        assert m["tokens"][k] == len(t) and m["letters"][k] == sum(map(len, ws)) and m["bytes"][k] == is_byte[t].sum()
        p = np.unique(t, return_counts=True)[1] / max(1, len(t))
        assert m["entropy"][k] == pytest.approx(-(p * np.log2(p)).sum())
    assert m["script"][0] == "LATIN" and m["script"][1] == "CJK" and m["script"][3] == "CYRILLIC"


@needs_files
def test_bands_of_a_script(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(r.choices(["tree", "house", "river", "stone", "light"], k=40))) for i in range(80)] + [(80, "go " * 60), (81, "")], "doc_id int, text string")
    v = {x.doc_id: x for x in repetition.fertility_verdicts(repetition.repetition(df)).collect()}
    assert v[80].entropy_rate_out and sum(x.entropy_rate_out for x in v.values()) < 10 and 81 not in v
    assert repetition.bands(repetition.repetition(df)).count() == 1
