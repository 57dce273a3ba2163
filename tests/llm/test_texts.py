"""Tokenizer, leaks and quality: exact round trips, brute force, awkward texts."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbloom.llm import leaks, quality, tokens

VOCABULARY = Path(tokens.TOKENIZERS, tokens.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def codec():
    if not VOCABULARY.exists():
        pytest.skip("no vocabulary here")
    return tokens.Codec(tokens.model_bytes(tokens.read_ranks(str(VOCABULARY))))


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(str(VOCABULARY)), special_tokens={})
    return enc.encode_ordinary


ODD = ["", " ", "  ", "a  b", "a   b ", "a \n b", " \n\n x\t\ty  ", "  a", "<|endoftext|> it's WE'LL", "naïve ﬁne 日本語 🙂👩‍👩‍👧", "\r\n\r\n", "x" * 5000, "12345 ½ Ⅷ", "​﻿a", "a　 b", "don't  you'd  ", "\x00\x01"]


@needs_vocabulary
def test_ids_equal_the_public_encoder(codec, tiktoken_encode):
    assert [list(x) for x in codec.encode(ODD)] == [tiktoken_encode(t) for t in ODD]
    assert [codec.decode(x) for x in codec.encode(ODD)] == ODD
    assert [list(x) for x in codec.encode([None, ""])] == [[], []]


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'.é中 "), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_any_text(codec, tiktoken_encode, text):
    ids = codec.encode([text])[0]
    assert list(ids) == tiktoken_encode(text) and codec.decode(ids) == text


@needs_vocabulary
def test_memory_starts_anew(codec, tiktoken_encode, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    texts = [f"word{i} other{i} end" for i in range(50)]
    assert [list(x) for x in codec.encode(texts)] == [tiktoken_encode(t) for t in texts]


@needs_vocabulary
def test_long_pieces_are_not_remembered(codec, tiktoken_encode):
    long = "x" * (tokens.LONG_UNIT + 1)
    for text in (f"a {long} b", f"{long} {long}", long):
        assert list(codec.encode([text])[0]) == tiktoken_encode(text)
    assert all(len(p) <= tokens.LONG_UNIT for p in [*codec.pieces, *codec.units])


@needs_vocabulary
def test_column(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, None, "z"), (None, "", "w")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert [len(x) for _, x in got] == [0, 2, 2, 0] and tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_vocabulary_has_to_be_whole():
    with pytest.raises(ValueError):
        tokens.model_bytes({b"a": 0})
    with pytest.raises(ValueError):
        tokens.model_bytes({bytes([b]): b + 1 for b in range(256)})


# --- leaks


def by_hand(items, text):
    ws, out = leaks.words(text), {}
    for name, item in items:
        covered = set()
        grams = {tuple(ws[i : i + leaks.RUN]) for i in range(len(ws) - leaks.RUN + 1)}
        for i in range(len(item) - leaks.RUN + 1):
            if tuple(item[i : i + leaks.RUN]) in grams:
                covered.update(range(i, i + leaks.RUN))
        if covered:
            out[name] = len(covered)
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(6)]
    for _ in range(60):
        items = [(k, [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]) for k in range(4)]
        items += [(9, items[0][1] + items[1][1])]
        auto = leaks.Automaton(items)
        text = " ".join(rng.choice([" ".join(rng.choice(items)[1]), " ".join(rng.choice(vocab) for _ in range(9)), "zzz"]) for _ in range(4))
        got = {auto.items[i][0]: m.bit_count() for i, (m, _) in auto.covered(leaks._Reader(auto).ids(text)).items()}
        assert got == by_hand(items, text)


PASSAGE = "One cluster of earning holds 81 spans, and it isn't clear why the naïve fine judge re-built their old tower near another quiet river again"
LINE = "Read the passage below and answer every question."


def test_instruction_lines_are_left_out():
    whole = leaks.words(PASSAGE)
    assert leaks.passage(f"{LINE}\n\n{PASSAGE}") == leaks.passage(f"{PASSAGE}\n \n{LINE}") == leaks.passage(PASSAGE) == whole
    assert leaks.passage(f"{LINE}\n\n{PASSAGE}\n\n{PASSAGE}") == whole * 2
    assert leaks.passage(f"{LINE}\n\n{PASSAGE}", instructions=False) == leaks.words(LINE) + whole
    assert leaks.passage(None) == leaks.passage("...") == leaks.passage(" \n\n ") == []


@pytest.mark.parametrize("n", [1, 3, 50])
def test_a_passage_of_many_items_is_found_for_all(spark, n):
    items = spark.createDataFrame([(k, f"{PASSAGE}\n\nQuestion {k}: which tower?") for k in range(n)] * 2, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{LINE} {PASSAGE}"), (2, LINE), (3, "Question 1: which tower?")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaking(docs, items).collect()) == [(1, k) for k in range(n)]


def test_short_items_are_reported(spark):
    items = spark.createDataFrame([(1, "seven words are one less than eight"), (2, None), (3, ""), (4, PASSAGE)], "item_id bigint, text string")
    got = sorted(leaks.looked_for(items).collect())
    assert [tuple(r) for r in got] == [(1, 7, False), (2, 0, False), (3, 0, False), (4, len(leaks.words(PASSAGE)), True)]


@pytest.mark.parametrize("shard", [30, 10**6])
def test_removal(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    long = [f"w{i}" for i in range(200)]
    items = spark.createDataFrame([(1, PASSAGE), (2, " ".join(long)), (3, " ".join(long[20:60]))], "item_id bigint, text string")
    head, tail = "Ünlike\tthis:\n\n", "\n\n  and  so on &amp; on."
    docs = [
        (1, head + PASSAGE + tail, head + tail), (2, head + "<p>" + PASSAGE.replace("old", "<b>old</b>").replace("it isn't", "it isn&#x27;t") + "</p>" + tail, None),
        (3, head + " ".join(long[100:140]) + tail, head + tail), (4, head + " ".join(long[100:120]) + tail, ""), (5, head + " ".join(long[10:70]) + tail + " " + PASSAGE, head + tail + " "), (6, None, ""), (7, "", ""), (8, "nothing of it", ""),
    ]
    got = {r.doc_id: r for r in leaks.cleaned(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string"), items).collect()}
    assert set(got) == {1, 2, 3, 5}
    for key, text, want in docs:
        if key in got:
            r = got[key]
            left = "".join(text[a:b] for a, b in zip([0] + [x.end for x in r.spans], [x.begin for x in r.spans] + [len(text)]))
            assert r.text == left and r.removed_chars == len(text) - len(left) and (want is None or left == want)
            assert "judge" not in left and left.startswith(head) and "so on &amp; on." in left
    clean = spark.createDataFrame([(k, r.text) for k, r in got.items()], "doc_id bigint, text string")
    assert leaks.leaking(clean, items).count() == 0 and leaks.cleaned(clean, items).count() == 0


@pytest.mark.parametrize("dress", [
    str.upper, lambda t: "<p>" + t.replace("old", "<b>old</b>") + "</p>", lambda t: t.replace(" ", "\n"), lambda t: t.replace("fine", "ﬁne").replace("naïve", "naïve").replace("i", "i​"),
    lambda t: t.replace("'", "’").replace(",", " ,"), lambda t: "1. " + t.replace("near", "\n2) near"), lambda t: "> " + t.replace("the ", "the\n> "), lambda t: t.replace("tower", "to-\nwer"), lambda t: t.replace("'", "&#x27;").replace("and", "**and**"),
    lambda t: "é".join(t.split("e")),
])
def test_dress_does_not_matter(spark, dress):
    docs = spark.createDataFrame([(1, "before " + dress(PASSAGE) + " after", 0), (2, "nothing of it", 0), (3, None, 0), (4, "", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, PASSAGE), (8, "short one")], "item_id bigint, text string")
    got = leaks.leaking(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].covered_words == got[0].item_words


def test_a_third_in_runs_of_eight(spark):
    ws = [f"w{i}" for i in range(24)]
    part = lambda a, b: "x " + " ".join(ws[a:b]) + " y"
    docs = [(1, part(3, 11)), (2, part(3, 10)), (3, part(0, 7) + part(8, 15)), (4, part(0, 24) * 2)]
    got = leaks.leaking(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(ws))], "item_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 4]


def test_more_items_than_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 30)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(5)]
    docs = [(k, t) for k, t in items]
    got = leaks.leaking(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(5)]
    assert leaks.leaking(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


# --- quality

PROSE = [
    "The old judge walked along the river while another clerk wrote a letter to their neighbor. It was not clear why the boat had left. Who sent it?",
    "one cluster of reducing holds 9 spans most of them like the honey or their paddle\nwho invited the drought said that the early scarf sold each fragile ritual",
    "1) The clerk walked home with the letter.\n2) Another boat was sold by the judge.\n3) Their neighbor did not answer the question about the river.",
    "<p>The clerk walked home with the letter.</p>\n<p>Another boat was sold by the judge to them.</p>",
    "La phrase vend le maître, car le théâtre garde chaque maître avec le garçon. Une tour garde cette été.",
    "Der Bauer zählt jeder Brief auf der Brücke, denn eine Straße findet das Schiff unter dem Garten.",
    "每个河流带来这个学者。这个石头卖掉每个石头在每个石头，并且那个高塔测量一个医院对这个石头。",
    "The   old   judge   walked along the river while another clerk wrote to them.",
]
OTHER = [
    "| lemma | role | p |\n|---|---|---|\n| open | ARG2 | 0.45 |\n| cut | ARG0 | 0.98 |", "use\t5\t0.1012\tinfant\nrepair\t705\t0.8189\ttrail", "- the muscle\n- its quiet dock\n- Lotus\n- their capital\n- a tower",
    "who was shared on?\nwhat was opened at?\nwhere was it noticed under?\nwho was paid by?", "hotel, muscle, maple, fog, keyboard, pepper, council, carpet, dose, bread, globe, dynasty, melody, anchor", "c5v364Z2ObeGYuBnGuakfdfaHZd0CFWI\nSs327ppvyFG3RcRLDH6AcDn98Husb3F+/",
    "nathsenosk rafertevwen lovomiba. wentuslofer limgriwentafer, dorra osktevtevsensen, zurakekesen", "Login | Next | Next | About | Verbs | Prev | Home", "AÃ¢nÃ¢oÃ¢tÃ¢hÃ¢eÃ¢rÃ¢ Ã¢wÃ¢aÃ¢lÃ¢lÃ¢ Ã¢pÃ¢aÃ¢sÃ¢sÃ¢eÃ¢dÃ¢",
    "northern province weary keyboard replacing ash monk tax circular blunt banner loading glove passport honey", "GET /meadow/index?id=72889&q=repair\nPOST /factory/regiment?id=6522&q=sell",
    "[17:17:08] INFO cluster.block step=862 loss=3.88326\n[12:10:19] INFO cluster.make step=479 loss=67.5", "lung                     -    4205    36.73\nborder                  no    2630    78.92",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert quality.text_statistics(text)[6] > 0.5


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert quality.text_statistics(text)[6] < 0.5


def test_statistics(spark):
    shape = "doc_id bigint, text string, n_words int"
    rows = [(1, PROSE[0], 0), (2, None, 0), (3, "", 0), (4, " \n\t", 0), (5, "x" * 100_000, 0), (6, "\x00�", 0), (6, "\x00�", 0)]
    got = quality.quality(spark.createDataFrame(rows, shape)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].n_words == 28 and by[1].prose_share == 1.0
    assert all(by[k].prose_share is None and by[k].n_words is None for k in (2, 3, 4))
    for k in (1, 5, 6):
        assert by[k].prose_share + by[k].list_share + by[k].table_share + by[k].junk_share == pytest.approx(1.0)
    assert quality.quality(spark.createDataFrame([], shape)).count() == 0


def test_viterbi_is_the_best_path():
    import itertools
    import math

    rng = random.Random(1)
    model = quality.STATED
    lines = [tuple(rng.randrange(len(t)) for t in model._log) for _ in range(5)]
    score = lambda path: model.log_start[path[0]] + sum(t[v][s] for s, line in zip(path, lines) for t, v in zip(model._log, line)) + sum(quality._STAY if a == b else quality._SWITCH for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(4), repeat=5), key=score)
    assert math.isclose(score(best), score(quality.label_lines(lines)))


def test_fitting_raises_the_likelihood_and_keeps_probabilities():
    rng = random.Random(3)
    texts = [[tuple(rng.choices(range(len(rows)), [r[k] ** 2 for r in rows])[0] for rows in quality._EMISSION.values()) for _ in range(rng.randrange(0, 12))] for k in (0, 1, 2, 3) for _ in range(60)]
    model, likelihood = quality.fitted(texts, rounds=6, weight=5.0)
    assert all(b > a - 1e-6 for a, b in zip(likelihood, likelihood[1:])) and likelihood[-1] > likelihood[0] + 0.05
    assert abs(sum(model.start) - 1) < 1e-9 and all(abs(sum(r[k] for r in rows) - 1) < 1e-9 for rows in model.emission.values() for k in range(4))
    right = [quality.label_lines(lines, model).count(k) * 2 > len(lines) for k in range(4) for lines in texts[60 * k : 60 * k + 60] if lines]
    assert sum(right) > 0.9 * len(right)
    assert quality.fitted([], rounds=2)[0].emission["end"] == [pytest.approx(r) for r in quality._EMISSION["end"]]


def test_fitting_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 3)
    rows = [(i, PROSE[i % len(PROSE)]) for i in range(9)] + [(20, None), (21, ""), (22, " \n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality.fitted_on(df)
    assert model.emission != quality.STATED.emission
    assert quality.fitted_on(df.limit(0)) is quality.STATED
    assert all(r.prose_share > 0.5 for r in quality.quality(df.filter("doc_id < 9"), model=model).collect())


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    import itertools
    import math

    import numpy as np

    rng = random.Random(5)
    model = quality.STATED
    texts = [[rng.randrange(len(quality._BINS)) for _ in range(n)] for n in (2, 0, 4, 1, 3, 0, 4)]
    start, by_number, likelihood = np.zeros(4), np.zeros((len(quality._BINS), 4)), 0.0
    for text in filter(None, texts):
        paths = {}
        for path in itertools.product(range(4), repeat=len(text)):
            moves = sum(quality._STAY if a == b else quality._SWITCH for a, b in zip(path, path[1:]))
            paths[path] = math.exp(model.log_start[path[0]] + moves + sum(model.emit(quality._BINS[x])[k] for x, k in zip(text, path)))
        whole = sum(paths.values())
        likelihood += math.log(whole)
        for path, p in paths.items():
            start[path[0]] += p / whole
            for x, k in zip(text, path):
                by_number[x, k] += p / whole
    numbers, lengths = np.array([x for t in texts for x in t]), np.array([len(t) for t in texts])
    got = quality._sums(numbers, lengths, model)
    assert got[:2].tolist() == [5, 14]
    assert got[2:] / quality.UNIT == pytest.approx(np.concatenate([[likelihood], start, (quality._HAS @ by_number).ravel()]), abs=1e-5)
    for lines, few in itertools.product((1, 5, 100), (0, 1, 2, 3, 12)):
        monkeypatch.setattr(quality, "LINES", lines)
        monkeypatch.setattr(quality, "FEW", few)
        assert (quality._sums(numbers, lengths, model)[3:] == got[3:]).all()


def test_every_text_of_a_table_counts_for_the_model(spark):
    n = 2_000 + 800
    text = lambda i: (PROSE + OTHER)[i * 7 % len(PROSE + OTHER)]
    df = spark.createDataFrame([(i, text(i)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, " ")], "doc_id bigint, text string")
    bins = [[quality.line_bins(*x)[0] for x in quality._lines(text(i))] for i in range(n)]
    model = quality.fitted_on(df)
    whole = quality.fitted(bins, weight=2_000.0 * n / 2_000)[0]
    assert model.start == whole.start and model.emission == whole.emission
    again = quality.fitted_on(df.repartition(7))
    assert again.start == model.start and again.emission == model.emission
