import itertools
import math
import random

import pytest

from seekmill.functions import segment as sg
from seekmill.plans import catalogue

WORDS = {"增长": 50, "经济": 80, "经济增长": 30, "增": 5, "长": 9, "国": 20, "中国": 60, "国家": 30, "人": 40, "gdp": 7, "研究生": 12, "研究": 25, "生命": 18, "起源": 11, "大学生活动": 2}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq long")


@pytest.fixture(scope="module")
def model(spark):
    return sg.learn(frame(spark, WORDS))


def ways(text):
    """All divisions of a text."""
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(text[at:i])
                at = i
        yield [*out, text[at:]]


def test_the_path_is_the_most_probable_one(model):
    r = random.Random(1)
    total = sum(WORDS.values())
    for _ in range(300):
        text = "".join(r.choice("增长经济国中家人研究生命x") for _ in range(r.randrange(1, 9)))
        value = lambda w: math.log(WORDS[w] / total) if w in WORDS else model.floor if len(w) == 1 or (w == "x" * len(w)) else -math.inf

        def fits(way):  # a Latin run isn't cut
            return all(not (a[-1] == "x" == b[0]) for a, b in zip(way, way[1:]))

        best = max(sum(map(value, way)) for way in ways(text) if fits(way))
        got = model.path(text)
        assert "".join(got) == text and sum(map(value, got)) == pytest.approx(best)


def test_states_against_all_sequences(model):
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("增长经济国中家人研究生命他") for _ in range(r.randrange(2, 7)))

        def score(states):
            if states[0] in (sg.MIDDLE, sg.END) or states[-1] in (sg.BEGIN, sg.MIDDLE) or any(b not in sg.FOLLOW[a] for a, b in zip(states, states[1:])):
                return -math.inf
            return model.start[states[0]] + sum(model.shown[s].get(c, sg.UNSEEN) for s, c in zip(states, text)) + sum(model.follow[a, b] for a, b in zip(states, states[1:]))

        best = max(map(score, itertools.product(range(4), repeat=len(text))))
        assert score(model.states(text)) == pytest.approx(best)


def test_probabilities_are_those_of_the_dictionary(model):
    single = sum(f for w, f in WORDS.items() if len(w) == 1)
    total = sum(WORDS.values())
    longer, inside = sum(f for w, f in WORDS.items() if len(w) > 2), sum(f * (len(w) - 3) for w, f in WORDS.items() if len(w) > 2)
    assert model.start[sg.SINGLE] == pytest.approx(math.log(single / total)) == model.follow[sg.END, sg.SINGLE]
    assert model.follow[sg.BEGIN, sg.MIDDLE] == pytest.approx(math.log(longer / (total - single)))
    assert model.follow[sg.MIDDLE, sg.MIDDLE] == pytest.approx(math.log(inside / (inside + longer)))
    assert all(sum(map(math.exp, s.values())) == pytest.approx(1) for s in model.shown)


def test_words_outside_the_dictionary_are_found(model):
    assert model.cut("中国经济增长 GDP增长 3.5") == ["中国", "经济增长", "GDP", "增长", "3", ".", "5"]
    assert model.cut("研究生命起源") == ["研究", "生命", "起源"]
    assert model.cut("") == [] and model.cut(" \n") == [] and model.cut("。，") == ["。", "，"]
    loose = model.cut("中增")  # begins a word, and stands alone or begins one
    assert "".join(loose) == "中增"
    unknown = model.cut("他们来到了杭研大厦")
    assert "".join(unknown) == "他们来到了杭研大厦" and len(unknown) < 9


def test_odd_dictionaries_and_columns(spark):
    with pytest.raises(ValueError, match="MB"):
        sg.learn(frame(spark, WORDS), 100)
    none = sg.learn(frame(spark, {"x": 1}).limit(0))
    assert none.cut("中国 ab") and "".join(none.cut("中国ab")) == "中国ab"
    twice = spark.createDataFrame([("中国", 1), ("中国", 2), ("", 5), (None, 5), ("国", 0)], "word string, freq long")
    assert sg.learn(twice).words == {"中国": 0.0, "中": None}
    tokens = sg.learned_tokens(frame(spark, WORDS))
    rows = spark.createDataFrame([(1, "中国经济"), (2, None), (3, "国 " * 5000)], "doc_id long, text string").select("doc_id", tokens("text").alias("t")).collect()
    assert {r["doc_id"]: len(r["t"]) for r in rows} == {1: 2, 2: 0, 3: 5000}


def test_query_keeps_all_characters(spark, sf):
    out = {}
    for r in catalogue.QUERIES["segment"](spark, sf).orderBy("doc_id", "pos").collect():
        out.setdefault(r["doc_id"], []).append(r["word"])
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lower(text) text").collect()
    assert all("".join(out.get(d["doc_id"], [])) == "".join((d["text"] or "").split()) for d in docs)


def test_a_dictionary_of_any_size(spark, monkeypatch):
    long = "ab" * 15000
    words = {**WORDS, long: 3, long + "c": 2, "中国" * 40: 4, "他们来到": 3}
    texts = ["中国经济增长 GDP增长 3.5", None, "", " \n", f"x{long}c {long}", "研究生命起源他们来到了杭研大厦", "中国" * 41 + "，大学生活动中" * 3, "gdp大学生活动x"]
    df = spark.createDataFrame([*enumerate(texts), (0, "国家")], "doc_id long, text string")
    with pytest.raises(ValueError, match="MB"):
        sg.learn(frame(spark, words))
    small = {w: f for w, f in words.items() if len(w) < 1000}
    monkeypatch.setattr(sg, "CHUNK", 5)
    for batch in (16 << 20, 40):
        model = sg.learn(frame(spark, small))
        want = sorted((i, model.cut(t or "")) for i, t in [*enumerate(texts), (0, "国家")])
        assert sorted((r["doc_id"], r["words"]) for r in sg.segmented(df, frame(spark, small), batch).collect()) == want
        got = {r["doc_id"]: r["words"] for r in sg.segmented(df.where("doc_id > 3"), frame(spark, words), batch).collect()}
        assert got[4] == [f"x{long}c", long]  # one unknown run is more probable than one beside a word
    assert sg.segmented(df.limit(0), frame(spark, WORDS)).collect() == []
    none = frame(spark, WORDS).limit(0)
    assert [r["words"] for r in sg.segmented(df.where("doc_id = 7"), none).collect()] == [sg.learn(none).cut(texts[7])]


def test_a_piece_is_cut_once_for_all_batches(spark):
    """What is shuffled doesn't grow with batches times words, and odd pieces and spaces come back as they are cut whole."""
    r = random.Random(3)
    words = WORDS | {f"abcdefgh{i}": 2 + i % 7 for i in range(1000, 6000)} | {"été": 3, "the": 900, "_": 2, "a_b": 4}
    parts = ["the", "été,", "thethe", "a_b_", "ab9", "%%", "中国経済x", "x̂", "\U00020000国", "abcdefgh1234the", "ététhe.", "²三", "他们来到了"]
    gaps = [" ", "\n", "　", "\x1c", "\x85", " \t "]
    texts = [None, *("".join(r.choice(parts) + r.choice(gaps) + f"abcdefgh{r.randrange(1000, 1200)} " for _ in range(60)) for _ in range(100))]
    df, dictionary = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frame(spark, words)
    model = sg.learn(dictionary)
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
    sent = lambda: sum(executors().apply(i).totalShuffleWrite() for i in range(executors().size()))
    before = sent()
    got = {x["doc_id"]: x["words"] for x in sg.segmented(df, dictionary, 2000).collect()}
    assert sent() - before < 1 << 20
    assert got == {i: model.cut(t or "") for i, t in enumerate(texts)}
