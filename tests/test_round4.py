"""What the findings of the fourth round asked for."""


def test_matched_ratio_is_difflibs():
    """Texts of few and of many letters, below and above the length where difflib leaves out frequent ones."""
    import difflib
    import random

    from tallyforge.operators.similarity import _Matched

    rng = random.Random(11)
    letters = ["ab", "abcdefghij ", "".join(map(chr, range(97, 123))) + "   eeettaaXYZ0123^-]\\[\n", "".join(map(chr, range(0x4E00, 0x4E80)))]
    for n in range(240):
        of = letters[n % 4]
        a = "".join(rng.choices(of, [1 / (k + 1) for k in range(len(of))], k=rng.choice((0, 3, 199, 200, 201, 700))))
        b = a
        for _ in range(rng.choice((0, 1, 6, 40))):
            k = rng.randint(0, len(b))
            b = rng.choice((b[:k] + rng.choice(of) + b[k:], b[:k] + b[k + 3 :], b[k:] + b[:k]))
        want = round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
        assert _Matched(b).ratio(a, 0.0) == want and _Matched(b).ratio(a, 0.97) == (want if want >= 0.97 else None)


def test_near_texts_stay_in_their_task(spark, tmp_path, monkeypatch):
    """What is kept between steps doesn't grow with the pairs that bounds alone can't tell apart."""
    import random
    from pathlib import Path

    from tallyforge.operators import similarity

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(40)]
    # the same words in other orders: counts of characters are all the same, no two are alike
    rows = [(i, " ".join(rng.sample(words, 40)), i % 2) for i in range(120)]
    rows += [(200, rows[0][1][:-1] + "Z", 1)]
    df = spark.createDataFrame(rows, "id int, text string, side int")
    kept = []
    table = similarity.Scratch.table
    monkeypatch.setattr(similarity.Scratch, "table", lambda self, x, name: kept.append(table(self, x, name)) or kept[-1])
    members, pairs = similarity.near_classes(df, 0.97, None, "side")
    assert [(r.id_a, r.id_b) for r in pairs.collect()] == [(0, 200)]
    assert members.count() == len(rows) and max(x.count() for x in kept) == len(rows)


def test_failure_labels_score_what_labels_look_at(spark, monkeypatch):
    """A candidate is scored where its strategy's labels turn on it, and only as far as they do; labels are those of all scores."""
    import pandas as pd

    from tallyforge.functions import outputs
    from tallyforge.operators import failures

    gold = '{"answerable":true,"answer":"a","evidence":["e1"]}'
    given = '{"evidence_units":[{"id":"e1","text":"a"}]}'
    qa = '{"answer":"%s","citations":["e1"],"abstain":false,"confidence":0.5}'
    right, wrong = qa % "a", qa % "b"
    rows = [
        (s, output, c) for s in ("single_agent", "critic_reviser", "multi_agent_debate", "adaptive_router", None) for output in (right, wrong, "no object", None)
        for c in ([wrong, wrong, right], [right, wrong, wrong], [wrong, None], [wrong], [], None)
    ]
    frame = pd.DataFrame(rows, columns=["strategy", "output", "candidates"])
    seen, score = [], outputs.qa_values
    monkeypatch.setattr(outputs, "qa_values", lambda i, g, x: seen.append(x) or score(i, g, x))
    n = len(frame)
    found = failures._facts.func(*(pd.Series([x] * n) for x in ("grounded_qa", given, gold, '{"tags":[]}')), frame["output"], pd.Series([False] * n), frame["strategy"], frame["candidates"])
    # 60 outputs that are objects, 32 first candidates and 5 for each of three flawed debates; 160 candidates are objects
    assert len(seen) == 60 + 32 + 15
    for (s, output, c), r in zip(rows, found.itertuples(), strict=True):
        scores = [outputs.evaluate("grounded_qa", *map(outputs.loads, (given, gold)), {"tags": []}, x)["task_score"] for x in (output, *(c or ()))]
        assert r.total == scores[0] and r.invalid == (output not in (right, wrong))
        if s == "multi_agent_debate" and r.total < 1:
            assert r.one_right == any(x >= 1 for x in scores[1:])
        if s in ("critic_reviser", "adaptive_router"):
            assert r.first == scores[1] if c else pd.isna(r.first)
    for task, g, x in (
        ("structured_extraction", '{"expected":{"n":1,"d":"2020-01-02"},"json_schema":{"properties":{"n":{"type":"integer"},"d":{"type":"string","format":"date"}}}}', '{"n":"1","d":"2020/1/2"}'),
        ("business_summarization", '{"summary":"s","decisions":["a","b"],"risks":["r","q","p"],"supported_facts":["a","z","y"]}', '{"summary":"t","decisions":["A"],"risks":["q"],"action_items":[]}'),
    ):
        assert outputs.task_score(task, {}, outputs.loads(g), outputs.loads(x)) == outputs.evaluate(task, {}, outputs.loads(g), {}, x)["task_score"]
