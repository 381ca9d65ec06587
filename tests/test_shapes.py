"""Shape rules as joins against the same rules as a plain function, on random outputs and schemas."""

import json
import random

from pyspark.sql import functions as F

from tallyforge.functions import outputs
from tallyforge.operators import shapes

VALUES = [None, True, False, 0, 1, 7, 0.5, 1.0, 2.5, "", "x", "2024-01-05", "2024-13-05", "2024-02-30", "2024-1-5", "24-01-05", "a/b", [], ["e1"], [1], {}, {"a": 1}]
NAMES = ["answer", "confidence", "company", "a/b", "x~y", "d.e", "é"]


def some(rng, names, values=VALUES, p=0.7):
    return {n: rng.choice(values) for n in names if rng.random() < p}


def schema(rng):
    types = lambda: rng.choice(["string", "integer", "number", "boolean", "array", "object", "null", ["integer", "null"], ["string", "number"], []])
    spec = lambda: rng.choice([{"type": types()}, {"type": "string", "format": "date"}, {"type": ["string", "null"], "format": "date"}, {}, "no object", {"format": "date"}])
    out = {"type": "object", "properties": rng.choice([{n: spec() for n in NAMES if rng.random() < 0.6}] * 8 + [[], "x"])}
    if rng.random() < 0.7:
        out["required"] = rng.choice([[n for n in NAMES if rng.random() < 0.5], "answer"] if rng.random() < 0.2 else [[n for n in NAMES if rng.random() < 0.5]])
    if rng.random() < 0.7:
        out["additionalProperties"] = rng.choice([False, False, True, 0, 1, None, "", "no", {}, {"a": 1}, []])
    return out


def test_shapes(spark):
    rng, rows = random.Random(12), []
    for i in range(700):
        task = rng.choice(["grounded_qa", "robustness", "structured_extraction", "structured_extraction", "business_summarization", "other"])
        gold = {}
        if task == "structured_extraction":
            gold = rng.choice([{"json_schema": schema(rng)}] * 6 + [{"schema_required": ["answer", "d.e"]}, {}, {"json_schema": [], "schema_required": ["a/b"]}])
        names = {"structured_extraction": NAMES, "business_summarization": ["summary", "decisions", "risks"]}.get(task, ["answer", "citations", "abstain", "confidence"])
        output = some(rng, names)
        if task == "business_summarization" and rng.random() < 0.8:
            output["action_items"] = rng.choice([rng.choice(VALUES), [rng.choice([1, "x", None, some(rng, ["owner", "action", "deadline", "more"])]) for _ in range(rng.randint(0, 3))]])
        text = rng.choice([json.dumps(output, ensure_ascii=False)] * 12 + ["{", "[1]", "3", None, '"x"'])
        rows.append((i, task, json.dumps(gold, ensure_ascii=False), text))
    df = spark.createDataFrame(rows, "i int, task_type string, gold string, output string")
    want = []
    for i, task, gold, text in rows:
        value = outputs.loads(text)
        want += [(i, x) for x in (outputs.output_issues(task, json.loads(gold), value) if isinstance(value, dict) else ["output_must_be_object"])]
    got = [tuple(r) for r in shapes.output_issues(df, ["i"]).collect()]
    assert sorted(got) == sorted(want), (sorted(set(got) - set(want))[:5], sorted(set(want) - set(got))[:5])
    assert len({x.split(":")[-1].split()[0] for _, x in want}) > 12
    assert shapes.output_issues(df.limit(0), ["i"]).isEmpty() and shapes.output_issues(df.where(F.col("task_type") == "other").where("output like '{_%'"), ["i"]).isEmpty()
