"""Operators 11 to 13 on small hard tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import balance, infill, negatives, packing, queries, rope
from tallyforge.storage import Scratch

DIR = "/root/testdata/sf0.001"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty, long, repeated texts, sentinels, ids that are null or repeat, columns with clashing names."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab é🙂 \n\t<PSM>", k=rng.randint(0, 300))) for _ in range(150)]
    texts += [None, "", " ", "\n \x1c", "one", "word " * 30_000, "x" * 50_000, "a <P> b", "a <M", "P> c", "tail  \t ", "<|endoftext|> x", "a" * 9000 + " b"]
    rows = [(k if k % 11 else None, x) for k, x in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (2**63 - 1, texts[6]), (-3, texts[7])]
    return spark.createDataFrame([(i, x, "o", 1, "f", 9) for i, x in rows], "doc_id long, text string, output string, n int, form string, ids int").repartition(3)


def bag(rows):
    return sorted(map(repr, rows))


def bits(i):
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def plain_infill(i, text):
    text = text or ""
    units = re.findall(UNIT, text)
    a, b, c, d = bits(i)
    if not text or re.search("<[PSM]>", text) or c % 100 >= 50:
        return (i, len(units), "plain", None, None, text, text)
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, len(units), form, len(p), len(m), out, text)


def test_infill(hard):
    got = infill.fill_in_middle(hard)
    want = [plain_infill(r.doc_id, r.text) for r in hard.collect()]
    assert bag(map(tuple, got.collect())) == bag(want) and {x[2] for x in want} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(hard.limit(0)).isEmpty()


def balanced_tree(x):
    if x.left is None:
        return x.height == 0
    sums = x.units == x.left.units + x.right.units and x.chars == x.left.chars + x.right.chars
    return sums and abs(x.left.height - x.right.height) <= 1 and balanced_tree(x.left) and balanced_tree(x.right)


def test_ropes():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices("ab é🙂 \n\t<PSM>", k=rng.randint(0, 400)))
        units, x = re.findall(UNIT, text), rope.build(text, rng.choice([1, 2, 7, 50]))
        assert rope.text_of(x) == text and (x.units, x.chars) == (len(units), len(text)) and balanced_tree(x)
        k = rng.randint(0, len(units))
        a, b = rope.split_units(x, k)
        assert rope.text_of(a) == "".join(units[:k]) and rope.text_of(b) == "".join(units[k:]) and balanced_tree(a) and balanced_tree(b) and a.units == k
        k = rng.randint(0, len(text))
        a, b = rope.split_chars(x, k)
        assert rope.text_of(a) == text[:k] and rope.text_of(rope.concat(b, a)) == text[k:] + text[:k] and balanced_tree(rope.concat(b, a))
        whole, form, *_, out = infill.transform(text, [rng.getrandbits(32) for _ in range(4)], 100, 50)
        assert infill.restore(out, form) == text


def test_balanced_sizes():
    rng = random.Random(2)
    for _ in range(150):
        length = rng.choice([4, 16, 64, 2048])
        sizes = [rng.randint(1, length * rng.choice([1, 1, 3])) for _ in range(rng.randint(0, 100))]
        rows = balance.balanced(sizes, length)
        seen = defaultdict(int)
        for row in rows:
            held = sum(n for *_, n in row)
            assert held == length or held & (held - 1) == 0 and held < length
            for i, at, n in row:
                for k in range(at, at + n):
                    seen[i, k] += 1
        assert len(seen) == sum(sizes) and set(seen.values()) <= {1}
    sizes = [min(700, int(rng.lognormvariate(4.5, 1.0)) + 1) for _ in range(6000)]

    def spread(rows):
        return np.std([sum(balance.cost(n) for *_, n in r) for r in rows if sum(n for *_, n in r) > 2000])

    assert spread(balance.balanced(sizes)) < spread(packing.best_fit(sizes, 2048)) / 4


def test_least_cost_with_room():
    rng, tree, open_rows = random.Random(3), balance.Open(16), {}
    for k in range(600):
        if rng.random() < 0.55:
            open_rows[k] = (rng.randint(1, 16), rng.randint(0, 9))
            tree.put(open_rows[k][0], open_rows[k][1], k)
        least = rng.randint(1, 16)
        want = min(((c, k, room) for k, (room, c) in open_rows.items() if room >= least), default=None)
        assert tree.take(least) == want
        if want:
            del open_rows[want[1]]


def check_packing(pieces, wanted):
    """Every id once, sequences gapless and full or a power of two."""
    ids, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.length == len(r.ids) // 4 > 0
        ids[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.sequence_length == sum(x.length for x in rows)
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
        assert rows[0].sequence_cost == sum(balance.cost(x.length) for x in rows)
    for (i, n), rows in ids.items():
        texts = [x for x in wanted if x[0] == i and len(x[1]) == 4 * n]
        assert len(texts) == sum(r.length for r in rows) // n
        got = sorted((r.start, bytes(r.ids)) for r in rows)
        assert got == sorted((r.start, texts[0][1][4 * r.start : 4 * (r.start + r.length)]) for r in rows) if len(set(texts)) == 1 else got
    assert sum(r.length for r in pieces) == sum(len(x[1]) // 4 for x in wanted)


def test_packing_by_cost(hard):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    wanted = [(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in hard.collect()]
    for pool in (balance.POOL, 5000):
        check_packing(balance.pack_balanced(hard, path, pool=pool).collect(), wanted)
    assert balance.pack_balanced(hard.limit(0), path).isEmpty()


def test_packing_query(spark):
    got = queries.op12_balanced_packing(spark, DIR)
    pieces = balance.pack_balanced(queries.documents(spark, DIR), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.ids_crc32 for r in got.collect()} == {zlib.crc32(r.ids) for r in pieces}
    assert got.count() == got.select("doc_id", "start").distinct().count()


def test_table_of_words(monkeypatch):
    codec = balance.JsonCodec(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(balance, "PIECES", 50)
    monkeypatch.setattr(balance, "PORTION", 40)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcé🙂.,\n'<|>", k=rng.randint(1, 40))).strip("\n") or "x" for _ in range(300)]
    for _ in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 200)))
        assert codec.encode(text) == np.array(codec.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plain_negatives(rows, is_anchor, positives, negatives_, low, high):
    rows = [(k, i, y, [int(np.floor(256 * np.float64(v))) for v in x]) for k, (i, x, y) in enumerate(rows) if y is not None and x is not None and all(v is not None and np.isfinite(v) and np.isfinite(256 * np.float64(v)) for v in x)]
    out = []
    for k, i, y, x in rows:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, x2, strict=False)), i2 is None, i2 or 0, k2, y2) for k2, i2, y2, x2 in rows if k2 != k]
        scored.sort()
        for s, none, i2, _, _ in [r for r in scored if r[4] == y][:positives]:
            fit = [r for r in scored if r[4] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives_]
            out += [(i, None if none else i2, n, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("size, digit, least", [(1.0, 9, 512), (1.0, 2, 8), (1e-2, 9, 8), (100.0, 9, 16), (3e5, 9, 16)])
def test_negatives(spark, monkeypatch, size, digit, least):
    """Small, large and huge numbers; ties, equal rows, nulls, vectors of other lengths, ids that repeat."""
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "LEAST", least)
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 1) * size for _ in range(6)], rng.randrange(3)) for k in range(120)]
    common = [abs(rng.gauss(0, 1)) * size for _ in range(6)]
    rows += [(200 + k, common, k % 3) for k in range(60)] + [(200, common, 0), (None, common, 1), (None, common, 1)]
    rows += [(300, None, 1), (301, common, None), (302, [None, 1.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 2), (305, [], 1), (310, common[:3], 2), (320, [0.0] * 6, 0)]
    table = spark.createDataFrame([(*r, "?", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, g int").coalesce(1)
    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert bag(map(tuple, got.collect())) == bag(plain_negatives(rows, lambda i: i is not None and i % 10 == 0, 5, 3, 50, 95))


def test_negatives_of_little(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    anchor = F.col("vec_id") % 2 == 0
    assert [tuple(r) for r in negatives.hard_negatives(table, anchor).collect()] == [(0, 1, 1, 2, 5 << 16, 3 << 16)]
    assert negatives.hard_negatives(table.limit(0), anchor).isEmpty() and negatives.hard_negatives(table, F.lit(False)).isEmpty()


def test_scores_beyond_a_long(spark):
    """Products that no long holds are held at the bound."""
    x = [3e20, 1.0]
    table = spark.createDataFrame([(0, x, 1), (1, x, 1), (2, [-3e20, 1.0], 1), (3, [1.0, 1.0], 0)], "vec_id long, embedding array<double>, label int").coalesce(1)
    keep = Scratch(spark, "test")
    rows = keep.table(negatives.prepare(table), "rows").withColumn("g", F.lit(0))
    anchors = rows.where("vec_id = 0").select("key", "vec_id", "label", "q")
    want = anchors.select(F.col("key").alias("anchor"), F.lit(0).alias("slot"), F.lit(-negatives.LIMIT).alias("lo"), F.lit(negatives.LIMIT).alias("hi"), F.lit(2).alias("need"))
    top = negatives.select(keep, "t", rows, anchors, want, 1, 2, negatives.LIMIT, 2 * negatives.LIMIT, True)
    assert [(r.vec_id, r.score) for r in top.orderBy("rank").collect()] == [(1, negatives.LIMIT), (2, -negatives.LIMIT)]


def test_no_pair_is_shuffled(spark):
    """Rows that leave a task are bounded by windows and groups, not by pairs."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(size=4)], k % 4) for k in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    keep = Scratch(spark, "test")
    own = keep.table(negatives.prepare(table), "rows").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(4)).cast("int"))
    anchors = own.where("vec_id % 50 = 0").select("key", "label", "q")
    one = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-(10**9)).cast("long").alias("lo"), F.lit(10**9).cast("long").alias("hi"), F.lit(5).alias("need"), F.lit(22).alias("shift")))
    counted = negatives._meet(own, anchors.withColumn("windows", one), 4, 4, 1 << 30, True, negatives._count, negatives._COUNTED)
    assert counted.count() <= 40 * 4 * 5 and counted.agg(F.sum("n")).first()[0] >= 40 * 4 * 5


def test_two_pipelines_at_once(spark, tmp_path):
    """Each thread's stages delete their own tables only."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline

    for k in range(2):
        queries.documents(spark, DIR).where(F.col("doc_id") % 2 == k).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda k: bag(corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()), range(2)))
    assert both == [bag(corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()) for k in range(2)] and all(both)
