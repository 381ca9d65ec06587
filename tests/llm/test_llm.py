"""The ten operators on small tables, against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyforge import storage
from tallyforge.llm import blindtrie, bpe, exact_dedup, fingerprint, langid, mixing, ngram_join, packing, packs, pii, queries, secrets, spans, substring_dedup

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty, long, repeated and clashing rows."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = [(i, x) for i, x in enumerate(base)]
    for i, x in enumerate(base[:25]):
        w = x.split()
        w[rng.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, x + "\n"))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "A"), (304, "a "), (305, base[0] * 200), (306, "aaaa" * 300), (306, "aaaa" * 300), (307, "🙂 x  y z"), (None, base[1]), (None, None)]
    rows += [(2**63 - 1, base[1] + "\t"), (2**63 - 1, base[2] + " x"), (None, base[2] + " x")]
    return spark.createDataFrame([(i, x, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 4}", 0, "?") for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, name string").repartition(3)


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    other = con.sql(queries.SQL[name])
    cols = sorted(other.columns)
    assert set(cols) <= set(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[other.columns.index(c)] for c in cols) for r in other.fetchall()), key=str)


def test_mix(hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == hard.count() and all(r.mix_copies in (int(r.mix_rate), int(r.mix_rate) + 1) and r.mix_rate <= 3 for r in rows)
    assert sum({r.source: r.mix_target for r in rows}.values()) == pytest.approx(sum(r.mix_size for r in rows))
    assert mixing.emit(mixing.mix(hard)).columns == hard.columns and mixing.mix(empty).isEmpty()


def test_equal_rows_without_ids_draw_for_themselves(spark, tmp_path, monkeypatch):
    """Two sources of 2,000 equal rows each, ids missing or all the same; weights 1 and 2 of 6,000 words each."""
    monkeypatch.setattr(mixing, "COPIES", 300)
    rows = [(i, "one two three", source) for source, i in (("a", None), ("b", 7)) for _ in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    first, again = (queries.op1_mix_sources(spark, str(tmp_path)) for _ in range(2))
    got = {r.target: (r.n, r.taken, r.most) for r in first.groupBy("target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).collect()}
    assert {t: n for t, (n, _, _) in got.items()} == {4000.0: 2000, 8000.0: 2000} and all(abs(x - t) < 0.05 * t and most <= 9 for t, (_, x, most) in got.items())
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    other = con.sql(queries.SQL["op1_mix_sources"])
    assert sorted((r.doc_id or 0, r.taken) for r in first.collect()) == sorted((r[other.columns.index("doc_id")] or 0, r[other.columns.index("taken")]) for r in other.fetchall())


def plain_likeness(a, b):
    """Of two fingerprints, from the sets of their names."""
    if a == b or not a or not b:
        return float(a == b)

    def share(x, y, k):
        if not x or not y:
            return float(x == y)
        both = sorted(x | y)[: k if max(len(x), len(y)) >= k else None]
        return len([n for n in both if n in x & y]) / len(both)

    (ua, la), (ub, lb) = ([set(re.findall("[0-9a-f]{8}", part)) for part in f.split(".")] for f in (a, b))
    return 0.75 * share(ua, ub, 48) + 0.25 * share(la, lb, 16) if ua or ub else share(la, lb, 16)


def test_fingerprints(hard, empty):
    rows = sorted(((r.doc_id is None, -(r.doc_id or 0), r.h, r.doc_id, r.text or "") for r in hard.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()))
    want = []
    for k, (*_, i, x) in enumerate(rows):
        y = rows[(k + 1) % len(rows)][4]
        third = len(x) // 3
        e = "".join(c for n, c in enumerate(x) if n < len(x) - third) + y[:third]
        own, other, after = fingerprint.fingerprints([x, e, y])
        want.append((i, len(x), hashlib.sha256(e.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, after)))
    got = fingerprint.fingerprint_documents(hard).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and fingerprint.fingerprint_documents(empty).isEmpty()
    a, b = "".join(random.Random(2).choices("abcdefgh ", k=4000)), "".join(random.Random(3).choices("abcdefgh ", k=4000))
    fa, fb, fc = fingerprint.fingerprints([a, b, "shift " + a[:3000] + b[:1000]])
    assert fingerprint.likeness(fa, fc) > 0.4 > 0.1 > fingerprint.likeness(fa, fb)


def test_cuts(spark):
    cuts = list(range(-50, 400, 7))
    df = spark.range(-60, 420).select(F.col("id"), *[fingerprint._cuts_up_to(cuts, F.col("id"), k).alias(f"n{k}") for k in (2, 10, 1000)], fingerprint._cuts_up_to([], F.col("id")).alias("none"))
    assert all(r.n2 == r.n10 == r.n1000 == sum(c <= r.id for c in cuts) and r.none == 0 for r in df.collect())


@pytest.mark.parametrize("n, num, den, block, leaders, pack", [(3, 90, 100, 512, 64, 1 << 24), (5, 80, 100, 512, 64, 1 << 24), (2, 60, 100, 3, 2, 500), (1, 50, 100, 4, 3, 4000)])
def test_ngram_join(hard, empty, n, num, den, block, leaders, pack):
    rows = texts(hard)
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(lambda: None)
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None and (least[g] is None or i < least[g]):
            least[g] = i
    want = sorted(((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=str)
    assert sorted(map(tuple, ngram_join.ngram_join(hard, n, num, den, block, leaders, pack).collect()), key=str) == want
    assert ngram_join.ngram_join(empty).isEmpty()


def test_ngram_join_of_texts_made_of_the_same_passages(spark):
    # every text shares most of its shingles with others, few texts link: one block, cut by leaders and sizes
    rng = random.Random(12)
    passages = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(14)]
    rows = [(i, " ".join(rng.sample(passages, rng.choice((4, 5, 8))))) for i in range(70)]
    rows += [(100 + i, x + f" end{i % 2}") for i, x in rows[:20]]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in rows for w in [x.split()]}
    low = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.ngram_join(df, 3, 90, 100, block=8, leaders=3, pack=2000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), low[i]) for i in sets}
    assert 20 <= sum(i != g for i, g in low.items()) < len(rows) - 20


def test_size_classes():
    for num, den in ((90, 100), (80, 100), (60, 100), (1, 2)):
        band = ngram_join._size_class(np.arange(1, 3000), num, den)
        for a in range(1, 1000):
            # the largest set that a set of a can link with
            assert band[a * den // num - 1] - band[a - 1] <= 1


@pytest.mark.parametrize("width", [1, 32])
def test_exact_dedup(hard, empty, width):
    groups = defaultdict(list)
    for i, x in texts(hard):
        groups[re.sub(r"[\x20\x09-\x0D]", "", x)].append((-len(x), i is None, i or 0, i))
    want = []
    for plain, rows in groups.items():
        best = min(rows)
        want += [(r[3], best[3], len(rows), r[3] == best[3] and r[0] == best[0], hashlib.sha256(plain.encode()).hexdigest(), -r[0]) for r in rows]
    assert sorted(map(tuple, exact_dedup.exact_dedup(hard, width).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).isEmpty()


def test_best_fit():
    rng = random.Random(8)
    for length in (1, 7, 64):
        for _ in range(60):
            sizes = [rng.choice([0, 1, rng.randint(1, length), rng.randint(1, 3 * length)]) for _ in range(rng.randint(0, 40))]
            pieces = sorted(((min(length, n - at), i, at) for i, n in enumerate(sizes) for at in range(0, n, length)), key=lambda p: (-p[0], p[1], p[2]))
            rooms = []
            for size, _, _ in pieces:  # the naive form looks at every open row
                fits = [k for k, room in enumerate(rooms) if room >= size]
                if fits:
                    rooms[min(fits, key=lambda k: rooms[k])] -= size
                else:
                    rooms.append(length - size)
            rows = packing.best_fit(sizes, length)
            assert sorted(length - sum(s for _, _, s in row) for row in rows) == sorted(rooms)
            assert sorted((s, i, at) for row in rows for i, at, s in row) == sorted(pieces)


def test_packing(hard, empty):
    ids = bpe.encode(hard, *queries.byte_bpe())
    back = defaultdict(lambda: defaultdict(list))
    for r in packing.pack(ids, length=64, shards=3).collect():
        flat, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(flat) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and not flat[r.n_tokens :].any()
        for d, o, lo, hi in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert place[lo:hi].tolist() == list(range(hi - lo))
            back[d][o].append(tuple(flat[lo:hi].tolist()))
    want = defaultdict(lambda: defaultdict(list))
    for r in ids.collect():  # of rows that share an id, or have none, as many segments begin at each offset
        flat = np.frombuffer(r.token_ids, "<u4").tolist()
        for o in range(0, len(flat), 64):
            want[r.doc_id][o].append(tuple(flat[o : o + 64]))
    assert {d: {o: sorted(x) for o, x in v.items()} for d, v in back.items()} == {d: {o: sorted(x) for o, x in v.items()} for d, v in want.items()}
    assert packing.pack(ids, length=64).count() and packing.pack(bpe.encode(empty, *queries.byte_bpe())).isEmpty()


def all_taggings(n):
    return [y for y in itertools.product(range(3), repeat=n) if all(t != 2 or (k and y[k - 1] in (1, 2)) for k, t in enumerate(y))]


def test_field_against_all_taggings():
    rng = np.random.default_rng(4)
    feats = [["a", "b"], ["b"], ["c", "a"], ["c"], ["b", "d"]]
    field = secrets.Field()
    field.names = {x: i for i, x in enumerate("abcd")}
    field.w, field.t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    field.w[-1] = 0

    def score(w, t, x, y):
        around = [0, *y, 0]
        return sum(w[[field.names[f] for f in fs], tag].sum() for fs, tag in zip(x, y, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(around))

    for n in range(1, 6):
        x = feats[:n]
        assert tuple(field.tags(x)) == max(all_taggings(n), key=lambda y: score(field.w, field.t, x, y))

    def likelihood(w, t):
        return sum(score(w, t, x, y) - np.log(sum(np.exp(score(w, t, x, z)) for z in all_taggings(len(x)))) for x, y in chains)

    chains = [(feats[:3], (0, 1, 2)), (feats[1:], (1, 2, 0, 1)), (feats[:1], (1,))]
    ids, tag = np.full((3, 4, 2), 4), np.zeros((3, 4), int)
    for i, (x, y) in enumerate(chains):
        tag[i, : len(y)] = y
        for j, fs in enumerate(x):
            ids[i, j, : len(fs)] = [field.names[f] for f in fs]
    gw, gt = field._gradient(field.w, field.t, ids, tag, np.array([3, 4, 1]))
    step = 1e-5
    for k in np.ndindex(4, 3):
        up, down = field.w.copy(), field.w.copy()
        up[k] += step
        down[k] -= step
        assert gw[k] == pytest.approx((likelihood(up, field.t) - likelihood(down, field.t)) / (2 * step), abs=1e-5)
    for k in np.ndindex(3, 3):
        up, down = field.t.copy(), field.t.copy()
        up[k] += step
        down[k] -= step
        assert gt[k] == pytest.approx((likelihood(field.w, up) - likelihood(field.w, down)) / (2 * step), abs=1e-5)


def plain_secrets(text):
    out = []
    for k, (kind, pattern, least) in enumerate((("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if len(m[2] if k == 0 else m[0]) >= least]
    return ",".join(x for _, _, x in sorted(out))


def test_base_secrets_fuzzed(spark):
    rng = random.Random(9)
    parts = ["password", "PassWd", "api_key", "apikey", "secret", "token", "=", ":", " ", '"', "'", "abcdefgh", "abc", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "é🙂", "\n", "ſecret", "K"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(1500)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.Field()).select("doc_id", *spans.digest_columns("spans", secrets.KINDS))
    got = {r.doc_id: r.spans for r in got.collect()}
    assert got == {i: plain_secrets(x) for i, x in rows}


def test_secrets_that_the_field_adds(spark, hard):
    rng = random.Random(10)
    words = "the build of last week uses a new server and we keep it in the vault for now".split()
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12)))
    value = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(16, 28)))
    train = [(None, f'{prose()} {rng.choice(["password", "token", "api_key"])} = "{value()}" {prose()}') for _ in range(200)] + [(1, f"{prose()} build {rng.randint(1, 999)} {prose()}") for _ in range(200)]
    field = secrets.train(spark.createDataFrame([*train, *train], "doc_id long, text string"))
    planted, found, right = 0, 0, 0
    for _ in range(200):
        v, word = value(), rng.choice(["password", "token", "secret"])
        text = f"{prose()} {word} is {v} {prose()}"
        got = secrets.added_spans(text, field, secrets.base_spans(text))
        planted, found, right = planted + 1, found + len(got), right + sum(text[a:b] == v for _, a, b in got)
        clean = f"{prose()} release {rng.randint(1, 10**6)} {prose()} token of {prose()}"
        found += len(secrets.added_spans(clean, field, secrets.base_spans(clean)))
    assert right >= 0.9 * planted and right >= 0.95 * found
    # bounds hold by rows and by size, and all rows without an id still teach
    assert len(secrets.train(spark.createDataFrame(train, "doc_id long, text string"), sample=5, chains=2).w)


def test_secrets(spark, empty):
    rows = [(i, f'word here token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and more {i}' if i % 2 else f"nothing {i} to find password short=abc") for i in range(80)] + [(90, None), (91, "AKIA" + "Z" * 12), (92, "PASSWORD:abcdefg Passwd='abcdefgh"), (93, "my token " + hashlib.sha1(b"x").hexdigest()[:31] + " is"), (94, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df, secrets.train(df.where("doc_id < 90"))).select("doc_id", *spans.digest_columns("spans", secrets.KINDS)).collect()}
    assert got[1].n_assign == got[1].n_hex == 1 and got[2].spans == "" and got[90].spans == "" and got[94].spans == ""
    assert got[91].spans == "access:0:16" and got[92].n_assign == 1 and "crf" in got[93].spans
    assert secrets.find_secrets(empty, secrets.Field()).isEmpty() and not len(secrets.train(empty).w)


def test_language(spark, hard, empty):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    rows = langid.predict(docs, model).where(langid.held_out("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.predict(hard, model).collect()}
    assert odd[300] == odd[301] == odd[302] == "und" and langid.predict(empty, langid.train(empty)).isEmpty()
    code = langid.codewords(40)
    assert len({tuple(x) for x in code}) == 40
    for r in docs.orderBy("doc_id").limit(60).collect():  # decoding against a plain loop over codewords
        x = langid.features(r.text)
        if x is None:
            continue
        margin = [sum(float(v) * float(w) for v, w in zip(x[x > 0], model.w[x > 0, b], strict=True)) + float(model.b[b]) for b in range(model.code.shape[1])]
        sure = [abs(math.tanh(m / 2)) + 1e-6 for m in margin]
        loss = [sum(s * math.log1p(math.exp(-c * m)) for c, m, s in zip(word, margin, sure, strict=True)) / sum(sure) for word in model.code]
        p = [math.exp(-len(margin) * (v - min(loss))) for v in loss]
        order = sorted(range(len(p)), key=lambda k: loss[k])
        lang, score, ambiguous, _ = model.predict(r.text)
        assert lang == model.langs[order[0]] and score == pytest.approx(p[order[0]] / sum(p), rel=1e-3)
        assert ambiguous == (p[order[0]] < 2 * p[order[1]]) or abs(p[order[0]] / p[order[1]] - 2) < 1e-2


def test_minimizers_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 700, 130, 2000, 51)]
    p, seen = packs.Pack(0, np.arange(7), np.zeros(7, bool), texts), []
    for size in (1 << 20, 200, 77):
        monkeypatch.setattr(substring_dedup, "SLICE", size)
        seen.append({(w, int(k), int(t)) for a, b, k, t in zip(*substring_dedup._runs(p), strict=True) for w in range(a, b + 1)})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == sum(max(0, len(t) - 49) for t in texts)


@pytest.mark.parametrize("pack, hot", [(16 << 20, 50_000), (500, 3)])
def test_substrings(hard, empty, monkeypatch, pack, hot):
    monkeypatch.setattr(substring_dedup, "MET", 2000)
    rows, seen, want = sorted(texts(hard), key=lambda r: (r[0] is None, r[0] or 0)), {}, []
    for i, x in rows:
        b = x.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) != i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_repeats(hard, pack, hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and substring_dedup.remove_repeats(empty).isEmpty()


@pytest.mark.parametrize("letters, width", [(1, 50), (2, 50), (3, 16), (26, 9)])
def test_deep_shallow_sorts(letters, width):
    rng = np.random.default_rng(letters)
    body = bytes(rng.integers(97, 97 + letters, 2000).astype(np.uint8))
    places = rng.integers(0, len(body) - width, 3000)
    order = blindtrie.deep_shallow(body, places, width)
    assert sorted(order.tolist()) == list(range(3000))
    assert [body[p : p + width] for p in places[order]] == sorted(body[p : p + width] for p in places)


def test_bpe(hard, empty):
    codec = bpe.Codec.of(*queries.byte_bpe())
    want = [(i, codec.encoding.encode_ordinary(x), x) for i, x in texts(hard)]
    got = [(r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in bpe.encode(hard, *queries.byte_bpe(), decode=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    rng, parts = random.Random(4), list("ab1 \n\t'.s\u0085　\x1cé中🙂") + ["  ", "'s", "\r\n", " the"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert np.frombuffer(codec.encode(x), "<u4").tolist() == codec.encoding.encode_ordinary(x)
    x = " ".join(f"w{i}" for i in range(3 * bpe.PORTION))
    assert np.frombuffer(codec.encode(x), "<u4").tolist() == codec.encoding.encode_ordinary(x) and len(codec.known) <= bpe.PIECES + bpe.PORTION
    x = "some words, here\t" * 20_000
    assert np.frombuffer(codec.encode(x), "<u4").tolist() == codec.encoding.encode_ordinary(x)
    assert bpe.encode(empty, *queries.byte_bpe()).isEmpty() and public_tokenizers.PATTERN


def base_pii(x):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (k, p) in enumerate(kinds):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(v) <= 255 for v in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), rank, m.end(), k))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_pii(spark, empty):
    rng, parts = random.Random(5), ["a@b.c", "@", ".", "_d@e.f", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", " ", "+1 (663) 555-6869", "+", "7", "é🙂", "x", "-", "%", "\n", "00.", "12"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(1500)] + [(2000, None), (2001, "1" * 100000), (2002, "a" * 100000), (2003, "Dear Dr. Anna Smith, call 555-123-4567 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).select("doc_id", *spans.digest_columns("spans", pii.KINDS)).collect()}
    for i, x in rows:
        assert got[i].base_sha256 == hashlib.sha256(base_pii(x or "").encode()).hexdigest(), x
    assert pii.find_pii(empty).isEmpty()


def test_pii_is_linear_in_the_text(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"10.{i % 256}.3.4 a{i}@b.co" for i in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        r = pii.candidates(df).select("doc_id", F.size("cands").alias("n")).first()
        took.append(time.time() - began)
        assert r.n >= n
    assert took[1] < 6 * took[0] + 5


def test_scan():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for n in (0, 1, 64, 65, 300):
        x = list(range(1, n + 1))
        got = spark.createDataFrame([(x,)], "x array<int>").select(pii.scan(F.col("x"), 0, lambda a, b: a + b, 1)).first()[0]
        assert got == [sum(x[:k]) for k in range(n)]


def pii_rows(n):
    rng, first, last = random.Random(3), pii.NAMES.split("|"), "Smith Weber Dubois Garcia Rossi Novak".split()
    words = "the report was sent on monday and the team met again later".split()
    number = lambda *sizes: "-".join(str(rng.randint(2 * 10 ** (k - 1), 10**k - 1)) for k in sizes)
    out = []
    for i in range(n):
        kind, lead, value = [
            ("name", "Dear ", f"{rng.choice('Mr Mrs Ms Dr Prof'.split())}. {rng.choice(first)} {rng.choice(last)}"), ("local_phone", "call ", number(3, 3, 4)),
            ("hidden_email", "email ", f"{rng.choice(last).lower()} [at] {rng.choice(words)} [dot] com"), (None, "version ", number(3, 3, 4)), (None, "order ", number(3, 2, 4)), (None, "", ""),
        ][i % 6]
        before = " ".join(rng.choices(words, k=rng.randint(3, 9))) + " " + lead
        out.append((i, f"{before}{value} {rng.choice(words)}", [(kind, len(before), len(before) + len(value))] if kind else []))
    return out


def test_pii_that_the_classifier_adds(spark):
    rows = pii_rows(600)
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find_pii(df).collect()}
    right = sum(s in got[i] for i, _, planted in rows for s in planted)
    assert right >= 0.95 * sum(len(planted) for *_, planted in rows) and right >= 0.95 * sum(map(len, got.values()))
    # the same estimates as by plain loops
    for r in pii.reliabilities(pii.candidates(df)).collect():
        votes = [tuple(c.v) for x in pii.candidates(df).collect() for c in x.cands if c.kind == r.kind]
        pi, a = pii.PRIOR, [0.8] * 4
        for _ in range(pii.ROUNDS):
            q = [1 / (1 + math.exp(-(math.log(pi / (1 - pi)) + sum(v * math.log(x / (1 - x)) for v, x in zip(vs, a, strict=True))))) for vs in votes]
            pi = min(pii.MOST_PRIOR, max(pii.LEAST_PRIOR, sum(q) / len(q)))
            agree = [8 + sum(p if vs[j] == 1 else 1 - p if vs[j] == -1 else 0 for p, vs in zip(q, votes, strict=True)) for j in range(4)]
            a = [min(0.99, max(0.55, agree[j] / (10 + sum(abs(vs[j]) for vs in votes)))) for j in range(4)]
        assert [r.pi, *r.a] == pytest.approx([pi, *a], rel=1e-9)


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.documents(spark, DIR)
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, stage(spark, df, DIR)
        if name != "byte_bpe":
            assert df.columns == docs.columns
        if name in ("exact_dedup", "ngram_join"):
            found = exact_dedup.exact_dedup(before).where("kept") if name == "exact_dedup" else ngram_join.ngram_join(before).where("doc_id = component_id")
            assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in found.select("doc_id").collect())
    folder = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    whole = corpus_pipeline.run(spark, DIR)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"pipeline"}
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect())) and whole.where(F.col("n_tokens") > 0).count()


def test_stages_on_hard_rows(spark, hard, empty):
    import corpus_pipeline

    clash = hard
    for name in ("key", "_key", "row", "own_n", "key_id", "lang_pred", "near", "copy", "__id", "rank"):
        clash = clash.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, "")
        assert stage(spark, empty, "").isEmpty()
        if name != "byte_bpe":
            assert got.columns == clash.columns and got.where("_key = '_key' and rank = 'rank'").count() == got.count()
    # every text that is near no other stays, whatever its id
    rows = [(7, f"{c} " + " ".join(f"{c}{k}" for k in range(30))) for c in "abc"] + [(2**63 - 1, "x1 x2 x3 x4 x5 x6"), (None, "y1 y2 y3 y4 y5 y6"), (2**63 - 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("exact_dedup", "ngram_join"):
        got = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_exact_stage_keeps_each_text(spark):
    import corpus_pipeline

    rows = [(None, "abc"), (None, "xyz"), (None, "xyz"), (None, None), (5, "one two"), (5, "two one"), (5, "on etwo"), (6, "x yz"), (6, "p qr"), (7, "pqr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.exact(spark, docs, "").collect()
    want = [(5, "onetwo"), (5, "twoone"), (6, "pqr"), (6, "xyz"), (None, ""), (None, "abc")]
    assert sorted(((r.doc_id, (r.text or "").replace(" ", "")) for r in got), key=str) == want


def test_language_sample_is_bounded_by_rows(spark):
    # one id for every row, and no id: neither takes a language out nor brings more rows than asked
    seen = []
    words = {"aa": "alpha beta gamma", "zz": "xylo zebra quux"}
    rows = [(i, f"{words[lang]} {k}" + "y" * (k % 9), lang) for i in (7, None) for lang in words for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for part in (docs, docs.where("doc_id is null")):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "Model", lambda langs, x, y, model=langid.Model: seen.append((langs, np.bincount(y).tolist())) or model(langs, x, y))
            model = langid.train(part, per_language=8, in_all=16)
        assert seen[-1][0] == ["aa", "zz"] and all(1 < n <= 8 for n in seen[-1][1])
        assert [model.predict(x)[0] for x in words.values()] == ["aa", "zz"]


def test_language_stage_decides(spark):
    import corpus_pipeline

    docs = queries.documents(spark, DIR).select("doc_id", "text", "lang")
    rng = random.Random(6)
    odd = ["".join(rng.choices("qzxjkvw ", k=300)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)), "1 2 3 --", None]
    rows = docs.unionByName(spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(odd)], docs.schema))
    assert sorted(r[0] for r in corpus_pipeline.language(spark, rows, "").select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    for bare in (rows.withColumn("lang", F.lit(None).cast("string")), rows.where("doc_id < 0")):
        got = corpus_pipeline.language(spark, bare, "")
        assert sorted(r[0] for r in got.where("doc_id < 0").collect()) == [-2, -1] and got.count() == bare.count() - 2
    got = corpus_pipeline.language(spark, rows.withColumn("doc_id", F.lit(None).cast("long")), "")
    assert got.count() == docs.count()


def test_near_stage_goes_by_rows(spark):
    import corpus_pipeline

    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, base[0] + " x"), (None, base[0]), (None, base[0] + " y"), (3, base[1]), (2, base[1] + " z"), (3, base[2]), (None, base[1] + " w"), (9, None), (None, ""), (4, base[3]), (4, base[3] + " v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:1]) for r in got.collect()), key=str) == [(2, "b"), (3, "c"), (4, "d"), (9, ""), (None, ""), (None, "a")]


def test_mixture_stage_draws_for_each_text(spark):
    import corpus_pipeline

    rows = [(None, f"one two three {k}", f"s{k % 2}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in corpus_pipeline.mixture(spark, docs, "").groupBy("source").count().collect()}
    # weights 1 and 2 of 2000 equal documents
    assert abs(got["s0"] - 2000 / 3) < 100 and abs(got["s1"] - 4000 / 3) < 100
