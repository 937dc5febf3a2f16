"""Suffix dedup, SimHash, nearest neighbours, chat, mixing, the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from termfall.llm import ann, chat, components, mixing, simhash, suffix_dedup

# Suffix dedup


def removed_brute(texts, length=suffix_dedup.LENGTH):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_loser_tree_merges_and_keeps_prefixes():
    r = random.Random(0)
    words = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(300)]
    runs = [sorted(words[i::7]) for i in range(7)] + [[]]
    coded = [suffix_dedup.front_code(x) for x in runs]
    assert [suffix_dedup.front_decode(p.tolist(), s) for p, s in coded] == runs
    order, common = suffix_dedup.loser_merge([(x, p.tolist()) for x, (p, _) in zip(runs, coded, strict=True)])
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(words)
    for i in range(1, len(merged)):
        n = 0
        while n < min(len(merged[i]), len(merged[i - 1])) and merged[i][n] == merged[i - 1][n]:
            n += 1
        assert common[i] == n
    assert suffix_dedup.loser_merge([]) == ([], [])


@pytest.mark.parametrize("hot", [100_000, 1])
def test_removed_bytes_equal_brute_force(spark, hot):
    r = random.Random(3)
    bits = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (30, 90, 150, 199, 201, 260, 400)]
    given = [(1, None), (2, ""), (None, bits[5]), (3, "a" * 1000), (3, "a" * 1000), (4, "ab" * 300), (5, "ab" * 99 + "c"), (3, bits[4]), (6, "ü" * 100), (7, "ü" * 100 + "x")]
    given += [(10 + i % 40, "".join(r.choice(bits)[r.choice([0, 0, 3]) :] for _ in range(r.randint(1, 5)))) for i in range(50)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id bigint, text string, n_bytes string, d int")
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    want = [(i, *w) for (i, _), w in zip(given, removed_brute([t for _, t in given]), strict=True)]
    assert sorted((tuple(x[:5]) for x in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got)


def test_rows_are_told_apart_by_digests(spark):
    """Two 257-byte texts of equal 32-bit hash without ids, one of them repeated: the unique one keeps its bytes."""
    F = _f()
    made = spark.range(400_000).select(F.rpad(F.concat(*[F.sha2(F.concat("id", F.lit(k)).cast("string"), 256) for k in "abcd"]), 257, "x").alias("t"))
    both = made.groupBy(F.hash("t")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).filter("n > 1").first()
    docs = [(None, both.a), (None, both.b), (5, both.b)]
    got = sorted(tuple(x[1:3]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == [(257, 0), (257, 257), (257, 257)]
    # A null id is no empty one, a null text is no empty one.
    keyed, _ = suffix_dedup.repeated_spans(spark.createDataFrame([(None, "x"), (None, None), (None, ""), ("", "x")], "doc_id string, text string"))
    assert keyed.select("d", "h").distinct().count() == 4


def test_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 700)
    r = random.Random(5)
    long = "".join(r.choice("abc") for _ in range(5_000))
    docs = [(1, long), (2, "y" * 30 + long[650:1_500]), (3, long[:300] + "z" + long[:300])]
    got = [tuple(x[:5]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).orderBy("doc_id").collect()]
    raw = [suffix_dedup._parts([t.encode()]) for _, t in docs[:1]]
    assert sum(1 for _ in raw[0]) == 8
    assert got == [(i, *w) for (i, _), w in zip(docs, removed_brute([t for _, t in docs]), strict=True)]


def _f():
    from pyspark.sql import functions as F

    return F


def test_suffixes_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(docs).collect() == []


# SimHash


def fingerprint_brute(text, words=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.BITS
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "a b c d", "É À b\x1cc \x85x y z z z z", "a  b\n\tc d e f A B C", "w " * 40_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == fingerprint_brute(text)


def test_trie_links_connect_what_is_near():
    r = np.random.default_rng(0)
    fps = []
    for base in r.integers(0, 2**64, size=25, dtype=np.uint64).tolist():
        for _ in range(14):
            x = base
            for k in r.choice(64, size=r.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    assert (simhash.trie_links(fps, 0) == components_brute(fps, np.arange(len(fps)))).all()


def test_classes_equal_brute_force(spark):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(500)}" for _ in range(150)]
        for _ in range(6):
            texts.append(" ".join(words))
            words[r.randrange(150)] = "changed"
    texts += [None, "", " ", "one", "one", "ONE"]
    docs = spark.createDataFrame([(i * 3, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, fp string, component_id int")
    got = {x.doc_id: x for x in simhash.fingerprint_classes(docs).collect()}
    fps = np.array([fingerprint_brute(t) for t in texts], dtype=np.uint64)
    assert [got[i * 3].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps.tolist()]
    want = components_brute(fps, [i * 3 for i in range(len(texts))])
    assert [got[i * 3].component_id for i in range(len(texts))] == want.tolist()
    assert len(set(want)) < len(set(fps.tolist()))
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.tolist()))
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d"), (5, "c d")], "doc_id bigint, text string")
    assert sorted((x.doc_id for x in simhash.keep_one(nulls).collect()), key=str) == [5, None]
    assert simhash.fingerprint_classes(docs.filter("false")).collect() == []
    assert simhash.keep_one(docs.filter("false")).collect() == []


def test_components(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)]
    r.shuffle(chain)
    links = [*chain, *[(100, i) for i in range(101, 130)], (7, 7), (200, 201), (201, 200), (200, 201)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# Nearest neighbours


def nearest_brute(given, k=20):
    fine = [(i, np.array(v, dtype=float)) for i, v in given if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-float((q * v).sum()), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_nearest_with_ties_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    given = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(240)] + [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(240, 300)]
    given += [(300, None), (320, []), (340, [0.0] * 4), (360, [math.nan, 1.0, 2.0, 3.0]), (None, [1.0] * 4), (380, [1.0, 2.0]), (400, [1.0, -2.0]), (420, [None, 1.0, 1.0, 1.0]), (440, [math.inf] * 4)]
    vectors = spark.createDataFrame([(i, v, "s", 1) for i, v in given], "vec_id bigint, embedding array<float>, score string, rank int")
    got = ann.search(vectors.filter("vec_id % 20 = 0"), vectors)
    assert sorted(map(tuple, got.collect())) == nearest_brute(given)
    assert ann.codes(vectors).count() == 302
    assert ann.search(vectors.filter("false"), vectors.filter("false")).collect() == []
    # Repeated rows change nothing.
    twice = ann.search(vectors.filter("vec_id % 20 = 0"), vectors.unionByName(vectors))
    assert sorted(map(tuple, twice.collect())) == nearest_brute(given)


def test_estimates_keep_their_bounds():
    r = np.random.default_rng(1)
    vectors, centre = r.standard_normal((3000, 50)), r.standard_normal(50)
    assert np.allclose((ann.rotate(vectors[:9]) ** 2).sum(axis=1), (vectors[:9] ** 2).sum(axis=1), rtol=1e-4)
    asked = ann.Asked.of(vectors[:40])
    bits, length, fit = ann.encode(vectors - centre)
    guess, error = ann.estimate(asked, slice(0, 40), np.ascontiguousarray(bits.view(np.uint64).T), length, fit, centre)
    exact = vectors[:40] @ vectors.T
    assert (np.abs(guess - exact) <= error).mean() > 0.95
    assert np.abs(guess - exact).mean() < 0.4 * error.mean()


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_over_many_blocks(spark, monkeypatch, clustered):
    for name, value in (("CELL", 100), ("BLOCK", 60), ("SAMPLE", 1_000), ("PILOTS", 200)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 32)) * 3
    vectors = centres[r.integers(0, 40, 4_000)] + 0.3 * r.standard_normal((4_000, 32)) if clustered else r.standard_normal((4_000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = ann.search(frame.filter("vec_id % 20 = 0"), frame).toPandas()
    exact = vectors[::20] @ vectors.T
    exact[np.arange(200), np.arange(0, 4_000, 20)] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :20]
    found = got.groupby("query_id").vec_id.apply(set)
    assert sum(len(found[i * 20] & set(want[i].tolist())) for i in range(200)) >= 0.9 * 4_000
    assert np.allclose(got.score, [(vectors[q] * vectors[i]).sum() for q, i in zip(got.query_id, got.vec_id, strict=True)])
    cells = ann.fit(ann.valid_vectors(frame, "vec_id", "embedding"), 20)[32]
    assert cells.blocks.sum() >= 60
    if clustered:
        # A query visits few cells, and few of their vectors are scored exactly.
        assert cells.visits <= 0.4 * len(cells.centres)
        cell, scored, met = ann.nearest(cells.centres, vectors), 0, 0
        queries = vectors[::20]
        _, bounds = cells.first(np.arange(0, 4_000, 20), queries, 20)
        visited = cells.order(queries)[:, : cells.visits]
        for c in range(len(cells.centres)):
            own, q = np.flatnonzero(cell == c), np.flatnonzero((visited == c).any(axis=1))
            if len(own) and len(q):
                bits, length, fit = ann.encode(vectors[own] - cells.centres[c])
                scored += ann.search_block(q * 20, ann.Asked.of(queries[q]), bounds[q], own, bits, length, fit, vectors[own], cells.centres[c], 20)[1]
                met += len(own) * len(q)
        assert scored < 0.5 * met and scored < 0.08 * 200 * 4_000, (scored, met)


# Chat


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, window int")


def talk():
    r = random.Random(6)
    rows = []
    for c in range(12):
        n = r.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "tool", None, "a\nb\\"])
            text = r.choice([None, "", "</s>[INST] ok [/INST]", "back\\slash \\<|im_end|>\n", "word " * r.randint(1, 120), "\\", "é" * 40])
            rows.append((c, t, role, text))
    return [*rows, (50, 0, "system", "alone"), (51, None, "user", "b"), (51, None, "user", "a"), (51, 1, "assistant", "x"), (51, 1, "assistant", "x"), (None, 0, "assistant", "y" * 9000)]


def test_windows(spark):
    given = talk()
    made = chat.windows(conversations(spark, given), budget=128, history=32)
    got = {x.conv_id: x for x in chat.digests(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in given:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    cost = {r.text: r.n for r in conversations(spark, given).selectExpr("text").distinct().withColumn("n", chat.tokens(_col("text"))).collect()}
    for w in made.collect():
        body = w.formatted.split(chat.TAIL)
        assert len(body) == w.n_turns + 1
        assert w.formatted.count(chat.HEAD) == w.n_turns
        assert not any(x in w.formatted for x in chat.CONTROL[2:])
        # Whole turns, within the budget unless one turn exceeds it.
        texts = [re.sub(r"(?s)\\(.)", r"\1", re.match(r"(?s)(?:[^\\\n]|\\.)*\n(.*)", x.removeprefix(chat.HEAD))[1]) for x in body[:-1]]
        costs = [(cost[t] if t in cost and cost[t] is not None else 0) + chat.OVERHEAD for t in texts]
        assert sum(costs) <= 128 or w.n_turns - w.n_repeated <= 1
        roles = [re.match(r"(?s)((?:[^\\\n]|\\.)*)\n", x.removeprefix(chat.HEAD))[1] for x in body[:-1]]
        begins = sorted(by[w.conv_id])[0][2] == "system"
        assert not begins or roles[0] == "system"
        # Repeated turns, but for the system turn, lie within the history budget.
        own = costs[begins : w.n_repeated]
        assert sum(own) <= 32


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_chat_equals_sql_and_stays_native(spark, duck):
    from termfall.llm.queries import op3_chat

    from ..conftest import SF, rows

    df = op3_chat(spark, SF)
    got = df.toPandas()
    assert rows(got, got.columns) == rows(duck.sql(chat.SQL).df(), got.columns)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert chat.digests(chat.windows(conversations(spark, []))).collect() == []


# Mixing


def mix_brute(rows, place, budget=None, towards=mixing.TOWARDS_UNIFORM, limit=mixing.MOST_REPEATS, block=mixing.BLOCK_TOKENS):
    """Copies of each (id, source, tokens); place(copy, id) is the seeded hash."""
    tokens = defaultdict(int)
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    if not total:
        return Counter((i, s, 0) for i, s, _ in rows)
    p = {s: n / total for s, n in tokens.items() if n}
    own = -sum(x * math.log(x) for x in p.values())
    target = own + towards * (math.log(len(p)) - own)
    budget = min(float(budget or total), limit * total)

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def fine(a):
        w = weights(a)
        return -sum(x * math.log(x) for x in w.values()) <= target + 1e-12 and max(w[s] * budget / tokens[s] for s in w) <= limit * (1 + 1e-12)

    low, high = 0.0, 1.0
    if fine(0.0):
        high = 0.0
    else:
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fine(middle) else (middle, high)
    w = weights(high)
    out = Counter()
    for s in tokens:
        docs = [(i, n) for i, x, n in rows if x == s]
        if not tokens[s]:
            out.update((i, s, 0) for i, _ in docs)
            continue
        quota = math.floor(w[s] * budget + 1e-6)
        whole, rest = divmod(quota, tokens[s])
        blocks = max(1, -(-tokens[s] // block))
        order = defaultdict(list)
        for i, n in docs:
            order[place(whole, i) % blocks, place(whole, i)].append((i, n))
        taken, used = set(), 0
        for key in sorted(order) if rest else ():
            used += sum(n for _, n in order[key])
            if used > rest:
                break
            taken.add(key)
        for i, _ in docs:
            n = whole + ((place(whole, i) % blocks, place(whole, i)) in taken)
            out.update((i, s, c) for c in range(n))
    return out


@pytest.mark.parametrize("case", [{}, {"towards_uniform": 1.0}, {"towards_uniform": 0.0}, {"budget": 9000.0}, {"budget": 90_000.0}, {"most_repeats": 1.0}, {"budget": 37.0, "towards_uniform": 1.0}])
def test_mixing_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    r = random.Random(8)
    rows = [(i, r.choice(["big"] * 9 + ["mid"] * 3 + ["low", None]), r.randint(0, 30)) for i in range(200)]
    rows += [(900, "void", 0), (901, "void", 0), (5, "big", 9), (None, "mid", 4), (None, "mid", 6)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n or i % 2 else None, "x", 1) for i, s, n in rows], "doc_id bigint, source string, text string, copy string, block int")
    got = mixing.plan_copies(docs, **case).collect()
    ids = spark.createDataFrame([(i,) for i in {x[0] for x in rows}], "id bigint")
    from pyspark.sql import functions as F

    hashed = {(x.c, x.id): x.h for x in ids.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(60)))).withColumn("h", mixing._place(F.col("c"), F.col("id"), mixing.SEED)).collect()}
    want = mix_brute(rows, lambda c, i: hashed[c, i], budget=case.get("budget"), towards=case.get("towards_uniform", mixing.TOWARDS_UNIFORM), limit=case.get("most_repeats", mixing.MOST_REPEATS), block=100)
    assert Counter((x.doc_id, x.source, x["copy"]) for x in got) == want
    mixed = mixing.mix(docs, **case)
    assert mixed.columns == docs.columns
    assert mixed.count() == len(got)
    assert max((x["copy"] for x in got), default=0) < case.get("most_repeats", mixing.MOST_REPEATS) + 1


def test_mixing_without_tokens(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id bigint, source string, text string")
    assert sorted(tuple(x)[:3] for x in mixing.plan_copies(docs).collect()) == [(1, "a", 0), (2, None, 0)]
    assert mixing.mix(docs).count() == 2
    assert mixing.mix(docs.filter("false")).collect() == []
    assert mixing.plan_copies(docs.filter("false")).collect() == []


# The pipeline


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    import corpus_pipeline
    from termfall.llm import bpe, pii, quality

    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeiou") + r.choice("nrstl") for _ in range(r.randint(1, 3))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(90)) for _ in range(40)]
    texts += [texts[0], texts[1] + " x", None, "", "short", texts[2] + " me@home.org", "b b b " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        ids = sorted(x.doc_id for x in docs.select("doc_id").collect())
        if name == "quality":
            assert ids == sorted(x.doc_id for x in quality.score_quality(before).filter("kept").collect())
            assert set(ids).isdisjoint({42, 43, 44, 46})
        elif name == "near_dedup":
            given = [(x.doc_id, x.text) for x in before.collect()]
            fps = np.array([fingerprint_brute(t) for _, t in given], dtype=np.uint64)
            assert ids == sorted(set(components_brute(fps, [i for i, _ in given]).tolist()))
            assert 40 not in ids
            kept = ids
        elif name == "pii":
            assert ids == kept
            text = {x.doc_id: x for x in docs.collect()}
            want = {x.doc_id: pii.redact(x.text) for x in before.collect()}
            assert {i: x.text for i, x in text.items()} == want
            assert all(x.n_chars == len(x.text) for x in text.values())
        else:
            assert set(ids) <= set(kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = bpe.Codec(bpe.read_ranks(bpe.production()[0]), bpe.production()[1])
    assert sorted((x.doc_id, tuple(x.ids)) for x in got) == sorted((x.doc_id, tuple(codec.encode(x.text))) for x in docs.collect())


# Near-dedup by shingle similarity


def similar_brute(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    near = np.array([[(len(a & b) / len(a | b) if a | b else 1.0) >= 0.8 for b in sets] for a in sets])
    at = np.arange(len(texts))
    for _ in texts:
        at = np.array([at[row].min() for row in near])
    return np.array(ids)[at]


def test_near_copies_beyond_the_simhash_budget_are_dropped(spark):
    import corpus_pipeline

    r = random.Random(31)
    texts = []
    for changes in (1, 2, 3, 4, 5, 8, 12):
        words = [f"w{r.randrange(3000)}" for _ in range(220)]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = words[:]
            for i in r.sample(range(220), changes):
                copy[i] = f"v{r.randrange(3000)}"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one", "ONE", "one two three four five six"]
    docs = spark.createDataFrame([(i * 2, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, fp string")
    want = sorted(set(similar_brute(texts, [i * 2 for i in range(len(texts))]).tolist()))
    out = corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs), "")
    assert out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect()) == want
    assert len(want) < len(simhash.keep_one(docs).collect())


def test_open_buckets_are_settled_in_blocks(spark, monkeypatch):
    """A large group of near copies that differ from each other: blocks of few nodes, links equal those of all pairs."""
    import corpus_pipeline
    from termfall.llm import similar

    monkeypatch.setattr(similar, "BLOCK", 8)
    r = random.Random(77)
    base = [f"w{r.randrange(9000)}" for _ in range(160)]
    texts = []
    for _ in range(90):
        copy = base[:]
        for i in r.sample(range(160), r.choice([1, 3, 4, 6, 8])):
            copy[i] = f"v{r.randrange(9000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(set(similar_brute(texts, list(range(90))).tolist()))
    assert 3 < len(want) < 90
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def test_wide_trie_gives_the_pairs_of_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 2, 9, 60, 60, 60):
        base = r.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
        fps = base[r.integers(0, 3, n)].copy()
        for i in range(n):
            for _ in range(r.integers(0, 8)):
                fps[i, r.integers(0, 4)] ^= np.uint64(1) << np.uint64(r.integers(0, 64))
        root = r.integers(0, 6, n)
        for bits in (0, 3, 10):
            near = (np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2) <= bits) & (root[:, None] != root[None, :])
            for split in (0, n // 2):
                want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j and (not split or i < split <= j)}
                got = [(min(x), max(x)) for x in zip(*map(np.ndarray.tolist, simhash.trie_pairs(fps, root, bits, split)), strict=True)]
                assert len(got) == len(set(got)) and set(got) == want


def test_near_dedup_goes_through_the_simhash_trie(spark, monkeypatch):
    """Both trie joins find pairs: the narrow one what is within its bits, the wide one, with its budget, each pair at 0.8."""
    import corpus_pipeline
    from termfall.llm import similar

    found = {}

    def seen(name, own):
        def run(*given):
            found[name] = out = own(*given)
            return out

        return run

    monkeypatch.setattr(similar.simhash, "links", seen("narrow", simhash.links))
    monkeypatch.setattr(similar, "_alike", seen("wide", similar._alike))
    r = random.Random(8)
    base = [f"w{r.randrange(9000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base, "more"])]
    for k in range(60):
        copy = base[:]
        for i in r.sample(range(400), 8 + k % 12):
            copy[i] = f"v{r.randrange(9000)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(set(similar_brute(texts, list(range(len(texts)))).tolist()))
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert found["narrow"].count() > 0 and found["wide"].count() > 0
    for n in (4, 12, 24, 60, 240):
        shared = [r.getrandbits(64) for _ in range(n)]
        for _ in range(20):
            a, b = (simhash.voted(np.array([*shared, *(r.getrandbits(64) for _ in range(k))], dtype=np.uint64), similar._WIDE_ODD) for k in (n // 8, n // 4 - n // 8))
            assert np.bitwise_count(a ^ b).sum() <= similar.budgets()[min(n + n // 8, similar.FEW)]


def test_near_copies_without_texts(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f", "c")], "doc_id bigint, text string, fp string")
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d"), (5, "c d")], "doc_id bigint, text string")
    assert sorted((x.doc_id for x in corpus_pipeline.drop_near_copies(spark, nulls, "").collect()), key=str) == [5, None]
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("false"), "").collect() == []
