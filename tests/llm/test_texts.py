"""PII, URL filters, BPE, quality, language identification."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termfall.llm import bpe, langid, pii, quality, urlfilter

EXTRA = "doc_id bigint, text string, lang string, source string, n_words string, kept int, fp string"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, "y") for i, t in enumerate(texts)], EXTRA)


# PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", ".", "@", "1", "2", "55", "255", "300", "007", "-", " ", "+", "(", ")", "é", "4111111111111111", "token=", "%", "x.y", "IBAN ", "http://"]), max_size=40).map("".join))
def test_base_spans_equal_their_patterns(text):
    assert [x for x in pii.find_spans(text) if x[0] in pii.BASE] == base_spans(text)


def test_added_spans():
    def kinds(t):
        return [(k, t[s:e]) for k, s, e in pii.find_spans(t) if k in pii.ADDED]

    assert kinds("IBAN DE89370400440532013000 x") == [("account", "DE89370400440532013000")]
    assert kinds("account number 12345678.") == [("account", "12345678")]
    assert kinds("password=7602ad27cf5550de1c st") == [("secret", "7602ad27cf5550de1c")]
    assert kinds("see https://bob:pw@host.org/a b") == [("address", "https://bob:pw@host.org/a")]
    assert kinds("the account of 20 people, a token of thanks, tokens=12345678, https://host.org/a") == []


def test_accounts_beside_other_words():
    def accounts(t):
        return [t[s:e] for k, s, e in pii.find_spans(t) if k == "account"]

    iban = "DE89370400440532013000"
    assert accounts(f"IBAN: {iban} BIC COBADEFFXXX") == [iban]
    assert accounts("IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("IBAN NL91 ABNA 0417 1643 00 EUR 25") == ["NL91 ABNA 0417 1643 00"]
    for t in ("Account Number: 12345678", "Account No: 12345678", "ACCOUNT NO. 12345678", "account number is 12345678", "account is: 12345678", "Account No. 12345678 BIC COBADEFFXXX"):
        assert accounts(t) == ["12345678"], t
    assert accounts(f"IBAN is {iban}") == [iban]
    assert accounts(f"Konto Nummer ist {iban}.") == [iban]
    assert accounts("the account is 20 people, account isabel 12345678, accounts 12345678, Account Number: 12 BIC COBADEFFXXX") == []
    assert pii.redact(f"IBAN: {iban} BIC X") == "IBAN: [ACCOUNT] BIC X"


@pytest.mark.parametrize("unit", ["mailto:", "mailto:a@b/", "sip:x:", "token=", "token=aaa", "IBAN 1 ", "account: 1", "https://u@", "+1 (", "a@", "1.2.", "secret: ", "tel:+1 "])
def test_long_runs_take_linear_time(unit):
    import time

    def seconds(n):
        text = unit * (n // len(unit))
        start = time.perf_counter()
        pii.find_spans(text)
        return time.perf_counter() - start

    seconds(1_000)
    assert min(seconds(400_000) for _ in range(2)) < 25 * max(min(seconds(50_000) for _ in range(3)), 0.004)


def test_addresses():
    def found(t):
        return [t[s:e] for k, s, e in pii.find_spans(t) if k == "address"]

    assert found("mailto:mailto:ann.lee@host.org?x=1 sip:100@10.0.0.1:5060, ftp://a:b@c.de/f") == ["mailto:mailto:ann.lee@host.org?x=1", "sip:100@10.0.0.1:5060", "ftp://a:b@c.de/f"]
    assert found("mailto:a@localhost mailto:@b.c http://:p@b.c https://b.c/@d.e tel:+49 30 1234567") == ["tel:+49 30 1234567"]
    assert found("mailto:x mailto:y@z.org") == ["mailto:y@z.org"]


def test_redaction_and_odd_texts(spark):
    texts = [None, "", "a@b.c", "x" * 200_000, "4111 1111 1111 1111", "a@b.c"]
    got = pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.spans for r in got] == ["", "", "email:0:5", "", "card:0:19", "email:0:5"]
    assert [r.base_sha256 for r in got] == [hashlib.sha256(r.spans.encode()).hexdigest() for r in got]
    cleaned = pii.redact_pii(frame(spark, texts)).orderBy("doc_id")
    assert cleaned.columns == frame(spark, texts).columns
    assert [r.text for r in cleaned.collect()][2:5] == ["[EMAIL]", "x" * 200_000, "[CARD]"]
    assert pii.find_pii(frame(spark, []).filter("false")).collect() == []
    counted = spark.createDataFrame([("a@b.c", 5)], "text string, n_chars bigint")
    assert pii.redact_pii(counted).first().n_chars == 7


# URL filters


def test_urls_equal_sql(spark, duck):
    from termfall.llm.queries import op9_url_filters

    from ..conftest import SF, rows

    got = op9_url_filters(spark, SF).toPandas()
    assert rows(got, got.columns) == rows(duck.sql(urlfilter.SQL).df(), got.columns)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.com/en/x?y#z", "http://a.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://sub.casino-win.example.org", "http://example.org/bad?x", "http://example.org/bad/", "http://com", "x://É.COM/a", "http://casino-win.example.org:80/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, blocked=["casino-win.example.org/", "example.org/bad", None]).collect()}
    assert [got[i] for i in range(3)] == [("", "", None, "allow")] * 3
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[6] == ("x.net", "/es/1", "net/es/", "block")
    assert got[7] == ("x.net", "/de/1", None, "allow")
    assert got[8] == ("sub.casino-win.example.org", "", None, "block")
    assert [got[i][3] for i in (9, 10, 13)] == ["block", "allow", "allow"]
    assert got[11] == ("com", "", None, "allow")
    assert got[12] == ("É.com", "/a", "com/", "allow")
    assert urlfilter.filter_urls(pages.filter("false")).collect() == []
    listed = spark.createDataFrame([("casino-win.example.org/",), ("example.org/bad",), (None,)], "entry string")
    again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, blocked=listed).collect()}
    assert again == got


def test_the_list_decides_many_rows(spark, duck, tmp_path):
    """Hosts of the production list where no rule fits, against the SQL twin."""
    from ..conftest import rows

    r = random.Random(3)
    hosts = [f"{r.choice(['', 'm.', 'www.a.'])}{r.choice([*urlfilter.NAMES, 'fine', 'xcasino-win'])}{r.choice(['', '-7', '-4999', '-5000', '-07'])}.example.{r.choice(['net', 'org', 'com'])}" for _ in range(400)]
    urls = [(i, f"https://{h}{r.choice(['', '/', '/de/1', '/es/2', '/x?y#z'])}", "h") for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string, html string")
    got = urlfilter.filter_urls(pages).toPandas()
    assert (got.entry.notna()).sum() > 100
    frame = pages.toPandas()
    con = duck.cursor()
    con.register("given", frame)
    want = con.sql(urlfilter.SQL.replace("FROM pages", "FROM given")).df()
    assert rows(got, got.columns) == rows(want, want.columns)


def test_hosts_of_many_labels_take_linear_time():
    host = "a." * 300_000 + "spam.org"
    assert urlfilter.forms(host, "/x", 12) == [b"org/", b"spam.org/", b"a.spam.org/"]
    assert urlfilter.forms("a.b", "/c", 9) == [b"b/", b"a.b/", b"a.b/c"]
    assert urlfilter.forms("", "", 9) == [b"/"]


def test_collisions_are_told_apart():
    listed = urlfilter.DigestArray(urlfilter.pack(["a/", "b/"]))
    key = listed.keys[:1].repeat(3)
    own = [s for s in (b"a/", b"b/") if urlfilter.DigestArray(urlfilter.pack([s.decode()])).keys[0] == key[0]][0]
    assert listed.contains([own, b"c/", b"d/"], key).tolist() == [True, False, False]
    assert urlfilter.DigestArray(urlfilter.pack([])).contains([b"x"]).tolist() == [False]


# BPE


@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    path, pattern = bpe.production()
    tokens = bpe.read_ranks(path)
    return bpe.Codec(tokens, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(text=st.one_of(st.text(), st.lists(st.sampled_from(["a", "the", " ", "  ", "'s", "'LL", "é", "日本", "22", "\n", "\r\n", "\t", "</s>", "\x1c", "\x85", "\xa0", "<|endoftext|>"])).map("".join)))
def test_ids_equal_the_rank_encoder(codecs, text):
    own, other = codecs
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_pieces_and_every_character(codecs):
    own, other = codecs
    for text in ("ab" * 20_000, " " * 5_000 + "x", "\n" * 3_000):
        assert own.encode(text) == other.encode_ordinary(text)
    for at in range(0, 0x3100, 64):
        text = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(at, at + 64))
        assert own.encode(text) == other.encode_ordinary(text)


def test_encoded_documents(spark, codecs):
    texts = [None, "", "Hello, wörld", "Hello, wörld", "a " * 60_000]
    out = bpe.encode_documents(frame(spark, texts), *bpe.production())
    got = out.orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = codecs[1].encode_ordinary(t or "")
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode_ids(out, *bpe.production()).collect()}
    assert bytes(back[2]) == "Hello, wörld".encode()
    assert bpe.encode_documents(frame(spark, texts).filter("false"), *bpe.production()).collect() == []


@pytest.mark.parametrize("name", ["pii_counts", "quality_counts"])
def test_counts_equal_sql(spark, duck, name):
    from termfall.llm import queries

    from ..conftest import SF, rows

    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, got.columns) == rows(want, want.columns)


# Quality


def base_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\t", "#", "<", "\x1c", "\x85", "\u2003", "abc"]), max_size=60).map("".join))
def test_base_counts(text):
    assert quality.base_counts(text) == base_brute(text)


def kneser_ney(texts):
    """The log probability of each character of the texts, from dictionaries."""
    n = quality.ORDER
    padded = ["\n" * (n - 1) + t for t in texts]
    grams = [[p[i : i + n] for i in range(len(t))] for p, t in zip(padded, texts, strict=True)]
    found = Counter(g for own in grams for g in own)
    texts_of = Counter(g for own in grams for g in set(own))
    levels = [{g: c if texts_of[g] > 1 else 0 for g, c in found.items()}]
    for _ in range(n - 1):
        below = {g[1:]: 0 for g in levels[-1]}
        for g, c in levels[-1].items():
            below[g[1:]] += c > 0
        levels.append(below)

    def prob(g, level):
        if level == n:
            return 1 / len(levels[-1])
        c = levels[level]
        k = [sum(v == i for v in c.values()) for i in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        d = [0.0, 1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        d = [0.0, *(min(max(x, 0.1), 0.95 * i) for i, x in enumerate(d[1:], 1))]
        own = [v for x, v in c.items() if x[:-1] == g[:-1]]
        total, lower = sum(own), prob(g[1:], level + 1)
        if not total:
            return lower
        return max(c[g] - d[min(c[g], 3)], 0) / total + sum(d[min(v, 3)] for v in own) / total * lower

    return [[math.log(prob(g, 0)) for g in own] for own in grams]


def test_model_equals_brute_force(spark, monkeypatch):
    """Scores, bands and verdicts of two languages, from dictionaries and sorted lists; chunks of few texts."""
    monkeypatch.setattr(quality, "CHUNK", 2_000)
    monkeypatch.setattr(quality, "LEAST_WORDS", 5)
    r = random.Random(2)
    texts = {lang: ["".join(r.choice(signs) for _ in range(r.randint(30, 160))) for _ in range(24)] for lang, signs in (("en", "abcd e  "), ("zh", "的一是不了 人\U0001f600Ab"))}
    texts["en"] += [texts["en"][0], "e e e e e e d d d d", "abababab a b a b ab ab abab", None, ""]
    rows = [(lang, t) for lang, own in texts.items() for t in own]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = {x.doc_id: x for x in quality.score_quality(docs).collect()}
    want = {}
    for lang in texts:
        own = [i for i, (x, t) in enumerate(rows) if x == lang and t]
        for i, logs in zip(own, kneser_ney([rows[i][1] for i in own]), strict=True):
            want[i] = -sum(logs) / len(logs)
        assert all(math.isclose(got[i].nll, want[i], rel_tol=1e-4) for i in own)
        passed = [i for i in own if not got[i].base_failed]
        middle = np.median([round(got[i].nll, 4) for i in passed])
        unit = {i: math.sqrt(1 / len(rows[i][1]) + 1 / quality.LONG) for i in own}
        scale = max(quality.LEAST_SCALE, 1.4826 * np.median([round(abs(got[i].nll - middle) / unit[i], 3) for i in passed]))
        for i in own:
            off = (got[i].nll - middle) / unit[i] / scale
            assert got[i].kept == (not got[i].base_failed and -quality.BELOW <= off <= quality.ABOVE)
    assert len(want) == len(rows) - 2


@pytest.mark.parametrize("window", [7, 2_000_000])
def test_ngrams_of_wide_alphabets_and_long_texts(monkeypatch, window):
    monkeypatch.setattr(quality, "WINDOW", window)
    r = random.Random(9)
    for texts in (["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(9_000))], ["abcabc", "abc", "a", "\U0010ffff\0\n"], ["abcabcabcabc"]):
        padded = ["\n" * 4 + t for t in texts]
        grams = [[p[i : i + 5] for i in range(len(p) - 4)] for p in padded]
        n, of = Counter(g for own in grams for g in own), Counter(g for own in grams for g in set(own))
        hi, lo, times, texts_of = quality.ngrams(texts)
        shift = [(hi, 21), (hi, 0), (lo, 42), (lo, 21), (lo, 0)]
        names = ["".join(chr(int(x[i]) >> b & 0x1FFFFF) for x, b in shift) for i in range(len(hi))]
        assert dict(zip(names, times.tolist(), strict=True)) == n
        assert dict(zip(names, texts_of.tolist(), strict=True)) == of


def test_quality_of_documents(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeiou") + r.choice("nrstl") for _ in range(r.randint(1, 3))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(120)) for _ in range(60)]

    def noise(signs):
        return " ".join("".join(r.choice(signs) for _ in range(9)) for _ in range(100))

    # Base rules; gibberish of many signs and of few (above the band); signs behind every word; a few words again and again (below).
    texts += [None, "", "short", "same word here " * 60, noise("abcdefghijklmnopqrstuvwxyz"), noise("qxzjkvw0123456789"), " ".join(f"{r.choice(vocabulary)}{'&&&' * 4}" for _ in range(90)), " ".join(r.choice(vocabulary[:5]) for _ in range(400))]
    docs = frame(spark, texts)
    got = {x.doc_id: x for x in quality.score_quality(docs).collect()}
    assert all(got[i].kept and not got[i].base_failed for i in range(60))
    assert [got[i].base_failed for i in range(60, 67)] == [True, True, True, True, False, False, False]
    assert not any(got[i].kept for i in range(60, 68))
    assert min(got[64].place, got[65].place) > 1
    assert [got[i][1:6] for i in range(68)] == [base_brute(t) for t in texts]
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [tuple(x) for x in docs.orderBy("doc_id").limit(60).collect()]
    assert quality.score_quality(docs.filter("false")).collect() == []
    assert quality.keep_quality(docs.filter("false")).collect() == []
    twice = docs.unionByName(docs).withColumn("lang", docs.lang.substr(5, 1))
    assert quality.score_quality(twice.unionByName(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_words", "kept", "fp"))).count() == 204


# Language identification


def test_languages(spark):
    r = random.Random(1)
    made = {"aa": ["".join(r.choice("abcde") for _ in range(5)) for _ in range(80)], "bb": ["".join(r.choice("defgh") for _ in range(5)) for _ in range(80)], "cc": ["".join(r.choice("äöüij") for _ in range(5)) for _ in range(80)]}
    rows = [(i, " ".join(r.choice(made[x]) for _ in range(40)), x, "s", "1", 0, "z") for i, x in enumerate(list(made) * 40)]
    rows += [(503, "\u0301\u0302 \u0301", None, "s", "1", 0, "z"), (500, None, "aa", "s", "1", 0, "z"), (501, "", "bb", "s", "1", 0, "z"), (502, "123 !?", None, "s", "1", 0, "z"), (None, "abcde", None, "s", "1", 0, "z")]
    rows += [(600, " ".join([*(r.choice(made["aa"]) for _ in range(60)), *(r.choice(made["cc"]) for _ in range(40))]), None, "s", "1", 0, "z")]
    docs = spark.createDataFrame(rows, EXTRA)
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    import zlib

    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items() if i is not None)
    assert all(got[i].lang_pred == rows[i][2] for i in range(120))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und"] * 4
    assert got[600].languages == ["aa", "cc"]
    assert abs(got[600].score - 0.6) < 0.1
    assert [x.lang_pred for x in langid.identify(docs.filter("lang IS NULL")).collect()] == ["und"] * 4
    assert langid.identify(docs.filter("false")).collect() == []


def mixture_brute(words, table):
    """Proportions of the languages of one text, from lists of its words' scaled likelihoods."""

    def em(allowed):
        weights = {x: 1 / len(allowed) for x in allowed}
        for _ in range(langid.STEPS):
            shares = dict.fromkeys(allowed, 0.0)
            for like in words:
                total = sum(like[x] * weights[x] for x in allowed)
                for x in allowed:
                    shares[x] += like[x] * weights[x] / total
            weights = {x: shares[x] / len(words) for x in allowed}
        return weights, sum(math.log(sum(like[x] * weights[x] for x in allowed)) for like in words)

    price = langid.PENALTY * 0.5 * math.log(max(len(words), 2))
    allowed = list(range(table.shape[1]))
    best, total = em(allowed)
    value = total - price * len(allowed)
    limit = min(0.5 / len(words), max(best.values()) / 2)
    allowed = [x for x in allowed if best[x] > limit]
    while allowed:
        weights, total = em(allowed)
        if total - price * len(allowed) > value:
            best, value = weights, total - price * len(allowed)
        allowed.remove(min(allowed, key=lambda x: (weights[x], x)))
    return [best.get(x, 0.0) for x in range(table.shape[1])]


def test_mixtures_equal_brute_force():
    r = random.Random(11)
    signs = ["abcdef", "defghi", "äöüij", "xyzab"]
    words = [["".join(r.choice(s) for _ in range(r.randint(1, 7))) for _ in range(60)] for s in signs]
    table = np.full((langid.BUCKETS, 4), langid.SMOOTH)
    for i, own in enumerate(words):
        for grams in langid.words_of([" ".join(own)])[0]:
            np.add.at(table[:, i], grams, 1)
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    texts = [" ".join(r.choice(words[i]) for i in r.choices(range(4), weights=w, k=n)) for n in (1, 3, 40, 150) for w in ((1, 0, 0, 0), (3, 0, 2, 0), (1, 1, 1, 1), (0, 8, 1, 1))]
    texts += ["", None, "!?"]
    got = langid.mixtures(texts, table)
    for text, row in zip(texts, got, strict=True):
        likes = []
        for word in (text or "").split():
            if not any(c.isalpha() for c in word):
                continue
            logs = sum(table[g].sum(axis=0) for g in langid.words_of([word])[0]) / len(langid.ORDERS)
            likes.append(np.exp(np.maximum(logs - logs.max(), -60)).tolist())
        want = mixture_brute(likes, table) if likes else [0.0] * 4
        assert np.allclose(row, want, atol=1e-5), text


def test_held_out_accuracy(spark):
    from termfall.llm.queries import op2_language_id

    from ..conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op2_language_id(spark, SF).filter("held_out").join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_released_tables_leave_no_shuffle_files(spark, monkeypatch):
    """Their removal doesn't wait for the driver's garbage: none is collected here."""
    import glob
    import time

    from termfall.llm import common

    kind = type(spark.sparkContext._jvm.System)
    real = kind.__getattr__
    monkeypatch.setattr(kind, "__getattr__", lambda self, name: (lambda: None) if name == "gc" else real(self, name))
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    files = lambda: set(glob.glob(f"{folder}/*/shuffle_*.data"))
    before = files()
    df = spark.range(10_000).repartition(3, "id")
    assert common.written(df, "kept").count() == 10_000
    kept = files() - before
    assert kept
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    out = common.written(df, "released", release=True)
    until = time.time() + 5
    while (left := files() - before - kept) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == was
    assert out.count() == 10_000
