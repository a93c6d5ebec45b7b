"""Operators of the training-data subpackage on small fixtures, against brute force and on odd input."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, pii, quality, sentencepiece, sharding, simhash, toxicity, urls, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang"), columns.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, extra columns with clashing names."""
    long_ = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (None, "hello there", None, None, 11), (5, long_, "en", "b", len(long_)), (6, "same text here", "en", "a", 14), (6, "same text here", "en", "a", 14), (7, "😀 é 𝒳", "fr", "b", 5)]
    return spark.createDataFrame(rows, DOCS).withColumns({"words": F.lit(1), "bucket": F.lit("x"), "content": F.lit(2), "host": F.lit("h"), "key": F.lit(3), "fp": F.lit(4)})


@pytest.mark.parametrize("op", [pii.report, quality.quality, winnow.compare_edited, winnow.fingerprints, simhash.near_duplicates, sharding.shard_documents, sentencepiece.round_trip, langid.identify, lambda d: mixing.mix(d, {"a": 2, "b": 1}), lambda d: toxicity.score(d, None)])
def test_odd_rows_and_empty_tables(odd, op):
    assert op(odd).count() == odd.count()
    assert op(odd.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [quality.keep_good, simhash.keep_one, pii.mask, lambda d: mixing.in_order(d, {"a": 2, "b": 1})])
def test_stages_keep_columns(odd, stage):
    assert stage(odd).columns == odd.columns
    assert stage(odd.limit(0)).count() == 0


# ---- personal data -------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group(0))]


def test_base_spans_equal_plain_patterns(spark):
    pick = random.Random(3)
    texts = ["a@b.com_x@c.org x@y@z.co.uk ..a@b.c.d. 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004 4041894974608795 +1 (499) 555-6503 é€𝒳 a@b.cc", None, "", "9" * 30_000, "a" * 30_000 + "@" + "b." * 5_000 + "c", "+1" + "(" * 20_000]
    texts += ["".join(pick.choice("ab1204.@+-( )_%é=:\n") for _ in range(pick.randint(1, 60))) for _ in range(600)] + ["".join(pick.choice("0123456789 -.+") for _ in range(pick.randint(10, 60))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]


def test_patterns_find_unseen_identifiers_and_spare_clean_text(spark):
    texts = [f"some words then password=a{i}b{i:04d}c9d8e7f6a5 and more" for i in range(12)] + ["then password=Hunter-22 was set", "in 2024 there was nothing of note", "the version 4.0 came out"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs(spark, texts)).collect()}
    assert got[12] == "secret:14:23" and got[13] == got[14] == ""


def test_shape_alone_adds_no_span(spark):
    texts = [f"alone word{i} AKIA{'ABCDEFGHIJKLMN01'[i:]}{'ABCDEFGHIJKLMN01'[:i]} here" for i in range(2)] + [f"the key: AKIA{'ABCDEFGHIJKLMN02'[i:]}{'ABCDEFGHIJKLMN02'[:i]} was seen" for i in range(4)] + ["the key: my-own-77 was seen"]
    got = [r["spans"] for r in pii.report(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[:2] == ["", ""] and got[2:6] == ["secret:9:29"] * 4 and got[6] == "secret:9:18"


def plain_bootstrap(texts):
    """Added spans (kind, start, end) of each text by the rules of the module, in plain Python, for texts without base entities."""
    instances, uses = [], collections.Counter(w for t in texts for w in t.lower().split())
    for n, t in enumerate(texts):
        last = 0
        for m in re.finditer(r"\S+", t):
            tok = m.group(0)
            if not re.search(r"[0-9@]|(?<=[A-Za-z_])=", tok):
                continue
            key = (re.match(r"([A-Za-z_][A-Za-z_.-]*[=:][\"']?)", tok) or [""])[0]
            rest = tok[len(key):]
            head = len(re.match(r"[\"'(\[{<]*", rest).group(0))
            start, end = m.start() + len(key) + head, m.end() - (len(rest) - len(rest.rstrip("\"'.,;:!?)]}>")))
            gap = t[last : m.start()].lower().split()
            last = m.end()
            letters = [i for i, w in enumerate(gap) if any(c.isalpha() for c in w)]
            context, cue = (key.lower(), None) if key else (" ".join(gap[letters[-1] :]) + " " + re.match(r"[\"'(\[{<]*", tok).group(0), gap[letters[-1]]) if letters else ("", None)
            if context and end - start >= 4:
                value = t[start:end]
                shape = re.match(r"(?:AKIA[0-9A-Z]{16}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,})$", value)
                instances.append((n, context, cue, value, start, end, bool(shape)))
    seen, cues, pairs = collections.Counter(), {}, collections.Counter()
    for _, context, cue, value, *_ in instances:
        seen[context] += 1
        cues[context] = cue
        pairs[context, value] += 1
    total = {c: max(seen[c], uses.get(cues[c], 0)) for c in seen}
    believed, chosen = {v for *_, v, _, _, s in instances if s}, set()
    for _ in range(pii.ROUNDS):
        good, support = collections.Counter(), collections.Counter()
        for (c, v), k in pairs.items():
            if v in believed:
                good[c] += k
                support[c] += 1
        chosen = {c for c in good if support[c] >= pii.MIN_SUPPORT and good[c] / total[c] >= pii.MIN_CONFIDENCE}
        believed |= {v for c, v in pairs if c in chosen}
    return [sorted({("secret", a, b) for m, c, _, _, a, b, _ in instances if m == n and c in chosen}) for n in range(len(texts))]


def test_added_spans_against_brute_force(spark):
    pick = random.Random(21)
    secret = lambda: "".join(pick.choice("abcdef") + pick.choice("0123456789") for _ in range(10))
    other = lambda: "".join(pick.choice("ghijk") for _ in range(5)) + str(pick.randint(10, 99))
    lead = ["token is", "token --", "pwd=", "password:", "see page", "in", "secret ("]
    texts = []
    for _ in range(250):
        words = []
        for _ in range(pick.randint(1, 6)):
            words += [pick.choice(["some", "plain", "words", "token", "Über"]) for _ in range(pick.randint(0, 4))]
            k = pick.choice(lead)
            value = (secret if k in lead[:4] and pick.random() < 0.9 else other)()
            words.append(f"{k}{value}" if k[-1] in "=:(" else f"{k} {value}{pick.choice(['', '.', ')'])}")
        texts.append(" ".join(words))
    got = [r["spans"] for r in pii.report(docs(spark, texts)).orderBy("doc_id").collect()]
    want = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in plain_bootstrap(texts)]
    assert got == want and any(got)


def test_very_long_text_in_proportion(spark):
    text = " ".join(f"token is ab{i:06d}cd and mail a{i}@b.org" for i in range(30_000))  # 240,000 tokens, 60,000 of them instances
    t = time.perf_counter()
    r = pii.report(docs(spark, [text])).first()
    masked = pii.mask(docs(spark, [text])).first()["text"]
    assert r["n_email"] == 30_000 and masked.count("[EMAIL]") == 30_000 and time.perf_counter() - t < 120


def test_mask_replaces_spans(spark):
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs(spark, ["mail é a@b.com now +1 (499) 555-6503.", "clean", None])).collect()}
    assert got == {0: "mail é [EMAIL] now [PHONE].", 1: "clean", 2: None}


# ---- toxicity and language -----------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("aeioulnrst") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(40)] + ["zzkwqar" + word()[:2] for _ in range(4 * (i % 4 == 0))])) for i in range(800)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.classify(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and np.mean([(r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.classify(d, labels.limit(0)).collect()} == {0.0}


def plain_ngrams(text):
    """Hashes of the 3- to 6-grams of each distinct word with its ends marked, by the definition."""
    mask, out = (1 << 64) - 1, []
    for w in set(bytes(c if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 for c in (text or "").lower().encode()).decode().split(" ")) - {""}:
        line = f" {w} "
        for n in toxicity.LENGTHS:
            for i in range(len(line) - n + 1):
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & mask
                out.append((((h * 0x9E3779B97F4A7C15 + n) & mask) * 0x9E3779B97F4A7C15 & mask) >> (64 - toxicity.BITS))
    return sorted(out)


def test_toxicity_against_brute_force(spark):
    pick = random.Random(31)
    texts = [None, "", "a", "Ab 12-x é!"] + [" ".join("".join(pick.choice("abé1") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(0, 12))) for _ in range(76)]
    assert all(sorted(toxicity.features(t).tolist()) == plain_ngrams(t) for t in texts)
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    train = spark.createDataFrame([(int(k), t) for k, t in zip(y, texts, strict=True)], "label int, text string")
    ratios = toxicity.log_ratios(train, int(y.sum()), int((1 - y).sum()))
    sets = [set(plain_ngrams(t)) for t in texts]
    for f in set().union(*sets):
        p, q = (1 + sum(f in s for s, k in zip(sets, y, strict=True) if k == v) for v in (1, 0))
        r = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))
        assert ratios[f] == pytest.approx(0 if abs(r) < toxicity.MIN_RATIO or p + q < toxicity.LEAST_COUNT else r)
    # the fit, with all features of all rows in one dense matrix
    own = [collections.Counter(f for f in plain_ngrams(t) if ratios[f]) for t in texts]
    cols = sorted(set().union(*own))
    x = np.array([[c[f] * ratios[f] for f in cols] for c in own])
    w, b, m, v, mb, vb = np.zeros(len(cols)), np.log(y.mean() / (1 - y.mean())), 0, 0, 0, 0
    for t in range(1, 81):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        g, gb = x.T @ err + 1e-3 / len(y) * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.03 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    rows = [np.array(sorted(c), np.int64) for c in own]
    full, bias = toxicity.fit_weights(rows, [np.array([c[f] for f in sorted(c)], np.int64) for c in own], y, ratios)
    assert len(cols) > 5 and np.allclose(full[cols], w * ratios[cols], atol=1e-4) and bias == pytest.approx(b)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(d, (full, bias)).collect():
        z = bias + sum(float(full[f]) for f in plain_ngrams(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30)))) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_word_features_against_brute_force():
    mask, step, bits = (1 << 64) - 1, 0x9E3779B97F4A7C15, 64 - langid.BITS
    words = [b"a", b"ab", "é".encode(), b"word", b"longerword"]
    who, what = langid.word_features(words)
    for k, w in enumerate(words):
        line, grams = b" " + w + b" ", []
        for n in (2, 3, 4):
            for i in range(len(line) - n + 1):
                h = 0
                for c in line[i : i + n]:
                    h = (h * 263 + c) & mask
                grams.append((((h * step + n) & mask) * step & mask) >> bits)
        own = what[who == k].tolist()
        assert sorted(f for f in own if f < 1 << langid.BITS) == sorted(grams)
        assert len([f for f in own if f >= 1 << langid.BITS]) == 1  # the word itself, in the lexicon
    assert len({f for f in what.tolist() if f >= 1 << langid.BITS}) == len(words)


def brute_posteriors(e, trans):
    n, k = e.shape
    paths = list(itertools.product(range(k), repeat=n))
    w = np.array([np.exp(sum(e[i, p[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) * np.exp(trans)[:, p[0]].sum() for p in paths])
    return np.array([[w[[p[i] == c for p in paths]].sum() for c in range(k)] for i in range(n)]) / w.sum()


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    r = np.random.default_rng(0)
    lens = np.array([1, 7, 3, 8])
    e, trans = r.normal(size=(lens.sum(), 3)), r.normal(size=(3, 3))
    got, _ = langid.posteriors(e, lens, trans)
    at = 0
    for n in lens:
        assert np.allclose(got[at : at + n], brute_posteriors(e[at : at + n], trans))
        at += n


def test_language_of_invented_tongues(spark):
    pick = random.Random(2)
    make = {"aa": lambda: "".join(pick.choice(["ka", "to", "mi"]) for _ in range(3)), "bb": lambda: "".join(pick.choice(["üz", "ör", "äl"]) for _ in range(3))}
    rows = [(i, " ".join(make[k]() for _ in range(30)), k, None, None) for i, k in enumerate(["aa", "bb"] * 150)]
    rows += [(1000, "12 34 !?", "aa", None, None), (1001, None, "aa", None, None), (1002, " ".join(make["aa"]() for _ in range(9)), None, None, None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _, _ in rows[:300]) and got[1002]["lang_pred"] == "aa"
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und"


# ---- urls ----------------------------------------------------------------------------------------------------


def judge(rules, host, path):
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls_against_brute_force(spark):
    pick = random.Random(4)
    rules = [*urls.RULES, ("block", "a.b.com", "/"), ("block", "x-a.b.com", ""), ("allow", "a.b.com", "/x"), ("allow", "b.com", "/x"), ("block", "b.com", ""), ("block", "deep.er.b.com", "/x/y"), ("allow", "co", "/")]
    hosts = ["com", "b.com", "a.b.com", "z.a.b.com", "x-a.b.com", "a-x.b.com", "y.x-a.b.com", "ab.com", "deep.er.b.com", "example.com", "www.example.com", "q.www.example.com", "net", "x.net", "co", "x.co", "", "."]
    rows = [(i, f"http://{pick.choice(hosts).upper()}{pick.choice(['', '/', '/en/', '/en/q', '/es/1', '/x', '/x/y', '/fr'])}{pick.choice(['', '?a=/en/', '#f'])}") for i in range(800)] + [(900, None), (901, "no scheme"), (902, "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, rules), salts=3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["rule"], r["verdict"]) == judge(rules, r["host"], r["path"])
    assert urls.judge(spark.createDataFrame(rows[:5], "page_id long, url string"), urls.rule_table(spark, rules).limit(0)).filter("verdict = 'allow'").count() == 5


# ---- SentencePiece -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_pieces_equal_the_library(kind, tmp_path):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    path = sentencepiece.MODEL
    if kind == "unigram":  # the same pieces and scores read as a unigram model
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        proto.trainer_spec.model_type = 1
        path = str(tmp_path / "u.model")
        open(path, "wb").write(proto.SerializeToString())
    v, library, pick = sentencepiece.load(path), SentencePieceProcessor(model_file=path), random.Random(5)
    letters = ["a", "b", "e", "the", "ing", " ", "  ", "\n", "é", "=", "==", "----", "😀", "A", "0", "ß", "tion", "\t", "𝒳"]
    split = lambda ready, size: [(ready[max(0, lo - v.longest) : lo + size + v.longest], min(lo, v.longest), min(lo, v.longest) + min(size, len(ready) - lo)) for lo in range(0, len(ready), size)]
    for n in range(250):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(1, 40))) if n % 3 else "".join(pick.choice("abetheingo=-") for _ in range(pick.randint(50, 200)))
        ready = v.prepared(text)
        whole = v.whole([ready])[0].tolist()
        cells = split(ready, pick.choice([34, 40, 57]))
        states = sentencepiece.best_states([v.matrix(*c) for c in cells])
        parts = [i for x in v.between([(*c, a, b) for c, a, b in zip(cells, states, states[1:], strict=False)]) for i in x.tolist()]
        want = library.encode(text)
        score = lambda ids: sum(library.get_score(i) if not library.is_byte(i) else 0 for i in ids)
        if kind == "bpe":
            assert whole == parts == want
        else:  # paths of equal weight may differ, and the library adds in single precision
            assert score(whole) == pytest.approx(score(parts)) and score(whole) >= score(want) - 1e-3
        assert v.decode(whole) == v.decode(parts) == text


def test_products_are_associative():
    v = sentencepiece.load()
    ready, size = v.prepared("abcabcingthe" * 20), 40
    m = [v.matrix(ready[max(0, lo - v.longest) : lo + size + v.longest], min(lo, v.longest), min(lo, v.longest) + min(size, len(ready) - lo)) for lo in range(0, len(ready), size)]
    a = sentencepiece.product(sentencepiece.product(m[0], m[1]), m[2])
    b = sentencepiece.product(m[0], sentencepiece.product(m[1], m[2]))
    assert sorted(a) == sorted(b)


def test_giant_texts_go_through_chunks(spark):
    from sentencepiece import SentencePieceProcessor

    pick = random.Random(6)
    texts = ["".join(pick.choice("abetheingo =-\n") for _ in range(n)) for n in (10, 99, 100, 101, 700, 4000)] + ["x" * 500, "", None]  # up to three levels of the tree
    texts += ["".join(pick.choice("abethe𝒳é \n") for _ in range(2_000))]
    got = {r["doc_id"]: r["ids"] for r in sentencepiece.encode(docs(spark, texts), chunk=100).collect()}
    library = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}


def test_megabytes_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    pick = random.Random(16)
    word = lambda: "".join(pick.choice("abetheingosrn") for _ in range(pick.randint(1, 11)))
    texts = [" ".join(word() for _ in range(170_000)), "".join(pick.choice("abethe") for _ in range(60_000))]  # about a megabyte; no break at all
    library = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = {r["doc_id"]: r for r in sentencepiece.round_trip(docs(spark, texts)).collect()}
    assert all(got[i]["ids"] == library.encode(t) and got[i]["round_trip"] for i, t in enumerate(texts))


# ---- near duplicates -----------------------------------------------------------------------------------------


def slow_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_and_golay_keys_lose_no_link():
    for t in ["One two THREE four five É", "", "a", "a b", "x " * 50, None]:
        assert simhash.simhash(t) % (1 << 64) == slow_simhash(t)
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 64, 150, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, r.integers(1, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    key, fp = simhash.key_rows(np.concatenate([a, b]))
    by = {}
    for k, f in zip(key.tolist(), fp.view(np.uint64).tolist(), strict=True):
        by.setdefault(k, set()).add(f)
    shared = {(x, y) for s in by.values() for x in s for y in s}
    assert all((x, y) in shared for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_near_duplicates_against_brute_force(spark):
    pick = random.Random(8)
    words = lambda n: [f"w{pick.randint(0, 5000)}" for _ in range(n)]
    groups = [words(300) for _ in range(8)]
    texts = []
    for g in groups:
        for _ in range(5):
            copy = list(g)
            copy[pick.randrange(300)] = f"edit{pick.random()}"
            texts.append(" ".join(copy))
        texts.append(" ".join(g))
    texts += [" ".join(words(200)) for _ in range(20)] + ["", None, " "]
    fp = [slow_simhash(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{fp[i]:016x}" and got[i]["component_id"] == find(i)
    assert simhash.keep_one(docs(spark, texts)).count() == len({find(i) for i in range(len(texts))})


# ---- quality -------------------------------------------------------------------------------------------------


def test_base_counts_against_brute_force(spark):
    pick = random.Random(9)
    texts = ["\n".join(" ".join(pick.choice("ab#*é") for _ in range(pick.randint(0, 6))) for _ in range(pick.randint(1, 12))) for _ in range(150)] + ["a b", "a b c", "a a a a", None, ""]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))


def test_frequent_lines_deplete_a_document(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))  # noqa: E731  digits count as equal in lines
    own = lambda i, n: " ".join(f"own{name(i)}x{name(k)}" for k in range(n))
    menu = " ".join(f"menu{name(k)}" for k in range(60))
    texts = [f"{own(i, 200)}\n{menu}" for i in range(30)] + [f"{own(99, 5)}\n{menu.upper()}"] + [own(i, 80) for i in range(100, 140)]
    d = docs(spark, texts, source="h")
    got = {r["doc_id"]: r for r in quality.quality(d).collect()}
    assert [i for i, r in got.items() if not r["kept"]] == [30] and got[30]["n_removed"] == 60
    stripped = {r["doc_id"]: r["text"] for r in quality.strip_lines(d, quality.frequent_lines(d)).collect()}
    assert len(stripped) == 31 and stripped[0] == own(0, 200)
    copies = docs(spark, [f"{own(1, 100)}\n{own(2, 100)}"] * 60, source="h")
    assert quality.quality(copies).filter("kept").count() == 60


# ---- winnowing -----------------------------------------------------------------------------------------------


def test_winnowing_guarantee_and_ties(spark):
    pick = random.Random(10)
    shared = " ".join(f"s{k}" for k in range(winnow.K + winnow.W - 1))
    rows = [(i, " ".join(f"a{pick.random()}" for _ in range(pick.randint(0, 30))) + f" {shared} " + " ".join(f"b{pick.random()}" for _ in range(pick.randint(0, 30)))) for i in range(40)]
    sets = [{x["hash"] for x in r["chosen"]} for r in winnow.fingerprints(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()]
    assert set.intersection(*sets)
    same = winnow.fingerprints(docs(spark, ["w " * 40])).first()["chosen"]
    assert [x["pos"] for x in same] == list(range(winnow.W - 1, 40 - winnow.K + 1))  # the rightmost of equal hashes in each window


def plain_winnow(text):
    """(hash, position) pairs by the definition, each run hashed anew."""
    codes = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = xxhash.xxh64_intdigest(w.lower().encode(), 42)
        codes.append((h - (1 << 64) if h >> 63 else h) % winnow.PRIME)
    runs = [codes] if 0 < len(codes) < winnow.K else [codes[i : i + winnow.K] for i in range(len(codes) - winnow.K + 1)]
    hashes = [sum(c * pow(winnow.BASE, len(r) - 1 - j, winnow.PRIME) for j, c in enumerate(r)) % winnow.PRIME for r in runs]
    chosen = []
    for i in range(max(1, len(hashes) - winnow.W + 1) if hashes else 0):
        part = [(h, -p) for p, h in enumerate(hashes[i : i + winnow.W], i)]
        h, p = min(part)
        if (h, -p) not in chosen:
            chosen.append((h, -p))
    return chosen


@pytest.mark.parametrize("range_rows, coarse", [(7, 4), (7, 256), (1000, 256)])
def test_edited_texts(spark, monkeypatch, range_rows, coarse):
    monkeypatch.setattr(winnow, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(winnow, "COARSE", coarse)
    pick = random.Random(11)
    texts = ["".join(pick.choice("ab é𝒳") for _ in range(pick.randint(0, 25))) for _ in range(90)] + [" ".join(pick.choice(["x", "Y", "ü", "w1", "z"]) for _ in range(pick.randint(30, 120))) for _ in range(30)]
    got = {r["doc_id"]: r for r in winnow.compare_edited(docs(spark, texts)).collect()}
    digest = lambda hashes: "".join(f"{h:08x}" for h in hashes)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    own = [list(dict.fromkeys(h for h, _ in plain_winnow(t))) for t in texts]
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[i - 1][:half]
        e = list(dict.fromkeys(h for h, _ in plain_winnow(edited)))
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == digest(own[i]) and r["edited_fingerprint"] == digest(e) and r["positions"] == ",".join(str(p) for _, p in plain_winnow(t))
        assert r["near_edited"] == pytest.approx(like(own[i], e)) and r["near_next"] == pytest.approx(like(own[i], own[i - 1]))


def test_ids_that_are_text(spark):
    rows = [(f"doc{i:03d}", f"text {i}") for i in range(50)]
    got = {r["doc_id"]: r for r in winnow.compare_edited(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(got) == 50


# ---- sharding and mixing -------------------------------------------------------------------------------------


def draw(key, shard):
    """xxhash64 of a string and an int as Spark chains it, by the library."""
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    monkeypatch.setattr(sharding, "RUN_ROWS", 7)
    rows = [(i, f"text {i}é") for i in range(1500)] + [(3, "other")] * 40 + [(None, f"t{i}") for i in range(30)] + [(None, None)] * 20
    got = sharding.shard_documents(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["text_crc32"], r["size"]) for r in got) == sorted((str(i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    for r in got:
        cost = [-math.log(((draw(str(r["doc_id"]) if r["doc_id"] is not None else "\0null", s) >> 11) + 0.5) / (1 << 53)) / w for s, w in enumerate([*sharding.WEIGHTS, 1.0])]
        assert r["shard"] == min(range(40), key=cost.__getitem__) and r["grown_shard"] == min(range(41), key=cost.__getitem__)
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_rendezvous_moves_only_into_the_new_shard(spark):
    rows = sharding.shard_documents(docs(spark, [f"t{i}" for i in range(2000)])).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows) and 0 < sum(r["grown_shard"] == 40 for r in rows) < 150
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    shares = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1, 3]).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in shares}[1] / 20_000 - 0.75) < 0.02


def test_mix_stays_within_one_block(spark):
    weights = {"a": 5, "b": 3, "c": 1}
    rows = [(i, "t", None, s, 1) for i, s in enumerate(["a"] * 400 + ["b"] * 130 + ["c"] * 90 + ["z"] * 55 + [None] * 3)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights, other=2, block_rows=4).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    slots = {r["slot"]: r["mix_source"] for r in got}
    assert sorted(slots) == list(range(len(slots))) and all(r["slot"] < r["deadline"] for r in got)
    total, blocks = {**weights, "other": 2}, {"a": 100, "b": 33, "c": 23, "other": 15}
    done = dict.fromkeys(total, 0)
    for t in range(len(slots)):
        done[slots[t]] += 1
        lo, hi = 0.0, 200.0  # fluid time at which t + 1 blocks have been given
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(total[s] * mid, blocks[s]) for s in total) < t + 1 else (lo, mid)
        assert all(abs(done[s] - min(total[s] * hi, blocks[s])) < 1 + 1e-6 for s in total)
