"""Operators 11 to 13 against plain loops, round trips and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, packing, spelling
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import ByteTokens, PieceTokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n\n  x \t", "été Été ÉTÉ", "<|endoftext|> in a text<|endoftext|>", "one▁two", "日本語 text", "a b　c", "\U0001F600" * 3, "word " * 3000, "x" * 20_000, "same", "same"]


def odd_docs(spark, ids="string"):
    """Repeated and null ids, extra columns with names that helpers use."""
    rows = [(None if i % 5 == 0 else str(i % 4), t, "u", 1, 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id string, text string, pair string, n int, word_id int").withColumn("doc_id", F.col("doc_id").cast(ids))


def small_docs(spark, small):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def random_texts(n=400):
    pick = random.Random(2)
    return ["".join(pick.choice(" \n\tabZé1.'s▁ 　\x1c日本\U0001F600-~͸") for _ in range(pick.randint(0, 40))) for _ in range(n)]


# ---- encoding ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_those_of_the_library(special):
    tokens, library = ByteTokens(A, special), Tokenizer.from_file(A)
    library.encode_special_tokens = not special
    texts = [*random_texts(), *[t for t in ODD if t]]
    assert tokens.quick is not None
    assert tokens.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(b"".join(tokens.bytes_of[i] for i in ids) == t.encode() for t, ids in zip(texts, tokens.encode(texts), strict=True))


# ---- op11 ----------------------------------------------------------------------------------------------------


def counted(docs, one_in):
    out = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            out[spelling.damaged("" if key is None else str(key), word, one_in)] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            u = w[:i] + w[i + 1 :]
            if u in words:
                near[w].add(u)
                near[u].add(w)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_against_plain_loops(spark, small):
    want = grouped(counted(small_docs(spark, small), 97))
    assert found(QUERIES["op11_spelling"](spark, small)) == want and any(v[0] for v in want.values())


def test_spelling_of_a_dense_dictionary(spark):
    pick = random.Random(7)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(1, 6))): pick.choice((1, 2, 4, 8, 16, 40, 100)) for _ in range(400)} | {"aaaaaaaa": 50, "aaaaaaa": 100, "z" * 3000: 9, "z" * 2999: 3}
    got = found(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert any(v[0] not in (None, v[1]) for v in got.values())  # chains of more than one form


def test_spelling_of_words_with_no_other_beginnings_or_ends(spark):
    pick = random.Random(1)
    words = {"abcde": 10, "xbcde": 3, "information": 10, "infoxmation": 3}
    for _ in range(60):
        w = "".join(pick.choice("abcdefgh") for _ in range(pick.randint(5, 9)))
        at = pick.randrange(len(w))
        words |= {w: pick.randint(3, 40), w[:at] + pick.choice(["", "z", "é", "ab"]) + w[at + 1 :]: pick.randint(3, 40)}
    got = found(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and got["infoxmation"][:2] == ("information", "information")


def test_no_pair_of_words_meets_twice(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["aaaa", "aaaaa", "aaab", "abab", "abbb", "bb", "b", ""])], "word_id long, word string")
    pairs = [tuple(r) for r in spelling.neighbours(words).select("word_id", "other").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(b, a) for a, b in pairs}


def test_spelling_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spelling.group(spelling.count_words(docs, damage=97))) == grouped(counted(rows, 97))
    assert spelling.group(spelling.count_words(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        spelling.group(spelling.count_words(docs), ratio=1)


# ---- op12 ----------------------------------------------------------------------------------------------------


def test_gallop_is_the_rank():
    pick = np.random.default_rng(3)
    for n, m in [(0, 5), (1, 1), (3, 2000), (50, 60), (500, 500), (9, 100_000)]:
        short, long = np.sort(pick.choice(3 * m + 9, n, replace=False)), np.sort(pick.choice(3 * m + 9, m, replace=False))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def ends(ids, names):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(names[i])))
        at = out[-1][1]
    return out


def plain_alignment(texts):
    a, b = ByteTokens(A, special=False), PieceTokens(B)
    per, counts = [], Counter()
    for text in texts:
        raw = f" {text or ''}".encode()
        x, y = a.library.encode(f" {text or ''}", add_special_tokens=False).ids, b.library.encode(text or "")
        if not text or b"".join(a.bytes_of[i] for i in x) != raw or b"".join(b.bytes_of[i] for i in y) != raw:
            per.append(None)
            continue
        p, q = ends(x, a.bytes_of), ends(y, b.bytes_of)
        links = [(x[i], y[j]) for i, (s, e) in enumerate(p) for j, (u, v) in enumerate(q) if s < v and u < e] if len(p) < 400 else None
        if links is None:  # long texts: only neighbours in order can overlap
            links, j = [], 0
            for i, (s, e) in enumerate(p):
                while q[j][1] <= s:
                    j += 1
                k = j
                while k < len(q) and q[k][0] < e:
                    links.append((x[i], y[k]))
                    k += 1
        both = sorted({e for _, e in p} & {e for _, e in q})
        groups, s = [], 0
        for e in both:
            own = lambda ids, spans, s=s, e=e: ",".join(str(i) for i, (u, v) in zip(ids, spans, strict=True) if s <= u and v <= e)
            groups.append(own(x, p) + "|" + own(y, q) if len(p) < 400 else None)
            s = e
        per.append((len(x), len(y), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(p) < 400 else None))
        counts.update(links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], p[2], len(p[3]), sum(counts[k] == best[k[1]] for k in p[3]), sum(counts[k] for k in p[3]), p[4]) for p in per]


def shown(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


@pytest.mark.parametrize("hot", [1, 300, alignment.HOT])
def test_alignment_against_plain_loops(spark, hot):
    texts = [*random_texts(250), *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: shown(r) for r in alignment.align(docs, hot=hot).collect()}
    for i, want in enumerate(plain_alignment(texts)):
        assert got[i][: 6 + (want[6] is not None)] == want[: 6 + (want[6] is not None)], texts[i]


def test_alignment_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = alignment.align(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    same = [shown(r) for r in got if r["n_a"] == 1 and r["n_b"] == 1 and r["n_groups"] == 1]
    assert len([s for s in same if same.count(s) > 1]) >= 2  # equal texts, equal rows
    assert sum(r["n_links"] == 0 and r["groups_sha256"] == "" for r in got) >= 3
    assert alignment.align(docs.limit(0)).collect() == []
    assert alignment.align(docs.filter("text is null")).first()["count_sum"] == 0


# ---- op13 ----------------------------------------------------------------------------------------------------


def check_pieces(rows, want):
    """Every id of every example lies in one piece, sequences have no gaps, and limits hold. Returns tokens, segments of each sequence."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for key, ids in want.items():
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            at += r["length"]
            assert np.frombuffer(r["ids"], np.uint32).tolist() == ids[r["start"] : at]
        assert at == len(ids)
    out = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        out.append((at, own))
    return out


def test_packing_of_whole_texts(spark, small):
    library = Tokenizer.from_file(A)
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in small_docs(spark, small)}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = check_pieces(packing.pack(docs, tokenizer=A).collect(), want)
    total = sum(n for n, _ in sizes)
    assert all(n <= 1024 and len(own) <= 256 for n, own in sizes)
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n, _ in sizes) <= 0.001 * total
    for r in QUERIES["op13_packing"](spark, small).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_under_three_limits(spark, small):
    """Conversations whose assistant turns bear loss: whole examples, and each limit binds somewhere."""
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    part = F.struct("turn", F.col("text"), (F.col("role") == "assistant").alias("loss"))
    examples = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("turns")).select(F.col("conv_id").alias("doc_id"), F.transform("turns", lambda t: F.struct(t["text"].alias("text"), t["loss"].alias("loss"))).alias("parts")).cache()
    tokens, want, bears = ByteTokens(A, True), {}, {}
    for r in examples.collect():
        ids = tokens.encode([p["text"] or "" for p in r["parts"]])
        want[r["doc_id"]] = [i for x in ids for i in x] + [0]
        bears[r["doc_id"]] = [p["loss"] for x, p in zip(ids, r["parts"], strict=True) for _ in x] + [r["parts"][-1]["loss"]]
    longest, most_loss = max(map(len, want.values())), max(map(sum, bears.values()))
    for limits in (packing.Limits(4 * longest, 3, 10**6), packing.Limits(longest, 100, most_loss), packing.Limits(longest, 4, 10**6), packing.Limits(max(2, longest // 3), 5, max(1, most_loss // 3))):
        sizes = check_pieces(packing.pack(examples, text="parts", limits=limits, tokenizer=A, cut=False).collect(), want)
        for n, own in sizes:
            loss = sum(sum(bears[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in own)
            assert n <= limits.tokens and len(own) <= limits.segments and loss <= limits.loss
            for r in own:  # only what no sequence could hold alone is cut
                assert r["length"] == len(want[r["doc_id"]]) or len(want[r["doc_id"]]) > limits.tokens or sum(bears[r["doc_id"]]) > limits.loss
        # no two sequences of a task could be one, but for those that were full when they closed
        if limits.segments == 3:
            assert sum(len(own) == 3 for _, own in sizes) >= len(sizes) - 4 - len({n >> 33 for n in {r["sequence_id"] for _, o in sizes for r in o}})


def test_the_heuristic_takes_the_largest_dot_product():
    packer = packing.Packer(packing.Limits(100, 10, 100), cut=False)
    piece = lambda n, loss: packing.Piece((n, loss), n, 0, np.zeros(n, np.uint32), np.concatenate([[0], np.cumsum(np.arange(n) < loss)]))
    for p in (piece(50, 0), piece(40, 40), piece(10, 10), piece(45, 5)):
        assert list(packer.add(p)) == []
    # (40, 40) has most of both; with 60 tokens and 60 loss left (50, 0) is worth .3 and (45, 5) .27 + .03, both with the same share of a segment: the first stays ahead
    assert [[p.row for p in s] for s in packer.rest()] == [[(40, 40), (50, 0), (10, 10)], [(45, 5)]]


def test_packing_random_pieces():
    pick = random.Random(5)
    for cut in (True, False):
        for _ in range(30):
            limits = packing.Limits(pick.choice((1, 7, 64)), pick.choice((1, 3, 50)), pick.choice((1, 5, 64)))
            packer, out, held = packing.Packer(limits, cut, pool=pick.choice((2, 9, 100))), [], {}
            for k in range(pick.randint(0, 60)):
                n = pick.randint(1, 200)
                held[k] = [pick.random() < 0.5 for _ in range(n)]
                out += packer.add(packing.Piece(k, n, 0, np.arange(n, dtype=np.uint32), np.concatenate([[0], np.cumsum(held[k])])))
            out += packer.rest()
            seen = defaultdict(list)
            for s in out:
                assert s and sum(len(p.ids) for p in s) <= limits.tokens and len(s) <= limits.segments
                assert sum(sum(held[p.row][p.start : p.start + len(p.ids)]) for p in s) <= limits.loss
                for p in s:
                    seen[p.row] += p.ids.tolist()
            assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(len(v))) for k, v in held.items()}


def test_packing_of_odd_rows(spark):
    for ids in ("string", "int"):
        docs = odd_docs(spark, ids)
        rows = packing.pack(docs, tokenizer=A).collect()
        assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ByteTokens(A, True).encode([t or "" for t in ODD]))
        assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert packing.pack(docs.limit(0), tokenizer=A).collect() == []
    assert packing.pack(docs.select("doc_id", F.lit(None).cast("array<struct<text:string,loss:boolean>>").alias("text")), tokenizer=A).count() == len(ODD)
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)
