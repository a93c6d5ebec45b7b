"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and the forms they are variants of.

All words form two tries, one of their beginnings and one, of the words reversed, of their ends; the nodes of each are numbered. A word stands at each of its places
as a pair of two integers: the node of what lies before the place and the node of what lies behind it. At a skipped place one code point is left out between the
two, at an inserted place none. Two words of one skipped pair differ in just that code point; a skipped pair of a longer word that is an inserted pair of a shorter
one has one code point more. So joining pairs of integers gives all neighbours and nothing else. Leaving out any code point of a run of equal ones
gives the same word, so only the first one is joined with inserted places and no two words meet twice.

Scale: words are counted in each task before the shuffle; all that follows grows with the dictionary, not with the text. No prefix is written out: a node is known
by the 128-bit hash of its string, made step by step, until it has its number, so a word takes rows in proportion to its length. Roots are number 0 by
rule, nodes of one word are left out, as no other word can share a pair with it, and nodes of very many words are joined by ``join_hot``. A pair of nodes with a skipped code point has at most as many words as the alphabet has
letters, one with an inserted place has one, so no key of the last join is large. Forms are followed by doubling: a form occurs at least twice as often as its
variant, so chains are short and there are no cycles.

Defined results: null texts have no words; null ids count as empty in the damage that the rule of ``damage`` does; equal rows count each; ties of a form go to the word that is
first in code-point order; an empty table gives no rows; extra columns are left out; very long texts are searched whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, join_hot

#: A run of letters after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
#: Distinct words that a task counts at a time.
WORDS_AT_ONCE = 300_000
#: Rows that a task writes at once.
ROWS_AT_ONCE = 20_000


def damaged(key: str, word: str, one_in: int) -> str:
    """The word without one code point, if the hash of ``key:word`` says so: a known share of misspellings, for measuring."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _words(least: int, one_in: int | None):
    run_of = re.compile(LETTERS)

    def run(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in columns:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(run_of.findall(text.encode().lower().decode()))  # bytes lower-case A-Z only
                if one_in is None:
                    seen.update({w: n for w, n in found.items() if len(w) >= least})
                else:
                    head = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for w, n in found.items():
                        if len(w) >= least:
                            h = zlib.crc32(w.encode(), head)
                            if h % one_in == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least:
                                    continue
                            seen[w] += n
                if len(seen) >= WORDS_AT_ONCE:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def count_words(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, damage: int | None = None) -> DataFrame:  # noqa: A002
    """word and n (occurrences): runs of letters of at least that length and count. ``damage``: one in so many words of a document loses a code point first,
    by the checksum of its id and the word."""
    parts = docs.select(F.col(id).cast("string"), text).mapInArrow(_words(least_length, damage), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


#: Kinds of places: inserted, skipped, and skipped at the first of equal code points.
GAP, SKIP, FIRST_SKIP = 0, 1, 2
_PLACES = "word_id long, kind int, before binary, behind binary"


def _places(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skipped and inserted places of words, with the hashes of what lies before and behind them; null for nothing."""
    names = [x.split()[0] for x in _PLACES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def hashes(cs: list[bytes]) -> list[bytes | None]:
        h, out = xxhash.xxh3_128(), [None]
        for c in cs:
            h.update(c)
            out.append(h.digest())
        return out

    for batch in columns:
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)  # noqa: B023, E731
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cs = [c.encode("utf-32-le", "surrogatepass") for c in word]
            before, behind = hashes(cs), hashes(cs[::-1])[::-1]  # of word[:i] and word[i:]
            for i in range(len(cs) + 1):
                rows.append((number, GAP, before[i], behind[i]))
                if i < len(cs):
                    rows.append((number, FIRST_SKIP if i == 0 or cs[i] != cs[i - 1] else SKIP, before[i], behind[i + 1]))
                if len(rows) >= ROWS_AT_ONCE:
                    yield out()
                    rows = []
        if rows:
            yield out()


def _numbered(rows: DataFrame, places: DataFrame, node: str, total: int) -> DataFrame:
    """``rows`` with the number of the trie's node in place of its hash: 0 for the root; rows at a node that one word alone has, and so no neighbour, are left out.

    ``places`` has the places of all words: a word has each node at one inserted place, and at one skipped place at most. What is left of them after the other
    side's nodes would not do: words that differ at a place have no node in common just before what they share behind it.
    """
    held = places.filter((F.col("kind") == GAP) & F.col(node).isNotNull()).groupBy(node).agg((2 * F.count("*")).alias("n"))
    nodes = cut(held.filter("n > 2")).withColumn(f"{node}_no", F.monotonically_increasing_id() + 1)
    found = join_hot(rows.filter(F.col(node).isNotNull()), nodes, node, total, F.col("word_id")).filter(F.col(f"{node}_no").isNotNull())
    return found.unionByName(rows.filter(F.col(node).isNull()).withColumn(f"{node}_no", F.lit(0).cast("long"))).drop(node)


def pairs_of(words: DataFrame) -> DataFrame:
    """word_id, kind, front and back (numbers of the nodes before and behind a place) of words (word_id, word), where other words have both nodes too."""
    places = cut(words.select("word_id", "word").mapInArrow(_places, _PLACES))
    total = 2 * (words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("n")).first()["n"])
    out = _numbered(_numbered(places, places, "before", total), places, "behind", total)
    return out.select("word_id", "kind", F.col("before_no").alias("front"), F.col("behind_no").alias("back"))


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, other (the id of a word at one insertion, deletion or replacement), both ways, each once."""
    pairs = cut(pairs_of(words))
    skips = pairs.filter(F.col("kind") != GAP)
    side = lambda rows, name: rows.select("front", "back", F.col("word_id").alias(name))
    replaced = side(skips, "word_id").join(side(skips, "other"), ["front", "back"]).filter("word_id <> other").select("word_id", "other")
    longer = side(pairs.filter(F.col("kind") == FIRST_SKIP), "word_id").join(side(pairs.filter(F.col("kind") == GAP), "other"), ["front", "back"]).select("word_id", "other")
    return replaced.unionByName(longer).unionByName(longer.select(F.col("other").alias("word_id"), F.col("word_id").alias("other")))


def group(counted: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for counted words (word, n).

    A word's form is its neighbour of largest n, if that is at least ``ratio`` times the word's own; root is the last form of the chain.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often, so that chains end")
    # numbers rise in code-point order, which is that of the bytes
    words = cut(counted.select("word", "n").orderBy("word")).withColumn("word_id", F.monotonically_increasing_id())
    near = neighbours(words).join(words.select(F.col("word_id").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word_id").agg(F.count("*").alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("back"))).alias("best"))
    found = words.join(best, "word_id", "left")
    is_form = F.col("best.other_n") >= ratio * F.col("n")
    found = cut(found.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.back")).alias("form_id"), F.when(is_form, F.col("best.other_n")).alias("form_n")))
    # to: how far a word's chain is known; every round doubles that
    to = found.filter("form_id is not null").select("word_id", F.col("form_id").alias("to"))
    while True:
        ahead = to.select(F.col("word_id").alias("_at"), F.col("to").alias("_to"))
        now = cut(to.join(ahead, F.col("to") == F.col("_at"), "left").select("word_id", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        to = now.select("word_id", "to")
        if now.filter("moved").isEmpty():
            break
    name = words.select(F.col("word_id").alias("_id"), F.col("word").alias("_word"))
    ends = to.join(name, F.col("to") == F.col("_id")).select("word_id", F.col("_word").alias("root"))
    forms = found.filter("form_id is not null").select("word_id", "form_id").join(name, F.col("form_id") == F.col("_id")).select("word_id", F.col("_word").alias("form"))
    out = found.join(forms, "word_id", "left").join(ends, "word_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
