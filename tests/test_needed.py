"""What a pattern's matches need, so that other texts are not searched."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V


@pytest.mark.parametrize(("pattern", "words"), [
    (r"\bgoing\s+concern\b", {"concern"}), (r"\b(merger|acquisition)\s+(talks?|x)\b", {"acquisition", "merger"}), (r"a?b*", None), (r"[ab]c", {"c"}), (r"(?:ab)?cde(?!fgh)", {"cde"}),
    (r"(Moody|S&P)", {"moody", "s&p"}), (r"x{0,3}", None), (r"(ab){2}", {"ab"}), (r"\p{L}+x", None), (r"(|abc)", None), ("", None),
])
def test_needed_words(pattern, words):
    got = X.needed(pattern)
    assert (None if got is None else set(got)) == words


def test_every_match_holds_a_needed_word():
    """Texts made from the patterns' own words: where a pattern matches, a needed word is there."""
    pick = random.Random(3)
    patterns = [p for _, _, ps in V.RULES for p in ps] + [p for _, _, ps in V.CLAUSES for p in ps]
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z0-9&-]+", p.replace("\\b", " ").replace("\\s", " "))})
    hits = 0
    for _ in range(6_000):
        text = " ".join(pick.choice(words) for _ in range(12)).lower()
        for p in patterns:
            if re.search(p, text, re.IGNORECASE):
                hits += 1
                need = X.needed(p)
                assert need is None or any(w in text for w in need), (p, text)
    assert hits > 500


def test_hits_beyond_ascii(spark):
    """Cases that a plain search would miss: a long s and a Kelvin sign match s and k."""
    texts = ["covenant breach", "COVENANT BREACH", "buſineſſ reſcue proceedings", "creditor banKKruptcy", "banKruptcy petition", "café going concern", "é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.rule_hits("t").alias("h")).collect()
    plain = {}
    for kind in dict.fromkeys(r[0] for r in V.RULES):
        for _, score, ps in sorted((r for r in V.RULES if r[0] == kind), key=lambda r: -r[1]):
            flag = F.lit(False)
            for p in ps:
                flag = flag | F.lower("t").rlike("(?iUd)" + p)
            for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").filter(flag).collect():
                plain.setdefault((r["i"], kind), score)
    assert {(r["i"], h["signal_type"]): h["base_score"] for r in rows for h in r["h"]} == plain
