"""Personal data: fixed base patterns plus bootstrapped contextual extraction.

Base kinds are found by patterns, leftmost and non-overlapping, with offsets in code points. The patterns below are the plain ones made
linear: a look-behind (or the end of the last match) keeps a search from starting inside a run that has already failed, and possessive
repeats keep the engine from backtracking or recursing on long runs. They match exactly what the plain ones match.

The method: tokens that look like identifiers (a digit, ``@`` or ``key=value``, and at least ``LEAST_VALUE`` characters) are instances; the words
before them, from the last word with a letter on, or the key in the token, are lexical patterns. Seeds are the base entities and tokens of two
secret-like shapes. On the graph of patterns and instances, a pattern's confidence is the share of its uses in the corpus - every use of its cue
word, with an identifier or without - whose instance is believed; an instance that some pattern of at least ``MIN_CONFIDENCE`` and ``MIN_SUPPORT``
seeds holds is believed in the next round. After ``ROUNDS`` rounds the accepted patterns add their instances as spans of the kind most of their
believed instances have. A seed's shape alone adds no span.

Scale: texts are scanned twice and never shuffled. Words are counted with map-side aggregation; the graph holds distinct pairs. Base spans
and instances are cut by a checkpoint, so each round works on small rows. The steps of one text grow in proportion to it: offsets and the merge of
tokens and base spans are running results (``scan``).

Defined results: null texts are empty; rows that share doc_id and text get equal results; a null doc_id is kept; an empty table gives no rows;
extra columns are left out by the reports and kept, whatever their names, by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_names, let, scan, text_of, words

#: Base kinds in the order of their spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a text must hold for a pattern to be worth a search.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Tokens that may be identifiers.
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@=]|(?<![A-Za-z_])=)*+[0-9@=][^\x20\x09-\x0D]*+"
KEYED = r"^([A-Za-z_][A-Za-z_.-]*[=:][\"']?)"
#: Shapes whose tokens are seeds of the kind ``secret``.
SECRET = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,})$"
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 3, 0.8
#: Characters of the shortest instance that is no base entity: shorter ones are mere numbers.
LEAST_VALUE = 4
#: Characters of a page of a text that is masked.
PAGE = 4_096


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value,before>> of the matches; ``before`` is the text since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(m: Column, p: Column) -> Column:
        ends = scan(F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x)), F.lit(0), lambda a, n: a + n)
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("value"), F.get(p, i).alias("before"))))

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")).otherwise(let(between, lambda p: placed(m, p))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.get(F.split(digits, ""), F.length(digits) - 1 - i).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # the value of a part without its leading zeros is at most three digits long
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind, array<struct<kind,start,end>> in order of start."""
    def of(kind: str, pattern: str) -> Column:
        ok = F.filter(spans(text, pattern), lambda s: _valid(kind, s["value"]))
        plain = F.transform(ok, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(text.rlike(HINT[kind]), plain.cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    return {kind: of(kind, pattern) for kind, pattern in KINDS.items()}


def _held_by(tokens: Column, base: Column) -> Column:
    """For each token the base span (start, end, kind) that reaches furthest among those that begin before its end; null if there is none.

    Tokens, at their last character, and base spans, at their first, are sorted together; the span is a running maximum.
    """
    reach = "struct<end:int,start:int,kind:string>"
    at_token = F.transform(tokens, lambda t, i: F.struct((t["end"] - 1).alias("at"), F.lit(1).alias("is_token"), F.lit(None).cast(reach).alias("span")))
    at_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("is_token"), F.struct(b["end"].alias("end"), b["start"].alias("start"), b["kind"].alias("kind")).cast(reach).alias("span")))
    events = F.array_sort(F.concat(at_token, at_base))
    best = lambda e: scan(F.transform(e, lambda x: x["span"]), F.lit(None).cast(reach), lambda a, x: F.greatest(a, x))
    # tokens do not overlap, so they come in their own order
    return let(events, lambda e: let(best(e), lambda s: F.transform(F.filter(F.transform(e, lambda x, i: F.struct(x["is_token"].alias("is_token"), F.get(s, i).alias("span"))), lambda x: x["is_token"] == 1), lambda x: x["span"])))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start,end,context,cue,value,kind>>: instances with their lexical pattern; kind is null if no base span or shape names it."""
    def one(s: Column, held: Column) -> Column:
        key = F.regexp_extract(s["value"], KEYED, 1)
        rest = F.substring(s["value"], F.length(key) + 1, F.length(s["value"]))
        tail = F.length(F.regexp_extract(rest, "([\"'.,;:!?)\\]}>]*+)$", 1))
        head = F.length(F.regexp_extract(rest, "^([\"'(\\[{<]*)", 1))
        start = s["start"] + F.length(key) + head
        end = F.greatest(start, s["end"] - tail)
        value = F.substring(rest, head + 1, end - start)
        # the last word with a letter, and what follows it up to the token
        gap = words(F.lower(s["before"]))
        lead = let(gap, lambda g: let(F.array_max(F.transform(g, lambda w, i: F.when(w.rlike(r"\p{L}"), i))), lambda last: F.when(last.isNotNull(), F.slice(g, last + 1, F.size(g)))))
        opened = F.regexp_extract(s["value"], "^([\"'(\\[{<]*)", 1)
        inside = F.coalesce(held["end"] > s["start"], F.lit(False))
        kind = F.when(inside, held["kind"]).when(value.rlike(SECRET), F.lit("secret"))
        first = ~inside | (held["start"] >= s["start"])  # later tokens of a base span have no pattern of their own

        def named(w: Column) -> Column:
            context = F.when(key != "", F.lower(key)).when(w.isNotNull(), F.concat(F.array_join(w, " "), F.lit(" "), opened)).otherwise(F.lit(""))
            cue = F.when(key == "", F.get(w, 0))
            return F.struct(start.alias("start"), end.alias("end"), context.alias("context"), cue.alias("cue"), value.alias("value"), kind.alias("kind"), inside.alias("is_base"), first.alias("first"))

        return let(lead, named)

    all_ = let(spans(text, TOKEN), lambda t: let(_held_by(t, base), lambda h: F.transform(t, lambda s, i: one(s, F.get(h, i)))))
    return F.filter(all_, lambda c: c["first"] & (c["is_base"] | (c["end"] - c["start"] >= LEAST_VALUE)) & (c["context"] != ""))


def found_rows(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), base (struct of arrays) and candidates of every document; no texts."""
    text = text_of()
    rows = docs.select("doc_id", text.alias("_t"))
    rows = rows.select("doc_id", "_t", F.struct(*[c.alias(k) for k, c in base_spans(F.col("_t")).items()]).alias("base"))
    every = F.concat(*[F.col(f"base.{k}") for k in KINDS])
    found = F.when(F.col("_t").rlike("[0-9@=]"), let(every, lambda b: candidates(F.col("_t"), b)))
    return rows.select("doc_id", F.xxhash64("_t", F.lit("content")).alias("content"), "base", found.alias("found"))


def cue_counts(docs: DataFrame) -> DataFrame:
    """How often each word (lower case) occurs in the corpus."""
    rows = docs.select(F.explode(words(F.lower("text"))).alias("cue"))
    return rows.groupBy("cue").agg(F.count("*").alias("uses"))


def accepted_patterns(instances: DataFrame, uses: DataFrame) -> DataFrame:
    """context, kind and confidence of the patterns accepted after ROUNDS rounds on the pattern-instance graph."""
    pairs = instances.groupBy("context", "cue", "value").agg(F.count("*").alias("n"), F.max("kind").alias("seed"))
    seeds = pairs.filter("seed is not null").groupBy("value").agg(F.max("seed").alias("believed"))
    # a pattern with too few seeds can only be reached through instances that it shares with others, so all stay in the graph
    per_context = pairs.groupBy("context").agg(F.sum("n").alias("seen"), F.max("cue").alias("cue"))
    total = per_context.join(uses, "cue", "left").select("context", F.coalesce("uses", "seen").alias("total"), "seen")
    graph = cut(pairs.join(total, "context").select("context", "value", "n", F.greatest("total", "seen").alias("total")))
    believed = cut(seeds)
    chosen = None
    for _ in range(ROUNDS):
        held = graph.join(believed, "value")
        by_kind = held.groupBy("context", "believed").agg(F.sum("n").alias("n"), F.count("*").alias("support"), F.max("total").alias("total"))
        scored = by_kind.groupBy("context").agg(F.sum("n").alias("good"), F.sum("support").alias("support"), F.max("total").alias("total"), F.max_by("believed", F.struct("n", "believed")).alias("kind"))
        chosen = cut(scored.withColumn("confidence", F.col("good") / F.col("total")).filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("context", "kind", "confidence"))
        fresh = graph.join(chosen, "context").groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("believed"))
        believed = cut(believed.unionByName(fresh.join(believed.select("value"), "value", "left_anti")))
    return chosen


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, content, base (struct of arrays of spans) and added (array of spans by kind and start) of every document."""
    rows = cut(found_rows(docs))
    instances = rows.select("doc_id", "content", F.inline("found"))
    patterns = accepted_patterns(instances, cue_counts(docs))
    held = instances.filter(~F.col("is_base")).drop("kind").join(patterns, "context").select("doc_id", "content", "kind", "start", "end")
    added = held.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))  # one document's spans
    added = added.select(F.col("doc_id").alias("_id"), F.col("content").alias("_c"), "added")
    joined = rows.select("doc_id", "content", "base").join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_c")), "left")
    return joined.select("doc_id", "content", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    base = F.concat(*[F.col(f"base.{k}") for k in KINDS])
    kinds = [*KINDS, "secret"]

    def of(kind: str) -> Column:
        more = F.filter("added", lambda s: s["kind"] == kind)
        return F.concat(F.col(f"base.{kind}"), more) if kind in KINDS else more

    order = F.concat(*[F.array_sort(of(k)) for k in kinds])
    return extract(docs).select(
        "doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(order).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """The documents with all columns, each span of their texts (joined where they overlap) replaced by its kind in brackets. Helper columns have
    names that ``docs`` lacks."""
    found = extract(docs.select("doc_id", "text"))
    every = F.concat(*[F.col(f"base.{k}") for k in KINDS], F.col("added"))
    by_start = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    id_, content, own, hits = fresh_names(docs, "id", "content", "own", "hits")
    hit = found.select(F.col("doc_id").alias(id_), F.col("content").alias(content), by_start.alias(hits)).filter(F.size(hits) > 0).dropDuplicates([id_, content])
    both = docs.withColumn(own, F.xxhash64(text_of(), F.lit("content"))).join(hit, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(content)), "left")

    def pieces(text: Column) -> Column:
        # how far the spans before reach: a span that begins further starts a new mask
        reach = scan(F.transform(hits, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        starts = let(reach, lambda r: F.filter(F.transform(hits, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["start"] >= F.get(r, s["i"] - 1))))

        def cells(s: Column, r: Column) -> Column:
            last = lambda k: F.get(r, F.coalesce(F.get(s, k + 1)["i"], F.size(r)) - 1)  # noqa: E731  where mask k ends
            masks = F.transform(s, lambda x, k: F.struct(x["start"].alias("start"), last(k).alias("end"), x["kind"].alias("kind")))
            return let(masks, lambda m: F.transform(m, lambda x, k: F.struct(F.coalesce(F.get(m, k - 1)["end"], F.lit(0)).alias("from"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))

        return let(reach, lambda r: let(starts, lambda s: cells(s, r)))

    def written(text: Column) -> Column:
        # long texts are cut into pages first, so that a cell is found from its page's start, not from the text's
        pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

        def part(p: Column, a: Column, b: Column) -> Column:
            page = lambda x: F.floor(x / PAGE).cast("int")
            return let(F.array_join(F.slice(p, page(a) + 1, page(b) - page(a) + 1), ""), lambda t: F.substring(t, a - page(a) * PAGE + 1, b - a))

        return let(pages, lambda p: let(pieces(text), lambda c: F.concat(
            F.array_join(F.transform(c, lambda x: F.concat(part(p, x["from"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""),
            part(p, F.element_at(c, -1)["end"], F.length(text)))))

    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(written(F.col("text")))
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


__all__ = ["KINDS", "accepted_patterns", "base_spans", "extract", "mask", "report"]
