"""From landed files and pages to filings and news: scans, extraction, resolution, de-duplication, ranking and merging of sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import values as V
from tidemark.sources.store import cut


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their rank. Spark limits each task's groups before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def since(day: Column, as_of: dt.datetime, days: int) -> Column:
    return day >= F.date_sub(F.lit(as_of).cast("date"), days)


def scan_submissions(submissions: DataFrame, forms: Sequence[str], *, as_of: dt.datetime, lookback: int, most: int = 20) -> DataFrame:
    """Filings out of one row per company with parallel arrays: listed forms since the cut-off, the first ``most`` in source order."""
    rows = submissions.select("company_id", F.posexplode(F.arrays_zip("accession_number", "form_type", "filing_date")).alias("pos", "f")).select("company_id", "pos", "f.*")
    rows = rows.filter(F.col("form_type").isin(*forms) & since(F.col("filing_date"), as_of, lookback))
    return first_rows(rows, ["company_id"], ["pos"], most)


def phrase_search(filings: DataFrame, phrases: Sequence[str], forms: Sequence[str], start: dt.date, end: dt.date, most: int = 3) -> DataFrame:
    """The first ``most`` filings of each company that hold a phrase, newest first."""
    low = F.lower(F.coalesce("description", F.lit("")))
    found = F.filter(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
    rows = filings.filter(F.col("form_type").isin(*forms) & F.col("filing_date").between(start, end)).withColumn("phrase", F.explode(found))
    return first_rows(rows, ["company_id", "phrase"], [F.desc("filing_date"), "accession_number"], most)


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """key and phrase for the texts that contain a phrase, case aside; for more phrases than an expression can hold (a table with a column ``phrase``).

    Texts and phrases fall into words at single spaces. A text that contains a phrase has the phrase's inner words whole, its first word as the end of a word and its
    last one as the beginning of one; the word of a one-word phrase lies anywhere in a word. So each phrase is looked up by the one of its words that the fewest texts
    have: the dictionary of the texts says which words can be that one, an equi-join on words gives the candidates, and ``contains`` decides. Blank phrases are left out.
    """
    low = docs.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    each = F.explode(F.array_distinct(F.split("_low", " "))).alias("word")
    own = phrases.filter(F.trim("phrase") != "").select("phrase", F.lower("phrase").alias("_p")).distinct()
    words = cut(low.select(each).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    parts = own.select("_p", F.posexplode(F.split("_p", " ")).alias("at", "part"), F.size(F.split("_p", " ")).alias("of")).filter("part <> ''").distinct()
    place = F.when(F.col("of") == 1, "any").when(F.col("at") == 0, "end").when(F.col("at") == F.col("of") - 1, "start").otherwise("whole")
    parts = cut(parts.select("_p", "at", "part", place.alias("place")))
    # lengths of the phrases' words, so that only these pieces of the dictionary's words are made; no more than the longest phrase has letters
    sizes = {r["place"]: r["k"] for r in parts.groupBy("place").agg(F.collect_set(F.length("part")).alias("k")).collect()}
    pieces = {
        "whole": lambda k: F.array("word"), "end": lambda k: F.array(F.right("word", k)), "start": lambda k: F.array(F.left("word", k)),
        "any": lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda a: F.substring("word", a, k)),
    }
    looks = None
    for name, lengths in sizes.items():
        fit = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("word"))
        made = F.array("word") if name == "whole" else F.flatten(F.transform(fit, pieces[name]))
        found = words.select("word", "n", F.explode(F.array_distinct(made)).alias("part")).join(parts.filter(F.col("place") == name), "part").select("_p", "at", "word", "n")
        looks = found if looks is None else looks.unionByName(found)
    if looks is None:
        return low.select(key, F.col("_low").alias("phrase")).limit(0)
    looks = cut(looks)
    rarest = looks.groupBy("_p", "at").agg(F.sum("n").alias("n")).groupBy("_p").agg(F.min_by("at", F.struct("n", "at")).alias("at"))
    index = looks.join(rarest, ["_p", "at"]).select("word", "_p").distinct()
    found = low.select(key, "_low", each).join(index, "word").filter(F.contains("_low", "_p")).select(key, "_p").distinct()
    return found.join(own, "_p").select(key, "phrase")


def phrase_filings(filings: DataFrame, phrases: DataFrame, forms: Sequence[str], start: dt.date, end: dt.date, most: int = 3) -> DataFrame:
    """``phrase_search`` for a table of phrases."""
    rows = filings.filter(F.col("form_type").isin(*forms) & F.col("filing_date").between(start, end))
    found = phrase_hits(rows, phrases, "doc_no", "description")
    return first_rows(rows.join(found, "doc_no"), ["company_id", "phrase"], [F.desc("filing_date"), "accession_number"], most)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items of landed feed files, those that can be read."""
    return landed_feed(spark, path)[0]


def landed_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RSS items of landed feed files, and the errors (error, detail): items that are no XML, and what is left of an item at a file's end.

    A feed file is read as a whole; its items are parsed one by one, so a spoiled one leaves the others.
    """
    schema = "title string, link string, pubDate string, description string, _corrupt string"
    files = spark.read.text(path, wholetext=True)
    item = F.lit(r"(?s)<item(?:\s[^>]*)?>.*?</item>")
    whole = files.select(F.explode(F.regexp_extract_all("value", item, F.lit(0))).alias("text")).select("text", F.from_xml("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rest = files.select(F.regexp_extract(F.regexp_replace("value", item, F.lit("")), r"(?s)<item(?:\s[^>]*)?>.*", 0).alias("detail")).filter("detail <> ''")
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    errors = whole.filter(bad).select(F.col("text").alias("detail")).unionByName(rest).select(F.lit("corrupt row").alias("error"), "detail")
    return feed_items(whole.filter(~bad).select("r.*").drop("_corrupt")), errors


def feed_items(rows: DataFrame) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]+>", " "))
    return rows.filter(F.trim(F.coalesce("title", F.lit(""))) != "").select(F.trim("title").alias("title"), F.trim("link").alias("link"), "pubDate", plain.alias("snippet"))


def feed_date(text: Column, as_of: dt.datetime) -> Column:
    """Date of a feed's date text: weekday and zone optional, ISO forms too; else the day of ``as_of``."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3},\\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in ("dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")]
    return F.to_date(F.coalesce(*tries, F.lit(as_of)))


def exchange_filings(items: DataFrame, feeds: Mapping[str, tuple[str, str, str, int]] = V.EXCHANGE_FEEDS, spare: Mapping[str, str] = V.EXCHANGE_FALLBACK) -> DataFrame:
    """Announcements (company_id, feed, pos in the feed, title, text, link, day) as filings: the first ones of each feed, those without a title aside.

    A feed gives venue code, form, the prefix of the synthetic number (with the title's MD5) and how many items of a company count. A feed of ``spare`` counts
    for companies of which the other one gives no filing.
    """
    of = lambda i: X.lookup(F.col("feed"), {k: v[i] for k, v in feeds.items()}, None)
    rows = first_rows(items.filter(F.col("feed").isin(*feeds)), ["company_id", "feed"], ["pos"], max(v[3] for v in feeds.values()), "_rank")
    rows = rows.filter((F.col("_rank") <= of(3)) & (F.coalesce("title", F.lit("")) != ""))
    rows = rows.select(
        "company_id", "feed", F.concat(of(2), F.lit("-"), F.left(F.md5("title"), F.lit(12))).alias("accession_number"), of(1).alias("form_type"), of(0).alias("cik"), F.col("day").alias("filing_date"),
        F.col("link").alias("document_url"), F.col("title").alias("description"), F.left(F.coalesce("text", F.lit("")), F.lit(300)).alias("raw_excerpt"),
    )
    # one window over the filings of a company tells which of its feeds have any
    held = F.collect_set("feed").over(Window.partitionBy("company_id"))
    first = X.lookup(F.col("feed"), dict(spare), None)
    return rows.withColumn("_held", held).filter(first.isNull() | ~F.array_contains("_held", F.coalesce(first, F.lit("")))).drop("_held")


def fallback(primary: DataFrame, secondary: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows of the primary source, and of the secondary for companies that the primary has none of."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def link_extract(pages: DataFrame, *, min_len: int = 15, max_len: int = 300, most: int = 8, keywords: Sequence[str] | None = None, company: str | None = None) -> DataFrame:
    """Links of listing pages: text of the anchor without tags, length and letter tests, absolute address, the first ``most`` per page. With
    ``keywords``, the text must hold one of them, or the name in the pages' column ``company`` if that is given, or a part of it of over 3 characters."""
    anchor = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("inner"))
    name = F.lit(None).cast("string") if company is None else F.lower(F.trim(company))
    rows = pages.select("page_id", "url", name.alias("_company"), F.posexplode(links).alias("pos", "l"))
    title = F.trim(F.regexp_replace("l.inner", "<[^>]+>", " "))
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = F.trim("l.href")
    rows = rows.select("page_id", "_company", "pos", title.alias("title"), F.when(href.startswith("/"), F.concat(base, href)).when(href.startswith("http"), href).alias("link"))
    rows = rows.filter(F.length("title").between(min_len, max_len) & F.col("title").rlike(r"\p{L}") & F.col("link").isNotNull())
    if keywords is not None:
        part = F.exists(F.split("_company", r"\s+"), lambda p: (F.length(p) > 3) & F.lower("title").contains(p))
        hit = F.coalesce((F.col("_company") != "") & (F.lower("title").contains(F.col("_company")) | part), F.lit(False))
        for k in keywords:
            hit = hit | F.lower("title").contains(k)
        rows = rows.filter(hit)
    return first_rows(rows.drop("_company"), ["page_id"], ["pos"], most)


def html_text(html: Column, most: int = 4000) -> Column:
    """Text of a page: tags out, white space collapsed, the first ``most`` characters as users of this excerpt expect."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), F.lit(most))


def resolve_companies(requests: DataFrame, company: DataFrame) -> DataFrame:
    """request_no and the company found by ticker, else by name; id padded to 10 digits. Of companies that share a ticker the least id counts."""
    by_ticker = company.filter("ticker is not null").groupBy(F.upper(F.trim("ticker")).alias("_t")).agg(F.min("company_id").alias("_by_ticker"))
    by_name = company.groupBy(F.lower(F.trim("company_name")).alias("_n")).agg(F.min("company_id").alias("_by_name"))
    rows = requests.join(by_ticker, F.upper(F.trim("ticker")) == F.col("_t"), "left").join(by_name, F.lower(F.trim("name")) == F.col("_n"), "left")
    found = F.coalesce("_by_ticker", "_by_name")
    return rows.select("request_no", found.alias("company_id"), F.lpad(found.cast("string"), 10, "0").alias("padded"), F.when(F.col("_by_ticker").isNotNull(), "ticker").when(F.col("_by_name").isNotNull(), "name").otherwise("none").alias("found_by"))


def document_url(cik: Column, accession: Column) -> Column:
    bare = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), bare, F.lit("/"), accession, F.lit("-index.htm"))


def is_regional(title: Column, snippet: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, snippet))
    out = F.lit(False)
    for word in (*V.REGION_COUNTRIES, *V.REGION_WORDS):
        out = out | text.contains(word.lower())
    return out


def news_relevance(news: DataFrame, company: DataFrame, keywords=V.NEWS_KEYWORDS, least: float = 0.1) -> DataFrame:
    """News with the relevance to its own company, without what is below ``least``."""
    return _relevance(news, company, keywords).filter(F.col("relevance") >= least)


def regional_relevance(news: DataFrame, company: DataFrame) -> DataFrame:
    """News of regional sources: any mention counts, so the limit is lower."""
    return news_relevance(news, company, V.REGIONAL_KEYWORDS, V.REGIONAL_LEAST)


def institutional_relevance(news: DataFrame, company: DataFrame) -> DataFrame:
    """Items of institutional sources: all are kept, and those of hardly any relevance are lifted to a floor."""
    weak = F.col("relevance") < V.INSTITUTIONAL_WEAK
    return _relevance(news, company, V.REGIONAL_KEYWORDS).withColumn("relevance", F.when(weak, V.INSTITUTIONAL_FLOOR).otherwise(F.col("relevance")))


def _relevance(news: DataFrame, company: DataFrame, keywords) -> DataFrame:
    rows = news.join(company.select("company_id", "company_name"), "company_id")
    return rows.withColumn("relevance", F.round(X.relevance(F.col("title"), F.col("snippet"), F.col("company_name"), keywords), 2))


def dedup_first(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    return first_rows(rows, keys, order, 1, "_first").drop("_first")


def merge_filings(sources: Sequence[DataFrame], keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """Filings of several sources in their order: the first of each accession number, or address where there is none."""
    rows = sources[0].withColumn("priority", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("priority", F.lit(i)))
    own = F.coalesce(F.when(F.col("accession_number") != "", F.col("accession_number")), F.col("document_url"), F.lit(""))
    return dedup_first(rows.withColumn("_key", own), [*keys, "_key"], ["priority", "filing_date", "doc_no"]).drop("_key")


def merge_news(sources: Sequence[DataFrame]) -> DataFrame:
    """Items of several sources by priority: one per company and title, from the earliest source."""
    rows = sources[0].withColumn("priority", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("priority", F.lit(i)))
    return dedup_first(rows.filter(F.trim("title") != ""), ["company_id", "title"], ["priority", "published_date", "doc_no"])


def explain_guard(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Explanations out of reply texts (a JSON array or object, maybe fenced) that name a candidate of their company; others are dropped.

    A reply without a headline gets the type's own; evidence is a list, empty where there is none, and reasoning a text.
    """
    bare = F.trim(F.regexp_replace("reply", "```json|```", ""))
    array = F.when(bare.startswith("["), bare).when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(F.regexp_extract(bare, r"(?s)\[.*\]", 0))
    rows = replies.select("reply_no", "company_id", F.inline(F.from_json(array, "array<struct<signal_type:string,headline:string,evidence:array<string>,reasoning:string>>")))
    rows = rows.withColumn("signal_type", F.replace(F.replace(F.lower("signal_type"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
    held = candidates.select("company_id", "signal_type", "severity", "confidence")
    own = F.coalesce("headline", F.concat(X.title_case(F.col("signal_type")), F.lit(" detected")))
    return rows.join(held, ["company_id", "signal_type"]).select(
        "reply_no", "company_id", "signal_type", own.alias("headline"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), "severity", "confidence")


def evidence(filing_clauses: DataFrame, news_clauses: DataFrame) -> DataFrame:
    """The first clauses of a company: some of each of its first filings, then one of each of its first news items.

    Inputs: company_id, nth (place of the document for the company), rank (place of the clause in it) and any columns that both have.
    """
    most = V.EVIDENCE
    some = lambda rows, origin, no, docs, each: rows.filter((F.col("nth") <= docs) & (F.col("rank") <= each)).withColumns({"origin": F.lit(origin), "_no": F.lit(no)})
    rows = some(filing_clauses, "filing", 0, most["filings"], most["of_filing"]).unionByName(some(news_clauses, "news", 1, most["news"], most["of_news"]))
    return first_rows(rows, ["company_id"], ["_no", "nth", "rank"], most["most"], "place").drop("_no")


def clauses(docs: DataFrame, text: str, key: str, max_per_type: int = 2, location: str = "filing") -> DataFrame:
    """Clauses of each document: distinct clause texts, at most ``max_per_type`` per kind, ranked by confidence, then kind, pattern and place; ``location``
    names where the texts are from."""
    column = F.col(text)
    rows = docs.filter(F.length(column) >= V.CLAUSE_LEAST_TEXT).select(key, F.inline(X.clauses(column)))
    rows = dedup_first(rows, [key, "clause"], ["kind_no", "pattern_no", "start"])
    rows = first_rows(rows, [key, "kind"], ["pattern_no", "start"], max_per_type, "in_kind")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "kind_no", "pattern_no", "start")))
    first = lambda p: F.trim(F.regexp_extract("context", p, 0))
    return rows.select(
        key, "kind", "confidence", "rank", "start", F.left("clause", F.lit(V.CLAUSE_CHARS)).alias("clause"), F.left("context", F.lit(V.CLAUSE_CONTEXT_CHARS)).alias("context"),
        first("(?i)" + V.CLAUSE_AMOUNT).alias("amount"), first("(?i)" + V.CLAUSE_TIME).alias("time"), first(V.CLAUSE_COMPANY).alias("subject"), F.lit(location).alias("location"),
    )


def clause_strings(rows: DataFrame) -> Column:
    more = F.concat(F.when(F.col("amount") != "", F.concat(F.lit(" ("), "amount", F.lit(")"))).otherwise(F.lit("")), F.when(F.col("time") != "", F.concat(F.lit(" — "), "time")).otherwise(F.lit("")))
    return F.concat(F.lit("["), X.title_case(F.col("kind")), F.lit("] "), "clause", more)
