"""URL allow and block lists as a sort-merge range join over reversed hosts.

The key of a host is its labels in reverse, each followed by a dot (``www.example.com`` is
``com.example.www.``), so a rule on a host covers the interval of keys from ``com.example.`` to just below
``com.example/``. Intervals of rules nest or are disjoint. Starts and ends of all intervals and the distinct hosts are
sorted together and swept in order: a start pushes its rules on the stack, an end pops them, and a host takes the stack as it
is. The stack is kept level by level: the running sum of pushes and pops is its depth, and the rules at level d are those of the last
start that made the depth d. The stack's rules whose path the url's path starts with fit; the longest one (host and path
together, then host) wins.

Scale: hosts are reduced to distinct ones before the sweep, so a hot host is one row. The sweep is dealt by
the last two labels and a salt; a rule with two or more labels goes to its own domain's salts, a rule on one label to each group of that
label (one more event in each). Stacks come back to the pages by ``join_hot`` on the host.

Defined results: a null url, or one without ``://``, has empty host and path and the default verdict; repeated
pages give repeated rows; an empty table or rule list works; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts that a domain's distinct hosts are dealt over; each of its rules is repeated as often.
SALTS = 32
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_STACK = "array<struct<host:string,path:string,verdict:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as rows."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _domain(key: Column) -> Column:
    """The first two labels of a key; a key of one label is its own domain."""
    return F.substring_index(key, ".", 2)


def stacks(hosts: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """The active rules (outermost first) of each distinct ``host``."""
    nodes = rules.dropDuplicates(["host", "path"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("host", "path", "verdict"))).alias("own"))
    nodes = nodes.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), "own")
    levels = nodes.agg(F.max("labels")).first()[0] or 0  # intervals nest at most as deep as the longest rule's labels

    key = host_key(F.col("host"))
    points = hosts.select(
        _domain(key).alias("domain"), F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int").alias("salt"), key.alias("at"),
        F.lit(0).alias("step"), F.lit(None).cast(_STACK).alias("own"), "host",
    )
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    deep = nodes.filter("labels > 1").select(_domain(F.col("key")).alias("domain"), every_salt.alias("salt"), "key", "own")
    groups = points.select("domain", "salt", F.concat(F.substring_index("domain", ".", 1), F.lit(".")).alias("key")).distinct()
    top = groups.join(nodes.filter("labels = 1").select("key", "own"), "key").select("domain", "salt", "key", "own")
    push = F.struct(F.col("key").alias("at"), F.lit(1).alias("step"), F.col("own").alias("own"))
    pop = F.struct(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(_STACK).alias("own"))
    events = deep.unionByName(top).select("domain", "salt", F.inline(F.array(push, pop))).withColumn("host", F.lit(None).cast("string"))

    # a key's own interval starts before the host of that key; ends lie between keys
    sweep = Window.partitionBy("domain", "salt").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(events).withColumn("depth", F.sum("step").over(sweep))
    level = lambda d: F.when(F.col("depth") >= d, F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("own")), ignorenulls=True).over(sweep))
    swept = swept.withColumns({f"level_{d}": level(d) for d in range(1, levels + 1)}).filter("step = 0")
    stack = F.flatten(F.filter(F.array(F.array().cast(_STACK), *[F.col(f"level_{d}") for d in range(1, levels + 1)]), lambda x: x.isNotNull()))
    return swept.select("host", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page's ``url``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
    found = stacks(hosts.select("host"), rules, salts).join(hosts.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).drop("_host")
    joined = join_hot(rows, found, "host", pages.count(), F.struct("page_id", "path"))
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("long"), F.length(r["host"]).alias("host_long"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    return joined.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
