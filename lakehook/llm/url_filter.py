"""URL filtering by association rules (native: DataFrame and Spark ML operations only).

A url is split into host and path as the fixed rules need them; the longest fixed
rule that fits decides. All other urls are judged by rules mined from labels: a
labelled page's tokens (host labels with their level, host suffixes, path words, query keys,
extension, scheme) and, for pages whose document is labelled bad, the item
``BAD`` are one transaction; FP-growth finds the token combinations that occur
with BAD. A rule is kept with at least ``CONFIDENCE`` and a support of
``SUPPORT`` of the transactions, when no kept rule over a part of its tokens is
as confident; neither rules nor their tokens are limited in number. Rules match
by an inverted index: a url's tokens are joined with the rules' rarest tokens,
and a rule whose tokens are all found blocks the url.

Numbers (runs of digits) are one token, so vocabularies and urls' token sets are
small; FP-growth's tables are Spark's own shuffled groups. Tokens that stand in
too few bad pages are left out of them, and tokens of the very same pages are one
item there: a set with two of them is never a kept rule, since a part of it is as
confident. The kept rules get each of an item's tokens in turn.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and is judged on no tokens, so it is allowed. Repeated rows repeat.
Labels that are null or of unknown pages are ignored; without any, nothing is
mined. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import materialise, table

# Fixed values of the contract: (host, path start, verdict).
FIXED_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
BAD = "label:bad"
SUPPORT = 0.002
# A rule also rests on so many bad pages at least: one page proves nothing.
MIN_PAGES = 2
CONFIDENCE = 0.7
# Matched token sets up to so many bytes are broadcast to the pages.
BROADCAST_BYTES = 16 << 20
# Longer path words, query keys and schemes stand as their hash.
LONG_WORD = 64
# Upper-case ASCII alone is lowered.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows the path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
    return host, path, tail


def fixed(host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, or null."""
    ordered = sorted(FIXED_RULES, key=lambda r: -len(r[0] + r[1]))
    out = None
    for name, start, verdict in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def whole(word: Column) -> Column:
    """The word, or the hash of all of a long one; neither words nor keys have a ``#`` of their own."""
    return F.when(F.length(word) <= LONG_WORD, word).otherwise(F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256)))


def tokens(url: Column, host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    levels = F.transform(labels, lambda x, i: F.concat(F.lit("host"), (n - i).cast("string"), F.lit(":"), x))
    suffix = F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))
    hyphens = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("name:"), x))
    words = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"[/.\-_]"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("path:"), whole(x)))
    keys = F.transform(F.expr("regexp_extract_all(t, '[?&]([^=&#]+)', 1)"),
                       lambda x: F.concat(F.lit("key:"), whole(x)))
    scheme = F.array(F.concat(F.lit("scheme:"), whole(F.lower(F.substring_index(url, ":", 1)))))
    every = F.array_distinct(F.concat(levels, F.array(suffix), hyphens, words, keys, scheme))
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<string>"))


def describe(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, number (the first run of digits that is a whole path part or name), tokens."""
    raw = F.col(url).cast("string")
    host, path, tail = parts(raw)
    return (pages.select(F.col(key), raw.alias("u"), host.alias("host"), path.alias("path"), tail.alias("t"))
            .withColumn("number", F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) AS BIGINT)"))
            .withColumn("tokens", tokens(F.col("u"), F.col("host"), F.col("path"), F.col("t")))
            .select(key, "host", "path", "number", "tokens"))


def mine(described: DataFrame, labels: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(tokens, confidence, support, lead, rule id): pruned rules for BAD; lead is the rarest token.

    A page is labelled by the document whose number its url ends in. A rule's tokens
    stand together in at least ``SUPPORT`` of the labelled pages and in ``min_pages`` bad ones.
    """
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = described.where(F.size("tokens") > 0).join(marks, F.col("number") == F.col("doc_id"))
    known = materialise(known.select("tokens", "bad", F.monotonically_increasing_id().alias("row")), "url-known")
    held = known.select("row", "bad", F.explode("tokens").alias("token"))
    labelled = known.count()
    least = max(SUPPORT * labelled, min_pages)
    # tokens of the same pages, by count and 128 bits of their numbers, are one item: its least token
    alike = [F.bit_xor(F.xxhash64("row", F.lit(salt))).alias(f"mark{salt}") for salt in (1, 2)]
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("both"), *alike)
    kinds = materialise(counts.where(F.col("both") >= least).groupBy("n", "mark1", "mark2").agg(
        F.min("token").alias("item"), F.collect_list("token").alias("members")).select("item", "n", "members"), "url-kinds")
    items = (held.join(kinds.select(F.col("item").alias("token")), "token", "left_semi")
             .groupBy("row").agg(F.collect_list("token").alias("items")))
    every = F.coalesce("items", F.array().cast("array<string>"))
    baskets = materialise(known.select("row", "bad").join(items, "row", "left").select(
        F.when(F.col("bad") == 1, F.concat(every, F.array(F.lit(BAD)))).otherwise(every).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(SUPPORT, (min_pages - 0.5) / max(labelled, 1))), minConfidence=CONFIDENCE).fit(baskets)
    sets = materialise(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.col("freq") >= min_pages)).select(
        F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("both"))
    whole = sets.select(F.col("items").alias("tokens"), "freq")
    sure = materialise(bad.join(whole, "tokens").select(
        "tokens", F.col("both").alias("support"), (F.col("both") / F.col("freq")).alias("confidence")), "url-rules")
    rules = materialise(minimal(sure), "url-minimal")
    # every choice of one token of each item, the rarest item's first
    choices = (rules.select("tokens", F.explode("tokens").alias("item")).join(kinds, "item").groupBy("tokens")
               .agg(F.array_sort(F.collect_list(F.struct("n", "members"))).alias("choices")))
    spread = F.aggregate(
        F.col("choices.members"), F.array(F.array()).cast("array<array<string>>"),
        lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda x: F.concat(d, F.array(x))))))
    return (rules.join(choices, "tokens").select(F.explode(spread).alias("chosen"), "confidence", "support")
            .select(F.array_sort("chosen").alias("tokens"), "confidence", "support", F.col("chosen")[0].alias("lead"))
            .withColumn("rule_id", F.xxhash64("tokens")))


def minimal(sure: DataFrame) -> DataFrame:
    """The rules of (tokens, support, confidence) of at least CONFIDENCE that no part of their tokens is as sure as.

    By size: what is known of a set is the greatest confidence of its parts, which
    the sets of one token less carry, so a set meets just those and no list of rules.
    """
    longest = sure.where(F.col("confidence") >= CONFIDENCE).agg(F.max(F.size("tokens"))).first()[0] or 0
    kept, last = sure.limit(0), None
    for n in range(1, longest + 1):
        level = sure.where(F.size("tokens") == n)
        if last is None:
            level = level.withColumn("below", F.lit(0.0))
        else:
            parts = level.select("tokens", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
            below = (parts.join(last.select(F.col("tokens").alias("part"), F.greatest("confidence", "below").alias("below")), "part")
                     .groupBy("tokens").agg(F.max("below").alias("below")))
            level = level.join(below, "tokens")
        last = materialise(level, f"url-level{n}")
        kept = kept.union(last.where((F.col("confidence") >= CONFIDENCE) & (F.col("below") < F.col("confidence")))
                          .select(kept.columns))
    return kept


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and the mined rule's confidence."""
    described = describe(pages, key, url)
    rules = materialise(mine(described, labels, min_pages), "url-pruned")
    index = rules.select("lead", F.col("tokens").alias("need"), "confidence")
    # one row per set of tokens, far fewer than urls
    sets = described.select("tokens").distinct()
    hits = (sets.select("tokens", F.explode("tokens").alias("lead")).join(index, "lead")
            .where(F.size(F.array_except("need", "tokens")) == 0)
            .groupBy("tokens").agg(F.max("confidence").alias("confidence")))
    # a set of tokens may be that of a third of all urls: few matched sets go to the urls
    hits = materialise(hits, "url-hits")
    size = hits.agg(F.sum(F.octet_length(F.array_join("tokens", ",")) + 64)).first()[0] or 0
    hits = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    fit = described.withColumn("fixed", fixed(F.col("host"), F.col("path"))).join(hits, "tokens", "left")
    return fit.select(
        key, "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
