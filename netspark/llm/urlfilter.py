"""URL filtering: rules first, then naive Bayes over segmented hosts and paths.

A rule names a host and a path prefix; it fits its host and all subdomains, and
the longest fitting rule decides.  Urls without a rule are judged by multinomial
naive Bayes trained on the urls that have one.  Host names run words together, so
each distinct label is cut into words by a unigram Viterbi first; the unigrams are
counted over the visible words of all pages.

Everything that grows stays distributed: only page words that are a substring of
some label are counted, labels, their substrings and the counts meet in joins that
take frequent keys aside, and one label's known substrings are all that is gathered.
A word has at most ``LONGEST_WORD`` characters, which is as long as a label of a
host name can be; what is longer in a made-up label is cut into several.  Naive Bayes
keeps its counts in ``2 ** BITS`` hashed bins, a fixed size.  Words and tokens are
runs of letters of any script, or single digits.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule, and the verdict of the class prior; with no rule hit at all to learn from,
the verdict is ``allow``, as it is on a tie; a null or empty page text adds no
words; a null ``page_id`` stays null; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netspark.plans.skew import checked, join_counted
from netspark.plans.workspace import materialise

BITS = 18
LONGEST_WORD = 63
_TOKEN = r"(\p{L}+|\p{N})"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def match(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda x: (len(x), x)):  # later, longer ones win
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def viterbi(label: str, logs: dict[str, float], unknown: float) -> list[str]:
    """The likeliest words a label is made of; an unknown run costs ``unknown`` a character."""
    best = [0.0] + [-math.inf] * len(label)
    back = [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for size in range(1, min(end, LONGEST_WORD) + 1):
            word = label[end - size : end]
            score = best[end - size] + logs.get(word, unknown * size + unknown)
            if score > best[end]:
                best[end], back[end] = score, end - size
    words, at = [], len(label)
    while at:
        words.append(label[back[at] : at])
        at = back[at]
    return words[::-1]


def unigrams(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``word, n``: how often each ``wanted(word)`` is a visible word of the pages, lower-cased; one row has a null word and the number of all words."""
    plain = F.lower(F.regexp_replace("html", r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    held = words.join(checked(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return held.union(words.agg(F.lit(None).cast("string").alias("word"), F.count("*").alias("n")))


def substrings(labels: DataFrame) -> DataFrame:
    """``label, word``: the distinct substrings of at most ``LONGEST_WORD`` characters of each label."""
    size = F.length("label")
    at = labels.filter(size > 0).select("label", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    longest = F.least(F.lit(LONGEST_WORD), size - F.col("i") + 1)
    return at.select("label", F.explode(F.transform(F.sequence(F.lit(1), longest), lambda n: F.col("label").substr(F.col("i"), n))).alias("word")).distinct()


def segment(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """``label, words`` for distinct host labels, by unigram Viterbi over the pages' words."""
    candidates = materialise(substrings(labels), "substrings")
    wanted = materialise(candidates.groupBy("word").agg(F.count("*").alias("labels")), "wanted")
    counted = materialise(unigrams(pages, wanted.select("word")), "unigrams")
    total = float(counted.filter("word is null").first()["n"] or 1)
    weighed = materialise(wanted.join(counted.filter("word is not null"), "word"), "weighed")
    known = join_counted(candidates, weighed, "word", "labels", candidates.count())
    known = known.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    ready = labels.filter(F.length("label") > 0).join(known, "label", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = math.log(0.1 / total)
        for batch in batches:
            found = []
            for label, known in zip(batch.column("label").to_pylist(), batch.column("known").to_pylist(), strict=True):
                found.append(viterbi(label, {x["word"]: math.log(x["n"] / total) for x in known or ()}, unknown))
            yield pa.record_batch([batch.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "words"])

    return ready.mapInArrow(run, "label string, words array<string>")


def _bin(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(1 << BITS)).cast("int")


def judge(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every url."""
    spark = pages.sparkSession
    host, path = parse(F.col("url"))
    parsed = materialise(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", rule).withColumn("given", verdict)
    # Distinct hosts, their labels, and the words of each label.
    hosts = materialise(parsed.groupBy("host").agg(F.count("*").alias("urls")), "hosts")
    pieces = materialise(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"(\p{L}+|\p{N}+)"), 1)).alias("place", "label")), "pieces")
    labels = materialise(pieces.groupBy("label").agg(F.count("*").alias("hosts")), "labels")
    cut = materialise(segment(labels.select("label"), pages).join(labels, "label"), "cut")
    parts = join_counted(pieces, cut, "label", "hosts", pieces.count())
    by_host = parts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts")).select("host", F.flatten(F.col("parts.words")).alias("words"))
    by_host = materialise(hosts.join(by_host, "host", "left"), "segmented")
    on_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(_TOKEN), 1), lambda t: F.concat(F.lit("/"), t))
    on_host = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda t: F.concat(F.lit("."), t))
    joined = join_counted(ruled, by_host, "host", "urls", parsed.count()).withColumn("bins", F.transform(F.concat(on_host, on_path), _bin))
    # Multinomial counts in a fixed number of bins.
    learned = ruled.filter("given is not null").groupBy("given").count().collect()  # two rows
    prior = {r["given"]: r["count"] for r in learned}
    if not prior:
        return ruled.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"))
    counts = joined.filter("given is not null").select("given", F.explode("bins").alias("bin")).groupBy("bin").agg(F.count(F.when(F.col("given") == "allow", 1)).alias("allow"), F.count(F.when(F.col("given") == "block", 1)).alias("block"))
    table = np.zeros((2, 1 << BITS))
    for r in counts.collect():  # at most 2 ** BITS rows
        table[:, r["bin"]] = r["allow"], r["block"]
    used = max(1, int((table.sum(axis=0) > 0).sum()))
    logs = np.log((table + 1) / (table.sum(axis=1, keepdims=True) + used))
    odds = (logs[1] - logs[0]).astype(np.float32)
    start = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1))
    shared = spark.sparkContext.broadcast(odds)  # 1 MB whatever the corpus

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            bins = batch.column("bins").to_pylist()
            blocked = [start + float(odds[b].sum()) > 0 if b else start > 0 for b in bins]
            given = batch.column("given").to_pylist()
            said = [g or ("block" if x else "allow") for g, x in zip(given, blocked, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return joined.select("page_id", "host", "path", "rule", "given", "bins").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
