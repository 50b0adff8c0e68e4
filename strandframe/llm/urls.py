"""URL filters: rules first, then naive Bayes over segmented host and path tokens."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandframe.plans.session import materialize

#: (host, path prefix, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of seed hosts: urls whose host holds one are the block class that the model is trained on; there are no labels of urls.
SEEDS = ("ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "farm", "free", "gambling", "loan", "lottery", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "winner", "xxx")
#: Words beside them that the segmenter knows before it has counted anything.
KNOWN = ("blog", "com", "example", "forum", "mail", "media", "net", "news", "online", "org", "shop", "site", "store", "web", "wiki", "www")
#: Block counts that each seed word has beforehand, so that small tables know them too, and counts of words known to the segmenter.
SEED_COUNT, KNOWN_COUNT = 1, 50
#: Octets of a label of a host name, and so characters of a word, at most (RFC 1035).
LABEL = 63

_TOKEN = re.compile(r"[^\W_]+")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path``: host in lower case and path; both empty for null or a url without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)://([^/?#]*)([^?#]*)", k), F.lit(""))
    lower = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), lower.alias("host"), part(2).alias("path"))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the rule (host and path joined) and the verdict of the longest rule that fits, the first of equals; null for none."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for h, p, v in sorted(rules, key=lambda r: -len(r[0]) - len(r[1])):
        out = out.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    return out


def segment(name: str, logs: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of a name into words of given log probabilities; unknown pieces pay by length. Earlier cuts win ties."""
    n = len(name)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - LABEL), j):
            s = best[i] + logs.get(name[i:j], unknown - 2.5 * (j - i))
            if s > best[j]:
                best[j], back[j] = s, i
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def _concatenated(word: str) -> bool:
    """Whether a word is a concatenation of seed and known words, and so no word of its own."""
    logs = {w: -8.0 for w in (*SEEDS, *KNOWN) if len(w) > 2}
    parts = segment(word, logs, -math.log(1e6))
    return len(parts) > 1 and all(p in logs for p in parts)


def _tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array of word tokens of a text column."""

    def run(batches):
        for b in batches:
            found = [_TOKEN.findall(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"{out} array<string>").fields]))


@dataclass
class UrlModel:
    """Tables of a fitted model, none of which reaches the driver: ``hosts(host, tokens)`` and ``weights(token, w)``, and the bias."""

    hosts: DataFrame
    weights: DataFrame
    bias: float


def _segments(words: DataFrame) -> DataFrame:
    """``label, tokens``: every distinct label of ``words(w, n)`` in words, by counts of all labels and of the known words.

    A label meets the counts of its pieces by a join on the piece, so the vocabulary has any size.
    """
    spark = words.sparkSession

    def own(batches):
        for b in batches:
            plain = [not (w in SEEDS or w in KNOWN) and _concatenated(w) for w in b.column(0).to_pylist()]
            yield b.filter(pa.array([not x for x in plain], pa.bool_()))

    given = spark.createDataFrame([(w, KNOWN_COUNT) for w in (*SEEDS, *KNOWN)], "w string, n long")
    counts = materialize(words.where(F.length("w") <= LABEL).mapInArrow(own, "w string, n long").union(given).groupBy("w").agg(F.sum("n").alias("n")), "url-words")
    total = float(counts.agg(F.sum("n")).first()[0])

    def pieces(batches):
        for b in batches:
            for w in b.column(0).to_pylist():
                found = list({w[i:j] for i in range(len(w)) for j in range(i + 1, min(len(w), i + LABEL) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(found), pa.string()), pa.array(found, pa.string())], names=["label", "w"])

    met = words.select("w").mapInArrow(pieces, "label string, w string").join(counts, "w").groupBy("label").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def split(batches):
        for b in batches:
            found = []
            for w, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.append(segment(w, {x["w"]: math.log(x["n"] / total) for x in known or ()}, -math.log(total)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "tokens"])

    return words.select(F.col("w").alias("label")).join(met, "label", "left").mapInArrow(split, "label string, tokens array<string>")


def fit(pages: DataFrame, url_col: str = "url") -> UrlModel:
    """Count words and classes over every url.

    Unigrams are the host tokens of all urls, as many as there are, and the words of ``SEEDS`` and ``KNOWN``; labels over
    ``LABEL`` characters are no words but are split into them. A name is the block class if its segments hold a seed word, else
    allow; token counts of both classes are smoothed by one half. Hosts and paths are counted once each before any join;
    only sums reach the driver. An empty table gives a model of the seed words alone.
    """
    spark = pages.sparkSession
    urls = parsed(pages.withColumn("_id", F.lit(0)), "_id", url_col)
    hosts = materialize(_tokens(urls.groupBy("host").agg(F.count("*").alias("n")), "host", "labels"), "url-hosts")
    words = materialize(hosts.select(F.explode("labels").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")), "url-labels")
    parts = hosts.select("host", F.posexplode("labels").alias("at", "label")).join(_segments(words), "label")
    named = parts.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x.tokens)).alias("tokens"))
    named = hosts.select("host", "n").join(named, "host", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    named = materialize(named.withColumn("y", F.arrays_overlap("tokens", F.array(*map(F.lit, SEEDS)))), "url-names")
    block, allow = F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("y"), 0).otherwise(F.col("n")))
    paths = _path_tokens(urls.groupBy("host", "path").agg(F.count("*").alias("n"))).groupBy("host", "token").agg(F.sum("n").alias("n"))
    seen = named.select(F.explode("tokens").alias("token"), "y", "n").unionByName(paths.join(named.select("host", "y"), "host").select("token", "y", "n"))
    counts = seen.groupBy("token").agg(block.alias("b"), allow.alias("a"))
    seeds = spark.createDataFrame([(w, SEED_COUNT, 0) for w in SEEDS], "token string, b long, a long")
    counts = materialize(counts.unionByName(seeds).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "url-counts")
    s = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    sb, sa = s.b + 0.5 * s.v, s.a + 0.5 * s.v
    weights = counts.select("token", (F.log((F.col("b") + 0.5) / sb) - F.log((F.col("a") + 0.5) / sa)).alias("w"))
    c = named.agg(block.alias("b"), allow.alias("a")).first()
    return UrlModel(named.select("host", "tokens"), weights, math.log(((c.b or 0) + 1) / ((c.a or 0) + 1)))


def _path_tokens(rows: DataFrame) -> DataFrame:
    """``host, token, n`` of the tokens of each path, marked by a slash; numbers are none."""
    d = _tokens(rows.withColumn("path", F.lower("path")), "path", "t").select("host", F.explode("t").alias("t"), "n")
    return d.where(~F.col("t").rlike(r"^\d+$")).select("host", F.concat(F.lit("/"), "t").alias("token"), "n")


def _scores(rows: DataFrame, key: str, tokens: str, model: UrlModel) -> DataFrame:
    """``key, z``: the sum of the weights of the tokens of each distinct key; rows without tokens are left out."""
    return rows.select(key, F.explode(tokens).alias("token")).join(model.weights, "token").groupBy(key).agg(F.sum("w").alias("z"))


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, tokens, score`` for every url.

    The verdict is the longest fitting rule's, else block where the posterior of the block
    class is at least one half (a tie blocks); log odds count to nine digits. A null url, or one without ``://``, has
    empty host and path and no tokens, and gets the prior's verdict. Repeated rows are judged alike; other
    columns are ignored; an empty table gives no rows. Urls of hosts that the model has not counted have the tokens of their paths only.
    """
    urls = parsed(pages, id_col, url_col)
    paths = _tokens(urls.select("path", F.lower("path").alias("low")).distinct(), "low", "t")
    paths = materialize(paths.select("path", F.transform(F.filter("t", lambda x: ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("/"), x)).alias("path_tokens")), "url-paths")
    by_host = model.hosts.join(_scores(model.hosts, "host", "tokens", model).withColumnRenamed("z", "zh"), "host", "left")
    by_path = paths.join(_scores(paths, "path", "path_tokens", model).withColumnRenamed("z", "zp"), "path", "left")
    d = urls.join(by_host, "host", "left").join(by_path, "path", "left")
    z = F.round(F.lit(model.bias) + F.coalesce("zh", F.lit(0.0)) + F.coalesce("zp", F.lit(0.0)), 9)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))
    none = F.array().cast("array<string>")
    d = d.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("r"), F.concat(F.coalesce("tokens", none), F.coalesce("path_tokens", none)).alias("tokens"), score.alias("score"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return d.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "tokens", "score")
