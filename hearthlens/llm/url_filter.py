"""URL filters: host and path rules first, then a trained classifier.

The classifier is a logistic regression over hashed character n-grams of host
and path, fitted on a small labelled URL table.  Everything on the scoring
path is a column expression: no shuffle, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlens.llm import native_lr
from hearthlens.llm.common import ascii_lower

#: Topic words of the labelled table.
BLOCK_WORDS = ["ads", "adserver", "adtrack", "tracker", "track", "click", "banner", "popup", "casino", "poker", "bets", "slots",
               "spam", "farm", "adult", "xxx", "porn", "sex", "pharma", "pills", "viagra", "cheap", "free", "payday", "loans", "torrent", "warez", "crack", "win"]
ALLOW_WORDS = ["news", "blog", "wiki", "docs", "library", "science", "university", "museum", "journal", "weather", "recipes",
               "travel", "forum", "developer", "health", "history", "garden", "music", "sports", "research", "learn", "book",
               "school", "city"]
#: The rules of the registered query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label 1 = block), built by a rule:
    each topic word as a host, as a host part and as a path part."""
    rows = []
    for label, words in ((1.0, BLOCK_WORDS), (0.0, ALLOW_WORDS)):
        for i, w in enumerate(words):
            o = words[(i + 7) % len(words)]
            rows += [(f"https://{w}.example.com/", label), (f"http://www.{w}-{o}.example.org/{o}", label), (f"http://{o}-{w}.example.com/fr/2{i}", label),
                     (f"https://m.{w}-x.example.net/en/1{i}", label), (f"https://shop.example.com/{w}/{o}{i}", label)]
    neutral = ["thandon", "reshing", "ouverti", "lannes", "mentori", "haedith", "ertono", "stalin", "venuti", "chorale"]
    rows += [(f"https://{p}{n}.example.{t}/{lang}/{i * 37}{q}", 0.0) for i, n in enumerate(neutral) for p in ("", "m.", "blog.", "www.")
             for t, lang, q in (("com", "en", ""), ("org", "fr", ".html"), ("net", "de", "?page=2"))]
    return spark.createDataFrame(rows, "url string, label double")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/``, ``?``, ``#`` or
    the end with A-Z lower-cased; path up to ``?``, ``#`` or the end.  Null or
    no ``://``: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def _grams(tag: str, text: Column, n: int, dim: int) -> Column:
    last = F.length(text) - F.lit(n - 1)
    ids = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                      lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substr(text, i, F.lit(n))), F.lit(dim)).cast("int"))
    return F.when(last >= 1, ids).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column, dim: int) -> Column:
    """Distinct feature numbers of the 3- to 5-grams of host and path; the
    marks ``^`` and ``$`` show the ends."""
    h, p = (F.concat(F.lit("^"), x, F.lit("$")) for x in (host, F.lower(path)))
    return F.array_distinct(F.concat(*[_grams(f"{t}{n}", c, n, dim) for t, c in (("h", h), ("p", p)) for n in (3, 4, 5)]))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  Ties of
    equal length go to block, then to the alphabetically first rule."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


class UrlClassifier:
    """P(block) of a URL from the n-grams of its host and path."""

    def __init__(self, weights: list[float], bias: float, dim: int):
        self.weights, self.bias, self.dim = weights, bias, dim

    @classmethod
    def fit(cls, labelled: DataFrame, url: str = "url", label: str = "label", dim: int = 4096, reg: float = 0.002) -> UrlClassifier:
        """labelled: a small table (the caller's bound) of url and label (1 =
        block); rows with a null in either are not learned from."""
        t = labelled.select(F.col(url).alias("u"), F.col(label).cast("double").alias("label")).dropna()
        host, path = split_url(F.col("u"))
        train = t.select("label", features(host, path, dim).alias("ids"))
        rows, bias = native_lr.fit(train, dim, reg, 0.0)
        return cls(rows[1], bias[1], dim)

    def prob(self, host: Column, path: Column) -> Column:
        z = native_lr.log_odds(features(host, path, self.dim), self.weights, self.bias)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge(pages: DataFrame, classifier: UrlClassifier, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, p_block.

    A rule fits its host and all subdomains when the path starts with the
    rule's path; the longest fitting rule decides, else the classifier (block
    from ``threshold``).  Null or odd URLs have empty host and path and are
    judged like any other; repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    return (base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), classifier.prob(F.col("host"), F.col("path")).alias("p_block"))
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "p_block"))
