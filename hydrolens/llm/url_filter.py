"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model is fitted on a small labelled table of URLs (a bounded parameter: its
size does not follow the corpus) and compiled into one projection: n-grams of host
and path are hashed to ``DIMS`` places of a weight array. DataFrame operations only.

Defined results: a NULL URL, or one without ``://``, has an empty host and path, no
rule, and the model's verdict on no n-grams (its intercept). Rows are judged one by
one; other columns pass through, those named as a result are replaced; an empty
table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 1 << 12
GRAM = 3

#: The default labelled table is made of words by a rule (``labelled_urls``). Words of sites to allow:
ALLOWED = (
    "water river museum library school history science nature garden recipe bread atlas weather forest village council "
    "parliament archive journal dictionary grammar poetry novel theatre orchestra painting physics chemistry biology "
    "geology astronomy medicine hospital health farming cycling hiking football chess travel railway harbour bridge "
    "kitchen pottery weaving teacher student lecture course research report news article forum docs manual python "
    "software linux browser database energy climate ocean mountain island bird flower"
).split()

#: Words of sites to block.
BLOCKED = (
    "casino poker jackpot roulette slots betting bets gambling lottery bingo pills viagra cialis pharmacy diet miracle "
    "weightloss porn xxx sex sexcam adult escort hookup nude hotgirls loan payday fastcash getrich doubler forex "
    "torrent warez crack keygen serials cheat hack phishing paypa1 verifyaccount prize winner claim giveaway freespins "
    "bonus777 replica rolex cheap discount buynow followers clickbait popup adserver ads spam tracker malware toolbar "
    "win free"
).split()

#: Domain endings, forms of a host and paths: each stands in both classes alike, so that none decides alone.
ENDINGS = "com net org edu info io de fr es co.uk eu example.com example.net example.org".split()
HOSTS = ("{a}", "www.{a}", "{a}-{b}", "m.{a}-{b}", "{b}{a}", "blog.{a}", "{b}.{a}", "best-{a}")
PATHS = ("/", "", "/en/{n}", "/{b}/{n}.html", "/play", "/docs/guide", "/de/{n}/", "/{b}", "/index.html", "/fr/{n}", "/login/{b}",
         "/es/{n}.html")


def labelled_urls() -> list[tuple[str, float]]:
    """URLs and labels (1: block). Every word heads as many hosts as there are forms, on endings and with paths in turn;
    made-up words, which tell nothing, and hosts without any stand among the allowed."""
    out = []
    for words, label in ((ALLOWED, 0.0), (BLOCKED, 1.0)):
        for i, a in enumerate(words):
            for j, form in enumerate(HOSTS):
                b, at = words[(7 * i + 13 * j + 5) % len(words)], len(HOSTS) * i + j
                host = form.format(a=a, b=b) + "." + ENDINGS[(5 * i + j) % len(ENDINGS)]
                out.append((("http", "https")[at % 2] + "://" + host + PATHS[(3 * i + j) % len(PATHS)].format(b=b, n=37 * at % 9000), label))
    sounds = [c + v + e for c in "bdfklmnprst" for v in "aeiou" for e in "lnrst"]
    for i, end in enumerate(ENDINGS * 10):
        made = sounds[29 * i % len(sounds)] + sounds[(53 * i + 7) % len(sounds)]
        host = (made, "www." + made, "m." + made, "blog." + made)[i // len(ENDINGS) % 4] + "." + end
        out.append(("https://" + host + PATHS[5 * i % len(PATHS)].format(b=made, n=41 * i % 9000), 0.0))
    return out + [("https://" + sub + end + path, 0.0) for end in ENDINGS for sub in ("", "www.") for path in ("/", "/docs/guide")]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for hosts equal to or below ``host`` with paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


#: The contract's rules.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    lower = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": lower, "path": F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)}


def _grams(kind: str, s: Column) -> Column:
    """Places of the n-grams of a string between two marks; none of an empty string."""
    # characters as an array: a place in a string of several bytes a character takes a walk to it, for each n-gram
    marked = F.split(F.concat(F.lit("^"), s, F.lit("$")), "")
    hashed = F.transform(F.array(marked), lambda cs: F.transform(
        F.sequence(F.lit(0), F.size(cs) - GRAM),
        lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*[F.get(cs, i + j) for j in range(GRAM)])), F.lit(DIMS)).cast("int")))[0]
    return F.when(F.length(s) > 0, hashed).otherwise(F.array().cast("array<int>"))


def places() -> Column:
    return F.concat(_grams("h", F.col("host")), _grams("p", F.col("path")))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        """That a URL is to be blocked: the mean weight of its n-grams, and the intercept."""
        w = F.lit(list(self.weights)).cast("array<double>")
        total = F.aggregate(places(), F.lit(0.0), lambda acc, i: acc + F.get(w, i))
        n = F.greatest(F.size(places()), F.lit(1))
        return 1 / (1 + F.exp(-(total / n + F.lit(self.intercept))))


def labelled(spark: SparkSession) -> DataFrame:
    """The default table, some 1,300 rows."""
    rows = labelled_urls()
    urls, labels = (F.lit([r[i] for r in rows]) for i in (0, 1))
    pairs = F.arrays_zip(urls.alias("url"), labels.alias("label"))
    return spark.range(1).select(F.explode(pairs).alias("r")).select(F.col("r.url").alias("url"), F.col("r.label").alias("label"))


def fit(urls: DataFrame, regularisation: float = 1e-5) -> Model:
    """Fit on a small table of ``url`` and ``label`` (1: block). Rows without a label are left out."""
    n = F.greatest(F.size("places"), F.lit(1))
    found = F.col("found")
    zeros = lambda before, after: F.array_repeat(F.lit(0.0), after - F.coalesce(before, F.lit(-1)) - 1)
    share = lambda p: F.size(F.filter(F.col("places"), lambda x: x == p)) / n
    runs = F.transform(found, lambda p, k: F.concat(zeros(F.get(found, k - 1), p), F.array(share(p))))
    dense = F.concat(F.flatten(runs), zeros(F.array_max(found), F.lit(DIMS)))
    rows = (urls.where("label IS NOT NULL").withColumns(host_and_path(F.col("url"))).withColumn("places", places())
            .withColumn("found", F.sort_array(F.array_distinct("places"))).orderBy("url").coalesce(1)
            .select("label", array_to_vector(dense).alias("features")))
    fitted = LogisticRegression(regParam=regularisation, maxIter=100, standardization=False).fit(rows)
    return Model(tuple(float(x) for x in fitted.coefficients.toArray()), float(fitted.intercept))


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits), ``p_block`` and ``verdict``.

    ``rules`` is a list written by hand, of a few hundred at most; it becomes part
    of the projection. Of two rules of one length, the one with the longer host wins.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    pick = lambda value: F.coalesce(*[F.when(r.fits(), F.lit(value(r))) for r in order], F.lit(None).cast("string"))
    guess = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    made = {"host", "path", "rule", "p_block", "verdict"} - {url}
    return (pages.drop(*made).withColumns(host_and_path(F.col(url)))
            .withColumns({"rule": pick(lambda r: r.name), "p_block": model.probability()})
            .withColumn("verdict", F.coalesce(pick(lambda r: r.verdict), guess)))
