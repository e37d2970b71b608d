"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions only: n-grams are array expressions, and Spark's own logistic regression learns
from a small labelled URL table.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
rule's; the longest fitting rule wins. Any other URL is blocked if the model's probability of "block"
is at least THRESHOLD.

Defined cases: a null URL, or one without ``://``, has an empty host and path; it fits no rule with a
host and gets the verdict that the model has for no n-grams at all. Very long URLs are read whole. Rows
that repeat stay rows of their own. Other columns are carried along; those named like the result's are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, path, verdict
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: The labelled URL table: (url, 1 to block).
LABELLED = (
    ("https://en.wikipedia.example.org/wiki/History_of_science", 0),
    ("https://www.library.example.edu/catalogue/item/2231", 0),
    ("http://news.daily.example.com/world/2023/05/elections", 0),
    ("https://docs.project.example.org/guide/install.html", 0),
    ("https://blog.gardening.example.net/fr/tomates", 0),
    ("https://recipes.kitchen.example.com/de/brot-backen", 0),
    ("http://www.museum.example.org/es/exposiciones", 0),
    ("https://forum.cycling.example.net/thread/1881?page=2", 0),
    ("https://www.university.example.edu/courses/algebra", 0),
    ("https://travel.notes.example.com/en/lisbon-in-spring", 0),
    ("https://weather.service.example.gov/forecast/today", 0),
    ("http://poetry.archive.example.org/author/collected-poems", 0),
    ("https://health.info.example.gov/vaccines/schedule", 0),
    ("https://www.city.example.org/council/minutes/2019", 0),
    ("https://science.journal.example.org/articles/10245", 0),
    ("https://music.reviews.example.com/fr/album/concert", 0),
    ("http://chess.club.example.net/de/turnier.html", 0),
    ("https://old.books.example.org/en/chapter/12", 0),
    ("https://www.parliament.example.gov/debates/transcript", 0),
    ("https://birds.watch.example.net/es/aves", 0),
    ("http://casino-bonus.example.com/free-spins/jackpot", 1),
    ("https://win-poker-online.example.net/bonus/slots", 1),
    ("http://cheap-pills.example.com/viagra/buy-now", 1),
    ("https://xxx-videos.example.net/free-porn/hd", 1),
    ("http://adult-cams.example.com/live/sex-chat", 1),
    ("http://download-crack.example.net/keygen/serial-free.exe", 1),
    ("https://fast-loans.example.com/payday/apply-now", 1),
    ("http://replica-watches.example.net/cheap/rolex-sale", 1),
    ("https://track.adserver.example.com/click?campaign=991", 1),
    ("http://ads.banner.example.net/popup/redirect", 1),
    ("http://slots-jackpot.example.com/casino/win-big", 1),
    ("https://free-bitcoin.example.net/double-your-coins", 1),
    ("http://hot-singles.example.com/dating/xxx", 1),
    ("http://torrent-crack.example.net/warez/free-download", 1),
    ("https://escort-service.example.com/adult/girls", 1),
    ("http://buy-followers.example.net/cheap-likes", 1),
    ("http://miracle-diet.example.com/lose-weight-fast/buy-now", 1),
    ("https://sexcams.example.net/porn/live", 1),
    ("http://betting-tips.example.com/poker/bonus-code", 1),
    ("http://clickbait.adserver.example.net/popup/win-prize", 1),
)
SIZES = (2, 3, 4)
FEATURES = 1 << 14
THRESHOLD = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: str, mark: str, sizes: tuple[int, ...]) -> list[Column]:
    """Arrays of the n-grams of each size of the column ``text``, each with the part's mark."""
    letters = f"split(concat('^', {text}, '$'), '')"
    out = []
    for n in sizes:
        joined = ", ".join(f"c[i + {k}]" for k in range(n))
        # one array of letters, then by position: linear in the text's length
        each = f"transform(sequence(0, size(c) - {n}), i -> concat('{mark}', {joined}))"
        out.append(F.expr(f"CASE WHEN {text} = '' THEN array() ELSE flatten(transform(array({letters}), c -> CASE WHEN size(c) >= {n} THEN {each} ELSE array() END)) END"))
    return out


def _featured(rows: DataFrame) -> DataFrame:
    """Adds __grams from the columns __host and __path."""
    return rows.withColumn("__grams", F.concat(*_grams("__host", "h", SIZES), *_grams("__path", "p", SIZES)))


def train(spark: SparkSession, labelled: DataFrame | None = None, features: int = FEATURES) -> PipelineModel:
    """A model from a small table (url, label); the built-in one if none is given."""
    own = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in LABELLED])
    table = labelled if labelled is not None else spark.range(1).select(F.inline(own))
    host, path = parts(F.col("url"))
    rows = _featured(table.select(host.alias("__host"), path.alias("__path"), F.col("label").cast("double").alias("label"))).coalesce(1)
    hashed = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=features, binary=True)
    fitted = LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", regParam=0.1, maxIter=50).fit(hashed.transform(rows))
    # the summary of the training holds the session, which no task may carry
    fitted._java_obj.setSummary(spark.sparkContext._jvm.scala.Option.empty())
    return PipelineModel([hashed, fitted])


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, model: PipelineModel | None = None, threshold: float = THRESHOLD, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none), verdict and the model's probability of "block"."""
    own = ("host", "path", "rule", "verdict", "probability")
    kept = [c for c in pages.columns if c not in own]
    host, path = parts(F.col(url_col))
    rows = _featured(pages.withColumn("__host", host).withColumn("__path", path))
    scored = (model or train(pages.sparkSession)).transform(rows)
    probability = F.element_at(vector_to_array("__probability"), 2)
    found = rule_for(F.col("__host"), F.col("__path"), rules)
    return scored.select(
        *kept, F.col("__host").alias("host"), F.col("__path").alias("path"), found["rule"].alias("rule"),
        F.coalesce(found["verdict"], F.when(probability >= threshold, "block").otherwise("allow")).alias("verdict"), probability.alias("probability"),
    )
