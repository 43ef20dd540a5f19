"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host
and path, trained on the driver from a small labelled table of URLs.

The features of a URL are the counts of hashed 3- to 5-grams of the bytes of ``^host$`` and, hashed
apart, of ``^path$``, scaled to length 1. The model is one array of weights that goes out with the task.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is scored
like any other; rows are judged alone, so ties and repeated rows need no care; very long urls are used
whole; an empty table gives an empty result; only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixclust.llm.words import flat, mix

DIMS = 1 << 16
SIZES = (3, 4, 5)
MOST_LABELLED = 10_000
MOST_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules that are asked for, as (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A small labelled table, (url, 1 for a site to block). Invented hosts.
LABELLED = (
    *((f"{scheme}{host}.example{end}", 1) for host, end in (
        ("casino-royal", ".com/play"), ("www.online-casino", ".org/en/1"), ("win-casino", ".net/bonus"), ("big-win", ".com/fr/jackpot"),
        ("poker-win", ".org/en/12"), ("free-poker", ".com/de/9"), ("free-spins", ".net/slots"), ("best-bets", ".com/en/77"),
        ("www.sport-bets", ".org/es/4"), ("bets-online", ".com/odds"), ("budget-pills", ".com/buy"), ("www.pills-online", ".org/en/8"),
        ("cheap-meds", ".net/fr/44"), ("cheap-watches", ".com/sale"), ("pharma-pills", ".com/en/310"), ("ads-server", ".com/en/5"),
        ("ads-click", ".org/banner"), ("click-track", ".com/px"), ("track-pixel", ".net/en/2"), ("m.adtrack", ".com/t"),
        ("spam-mail", ".com/en/91"), ("blog.link-farm", ".org/links"), ("spam-links", ".com/fr/6"), ("seo-farm", ".net/en/3"),
        ("adult-cams", ".com/en/18"), ("www.adult-video", ".org/x"), ("xxx-video", ".net/de/7"), ("adult-x-tube", ".com/en/40"),
    ) for scheme in ("https://", "http://www.")),
    *((f"{scheme}{host}.example{end}", 0) for host, end in (
        ("news", ".com/en/825"), ("www.weather", ".org/fr/12"), ("blog.garden", ".com/en/4.html"), ("harbour-notes", ".com/en/671"),
        ("northfield", ".org/en/9"), ("ferrand", ".com/es/75"), ("m.theatre", ".com/en/33"), ("library", ".org/de/8"),
        ("www.museum", ".com/fr/201"), ("stanmore", ".org/en/50"), ("blog.inventions", ".com/en/612"), ("gathering", ".com/fr/14"),
        ("recipes", ".org/es/99"), ("history", ".com/en/7"), ("science", ".org/en/400"), ("blog.travel", ".com/de/31"),
        ("bathstone", ".com/en/88"), ("m.winterly", ".org/en/5"), ("merchant", ".com/fr/66"), ("www.school", ".org/en/2"),
        ("music", ".com/en/314"), ("everton-choir", ".org/es/20"), ("wiki", ".org/en/1000"), ("forum.bikes", ".com/en/16"),
        ("andrews", ".com/en/940"), ("printers", ".org/fr/3"), ("readers", ".com/en/57"), ("theology", ".org/de/44"),
    ) for scheme in ("https://", "http://www.")),
)


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> F.Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = []
    for rule, verdict in rules:
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def ngrams(col: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each hashed n-gram of ``^text$``."""
    data, offs = flat(pc.binary_join_element_wise("^", pc.fill_null(col, ""), "$", ""))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    wide, rows, features = data.astype(np.uint64), [], []
    for n in SIZES:
        k = max(0, len(data) - n + 1)
        h = np.full(k, n * 2 + salt, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + wide[j : j + k]
        ok = np.arange(n, n + k) <= offs[1:][row[:k]]
        rows.append(row[:k][ok])
        features.append((mix(h[ok]) % np.uint64(DIMS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def scores(hosts: pa.Array, paths: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The regression's linear score of each row."""
    row, feature, value = features(hosts, paths)
    return bias + np.bincount(row, weights[feature] * value, minlength=len(hosts))


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each n-gram; each row's counts have length 1."""
    (r1, f1), (r2, f2) = ngrams(hosts, 0), ngrams(paths, 1)
    keys, counts = np.unique(np.concatenate([r1, r2]) * DIMS + np.concatenate([f1, f2]), return_counts=True)
    row, feature = keys // DIMS, keys % DIMS
    norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, minlength=len(hosts)))
    return row, feature, counts / norm[row]


def train(labelled: list[tuple[str, str, int]], rounds: int = 400, rate: float = 4.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label) rows, by gradient descent on the logistic loss."""
    hosts, paths, y = (list(x) for x in zip(*labelled, strict=True))
    row, feature, value = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    y, w, b = np.array(y, float), np.zeros(DIMS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[feature] * value, minlength=len(y)))))
        g = (p - y) / len(y)
        w -= rate * (np.bincount(feature, g[row] * value, minlength=DIMS) + l2 * w)
        b -= rate * float(g.sum())
    return w, b


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else block where the score reaches ``threshold``) and
    score of every row. ``labelled``: a table (url, label) of at most MOST_LABELLED rows."""
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    host, path = host_and_path()
    small = [tuple(r) for r in labelled.where("label is not null").select(host, path, "label").limit(MOST_LABELLED + 1).collect()]
    if not 0 < len(small) <= MOST_LABELLED:
        raise ValueError(f"the labelled table must have 1 to {MOST_LABELLED} rows")
    weights, bias = train(sorted(small))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-scores(b["host"], b["path"], weights, bias)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(score, "page_id long, host string, path string, score double")
    best = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(best["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"), "score")
