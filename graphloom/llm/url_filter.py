"""URL filters: allow and block rules, and logistic regression on hashed character n-grams for the rest.

Host and path come from the url by string functions.  The longest rule that fits decides; where none fits, a logistic regression
does, over 3- to 5-grams of ^host$ and of the path, each hashed with its part into `dim` weights.  It is trained on the driver
from a small labelled table of urls, at most `max_rows` rows, by full-batch gradient descent from zero: no randomness.  The weights, `dim`
doubles, are all that goes to the executors.

A url that is null or without "://" has empty host and path; no rule fits and the model judges it by its intercept.  An empty path fits
no rule.  Repeated rows are judged each for itself.  No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, table

#: The rules (verdict, host, path) that the query is to apply.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: A small labelled table: urls of ordinary and of unwanted sites.
LABELLED = [
    *((u, 0) for u in (
        "https://www.cityherald.net/en/news/412", "https://blog.greenvalley.net/en/88", "http://library.riverside.edu/es/catalog/17", "https://museum.northport.net/fr/231", "https://www.weatherdesk.net/de/45.html",
        "https://m.cookbooknotes.net/en/recipes/7", "https://docs.openlibrary.net/en/guide/3", "https://school.eastwood.net/es/901?page=2", "http://www.gardenjournal.net/en/550/", "https://forum.cyclists.net/de/612#top",
        "https://www.mathnotes.net/en/120", "https://history.lakeside.net/fr/77", "https://blog.the-other.net/en/340", "http://www.mountaintrail.net/es/15", "https://research.example.net/en/204",
        "https://www.thenational.net/en/99", "https://m.anders.net/de/310", "https://tionhall.net/en/5", "https://blog.thereon.net/es/64", "https://www.andthe.net/fr/812", "http://thanin.net/en/36", "https://www.readings.com/en/71", "https://blog.inthere.com/es/402", "https://www.heron.com/en/18",
        "https://www.tharen.example.com/en/4", "https://ththor.example.com/es/12", "http://blog.theran.example.com/en/620.html", "https://m.ththis.example.com/de/3", "https://ththat.example.com/en/88", "http://thand.example.com/en/7", "https://thhers.example.com/es/5",
    )),
    *((u, 1) for u in (
        "https://www.cheap-pills-online.net/en/1", "http://cheap-pills.shop.net/fr/22", "https://buy-cheap-pills.com/en/3?ref=x", "https://spam-farm.link.net/en/45", "http://www.spam-farm.com/es/8", "https://spam-links.farm.net/de/17",
        "https://free-casino-bonus.net/en/50", "http://online-casino-win.com/de/61", "https://casino-spins.net/es/9", "https://hot-xxx-videos.net/en/12", "http://xxx-adult-cams.com/fr/4", "https://adult-dating-free.net/en/6",
        "https://replica-watches-cheap.net/en/71", "http://win-free-prize.com/en/2", "https://payday-loans-fast.net/es/33", "https://viagra-discount-pills.com/en/10", "http://click-bait-farm.net/en/19", "https://seo-spam-links.com/en/28", "https://free-prize-winner.net/de/5", "https://malware-download-free.net/en/14", "https://cheap-pills.example.net/en/7", "https://spam-farm.example.net/es/6",
        "https://ads-server.example.net/en/3", "http://track-ads.net/es/40", "https://pixel-track-ads.com/en/9", "https://free-bets-now.net/en/31",
        "https://win-casino-now.example.com/en/5", "https://bets-free.example.com/de/3", "http://pill-shop.example.com/es/44", "https://ads-tracker.example.com/en/6", "https://casino.example.com/fr/9", "https://spam-links.example.com/en/2", "http://online-bets.example.com/es/71",
    )),
]

DIM, GRAMS, MAX_ROWS = 1 << 14, (3, 4, 5), 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(known, ascii_lower(host)).otherwise(empty), F.when(known, path).otherwise(empty)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, dim: int) -> np.ndarray:
    """Hashed n-grams, each once."""
    found = set()
    for part, text in (("h", f"^{host}$"), ("p", path)):
        raw = text.encode()
        for n in GRAMS:
            found.update(zlib.crc32(raw[k : k + n], ord(part)) % dim for k in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def split_url(url: str | None) -> tuple[str, str]:
    """host_and_path for one url of the labelled table."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    end = min([k for c in "?#" if (k := path.find(c)) >= 0], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def train(labelled: list[tuple[str | None, int]], *, dim: int = DIM, steps: int = 300, rate: float = 1.0, l2: float = 1e-3, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    rows = labelled[:max_rows]
    feats = [grams(*split_url(u), dim) for u, _ in rows]
    y = np.array([v for _, v in rows], float)
    at, col = np.repeat(np.arange(len(rows)), [len(f) for f in feats]), np.concatenate(feats) if rows else np.zeros(0, np.int64)
    scale = np.array([1 / np.sqrt(max(1, len(f))) for f in feats])
    w, b = np.zeros(dim), 0.0
    for _ in range(steps if rows else 0):
        z = np.bincount(at, w[col], len(rows)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(col, (g * scale)[at], dim) * 4 + l2 * w)
        b -= rate * g.sum()
    return w, b


def judge(pages: DataFrame, *, rules=RULES, labelled=LABELLED, dim: int = DIM, url_col: str = "url") -> DataFrame:
    """The input row as struct __row, with host, path, rule, p_block and verdict beside it."""
    w, b = train(list(labelled), dim=dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            feats = [grams(h, p, dim) for h, p in zip(hosts, paths, strict=True)]
            z = [w[f].sum() / np.sqrt(max(1, len(f))) + b for f in feats]
            yield batch.append_column("p_block", pa.array(1 / (1 + np.exp(-np.array(z, float))), pa.float64()))

    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__row"), host.alias("host"), path.alias("path"))
    schema = T.StructType([*rows.schema.fields, T.StructField("p_block", T.DoubleType())])
    rows = rows.mapInArrow(score, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))})


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("__row.page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
