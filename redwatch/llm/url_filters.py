"""URL filters: host and path rules first, a logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled table of URLs (``LABELLED`` unless the caller gives another, at most
``MAX_LABELLED`` rows). Its weights, ``BUCKETS`` doubles, go to the tasks; URLs are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import buffers, mix

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)
MAX_LABELLED = 10_000

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# fixed values: a small labelled table, 1 = block
LABELLED: tuple[tuple[str, int], ...] = (
    ("https://www.casino-win.example.com/en/1", 1),
    ("http://best-casino.example.org/en/bonus", 1),
    ("https://casino-royal.example.com/play/slots", 1),
    ("http://online-casino.test/jackpot", 1),
    ("https://spam-farm.example.com/en/7", 1),
    ("http://www.spam-farm.example.org/links/22", 1),
    ("http://spam-mail.test/offer", 1),
    ("https://link-farm.example.org/seo/5", 1),
    ("http://cheap-pills.example.com/buy/viagra", 1),
    ("https://pills-online.test/order", 1),
    ("http://viagra-shop.example.org/en/cheap", 1),
    ("https://xxx-videos.example.com/adult/3", 1),
    ("http://adult-porn.test/free", 1),
    ("https://porn-tube.example.org/en/9", 1),
    ("http://free-money.example.com/win/prize", 1),
    ("https://win-prize.test/claim", 1),
    ("http://poker-bet.example.org/en/bonus", 1),
    ("https://sport-bet.example.com/odds/11", 1),
    ("http://betting-win.test/casino", 1),
    ("https://payday-loans.example.com/apply", 1),
    ("http://fast-loans.example.org/credit", 1),
    ("https://replica-watches.test/shop", 1),
    ("http://click-ads.example.com/track/1", 1),
    ("https://malware-download.example.org/crack/keygen", 1),
    ("http://warez-crack.test/serial", 1),
    ("http://www.free-bets.example.org/en/12", 1),
    ("https://m.bets-free.example.com/fr/13/", 1),
    ("http://ads-tracker.example.com/de/14.html", 1),
    ("https://track-ads.example.org/es/15", 1),
    ("http://m.cheap-drugs.example.org/en/16#top", 1),
    ("https://www.pills-cheap.example.com/fr/17", 1),
    ("http://casino.example.org/es/18", 1),
    ("https://farm-of-spam.example.com/en/19/", 1),
    ("https://phishing-login.example.com/verify", 1),
    ("https://www.example.com/en/1", 0),
    ("http://example.org/de/22", 0),
    ("https://m.example.net/fr/333", 0),
    ("http://blog.example.com/es/4444", 0),
    ("https://news.example.org/en/55555.html", 0),
    ("http://www.library.example.org/en/6", 0),
    ("https://university.test/research/paper", 0),
    ("http://museum.example.com/de/ausstellung", 0),
    ("https://weather.example.org/fr/meteo", 0),
    ("http://recipes.test/en/bread", 0),
    ("https://m.travel.example.com/es/guia", 0),
    ("http://www.school.example.org/en/lessons", 0),
    ("https://science.example.com/en/physics/12", 0),
    ("http://blog.garden.example.org/de/13/", 0),
    ("https://health.test/en/nutrition", 0),
    ("http://www.history.example.com/fr/14", 0),
    ("https://docs.example.org/en/reference", 0),
    ("http://forum.example.com/en/topic/15", 0),
    ("https://wiki.test/de/artikel", 0),
    ("http://m.thestone.example.org/en/16", 0),
    ("https://www.theother.example.com/de/17#top", 0),
    ("http://tionhere.example.org/es/18.html", 0),
    ("https://blog.anding.example.com/fr/19/", 0),
    ("http://ouright.test/en/20", 0),
    ("https://www.nation.example.org/en/21/", 0),
    ("http://thereis.example.com/en/22.html", 0),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule ``host/path`` covers a host (or a subdomain of it) and the start of a path."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def rule_columns(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does; equal lengths go by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ordered):
        hit = fits(text, host, path)
        rule, verdict = F.when(hit, text).otherwise(rule), F.when(hit, what).otherwise(verdict)
    return rule, verdict


# --------------------------------------------------------------------------- model


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the texts; digits count as one symbol, so numbers do not matter."""
    data, at = buffers(texts)
    low, high = int(at[0]), int(at[-1])
    data, at = data[low:high], at - low
    codes = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, buckets = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + codes[j : j + m]
        whole = row[:m] == row[n - 1 :]
        rows.append(row[:m][whole])
        buckets.append((mix(h[whole]) % np.uint64(BUCKETS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _text(host: str, path: str) -> str:
    return f"^{host}\x01{path}$"


def _split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:end]


def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 1000, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularized logistic regression by full gradient steps."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    rows, buckets = features(pa.array([_text(*_split(u)) for u, _ in labelled]))
    y = np.array([label for _, label in labelled], float)
    used, place = np.unique(buckets, return_inverse=True)
    x = np.zeros((len(y), len(used)))
    np.add.at(x, (rows, place), 1.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        error = 1.0 / (1.0 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + decay * w)
        b -= rate * error.mean()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, b


def scores(texts: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Probability of ``block`` per text."""
    n = len(texts)
    rows, buckets = features(texts)
    if len(rows) == 0:
        return np.full(n, 1.0 / (1.0 + np.exp(-intercept)))
    # the norm of a row's counts: counts per (row, bucket) by sorting the pairs
    pairs, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
    norm = np.sqrt(np.bincount(pairs // BUCKETS, weights=counts.astype(float) ** 2, minlength=n))
    total = np.bincount(rows, weights=weights[buckets], minlength=n)
    return 1.0 / (1.0 + np.exp(-(total / np.maximum(norm, 1e-12) + intercept)))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the model's score for ``block``.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and the verdict is that of the model on
    the empty text. Repeated rows and repeated ids are judged one by one; other columns are not read. An empty table gives no rows.
    """
    weights, intercept = train(labelled)
    url = F.col(f"`{url_col}`")
    named = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            text = pc.binary_join_element_wise(pa.scalar("^", host.type), host, pa.scalar("\x01", host.type), path, pa.scalar("$", host.type), pa.scalar("", host.type))
            p = scores(text, weights, intercept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    kind = named.schema["page_id"].dataType.simpleString()
    scored = named.mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    return scored.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
