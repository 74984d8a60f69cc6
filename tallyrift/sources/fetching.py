"""Scans that ask a server: requests that haven't been answered yet, retries, articles with checked redirects.

The server is a function that is handed in, so that tests and other transports need no network. Answers are landed as a
table, by request; what is parsed is that table.
"""

from __future__ import annotations

import ipaddress
import socket
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.functions.scalars import cut_bytes, safe_to_fetch
from tallyrift.sources.readers import there

#: Redirects that are followed, bytes that are taken, kinds of content that are read.
REDIRECTS, MOST, KINDS = 5, 5 * 1024 * 1024, ("text/html", "text/plain")


def retried(call: Callable, attempts: int = 3, first_wait: float = 1.0, most_wait: float = 30.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` again after an error, each time after twice the wait; the last error is raised."""
    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except errors:
                if n + 1 == attempts:
                    raise
                sleep(min(most_wait, first_wait * 2**n))

    return run


def statistic_requests(spark: SparkSession, families: Sequence[int], years: Sequence[int], measures: Sequence[int] = (2,), group: int | None = None) -> DataFrame:
    """(family, year, measure, group, kinds): one request for each family, year and measure; a group's rate and count are two."""
    f, y, m = (spark.createDataFrame([(v,) for v in x], f"{n} int") for n, x in (("family", families), ("year", years), ("measure", measures)))
    return f.join(y).join(m).withColumns({"group": F.lit(group).cast("int"), "kinds": F.lit("1,2")})


def landed(requests: DataFrame, path: str, ask: Callable[[dict], bytes], key: Sequence[str] = ("family", "year", "measure", "group"), encoding: str = "latin-1", **options) -> DataFrame:
    """The answers (request, html, error) to all requests: those that were landed before, and new ones, which are appended.

    A task asks for its requests one by one; one that fails after its retries has an error in place of an answer and is
    asked again the next time.
    """
    spark, columns = requests.sparkSession, requests.columns
    names = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key))
    todo = requests.withColumn("request", names)
    if there(spark, path):
        todo = todo.join(spark.read.parquet(path).where("error IS NULL").select("request"), "request", "left_anti")
    call = retried(ask, **options)

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                try:
                    out.append((r["request"], call({c: r[c] for c in columns}).decode(encoding), None))
                except Exception as e:  # noqa: BLE001  one request's failure is its own
                    out.append((r["request"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["request", "html", "error"])

    todo.mapInPandas(answers, "request string, html string, error string").write.mode("append").parquet(path)
    return requests.withColumn("request", names).join(spark.read.parquet(path).where("error IS NULL"), "request").drop("error")


def _closed(address: str) -> bool:
    ip = ipaddress.ip_address(address.partition("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not ip.is_global or ip.is_multicast or ip.is_reserved


def safe_address(url: str, resolve: Callable[[str], Sequence[str]] | None = None) -> bool:
    """Whether an address may be fetched now: http or https, no user, and a host all of whose addresses are public.

    ``resolve`` gives a name's addresses, by the system's resolver if it isn't given; a name without any is not safe.
    """
    try:
        parts = urlsplit(url)
        host = parts.hostname
        if parts.scheme not in ("http", "https") or not host or parts.username is not None or parts.password is not None:
            return False
        found = resolve(host) if resolve else [x[4][0] for x in socket.getaddrinfo(host, None)]
        return bool(found) and not any(map(_closed, found))
    except (OSError, ValueError):
        return False


_ARTICLE = "url string, final_url string, status int, ok boolean, text string"


def articles(rows: DataFrame, get: Callable[[str], tuple[int, dict, bytes]], read: Callable[[str], str], safe: Callable[[str], bool] = safe_address, decode: Callable[[str], str | None] | None = None, url: str = "url") -> DataFrame:
    """(url, final_url, status, ok, text) of each address.

    ``get`` (address) gives status, headers and body without following redirects; ``read`` takes the text out of a page;
    ``safe`` is asked before every address, at the time it is fetched; ``decode`` turns an aggregator's address into the
    article's, or None. What isn't safe, isn't text, is too large or is redirected too often has no text.
    """
    def one(start: str) -> tuple:
        def none(at: str, status: int | None = None) -> tuple:
            return start, at, status, False, ""

        if not safe(start):
            return none(start)
        at = start if decode is None else decode(start)
        if at is None or not safe(at):
            return none(start)
        for _ in range(REDIRECTS + 1):
            status, headers, body = get(at)
            said = {k.lower(): v for k, v in headers.items()}
            if status in (301, 302, 303, 307, 308) and said.get("location"):
                at = urljoin(at, said["location"])
                if not safe(at):
                    return none(at)
                continue
            if not 200 <= status < 300 or not said.get("content-type", "").lower().startswith(KINDS) or len(body) > MOST:
                return none(at, status)
            text = read(body.decode("utf-8", "ignore")) or ""
            return start, at, status, bool(text.strip()), text
        return none(at)

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for u in rows[url]:
                try:
                    out.append(one(u))
                except OSError:  # one article's failure is its own
                    out.append((u, u, None, False, ""))
            frame = pd.DataFrame(out, columns=["url", "final_url", "status", "ok", "text"])
            yield frame.assign(status=frame["status"].astype("Int32"))

    return rows.where(safe_to_fetch(F.col(url))).select(url).mapInPandas(fetched, _ARTICLE)


def article_objects(fetched: DataFrame, most: int = 2 * 1024 * 1024) -> DataFrame:
    """``fetched`` with the text cut to ``most`` bytes, its digest and its length."""
    cut = fetched.withColumn("text", cut_bytes(F.col("text"), most))
    return cut.withColumns({"text_sha256": F.sha2("text", 256), "char_count": F.length("text")})
