"""Fetching pages and asking services, through clients that the caller supplies.

A client is a plain function; nothing here opens a connection itself. Calls run in the tasks of an
Arrow-batched operator, with the urls of one domain in one task, so that its requests are spaced.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.functions import constants as K
from quellwerk.functions import text as X
from quellwerk.operators.answers import Node, Selector, Tree
from quellwerk.operators.records import labels_by_index

# --- fixed values ------------------------------------------------------------------------------
#: Error classes that a browser may get past, and statuses of an enrichment call.
BROWSER_CLASSES = ("js_challenge", "forbidden", "rate_limited", "timeout")
SUCCESS, NO_DATA, ODD_DATA, NO_NETWORK = "成功", "无数据", "格式异常", "网络异常"
BODY_CHARS, SNIPPET_CHARS, FALLBACK_CHARS = 2048, 512, 50_000
# -----------------------------------------------------------------------------------------------

RESULT_SCHEMA = "url string, final_url string, status_code int, title string, fetched_html string, fetch_error string, error_class string, body_snippet string, attempts int"
_NAMES = [f.split(" ")[0] for f in RESULT_SCHEMA.split(", ")]


@dataclass
class Response:
    status: int
    body: str
    final_url: str = ""


def is_block_page(body: str) -> bool:
    """T27."""
    head = body[:4096].lower()
    return any(sign in head for sign in K.BLOCK_PAGE_SIGNS)


def classify(error: str, status: int | None, body: str) -> str:
    """T26 for one result; functions.text.error_class is the same for columns."""
    low = error.lower()
    named = next((label for signs, label in K.EXCEPTION_RULES if any(s in low for s in signs)), None) if error else None
    by_status = {403: "forbidden", 404: "not_found", 429: "rate_limited"}.get(status or 0) or ("server_error" if (status or 0) >= 500 else None)
    return named or by_status or ("js_challenge" if is_block_page(body) else "unknown" if error else "")


def main_content(html: str, fallback: int = FALLBACK_CHARS) -> tuple[str, str]:
    """Title and the markup of the element whose own paragraphs hold most text; the first
    characters of the page if none does."""
    root = Tree(html).root
    title = Selector("title").first(root)
    score: dict[int, tuple[int, Node]] = {}
    for p in Selector("p").all(root):
        text = p.text()
        if p.parent is not None and len(text) >= 25:
            n, _ = score.get(id(p.parent), (0, p.parent))
            score[id(p.parent)] = (n + len(text) + 10 * text.count(","), p.parent)
    best = max(score.values(), key=lambda s: s[0], default=None)
    return (title.text() if title else "", best[1].inner() if best and best[1].tag else html[:fallback])


def backoff(attempt: int, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds to wait after an attempt: doubled each time up to 30, with jitter of up to half."""
    base = min(2.0**attempt, 30.0)
    return base + draw(0, base / 2)


@dataclass
class Fetcher:
    """Fetches a url with retries, then by browser where that may help."""

    client: Callable[[str], Response]
    browser: Callable[[str], Response] | None = None
    retries: int = 2
    spacing: float = 0.0  # seconds between requests of one domain
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    extract: Callable[[str], tuple[str, str]] = main_content
    next_at: dict[str, float] = field(default_factory=dict)

    def wait(self, url: str) -> None:
        """Reserves the domain's next slot, then sleeps until it comes."""
        domain, now = urlsplit(url).netloc.lower(), self.clock()
        at = max(now, self.next_at.get(domain, now))
        self.next_at[domain] = at + self.spacing
        if at > now:
            self.sleep(at - now)

    def _once(self, call: Callable[[str], Response], url: str) -> dict[str, Any]:
        self.wait(url)
        try:
            got = call(url)
        except Exception as e:  # noqa: BLE001  a failed request is a result
            text = f"{type(e).__name__}: {e}"
            return {"final_url": "", "status_code": None, "title": "", "fetched_html": "", "fetch_error": text, "error_class": classify(text, None, ""), "body_snippet": ""}
        body = got.body or ""
        kind = classify("", got.status, body)
        out = {"final_url": got.final_url or url, "status_code": got.status, "title": "", "fetched_html": "", "fetch_error": "", "error_class": kind, "body_snippet": body[:BODY_CHARS] if kind else ""}
        if kind:
            return out | {"fetch_error": f"HTTP {got.status}" if got.status >= 400 else kind}
        title, html = self.extract(body)
        return out | {"title": title, "fetched_html": html}

    def fetch(self, url: str) -> dict[str, Any]:
        for attempt in range(self.retries + 1):
            got = self._once(self.client, url)
            if not got["error_class"]:
                break
            if attempt < self.retries:
                self.sleep(backoff(attempt))
        tried = attempt + 1
        if self.browser and got["error_class"] in BROWSER_CLASSES:
            seen = self._once(self.browser, url)
            tried += 1
            got = seen if not seen["error_class"] else got | {"error_class": "browser_error" if seen["status_code"] is None else got["error_class"]}
        return {"url": url, **got, "attempts": tried}


def fetch_urls(urls: DataFrame, fetcher: Fetcher, tasks: int | None = None) -> DataFrame:
    """RESULT_SCHEMA rows for the distinct urls. A domain's urls share a task, which is what bounds
    the rate of requests to it."""
    wanted = urls.select("url").filter("coalesce(url, '') <> ''").distinct().withColumn("_d", X.netloc(F.col("url")))
    spread = wanted.repartition(tasks, "_d") if tasks else wanted.repartition("_d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [fetcher.fetch(u) for u in batch["url"]]
            out = pd.DataFrame(rows, columns=_NAMES)
            out["status_code"] = out["status_code"].astype("Int32")
            yield out

    return spread.select("url").mapInPandas(run, RESULT_SCHEMA)


def failure_log(results: DataFrame, cited_by: DataFrame, when: str | None = None) -> DataFrame:
    """The failures with the files that cite them (url, source_files)."""
    now = when or datetime.now(UTC).isoformat()
    failed = results.filter("error_class <> ''").join(cited_by, "url", "left")
    files = F.coalesce("source_files", F.array().cast("array<string>"))
    return failed.select("url", "error_class", "fetch_error", "status_code", X.clip(F.col("body_snippet"), SNIPPET_CHARS).alias("body_snippet"), "attempts", files.alias("source_files"), F.lit(now).alias("timestamp"))


def backfill_citations(records: DataFrame, fresh: DataFrame, key: str = "source_file") -> DataFrame:
    """Records whose failed citations take the fresh result of their url, if that is not
    itself a failure; everything else stays. key names a record."""
    ok = fresh.filter("error_class = ''").select(F.col("url").alias("_u"), F.struct(*[F.col(n) for n in _NAMES if n != "url"]).alias("_f"))
    names = records.schema["citations"].dataType.elementType.names
    new = [n for n in _NAMES if n in names and n != "url"]
    rows = records.select(key, F.posexplode("citations").alias("_at", "_c")).join(ok, (F.col("_c.url") == F.col("_u")) & (F.coalesce(F.col("_c.fetch_error"), F.lit("")) != ""), "left")
    value = lambda n: F.when(F.col("_u").isNotNull(), F.col(f"_f.{n}")).otherwise(F.col(f"_c.{n}")) if n in new else F.col(f"_c.{n}")
    made = rows.select(key, "_at", F.struct(*[value(n).alias(n) for n in names]).alias("_c"))
    lists = made.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda x: x["_c"]).alias("_made"))
    joined = records.join(lists, key, "left")
    return joined.withColumn("citations", F.coalesce("_made", "citations")).select(*records.columns)


def retry_failures(failures: DataFrame, fetcher: Fetcher, when: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, failures that remain) of fetching every failed url once more; what remains
    keeps the time of the failure before."""
    results = fetch_urls(failures.select("url"), fetcher)
    latest = failures.groupBy("url").agg(F.flatten(F.collect_list("source_files")).alias("source_files"), F.max("timestamp").alias("prev_timestamp"))
    cited = latest.select("url", F.array_sort(F.array_distinct("source_files")).alias("source_files"))
    return results, failure_log(results, cited, when).join(latest.select("url", "prev_timestamp"), "url", "left")


# --- services ----------------------------------------------------------------------------------


def enrich(keys: DataFrame, key: str, client: Callable[[str], dict[str, Any] | None], fields: list[str], missing: str = "null", pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, status, fields) for the distinct keys, as texts; missing stands for what a client
    does not give, and the status says why."""

    def one(value: str) -> list[str]:
        try:
            found = client(value)
        except Exception:  # noqa: BLE001  a failed call is a result
            return [value, NO_NETWORK] + [missing] * len(fields)
        finally:
            if pause:
                sleep(pause)
        if not found:
            return [value, NO_DATA] + [missing] * len(fields)
        if not isinstance(found, dict):
            return [value, ODD_DATA] + [missing] * len(fields)
        return [value, SUCCESS] + [" ".join(str(found[f]).split("\n")) if found.get(f) else missing for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(v) for v in batch[key]], columns=[key, "status", *fields])

    schema = ", ".join(f"`{c}` string" for c in [key, "status", *fields])
    return keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, schema)


def merged_clients(*clients: Callable[[str], dict[str, Any] | None]) -> Callable[[str], dict[str, Any]]:
    """One client of several endpoints; the earlier ones win, and one that fails adds nothing."""

    def both(value: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for client in clients:
            try:
                out = (client(value) or {}) | out
            except Exception:  # noqa: BLE001
                continue
        return out

    return both


def yesterday(today: date | None = None) -> str:
    """The day that authority figures are asked for."""
    return ((today or datetime.now(UTC).date()) - timedelta(days=1)).isoformat()


def site_types(domains: DataFrame, client: Callable[[str], str | None], allowed: list[str] = K.SITE_TYPES) -> DataFrame:
    """(domain, site_type): a classifier's one word, or 'null'."""

    def one(value: str) -> str:
        try:
            word = (client(value) or "").strip()
        except Exception:  # noqa: BLE001
            return "null"
        return word if word in allowed else "null"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "site_type": [one(d) for d in batch["domain"]]})

    return domains.select("domain").filter("domain is not null").distinct().mapInPandas(run, "domain string, site_type string")


def label_citations(prompts: DataFrame, keys: list[str], client: Callable[[str], str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The labels (keys, citation_index, llm_...) that the client's replies hold; a record
    whose calls all fail has none."""

    def ask(prompt: str) -> str:
        for attempt in range(attempts):
            try:
                return client(prompt)
            except Exception:  # noqa: BLE001
                if attempt < attempts - 1:
                    sleep(2.0 ** (attempt + 1))
        return "[]"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["json"] = [ask(p) for p in batch["prompt"]]
            yield batch[[*keys, "json"]]

    schema = ", ".join(f"`{k}` {dict(prompts.dtypes)[k]}" for k in keys) + ", json string"
    return labels_by_index(prompts.select(*keys, "prompt").mapInPandas(run, schema), keys, "json")


def poll(status: Callable[[], str], done: tuple[str, ...] = ("completed",), failed: tuple[str, ...] = ("failed", "cancelled"), every: float = 5.0, most: int | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """Asks for a job's state until it ends."""
    asked = 0
    while True:
        now = status()
        asked += 1
        if now in done:
            return now
        if now in failed or (most is not None and asked >= most):
            raise RuntimeError(f"job ended as {now!r} after {asked} calls")
        sleep(every)


def download(chunks: Iterable[bytes], path: str) -> int:
    """Writes a streamed body piece by piece; the number of bytes."""
    written = 0
    with open(path, "wb") as out:
        for chunk in chunks:
            written += out.write(chunk)
    return written
