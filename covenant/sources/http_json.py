"""JSON over HTTP as a data source: spark.read.format("http_json").option("urls", ...).load().

Rows are url, status, body. A task fetches the URLs of its partition one after another, with a pause before each; answers
that ask to come again later (429, 5xx) and broken connections are tried again with growing waits. What still fails is an
error, or with onError=keep a row with its status and no body.
"""

from __future__ import annotations

import gzip
import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = frozenset({429, 500, 502, 503, 504})
DEFAULTS = {"pause": "0.2", "timeout": "60", "retries": "5", "backoff": "0.5", "partitions": "1", "agent": "covenant", "onerror": "fail"}


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpJsonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return HttpJsonReader(self.options)


class HttpJsonReader(DataSourceReader):
    def __init__(self, options):
        given = {k.lower(): v for k, v in dict(options).items()}
        if "urls" not in given:
            raise ValueError("option urls: a JSON list of what to fetch")
        self.urls = json.loads(given["urls"])
        self.options = DEFAULTS | {k: v for k, v in given.items() if k in DEFAULTS}

    def partitions(self) -> list[InputPartition]:
        """URLs dealt out in turn: as many partitions fetch at once, so keep to what a server allows."""
        n = max(1, min(int(self.options["partitions"]), len(self.urls)))
        return [Urls(self.urls[k::n]) for k in range(n)]

    def read(self, partition: Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield (url, *fetched(url, self.options))


def fetched(url: str, options: dict[str, str]) -> tuple[int, str | None]:
    """Status and body of a URL after as many attempts as it takes and is allowed."""
    request = urllib.request.Request(url, headers={"User-Agent": options["agent"], "Accept-Encoding": "gzip"})
    status, why = 0, ""
    for attempt in range(int(options["retries"]) + 1):
        time.sleep(float(options["pause"]) if not attempt else float(options["backoff"]) * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(request, timeout=float(options["timeout"])) as answer:
                body = answer.read()
                return answer.status, (gzip.decompress(body) if answer.headers.get("Content-Encoding") == "gzip" else body).decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            status, why = error.code, str(error)
            if status not in AGAIN:
                break
        except (urllib.error.URLError, OSError, http.client.HTTPException) as error:
            status, why = 0, str(error)
    if options["onerror"] == "keep":
        return status, None
    raise OSError(f"{url}: {why}")


def read(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    """url, status, body of each URL."""
    spark.dataSource.register(HttpJsonSource)
    reader = spark.read.format("http_json").option("urls", json.dumps(urls))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
