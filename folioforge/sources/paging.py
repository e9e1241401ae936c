"""Services that answer in pages, as a streaming source: an offset is the token of the next page, how many pages there were, and the
date from which to ask again when a list has ended. A checkpoint therefore resumes in the middle of a list.

The driver follows the tokens (a page is asked for its token, and nothing of it is kept but a sum of hashes of the latest date's records,
by which a list that has ended is known to be unchanged); tasks fetch the pages, one each or, of many, runs of them one after
the other, so only executors hold their rows. A page that is fetched again after a failure gives the same rows as long as the service does.
"""

from __future__ import annotations

import hashlib
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .readers import OAI_RECORD, oai_rows

_TOKEN = re.compile(r"<resumptionToken[^>]*>\s*([^<\s][^<]*?)\s*</resumptionToken>")
_RECORD = re.compile(r"<record[\s>].*?</record>", re.S)
_DATE = re.compile(r"<datestamp>\s*(\d{4}-\d\d-\d\d)")
SCHEMA = "page bigint, token string, payload string"
#: Tasks of a micro-batch at most; pages of a growing one at most.
MOST_TASKS, MOST_PAGES = 96, 16_384


@dataclass(frozen=True)
class OaiPages:
    """A repository of the harvesting protocol. Answers that tell to wait, and failures, are tried again after growing pauses."""

    url: str
    prefix: str = "arXiv"
    of_set: str = ""
    attempts: int = 5
    pause: float = 2.0
    timeout: float = 60.0

    def fetch(self, token: str, since: str) -> str:
        ask = {"verb": "ListRecords", "resumptionToken": token} if token else {"verb": "ListRecords", "metadataPrefix": self.prefix} | ({"set": self.of_set} if self.of_set else {}) | ({"from": since} if since else {})
        for i in range(self.attempts):
            try:
                with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(ask)}", timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace")
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if i + 1 == self.attempts or isinstance(e, urllib.error.HTTPError) and e.code not in (429, 500, 502, 503, 504):
                    raise
                told = e.headers.get("Retry-After") or "" if isinstance(e, urllib.error.HTTPError) else ""
                time.sleep(float(told) if told.isdigit() else self.pause * 2**i)
        raise ValueError("no attempt was allowed")


@dataclass(frozen=True)
class FolderPages:
    """Pages that were kept: the folder of page ``token`` below root holds one file. The first is ``first``; there's nothing new later."""

    root: str
    first: str = "0"

    def fetch(self, token: str, since: str) -> str:
        from pyarrow import fs

        if not token and since:
            return ""
        store, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root.removeprefix('file:')}")
        files = store.get_file_info(fs.FileSelector(f"{path}/page={token or self.first}"))
        (one,) = (f for f in files if f.is_file and not f.base_name.startswith((".", "_")))
        with store.open_input_stream(one.path) as f:
            return f.read().decode("utf-8")


@dataclass
class Page(InputPartition):
    """A page, and those after it that the same task fetches (each a number, token and date)."""

    number: int
    token: str
    since: str
    more: tuple = ()

    def __init__(self, number: int, token: str, since: str, more: tuple = ()):
        super().__init__((number, token, since, more))
        self.number, self.token, self.since, self.more = number, token, since, more


class PageReader(DataSourceStreamReader):
    def __init__(self, pages, since: str, most: int, growing: bool = False):
        self.pages, self.since, self.most, self.growing, self.at = pages, since, most, growing, None
        self.chain: dict[int, tuple[str, str, dict]] = {}  # of each page: how it is asked for, and the offset behind it

    def initialOffset(self) -> dict:
        return {"page": 0, "token": "", "since": self.since, "latest": self.since, "sum": ""}

    def _read(self, at: dict) -> tuple[str, str, str, str, bool]:
        """How the page at an offset is asked for (token), the next token, and the latest date with the sum of its records' hashes so far."""
        token, text = at["token"], self.pages.fetch(at["token"], at["since"])
        if token and "badResumptionToken" in text:  # the list has expired: it is asked for anew from its date
            token, text = "", self.pages.fetch("", at["since"])
        latest, total = (at["latest"], int(at["sum"] or "0", 16)) if token else (at["since"], 0)
        records = _RECORD.findall(text)
        for r in records:
            date = m[1] if (m := _DATE.search(r)) else ""
            if date > latest:
                latest, total = date, 0
            if date == latest:
                total = (total + int(hashlib.md5(r.encode()).hexdigest(), 16)) % (1 << 128)
        return token, m[1] if records and (m := _TOKEN.search(text)) else "", latest, f"{total:x}", bool(records)

    def _after(self, at: dict) -> dict:
        """The offset behind the page that begins at one; the same page where there's none."""
        token, following, latest, total, any_of = self._read(at)
        if not any_of:
            return at | {"token": ""}
        # Within a list the date it was asked with stays; when it ends the next one is asked from the latest date told.
        after = {"page": at["page"] + 1, "token": following, "since": at["since"] if following else latest, "latest": latest, "sum": total}
        self.chain[at["page"]] = (token, at["since"], after)
        return after

    def _news(self, at: dict) -> bool:
        """Whether the list of the latest date has changed since its end. A date's records are listed again with its later ones."""
        probe = at
        while True:
            _, token, latest, total, any_of = self._read(probe)
            if not any_of and probe is at:
                return False
            probe = probe | {"token": token, "latest": latest, "sum": total}
            if not token:
                return (latest, total) != (at["latest"], at["sum"])

    def latestOffset(self) -> dict:
        self.at = self.at or self.initialOffset()
        if self.at["page"] and not self.at["token"] and not self._news(self.at):
            return self.at
        for _ in range(max(self.most, min(self.at["page"], MOST_PAGES)) if self.growing else self.most):
            after = self._after(self.at)
            if after["page"] == self.at["page"]:
                break
            self.at = after
            if not after["token"]:
                break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = self.at or end  # a query that restarts plans its last batch again
        out, at = [], start
        while at["page"] < end["page"]:
            number = at["page"]
            if number not in self.chain and self._after(at)["page"] == number:  # after a restart the tokens are followed again
                raise RuntimeError(f"page {number} can't be read again")
            token, since, at = self.chain[number]
            out.append((number, token, since))
        run = max(1, -(-len(out) // MOST_TASKS))
        return [Page(*out[i], tuple(out[i + 1 : i + run])) for i in range(0, len(out), run)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for number, token, since in ((partition.number, partition.token, partition.since), *partition.more):
            yield number, token, self.pages.fetch(token, since)

    def commit(self, end: dict) -> None:
        self.chain = {n: t for n, t in self.chain.items() if n >= end["page"]}


def stream(spark: SparkSession, pages, since: str = "", most: int = 16, growing: bool = False) -> DataFrame:
    """page, token, payload of pages (an object with ``fetch(token, since)``, sent to tasks), at most so many a micro-batch.

    growing: a micro-batch may take as many pages as there were before it, so that a store which each one looks up is looked up
    a number of times that grows with the logarithm of the pages, up to MOST_PAGES a micro-batch.

    A query with the trigger availableNow takes one micro-batch; one with a processing time goes on, and asks again for what is
    new at each trigger when a list has ended.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "folio_pages"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> PageReader:
            return PageReader(pages, since, most, growing)

    spark.dataSource.register(Source)
    return spark.readStream.format("folio_pages").load()


def oai_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The records of pages, as ``readers.oai_records`` gives those of files."""
    # A page without its envelope: the records between the first and the last.
    inner = F.regexp_extract(column, r"(?s)(<record[\s>].*</record>)", 1)
    made = F.from_xml(F.concat(F.lit("<page>"), inner, F.lit("</page>")), f"record array<struct<{OAI_RECORD}>>", {"ignoreNamespace": "true"})
    return oai_rows(payloads.filter(F.coalesce(inner, F.lit("")) != "").select(F.explode(made["record"]).alias("r")).select("r.*"))
