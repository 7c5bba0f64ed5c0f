"""Paper metadata: Atom feeds, manifests, files and their digests, and a polite fetcher."""

from __future__ import annotations

import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import datetime, timezone
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.text import collapse, strip

PAPERS = "id string, title string, authors array<string>, abstract string, categories array<string>, published_at date, pdf_url string"
_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "category array<struct<_term:string>>, link array<struct<_href:string,_title:string,_rel:string>>"
)
PDF_URL = "https://arxiv.org/pdf/"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as papers. Entries without id, title, summary or published date go."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(_ENTRY).load(path)
    own = F.regexp_extract("id", r".*/abs/(.+)$", 1)
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    rows = raw.select(
        strip(own).alias("id"), collapse(F.col("title")).alias("title"), F.transform("author", lambda a: collapse(a["name"])).alias("authors"), collapse(F.col("summary")).alias("abstract"),
        F.transform("category", lambda c: c["_term"]).alias("categories"), F.to_date(F.to_timestamp("published")).alias("published_at"), pdf.alias("_pdf"),
    )
    rows = rows.where("id <> '' and title is not null and abstract is not null and published_at is not null")
    empty = F.array().cast("array<string>")
    return rows.select("id", "title", F.coalesce("authors", empty).alias("authors"), "abstract", F.coalesce("categories", empty).alias("categories"), "published_at", F.coalesce("_pdf", F.concat(F.lit(PDF_URL), "id")).alias("pdf_url"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a manifest: one a line, # begins a comment."""
    return spark.read.text(path).select(strip(F.substring_index("value", "#", 1)).alias("id")).where("id <> ''")


def manifest_lines(papers: DataFrame) -> DataFrame:
    """(id, line) of a manifest, newest first."""
    line = F.concat(F.col("id"), F.lit("  # "), F.substring("title", 1, 90))
    return papers.orderBy(F.desc("published_at"), F.desc("id")).select("id", line.alias("line"))


def write_manifest(papers: DataFrame, path: str, comments: tuple[str, ...] = ()) -> None:
    """One text file, ordered, after its comments: a listing for people, of one line a paper."""
    spark = papers.sparkSession
    head = spark.createDataFrame([(i, f"# {c}") for i, c in enumerate(comments)], "n long, value string")
    body = papers.select(F.lit(len(comments)).cast("long").alias("n"), F.concat(F.col("id"), F.lit("  # "), F.substring("title", 1, 90)).alias("value"), "published_at", "id")
    both = head.withColumns({"published_at": F.lit(None).cast("date"), "id": F.lit(None).cast("string")}).unionByName(body)
    # All columns but a line's are gone by now; the exchange keeps upstream work out of the one task that orders them.
    both.repartition(1).sortWithinPartitions("n", F.desc("published_at"), F.desc("id")).select("value").write.mode("overwrite").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


class Fetcher:
    """GET on the driver, requests at least interval seconds apart, up to attempts tries for 429, 5xx and transport errors."""

    def __init__(self, interval: float = 3.0, attempts: int = 5, get: Callable[[str], bytes] | None = None, sleep=time.sleep, clock=time.monotonic):
        self.interval, self.attempts, self._get, self._sleep, self._clock, self._last = interval, attempts, get or self._open, sleep, clock, None

    @staticmethod
    def _open(url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return answer.read()

    def get(self, url: str) -> bytes:
        for attempt in range(1, self.attempts + 1):
            if self._last is not None and (wait := self._last + self.interval - self._clock()) > 0:
                self._sleep(wait)
            self._last = self._clock()
            try:
                return self._get(url)
            except urllib.error.HTTPError as error:
                if error.code != 429 and error.code < 500 or attempt == self.attempts:
                    raise
            except OSError:
                if attempt == self.attempts:
                    raise
            self._sleep(3 * 2 ** (attempt - 1))
        raise AssertionError

    def to_file(self, url: str, path: str) -> str:
        """Keep url's content at path unless a file with content is there; whole or not at all."""
        if not (os.path.exists(path) and os.path.getsize(path)):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(f"{path}.part", "wb") as file:
                file.write(self.get(url))
            os.replace(f"{path}.part", path)
        return path

    def by_ids(self, ids: list[str], parse: Callable[[bytes], list[dict]] | None = None, page: int = 100, base: str = "https://export.arxiv.org/api/query") -> list[dict]:
        """Entries of explicit ids, asked for page at a time, in the order of the ids, each once; a bare id finds the entry of its latest version."""
        found: dict[str, dict] = {}
        for at in range(0, len(ids), page):
            asked = urllib.parse.urlencode({"id_list": ",".join(ids[at : at + page]), "max_results": page})
            for e in (parse or parse_atom)(self.get(f"{base}?{asked}")):
                found.setdefault(e["id"], e)
        number = lambda i: int(m[1]) if (m := re.search(r"v(\d+)$", i)) else -1
        bare: dict[str, str] = {}
        for i in sorted(found, key=number):
            bare[re.sub(r"v\d+$", "", i)] = i
        wanted = dict.fromkeys(i if i in found else bare.get(i) for i in ids)
        return [found[i] for i in wanted if i]

    def search(self, categories: list[str], limit: int, parse: Callable[[bytes], list[dict]] | None = None, page: int = 100, base: str = "https://export.arxiv.org/api/query") -> list[dict]:
        """Newest entries of any of the categories, each id once, until limit or a page without entries."""
        found: dict[str, dict] = {}
        query = " OR ".join(f"cat:{c}" for c in categories)
        while len(found) < limit:
            asked = urllib.parse.urlencode({"search_query": query, "sortBy": "submittedDate", "sortOrder": "descending", "start": len(found), "max_results": min(page, limit - len(found))})
            entries = (parse or parse_atom)(self.get(f"{base}?{asked}"))
            before = len(found)
            for e in entries:
                found.setdefault(e["id"], e)
            if not entries or len(found) == before:
                break
        return list(found.values())[:limit]


_ATOM = "{http://www.w3.org/2005/Atom}"


def parse_atom(answer: bytes) -> list[dict]:
    """Entries of an Atom answer as papers, by the rules of read_atom()."""
    out = []
    squeeze = lambda t: " ".join((t or "").split())
    for entry in ElementTree.fromstring(answer).iter(f"{_ATOM}entry"):
        text = lambda name: entry.findtext(f"{_ATOM}{name}")  # noqa: B023, E731
        own = (text("id") or "").rpartition("/abs/")[2].strip() if "/abs/" in (text("id") or "") else ""
        if not own or any(text(c) is None for c in ("title", "summary", "published")):
            continue
        pdf = next((link.get("href") for link in entry.iter(f"{_ATOM}link") if link.get("title") == "pdf"), None)
        out.append({
            "id": own, "title": squeeze(text("title")), "authors": [squeeze(a.findtext(f"{_ATOM}name")) for a in entry.iter(f"{_ATOM}author")], "abstract": squeeze(text("summary")),
            "categories": [c.get("term") for c in entry.iter(f"{_ATOM}category")], "published_at": datetime.fromisoformat(text("published").strip().replace("Z", "+00:00")).astimezone(timezone.utc).date(), "pdf_url": pdf or f"{PDF_URL}{own}",
        })
    return out


def corpus(papers: DataFrame, files: DataFrame) -> DataFrame:
    """papers with the path and digest (pdf_sha256) of their file, null without one: a paper whose file can't be had is a row still. files: as of read_files()."""
    own = files.select("path", F.col("sha256").alias("pdf_sha256"), F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"))
    name = F.concat(F.replace("id", F.lit("/"), F.lit("_")), F.lit(".pdf"))
    return papers.withColumn("_name", name).join(own, "_name", "left").drop("_name")


def file_name(paper_id: str) -> str:
    return paper_id.replace("/", "_") + ".pdf"
