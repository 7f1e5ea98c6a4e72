"""Outside services behind small interfaces, with offline stand-ins, and a Spark data source over page providers."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.vectors import unit
from corvane.operators import build
from corvane.sources.durable import durable


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Pages(Protocol):
    def html(self, page: str) -> str: ...

    def wikitext(self, title: str) -> tuple[str, str] | None: ...

    def summaries(self, titles: list[str]) -> dict: ...


#: When a process last called each service.
_called: dict[str, float] = {}


class Polite:
    """Calls of a service with at least ``spacing`` seconds between two of a process, repeated after a failed one up to
    ``tries`` times in all, the wait doubling from ``wait`` to ``most`` seconds. A LookupError (no such page) isn't
    repeated."""

    def __init__(self, service: str = "pages", spacing: float = 0.1, tries: int = 4, wait: float = 1.0, most: float = 10.0, sleep=time.sleep, clock=time.monotonic):
        self.service, self.spacing, self.tries, self.wait, self.most, self.sleep, self.clock = service, spacing, tries, wait, most, sleep, clock

    def __call__(self, call, *args):
        for n in range(1, self.tries + 1):
            early = _called.get(self.service, -1e9) + self.spacing - self.clock()
            if early > 0:
                self.sleep(early)
            _called[self.service] = self.clock()
            try:
                return call(*args)
            except LookupError:
                raise
            except OSError:
                if n == self.tries:
                    raise
                self.sleep(min(self.most, self.wait * 2 ** (n - 1)))


class HashEmbedder:
    """Deterministic vectors from the md5 of words, for tests and offline runs: the first 8 hex digits give the place,
    the ninth the sign (under 8: plus)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % self.dim] += 1 if int(h[8], 16) < 8 else -1
        return out.tolist()


class FolderPages:
    """Pages kept in a dict, as a stand-in for a wiki."""

    def __init__(self, html: dict[str, str] | None = None, wikitext: dict[str, str] | None = None, redirects: dict[str, str] | None = None):
        self._html, self._text, self._redirects = html or {}, wikitext or {}, redirects or {}

    def html(self, page: str) -> str:
        if page not in self._html:
            raise LookupError(f"no page {page!r}")
        return self._html[page]

    def wikitext(self, title: str) -> tuple[str, str] | None:
        for _ in range(8):
            if title in self._text:
                return title, self._text[title]
            if title not in self._redirects:
                return None
            title = self._redirects[title]
        return None


def fetch_summaries(titles: DataFrame, provider: Pages, batch: int = 20, polite: Polite | None = None) -> DataFrame:
    """(title, page_title, pageid, extract, url) of the pages that ``titles`` (title) name, ``batch`` titles a call. A
    reply has "normalized" and "redirects", lists of (from, to), and "pages", a list of (page_title, pageid, extract,
    url); titles are followed through both, and those of missing pages are dropped, as are those of a call that fails,
    which come up again in the next run."""
    polite = polite or Polite()

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch):
                try:
                    got = polite(provider.summaries, b.column(0).slice(k, batch).to_pylist())
                except OSError:
                    continue
                rows = [(kind, f, t, None, None, None) for kind in ("normalized", "redirects") for f, t in got.get(kind, [])]
                rows += [("pages", t, None, i, x, u) for t, i, x, u in got.get("pages", [])]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "from", "to", "pageid", "extract", "url"])

    asked = titles.select("title").where("title is not null").distinct()
    got = durable(asked.mapInArrow(run, "kind string, from string, to string, pageid long, extract string, url string"), "summaries")
    hops = {k: got.where(F.col("kind") == k).select("from", "to").distinct() for k in ("normalized", "redirects")}
    pages = got.where("kind = 'pages'").select(F.col("from").alias("page_title"), "pageid", "extract", "url").dropDuplicates(["page_title"])
    return build.resolve_aliases(asked, hops["normalized"], hops["redirects"], pages.withColumn("canonical", F.col("page_title"))).drop("page_title").withColumnRenamed("canonical", "page_title").select("title", "page_title", "pageid", "extract", "url")


def embed(texts: DataFrame, embedder: Embedder, batch: int = 96) -> DataFrame:
    """``texts`` (id, text) -> (id, embedding): unit vectors, ``batch`` texts a call. A batch whose call fails is
    left out and comes up again in the next incremental run."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                try:
                    v = unit(np.asarray(embedder.embed([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64)).astype(np.float32)
                except Exception:  # noqa: BLE001
                    continue
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, "id long, embedding array<float>")


def page_source(provider: Pages, name: str = "corpus_pages") -> type[DataSource]:
    """A data source to register: ``spark.read.format(name).option("pages", "A|B")`` gives (title, html, error).
    One partition a page, so a slow or failing page holds up or costs no other."""

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "title string, html string, error string"

        def reader(self, schema):
            return _PageReader([p for p in self.options.get("pages", "").split("|") if p], provider)

    return PageSource


class _PageReader(DataSourceReader):
    def __init__(self, pages: list[str], provider: Pages, polite: Polite | None = None):
        self.pages, self.provider, self.polite = pages, provider, polite or Polite()

    def partitions(self):
        return [InputPartition(p) for p in self.pages]

    def read(self, partition):
        try:
            yield partition.value, self.polite(self.provider.html, partition.value), None
        except (LookupError, OSError) as e:
            yield partition.value, None, str(e)
