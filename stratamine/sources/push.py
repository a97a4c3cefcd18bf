"""A source that is pushed to: a feed of texts with their language, filtered by words and languages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Gives the (text, lang) pairs from a position on that are there now, as many as fit a batch, and the position after them.
Feed = Callable[[int], tuple[Iterable[tuple[str, str]], int]]


def keeps(text: str | None, lang: str | None, track: list[str], languages: list[str]) -> bool:
    """Whether one of the words occurs in a text, in any case, and its language is one of those; no words or no
    languages: any will do. A null text has no word."""
    low = (text or "").lower()
    return (not track or any(w in low for w in track)) and (not languages or lang in languages)


class FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, feed: Feed, track: list[str], languages: list[str]):
        self.feed, self.track, self.languages = feed, track, languages

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _kept(self, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        return iter([r for r in rows if keeps(*r, self.track, self.languages)])

    def read(self, start: dict) -> tuple[Iterator[tuple[str, str]], dict]:
        rows, end = self.feed(start["at"])
        return self._kept(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, str]]:
        """The same rows anew, after a failure; the feed must still have them."""
        out, at = [], start["at"]
        while at < end["at"]:
            rows, after = self.feed(at)
            rows = list(rows)[: end["at"] - at]
            if after <= at:
                break
            out, at = out + rows, after
        return self._kept(out)


def pushed(spark: SparkSession, feed: Feed, track: list[str] = (), languages: list[str] = ()) -> DataFrame:
    """A stream of text and lang from a feed, of which a position is the number of pairs before it."""
    words, tongues = [w.lower() for w in track], list(languages)

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "feed"

        def schema(self) -> str:
            return "text string, lang string"

        def simpleStreamReader(self, schema) -> FeedReader:
            return FeedReader(feed, words, tongues)

    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feed").load()
