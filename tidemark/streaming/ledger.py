"""What a paid classifier has answered, kept so that no title is asked for twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.plans.prefix_sums import positions
from tidemark.plans.scratch import cut

ANSWERS = "news_id long, kind string, interests string, version long, tag_id long, score double, matched boolean"
ITEM = ["kind", "news_id"]
#: (news_id, title) of a call's titles to (news_id, tag_id, score) of those that match.
Classify = Callable[[list[tuple[int, str]]], list[tuple[int, int, float]]]


class Ledger:
    """Answers in folders of a root that any of Spark's file systems holds; a folder counts once it is complete."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _complete(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.root)
        fs = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(top):
            return []
        folders = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("answers-")]
        return [str(p) for p in folders if fs.exists(hadoop.Path(p, "_SUCCESS"))]

    def answers(self) -> DataFrame:
        """All answers: a row for each title and tag, and one without tag for a title that matched none."""
        folders = self._complete()
        if not folders:
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(*folders)

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/answers-{uuid.uuid4().hex}")

    def pending(self, items: DataFrame, interests: str, version: int, again: bool = False) -> DataFrame:
        """Items (kind, news_id, title), one of each, that no answer for these interests and version is about; with again
        also those whose answer matched nothing."""
        known = self.answers().where((F.col("interests") == interests) & (F.col("version") == version))
        known = known.where("matched") if again else known
        first = items.where(F.col("news_id").isNotNull()).groupBy(*ITEM).agg(F.min("title").alias("title"))
        return first.join(known.select(*ITEM).distinct(), ITEM, "left_anti")

    def results(self, tags: DataFrame, interests: str, version: int, least: float = 0.0) -> DataFrame:
        """Active tags (tag_id, status) with their matches (kind, news_id, score), best score of each."""
        rows = self.answers().where((F.col("interests") == interests) & (F.col("version") == version) & F.col("matched") & (F.col("score") >= least))
        best = rows.groupBy(*ITEM, "tag_id").agg(F.max("score").alias("score"))
        return best.join(tags.where("status = 'active'").select("tag_id"), "tag_id", "left_semi")


def _asked(classify: Classify, interests: str, version: int):
    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A call for each group of titles with one number; rows come sorted by it."""
        rest: list[tuple] = []

        def answered(titles: list[tuple]) -> pd.DataFrame:
            kind_of = {news: kind for _, kind, news, _ in titles}
            best: dict[tuple[int, int], float] = {}
            for news, tag, score in classify([(news, title) for _, _, news, title in titles]):
                if news in kind_of:  # an answer for a title that wasn't asked about counts for nothing
                    best[news, tag] = max(best.get((news, tag), 0.0), min(max(float(score), 0.0), 1.0))
            told = {news for news, _ in best}
            rows = [(news, kind_of[news], interests, version, tag, score, True) for (news, tag), score in best.items()]
            rows += [(news, kind, interests, version, None, None, False) for news, kind in kind_of.items() if news not in told]
            frame = pd.DataFrame(rows, columns=["news_id", "kind", "interests", "version", "tag_id", "score", "matched"])
            return frame.astype({"tag_id": "Int64", "score": "Float64"})

        for frame in frames:
            for row in frame[["call", "kind", "news_id", "title"]].itertuples(index=False, name=None):
                if rest and rest[-1][0] != row[0]:
                    yield answered(rest)
                    rest = []
                rest.append(row)
        if rest:
            yield answered(rest)

    return asked


def classify_pending(ledger: Ledger, items: DataFrame, classify: Classify, interests: str, version: int, per_call: int = 200, per_round: int = 50, again: bool = False) -> int:
    """Ask classify, inside tasks, about the items (kind, news_id, title) that are pending, and keep the answers; the number asked.

    Calls have at most per_call titles, all of one kind, in order of kind and id. They are made in rounds of per_round
    calls, each of which is kept before the next begins: a run that dies asks again at most for one round's titles, and
    what was kept is neither asked for nor kept a second time. A task that fails is tried again by Spark and repeats
    its calls; no answer of it was kept. Titles that an answer doesn't mention match nothing.
    """
    pending = cut(ledger.pending(items, interests, version, again), "pending")
    n = pending.count()
    if not n:
        return 0
    placed = positions(pending, [F.col(c) for c in ITEM], "place")
    of_kind = placed.groupBy("kind").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    starts = of_kind.collect()  # one row for each kind of item
    before, calls = 0, {}
    for r in sorted(starts, key=lambda r: r["first"]):
        calls[r["kind"]] = (r["first"], before)
        before += -(-r["n"] // per_call)
    call = F.lit(None).cast("long")
    for kind, (first, base) in calls.items():
        call = F.when(F.col("kind").eqNullSafe(F.lit(kind)), F.lit(base) + F.floor((F.col("place") - first) / per_call)).otherwise(call)
    numbered = cut(placed.withColumn("call", call.cast("long")).drop("place"), "calls")
    for low in range(0, before, per_round):
        some = numbered.where((F.col("call") >= low) & (F.col("call") < low + per_round))
        dealt = some.repartition(min(per_round, before - low), "call").sortWithinPartitions("call", "news_id")
        ledger.add(dealt.mapInPandas(_asked(classify, interests, version), ANSWERS))
    return n


def classifying(stream: DataFrame, root: str, classify: Classify, interests: str, version: int, **how: int) -> DataStreamWriter:
    """A stream of (kind, news_id, title), each batch classified into the ledger at root; a repeated batch asks for nothing kept."""

    def each(batch: DataFrame, number: int) -> None:
        classify_pending(Ledger(batch.sparkSession, root), batch, classify, interests, version, **how)

    return stream.writeStream.foreachBatch(each)
