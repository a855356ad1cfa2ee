"""An extension beside the batch engine: an index that follows its folder, and replies that arrive as a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.engine import Engine
from quillspark.sources.events import line_events


def follow(engine: Engine, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Refresh the index whenever notes appear or change in the vault; without ``every`` (such as '1 minute') once for all that is new.

    The file stream only tells that there is something new: what changed is found by the manifest, as in a batch refresh, so
    a batch that runs twice changes nothing.  Deletions are seen at the next refresh.
    """
    files = engine.spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(engine.settings.vault_path)

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.refresh()

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def events_of(lines: DataFrame, seq: str = "seq", line: str = "line") -> DataFrame:
    """A stream of reply lines (seq, line) as a stream of events, as sources.events.events() has them for tables."""
    return lines.select(seq, F.posexplode(line_events(F.col(line), F.col(seq))).alias("pos", "event")).select(seq, "pos", "event.*")
