"""Elements that arrive page by page: the running heading and offset are kept as a document's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "document_id string, element_index int, type string, text string, section_title string, char_start bigint"


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    title, offset = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values("element_index", ignore_index=True)
    above = rows["text"].where(rows["type"] == "heading").ffill().astype(object)
    above = above.where(above.notna(), title)
    body = rows[rows["type"] != "heading"]
    sizes = body["text"].str.len().fillna(0).astype("int64") + 1
    out = body.assign(document_id=key[0], section_title=above[body.index], char_start=offset + sizes.cumsum() - sizes)
    state.update((above.iloc[-1] if len(above) else title, int(offset + sizes.sum())))
    yield out[[c.split()[0] for c in _OUT.split(", ")]]


def carried(elements: DataFrame) -> DataFrame:
    """Body elements of a stream (document_id, element_index, type, text) with ``section_title`` and ``char_start``, as
    the batch operators give them. A document's pages must come in order; within a micro-batch any order will do."""
    rows = elements.select("document_id", "element_index", "type", "text")
    return rows.groupBy("document_id").applyInPandasWithState(_carry, _OUT, "title string, offset bigint", "append", GroupStateTimeout.NoTimeout)


def ingest_pages(elements: DataFrame, path: str, checkpoint: str):
    """The incremental sink: body elements of a stream of pages appended to a table as they come, each micro-batch durable before
    the next. Runs until what is there has been read; the query is returned."""
    return carried(elements).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
