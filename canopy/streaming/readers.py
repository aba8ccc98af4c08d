"""Streaming sources: records of XML files, subtrees, and chunks pushed by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.sinks.serialize import serialize
from canopy.sources.xml import Options, parse


def stream_records(spark: SparkSession, path: str, row_tag: str, schema: str, **options: str) -> DataFrame:
    """Streaming rows of the elements named row_tag; memory is bounded by a record."""
    return spark.readStream.format("xml").schema(schema).option("rowTag", row_tag).options(**options).load(path)


def subtrees(df: DataFrame, id_col: str, text_col: str, depth: int | None = None, path: str | None = None, when=None) -> DataFrame:
    """(doc_id, seq, path, xml) of the subtrees at a depth, at a root-anchored path, or where ``when(names of the ancestor chain)`` holds. Works on batch and streaming tables."""

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                stack = [(c, [c.name]) for c in parse(text.as_py(), Options()).document.elements()[::-1]]
                n = 0
                while stack:
                    node, chain = stack.pop()
                    here = "/" + "/".join(chain)
                    if depth is not None and len(chain) == depth or path is not None and here == path or when is not None and when(chain):
                        rows.append((key.as_py(), n, here, serialize(node)))
                        n += 1
                        continue
                    stack += [(c, [*chain, c.name]) for c in node.elements()[::-1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "seq", "path", "xml"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(emit, "doc_id long, seq int, path string, xml string")


class PushParser(StatefulProcessor):
    """Collects chunks of a document by key and emits its statistics when the document is complete; state is the text so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text = self.buffer.get()[0] if self.buffer.exists() else ""
        for frame in rows:
            for chunk in frame.sort_values("seq")["chunk"]:
                text += chunk
        parsed = parse(text)
        if parsed.errors:
            self.buffer.update((text,))
            return
        self.buffer.clear()
        elements = sum(n.kind == "element" for n in parsed.document.descendants())
        yield pd.DataFrame({"doc_id": [key[0]], "elements": [elements], "xml": [text]})

    def close(self) -> None:
        pass


def push_parse(chunks: DataFrame) -> DataFrame:
    """Streaming (doc_id, seq, chunk) to (doc_id, elements, xml) of every document once its chunks make it well-formed."""
    return chunks.groupBy("doc_id").transformWithStateInPandas(PushParser(), "doc_id long, elements long, xml string", "Append", "None")
