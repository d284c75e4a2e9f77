"""An extension beyond the batch engine: a stream of sections keeps the vector cache filled, batch by batch.

Each micro-batch chunks its sections, embeds the contents that the cache lacks and appends them; a batch that is run again
after a failure finds its own vectors there, so nothing is embedded twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftstone.config import EngineConfig
from siftstone.operators import chunk, embed
from siftstone.operators.index import fill_cache


def keep_cache_filled(sections: DataFrame, config: EngineConfig, cache: str, checkpoint: str, make: Callable[[], embed.Embedder] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream over ``sections`` (source, page, title, text)."""
    dim, unit = config.embed_dim, config.embed_normalize
    make = make or (lambda: embed.HashingEmbedder(dim, unit))

    def one(batch: DataFrame, number: int) -> None:
        fill_cache(batch.sparkSession, chunk.build_chunks(batch, config), config, make, cache)

    return sections.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
