"""Many strings looked up in all texts at once: sharded Aho-Corasick automata, sent to the tasks behind a check of their bytes.

A text is scanned once for each shard of at most about ``SHARD_BYTES`` of strings, and gives its hits alone; nothing of it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the strings of one automaton, which takes some fifty times as much in a worker.
SHARD_BYTES = 1 << 20


def shards(strings: DataFrame, size: Column, most: int | None = None) -> list[DataFrame]:
    """A list of rows in shards of at most ``most`` bytes on average, dealt by their hash; ``size`` is a row's bytes."""
    total = strings.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-total // (most or SHARD_BYTES)))
    return [strings if parts == 1 else strings.where(F.pmod(F.xxhash64(*strings.columns), F.lit(parts)) == i) for i in range(parts)]


def automaton(strings: list[str]) -> ahocorasick.Automaton:
    """An automaton that gives the number of every string; strings are distinct and not empty."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, s in enumerate(strings):
        out.add_word(s, i)
    out.make_automaton()
    return out


def scan(texts: DataFrame, held: list, prepare: Callable[[list], tuple[list[str], object]], found: Callable[[object, ahocorasick.Automaton, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``found`` of every batch of texts: ``prepare(held)`` gives, once a task, the strings of the automaton and what else it needs."""
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, state = prepare(sent.value)
        own = automaton(strings)
        for batch in batches:
            yield found(state, own, batch)

    return texts.mapInArrow(run, schema)
