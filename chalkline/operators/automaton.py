"""Sentences with the patterns they contain, for lexicons too large to be tried one by one or to be sent to all tasks.

Patterns are dealt into parts of bounded size, each of which makes one Aho-Corasick automaton. Sentences go once to
each part, in slots of bounded size, and run through its automaton once, whatever the number of patterns. A task reads
the patterns of its (part, slot) first, then the sentences as they come: it holds one automaton and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Patterns of a part, and sentences that one automaton is made for.
PART_PATTERNS, SLOT_SENTENCES = 200_000, 200_000
#: Pairs that leave a task at once.
PAIRS = 10_000


def contained(sentences: DataFrame, lexicon: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows of ``sentences`` with each row of ``lexicon`` whose pattern is in the text, without regard to case.

    A null text or pattern meets nothing, an empty pattern each text. Columns of both are to have different names.
    """
    known = lexicon.where(F.col(pattern).isNotNull())
    n_parts = max(1, -(-known.count() // PART_PATTERNS))
    said = sentences.where(F.col(text).isNotNull())
    n_slots = max(1, -(-said.count() // SLOT_SENTENCES))
    one, two = F.struct(*[F.col(f"`{c}`") for c in sentences.columns]), F.struct(*[F.col(f"`{c}`") for c in lexicon.columns])
    types = {"_s": said.select(one.alias("x")).schema["x"].dataType, "_p": known.select(two.alias("x")).schema["x"].dataType}
    none = {k: F.lit(None).cast(t) for k, t in types.items()}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    patterns = known.select(deal(F.lower(pattern), n_parts).alias("part"), every(n_slots).alias("slot"), F.lit(0).alias("kind"), F.lower(pattern).alias("word"), none["_s"].alias("_s"), two.alias("_p"))
    rows = said.select(every(n_parts).alias("part"), F.pmod(F.xxhash64(*said.columns), F.lit(n_slots)).cast("int").alias("slot"), F.lit(1).alias("kind"), F.lower(text).alias("word"), one.alias("_s"), none["_p"].alias("_p"))
    dealt = patterns.unionByName(rows).repartition("part", "slot").sortWithinPartitions("part", "slot", "kind")
    met = dealt.mapInArrow(_met, StructType([StructField(k, t) for k, t in types.items()]))
    return met.select("_s.*", "_p.*")


class _Part:
    """The automaton of a part; ``payload`` are its rows of the lexicon."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton, self.payload, self.n, self.at, self.everywhere = ahocorasick.Automaton(), [], 0, {}, []

    def add(self, words: list[str], rows: pa.Array) -> None:
        for word in words:
            if word:
                self.at.setdefault(word, []).append(self.n)
            else:
                self.everywhere.append(self.n)
            self.n += 1
        self.payload.append(rows)

    def make(self) -> None:
        for word, at in self.at.items():
            self.automaton.add_word(word, at)
        self.automaton.make_automaton()
        self.rows, self.at = pa.concat_arrays(self.payload), None

    def find(self, text: str) -> set[int]:
        hits = set(self.everywhere)
        if len(self.automaton):
            for _, at in self.automaton.iter(text):
                hits.update(at)
        return hits


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, part = None, None
    for batch in batches:
        place = list(zip(batch.column("part").to_pylist(), batch.column("slot").to_pylist()))
        kinds, words = batch.column("kind").to_pylist(), batch.column("word").to_pylist()
        start = 0
        while start < batch.num_rows:
            end = start
            while end < batch.num_rows and (place[end], kinds[end]) == (place[start], kinds[start]):
                end += 1
            if place[start] != current:
                current, part = place[start], _Part()
            if kinds[start] == 0:
                part.add(words[start:end], batch.column("_p").slice(start, end - start))
            elif part.n:
                if part.at is not None:
                    part.make()
                pairs: list[tuple[int, int]] = []
                for k in range(start, end):
                    pairs += [(k, hit) for hit in part.find(words[k])]
                    if pairs and (k + 1 == end or len(pairs) >= PAIRS):
                        left, right = zip(*pairs)
                        yield pa.RecordBatch.from_arrays([batch.column("_s").take(pa.array(left)), part.rows.take(pa.array(right))], ["_s", "_p"])
                        pairs = []
            start = end
