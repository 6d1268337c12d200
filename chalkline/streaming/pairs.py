"""Members of a JSON object while its text still comes in deltas: each top-level pair at the delta that closes it.

An automaton reads each character once and keeps the text of the member in work only: strings end at a quote that is
not escaped, objects and lists at depth zero, other values at the character behind them. It can stop between any two
characters, so its state goes with the item from one micro-batch to the next, and the pairs are the same however the
text is cut.

Defined results: a text that stops being an object (or, with ``strings_only``, has a value that is no string) gives
the pairs before that place and nothing after; of equal names the first counts; a null value is a pair with a null; an
item that ends early gives what was closed; null deltas are empty; deltas without item are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.streaming.fold import Keeper, walked, with_rocksdb

PAIRS = "item_id string, ord bigint, name string, value string"
STATE = "mode string, held string, depth int, name string, seen array<string>"
_BLANK = " \t\r\n"
_QUOTE, _NEST, _END = re.compile(r'["\\]'), re.compile(r'["\[\]{}]'), re.compile(rf"[,}}{_BLANK}]")


class PairParser:
    """Modes: open ({ awaited), name, colon, value (each awaited), in_name, text, nest, nest_text, bare, next (, or }), over."""

    def __init__(self, mode: str = "open", held: str = "", depth: int = 0, name: str | None = None, seen: list[str] | None = None, names: tuple[str, ...] | None = None, strings_only: bool = False) -> None:
        self.mode, self.held, self.depth, self.name, self.seen = mode, held, depth, name, list(seen or [])
        self.names, self.strings_only = names, strings_only

    def state(self) -> tuple:
        return self.mode, self.held, self.depth, self.name, self.seen

    def due(self) -> None:
        return None

    def _value(self, mode: str, text: str) -> Iterator[tuple[str, str | None]]:
        self.mode, self.held = "next", ""
        try:
            value = json.loads(text)
        except ValueError:
            self.mode = "over"
            return
        if (self.names is None or self.name in self.names) and self.name not in self.seen:
            self.seen.append(self.name)
            yield self.name, value if mode == "text" or value is None else text

    def _string_end(self, delta: str, at: int) -> int:
        """Place behind the quote that ends the string in work, or -1; an escape cut off at the end stays in ``held``."""
        if self.held and (len(self.held) - len(self.held.rstrip("\\"))) % 2:
            at += 1
        while (found := _QUOTE.search(delta, at)) and found[0] == "\\":
            at = found.end() + 1
        return found.end() if found else -1

    def feed(self, delta: str) -> Iterator[tuple[str, str | None]]:
        at, n = 0, len(delta)
        while at < n and self.mode != "over":
            if self.mode in ("in_name", "text", "nest_text"):
                end = self._string_end(delta, at)
                self.held += delta[at : end if end > 0 else n]
                if end < 0:
                    return
                at = end
                if self.mode == "nest_text":
                    self.mode = "nest"
                elif self.mode == "text":
                    yield from self._value("text", self.held)
                else:
                    try:
                        self.name, self.mode, self.held = json.loads(self.held), "colon", ""
                    except ValueError:
                        self.mode = "over"
            elif self.mode == "nest":
                found = _NEST.search(delta, at)
                end = found.end() if found else n
                self.held, at = self.held + delta[at:end], end
                if found and found[0] == '"':
                    self.mode = "nest_text"
                elif found:
                    self.depth += 1 if found[0] in "[{" else -1
                    if not self.depth:
                        yield from self._value("nest", self.held)
            elif self.mode == "bare":
                found = _END.search(delta, at)
                end = found.start() if found else n
                self.held, at = self.held + delta[at:end], end
                if found:
                    yield from self._value("bare", self.held)
            elif delta[at] in _BLANK:
                at += 1
            else:
                self._step(delta[at])
                at += 1

    def _step(self, c: str) -> None:
        """One character between names and values."""
        if self.mode == "open" and c == "{":
            self.mode = "name_or_end"
        elif self.mode in ("name", "name_or_end") and c == '"':
            self.mode, self.held = "in_name", c
        elif self.mode == "colon" and c == ":":
            self.mode = "value"
        elif self.mode == "next" and c == ",":
            self.mode = "name"
        elif self.mode == "value" and c == '"':
            self.mode, self.held = "text", c
        elif self.mode == "value" and not self.strings_only and c in "{[":
            self.mode, self.held, self.depth = "nest", c, 1
        elif self.mode == "value" and not self.strings_only and c not in ",}]:":
            self.mode, self.held = "bare", c
        else:
            self.mode = "over"

    def row(self, number: int, delta: str | None) -> Iterator[tuple]:
        for name, value in self.feed(delta or ""):
            yield number, name, value

    def end(self) -> Iterator[tuple]:
        return iter(())


def _plain(deltas: DataFrame) -> DataFrame:
    return deltas.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("ord").cast("long"), F.col("delta").cast("string"))


def pairs(deltas: DataFrame, names: tuple[str, ...] | None = None, strings_only: bool = False) -> DataFrame:
    """Pairs of complete items; ``deltas`` (item_id, ord, delta) come in the order of ``ord``."""
    return walked(_plain(deltas), "item_id", ["ord"], ["ord", "delta"], lambda: PairParser(names=names, strings_only=strings_only), PAIRS)


def pairs_stream(deltas: DataFrame, names: tuple[str, ...] | None = None, strings_only: bool = False) -> DataFrame:
    """The same over a stream, with the automaton of each item as state."""
    with_rocksdb(deltas.sparkSession)
    start = lambda *state: PairParser(*state, names=names, strings_only=strings_only)
    keeper = Keeper(start, ["ord", "delta"], ["ord"], STATE, ["item_id", "ord", "name", "value"])
    return _plain(deltas).groupBy("item_id").transformWithState(keeper, PAIRS, "append", "None")
