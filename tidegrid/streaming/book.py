"""Order books folded from messages, in batch and as a stream, and other keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SAMPLE = "inst string, sample_ms long, bid double, ask double, bid_size double, ask_size double, levels long, late long"
STATE = "bids map<double,double>, asks map<double,double>, last_ms long, next_ms long, late long"


class Book:
    """Two sides by price. A snapshot replaces them; a size of 0 removes a level."""

    def __init__(self, bids: dict | None = None, asks: dict | None = None, last: int = -1, due: int = -1, late: int = 0):
        self.bids, self.asks, self.last, self.due, self.late = dict(bids or {}), dict(asks or {}), last, due, late

    def sample(self, inst: str, at: int) -> tuple:
        bid, ask = max(self.bids, default=None), min(self.asks, default=None)
        return inst, at, bid, ask, self.bids.get(bid), self.asks.get(ask), len(self.bids) + len(self.asks), self.late

    def apply(self, inst: str, ms: int, action: str, bids: Iterable, asks: Iterable, step: int) -> Iterator[tuple]:
        """Samples due before this message come from the book as it was; at the boundary itself, with the message."""
        if self.due < 0:
            self.due = -(-ms // step) * step
        while self.due < ms:
            yield self.sample(inst, self.due)
            self.due += step
        if ms < self.last:
            self.late += 1  # counted, still applied
        self.last = max(self.last, ms)
        if action == "snapshot":
            self.bids.clear()
            self.asks.clear()
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for level in levels if levels is not None else ():
                price, size = level["price"], level["size"]
                if size:
                    side[price] = size
                else:
                    side.pop(price, None)
        if self.due == ms:
            yield self.sample(inst, self.due)
            self.due += step


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["inst", "sample_ms", "bid", "ask", "bid_size", "ask_size", "levels", "late"])


def replay(messages: DataFrame, step_ms: int = 10_000, day_ms: int = 86_400_000) -> DataFrame:
    """Book samples of whole days: one fold an instrument and day, in (ts, seq) order, to the day's end."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        book, out, inst = Book(), [], pdf["inst"].iloc[0]
        for m in pdf.itertuples(index=False):
            out += book.apply(inst, m.ts_ms, m.action, m.bids, m.asks, step_ms)
        end = (int(pdf["ts_ms"].min()) // day_ms + 1) * day_ms
        while book.due < end:
            out.append(book.sample(inst, book.due))
            book.due += step_ms
        return _frame(out)

    keyed = messages.withColumn("day", F.floor(F.col("ts_ms") / day_ms))
    return keyed.groupBy("inst", "day").applyInPandas(fold, SAMPLE)


def stream_samples(messages: DataFrame, step_ms: int = 10_000) -> DataFrame:
    """The same fold over a stream, with the book as keyed state; samples come as later messages prove them due."""
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(*state.get) if state.exists else Book()
        out = []
        for m in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
            out += book.apply(key[0], m.ts_ms, m.action, m.bids, m.asks, step_ms)
        state.update((book.bids, book.asks, book.last, book.due, book.late))
        yield _frame(out)

    return messages.groupBy("inst").applyInPandasWithState(fold, SAMPLE, STATE, "append", GroupStateTimeout.NoTimeout)


def effective_spread(trades: DataFrame, samples: DataFrame) -> DataFrame:
    """Twice the signed distance of a trade from the mid before it, in basis points, and the quote's age."""
    from ..operators.grid import asof

    quotes = samples.where("bid IS NOT NULL AND ask IS NOT NULL").select("inst", F.col("sample_ms").alias("ts"), F.struct(((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.col("sample_ms").alias("at")).alias("q"))
    t = asof(trades, quotes, "q", "quote", strict=True, keys=("inst",))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return t.select(*trades.columns, F.col("quote.mid").alias("mid"), (2 * sign * (F.col("price") - F.col("quote.mid")) / F.col("quote.mid") * 1e4).alias("effective_bp"), (F.col("ts") - F.col("quote.at")).alias("quote_age_ms"))
