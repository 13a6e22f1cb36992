"""Request de-duplication with a time-to-live that restarts at every accepted request.

The accepted requests of a key form a chain: the next one is the first success at least ``ttl`` after the last.
Folding a key's whole history in one task would not survive a hot key, so the history is cut into chunks:

1. per (key, chunk): where does the chain leave the chunk, for every point at which it may enter? An entry lies in
   the first ``ttl`` of the chunk or is the first success after that, so this table is at most about a sixteenth of
   the chunk, however dense the requests are;
2. the tables of FAN neighbouring chunks are composed into one of their block, those of FAN blocks into one of a
   larger block, and so on until a block spans the history;
3. back down, the entry state of a block gives those of its FAN parts;
4. per (key, chunk): replay the chunk from its entry state and mark the rows.

A task holds the tables of FAN parts of one block at a time, never those of a whole key. All steps are vectorised
over sorted Arrow batches. The rounds of 2 and 3 grow with the logarithm of the history's length in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.session import materialize, ship_package

_NEVER = -(2 ** 62)
FAN = 8


def request_key(columns: Sequence[str], explicit: str | None = None) -> Column:
    """Explicit idempotency key, else the first 32 hex digits of the hash of the canonical JSON of ``columns``."""
    content = F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 32)
    return F.coalesce(F.col(explicit), content) if explicit else content


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no (key, chunk) group is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch["k"] == batch["k"].iat[-1]) & (batch["c"] == batch["c"].iat[-1])
        start = int(np.argmin(last.values[::-1])) if not last.all() else len(batch)
        split = len(batch) - start
        if split:
            yield pd.concat([*held, batch.iloc[:split]], ignore_index=True)
            held = []
        held.append(batch.iloc[split:])
        # the held rows may belong to two groups when the previous batch ended exactly at a group border
        if len(held) > 1 and not ((held[0]["k"].iat[-1] == held[-1]["k"].iat[0]) and (held[0]["c"].iat[-1] == held[-1]["c"].iat[0])):
            yield pd.concat(held[:-1], ignore_index=True)
            held = held[-1:]
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_ids(pdf: pd.DataFrame) -> np.ndarray:
    k, c = pdf["k"].values, pdf["c"].values
    new = np.ones(len(pdf), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return np.cumsum(new) - 1


def _successors(group: np.ndarray, off: np.ndarray, ttl: int, width: int) -> np.ndarray:
    """Index of the first row of the same group at least ``ttl`` later, or the row count."""
    span = width + ttl + 1
    place = group.astype(np.int64) * span + off
    nxt = np.searchsorted(place, place + ttl, side="left")
    inside = nxt < len(group)
    inside[inside] = group[nxt[inside]] == group[inside]
    return np.where(inside, nxt, len(group))


def _transfer(ttl: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            n = len(pdf)
            group = _group_ids(pdf)
            us = pdf["us"].values
            off = us - pdf["c"].values * width
            nxt = _successors(group, off, ttl, width)
            jump = np.where(nxt < n, nxt, np.arange(n))
            while True:
                further = jump[jump]
                if (further == jump).all():
                    break
                jump = further
            first = np.ones(n, bool)
            first[1:] = group[1:] != group[:-1]
            # the chain enters at a row of the first ttl of the chunk, or at the first row after it
            entry = first | (off < ttl)
            entry[1:] |= (group[1:] == group[:-1]) & (off[:-1] < ttl)
            idx = np.flatnonzero(entry)
            keep = np.ones(len(idx), bool)
            keep[:-1] = (jump[idx[:-1]] != jump[idx[1:]]) | (group[idx[:-1]] != group[idx[1:]])
            idx = idx[keep]
            yield pd.DataFrame({"k": pdf["k"].values[idx], "c": pdf["c"].values[idx], "upto": us[idx],
                                "exit_us": us[jump[idx]], "exit_id": pdf["id"].values[jump[idx]]})
    return run


def _replay(ttl: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            n = len(pdf)
            group = _group_ids(pdf)
            us, ids, entry = pdf["us"].values, pdf["id"].values, pdf["entry_us"].values
            good = np.flatnonzero(pdf["ok"].values)
            accepted = np.zeros(n, bool)
            if len(good):
                g, off = group[good], us[good] - pdf["c"].values[good] * width
                nxt = _successors(g, off, ttl, width)
                # first success of each group that the entry state lets through
                open_ = np.flatnonzero(us[good] >= entry[good] + ttl)
                cur = open_[np.unique(g[open_], return_index=True)[1]]
                while len(cur):
                    accepted[good[cur]] = True
                    cur = nxt[cur]
                    cur = cur[cur < len(good)]
            # last accepted row strictly before each row of the same group
            mark = np.where(accepted, np.arange(n), -1)
            before = np.concatenate([[-1], np.maximum.accumulate(mark)[:-1]])
            own = before >= 0
            own[own] = group[before[own]] == group[own]
            last_us = np.where(own, us[np.maximum(before, 0)], entry)
            hit = us < last_us + ttl
            served = np.where(own, ids[np.maximum(before, 0)], pdf["entry_id"].values)
            yield pd.DataFrame({"id": ids, "executed": ~hit, "served_by": np.where(hit, served, None)})
    return run


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts) of each (k, c) group of sorted rows; parts are the (start, end) of equal ``i``."""
    group, i = _group_ids(pdf), pdf["i"].values
    new = np.ones(len(pdf), bool)
    new[1:] = (group[1:] != group[:-1]) | (i[1:] != i[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(pdf))
    owner = group[starts]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for x, y in zip(cut, np.append(cut[1:], len(owner)), strict=True):
        yield int(starts[x]), int(ends[y - 1]), list(zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True))


def _compose(ttl: int, size: int, origin: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Tables of parts (k, block c, part i) -> the table of the block; blocks are ``size`` long, the first begins at ``origin``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            upto, out_us, out_id = pdf["upto"].values, pdf["exit_us"].values, pdf["exit_id"].values
            rows = []
            for start, end, parts in _parts(pdf):
                k, c = pdf["k"].iat[start], pdf["c"].iat[start]
                rows.append(pd.DataFrame({"k": [k], "c": [c], "upto": [_NEVER], "exit_us": [0], "exit_id": [None]}))
                places = start + np.flatnonzero(upto[start:end] != _NEVER)
                # a chain enters the block within its first ttl, or at the first success after that
                near = places[upto[places] < c * size + origin + ttl]
                places = places[:len(near) + 1]
                if not len(places):
                    continue
                us, ident = out_us[places].copy(), out_id[places].copy()
                for a, b in parts:
                    table = np.arange(a, b)[upto[a:b] != _NEVER]
                    before = np.flatnonzero(places < a)
                    if not len(table) or not len(before):
                        continue
                    hit = np.searchsorted(upto[table], us[before] + ttl, side="left")
                    taken = hit < len(table)
                    us[before[taken]], ident[before[taken]] = out_us[table[hit[taken]]], out_id[table[hit[taken]]]
                keep = np.append(us[1:] != us[:-1], True)  # entries with one exit are one
                rows.append(pd.DataFrame({"k": k, "c": c, "upto": upto[places][keep], "exit_us": us[keep], "exit_id": ident[keep]}))
            yield pd.concat(rows, ignore_index=True)
    return run


def _descend(ttl: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Tables of parts with the entry state of their block -> the entry state of each part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            upto, out_us, out_id = pdf["upto"].values, pdf["exit_us"].values, pdf["exit_id"].values
            keys, index, entry_us, entry_id = [], [], [], []
            for start, _, parts in _parts(pdf):
                us, ident = pdf["entry_us"].iat[start], pdf["entry_id"].iat[start]
                for a, b in parts:
                    keys.append(pdf["k"].iat[a])
                    index.append(pdf["i"].iat[a])
                    entry_us.append(us)
                    entry_id.append(ident)
                    hit = a + int(np.searchsorted(upto[a:b], max(us + ttl, _NEVER + 1), side="left"))
                    if hit < b:
                        us, ident = out_us[hit], out_id[hit]
            yield pd.DataFrame({"k": keys, "c": index, "entry_us": entry_us, "entry_id": entry_id})
    return run


_TABLE = "k string, c bigint, upto bigint, exit_us bigint, exit_id string"


def _entries(tables: DataFrame, ttl: int, width: int) -> DataFrame:
    """(k, c, entry_us, entry_id) of every chunk of ``tables``, which holds a row with upto _NEVER for each."""
    ends = tables.agg(F.min("c").alias("lo"), F.max("c").alias("hi")).first()
    if ends.lo is None:
        return tables.select("k", "c", F.col("exit_us").alias("entry_us"), F.col("exit_id").alias("entry_id"))
    level, _ = materialize(tables.withColumn("c", F.col("c") - ends.lo), "tables")
    levels, span, size = [level], ends.hi - ends.lo + 1, width
    in_blocks = lambda df: df.withColumnRenamed("c", "i").withColumn("c", F.floor(F.col("i") / FAN))
    ordered = lambda df: df.repartition("k", "c").sortWithinPartitions("k", "c", "i", "upto")
    while span > FAN:
        size *= FAN
        level, _ = materialize(ordered(in_blocks(level)).mapInPandas(_compose(ttl, size, ends.lo * width), _TABLE), "tables")
        levels.append(level)
        span = -(-span // FAN)
    states = None
    for level in reversed(levels):
        rows = in_blocks(level)
        if states is None:  # one block spans all; nothing was accepted before it
            rows = rows.withColumns({"entry_us": F.lit(_NEVER).cast("bigint"), "entry_id": F.lit(None).cast("string")})
        else:
            rows = rows.join(states, ["k", "c"])
        states = ordered(rows).mapInPandas(_descend(ttl), "k string, c bigint, entry_us bigint, entry_id string")
        states, _ = materialize(states, "states")
    return states.withColumn("c", F.col("c") + ends.lo)


def dedupe_requests(df: DataFrame, key: Column, ts: str, request_id: str, failed: Column, ttl_seconds: int = 3600,
                    chunk_ttls: int = 16) -> DataFrame:
    """Per request: executed, or served from the cached result of an earlier successful request.

    Failures are not cached, but a failure inside the window of a success is served the success. A request
    without a time or a key can neither serve nor be served: it is executed.
    """
    ship_package(df.sparkSession)
    ttl, width = ttl_seconds * 1_000_000, ttl_seconds * chunk_ttls * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(key.alias("k"), F.floor(us / F.lit(width)).alias("c"), us.alias("us"),
                     F.col(request_id).cast("string").alias("id"), F.col(request_id).alias("o"), (~failed).alias("ok"))
    loose = rows.where("us IS NULL OR k IS NULL").select("id", F.lit(True).alias("executed"), F.lit(None).cast("string").alias("served_by"))
    rows = rows.where("us IS NOT NULL AND k IS NOT NULL")
    spread = rows.repartition("k", "c")
    good = spread.where("ok").sortWithinPartitions("k", "c", "us", "o").select("k", "c", "us", "id")
    exits = good.mapInPandas(_transfer(ttl, width), "k string, c bigint, upto bigint, exit_us bigint, exit_id string")

    # chunks without a success pass their entry state on; every chunk has a row with a bound nobody meets
    present = rows.select("k", "c").distinct().select("k", "c", F.lit(_NEVER).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("exit_us"),
                                                      F.lit(None).cast("string").alias("exit_id"))
    entry = _entries(exits.unionByName(present), ttl, width)
    joined = rows.join(entry, ["k", "c"]).repartition("k", "c").sortWithinPartitions("k", "c", "us", "o")
    out = joined.select("k", "c", "us", "id", "ok", "entry_us", "entry_id").mapInPandas(
        _replay(ttl, width), "id string, executed boolean, served_by string")
    kind = df.schema[request_id].dataType
    return out.unionByName(loose).select(F.col("id").cast(kind).alias(request_id), "executed", F.col("served_by").cast(kind).alias("served_by"))
