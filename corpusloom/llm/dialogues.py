"""Repair of conversation structure by an auction for shortest paths.

A conversation is a lattice: nodes are (rows worked off, state), the states are what the roles so far look like (nothing,
system, a user's turn last, an assistant's turn last), and arcs are edits with whole costs.  Keep, re-role and delete go
to the next row, an insertion stays before its row.  The cheapest repair is a shortest path to an accepted end.

**Auction** (Bertsekas, 1991).  Every node has a price, at first 0, that never exceeds any arc's cost plus the price of
the arc's end.  A path starts at a node; at its last node i the least ``cost + price`` over the arcs of i decides: above
the price of i, the price rises to it and the path contracts by one node; else the path extends over that arc.  It ends
at a node whose price is final, and then the prices of its nodes are final, their distances to the end.  Starts are taken
from the last row to the first, prices are kept, so each path ends after few steps and the work is linear.  Layers of
equal rows with equal prices ahead (up to a constant) have equal prices, so those are kept.

**Trace.** Arcs whose cost plus price equals the price of their node are tight; every chain of tight arcs is a cheapest
repair, as final prices are distances.  The trace takes the tight arc with the least letter at each node, so the letters
are the least in ASCII order.  From one node no two arcs have one letter.

**Long conversations** are cut into blocks of ``BLOCK`` rows.  Each block's costs between its end states (16 numbers)
come from auctions inside it, a pass over those 16 numbers from the last block to the first gives the prices at the
block ends, each block then finds where its tight arcs lead from each state, and a pass from the first block to the last
gives the state at each start.  So only 1/``BLOCK`` of a conversation passes one task, as small numbers, but for the
digest: the digest of a repaired conversation is one running hash of all its rows, in order, which are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.work import BATCH_ROWS, store, with_columns_of
from corpusloom.operators.ranking import with_rank

BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FAR = 1 << 50
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that a state waits for
#: Where a path to an end state may come from.  A state that cannot lead there would bid without end.
SOURCES = {START: (START,), SYSTEM: (START, SYSTEM), USER: (0, 1, 2, 3), ASSISTANT: (0, 1, 2, 3)}
EVERY = (0, 1, 2, 3)
FINE, LOST, CUT = range(3)  # what a row's fault asks for: nothing, deletion, deletion or a price
_SPACES = " \t\n\x0b\x0c\r"

Prices = tuple[int, int, int, int]


def _arcs(code: int) -> list[list[tuple[str, int, int, bool]]]:
    """Per state the arcs (letter, cost, state after, whether the row is worked off), letters ascending.

    ``code`` is 3 * initial (s, u, a, other) + fault; a negative one is the end of a conversation, where only turns
    can be inserted.
    """
    out = []
    for state in range(STATES):
        wanted = NEXT[state]
        arcs = [("I", INSERT, wanted, False)]
        if code >= 0:
            initial, fault = divmod(code, 3)
            arcs.append(("D", DELETE, state, True))
            if fault != LOST:
                more = UNFINISHED if fault == CUT else 0
                arcs.append(("R", REROLE + more, wanted, True))
                if initial == wanted - 1:
                    arcs.append(("K", KEEP + more, wanted, True))
                elif initial == 0 and state == START:
                    arcs.append(("K", KEEP + more, SYSTEM, True))
        out.append(sorted(arcs))
    return out


_ARCS = {code: _arcs(code) for code in range(-1, 12)}


def _auction(code: int, ahead: Prices, sources: tuple[int, ...], end: Prices | None = None) -> Prices:
    """Final prices of one layer's nodes from those of the layer ahead; ``end``: prices at which a path may stop here."""
    price = [0] * STATES
    final = [False] * STATES
    arcs = _ARCS[code]
    for origin in reversed(sources):
        path = [origin]
        while not final[path[-1]]:
            here = path[-1]
            best, to = FAR, None
            for _, cost, state, on in arcs[here]:
                if on or state in sources:
                    bid = cost + (ahead[state] if on else price[state])
                    if bid < best:
                        best, to = bid, None if on else state
            if end is not None and end[here] <= best:
                best, to = end[here], None
            if price[here] < best:
                price[here] = best
                if len(path) > 1:
                    path.pop()
                elif best >= FAR:
                    break
            elif to is None:
                break  # the layer ahead and the end have final prices
            else:
                path.append(to)
        for node in path:
            final[node] = True
    return tuple(p if k in sources else FAR for k, p in enumerate(price))


@lru_cache(maxsize=200_000)
def _layer(code: int, ahead: Prices, sources: tuple[int, ...] = EVERY) -> Prices:
    return _auction(code, ahead, sources)


def prices_before(code: int, ahead: Prices, sources: tuple[int, ...] = EVERY) -> Prices:
    """Prices of a layer; prices ahead are taken relative to their least, so that few different layers come up."""
    least = min(ahead)
    if least >= FAR:
        return (FAR,) * STATES
    got = _layer(code, tuple(min(p - least, FAR) if p < FAR else FAR for p in ahead), sources)
    return tuple(p + least if p < FAR else FAR for p in got)


#: Prices after the last row: nothing or a closed pair is accepted, other states insert turns.
END = _auction(-1, (FAR,) * STATES, EVERY, end=(0, FAR, FAR, 0))


def block_costs(codes: bytes) -> list[int]:
    """Cost from each state before the block to each state after it, row by row; ``FAR`` if there is no way."""
    columns = []
    for target in range(STATES):
        ahead = tuple(0 if k == target else FAR for k in range(STATES))
        for code in reversed(codes):
            ahead = prices_before(code, ahead, SOURCES[target])
        columns.append(ahead)
    return [columns[b][a] for a in range(STATES) for b in range(STATES)]


def layer_prices(codes: bytes, ahead: Prices) -> list[Prices]:
    """Final prices of all layers of a block, the one ahead of it last."""
    out = [ahead]
    for code in reversed(codes):
        out.append(prices_before(code, out[-1]))
    return out[::-1]


def follow(code: int, state: int, here: Prices, ahead: Prices) -> tuple[str, int]:
    """The least letters from a node over tight arcs to the next layer, and the state there."""
    letters, price = "", here[state]
    while True:
        for letter, cost, to, on in _ARCS[code][state]:
            if price == cost + (ahead[to] if on else here[to]):
                break
        else:
            raise ValueError("no tight arc")
        letters, state = letters + letter, to
        if on:
            return letters, state
        price = here[state]


def closing(state: int) -> tuple[str, int]:
    """The insertions after the last row."""
    letters = ""
    while state not in (START, ASSISTANT):
        letters, state = letters + "I", NEXT[state]
    return letters, state


def _numbers(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def _cost_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [block_costs(codes) for codes in _numbers(batch, "codes")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "block")], pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])


def _exit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, last block first: the prices after each block."""
    last: tuple | None = None
    ahead: Prices = END
    for batch in batches:
        out = []
        for conv, costs in zip(_numbers(batch, "conv"), _numbers(batch, "costs")):
            if last != (conv,):
                last, ahead = (conv,), END
            out.append(list(ahead))
            ahead = tuple(min(min(costs[STATES * a + b] + ahead[b] for b in range(STATES)), FAR) for a in range(STATES))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "block")], pa.array(out, pa.list_(pa.int64()))], names=["conv", "block", "ahead"])


def _exit_states(codes: bytes, ahead: Prices) -> list[int]:
    layers = layer_prices(codes, ahead)
    out = []
    for state in range(STATES):
        if layers[0][state] >= FAR:
            out.append(state)
            continue
        for i, code in enumerate(codes):
            _, state = follow(code, state, layers[i], layers[i + 1])
        out.append(state)
    return out


def _map_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_exit_states(codes, tuple(ahead)) for codes, ahead in zip(_numbers(batch, "codes"), _numbers(batch, "ahead"))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "block", "ahead")], pa.array(out, pa.list_(pa.int64()))], names=["conv", "block", "ahead", "leads"])


def _entry_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, first block first: the state before each block."""
    last: tuple | None = None
    state = START
    for batch in batches:
        out = []
        for conv, leads in zip(_numbers(batch, "conv"), _numbers(batch, "leads")):
            if last != (conv,):
                last, state = (conv,), START
            out.append(state)
            state = leads[state]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "block", "ahead")], pa.array(out, pa.int64())], names=["conv", "block", "ahead", "entry"])


def _edit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of a block: the letters of its edits (insertions before it first) and the state after them."""
    for batch in batches:
        convs = batch.column("conv")
        rows, places, kinds, letters, states, closers = [], [], [], [], [], []
        for k, (start, codes, ahead, entry, final) in enumerate(zip(*[_numbers(batch, c) for c in ("start", "codes", "ahead", "entry", "final")])):
            layers = layer_prices(codes, tuple(ahead))
            state = entry
            for i, code in enumerate(codes):
                found, state = follow(code, state, layers[i], layers[i + 1])
                rows.append(k)
                places.append(start + i)
                kinds.append(code)
                letters.append(found)
                states.append(state)
                closers.append("")
            if final:
                closers[-1] = closing(state)[0]
        take = pa.array(rows, pa.int64())
        narrow = [pa.array(kinds, pa.int32()), pa.array(letters, pa.string()), pa.array(states, pa.int32()), pa.array(closers, pa.string())]
        arrays = [convs.take(take), pa.array(places, pa.int64()), *narrow]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", "pos", "code", "letters", "state", "closing"])


def edits(blocks: DataFrame) -> DataFrame:
    """(conv, pos, code, letters, state, closing) of the cheapest repair.

    ``blocks`` has (conv, block, start, codes, final): the place of the first row, the codes of the block's rows in
    order, and whether it is the last one.  ``letters`` are the edits at a row, ``state`` the state after them, ``closing``
    the insertions after the last row.
    """
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["block"] == b["block"])
    long = blocks.filter("not final or block > 0")
    costs = long.select("conv", "block", "codes").mapInArrow(_cost_rows, "conv long, block long, costs array<long>")
    by_last = costs.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    exits = by_last.mapInArrow(_exit_rows, "conv long, block long, ahead array<long>")
    ahead = store(long.join(exits, same(long, exits)).select(long["conv"], long["block"], "codes", "ahead"), "dialogue-exits")
    leads = ahead.mapInArrow(_map_rows, "conv long, block long, ahead array<long>, leads array<long>")
    by_first = leads.repartition("conv").sortWithinPartitions("conv", "block")
    entries = by_first.mapInArrow(_entry_rows, "conv long, block long, ahead array<long>, entry long")
    joined = long.join(entries, same(long, entries)).select(long["conv"], long["block"], "start", "codes", "final", "ahead", "entry")
    short = blocks.filter("final and block = 0").select(
        "conv", "block", "start", "codes", "final", F.array(*[F.lit(p).cast("long") for p in END]).alias("ahead"), F.lit(START).cast("long").alias("entry")
    )
    return short.unionByName(joined).mapInArrow(_edit_rows, "conv long, pos long, code int, letters string, state int, closing string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with faults by the crc32 of ``conv:turn`` modulo 20; nulls are one space there.

    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (
        rows.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select(
            "conv",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def _fault_code() -> Column:
    """3 * initial + what the fault asks for."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("duplicate"), LOST).when(F.col("truncated"), CUT).otherwise(FINE)
    return (kind * 3 + fault).cast("byte")


def coded_rows(placed: DataFrame) -> DataFrame:
    """(conv, pos, code) of rows (conv, pos, role, text); the first fault of blank, duplicate and truncated counts.

    The first row of each (conversation, role, text) is a minimum, folded in the map tasks; it comes back by its place,
    so a text that is repeated very often makes no hot key.
    """
    ended = F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1))
    rows = placed.select(
        "conv",
        "pos",
        "role",
        F.sha2("text", 256).alias("_text"),
        (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
        (~ended.isin(".", "!", "?")).alias("truncated"),
    )
    firsts = rows.groupBy("conv", "role", "_text").agg(F.min("pos").alias("_pos")).select(F.col("conv").alias("_conv"), "_pos", F.lit(False).alias("_later"))
    same = rows["conv"].eqNullSafe(firsts["_conv"]) & (rows["pos"] == firsts["_pos"])
    marked = rows.join(firsts, same, "left").withColumn("duplicate", F.coalesce("_later", F.lit(True)))
    return marked.select("conv", "pos", _fault_code().alias("code"))


def code_blocks(coded: DataFrame, rows_of_block: int = BLOCK) -> DataFrame:
    """(conv, block, start, codes, final) from (conv, pos, code); a group is ``rows_of_block`` rows at most."""
    sizes = coded.groupBy("conv").agg(F.max("pos").alias("_last"))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.hex(x["code"].cast("long")), 2, "0")), "")
    rows = coded.groupBy("conv", F.floor(F.col("pos") / rows_of_block).alias("block")).agg(
        F.unhex(digits).alias("codes"), F.min("pos").alias("start"), F.max("pos").alias("_end")
    )
    ends = sizes.select(F.col("conv").alias("_conv"), "_last")
    joined = rows.join(ends, rows["conv"].eqNullSafe(ends["_conv"]))
    return joined.select("conv", F.col("block").cast("long").alias("block"), "start", "codes", (F.col("_end") == F.col("_last")).alias("final"))


class _Repaired:
    """The running result of one conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial = None
        self.letters: list[str] = []
        self.hash, self.any = hashlib.sha256(), False
        self.state = START

    def line(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(f"{role}:{text}".encode())

    def inserted(self, letters: str) -> None:
        for _ in letters:
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], "")
            self.cost += INSERT

    def row(self, turn, role: str, text: str, code: int, letters: str, state: int, closing: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        fault = code % 3
        if fault == LOST:
            blank = not text.strip(_SPACES)
            self.blank += blank
            self.duplicate += not blank
        self.truncated += fault == CUT
        self.inserted(letters[:-1])
        edit = letters[-1]
        self.state = state
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if edit == "R" else KEEP) + (UNFINISHED if fault == CUT else 0)
            self.line(ROLES[state] if edit == "R" else role, text)
        self.letters.append(letters)
        if closing:
            self.inserted(closing)
            self.letters.append(closing)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


_RESULT = pa.schema(
    [("conv", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _result_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and place, the edits of a row before the row itself."""
    now: _Repaired | None = None
    done: list[tuple] = []
    held = None
    names = ("conv", "turn", "role", "text", "code", "letters", "state", "closing")
    for batch in batches:
        for conv, turn, role, text, code, letters, state, closing in zip(*[_numbers(batch, n) for n in names]):
            if letters is not None:
                held = (code, letters, state, closing)
                continue
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.result())
                now = _Repaired(conv)
            now.row(turn, role, text, *held)
        if len(done) >= BATCH_ROWS:
            yield _as_batch(done)
            done = []
    if now is not None:
        done.append(now.result())
    if done:
        yield _as_batch(done)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)


def repair(conversations: DataFrame, damaged: bool = False, rows_of_block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``conversations`` has (conv_id, turn, role, text); other columns are ignored, an absent one is null.  Rows are
    taken by turn, nulls first, then role and text.  Null roles and texts are one space.  ``audit`` has one letter per
    edit: K keeps, R re-roles, D deletes, I inserts.  ``damaged`` first applies ``damage``.  Null conv_ids are one
    conversation.  A conversation without rows after damage has zeros, an empty audit and the digest of nothing.
    """
    rows = with_columns_of(conversations, ("conv_id", "turn", "role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    every = rows.select("conv").distinct()
    if damaged:
        rows = damage(rows)
    rows = rows.select("conv", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # equal rows may change places; the salt lets a range end among very many of them
    order = [F.col("turn"), F.col("role"), F.col("text"), F.rand(13)]
    placed = with_rank(rows, ["conv"], order, "pos", "_size").drop("_size")
    found = edits(store(code_blocks(coded_rows(placed), rows_of_block), "dialogue-blocks"))
    null = lambda kind: F.lit(None).cast(kind)
    texts = placed.select(
        "conv", "pos", F.lit(1).alias("kind"), "turn", "role", "text",
        null("int").alias("code"), null("string").alias("letters"), null("int").alias("state"), null("string").alias("closing"),
    )
    marks = found.select(
        "conv", "pos", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"),
        "code", "letters", "state", "closing",
    )
    ordered = texts.unionByName(marks).repartition("conv").sortWithinPartitions("conv", "pos", "kind")
    schema = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    results = store(ordered.mapInArrow(_result_rows, schema), "dialogue-results")
    joined = every.join(results, every["conv"].eqNullSafe(results["conv"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        every["conv"].alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
