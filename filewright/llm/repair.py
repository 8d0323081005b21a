"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: nothing, or pairs of user and
assistant turns after at most one system turn. A message is faulty if its text is blank, if role and text were
seen earlier in the conversation, or if it is truncated, that is, its last visible character is no ``.``, ``!``
or ``?``; the first of these counts. Edits are Keep (0), Rerole to user or assistant (3), Delete (4, the only
one for blank and repeated messages) and Insert of an empty user or assistant turn (3); a truncated message that
is not deleted costs 3 more. Of the cheapest edits those whose initials are least in ASCII order are taken; these
initials are the audit.

The dynamic programme runs on compressed sequences. A message is one of nine symbols, role and fault. Messages
are sorted over all tasks and cut into blocks of at most ``BLOCK_ROWS``, so one endless conversation is many
blocks, and blocks of the same symbols are solved once for all conversations. Re-Pair turns the sequences of a
batch into a grammar whose rules they share; each symbol and, bottom-up, each rule has a min-plus matrix from
state before to state after, with the cheapest cost and the audit as a rope. The blocks of a conversation are
chained by their matrices, first on costs and the order of audits alone, then the chosen audits are applied while
the messages of a conversation stream by in order.

Why the audits of parts may be compared apart: within one matrix entry two audits of equal cost have the same
number of letters other than I and end in such a letter, so neither is the beginning of the other, and what
follows cannot change their order.

Rows: NULL roles and texts are one space. A NULL turn sorts first and is left out of the gaps; rows of one turn
are in the order of role and of a digest of the text, and rows equal in all are repeats of the first. A NULL
conversation id is a conversation. Empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm.store import attach, stage
from filewright.llm.text import trimmed

RE_ROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 20
BATCH_SYMBOLS = 1 << 16
BLANK_CHARS = " \t\n\x0b\x0c\r"

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
AFTER_NEW = (2, 2, 3, 2)  # the state after an inserted or re-roled turn
CLOSING = ("", "II", "I", "")
SYMBOLS = "suaxSUAXD"  # role initial, capital if truncated; D has to be deleted

Entry = tuple[int, "str | tuple"]
Matrix = dict[tuple[int, int], Entry]


def _keep(state: int, initial: str) -> int | None:
    """The state after a kept turn, if it may follow."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


# Ropes: an audit of up to LEAF letters is a string, a longer one a pair of ropes.
LEAF = 64


def _leaves(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack.extend((top[1], top[0]))


def _letters(rope) -> Iterator[str]:
    for leaf in _leaves(rope):
        yield from leaf


def _before(left, right) -> bool:
    if isinstance(left, str) and isinstance(right, str):
        return left < right
    for one, other in zip(_letters(left), _letters(right)):
        if one != other:
            return one < other
    return False


def _joined(left, right):
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= LEAF:
        return left + right
    return (left, right)


def _put(matrix: Matrix, key: tuple[int, int], cost: int, rope) -> None:
    known = matrix.get(key)
    if known is None or cost < known[0] or (cost == known[0] and _before(rope, known[1])):
        matrix[key] = (cost, rope)


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions and then one edit of the symbol, from each state."""
    made: Matrix = {}
    for first in STATES:
        state = first
        for inserted in range(3):  # a third insertion comes back to a state that is reached for less
            paid, audit = inserted * INSERT, "I" * inserted
            _put(made, (first, state), paid + DELETE, audit + "D")
            if symbol != "D":
                more = TRUNCATED if symbol.isupper() else 0
                kept = _keep(state, symbol.lower())
                if kept is not None:
                    _put(made, (first, kept), paid + more, audit + "K")
                _put(made, (first, AFTER_NEW[state]), paid + RE_ROLE + more, audit + "R")
            state = AFTER_NEW[state]
    return made


def product(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product: ``left`` and then ``right``."""
    made: Matrix = {}
    for (first, middle), (cost, rope) in left.items():
        for last in STATES:
            follow = right.get((middle, last))
            if follow is not None:
                known = made.get((first, last))
                total = cost + follow[0]
                if known is None or total <= known[0]:
                    _put(made, (first, last), total, _joined(rope, follow[1]))
    return made


def re_pair(texts: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, sequences): the most frequent pair of neighbours becomes a symbol, until no pair occurs twice.

    Numbers below ``len(SYMBOLS)`` are symbols, the others rules, each made of two smaller numbers.
    """
    values: list[int] = []
    for text in texts:
        values.extend(SYMBOLS.index(symbol) for symbol in text)
        values.append(-1)
    size = len(values)
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    places: dict[tuple[int, int], set[int]] = {}

    def add(at: int) -> tuple[int, int] | None:
        follow = after[at] if at >= 0 else size
        if at < 0 or follow >= size or values[at] < 0 or values[follow] < 0:
            return None
        pair = (values[at], values[follow])
        places.setdefault(pair, set()).add(at)
        return pair

    def remove(at: int) -> None:
        follow = after[at] if at >= 0 else size
        if at >= 0 and follow < size:
            places.get((values[at], values[follow]), set()).discard(at)

    for at in range(size):
        add(at)
    queue = [(-len(found), pair) for pair, found in places.items()]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        count, pair = heapq.heappop(queue)
        found = places.get(pair, set())
        if len(found) < 2:
            continue
        if len(found) != -count:
            heapq.heappush(queue, (-len(found), pair))
            continue
        name = len(SYMBOLS) + len(rules)
        rules.append(pair)
        touched = set()
        for at in sorted(found):
            follow = after[at]
            if values[at] != pair[0] or follow >= size or values[follow] != pair[1]:
                continue  # it overlapped the one before
            remove(before[at])
            remove(follow)
            values[at], values[follow] = name, -2
            after[at] = after[follow]
            if after[at] < size:
                before[after[at]] = at
            touched |= {add(before[at]), add(at)}
        places.pop(pair, None)
        for other in touched - {None}:
            heapq.heappush(queue, (-len(places[other]), other))
    sequences: list[list[int]] = [[]]
    at = 0
    while at < size:
        if values[at] == -1:
            sequences.append([])
        else:
            sequences[-1].append(values[at])
        at = after[at]
    return rules, sequences[:-1]


def solved(texts: list[str]) -> list[Matrix]:
    """The matrix of each sequence of symbols."""
    rules, sequences = re_pair(texts)
    matrices = [symbol_matrix(symbol) for symbol in SYMBOLS]
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    made = []
    for sequence in sequences:
        whole = matrices[sequence[0]]
        for value in sequence[1:]:
            whole = product(whole, matrices[value])
        made.append(whole)
    return made


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        first = 0
        while first < len(texts):
            last, symbols = first, 0
            while last < len(texts) and (last == first or symbols + len(texts[last]) <= BATCH_SYMBOLS):
                symbols += len(texts[last])
                last += 1
            matrices = solved(texts[first:last])
            keys = [(i, j) for i in STATES for j in STATES]
            costs = [[matrix[key][0] if key in matrix else None for key in keys] for matrix in matrices]
            audits = [["".join(_leaves(matrix[key][1])) if key in matrix else None for key in keys] for matrix in matrices]
            arrays = [pa.array(texts[first:last], pa.string()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["symbols", "costs", "audits"])
            first = last


class _Rows:
    """Rows of a task, given on in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: dict, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars

    def full(self) -> bool:
        return len(self.rows) >= 1000 or self.chars >= 4 * BLOCK_CHARS

    def take(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.chars = [], 0
        return made


def _arrow(frame_schema, names: list[str]):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(frame_schema)
    return pa.schema([schema.field(name) for name in names])


BLOCK = (
    "place bigint, symbols string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, "
    "last_role string, least_turn bigint, greatest_turn bigint, turns bigint, "
    "roles array<string>, texts array<string>"
)
LEGAL = {"su", "ua", "au"}


def _blocks(schema: pa.Schema):
    """Runs of one conversation in sorted rows, cut into blocks with their symbols and what is counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, _Rows(schema)
        block, known, last, chars, number = None, None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                conv, turn, role, text = row["conv"], row["turn"], row["role"], row["text"]
                if block is not None and (block["conv"] != conv or len(block["roles"]) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    block["symbols"] = "".join(block["symbols"])
                    made.add(block, chars)
                    if block["conv"] != conv:
                        last = None
                    block = None
                    if made.full():
                        yield made.take()
                initial = role[:1]
                if block is None:
                    block = {"conv": conv, "place": base + number, "symbols": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                             "first_role": initial, "last_role": "", "least_turn": None, "greatest_turn": None,
                             "turns": 0, "roles": [], "texts": []}
                    number, chars = number + 1, 0
                elif block["last_role"] + initial not in LEGAL:
                    block["illegal"] += 1
                known = (turn, role, row["one"], row["two"])
                symbol = initial if initial in ("s", "u", "a") else "x"
                if row["blank"]:
                    symbol = "D"
                    block["blank"] += 1
                elif row["later"] or known == last:
                    symbol = "D"
                    block["duplicate"] += 1
                elif row["truncated"]:
                    symbol = symbol.upper()
                    block["truncated"] += 1
                if turn is not None:
                    if block["greatest_turn"] != turn:
                        block["turns"] += 1
                    if block["least_turn"] is None:
                        block["least_turn"] = turn
                    block["greatest_turn"] = turn
                last = known
                block["last_role"] = initial
                block["symbols"].append(symbol)
                block["roles"].append(role)
                block["texts"].append(text)
                chars += len(text)
        if block is not None:
            block["symbols"] = "".join(block["symbols"])
            made.add(block)
        if made.rows:
            yield made.take()

    return trimmed(run)


TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
TOTAL_NAMES = [field.split()[0] for field in TOTALS.split(", ")]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(whether a conversation begins, row) of sorted rows."""
    conv, begun = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield not begun or row["conv"] != conv, row
            conv, begun = row["conv"], True


class _Chain:
    """The cheapest way through the blocks of one conversation; of each block it keeps four small numbers."""

    def __init__(self, conv):
        self.conv, self.best, self.blocks = conv, {0: (0, 0)}, []
        self.totals = dict.fromkeys(TOTAL_NAMES, 0)
        self.least = self.last_turn = self.last_role = None

    def add(self, row: dict) -> None:
        reached = {}
        for first, (cost, order) in self.best.items():
            for last in STATES:
                step = row["costs"][4 * first + last]
                if step is None:
                    continue
                offer = (cost + step, order, row["audits"][4 * first + last], first)
                if last not in reached or offer < reached[last]:
                    reached[last] = offer
        # Audits up to here are compared by the order of what led to them, then by their last part.
        in_order = sorted(reached, key=lambda state: reached[state][1:3])
        self.best = {state: (reached[state][0], in_order.index(state)) for state in reached}
        self.blocks.append((row["place"], {state: reached[state][3] for state in reached}))
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.totals[name] += row[name]
        if self.last_role is not None and self.last_role + row["first_role"] not in LEGAL:
            self.totals["illegal"] += 1
        self.last_role = row["last_role"]
        if row["least_turn"] is not None:
            self.totals["gaps"] -= row["turns"] - (self.last_turn == row["least_turn"])
            self.least = row["least_turn"] if self.least is None else self.least
            self.last_turn = row["greatest_turn"]

    def chosen(self) -> Iterator[dict]:
        """The states before and after each block, last block first, with the totals."""
        ends = [(cost + INSERT * len(CLOSING[state]), order, state) for state, (cost, order) in self.best.items()]
        self.totals["cost"], _, state = min(ends)
        if self.least is not None:
            self.totals["gaps"] += self.last_turn - self.least + 1
        closing = CLOSING[state]
        for place, back in reversed(self.blocks):
            yield {"conv": self.conv, "place": place, "before": back[state], "after": state, "closing": closing, **self.totals}
            state, closing = back[state], None


def _choose(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, chain = _Rows(schema), None

        def close() -> Iterator[pa.RecordBatch]:
            if chain is not None:
                for row in chain.chosen():
                    made.add(row)
                    if made.full():
                        yield made.take()

        for begins, row in _runs(batches):
            if begins:
                yield from close()
                chain = _Chain(row["conv"])
            chain.add(row)
        yield from close()
        if made.rows:
            yield made.take()

    return trimmed(run)


def _applied(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each message that the edits leave."""
    at = 0
    for edit in audit:
        if edit in "IR":
            role = "assistant" if state == 2 else "user"
            state = AFTER_NEW[state]
        elif edit == "K":
            role = roles[at]
            state = _keep(state, role[:1])
        if edit != "D":
            yield edit, role, "" if edit == "I" else texts[at]
        at += edit != "I"


def _repaired(schema: pa.Schema, messages: bool):
    """Apply the audits to blocks that follow them; give the messages, or a row for each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Rows(schema)
        total, audits, digest, number = None, [], None, 0
        for begins, row in _runs(batches):
            if begins:
                if total is not None and not messages:
                    made.add({**total, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}, sum(map(len, audits)))
                total, audits, digest, number = None, [], hashlib.sha256(), 0
            if row["audit"] is not None:
                total = {"conv": row["conv"], **{name: row[name] for name in TOTAL_NAMES}}
                audit, state, closing = row["audit"], row["before"], row["closing"] or ""
            else:
                if not messages:
                    audits.append(audit + closing)
                for edit, role, text in _applied(audit + closing, state, row["roles"], row["texts"]):
                    if messages:
                        made.add({"conv": row["conv"], "number": number, "edit": edit, "role": role, "text": text}, len(text))
                    else:
                        digest.update(f"{chr(10) if number else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    number += 1
                    if made.full():
                        yield made.take()
        if total is not None and not messages:
            made.add({**total, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()})
        if made.rows:
            yield made.take()

    return trimmed(run)


def _described(rows: DataFrame) -> DataFrame:
    """Rows with their faults but for repeats in one turn, which the order of the rows shows."""
    rows = rows.withColumn("one", F.xxhash64("role", F.lit(1), "text")).withColumn("two", F.xxhash64("text", F.lit(2), "role"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeats = rows.groupBy("conv", "one", "two").agg(F.count("*").alias("n"), F.min(turn).alias("first")).where("n > 1").drop("n")
    repeats = stage(repeats.toDF("r_conv", "r_one", "r_two", "first"), "repeated-messages")
    rows = attach(rows, ["conv", "one", "two"], repeats, ["r_conv", "r_one", "r_two"])
    visible = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    return rows.select(
        "conv", "turn", "role", "text", "one", "two",
        (visible == "").alias("blank"),
        F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"),
        (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def _in_conversations(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", "place", F.col("audit").isNull())


def _edits(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Blocks of messages, each after a row with its audit, sorted within conversations."""
    spark = messages.sparkSession
    rows = messages.select(
        F.col(conversation).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("one"), F.col("two")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _described(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"conv {kind}, {BLOCK}"
    empty = spark.createDataFrame([], schema).schema
    blocks = stage(ordered.mapInArrow(_blocks(_arrow(empty, empty.names)), schema), "message-blocks")

    solutions = blocks.select("symbols").distinct().mapInArrow(trimmed(_solve), "symbols string, costs array<bigint>, audits array<string>")
    narrow = blocks.drop("roles", "texts").join(stage(solutions, "solutions"), "symbols")
    paths = stage(narrow, "paths")
    schema = f"conv {kind}, place bigint, before int, after int, closing string, {TOTALS}"
    empty = spark.createDataFrame([], schema).schema
    chosen = paths.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_choose(_arrow(empty, empty.names)), schema)
    audit = F.get("audits", (F.col("before") * 4 + F.col("after")).cast("int"))
    taken = chosen.join(paths.select("place", "audits"), "place").withColumn("audit", audit).drop("audits", "after")
    return _in_conversations(taken.unionByName(blocks.select("conv", "place", "roles", "texts"), allowMissingColumns=True))


def repaired(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, number, edit, role, text) of every message of the repaired conversations, numbered from 0."""
    kind = messages.schema[conversation].dataType.simpleString()
    schema = f"conv {kind}, number bigint, edit string, role string, text string"
    empty = messages.sparkSession.createDataFrame([], schema).schema
    return _edits(messages, conversation, turn, role, text).mapInArrow(_repaired(_arrow(empty, empty.names), True), schema)


def summary(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Counts, cost, audit and checksum of the repaired text of every conversation in ``messages``."""
    kind = messages.schema[conversation].dataType.simpleString()
    schema = f"conv {kind}, {TOTALS}, audit string, repaired_sha256 string"
    empty = messages.sparkSession.createDataFrame([], schema).schema
    return _edits(messages, conversation, turn, role, text).mapInArrow(_repaired(_arrow(empty, empty.names), False), schema)


def damaged(messages: DataFrame) -> DataFrame:
    """The messages with faults planted by a checksum of conversation and turn: some are lost, emptied, cut, repeated or re-roled."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key) % 20

    def of(value: int, change: Column, otherwise: Column) -> Column:
        return F.when(fault == value, change).otherwise(otherwise)

    text = F.coalesce("text", F.lit(" "))
    changed = messages.select(
        "conv_id",
        "turn",
        of(4, F.lit("user"), F.coalesce("role", F.lit(" "))).alias("role"),
        of(1, F.lit(""), of(2, F.regexp_replace(text, "[.!?]", ""), text)).alias("text"),
        F.explode(of(3, F.array(F.lit(0), F.lit(1)), of(0, F.array().cast("array<int>"), F.array(F.lit(0))))).alias("copy"),
    )
    return changed.drop("copy")


def damage_summary(messages: DataFrame) -> DataFrame:
    """``summary`` of the damaged messages, with a row for every conversation, also those that lost all messages."""
    found = summary(damaged(messages)).withColumnRenamed("conv", "found_id")
    every = messages.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    zeros = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in TOTAL_NAMES]
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
