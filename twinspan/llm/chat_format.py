"""Conversations as training windows of whole turns under a token budget.

A conversation's turns lie on a line of tokens. Prefix sums cut that line into cells of the
budget for new turns; a cell's turns make one window, and the turn that crosses into the next
cell makes one of its own, so a window holds more than its budget only if a single turn does.
Each window starts with the conversation's system turn and as many earlier turns as the
history budget allows. Repeated turns are masked: every assistant text is a target once.

No step needs a conversation's turns in one task: prefix sums come from a global sort, and
windows are put together one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.llm.ranks import with_row_numbers
from twinspan.operators.store import stage

#: Marks of a turn: open, role, line break, text, close.
OPEN, CLOSE = "<s>", "</s>"
#: Characters that begin a control string, and what stands for them inside a text. The first
#: comes first when escaping and last when reading back. A role's line break is escaped too.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE_BREAK = ("\n", "&#10;")
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"
#: Tokens of new turns and of repeated history in a window.
NEW_TOKENS = 1024
HISTORY_TOKENS = 512
NO_ID = -(1 << 63)


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: str) -> str:
    for raw, safe in reversed((*ESCAPES, LINE_BREAK)):
        text = text.replace(safe, raw)
    return text


def token_count(text: Column) -> Column:
    """A tokenizer-free count: words and single marks, plus the turn's own three."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")) + 3).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").alias("turn"),
        role.alias("role"), text.alias("text"), token_count(text).alias("tokens"))


def chat_windows(conversations: DataFrame, new_tokens: int = NEW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window LONG, formatted STRING, new_from INT, loss ARRAY<STRUCT<start, end>>, n_tokens LONG.

    Offsets count code points of ``formatted``; what lies before new_from is repeated from
    earlier windows; the spans of ``loss`` are the escaped target texts. Turns come in order
    of turn (nulls first), then role, then text. A null text or role is empty; a null conv_id
    is a conversation of its own. Repeated rows are turns of their own. Further columns are
    not read. An empty table gives no window.
    """
    order = [F.col(c) for c in ("conv", "turn", "role", "text")]
    numbered = with_row_numbers(_turns(conversations), order, "chat-order", "tokens")
    starts = stage(numbered.groupBy("conv").agg(F.min(F.col("running") - F.col("tokens")).alias("zero")), "chat-starts")
    placed = numbered.join(starts, "conv").withColumn("at", F.col("running") - F.col("tokens") - F.col("zero"))
    cell = F.expr(f"at DIV {new_tokens}")
    crosses = (F.col("at") % new_tokens + F.col("tokens") > new_tokens).cast("long")
    turns = stage(placed.select(
        "conv", "row_number", "role", "text", "tokens", "at", (2 * cell + crosses).alias("window"),
        ((F.col("at") == 0) & (F.col("role") == SYSTEM_ROLE)).alias("is_system")), "chat-turns")
    windows = stage(turns.groupBy("conv", "window").agg(F.min("at").alias("begin")), "chat-windows")

    own = turns.select("conv", "window", "row_number", F.lit(2).alias("kind"))
    # A turn is history of the few windows that begin within reach behind it.
    last = F.expr(f"2 * ((at + {history_tokens}) DIV {new_tokens}) + 1")
    reach = turns.filter("NOT is_system").select(
        "conv", "row_number", "at", "tokens", F.explode(F.sequence(F.col("window") + 1, F.greatest(last, F.col("window") + 1))).alias("window"))
    history = reach.join(windows, ["conv", "window"]).filter(
        f"at + tokens <= begin AND at >= begin - {history_tokens}").select("conv", "window", "row_number", F.lit(1).alias("kind"))
    first = stage(turns.filter("is_system").select("conv", "row_number", F.col("window").alias("home")), "chat-system")
    system = windows.join(first, "conv").filter("window != home").select("conv", "window", "row_number", F.lit(0).alias("kind"))

    parts = own.unionAll(history).unionAll(system).join(turns.select("row_number", "role", "text", "tokens"), "row_number")
    safe_role = F.replace(escape(F.col("role")), F.lit(LINE_BREAK[0]), F.lit(LINE_BREAK[1]))
    piece = F.concat(F.lit(OPEN), safe_role, F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    parts = parts.withColumns({
        "piece": piece, "skip": F.length(safe_role) + len(OPEN) + 1,
        "target": (F.col("kind") == 2) & (F.col("role") == TARGET_ROLE)})
    # A window's turns are bounded by its budgets.
    held = parts.groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "row_number", "piece", "skip", "target"))).alias("parts"),
        F.sum("tokens").alias("n_tokens"))
    spans = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)"
    loss = F.expr(f"""
        aggregate(parts, named_struct('pos', 0, 'spans', {spans}),
          (acc, p) -> named_struct(
            'pos', acc.pos + length(p.piece),
            'spans', IF(p.target, concat(acc.spans, array(named_struct(
                'start', acc.pos + p.skip, 'end', acc.pos + length(p.piece) - {len(CLOSE)}))), acc.spans)),
          acc -> acc.spans)""")
    return held.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "window",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.expr("aggregate(filter(parts, p -> p.kind < 2), 0, (n, p) -> n + length(p.piece))").alias("new_from"),
        loss.alias("loss"), "n_tokens")


_TURN = re.compile(f"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a window, unescaped."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows.

    A digest of a text is a chain, so a conversation's windows pass one task; they stream
    through it in order, and only the digests' states are held.
    """
    schema = "conv_id LONG, n_turns LONG, turns_sha256 STRING, loss_chars LONG, loss_sha256 STRING, formatted_chars LONG"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def close() -> None:
            if state:
                conv, n, turns, chars, loss, total = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "new_from", "loss")]
            for conv, formatted, new_from, spans in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted[new_from:]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
                done.clear()
        close()
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.select("conv_id", "formatted", "new_from", "loss").mapInArrow(run, schema)
