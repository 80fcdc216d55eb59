"""Chat formatting in budgeted windows.

Turns get the running sum of their tokens within the conversation. Spans are filled in order: a turn that the room has no place for begins the
next one. The first span has the whole budget, so a conversation that fits is one window; later ones have what
history and system turn leave. A conversation is filled in stretches of 64 budgets of the running sum, each by itself, so a
very long one is dealt to many tasks and at most one window in 64 ends early for it. A window is a span with the conversation's system turn before it and as many of the turns just before the span as
fit into the history budget; what is repeated is masked, and so each assistant turn is a target once.

Turns are dealt by ranges of (conversation, turn), so one long conversation lies in many tasks; its running
sum is that within a task plus the sums of the tasks before, a row for each task and conversation that
it shares with another. A window is bounded by its budget or its one long turn, whatever the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import WORD, written
from tarifa.llm.tokens import encoder, tokenizer_path

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Takes the control strings out of a text: a zero after the bar, and one more in what looks like that already."""
    return F.regexp_replace(text, r"<\|(0*)(im_start|im_end)\|>", "<|0$1$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|0(0*)(im_start|im_end)\|>", "<|$1$2|>")


def _order(conv: str = "conv_id") -> list[Column]:
    return [F.col(conv).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text")]


def _counted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows (text last) with n_ids: how many ids a public tokenizer gives the text."""
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True).encode
        for batch in batches:
            n = pa.array([len(ids) for ids in encode(batch.column("text").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, "n_ids"])

    return rows.mapInArrow(count, rows.withColumn("n_ids", F.lit(0).cast("long")).schema)


def _filled(placed: DataFrame, budget: int, history: int, stretch: int = 64) -> DataFrame:
    """placed (conv_id, number, cost, upto, system and others) with span, which rises in the conversation."""
    rows = placed.withColumn("stretch", F.expr(f"(upto - cost) div {budget * stretch}"))
    schema = rows.withColumn("span", F.lit(0).cast("long")).schema

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, span, used, room = None, 0, 0, 0
        for batch in batches:
            spans = []
            for conv, part, number, cost, system in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stretch", "number", "cost", "system")), strict=True):
                if now != (conv, part):
                    # Turns cost something, so a stretch has fewer spans than tokens.
                    now, span, used = (conv, part), part * budget * stretch, 0
                    room = budget if number == 1 else budget - history - system
                elif used + cost > room:
                    span, used, room = span + 1, 0, budget - history - system
                used += cost
                spans.append(span)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.int64())], [*batch.schema.names, "span"])

    return rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "number").mapInArrow(fill, schema)


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, overhead: int = 4, tokens: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """A row for each window of the conversations in turns (conv_id, turn, role, text).

    Gives conv_id, window (rises in the conversation), formatted (the template's text), n_tokens, and segments: for each turn
    in it role, turn, begin and length (of the escaped text in formatted), repeated, and target (under the loss mask: assistant turns
    that aren't repeated). tokenizer is the file of a public tokenizer whose ids count as tokens, tokens a column that counts them otherwise (default: the
    words of a turn); each turn costs ``overhead`` more.

    No window has more than ``budget`` tokens but one that holds a single longer turn and nothing else. A system turn that
    opens a conversation is repeated in each later window that has room for it, unless it takes more than half
    of what the history leaves. The first span of a conversation takes turns while they fit into the budget; the others while they fit into
    the budget less history and system turn. History are the turns just before the span, latest first, while their sum is at
    most ``history`` and what a long turn leaves of the budget.

    Null texts and roles count as empty, null conversations and turns come first and are kept; equal turns are ordered by
    role and text and each kept; an empty table gives no rows; other columns are ignored.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than budget")
    count = tokens if tokens is not None else F.regexp_count("text", F.lit(WORD))
    row = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text")
    )
    if tokenizer:
        # Ranges are drawn from a sample that a job of its own takes, so what is dear is written before.
        row, count = written(_counted(row, tokenizer), "counted"), F.col("n_ids")
    dealt = row.withColumn("cost", count.cast("long") + overhead).drop("n_ids").repartitionByRange(*_order()).withColumn("part", F.spark_partition_id())
    # The bounds of ranges are drawn anew by each run, so they are settled by writing.
    dealt = written(dealt, "turns")
    own = Window.partitionBy("part", "conv_id").orderBy(*_order())
    is_system = F.col("role") == "system"
    # A system turn counts if it is the first of its conversation; the first of a task may be another's.
    opening = F.when(is_system, F.col("cost")).otherwise(0)
    running = dealt.withColumn("upto", F.sum("cost").over(own)).withColumn("number", F.row_number().over(own)).withColumn("opening", F.first(opening).over(own))
    # Conversations in more than one part: two a part at most.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.col("role"), F.xxhash64("text").alias("text"), opening.alias("opening")))
    parts = dealt.groupBy("conv_id", "part").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), first.alias("first"))
    of_conv = Window.partitionBy("conv_id")
    before = parts.withColumn("parts", F.count("*").over(of_conv)).filter("parts > 1")
    earlier = of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("cost_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.first("first.opening").over(of_conv.orderBy("part")).alias("opening_before"),
    )
    placed = running.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    opening = F.coalesce("opening_before", "opening")
    system_cost = F.when(2 * opening <= budget - history, opening).otherwise(0)
    placed = placed.select(
        "conv_id", "part", "turn", "role", "text", "cost", (F.col("upto") + F.coalesce("cost_before", F.lit(0))).alias("upto"), (F.col("number") + F.coalesce("n_before", F.lit(0))).alias("number"), system_cost.cast("long").alias("system"),
    )
    placed = _filled(placed.drop("part"), budget, history).drop("stretch")
    placed = written(placed, "spans")

    # Where each span begins: its history reaches back from there, over as many spans as it takes. Turns and
    # spans meet in stretches of ``history`` tokens; a turn that fits is in reach of the starts in two at most.
    spans = placed.groupBy("conv_id", "span").agg(F.min(F.col("upto") - F.col("cost")).alias("begins"), F.min("number").alias("from"), F.sum("cost").alias("size"), F.max("system").alias("system"))
    spans = spans.withColumn("system", F.when(F.col("size") + F.col("system") <= budget, F.col("system")).otherwise(0))
    spans = spans.withColumn("allowed", F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("system") - F.col("size"))))
    stretch = max(history, 1)
    system = placed.filter("number = 1 AND role = 'system' AND system > 0").select("conv_id", F.struct("number", "turn", "role", "text", F.lit(True).alias("repeated")).alias("item"), "cost")
    turn = F.struct("number", "turn", "role", "text", F.lit(False).alias("repeated")).alias("item")
    again = F.struct("number", "turn", "role", "text", F.lit(True).alias("repeated")).alias("item")
    starts = spans.filter("from > 1 AND allowed > 0").select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "begins", "allowed", F.expr(f"begins div {stretch}").alias("near"))
    # An opening system turn is no history where it is repeated anyway.
    reach = placed.filter((F.col("cost") <= history) & ~((F.col("number") == 1) & (F.col("system") > 0))).withColumn("reach", F.explode(F.expr(f"sequence(upto div {stretch}, (upto - cost + {history}) div {stretch})")))
    repeated = reach.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("reach") == F.col("near"))).filter("s > span AND begins >= upto AND begins - upto + cost <= allowed")
    later = spans.filter("from > 1 AND system > 0").select(F.col("conv_id").alias("c"), F.col("span").alias("s"))
    all_items = (
        placed.select("conv_id", F.col("span").alias("window"), turn, "cost")
        .union(repeated.select("conv_id", F.col("s").alias("window"), again, "cost"))
        .union(later.join(system, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", F.col("s").alias("window"), "item", "cost"))
    )
    grouped = all_items.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("cost").alias("n_tokens"))
    head = lambda x: F.concat(F.lit(START), escape(x["role"]), F.lit("\n"))
    body = lambda x: escape(x["text"])
    tail = F.lit(f"{END}\n")
    made = F.transform("items", lambda x: F.struct(head(x).alias("head"), body(x).alias("body"), x["role"].alias("role"), x["turn"].alias("turn"), x["repeated"].alias("repeated")))
    # Offsets: each turn's text begins after all that is before it and its own head.
    sizes = F.transform("made", lambda m: F.char_length(m["head"]) + F.char_length(m["body"]) + len(END) + 1)
    begin = lambda m, i: F.aggregate(F.slice(F.col("sizes"), 1, i), F.lit(0), lambda a, x: a + x) + F.char_length(m["head"])
    segments = F.transform(
        "made",
        lambda m, i: F.struct(
            unescape(m["role"]).alias("role"), m["turn"].alias("turn"), begin(m, i).alias("begin"), F.char_length(m["body"]).alias("length"), m["repeated"].alias("repeated"), ((m["role"] == "assistant") & ~m["repeated"]).alias("target")
        ),
    )
    formatted = F.array_join(F.transform("made", lambda m: F.concat(m["head"], m["body"], tail)), "")
    return grouped.select("conv_id", "window", "n_tokens", made.alias("made")).withColumn("sizes", sizes).select("conv_id", "window", formatted.alias("formatted"), "n_tokens", segments.alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of windows(), read from the formatted texts: conv_id, window, position, role, text (unescaped), target and n_chars (of the window).

    Repeated turns are left out, so each turn comes once.
    """
    each = formatted.select("conv_id", "window", "formatted", F.posexplode("segments").alias("position", "s")).filter("NOT s.repeated")
    head = F.substring_index(F.substring("formatted", F.lit(1), F.col("s.begin")), START, -1)
    role = F.substring(head, F.lit(1), F.char_length(head) - 1)
    text = F.substring("formatted", F.col("s.begin") + 1, F.col("s.length"))
    return each.select("conv_id", "window", "position", unescape(role).alias("role"), unescape(text).alias("text"), "s.target", F.char_length("formatted").alias("n_chars"))
