"""Chat formatting in budgeted windows; DataFrame operations only.

A conversation's turns get running sums of tokens. Turns fill a window as long as the sum since its start fits the budget; then a
new window starts, at a turn. Each later window repeats the system turn (a first turn of that role) and up to two turns of
history that fit the history budget; what is repeated is never under the loss mask. So every assistant text is a target exactly once. A
turn that is longer than the budget has a window of its own, whole.

A turn is written as ``<s>[role]``, a line feed, the text, ``</s>``, a line feed. Control characters inside roles and texts are
written as entities, so texts that hold the template's own marks come back as they were.

One row holds one conversation, which is the training document and what the digests cover; nothing is cut. Defined cases: null roles and texts are
empty; rows of one turn number are ordered by role and text; a null conversation id is one conversation; repeated rows are turns; an empty
table gives none; columns other than the four that are read are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD

BUDGET, HISTORY = 1024, 256
#: Tokens that the marks of a turn take.
MARKS = 4
#: Control characters and what stands for them; the first is written first and read last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))
TURN = r"<s>\[([^\]]*)\]\n([^<]*)</s>\n"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Words, and the marks of the turn."""
    return (F.regexp_count(text, F.lit(WORD)) + MARKS).cast("long")


def _plan(turns: Column, system: Column, budget: int, history: int) -> Column:
    """Window starts: array of (at, hist): the first new turn, and the turns of history before it. Turns carry running sums of tokens (``upto``)."""
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(None).cast("long").alias("base"),  # what the window's sums are counted from
        F.lit(0).cast("long").alias("p1"),
        F.lit(0).cast("long").alias("p2"),
        F.array().cast("array<struct<at:int,hist:int>>").alias("starts"),
    )

    def step(s: Column, t: Column) -> Column:
        first = s["i"] == 0
        fits = s["base"].isNotNull() & (t["upto"] - s["base"] <= budget)
        done = s["i"] - (system > 0).cast("int")  # body turns before this one
        room = budget - system - t["tok"]
        two, one = s["p1"] + s["p2"], s["p1"]
        hist = F.when((done >= 2) & (two <= history) & (two <= room), 2).when((done >= 1) & (one <= history) & (one <= room), 1).otherwise(0)
        before = F.when(hist == 2, two).when(hist == 1, one).otherwise(F.lit(0).cast("long"))
        opened = F.struct(s["i"].alias("at"), hist.cast("int").alias("hist"))
        # the first window counts its own system turn; later ones repeat it
        base = F.when(first, F.lit(0).cast("long")).when(fits, s["base"]).otherwise(t["upto"] - t["tok"] - before - system)
        return F.struct((s["i"] + 1).alias("i"), base.alias("base"), t["tok"].alias("p1"), F.when(first & (system > 0), F.lit(0).cast("long")).otherwise(s["p1"]).alias("p2"), F.when(first | ~fits, F.concat(s["starts"], F.array(opened))).otherwise(s["starts"]).alias("starts"))

    return F.aggregate(turns, start, step)["starts"]


def format_windows(df: DataFrame, conv_col: str = "conv_id", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: the conversation, ``window_no``, ``formatted``, ``n_repeated`` (turns repeated at its head), ``n_new``,
    ``tokens``, and ``loss_spans``, the array of (start, length) in code points that are under the loss mask."""
    conv = F.col(conv_col)
    text = F.coalesce("text", F.lit(""))
    rows = df.select(conv, F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), token_count(text).alias("tok"))
    order = Window.partitionBy(conv_col).orderBy("turn", "role", "text")
    summed = rows.withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = summed.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "tok", "upto"))).alias("turns"))
    head = F.get(F.col("turns"), F.lit(0))
    whole = whole.withColumn("system", F.when(head["role"] == "system", head["tok"]).otherwise(F.lit(0).cast("long")))
    whole = whole.withColumn("starts", _plan(F.col("turns"), F.col("system"), budget, history))
    has_system = (F.col("system") > 0).cast("int")

    def window(w: Column, k: Column) -> Column:
        following = F.get(F.col("starts"), k + 1)["at"]
        end = F.coalesce(following, F.size("turns"))
        new = F.slice("turns", w["at"] + 1, end - w["at"])
        again = F.when(k > 0, F.concat(F.slice("turns", F.lit(1), has_system), F.slice("turns", w["at"] - w["hist"] + 1, w["hist"]))).otherwise(F.slice("turns", 1, 0))
        return F.struct(k.alias("window_no"), again.alias("again"), new.alias("new"))

    each = whole.select(conv_col, F.explode(F.transform("starts", window)).alias("w")).select(conv_col, "w.*")

    def rendered(turn: Column, target: Column) -> Column:
        head_text = F.concat(F.lit("<s>["), escaped(turn["role"]), F.lit("]\n"))
        return F.struct(head_text.alias("head"), escaped(turn["text"]).alias("body"), target.alias("target"))

    parts = each.select(
        conv_col,
        "window_no",
        F.concat(F.transform("again", lambda t: rendered(t, F.lit(False))), F.transform("new", lambda t: rendered(t, t["role"] == "assistant"))).alias("parts"),
        F.size("again").alias("n_repeated"),
        F.size("new").alias("n_new"),
        F.aggregate(F.concat("again", "new"), F.lit(0).cast("long"), lambda s, t: s + t["tok"]).alias("tokens"),
    )
    close = "</s>\n"

    def advance(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.struct(at.alias("start"), size.alias("length"))
        return F.struct((at + size + len(close)).alias("at"), F.when(p["target"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return parts.select(
        conv_col,
        "window_no",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(close))), "").alias("formatted"),
        "n_repeated",
        "n_new",
        "tokens",
        F.aggregate("parts", zero, advance)["spans"].alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What formatted windows hold, from their text and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    roles, bodies = (F.regexp_extract_all("formatted", F.lit(TURN), F.lit(i)) for i in (1, 2))
    turns = F.zip_with(roles, bodies, lambda r, b: F.concat(unescaped(r), F.lit("\n"), unescaped(b), F.lit("\n")))
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.size(turns))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    parsed = windows.select(conv_col, "window_no", fresh.alias("fresh"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("size"))
    joined = parsed.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("window_no", "fresh", "loss", "size"))).alias("w"))
    turn_list = F.flatten(F.transform("w", lambda x: x["fresh"]))
    loss_text = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return joined.select(
        conv_col,
        F.size(turn_list).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn_list, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["size"]).alias("formatted_chars"),
    )
