"""Chat formatting in budgeted windows. DataFrame operations only.

A turn's tokens are the words of its text and one more for its marks. Prefix sums of them choose windows of whole turns: a window
takes new turns while they fit the budget that is left after the system turn and the history. Each window starts with the
conversation's first system turn (if it isn't among the new turns) and the last turns before the window that fit `history` tokens.
These are repeats: only assistant turns that are new are under the loss mask, so each is learnt once.

The budget holds: a turn that doesn't fit beside the repeats has less history, or none, and no system turn if even that one leaves
no room; a turn longer than the budget is a window of its own without repeats, the only window that is longer. A system
turn of more than half the budget is given once, in its place, and isn't repeated.

A conversation of any length is many rows of bounded size: places and prefix sums are carried over sorted ranges of turns, and each
stretch of SPAN tokens is one row, in which a fold over prefix sums cuts the windows. History crosses the borders of spans; a window
doesn't, so the last one of each span may be shorter than the budget allows.

A turn is `<|turn|>role\\n` text `<|end|>\\n`. In roles and texts, every control string is replaced by U+001A and a code,
U+001A itself first, so nothing inside a text reads as markup and unescape() gives the text back.

Defined cases: a null text or role is empty; turns with equal number are ordered by role and text; a null turn number comes
first; repeated rows are turns of their own; a conversation with a null id is a conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, word_count

BUDGET, HISTORY = 2048, 256
#: Tokens of a span; every turn has one at least, so a span has no more turns than that.
SPAN = 65_536
TURN, END = "<|turn|>", "<|end|>\n"
ESC = "\x1a"
#: Strings with a meaning to this or another common template, in order of replacement; the code is the place in this list. Line ends only in roles.
CONTROL = [ESC, "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n"]


def _code(k: int) -> str:
    return f"{ESC}{k}"


def escape(text, role: bool = False):
    for k, s in enumerate(CONTROL if role else CONTROL[:-1]):
        text = F.replace(text, F.lit(s), F.lit(_code(k)))
    return text


def unescape(text):
    for k, s in reversed(list(enumerate(CONTROL))):
        text = F.replace(text, F.lit(_code(k)), F.lit(s))
    return text


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with _pos (from 1), _upto (tokens up to and with the turn) and _first (whether it is the first system turn), counted within
    the conversation; and the first system turns: _sc, _system (seg, tok).

    The turns are sorted over ranges, and a conversation's places and sums are carried from range to range, so none needs one task.
    """
    order = [F.col("_c").asc_nulls_first(), F.col("_t").asc_nulls_first(), F.col("_role").asc(), F.col("_text").asc()]
    dealt = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "chat-turns")
    is_system = F.col("_role") == "system"
    sums = dealt.groupBy("_c", "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_tok").alias("_sum"), F.count_if(is_system).alias("_ns"), F.min(F.when(is_system, F.struct("_t", "_text", "_tok"))).alias("_s"),
    )
    sums = durable(sums, "chat-sums")
    system = sums.where("_s is not null").groupBy("_c").agg(F.min_by("_s", "_range").alias("_s"))
    system = system.select(F.col("_c").alias("_sc"), F.struct(_segment(F.lit("system"), F.col("_s._text")).alias("seg"), F.col("_s._tok").alias("tok")).alias("_system"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("_c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("_c").alias("_sc"), F.col("_range").alias("_sr"), before("_n").alias("_n0"), before("_sum").alias("_sum0"), before("_ns").alias("_ns0"))
    line = Window.partitionBy("_c", "_range").orderBy(*order[1:])
    upto = lambda c: F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, 0))
    local = dealt.withColumn("_pos", F.row_number().over(line)).withColumn("_upto", upto(F.col("_tok"))).withColumn("_ns", upto(is_system.cast("long")))
    found = local.join(sums, local["_c"].eqNullSafe(sums["_sc"]) & (local["_range"] == sums["_sr"]))
    return found.select(
        "_c", "_role", "_text", "_tok", (F.col("_pos") + F.col("_n0")).alias("_pos"), (F.col("_upto") + F.col("_sum0")).alias("_upto"), (is_system & (F.col("_ns") + F.col("_ns0") == 1)).alias("_first")
    ), system


def _opening(role):
    return F.concat(F.lit(TURN), escape(role, role=True), F.lit("\n"))


def _segment(role, text):
    return F.concat(_opening(role), escape(text), F.lit(END))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per window: <conv_col>, span, window, n_repeated, n_new, tokens, formatted, loss (array of start, end in characters of formatted)."""
    rows = turns.select(
        F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    rows, system = _placed(rows.withColumn("_tok", word_count(F.col("_text")) + 1))
    system = system.where(F.col("_system.tok") * 2 <= budget)

    # a turn goes to the span that it starts in, and to later ones whose history it may be in
    start = F.col("_upto") - F.col("_tok")
    own = F.floor(start / SPAN)
    rows = rows.select(
        "_c", "_pos", "_upto", "_tok", _segment(F.col("_role"), F.col("_text")).alias("_seg"), F.length(_opening(F.col("_role"))).alias("_pre"),
        (F.col("_role") == "assistant").alias("_goal"), "_first", own.alias("_own"), F.explode(F.sequence(own, F.floor((start + history) / SPAN))).alias("_span"),
    )
    item = F.struct("_pos", "_upto", "_tok", "_seg", "_pre", "_goal", "_first", (F.col("_own") < F.col("_span")).alias("_old"))
    spans = rows.groupBy("_c", "_span").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    spans = spans.withColumn("_turns", F.filter("_all", lambda t: ~t["_old"])).withColumn("_tail", F.filter("_all", lambda t: t["_old"])).drop("_all").where(F.size("_turns") > 0)
    spans = spans.join(system, spans["_c"].eqNullSafe(system["_sc"]), "left").drop("_sc")

    # the position at which each window starts: a fold over prefix sums
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("_system.tok", F.lit(0)))
    first = F.aggregate(
        "_turns",
        F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<bigint>").alias("at")),
        lambda s, t: F.when(
            (F.size(s["at"]) == 0) | (t["_upto"] - s["base"] > room),
            F.struct((t["_upto"] - t["_tok"]).alias("base"), F.concat(s["at"], F.array(t["_pos"])).alias("at")),
        ).otherwise(s),
        lambda s: s["at"],
    )
    spans = spans.withColumn("_at", F.transform(first, lambda p: (p - F.get("_turns", F.lit(0))["_pos"] + 1).cast("int")))
    windows = spans.select("_c", "_span", "_turns", "_tail", "_system", "_at", F.posexplode("_at").alias("window", "_start"))
    stop = F.coalesce(F.get("_at", F.col("window") + 1), F.size("_turns") + 1)
    windows = windows.withColumn("_stop", stop).withColumn("_base", F.element_at("_turns", F.col("_start"))["_upto"] - F.element_at("_turns", F.col("_start"))["_tok"])
    windows = windows.withColumn("_new", F.slice("_turns", F.col("_start"), F.col("_stop") - F.col("_start")))
    # what the new turns leave of the budget: for the system turn first, then for history
    left = F.lit(budget) - (F.element_at("_new", -1)["_upto"] - F.col("_base"))
    leads = F.coalesce((F.col("_system.tok") <= left) & ~F.exists("_new", lambda t: t["_first"]), F.lit(False))
    windows = windows.withColumn("_leads", leads).withColumn("_back", F.least(F.lit(history), left - F.when(F.col("_leads"), F.col("_system.tok")).otherwise(0)))
    earlier = F.concat("_tail", F.slice("_turns", F.lit(1), F.col("_start") - 1))
    back = F.filter(earlier, lambda t: (F.col("_base") - t["_upto"] + t["_tok"] <= F.col("_back")) & ~(F.col("_leads") & t["_first"]))
    part = lambda seg, pre, tok, goal: F.struct(seg.alias("seg"), pre.alias("pre"), tok.alias("tok"), goal.alias("goal"))
    lead = F.when(F.col("_leads"), F.array(part(F.col("_system.seg"), F.lit(0), F.col("_system.tok"), F.lit(False))))
    windows = windows.withColumn("_lead", F.concat(F.coalesce(lead, F.array().cast("array<struct<seg:string,pre:int,tok:bigint,goal:boolean>>")), F.transform(back, lambda t: part(t["_seg"], t["_pre"], t["_tok"], F.lit(False)))))
    windows = windows.withColumn("_parts", F.concat("_lead", F.transform("_new", lambda t: part(t["_seg"], t["_pre"], t["_tok"], t["_goal"]))))
    spot = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["seg"])).alias("at"),
            F.when(p["goal"], F.concat(s["out"], F.array(F.struct((s["at"] + p["pre"]).alias("start"), (s["at"] + F.length(p["seg"]) - len(END)).alias("end"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return windows.select(
        F.col("_c").alias(conv_col),
        F.col("_span").alias("span"),
        "window",
        F.size("_lead").alias("n_repeated"),
        (F.col("_stop") - F.col("_start")).alias("n_new"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["tok"]).alias("tokens"),
        F.concat_ws("", F.transform("_parts", lambda p: p["seg"])).alias("formatted"),
        spot.alias("loss"),
    )


def read_back(windows: DataFrame, conv_col="conv_id") -> DataFrame:
    """From the formatted windows alone: the new turns (array of role, text) and the text under the loss mask, unescaped."""
    segments = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.lit(2) + F.col("n_repeated"), F.col("n_new"))
    turn = lambda s: F.struct(
        unescape(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, F.lit("\n")) + 1, F.length(s) - F.instr(s, F.lit("\n")) - len(END))).alias("text"),
    )
    masked = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return windows.select(F.col(conv_col).alias("_c"), "span", "window", F.transform(segments, turn).alias("turns"), F.concat_ws("", masked).alias("loss_text"), F.length("formatted").alias("chars"))


def chat_digests(windows: DataFrame, conv_col="conv_id") -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is of the whole conversation, so this holds its text in one row; windows themselves never are that long.
    """
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    each = read_back(windows, conv_col).select("_c", "chars", F.size("turns").alias("n"), F.struct("span", "window", said.alias("said"), F.col("loss_text").alias("lost")).alias("w"))
    whole = each.groupBy("_c").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("_ws"))
    lost = F.concat_ws("", F.transform("_ws", lambda w: w["lost"]))
    return whole.select(
        F.col("_c").alias(conv_col),
        "n_turns",
        F.sha2(F.concat_ws("", F.transform("_ws", lambda w: w["said"])), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
