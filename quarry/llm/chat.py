r"""Chat formatting into budgeted windows, with DataFrame functions only.

Template: a window is <s> and its turns. [INST] text [/INST] is a user's turn, [SYS] text [/SYS] a system's, [OUT] text</s>
an assistant's, [ROLE] role [SAYS] text [/ROLE] any other role's. Inside texts and roles every control string, and every
string that escaping could be taken for, gets one more backslash after its first character (`</s>` is written `<\/s>`);
reading takes one away, so escaping is reversible for all texts and control strings stand only where the template puts them.

Windows: prefix sums of the turns' tokens cut a conversation into spans, aligned to turns: a turn belongs to the span in
which its prefix sum ends, spans being half of what the budget leaves beside the system turn. Each window repeats the
system turn (if the conversation begins with one) and then the last turns of the window before, as many as fit into the
budget, HISTORY at most. Repeated turns are masked: loss covers each assistant text once, in the window that has it first.
A window exceeds the budget only by a turn that is itself longer than half of it; turns are never cut. A system turn of more
than half the budget stands once, in the first window: repeating it would leave no room and multiply the text.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role and text, and repeated
rows are turns of their own; a null conv_id is a conversation of its own; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, MARKS = 1024, 4, 4
#: What follows the first character of a control string; `[` or `<` and any backslashes stand before it.
CONTROL = r"([\[<])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|OUT\]|SAYS\])"
ESCAPED = r"([\[<])(\\*)\\(/?s>|/?(?:INST|SYS|ROLE)\]|OUT\]|SAYS\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def tokens(text: Column) -> Column:
    """Words, digits and marks of a text, and the template's own share."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]")) + MARKS


def opened(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "assistant", "[OUT] ").when(role == "system", "[SYS] ").otherwise(F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [SAYS] ")))


def closed(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated (leading turns under no loss), loss_spans array<struct<start,length>> (code points)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("size", tokens("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("ends", F.sum("size").over(upto)).withColumn("sys", F.first(F.when((F.col("role") == "system") & (2 * F.col("size") <= budget), F.col("size")).otherwise(0)).over(upto))
    half = F.greatest(F.lit(1), F.floor((budget - F.col("sys")) / 2))
    rows = rows.withColumn("span", F.floor((F.col("ends") - 1) / half))
    spans = rows.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "size"))).alias("turns"), F.sum("size").alias("new"), F.first("sys").alias("sys"))
    along = Window.partitionBy("conv_id").orderBy("span")
    first = F.first(F.when((F.col("turns")[0]["role"] == "system") & (2 * F.col("turns")[0]["size"] <= budget), F.array(F.col("turns")[0]))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    none = F.filter("turns", lambda x: F.lit(False))
    spans = spans.withColumn("window", F.row_number().over(along) - 1).withColumn("head", F.when(F.col("window") > 0, F.coalesce(first, none)).otherwise(none))
    spans = spans.withColumn("past", F.coalesce(F.lag(F.slice(F.reverse("turns"), 1, history)).over(along), none))
    room = budget - F.col("sys") - F.col("new")
    fits = F.aggregate("past", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["sum"] + x["size"]).alias("sum"), (a["n"] + F.when(a["on"] & (a["sum"] + x["size"] <= room) & (x["at"] > F.size("head")), 1).otherwise(0)).alias("n"), (a["on"] & (a["sum"] + x["size"] <= room) & (x["at"] > F.size("head"))).alias("on")))["n"]
    spans = spans.withColumn("again", F.concat("head", F.reverse(F.slice("past", F.lit(1), fits))))
    spans = spans.select("conv_id", "window", F.size("again").alias("n_repeated"), F.concat("again", "turns").alias("turns"))
    said = spans.withColumn("parts", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), opened(t["role"]).alias("open"), escape(t["text"]).alias("text"), closed(t["role"]).alias("close"))))
    said = said.withColumn("formatted", F.concat(F.lit("<s>"), F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["text"], p["close"])), "")))
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    lengths = F.transform("parts", lambda p, i: F.struct(F.length(p["open"]).alias("o"), F.length(p["text"]).alias("t"), F.length(p["close"]).alias("c"), ((p["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("loss")))
    spans_ = F.aggregate(lengths, start, lambda a, x: F.struct((a["at"] + x["o"] + x["t"] + x["c"]).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["o"]).alias("start"), x["t"].alias("length"))))).otherwise(a["spans"]).alias("spans")))["spans"]
    return said.select("conv_id", "window", "formatted", "n_repeated", spans_.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted window."""
    pieces = F.split(F.substr(formatted, F.lit(4)), r" \[/INST\]| \[/SYS\]| \[/ROLE\]|</s>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        role = F.when(p.startswith("[INST] "), "user").when(p.startswith("[OUT] "), "assistant").when(p.startswith("[SYS] "), "system").otherwise(unescape(F.substr(F.substring_index(p, " [SAYS] ", 1), F.lit(8))))
        text = F.when(p.startswith("[INST] "), F.substr(p, F.lit(8))).when(p.startswith("[OUT] ") | p.startswith("[SYS] "), F.substr(p, F.lit(7))).otherwise(F.substr(p, F.instr(p, " [SAYS] ") + 8))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def chat_digest(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per conversation, read back from the windows: turns, their hash, the text under the loss mask, formatted length, windows."""
    w = windows(conversations, budget, history)
    new = F.expr("slice(turns, n_repeated + 1, size(turns))")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    w = w.withColumn("turns", read_turns(F.col("formatted")))
    w = w.select("conv_id", "window", F.size(new).cast("long").alias("n"), F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    per = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    joined = {c: F.array_join(F.col(f"all.{c}"), "") for c in ("said", "loss")}
    return per.select("conv_id", "n_turns", F.sha2(joined["said"].cast("binary"), 256).alias("turns_sha256"), F.length(joined["loss"]).cast("long").alias("loss_chars"), F.sha2(joined["loss"].cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
