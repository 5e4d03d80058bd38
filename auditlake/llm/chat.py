"""Chat formatting: a finite-state machine over roles and a declarative template, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each role: its label in the output, and whether its text is trained on.
TEMPLATE = {
    "system": {"label": "System", "loss": False},
    "user": {"label": "User", "loss": False},
    "assistant": {"label": "Assistant", "loss": True},
}
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: States and the role that leads from one to the next; a missing step is an error.
MACHINE = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
ACCEPTING = ("assistant",)


def escape(text: Column) -> Column:
    """No '#', '<' or ': ' mark of the template is left in the result; unescape() gives the text back."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit("#"), F.lit("&num;"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("&num;"), F.lit("#"))
    text = F.replace(text, F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _label(role: Column, template: dict) -> Column:
    """The template's label; any other role is written as @role with its control characters escaped."""
    other = F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("&colon;")))
    return F.coalesce(F.try_element_at(_map({r: t["label"] for r, t in template.items()}), role), other)


def _role(label: Column, template: dict) -> Column:
    other = unescape(F.replace(F.substring(label, 2, 1 << 30), F.lit("&colon;"), F.lit(":")))
    return F.coalesce(F.try_element_at(_map({t["label"]: r for r, t in template.items()}), label), other)


def state_after(roles: Column, machine: dict = MACHINE) -> Column:
    """The machine's state after an array of roles: 'error' from the first role that no step allows."""
    steps = _map({f"{a} {b}": c for (a, b), c in machine.items()})
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat_ws(" ", s, r)), F.lit("error")))


def format_conversations(turns: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE) -> DataFrame:
    """One row per conv_id: valid, segments array<struct<text, loss>>.

    turns has conv_id, turn, role, text; further columns are ignored. Turns are ordered by turn, then role,
    then text, so ties and repeated rows have one order; null turns come first. A null role or text counts as
    empty; rows with a null conv_id make one conversation with a null id. A conversation that the machine
    rejects is formatted all the same, with valid false. An empty table gives no rows. A conversation is one
    output row, so its turns meet in one task; rows of different conversations do not.
    """
    loss = [r for r, t in template.items() if t["loss"]]
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    groups = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(OPEN), _label(t["role"], template), F.lit(COLON)), no),
                segment(escape(t["text"]), t["role"].isin(loss)),
                segment(F.lit(CLOSE), no),
            ),
        )
    )
    state = state_after(F.col("turns.role"), machine)
    return groups.select("conv_id", state.isin(*ACCEPTING).alias("valid"), segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation, by the marks alone."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        end = F.instr(part, COLON)
        label = F.substring(part, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
        text = F.substring(part, end + len(COLON), F.length(part))
        return F.struct(_role(label, template).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What the formatted conversations hold, read from their text and loss flags."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turns, lost = F.col("turns"), F.col("lost")
    return (
        formatted.withColumn("all", formatted_text(F.col("segments")))
        .withColumn("turns", parse(F.col("all"), template))
        .withColumn("lost", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            sha(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
            F.char_length(lost).cast("long").alias("loss_chars"),
            sha(lost).alias("loss_sha256"),
            F.char_length("all").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
