"""Chat formatting by a finite-state machine over roles, in DataFrame functions.

A :class:`Template` declares the marks around a turn, which roles train (their
text is under the loss mask) and which role may follow which.  Control strings
inside texts are escaped, so that a formatted conversation reads back to exactly
its turns: a backslash is doubled, and ``<|`` becomes ``<\\|``; in roles a line
break becomes ``<\\n>`` besides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = ""  # the state before the first turn


@dataclass(frozen=True)
class Template:
    """``begin role + "\\n" + text + end`` for each turn."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trains: tuple[str, ...] = ("assistant",)
    #: State (the last role; START before the first turn) to the roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


    def __post_init__(self):
        if not (self.begin.startswith("<|") and self.end.startswith("<|")) or self.begin in self.end:
            raise ValueError("marks begin with '<|', which is escaped inside texts, and the end mark does not hold the begin mark")


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_turns(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text, segment, begins, text_chars,
    loss, legal``.

    ``segment`` is the formatted turn; ``begins`` the code points of the
    conversation before its (escaped) text, ``text_chars`` that text's; ``loss``
    whether the text trains; ``legal`` whether the state machine allows the turn.
    Null role and text count as empty; turns of equal number (null first) go by
    role, then text; repeated rows stay.  A text of any length is one value.
    Extra columns are ignored.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    allowed = F.lit(False)
    state = F.lag("role", 1, START).over(w)
    for before, after in template.follows.items():
        first = F.row_number().over(w) == 1
        here = first if before == START else ~first & (state == before)
        allowed = allowed | (here & F.col("role").isin(*after))
    marked = plain.withColumns({"legal": allowed, "escaped": escape(F.col("text")), "opening": F.concat(F.lit(template.begin), escape_role(F.col("role")), F.lit("\n"))})
    marked = marked.withColumns({"segment": F.concat("opening", "escaped", F.lit(template.end)), "text_chars": F.char_length("escaped").cast("long"), "loss": F.col("role").isin(*template.trains)})
    before = F.coalesce(F.sum(F.char_length("segment").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("begins", before + F.char_length("opening")).select("conv_id", "turn", "role", "text", "segment", "begins", "text_chars", "loss", "legal")


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, valid, n_turns``.

    ``loss_spans`` are (begins, chars) in code points of ``formatted``, in order;
    ``valid``: the state machine accepts every turn.  A null conv_id is a
    conversation too.  A conversation is one value and so is put together in one
    task; only its own rows meet there.  An empty table gives no row.
    """
    each = format_turns(turns, template)
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    listed = each.withColumn("at", F.row_number().over(w)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "segment", "begins", "text_chars", "loss"))).alias("parts"), F.bool_and("legal").alias("valid"), F.count(F.lit(1)).alias("n_turns")
    )
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["begins"].alias("begins"), p["text_chars"].alias("chars")))
    return listed.select("conv_id", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"), spans.alias("loss_spans"), "valid", "n_turns")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, _literal(template.begin))  # the begin mark cannot stand inside a role or text
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    cut = len(template.end)

    def turn(body: Column) -> Column:
        whole = F.left(body, F.char_length(body) - cut)
        at = F.instr(whole, "\n")
        return F.struct(unescape_role(F.left(whole, at - 1)).alias("role"), unescape(F.substr(whole, at + 1)).alias("text"))

    return F.transform(bodies, turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["begins"] + 1).cast("int"), s["chars"].cast("int")))), "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests read back from the formatted conversations.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    valid``.  Null role and text count as empty, a null conv_id is a conversation,
    equal turns go by role, then text, and repeated rows are turns each; an empty
    table gives no row; columns besides these four are ignored.
    """
    done = format_conversations(turns, template).select("conv_id", "formatted", "valid", read_turns(F.col("formatted"), template).alias("back"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("trained"))
    listing = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
