"""Chat formatting with Spark expressions only (operator 11).

The turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged by array aggregation, and the blocks are concatenated:

    <s>[SYS] text [/SYS][INST] text [/INST]text</s>[ROLE]name[TEXT]text[/ROLE]

for system, user, assistant and any other role. Turns merged into one block are
parted by ``[NEXT]``, so that each can be read back. A control string inside a
text gets one backslash more after its first character, which reading takes away
again; all control strings begin with their only ``[`` or ``<``, so they never
overlap. The loss mask is a list of spans, one per assistant text, in code points
and in bytes; marks are never under it.

Merging works on slices of ``SLICE`` turns, a block that goes on in the next
slice is left open, so the work is linear in the turns. A conversation is one
string in the end, so its turns meet in one row; that string is its only bound.

Defined cases: rows are ordered by turn (missing first), then role, then text,
and repeated rows stay; a missing text is empty; a missing role is the empty
role; rows without ``conv_id`` are one conversation without id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that one aggregation merges.
SLICE = 64
START, NEXT = "<s>", "[NEXT]"
#: role: (opening mark, closing mark)
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
#: Any other role.
OPEN_ROLE, OPEN_TEXT, CLOSE_ROLE = "[ROLE]", "[TEXT]", "[/ROLE]"
_CONTROL = r"([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|TEXT|NEXT)\]|/?s>)"
_ESCAPED = r"([\[<])\\(\\*)((?:/?(?:SYS|INST|ROLE)|TEXT|NEXT)\]|/?s>)"
_BLOCK = (
    r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[ROLE\].*?\[TEXT\].*?\[/ROLE\]|.*?</s>"
)
_SEEN = "array<struct<role:string,open:boolean,texts:array<string>>>"
_SPAN = "struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>"


def escape(text) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _by_role(role: Column, other: Column, mark: int) -> Column:
    chosen = F.when(role == "system", F.lit(MARKS["system"][mark]))
    for name in ("user", "assistant"):
        chosen = chosen.when(role == name, F.lit(MARKS[name][mark]))
    return chosen.otherwise(other)


def _merge(turns: Column, before: Column) -> Column:
    """Blocks of one slice; the first is open where the turn before had the same role."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        role = F.coalesce(last["role"], before)
        same = F.coalesce(role == turn["role"], F.lit(False))
        grown = F.struct(
            turn["role"].alias("role"), last["open"].alias("open"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")
        )
        fresh = F.struct(turn["role"].alias("role"), same.alias("open"), F.array(turn["text"]).alias("texts"))
        head = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
        joined = F.concat(head, F.array(grown))
        return F.when(same & last.isNotNull(), joined).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.array().cast(_SEEN), add)


def blocks(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the slices of merged blocks (role, open, texts already escaped)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    escaped = sorted_turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("turns"),
    )
    starts = F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / SLICE).cast("int"))
    return escaped.select(
        "conv_id", "n_turns",
        F.transform(
            starts,
            lambda k: _merge(F.slice("turns", k * SLICE + 1, SLICE), F.try_element_at("turns", F.when(k > 0, k * SLICE))["role"]),
        ).alias("slices"),
    )


def _pieces(blocks_of_slice: Column, next_open: Column) -> Column:
    """(head, texts, tail, assistant) of every block of a slice."""
    last = F.size(blocks_of_slice) - 1

    def piece(block: Column, at: Column) -> Column:
        role = block["role"]
        named = F.concat(F.lit(OPEN_ROLE), escape(role), F.lit(OPEN_TEXT))
        goes_on = (at == last) & next_open
        return F.struct(
            F.when(block["open"], F.lit(NEXT)).otherwise(_by_role(role, named, 0)).alias("head"),
            block["texts"].alias("texts"),
            F.when(goes_on, F.lit("")).otherwise(_by_role(role, F.lit(CLOSE_ROLE), 1)).alias("tail"),
            (role == "assistant").alias("loss"),
        )

    return F.transform(blocks_of_slice, piece)


def _running(parts: Column) -> Column:
    """Spans of the assistant texts of one slice, counted from its start, and its length."""

    def over_text(state: Column, text: Column, loss: Column, first: Column) -> Column:
        skip = F.when(first, F.lit(0)).otherwise(F.lit(len(NEXT))).cast("long")
        at, byte_at = state["at"] + skip, state["byte_at"] + skip
        size, bytes_ = F.char_length(text).cast("long"), F.octet_length(text).cast("long")
        span = F.struct(at.alias("start"), size.alias("length"), byte_at.alias("byte_start"), bytes_.alias("byte_length"))
        return F.struct(
            (at + size).alias("at"), (byte_at + bytes_).alias("byte_at"),
            F.when(loss, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
            F.lit(False).alias("first"),
        )

    def over_block(state: Column, part: Column) -> Column:
        head, head_bytes = F.char_length(part["head"]).cast("long"), F.octet_length(part["head"]).cast("long")
        begun = F.struct(
            (state["at"] + head).alias("at"), (state["byte_at"] + head_bytes).alias("byte_at"),
            state["spans"].alias("spans"), F.lit(True).alias("first"),
        )
        inside = F.aggregate(part["texts"], begun, lambda s, t: over_text(s, t, part["loss"], s["first"]))
        return F.struct(
            (inside["at"] + F.char_length(part["tail"])).alias("at"),
            (inside["byte_at"] + F.octet_length(part["tail"])).alias("byte_at"), inside["spans"].alias("spans"),
        )

    zero = F.lit(0).cast("long")
    return F.aggregate(
        parts, F.struct(zero.alias("at"), zero.alias("byte_at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), over_block
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted text and the loss mask (spans of assistant texts as they stand there)."""
    n = F.size("slices")
    opens = lambda k: F.coalesce(F.try_element_at("slices", k + F.lit(2))[0]["open"], F.lit(False))
    parts = blocks(conversations).select(
        "conv_id", "n_turns",
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: _pieces(F.get("slices", k), opens(k))).alias("parts"),
    )
    sliced = parts.select(
        "conv_id", "n_turns",
        F.transform(
            "parts",
            lambda p: F.array_join(
                F.transform(p, lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), b["tail"])), ""
            ),
        ).alias("strings"),
        F.transform("parts", _running).alias("counted"),
    )
    # offsets of the slices: few sums, one a slice
    base = F.struct(F.lit(len(START)).cast("long").alias("at"), F.lit(len(START)).cast("long").alias("byte_at"))

    def next_base(seen: Column, one: Column) -> Column:
        last = F.element_at(seen, -1)
        ahead = F.struct((last["at"] + one["at"]).alias("at"), (last["byte_at"] + one["byte_at"]).alias("byte_at"))
        return F.concat(seen, F.array(ahead))

    based = sliced.withColumn(
        "bases", F.aggregate("counted", F.array(base).cast("array<struct<at:bigint,byte_at:bigint>>"), next_base)
    )

    def moved(one: Column, k: Column) -> Column:
        by = F.get("bases", k)
        return F.transform(
            one["spans"],
            lambda s: F.struct(
                (s["start"] + by["at"]).alias("start"), s["length"].alias("length"),
                (s["byte_start"] + by["byte_at"]).alias("byte_start"), s["byte_length"].alias("byte_length"),
            ),
        )

    return based.select(
        "conv_id", "n_turns", F.concat(F.lit(START), F.array_join("strings", "")).alias("formatted"),
        F.flatten(F.transform("counted", moved)).alias("loss_mask"),
    )


def _block_turns(block: Column) -> Column:
    """(role, text) of every turn of one formatted block."""

    def between(role: str) -> Column:
        head, tail = MARKS[role]
        return block.substr(F.lit(len(head) + 1), F.char_length(block) - len(head) - len(tail))

    other = block.startswith(OPEN_ROLE)
    named = F.substring_index(block, OPEN_TEXT, 1)
    rest = block.substr(F.char_length(named) + len(OPEN_TEXT) + 1, F.char_length(block) - F.char_length(named) - len(OPEN_TEXT) - len(CLOSE_ROLE))
    role = (
        F.when(block.startswith(MARKS["system"][0]), F.lit("system")).when(block.startswith(MARKS["user"][0]), F.lit("user"))
        .when(other, unescape(F.substr(named, F.lit(len(OPEN_ROLE) + 1)))).otherwise(F.lit("assistant"))
    )
    body = (
        F.when(block.startswith(MARKS["system"][0]), between("system")).when(block.startswith(MARKS["user"][0]), between("user"))
        .when(other, rest).otherwise(between("assistant"))
    )
    return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted conversation, in order."""
    body = F.substr(text, F.lit(len(START) + 1))
    return F.flatten(F.transform(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(0)), _block_turns))


def read_loss(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped; bytes are addressed directly."""
    data = text.cast("binary")
    under = F.transform(
        mask, lambda s: unescape(F.substring(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string"))
    )
    return F.array_join(under, "")


def digest(conversations: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations."""
    made = formatted(conversations)
    read = made.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    )
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold the template's own marks.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows and the two turns of the probing conversation."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).unionByName(probe)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)
), marked AS (
  SELECT *,
    regexp_replace(text, '([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|TEXT|NEXT)\]|/?s>)', '\1\\\2\3', 'g') AS shown,
    regexp_replace(role, '([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|TEXT|NEXT)\]|/?s>)', '\1\\\2\3', 'g') AS shown_role,
    row_number() OVER w AS nth,
    lag(role) OVER w AS role_before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(shown) + CASE
      WHEN role = role_before THEN 6
      WHEN role = 'system' THEN 13 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 4
      ELSE 19 + length(shown_role) END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
