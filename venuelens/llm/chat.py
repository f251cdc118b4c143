r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "<s>[INST] " content " [/INST]"          user
                 | "<s><<SYS>>\n" content "\n<</SYS>>"      system
                 | "<s>[ROLE:" role "] " content " [/ROLE]" other roles, percent-encoded
                 | "<s>" content "</s>"                     assistant, the only content under the loss mask

Content holds no control string. A backslash behind the first character of a control string takes its meaning away, and
one more is put where some are already, so that reading is the exact reverse. A turn is rendered as it is and read
again; if what is read differs from the source, its content is escaped, until it is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import map_rows, narrow

_AFTER = {"<": r"(?:/?s>|</?SYS>>)", "[": r"(?:/?INST\]|ROLE:|/ROLE\])"}
CONTROL = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|\[ROLE:|\[/ROLE\]")
_ESCAPE = re.compile(rf"(<(?=\\*{_AFTER['<']})|\[(?=\\*{_AFTER['[']}))")
_UNESCAPE = re.compile(rf"(?:(<)\\(?=\\*{_AFTER['<']})|(\[)\\(?=\\*{_AFTER['[']}))")

TAILS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("", "</s>")}
ROLE = re.compile(r"\[ROLE:([^\]]*)\] ")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or m[2], text)


def render(role: str, content: str) -> str:
    head, tail = TAILS.get(role) or (f"[ROLE:{quote(role, safe='')}] ", " [/ROLE]")
    return f"<s>{head}{content}{tail}"


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, start and end of the content, end of the turn) of the turn at ``at``; ValueError if there is none."""
    if not text.startswith("<s>", at):
        raise ValueError(f"no turn at {at}")
    at += 3
    other = ROLE.match(text, at)
    role = next((r for r in ("user", "system") if text.startswith(TAILS[r][0], at)), "assistant")
    start, tail = at + len(TAILS[role][0]), TAILS[role][1]
    if other:
        role, start, tail = unquote(other[1]), other.end(), " [/ROLE]"
    end = text.find(tail, start)
    if end < 0 or CONTROL.search(text, start, end):
        raise ValueError(f"open or ambiguous content at {start}")
    return role, unescape(text[start:end]), start, end, end + len(tail)


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        role, content, _, _, at = parse_turn(text, at)
        turns.append((role, content))
    return turns


def format_turn(role: str, text: str) -> str:
    """The rendered turn that reads back as (role, text)."""
    content = text
    for _ in range(2):
        rendered = render(role, content)
        try:
            if parse(rendered) == [(role, text)]:
                return rendered
        except ValueError:
            pass
        content = escape(text)
    raise ValueError(f"turn of role {role!r} does not survive the round trip")


def format_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    for conv_id, turn, role, text in rows:
        yield conv_id, turn, format_turn(role or "", text or "")


def formatted_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Every turn rendered, in any order; a conversation is the concatenation of its turns by turn number."""
    return map_rows(narrow(conversations, conv_id=conv_id, turn=turn, role=role, text=text), format_rows,
                    "conv_id long, turn long, formatted string")


def read_conversations(rows: Iterable[tuple], with_text: bool) -> Iterator[tuple]:
    """Digests of turns that arrive in order of conversation and turn; of a conversation only the hashes are held."""
    current: object = ...

    def result():
        return (current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, "".join(held) if with_text else None,
                masks if with_text else None)

    for conv_id, _, formatted in rows:
        if conv_id != current or current is ...:
            if current is not ...:
                yield result()
            current, n, loss_chars, chars = conv_id, 0, 0, 0
            turns, loss, held, masks = hashlib.sha256(), hashlib.sha256(), [], []
        at = 0
        while at < len(formatted):
            role, text, start, end, at = parse_turn(formatted, at)
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                loss.update(text.encode())
                loss_chars += len(text)
                if with_text:
                    masks.append({"start": chars + start, "end": chars + end})
        chars += len(formatted)
        if with_text:
            held.append(formatted)
    if current is not ...:
        yield result()


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per conversation, read back from its formatted text; with the text and its loss mask if ``with_text``.

    A null text is empty, a null role is the empty role, a null turn comes first, equal turns are ordered by their
    rendering and equal rows all count; a null id is a conversation of its own. An empty table gives no rows.
    Other columns are not read. Turns are rendered and checked where they are read; a conversation's turns then stream
    through one task in order, as its digest needs, without being held.
    """
    turns = formatted_turns(conversations, conv_id, turn, role, text)
    in_order = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted")

    def run(rows):
        return read_conversations(rows, with_text)

    return map_rows(in_order, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                    "formatted_chars long, formatted string, loss_mask array<struct<start: long, end: long>>")
