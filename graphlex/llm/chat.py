"""Chat formatting: roles recovered from raw transcripts by a hidden Markov model, then rendered canonically.

States are (role, first line or later line of a turn). A line's observation is what speaker marker it starts with (none, one of a
role's usual names, or another name) and the line's features: empty, after an empty line, a question, length. Transitions
and emissions are add-one counts over a bounded sample of conversations whose roles are known, written out as transcripts in several
styles, some turns without a marker. Viterbi gives the most probable state of each line; a turn starts at each first-line state
and at each later-line state whose role differs from the line before.

Null texts are empty, null roles count as unknown and are not learned from. A conversation of more than `segment` turns is parsed
in segments of that many, by turn number; null turn numbers come first. Ties in turn go by role and text. Without training rows every
line is a user's. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import received, share, table

ROLES = ("system", "user", "assistant")
NAMES = {
    "system": ("system", "sys", "context"),
    "user": ("user", "human", "question", "q", "instruction", "prompt", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "model"),
}
#: How transcripts write a speaker, for (system, user, assistant).
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("<sys> ", "<user> ", "<bot> "),
    ("Context: ", "Q: ", "A: "),
    ("**System:** ", "**User:** ", "**Assistant:** "),
)
_OF = {name: k + 1 for k, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"\s*(?:(?:#+\s*|\*\*|[\[<(])\s*([A-Za-z]{1,20})\s*(?::\s*\*\*|:|[\]>)]:?)|([A-Za-z]{1,20})\s*:(?!//))\s*")
STATES = 2 * len(ROLES)  # 2 * role + (1 on later lines)


def features(lines: list[str]) -> np.ndarray:
    """For each line: marker (0 none, 1-3 a role's name, 4 another name), shape (empty, question or not by length)."""
    out = np.zeros((len(lines), 2), np.int64)
    blank = False
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        name = (m[1] or m[2]).lower() if m else None
        marker = 0 if name is None else _OF.get(name, 4)
        body = line[m.end() :] if m else line
        shape = 0 if not line.strip() else 1 + (len(body) > 200) + 2 * body.rstrip().endswith("?") + 4 * blank
        out[i] = marker, shape
        blank = not line.strip()
    return out


class Model:
    """Log probabilities of a hidden Markov model with independent features."""

    def __init__(self) -> None:
        self.start, self.step = np.ones(STATES), np.ones((STATES, STATES))
        self.start[1::2] = 1e-6  # a transcript starts with a turn
        later = np.arange(1, STATES, 2)
        self.step[:, later] = 1e-6
        self.step[later, later] = self.step[later - 1, later] = 1  # a later line has its turn's role
        self.emit = [np.ones((STATES, 5)), np.ones((STATES, 9))]
        self.emit[0][1::2, 1:4] = 0.1
        self.trained = False

    def learn(self, seen: np.ndarray, states: np.ndarray) -> None:
        self.trained = True
        self.start[states[0]] += 1
        np.add.at(self.step, (states[:-1], states[1:]), 1)
        for k, e in enumerate(self.emit):
            np.add.at(e, (states, seen[:, k]), 1)

    def decode(self, seen: np.ndarray) -> np.ndarray:
        """The most probable states; of equally probable ones the first."""
        if not self.trained:
            return np.minimum(np.arange(len(seen)), 1) + 2
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        start, step = log(self.start), log(self.step)
        e = sum(log(x)[:, seen[:, k]] for k, x in enumerate(self.emit)).T
        back = np.zeros((len(seen), STATES), np.int64)
        v = start + e[0]
        for i in range(1, len(seen)):
            w = v[:, None] + step
            back[i] = w.argmax(axis=0)
            v = w.max(axis=0) + e[i]
        out = np.zeros(len(seen), np.int64)
        out[-1] = int(v.argmax())
        for i in range(len(seen) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def parse(transcript: str, model: Model) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript, markers taken off."""
    lines = transcript.split("\n")
    return turns(lines, model.decode(features(lines)))


def turns(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for i, (line, s) in enumerate(zip(lines, states, strict=True)):
        role = ROLES[s // 2]
        if i == 0 or s % 2 == 0 or s // 2 != states[i - 1] // 2:
            m = MARKER.match(line)
            named = m and _OF.get((m[1] or m[2]).lower())
            out.append((role, [line[m.end() :] if named else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(x).strip("\n")) for role, x in out]


def render(found: list[tuple[str, str]]) -> str:
    """Canonical form: <|role|>, the text, <|end|>, a line each. Such markers inside texts get a space, so the form can be read back."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in found)


def write_transcript(conv: str, rows: list[tuple[str | None, str]], bare_every: int = 10) -> tuple[list[str], np.ndarray]:
    """The lines of a raw transcript of (role, text) turns and each line's true state (-1 where the role is unknown).

    The style follows from the id; about one turn in `bare_every`, never the first, has no marker.
    """
    style = STYLES[crc32(conv.encode()) % len(STYLES)]
    lines, states = [], []
    for i, (role, text) in enumerate(rows):
        k = ROLES.index(role) if role in ROLES else -1
        bare = i > 0 and crc32(f"{conv}/{i}".encode()) % bare_every == 0
        own = (("" if bare or k < 0 else style[k]) + (text or "")).split("\n")
        if i:
            lines.append("")
            states.append(states[-1] | 1 if states[-1] >= 0 else -1)
        lines += own
        states += [2 * k, *[2 * k + 1] * (len(own) - 1)] if k >= 0 else [-1] * len(own)
    return lines, np.array(states, np.int64)


def conversations(own: pd.DataFrame) -> Iterator[tuple]:
    """(conv_id, part, [(role, text)]) of rows sorted into conversations."""
    own = own.sort_values(["conv_id", "part", "turn", "role", "text"], kind="stable", na_position="first")
    for (i, part), rows in own.groupby(["conv_id", "part"], sort=True, dropna=False):
        yield i, part, [(r if isinstance(r, str) else None, t if isinstance(t, str) else "") for r, t in zip(rows["role"], rows["text"], strict=True)]


def fit(rows: DataFrame, most: int = 2000) -> Model:
    """A model from about `most` turns, conversations chosen by a hash of their id."""
    n = rows.count()
    some = rows.where(F.col("role").isin(*ROLES)).where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < min(1.0, most / max(1, n)) * (1 << 20)).limit(4 * most).toPandas()
    model = Model()
    for i, _, own in conversations(some.assign(part=0)):
        lines, states = write_transcript(str(i), own)
        model.learn(features(lines), states)
    return model


def _formatter(shared) -> Callable:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        model, out = received(shared), []
        for i, part, rows in conversations(own):
            lines, true = write_transcript(str(i), rows)
            states = model.decode(features(lines))
            found = turns(lines, states)
            out.append((i, part, len(lines), len(found), int((states // 2 == true // 2)[true >= 0].sum()), ",".join(r for r, _ in found), render(found)))
        frame = pd.DataFrame(out, columns=["conv_id", "segment", "n_lines", "n_turns", "n_lines_right", "roles", "rendered"])
        return frame.astype({"conv_id": "Int64"})

    return run


def format_chats(rows: DataFrame, model: Model, segment: int = 512, rows_per_part: int = 20_000) -> DataFrame:
    """A row for each conversation (segment) of rows (conv_id, turn, role, text), which are first written out as a raw transcript.

    n_lines_right counts the lines whose recovered role is that of the row they came from; the parser sees the transcript only.
    """
    thin = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    thin = thin.withColumn("part", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long"))
    deals = max(1, -(-rows.count() // rows_per_part))
    dealt = thin.withColumn("deal", F.pmod(F.xxhash64("conv_id", "part"), F.lit(deals)))
    schema = "conv_id long, segment long, n_lines long, n_turns long, n_lines_right long, roles string, rendered string"
    return dealt.groupBy("deal").applyInPandas(_formatter(share(rows.sparkSession, model)), schema)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_chats(rows, fit(rows))
