"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, with each turn between marks, and encoded once with
character offsets.  Turn spans and token spans are both sorted, so binary search finds the tokens
that overlap an assistant's text; the loss mask is those tokens, cut to the text where a token
straddles its edge.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipetally.llm.shared import pieces, reach_workers

TOKENIZER = "byte_bpe_50k.json"
#: The template (fixed values).  A role that is not listed is written as @ and itself, escaped.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
LEARNED = "assistant"

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### (@?)((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_NAMES = {v: k for k, v in ROLES.items()}


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the sorted spans of the learned texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + (ROLES.get(role) or "@" + escape(role).replace(":", "\\:")) + AFTER_ROLE
        body = escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a rendered conversation")
        out.append((unescape(m[2]) if m[1] else _NAMES[m[2]], unescape(m[3])))
        at = m.end()
    return out


def overlaps(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, end) of each token that overlaps a span, cut to the span.

    Where tokens share a character (its bytes are several tokens) the later ones get an empty cut, so
    that the cuts of a span, one after another, are its text once.
    """
    token, a, b = [], [], []
    first = np.searchsorted(ends, [s for s, _ in spans], side="right")
    last = np.searchsorted(starts, [e for _, e in spans], side="left")
    for (s, e), lo, hi in zip(spans, first.tolist(), last.tolist()):
        if lo < hi:
            cut_b = np.minimum(ends[lo:hi], e)
            cut_a = np.maximum(starts[lo:hi], s)
            cut_a = np.maximum(cut_a, np.concatenate(([s], np.maximum.accumulate(cut_b)[:-1])))
            token.append(np.arange(lo, hi))
            a.append(np.minimum(cut_a, cut_b))
            b.append(cut_b)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(token), join(a), join(b)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a worker process; the strings of its special tokens are ordinary text."""
    if path not in _TOKENIZERS:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


FORMATTED = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>"


def formatted(conversations: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """One row a conversation: its rendered string, token ids, and the masked tokens with their spans.

    Turns follow ``turn`` (ties: role, then text; null turns first); null texts and roles are empty;
    repeated rows are repeated turns; rows without a conv_id are one conversation; other columns are
    not looked at; an empty table gives an empty result.  A conversation is one string, so its rows
    come to one task by nature.
    """
    reach_workers(conversations.sparkSession)
    path = public_tokenizers.path(name)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", "t.role", "t.text")

    def work(batches):
        coder = tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(k, 64)
                for conv, roles, texts in zip(*(c.to_pylist() for c in part.columns)):
                    whole, spans = render(list(zip(roles, texts)))
                    e = coder.encode(whole, add_special_tokens=False)
                    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                    token, a, b = overlaps(spans, at[:, 0], at[:, 1])
                    out.append((conv, len(roles), whole, e.ids, token, a, b))
                kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in FORMATTED.split(", ")])

    return rows.mapInArrow(work, FORMATTED)


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from ``formatted``: the turns, and the text under the loss mask."""

    def work(batches):
        for b in pieces(batches):
            out = []
            for conv, whole, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
                turns = parse(whole)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                under = unescape("".join([whole[x:y] for x, y in zip(starts, ends)]))
                sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                out.append((conv, len(turns), sha(said), len(under), sha(under), len(whole)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(work, schema)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(formatted(rows.unionByName(two)))


QUERIES = {"op2_chat_formatting": op2_chat_formatting}

ORACLES = {
    "op2_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') esc from c),
g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) said,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') learned,
  sum(4 + length(role) + 2 + length(esc) + 8) formatted_chars from e group by 1)
select conv_id, cast(n_turns as bigint) n_turns, sha256(said) turns_sha256, cast(length(learned) as bigint) loss_chars,
  sha256(learned) loss_sha256, cast(formatted_chars as bigint) formatted_chars from g
"""
}
